"""Remote files, paged queries, and the registry of sources. Driver-side work; Spark reads what they leave."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path


class DownloadError(Exception):
    """A file that can't be fetched."""


class ChecksumMismatch(DownloadError):
    """A file whose contents aren't those that were asked for."""


@dataclass(frozen=True)
class RemoteFile:
    """A10: an https address and, if pinned, the SHA-256 of its contents."""

    url: str
    sha256: str | None = None

    def __post_init__(self) -> None:
        parts = urllib.parse.urlparse(self.url)
        if parts.scheme != "https" or not parts.netloc or not self.filename:
            raise ValueError(f"no https address of a file: {self.url}")
        if self.sha256 is not None and not re.fullmatch("[0-9a-f]{64}", self.sha256):
            raise ValueError("sha256 must be 64 lower-case hex digits")

    @property
    def filename(self) -> str:
        return urllib.parse.urlparse(self.url).path.rpartition("/")[2]

    @property
    def pinned(self) -> bool:
        return self.sha256 is not None


#: Opens an address and gives its contents in chunks; tests put their own here.
Opener = Callable[[str], Iterable[bytes]]


def https(url: str, chunk: int = 1 << 20) -> Iterable[bytes]:
    try:
        with urllib.request.urlopen(url, timeout=60) as reply:  # noqa: S310
            while part := reply.read(chunk):
                yield part
    except (urllib.error.URLError, TimeoutError) as e:
        raise DownloadError(f"{url}: {e}") from e


def sha256_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def download(remote: RemoteFile, folder: Path, opener: Opener = https) -> Path:
    """The file in the folder, fetched unless it is there; a pinned one is checked either way."""
    path = Path(folder) / remote.filename
    if path.exists():
        if remote.pinned and sha256_of(path) != remote.sha256:
            raise ChecksumMismatch(f"{path} isn't what {remote.url} should be")
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part, seen = path.with_name(path.name + ".part"), hashlib.sha256()
    try:
        with part.open("wb") as out:
            for chunk in opener(remote.url):
                seen.update(chunk)
                out.write(chunk)
        if remote.pinned and seen.hexdigest() != remote.sha256:
            raise ChecksumMismatch(f"{remote.url}: {seen.hexdigest()}")
        part.rename(path)
    finally:
        part.unlink(missing_ok=True)
    return path


@dataclass(frozen=True)
class PagedQuery:
    """A search whose result is fetched in pages."""

    term: str
    filename: str
    database: str = "nuccore"
    batch: int = 5_000
    max_missing: float = 0.001

    def __post_init__(self) -> None:
        if not self.term.strip() or not self.filename.endswith(".gz"):
            raise ValueError("a query needs a term and a .gz file name")
        if self.batch < 1 or not 0 <= self.max_missing < 1:
            raise ValueError("batch must be positive and max_missing lie in [0, 1)")


SERVICE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
ATTEMPTS = 4


def fetch(query: PagedQuery, folder: Path, opener: Opener = https, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Path:
    """All pages in one gzip file. Each page is tried ATTEMPTS times with longer pauses; a few records may be missing."""
    path = Path(folder) / query.filename
    if path.exists():
        return path

    def get(call: str, told: dict[str, str]) -> bytes:
        url = f"{SERVICE}/{call}.fcgi?{urllib.parse.urlencode(told)}"
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return b"".join(opener(url))
            except DownloadError:
                if attempt == ATTEMPTS:
                    raise
                sleep(pause * attempt)
        raise AssertionError

    try:
        found = json.loads(get("esearch", {"db": query.database, "term": query.term, "usehistory": "y", "retmode": "json", "retmax": "0"}))["esearchresult"]
        count, key, env = int(found["count"]), found["querykey"], found["webenv"]
    except (ValueError, KeyError) as e:
        raise DownloadError(f"no search result for {query.term}") from e
    if not count:
        raise DownloadError(f"nothing found for {query.term}")
    path.parent.mkdir(parents=True, exist_ok=True)
    part, got = path.with_name(path.name + ".part"), 0
    try:
        with gzip.open(part, "wb") as out:
            for start in range(0, count, query.batch):
                page = get("efetch", {"db": query.database, "query_key": key, "WebEnv": env, "rettype": "fasta", "retmode": "text", "retstart": str(start), "retmax": str(query.batch)})
                got += len(re.findall(rb"(?m)^>", page))
                out.write(page if page.endswith(b"\n") else page + b"\n")
                sleep(pause)
        if count - got > query.max_missing * count:
            raise DownloadError(f"{got} of {count} records came for {query.term}")
        part.rename(path)
    finally:
        part.unlink(missing_ok=True)
    return path


@dataclass(frozen=True)
class Source:
    """One collection: its parser, what is told to it, and its files. The order of sources decides merges."""

    slug: str
    parser: str
    inputs: tuple[tuple[RemoteFile | PagedQuery, tuple[tuple[str, str], ...]], ...]
    member: str | None = None
    backbone: bool = False

    def expected(self, folder: Path) -> list[Path]:
        return [Path(folder) / self.slug / i.filename for i, _ in self.inputs]


def missing_files(sources: Iterable[Source], folder: Path) -> list[Path]:
    """Every file that should be there and isn't."""
    return [p for s in sources for p in s.expected(folder) if not p.exists()]

"""Operator 10: token counts by merging adjacent pairs, without making any ids."""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pick
from .pieces import CACHE, Splitter


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The symbols left when the adjacent pair of lowest rank, leftmost first, is merged until none has a rank.

    A heap holds the ranked pairs by position and a linked list the symbols still
    there; a pair that a later merge changed is known by its stale text.
    """
    n = left = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return left


class Counter:
    """Counts tokens of texts; the counts of pieces met before are kept, up to CACHE of them."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.ranks = {(a, b): k for k, (a, b) in enumerate(self.splitter.model["merges"])}
        self.known: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        if (n := self.known.get(piece)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            letters = list(self.splitter.letters(piece))
            if self.splitter.words:
                letters[-1] += "</w>"
            n = merged_length(letters, self.ranks)
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def count(self, text: str) -> int:
        total = 0
        for special, pieces in self.splitter.segments(text):
            if special:
                total += 1
                continue
            counts = [*map(self.known.get, pieces)]
            if None in counts:
                counts = [self.piece(p) if n is None else n for p, n in zip(pieces, counts)]
            total += sum(counts)
        return total


@lru_cache(maxsize=2)
def kept_counts(path: str) -> Counter:
    """One for each worker process: a worker's later tasks find what its earlier ones met."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, its whole text counted.

    One narrow pass without a shuffle. A null text counts as empty: zero bytes and
    tokens. Null ids and repeated rows are kept row by row; an empty table gives no
    rows; any other columns are left out. Very long pieces are counted but not cached.
    """
    rows = pick(docs, id_column, text_column)
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        counter = kept_counts(path)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [id_column, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)

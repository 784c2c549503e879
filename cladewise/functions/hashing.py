"""Content hashes and deterministic draws.

BLAKE2b is the identity that results are bound to; Spark has none, so it runs in Arrow
UDFs. `md5` is a substitute draw that stays in the JVM and that other SQL engines can
repeat; it deals rows out differently.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def _blake2b(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=16).digest())


def sequence_hash(sequence: Column | str, impl: str = "blake2b") -> Column:
    """16 bytes that name a sequence."""
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    if impl == "md5":
        return F.unhex(F.md5(sequence))
    return _blake2b(sequence)


def unit_interval(key: bytes, seed: int, purpose: str) -> float:
    """S06 for one key."""
    digest = hashlib.blake2b(key, digest_size=8, key=seed.to_bytes(8, "little"), person=purpose.encode()).digest()
    return int.from_bytes(digest, "little") / 2**64


def copy_seed(parent: bytes, copy: int, seed: int) -> int:
    """The seed of one synthetic copy of a sequence."""
    digest = hashlib.blake2b(parent + copy.to_bytes(4, "little"), digest_size=8, key=seed.to_bytes(8, "little"), person=b"oversampling").digest()
    return int.from_bytes(digest, "little")


def draw(key: Column | str, seed: int, purpose: str, impl: str = "blake2b") -> Column:
    """A number in [0, 1) that key, seed and purpose alone decide."""
    key = F.col(key) if isinstance(key, str) else key
    if impl == "md5":
        told = F.concat(key.cast("string"), F.lit(f"|{seed}|{purpose}"))
        return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("bigint") / F.lit(float(2**60))

    @F.pandas_udf(T.DoubleType())
    def keyed(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else unit_interval(k.encode() if isinstance(k, str) else bytes(k), seed, purpose)).astype(float)

    return keyed(key)

"""Small helpers that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
CACHE = 400_000
#: Odd factors, one per place in a shingle: the powers of the first.
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name], F.lit(""))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo a number: the fold of a labelled row."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality on pairs of columns in which null equals null."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def packed(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The caller's columns as one struct ``row``: beside it a join may add any name, none clashes."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns if columns is None or c in columns]).alias("row")


def unpacked(columns: list[str], instead: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``row`` again, some by others."""
    return [(instead or {}).get(c, F.col("row").getField(c)).alias(c) for c in columns]

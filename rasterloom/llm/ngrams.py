"""Hashed character n-grams of many words at once, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of each size; a word's start and end count as one character each."""
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    edge = text == 10
    word = np.cumsum(edge) - 1
    owners, found = [], []
    for n in sizes:
        count = len(text) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        ok = np.ones(count, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[k : k + count]
            if 0 < k < n - 1 or n == 1:
                ok &= ~edge[k : k + count]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        owners.append(word[:count][ok])
        found.append((h >> np.uint64(40))[ok] % np.uint64(buckets))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


def word_sums(words: list[str], sizes: tuple[int, ...], values: np.ndarray, mean: bool = False) -> np.ndarray:
    """For each word the sum, or mean, of values[bucket] over its n-grams."""
    out = np.zeros((len(words), values.shape[1]), np.float32)
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        owner, bucket = hashed(part, sizes, len(values))
        rows = values[bucket]
        for k in range(values.shape[1]):
            out[at : at + len(part), k] = np.bincount(owner, rows[:, k], len(part))
        if mean:
            out[at : at + len(part)] /= np.maximum(1, np.bincount(owner, minlength=len(part)))[:, None]
    return out


def shares(rows: DataFrame, label: str, per_label: int) -> tuple[DataFrame, int]:
    """About per_label rows of each label, those of the least hashes of doc_id, and a bound on how many.

    The bound holds at every size of the table: the share that is taken shrinks as a label's rows grow. Every label is
    taken, however rare.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_of_label"))
    most = 2 * per_label * max(1, counts.count())
    spot = F.xxhash64("doc_id").bitwiseAND(0xFFFFFFFF) / F.lit(float(1 << 32))
    taken = rows.join(counts, label).where(spot * F.col("_of_label") < per_label)
    return taken.orderBy(spot, *rows.columns).limit(most).drop("_of_label"), most


def stretch(text: Column, doc_id: Column, most_chars: int) -> Column:
    """The text, or of a longer one a stretch of most_chars characters that the hash of doc_id chooses."""
    start = F.pmod(F.xxhash64(doc_id), F.length(text) - most_chars + 1).cast("int") + 1
    return F.when(F.length(text) <= most_chars, text).otherwise(text.substr(start, F.lit(most_chars)))


def sample(rows: DataFrame, label: str, per_label: int, most_chars: int) -> list:
    """About per_label rows (doc_id, text, label) of each label; of longer texts than most_chars a stretch."""
    taken, most = shares(rows.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select("doc_id", label), label, per_label)
    texts = rows.select("doc_id", label, stretch(F.col("text"), F.col("doc_id"), most_chars).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(taken.distinct()), ["doc_id", label])  # `most` rows at most
    spot = F.xxhash64("doc_id")
    return in_order(found.select("doc_id", "text", label).orderBy(spot, "doc_id", "text", label).limit(2 * most).collect())


def in_order(rows: list) -> list:
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[2]), r[1]))


class Vocabulary:
    """Rows of what is known of each distinct word; emptied when full, so that it never outgrows its bound."""

    def __init__(self, compute, most: int):
        self.compute, self.most = compute, most
        self.at: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def index(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word of all texts, one after another, and the rows."""
        for attempt in (0, 1):
            new = list(dict.fromkeys(w for words in texts for w in words if w not in self.at)) if self.at else list(dict.fromkeys(w for words in texts for w in words))
            if attempt or len(self.at) + len(new) <= self.most:
                break
            self.at = {}
            self.rows = None
        if new:
            rows = self.compute(new)
            start = len(self.at)
            self.at.update(zip(new, range(start, start + len(new)), strict=True))
            if self.rows is None or start + len(new) > len(self.rows):
                grown = np.zeros((max(2 * (start + len(new)), 1024), rows.shape[1]), rows.dtype)
                if self.rows is not None:
                    grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start : start + len(new)] = rows
        if self.rows is None:
            self.rows = self.compute(["a"])[:0]
        get = self.at.__getitem__
        index = np.fromiter((i for words in texts for i in map(get, words)), np.int32, sum(map(len, texts)))
        return index, self.rows

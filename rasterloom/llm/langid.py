"""Languages of texts as a mixture: expectation-maximisation over n-gram likelihoods.

Each language is a multinomial over hashed character n-grams. A text is a run of units of a few words, each unit in
one of the text's languages; expectation-maximisation finds the proportions that make the units likeliest, for the
one, two, ... languages of the largest shares, and the set of the best penalised likelihood is kept.

Every language of the labels is learned, and a text's set may hold any number of them. The model is fitted on a bounded
sample of labelled rows: about `per_language` texts of each language, of longer ones a stretch of `most_chars` characters.
Texts are read whole, however long. A text that is null or has no letter is `und` with score 0. With no labelled rows at all, every
text is `und`. A null doc_id is kept. Repeated rows come back as often as they came; an empty table gives no rows;
extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, held_out
from rasterloom.llm.ngrams import Vocabulary, hashed, sample, word_sums

WORD = re.compile(r"[^\W\d_]+")
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Words of a unit.
UNIT = 8
#: Rounds of expectation-maximisation.
ROUNDS = 8
#: What each further language costs, times the logarithm of the number of units.
PENALTY = 1.5
VOCABULARY = 300_000


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # log probability of each bucket under each language


def fit(rows: list, smoothing: float = 0.5) -> Model:
    """Multinomials of (doc_id, text, language) rows."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    counts = np.zeros((BUCKETS, len(languages)))
    for k, language in enumerate(languages):
        words = [w for r in rows if r[2] == language for w in WORD.findall(r[1].lower())]
        for at in range(0, len(words), 100_000):
            counts[:, k] += np.bincount(hashed(words[at : at + 100_000], SIZES, BUCKETS)[1], minlength=BUCKETS)
    scores = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=0))
    return Model(languages, (scores - scores.mean(axis=1, keepdims=True)).astype(np.float32))


def mixtures(units: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions over its chosen languages, and how many it has; starts has the first unit of each text."""
    n, k = len(starts), units.shape[1]
    sizes = np.diff(np.r_[starts, len(units)])
    of = np.repeat(np.arange(n), sizes)
    top = units.max(axis=1)
    near = np.exp(units - top[:, None])
    offset = np.add.reduceat(top, starts)

    def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            r = share[of] * near + 1e-300
            r /= r.sum(axis=1, keepdims=True)
            share = np.add.reduceat(r, starts, axis=0) / sizes[:, None] * allowed
            share /= share.sum(axis=1, keepdims=True)
        return share, np.add.reduceat(np.log((share[of] * near).sum(axis=1) + 1e-300), starts) + offset

    free, _ = em(np.ones((n, k)))
    place = np.argsort(np.argsort(-free, axis=1, kind="stable"), axis=1, kind="stable")
    best, value, chosen = None, None, None
    for m in range(1, k + 1):
        share, likelihood = em((place < m).astype(float))
        now = likelihood - PENALTY * (m - 1) * np.log(sizes + 1.0) * UNIT
        if best is None:
            best, value, chosen = share, now, np.ones(n, int)
            continue
        better = now > value
        best[better], value[better], chosen[better] = share[better], now[better], m
        # No more languages can pay for what they cost, even if every unit were in its likeliest one.
        if not (offset - PENALTY * m * np.log(sizes + 1.0) * UNIT > value).any():
            break
    return best, chosen


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.words = Vocabulary(self.look, VOCABULARY)

    def look(self, words: list[str]) -> np.ndarray:
        """A word's score under each language, and at the end whether it has a letter."""
        letters = np.array([any(c.isalpha() for c in w) for w in words], np.float32)[:, None]
        return np.hstack([word_sums(words, SIZES, self.model.scores) * letters, letters])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """(language, score, its languages with their shares) of each text."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        out = [("und", 0.0, "")] * len(texts)
        if not self.model.languages:
            return out
        index, rows = self.words.index(words)
        lengths = np.array([len(w) for w in words])
        has = np.flatnonzero(lengths)
        if not len(has):
            return out
        begins = (np.cumsum(lengths) - lengths)[has]
        per = (lengths[has] + UNIT - 1) // UNIT
        starts = np.cumsum(per) - per
        cuts = np.repeat(begins - starts * UNIT, per) + np.arange(per.sum()) * UNIT
        units = np.add.reduceat(rows[index].astype(np.float64), cuts, axis=0)
        letters = np.add.reduceat(units[:, -1], starts) > 0
        shares, _ = mixtures(units[:, :-1], starts)
        best = shares.argmax(axis=1)
        for i, ok, k, share in zip(has, letters, best, shares, strict=True):
            if ok:
                named = ",".join(f"{self.model.languages[j]}:{share[j]:.3f}" for j in np.argsort(-share, kind="stable") if share[j] > 0.0005)
                out[i] = (self.model.languages[k], float(min(1.0, share[k])), named)
        return out


def query(docs: DataFrame, per_language: int = 1500, most_chars: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the mixture of every document; learns from the other folds alone."""
    import pyarrow as pa

    model = fit(sample(docs.where(~held_out(F.col("doc_id"))).where(F.col("lang").isNotNull()), "lang", per_language, most_chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Predictor(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string())))],
                    names=["doc_id", "held_out", "lang_pred", "score", "mixture"],
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, mixture string")

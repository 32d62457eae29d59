"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as a learned vector of the word itself (hashed) beside the mean of learned vectors of its characters'
n-grams (hashed). Two gated recurrent layers read a window of words in both directions, attention weighs their states
and a logistic unit scores the window. Windows overlap by half and cover the whole text; a text's score is its
highest window's.

Labels mark texts, not windows, so training is by multiple instances: a first linear model of the same inputs picks
the likeliest windows of each text, the network learns from those (and from random windows of clean texts), then picks
windows itself and learns again. At the end the logit's offset is set on whole training texts.

It learns from about `per_label` labelled ids of each label, and of texts longer than `most_chars` from a stretch of so
many characters; it scores whole texts, however long. Empty and null texts are one empty window and score as such. With no labels of both kinds every score is 0.0. A null doc_id is kept.
Repeated rows come back as often as they came; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, held_out
from rasterloom.llm.ngrams import Vocabulary, hashed, in_order, shares, stretch

WORD = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 16, 8
HIDDEN = 8
WORD_BUCKETS, WORD_SIZE = 1 << 15, 8
GRAM_BUCKETS, GRAM_SIZE = 1 << 16, 8
GRAMS = (3, 4, 5, 6)
VOCABULARY = 150_000


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_bucket(words: list[str]) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words], np.int64)


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows over n words."""
    return np.arange(0, max(1, n - STRIDE if n > WINDOW else 1), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, the forward pass over windows and its gradients."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        d = WORD_SIZE + GRAM_SIZE

        def start(*shape: int, scale: float | None = None) -> np.ndarray:
            return (g.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        self.p = {
            "words": start(WORD_BUCKETS, WORD_SIZE, scale=0.1), "grams": start(GRAM_BUCKETS, GRAM_SIZE, scale=0.3),
            **{f"w{s}": start(d, 3 * HIDDEN) for s in "fb"}, **{f"u{s}": start(HIDDEN, 3 * HIDDEN) for s in "fb"}, **{f"b{s}": np.zeros(3 * HIDDEN, np.float32) for s in "fb"},
            "wa": start(2 * HIDDEN, HIDDEN), "ba": np.zeros(HIDDEN, np.float32), "va": start(HIDDEN), "wo": start(2 * HIDDEN), "bo": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[str]) -> np.ndarray:
        """A word's vector: of the word, and the mean of its n-grams'."""
        out = np.zeros((len(words), WORD_SIZE + GRAM_SIZE), np.float32)
        out[:, :WORD_SIZE] = self.p["words"][word_bucket(words)]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            owner, bucket = hashed(part, GRAMS, GRAM_BUCKETS)
            rows, n = self.p["grams"][bucket], np.maximum(1, np.bincount(owner, minlength=len(part)))
            for k in range(GRAM_SIZE):
                out[at : at + len(part), WORD_SIZE + k] = np.bincount(owner, rows[:, k], len(part)) / n
        return out

    def projected(self, words: list[str]) -> np.ndarray:
        """What both directions' gates take from a word; the same wherever it stands."""
        x = self.inputs(words)
        return np.hstack([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]])

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; gates are [step, window, 6 hidden], mask [step, window] is 1 where a word is."""
        steps, n, _ = gates.shape
        h2, h3 = 2 * HIDDEN, 3 * HIDDEN
        states = np.zeros((steps, n, h2), gates.dtype)
        tape = []
        for s, order, lo in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), 1)):
            u, h = self.p["u" + s], np.zeros((n, HIDDEN), gates.dtype)
            for t in order:
                x, m = gates[t, :, lo * h3 : (lo + 1) * h3], mask[t][:, None]
                zr = _sigmoid(x[:, :h2] + h @ u[:, :h2])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, h2:] + (r * h) @ u[:, h2:])
                new = h + m * z * (c - h)
                if keep:
                    tape.append((s, t, h, z, r, c, m))
                h = new
                states[t, :, lo * HIDDEN : (lo + 1) * HIDDEN] = h
        hidden = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = hidden @ self.p["va"] - 30.0 * (1 - mask)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        logits = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logits, (tape, states, hidden, a, pooled)) if keep else logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted log loss; x are the inputs [step, window, size]. Also those of x, and the loss."""
        p, h2 = self.p, 2 * HIDDEN
        gates = np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], axis=2)
        logits, (tape, states, hidden, a, pooled) = self.forward(gates, mask, keep=True)
        prob = _sigmoid(logits)
        g = {}
        dl = ((prob - y) * weight / weight.sum()).astype(gates.dtype)
        g["wo"], g["bo"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["wo"]
        da = (states * dpool).sum(axis=2)
        dstates = a[:, :, None] * dpool
        de = a * (da - (a * da).sum(axis=0))
        g["va"] = (hidden * de[:, :, None]).sum(axis=(0, 1))
        dhid = de[:, :, None] * p["va"] * (1 - hidden**2)
        g["wa"], g["ba"] = np.tensordot(states, dhid, axes=((0, 1), (0, 1))), dhid.sum(axis=(0, 1))
        dstates = dstates + dhid @ p["wa"].T
        dx = np.zeros_like(x)
        for s, lo in (("b", 1), ("f", 0)):
            u = p["u" + s]
            du, dw, db = np.zeros_like(u), np.zeros_like(p["w" + s]), np.zeros_like(p["b" + s])
            dh = np.zeros((x.shape[1], HIDDEN), x.dtype)
            for side, t, h, z, r, c, m in reversed(tape):
                if side != s:
                    continue
                d = dh + dstates[t, :, lo * HIDDEN : (lo + 1) * HIDDEN]
                dz, dc = d * m * (c - h) * z * (1 - z), d * m * z * (1 - c**2)
                drh = dc @ u[:, h2:].T
                dr = drh * h * r * (1 - r)
                dgate = np.hstack([dz, dr, dc])
                du[:, :h2] += h.T @ dgate[:, :h2]
                du[:, h2:] += (r * h).T @ dc
                dw += x[t].T @ dgate
                db += dgate.sum(axis=0)
                dx[t] += dgate @ p["w" + s].T
                dh = d * (1 - m * z) + drh * r + dgate[:, :h2] @ u[:, :h2].T
            g["u" + s], g["w" + s], g["b" + s] = du, dw, db
        loss = float(-(weight * np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-9)).sum() / weight.sum())
        return g, dx, loss


class Scorer:
    """Scores whole texts, all overlapping windows of each."""

    def __init__(self, net: Network):
        self.net, self.words = net, Vocabulary(net.projected, VOCABULARY)

    def window_logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, text after text, and how many windows each text has."""
        index, rows = self.words.index(texts)
        lengths = np.array([len(t) for t in texts])
        begins = np.cumsum(lengths) - lengths
        each = [windows(n) for n in lengths]
        per = np.array([len(w) for w in each])
        first = np.concatenate(each)
        size = np.repeat(lengths, per)
        valid = np.clip(size - first, 0, WINDOW)
        first = first + np.repeat(begins, per)
        out = np.zeros(len(first), np.float32)
        steps = np.arange(WINDOW)
        for at in range(0, len(first), 2048):
            f, v = first[at : at + 2048], valid[at : at + 2048]
            mask = (steps[:, None] < v).astype(np.float32)
            if len(index):
                gates = rows[index[np.minimum(f + steps[:, None], len(index) - 1)]]
            else:
                gates = np.zeros((WINDOW, len(f), 6 * HIDDEN), np.float32)
            out[at : at + 2048] = self.net.forward(gates, mask)
        return out, per

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        logits, per = self.window_logits([tokens(t) for t in texts])
        return _sigmoid(np.maximum.reduceat(logits, np.cumsum(per) - per).astype(np.float64))


def _linear(words: list[str], index: list[np.ndarray], y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """A first score of each distinct word: the log odds of its n-grams and of itself between texts of either label."""
    owner, bucket = hashed(words, GRAMS, GRAM_BUCKETS)
    bucket = np.r_[bucket, GRAM_BUCKETS + word_bucket(words)]
    owner = np.r_[owner, np.arange(len(words))]
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    starts = np.searchsorted(owner, np.arange(len(words) + 1))
    seen = np.zeros((2, GRAM_BUCKETS + WORD_BUCKETS))
    for i, label in zip(index, y, strict=True):
        distinct = np.unique(i)
        if len(distinct):
            hit = np.unique(np.concatenate([bucket[starts[k] : starts[k + 1]] for k in distinct]))
            seen[int(label), hit] += 1
    n = np.bincount(y.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen.sum(axis=0) < 4] = 0
    best = np.full(len(words), -9.0)
    np.maximum.at(best, owner, odds[bucket])
    return best


def fit(rows: list, seed: int = 7, epochs: tuple[int, ...] = (6, 4), batch: int = 128, rate: float = 0.01, random_windows: int = 2) -> Network | None:
    """The network of (doc_id, text, toxic) rows; None without both labels."""
    y = np.array([float(r[2]) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    net, g = Network(seed), np.random.default_rng(seed)
    texts = [tokens(r[1]) for r in rows]
    names = list(dict.fromkeys(w for t in texts for w in t)) or ["a"]
    at = {w: k for k, w in enumerate(names)}
    index = [np.array([at[w] for w in t], np.int64) for t in texts]
    first = _linear(names, index, y)
    owner, bucket = hashed(names, GRAMS, GRAM_BUCKETS)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    starts = np.searchsorted(owner, np.arange(len(names) + 1))
    crc = word_bucket(names)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def picked(score) -> tuple[np.ndarray, np.ndarray]:
        """Windows (text, first word) to learn from: each text's best by score(text), and random ones of clean texts."""
        found = []
        for i, words in enumerate(index):
            begin = windows(len(words))
            s = score(i, begin)
            top = np.argsort(-s, kind="stable")[: 1 if y[i] else 2]
            found += [(i, int(begin[k])) for k in top]
            if not y[i]:
                found += [(i, int(k)) for k in g.choice(begin, min(random_windows, len(begin)), replace=False)]
        found = sorted(set(found))
        return np.array([f[0] for f in found]), np.array([f[1] for f in found])

    def by_words(i: int, begin: np.ndarray) -> np.ndarray:
        return np.array([np.sort(first[index[i][b : b + WINDOW]])[-2:].sum() if len(index[i]) else 0.0 for b in begin])

    steps = np.arange(WINDOW)
    for phase, passes in enumerate(epochs):
        if phase == 0:
            of, begin = picked(by_words)
        else:
            scorer = Scorer(net)
            logits = []
            for lo in range(0, len(texts), 256):
                got, per = scorer.window_logits(texts[lo : lo + 256])
                logits += np.split(got, np.cumsum(per)[:-1])
            of, begin = picked(lambda i, b, known=logits: known[i])
        label = y[of]
        weight = np.where(label > 0.5, 1 / max(1, (label > 0.5).sum()), 1 / max(1, (label < 0.5).sum())) * len(label)
        for _ in range(passes):
            shuffled = g.permutation(len(of))
            for lo in range(0, len(of), batch):
                pick = shuffled[lo : lo + batch]
                cut = [index[of[k]][begin[k] : begin[k] + WINDOW] for k in pick]
                mask = np.array([[t < len(c) for c in cut] for t in steps], np.float32)
                ids = np.array([[c[t] if t < len(c) else 0 for c in cut] for t in steps])
                distinct, inverse = np.unique(ids, return_inverse=True)
                inverse = inverse.reshape(ids.shape)
                x = np.zeros((len(distinct), WORD_SIZE + GRAM_SIZE), np.float32)
                x[:, :WORD_SIZE] = net.p["words"][crc[distinct]]
                spans = [bucket[starts[k] : starts[k + 1]] for k in distinct]
                own = np.repeat(np.arange(len(distinct)), [len(s) for s in spans])
                flat = np.concatenate(spans)
                n = np.maximum(1, np.bincount(own, minlength=len(distinct)))[:, None]
                for k in range(GRAM_SIZE):
                    x[:, WORD_SIZE + k] = np.bincount(own, net.p["grams"][flat, k], len(distinct)) / n[:, 0]
                grads, dx, _ = net.gradients(x[inverse] * mask[:, :, None], mask, label[pick], weight[pick])
                dword = np.zeros_like(x)
                np.add.at(dword, inverse.ravel(), (dx * mask[:, :, None]).reshape(-1, x.shape[1]))
                step += 1
                pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, d in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    net.p[k] -= (pace * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
                for k, rows_, d in (("words", crc[distinct], dword[:, :WORD_SIZE]), ("grams", flat, (dword[:, WORD_SIZE:] / n)[own])):
                    touched, back = np.unique(rows_, return_inverse=True)
                    total = np.zeros((len(touched), d.shape[1]), np.float32)
                    for j in range(d.shape[1]):
                        total[:, j] = np.bincount(back, d[:, j], len(touched))
                    m, v = moment[k]
                    m[touched] += 0.1 * (total - m[touched])
                    v[touched] += 0.001 * (total * total - v[touched])
                    net.p[k][touched] -= (pace * m[touched] / (np.sqrt(v[touched]) + 1e-7)).astype(np.float32)
    # The offset under which most training texts fall on their side, a clean one counting twice; the middle of such.
    scorer, top = Scorer(net), []
    for lo in range(0, len(texts), 256):
        got, per = scorer.window_logits(texts[lo : lo + 256])
        top.append(np.maximum.reduceat(got, np.cumsum(per) - per))
    top = np.concatenate(top)
    cuts = np.unique(top)
    up, down = np.sort(top[y > 0.5]), np.sort(top[y < 0.5])
    right = 1 - np.searchsorted(up, cuts, side="left") / len(up) + 2 * np.searchsorted(down, cuts, side="left") / len(down)
    best = np.flatnonzero(right >= right.max() - 1e-9)
    low = cuts[best[0] - 1] if best[0] else cuts[0]
    net.p["bo"] = (net.p["bo"] - (low + cuts[best[-1]]) / 2).astype(np.float32)
    return net


def query(docs: DataFrame, labels: DataFrame, per_label: int = 2500, most_chars: int = 16_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from the other folds alone.

    labels has doc_id and toxic (0 or 1); rows whose label is null teach nothing, and a document that labels marks
    twice counts as often in the sample, whatever the marks.
    """
    import pyarrow as pa

    known, most = shares(labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))), "toxic", per_label)
    texts = docs.select("doc_id", stretch(F.col("text"), F.col("doc_id"), most_chars).alias("text")).where("text is not null")
    marked = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")  # `most` rows at most
    net = fit(in_order(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(2 * most).collect()))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of one size, whatever the corpus

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(1).to_pylist()
                scores = of(texts) if of else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")

"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Documents become token counts on the executors (ids never leave them); only the histogram of piece lengths, whose
size is the capacity, comes to the driver. There the linear program over configurations is solved: its weights, one a
length, are multiplied by what a length needs over what it gets, and a knapsack dynamic program over all lengths prices
the configurations. The program keeps sums where one for the dearest configuration keeps maxima, so that one pass
prices all configurations, tells the coverage that they bring and draws thousands of them, where each pass of the other
brings one. The solution is rounded by taking drawn configurations whole as long as pieces last, again and again on
what is left; the last twentieth is filled by a knapsack, longest length first. The plan is a list of runs (length,
ranks, first sequence), as bounded as the histogram; executors look it up for each piece by its rank among the pieces
of its length.

`pack_in_order` keeps the order of its input as well: it cuts the pieces, in the order of the files and rows they came
in, into runs of so many sequences' tokens, and packs each run by a program of its own, on the executors. Sequences of
a run follow those of the runs before it, so that every prefix of whole runs holds a prefix of the input.

Texts are read whole, however long, and cut only into pieces. Nulls count as empty texts: a document of no ids is its end token alone. A null doc_id is a document like others.
Repeated rows are packed each on its own. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import functools
import math
import re
import threading
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, materialize, ranked, tokenizer

CAPACITY = 4096
END_ID = 1
SEED = 8
#: Where the weight of unfilled tokens starts, and the share of them that solutions are led to.
WASTE, SPARE = 1e-3, 1e-3
#: The power of needed over got coverage in a factor, and the part of the last factor.
RATE, MOMENTUM = 0.6, 0.5
#: Sequences' tokens in a run of `pack_in_order`: a share of all sequences, within these bounds.
RUN_SHARE, LEAST_RUN, MOST_RUN = 1 / 32, 16, 256
#: Runs between blanks whose ids a worker keeps, some 200 bytes each: half of them those of late, half those before.
CACHE_RUNS = 1_000_000
#: The same in `pack_in_order`, whose workers lie beside what other stages have left on their executors.
CACHE_IN_ORDER = 500_000
#: Seconds after it last encoded that a process keeps them: workers outlive their stage, idle or at other work.
KEPT_S = 3.0
#: Characters of texts encoded at once, or one longer text.
ENCODED = 1 << 22
#: Words of Latin-1 texts as the tokenizer splits them, after lower-casing.
LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-z0-9ªµº²³¹¼½¾\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


#: Separators at which Python splits and the tokenizer does not.
UNLIKE = "\x1c\x1d\x1e\x1f"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def run_ids(path: str) -> list[dict[str, bytes]]:
    """The ids of runs, those of late and those before."""
    return [{}, {}]


#: By tokenizer, what will forget the ids of runs.
_timers: dict[str, threading.Timer] = {}


def forget(path: str) -> None:
    """Lets the ids of runs go, and what memory is free then."""
    import pyarrow as pa

    run_ids(path)[:] = [{}, {}]
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


@functools.cache
def _ends_word(path: str) -> np.ndarray:
    """For each id, whether its token ends a word."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    return ends


@functools.cache
def _lean(path: str):
    """The tokenizer for text that is lower-cased, whose words blanks separate: all of it but the normalizer and the split."""
    from tokenizers import Tokenizer, pre_tokenizers

    lean = Tokenizer(tokenizer(path).model)
    lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return lean


def _encode_words(words: list[str], path: str) -> dict[str, bytes]:
    """The ids of each word: of all at once, cut after the ids that end words; one by one should the ends not agree."""
    ids = np.array(_lean(path).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
    ends = (4 * (np.flatnonzero(_ends_word(path)[ids]) + 1)).tolist()
    if len(ends) != len(words) or ends and ends[-1] != 4 * len(ids):
        return {w: np.array(tokenizer(path).encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}
    all_ids = ids.tobytes()
    return {w: all_ids[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}


def _encode_runs(runs: list[str], path: str, most: int) -> list[bytes]:
    """The ids of each of distinct runs between blanks: those kept, and those of its words, which are looked up as runs first; most are kept."""
    caches = run_ids(path)
    known, before = caches
    ids = list(map(known.get, runs))
    missing = [k for k, x in enumerate(ids) if x is None]
    inner: dict[int, list[str]] = {}
    for k in missing:
        r = runs[k]
        if (x := before.get(r)) is not None:
            ids[k] = known[r] = x
        else:
            inner[k] = [r] if r.isalpha() else LATIN_WORD.findall(r)
    of: dict[str, bytes] = {}
    new = []
    for w in {w for ws in inner.values() for w in ws}:
        if (x := known.get(w) or before.get(w)) is None:
            new.append(w)
        else:
            of[w] = x
    for at in range(0, len(new), 2000):
        of.update(_encode_words(new[at : at + 2000], path))
    for k, ws in inner.items():
        ids[k] = known[runs[k]] = of[ws[0]] if len(ws) == 1 else b"".join([of[w] for w in ws])
    if len(known) > most // 2:
        caches[:] = [{}, known]
    return ids


def encode(texts: list[str], path: str, most: int = CACHE_RUNS) -> list[bytes]:
    """Each text's ids as little-endian 32-bit numbers.

    Texts within Latin-1 are lower-cased and split here, at blanks and then into the tokenizer's words; each distinct
    run between blanks is looked up once a call, and its ids are kept; the tokenizer gives a word the same ids wherever it stands. Other texts,
    and those with a special token's opening or a separator that only one of the two splits at, go to it whole.

    At most `most` runs' ids are kept from call to call, and none once KEPT_S have passed without one.
    """
    import pyarrow as pa

    if timer := _timers.pop(path, None):
        timer.cancel()
    out = _encode(texts, path, most)
    pa.default_memory_pool().release_unused()  # else a worker holds some 130 MB of freed buffers
    _timers[path] = timer = threading.Timer(KEPT_S, forget, [path])
    timer.daemon = True
    timer.start()
    return out


def _encode(texts: list[str], path: str, most: int) -> list[bytes]:
    import pyarrow as pa
    import pyarrow.compute as pc

    out: list = [None] * len(texts)
    plain: list[int] = []
    for i, text in enumerate(texts):
        try:
            if "<|" in text or any(c in text for c in UNLIKE):
                raise ValueError
            text.isascii() or text.encode("latin-1")
        except ValueError:
            out[i] = np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            continue
        plain.append(i)
    split = pc.utf8_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
    coded = split.values.dictionary_encode()
    ids = _encode_runs(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), path, most)
    tokens, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    run = coded.indices.to_numpy()
    ends = np.r_[0, np.cumsum(sizes[run])]  # of runs among all texts' ids
    at = np.repeat((np.cumsum(sizes) - sizes)[run] - ends[:-1], sizes[run])
    at += np.arange(len(at))
    all_ids = tokens[at].tobytes()
    bounds = (4 * ends[split.offsets.to_numpy()]).tolist()
    for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
        out[i] = all_ids[a:b]
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, more: str = "", most: int = CACHE_RUNS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and end token, cut at the capacity.

    more names columns of docs, with their types, that each piece keeps; most is as in `encode`.
    """
    import pyarrow as pa

    path = path or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()
    bounded_batches(docs.sparkSession)
    kept = [c.split()[0] for c in more.split(",") if c]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            reach = np.cumsum([len(t or "") + 1 for t in texts])
            hi = 0
            while (lo := hi) < len(texts):
                hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + ENCODED, side="right")))
                took: list[int] = []
                rows: list[tuple[int, int, int, int]] = []
                for i, ids in enumerate(encode([t or "" for t in texts[lo:hi]], path, most), lo):
                    ids += end
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        took.append(i)
                        rows.append((k, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)])))
                cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
                at = pa.array(took)
                others = [batch.column(k).take(at) for k in range(2, 2 + len(kept))]
                yield pa.RecordBatch.from_arrays([keys.take(at), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:]), *others], names=["doc_id", "piece", "start", "length", "ids_crc32", *kept])

    return docs.select("doc_id", "text", *kept).mapInArrow(cut, ", ".join(["doc_id long, piece int, start long, length long, ids_crc32 long", *([more] if more else [])]))


def _steps(lengths: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Rows (index of a length, copies, their tokens): each length's copies within room and most, in powers of two."""
    rows = []
    for k, (length, n) in enumerate(zip(lengths.tolist(), most.tolist(), strict=True)):
        n, copies = min(n, room // length), 1
        while n > 0:
            copies = min(copies, n)
            n -= copies
            rows.append((k, copies, length * copies))
            copies *= 2
    return np.array(rows, np.int64).reshape(-1, 3)


def _fill(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """How often to take each length for the highest price within room, and that price: a knapsack."""
    steps, best = _steps(lengths, most, room), np.zeros(room + 1)
    better = np.zeros((len(steps), room + 1), bool)
    for s, (k, copies, w) in enumerate(steps.tolist()):
        other = best[: room + 1 - w] + prices[k] * copies
        np.greater(other, best[w:] + 1e-12, out=better[s, w:])
        np.copyto(best[w:], other, where=better[s, w:])
    used, at = np.zeros(len(lengths), np.int64), int(np.argmax(best))
    price = float(best[at])
    for s in range(len(steps) - 1, -1, -1):
        if better[s, at]:
            used[steps[s, 0]] += steps[s, 1]
            at -= steps[s, 2]
    return used, price


class _Pricing:
    """A knapsack over all lengths that weighs every configuration at once, by the product of its lengths' weights.

    The program runs over (length, copies) and filled tokens, as that for the dearest configuration does, with sums
    in place of maxima; so it gives the coverage that configurations bring on average, and draws as many of them as are
    asked for. Unfilled tokens have a weight of their own.
    """

    def __init__(self, lengths: np.ndarray, most: np.ndarray, capacity: int):
        self.steps, self.capacity, self.n = _steps(lengths, most, capacity), capacity, len(lengths)
        self.copies = np.bincount(self.steps[:, 0], self.steps[:, 1], self.n)
        self.taken = np.zeros((len(self.steps), capacity + 1), np.float32)

    def weigh(self, odds: np.ndarray, waste: float) -> None:
        """The chance, by filled tokens, that a step is taken; odds are those of each length's single copy, waste those of unfilled tokens."""
        part = np.full(self.capacity + 1, waste / self.capacity)
        part[0], scale = 1.0, 0.0
        add = np.empty_like(part)
        chance = odds / (1 + odds)
        for s, (k, _, w) in enumerate(self.steps.tolist()):
            more = add[: self.capacity + 1 - w]
            np.multiply(part[: self.capacity + 1 - w], chance[k], out=more)
            part *= 1 - chance[k]
            part[w:] += more
            np.divide(more, np.maximum(part[w:], 1e-300), out=self.taken[s, w:], casting="unsafe")
            if s % 16 == 15:
                most = part.max()
                part /= most
                scale += math.log(most)
        self.odds, self.waste = np.log(odds), math.log(waste / self.capacity)
        self.none = float(np.log1p(-chance)[self.steps[:, 0]].sum()) - math.log(max(part[self.capacity], 1e-300)) - scale

    def coverage(self) -> tuple[np.ndarray, float]:
        """How often a configuration holds each length, and the tokens that it leaves unfilled, both on average."""
        at = np.zeros(self.capacity + 1, np.float32)
        at[self.capacity] = 1.0
        out = np.zeros(self.n)
        for s in range(len(self.steps) - 1, -1, -1):
            k, copies, w = self.steps[s]
            moved = at[w:] * self.taken[s, w:]
            out[k] += copies * float(moved.sum())
            at[w:] -= moved
            at[: self.capacity + 1 - w] += moved
        return out, float(at @ np.arange(self.capacity + 1))

    def draw(self, n: int, rng: np.random.Generator) -> list[tuple[int, float, int, np.ndarray, np.ndarray]]:
        """The distinct ones of n drawn configurations: (unfilled tokens, chance, draws, indices of lengths, times), the fullest first."""
        at, rows, steps = np.full(n, self.capacity), [], []
        for s in range(len(self.steps) - 1, -1, -1):
            hit = np.flatnonzero(rng.random(n, np.float32) < self.taken[s, at])
            at[hit] -= self.steps[s, 2]
            rows.append(hit)
            steps.append(np.full(len(hit), s))
        row, taken = np.concatenate(rows), np.concatenate(steps)
        order = np.lexsort((taken, row))
        row, taken = row[order], taken[order]
        ends = np.searchsorted(row, np.arange(n + 1))
        seen: dict[bytes, list] = {}
        for j in range(n):
            mine = taken[ends[j] : ends[j + 1]]
            if (key := mine.tobytes()) in seen:
                seen[key][2] += 1
            elif len(mine):
                k, copies, _ = self.steps[mine].T
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                chance = math.exp(min(0.0, self.none + self.odds[k].sum() + (self.waste if at[j] else 0.0)))
                seen[key] = [int(at[j]), chance, 1, k[first], np.add.reduceat(copies, first)]
        return sorted(map(tuple, seen.values()), key=lambda c: (c[0], -c[1]))


@dataclass
class Packing:
    """Runs (copies, lengths, times); the program's value and a bound below it; pieces that rounded configurations hold."""

    runs: list[tuple[int, np.ndarray, np.ndarray]]
    value: float
    bound: float
    rounded: int

    @property
    def sequences(self) -> int:
        return sum(copies for copies, *_ in self.runs)


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int, gap: float, rounds: int, start: np.ndarray | None = None) -> tuple[_Pricing, float, float, np.ndarray]:
    """The configuration linear program by multiplicative weights: pricing at its end, value, bound and log weights.

    min sum x_c over configurations c, sum x_c c[l] >= need[l]. A solution is a mean of configurations, as many as
    are needed for the length that they cover least. Each round multiplies a length's weight by a power of what is
    needed of it over what it got, and by a part of its last factor; unfilled tokens are a length of which next to none
    is needed. It ends when the solution is within gap of the area bound, or after so many rounds.
    """
    pricing = _Pricing(lengths, need, capacity)
    area = float(lengths @ need) / capacity
    share = np.minimum(0.999, need / area / pricing.copies)  # of sequences that a single copy should be in
    weights = np.r_[np.log(share / (1 - share)), math.log(WASTE)] if start is None else start
    value, kept, factor = math.inf, weights, 0.0
    for _ in range(rounds):
        pricing.weigh(np.exp(weights[:-1]), math.exp(weights[-1]))
        got, waste = pricing.coverage()
        ratio = need / np.maximum(area * got, 1e-9 * need)
        if area * float(ratio.max()) < value:
            value, kept = area * float(ratio.max()), weights
        if value <= area * (1 + gap):
            break
        factor = RATE * np.log(np.clip(ratio, 0.01, 100)) + MOMENTUM * factor
        step = np.r_[np.clip(factor, -3, 3), np.clip(math.log(SPARE * capacity / max(waste, 1e-9)), -2, 2)]
        weights = np.clip(weights + step, -60, 25)
    return pricing, value, area, kept


def plan(histogram: np.ndarray, capacity: int = CAPACITY, gap: float = 0.005, rounds: int = 400, residue: float = 0.05, draws: int = 4096, work: int = 400_000, seed: int = SEED) -> Packing:
    """Runs that hold histogram[l] pieces of each length l exactly.

    The program is solved to the gap, or for so many rounds and steps of pricing (work; 60 rounds at least), and its solution rounded: configurations drawn from it are
    taken as often as they stand in it and pieces last, and what is left is a smaller program of the same kind, until
    a share of `residue` of all pieces is left. These are filled by a knapsack, longest first. rounds=0 leaves all to that.
    """
    need = histogram.astype(np.int64).copy()
    need[0] = 0
    runs: list[tuple[int, np.ndarray, np.ndarray]] = []
    if full := int(need[capacity]):
        runs.append((full, np.array([capacity]), np.array([1])))
        need[capacity] = 0
    total, value, bound, kept = int(need.sum()), float(full), float(full), None
    rng, spare = np.random.default_rng(seed), None
    while rounds and need.sum() > residue * total:
        lengths = np.flatnonzero(need)[::-1]
        pricing, now, area, weights = solve(lengths, need[lengths], capacity, gap, min(rounds, max(60, work // len(lengths))) if kept is None else 1 + min(rounds, 100) // 8, None if kept is None else np.r_[kept[lengths], kept[0]])
        if kept is None:
            value, bound, kept = value + now, bound + area, np.zeros(capacity + 1)
        kept[lengths], kept[0] = weights[:-1], weights[-1]
        pricing.weigh(np.exp(weights[:-1]), math.exp(weights[-1]))
        n = int(min(draws, max(64, 4 * area)))
        drawn = pricing.draw(n, rng)
        if spare is None:  # unfilled tokens that a solution can't do without
            spare = int(np.quantile(np.repeat([c[0] for c in drawn], [c[2] for c in drawn]), 0.9))
        left, carry = int(need.sum()), 0.5
        for waste, chance, times_drawn, at, times in drawn:
            if waste > spare:
                break
            if (copies := int(area * chance + 1e-9)) < 1:  # those of less than one sequence by their draws
                carry += times_drawn * area / n
                copies = max(1, int(carry))
            copies = min(copies, int((need[lengths[at]] // times).min()))
            if copies > 0:
                carry = max(0.0, carry - copies) if area * chance < 1 else carry
                need[lengths[at]] -= copies * times
                runs.append((copies, lengths[at], times))
        if need.sum() > 0.97 * left:
            break
    rounded = total - int(need.sum())
    while len(open_ := np.flatnonzero(need)):
        longest = int(open_[-1])
        need[longest] -= 1
        fits = open_[(need[open_] > 0) & (open_ <= capacity - longest)][::-1]
        times = _fill(fits, fits * (1 + 1e-6 * fits / capacity), need[fits], capacity - longest)[0] if len(fits) else np.zeros(0, np.int64)
        need[longest] += 1
        got = {int(n): int(t) for n, t in zip(fits, times, strict=True) if t}
        got[longest] = got.get(longest, 0) + 1
        at = np.array(sorted(got, reverse=True))
        times = np.array([got[int(n)] for n in at])
        copies = int(np.min(need[at] // times))
        need[at] -= copies * times
        runs.append((copies, at, times))
    return Packing(runs, value, bound, rounded)


def _lookup(runs: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a sequence, offset), by length and first rank."""
    rows, seen, sequence = [], {}, 0
    for copies, lengths, times in runs:
        offset = 0
        for length, n in zip(lengths.tolist(), times.tolist(), strict=True):
            rows.append((length, seen.get(length, 0), sequence, n, offset))
            seen[length] = seen.get(length, 0) + copies * n
            offset += length * n
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Each piece of `pieces`, with sequence_id and its offset there; sequences are gapless from 0."""
    import pandas as pd

    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, path))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # capacity rows at most
        histogram[length] = n
    look = spark.sparkContext.broadcast(_lookup(plan(histogram, capacity).runs))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = look.value
        starts = rows[:, 0] << 48 | rows[:, 1]
        for f in frames:
            length, rank = f.length.to_numpy(np.int64), f.pop("_rank").to_numpy(np.int64)
            at = rows[np.searchsorted(starts, length << 48 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            yield f.assign(sequence_id=at[:, 2] + nth // at[:, 3], offset=at[:, 4] + nth % at[:, 3] * length)

    spread = cut.withColumn("_hash", F.xxhash64("doc_id", "piece").bitwiseAND(0xFFFFFFFF))
    bounded_batches(spark)
    placed = ranked(spread, ["length"], "_hash", ["doc_id", "piece"], "_rank", int(histogram.sum()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return placed.select(*columns, "_rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, and where a row stands: the file it was read from and its number there; of other tables, its partition's."""
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("file"), F.monotonically_increasing_id().alias("row"))


def small_table(spark: SparkSession, **columns: tuple[list, str]) -> DataFrame:
    """Columns by (values, type), by Arrow: of Python rows Spark makes a table in workers of their own, which stay on the executors."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({name: pa.array(*column) for name, column in columns.items()}))


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """What `pack` gives, with sequences in the order of docs, run by run."""
    import pandas as pd

    spark = docs.sparkSession
    cut = materialize(pieces(in_order(docs), capacity, path, "file string, row long", CACHE_IN_ORDER))
    files = sorted(cut.groupBy("file").agg(F.sum("length")).collect(), key=lambda f: (len(f[0]), f[0]))  # a row a file
    before = np.cumsum([0, *(n for _, n in files)]).tolist()
    tokens = capacity * int(min(MOST_RUN, max(LEAST_RUN, before[-1] / capacity * RUN_SHARE)))
    starts = F.broadcast(small_table(spark, file=([f for f, _ in files], "string"), first_token=(before[:-1], "int64")))
    earlier = Window.partitionBy("file").orderBy("row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("first_token") + F.coalesce(F.sum("length").over(earlier), F.lit(0))
    dealt = cut.join(starts, "file").withColumn("at", at).withColumn("run", F.floor(F.col("at") / tokens)).drop("file", "row", "first_token")

    def place(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at", ignore_index=True)
        length = f.length.to_numpy(np.int64)
        rows = _lookup(plan(np.bincount(length, minlength=capacity + 1), capacity, rounds=10).runs)
        rank = f.groupby("length").cumcount().to_numpy(np.int64)
        row = rows[np.searchsorted(rows[:, 0] << 48 | rows[:, 1], length << 48 | rank, side="right") - 1]
        nth = rank - row[:, 1]
        # Sequences by their first piece in the order of the input.
        sequence, _ = pd.factorize(row[:, 2] + nth // row[:, 3])
        return f.assign(sequence_id=sequence, offset=row[:, 4] + nth % row[:, 3] * length).drop(columns="at")

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    placed = materialize(dealt.groupBy("run").applyInPandas(place, f"{columns}, run long, sequence_id long, offset long"))
    runs = sorted(placed.groupBy("run").agg(F.max("sequence_id") + 1).collect())  # a row a run
    firsts = np.cumsum([0, *(n for _, n in runs)]).tolist()
    bases = F.broadcast(small_table(spark, run=([k for k, _ in runs], "int64"), base=(firsts[:-1], "int64")))
    return placed.join(bases, "run").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("sequence_id")).alias("sequence_id"), "offset")

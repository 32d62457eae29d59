"""Near-duplicate vectors by collision counting over one-dimensional projections.

A pair at the least cosine differs by a known normal law along a random direction, so every bound follows from it. A
vector is sorted in where it stands out: of many projections it takes the few on which it lies farthest out, at either
end. There the windows around it hold few others, and a linked pair shares two such ends with a known probability, so
a vector is sent to each pair of its ends, and nowhere else: a number of copies that grows with the logarithm of all
vectors. At a pair of ends the rows are sorted along one more projection, and the windows of that order are the
candidates. Their collisions are tallied over further projections; only pairs that reach the recall-calibrated count
are verified, by their cosine in double precision.

No pairs leave a group: only how many links each vector gained, and links that connect what all of them connect. A
pair that shares more than two ends is looked at where the first two meet. Large groups are cut into blocks and each
pair of blocks is a group of its own. Vectors that are equal number by number are one, with so many copies.

Vectors that are null, of no length, zero, or hold null or non-finite numbers link with nothing, not even a copy.
Vectors of different lengths don't link. A row whose vec_id is null comes back with a null component and links with
nothing. Rows that repeat a vec_id with another vector are vectors of their own, under one id; rows that repeat both
are one and come back once. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, components, fixed_bytes, in_blocks, join_counted, materialize, roots, whole_groups

#: Groups are cut into blocks of the first size up to SPREAD blocks, then into SPREAD larger ones, up to the second.
BLOCK, SPREAD, LARGEST = 256, 16, 2048
#: Pairs of ends at which a vector may meet others by chance, from which on there are more projections to stand out on.
BY_CHANCE = 250
#: Standard deviations of a linked pair's difference that a window reaches: of the sorted order, and of what is tallied.
SORTED, TALLIED = 3.0, 2.0
SEED = 20_240_917
#: Draws that a share is estimated from.
DRAWS = 3000


@dataclass(frozen=True)
class Plan:
    projections: int  # that a vector may stand out on
    ends: int  # that it takes
    counted: int  # projections whose collisions are counted
    window: float  # how far a query's window reaches there
    reach: float  # and along the sorted projection
    least: int  # collisions that a pair needs


@functools.cache
def sharing(cosine: float, projections: int) -> tuple[float, ...]:
    """The probability that a pair of that cosine shares two of its n outermost ends, for n = 0, 1, ... 32."""
    g = np.random.default_rng([SEED, projections])
    shared = np.zeros((DRAWS, 33), np.int64)
    for lo in range(0, DRAWS, 500):
        x, z = g.standard_normal((2, 500, projections))
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z
        places = [np.argsort(np.argsort(-np.abs(v), axis=1), axis=1) for v in (x, y)]
        later = np.where((x > 0) == (y > 0), np.maximum(*places), 99)  # the n from which on both have the end
        for n in range(33):
            shared[lo : lo + 500, n] = (later < n).sum(axis=1)
    return tuple((shared >= 2).mean(axis=0).tolist())


def calibrate(threshold: float, rows: int, recall: float = 0.97, counted: int = 32) -> Plan:
    """The plan under which a pair just at the threshold is found with probability recall, closer ones likelier."""
    sigma = math.sqrt(2 - 2 * threshold) or 1e-9
    each = 1 - (1 - recall) / 2  # half of what may be missed is left to the ends, half to the count
    projections = 32
    while True:
        projections *= 2
        ends = next(n for n, p in enumerate(sharing(threshold, projections)) if p >= each or n == 32)
        if projections == 1 << 14 or rows * math.comb(ends, 2) ** 2 / (4 * math.comb(projections, 2)) <= BY_CHANCE:
            break
    p = math.erf(TALLIED / math.sqrt(2))
    tail, least = 0.0, counted
    for k in range(counted, -1, -1):
        tail += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        least = k
        if tail >= each:
            break
    return Plan(projections, ends, counted, TALLIED * sigma, SORTED * sigma, least)


def directions(size: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed, size]).standard_normal((size, n))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; by their largest number first, so that no square overflows or vanishes."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def outermost(vectors: np.ndarray, plan: Plan) -> np.ndarray:
    """The ends on which each vector stands out, two a projection, in rising order."""
    out = np.empty((len(vectors), plan.ends), np.uint16)
    towards = directions(vectors.shape[1], plan.projections, 1)
    for lo in range(0, len(vectors), 512):
        at = vectors[lo : lo + 512] @ towards
        far = np.argpartition(-np.abs(at), plan.ends - 1, axis=1)[:, : plan.ends]
        out[lo : lo + 512] = np.sort(2 * far + (np.take_along_axis(at, far, 1) > 0), axis=1)
    return out


def linked(group: np.ndarray, place: np.ndarray, vectors: np.ndarray, ends: np.ndarray, last: np.ndarray, own: np.ndarray, plan: Plan, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows, sorted by group and place along a projection, that are linked and met here first.

    last is the greater of the two ends that a row's group stands for; rows of one block meet in that block's group.
    """
    along = vectors @ directions(vectors.shape[1], plan.counted, 2)
    at, d = np.arange(len(group)), 0
    while len(at):
        d += 1
        at = at[at + d < len(group)]
        at = at[(group[at] == group[at + d]) & (place[at + d] - place[at] <= plan.reach)]
        i = at[own[at] != own[at + d]]
        shared = np.zeros(len(i), np.int64)  # ends up to the last that both have
        for k in range(plan.ends):
            mine = ends[i, k]
            shared += ((ends[i + d] == mine[:, None]).any(axis=1)) & (mine <= last[i])
        i = i[shared == 2]
        i = i[(np.abs(along[i] - along[i + d]) <= plan.window).sum(axis=1) >= plan.least]
        i = i[np.einsum("ij,ij->i", vectors[i], vectors[i + d]) >= threshold]
        if len(i):
            yield i, i + d


def query(rows: DataFrame, threshold: float = 0.9, recall: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector of (vec_id, embedding)."""
    import pyarrow as pa

    spark = rows.sparkSession
    bounded_batches(spark)
    kind = "double" if dict(rows.dtypes)["embedding"] == "array<double>" else "float"
    number = np.dtype(np.float64 if kind == "double" else np.float32)
    one = rows.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("v"))
    bad = F.expr("v is null or size(v) = 0 or exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) or forall(v, x -> x = 0)")
    sound = one.withColumn("v", F.when(bad | F.col("vec_id").isNull(), F.lit(None)).otherwise(F.expr(f"transform(v, x -> x + {kind}(0))")))
    named = materialize(sound.where("vec_id is not null").distinct().unionByName(sound.where("vec_id is null")))
    distinct = materialize(named.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("u", F.monotonically_increasing_id()))
    plan = calibrate(threshold, distinct.count(), recall)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, stops = lists.flatten().to_numpy(), np.asarray(lists.offsets.to_numpy())
            stops = stops - stops[0]
            sizes = np.diff(stops)
            for size in np.unique(sizes):
                pick = np.flatnonzero(sizes == size)
                raw = flat[stops[pick][:, None] + np.arange(size)].astype(number)
                unit = units(raw)
                found, place = outermost(unit, plan), (unit @ directions(size, 1, 3))[:, 0]
                # Vectors of different lengths never share a group.
                first, second = np.triu_indices(plan.ends, 1)
                keys = (int(size) << 32) + (found[:, first].astype(np.int64) << 16) + found[:, second]
                some = pa.array(pick)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(some) for k in range(3)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in found], pa.binary()), pa.array(place), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                    names=["u", "id", "copies", "raw", "ends", "place", "keys"],
                )

    payload = materialize(distinct.select("u", "id", "copies", "v").mapInArrow(post, "u long, id long, copies long, raw binary, ends binary, place double, keys array<long>"))
    group = ["key", "lo", "hi"]
    posts = payload.select("u", F.explode("keys").alias("key"))
    met = in_blocks(posts, ["key"], "u", BLOCK, SPREAD, LARGEST, alone=True).select(*group, "own", "u")
    columns = [*group, "own", "u", "id", "copies", "place", "ends", "raw"]
    dealt = met.join(payload.drop("keys"), "u").select(*columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, 3):
            key, lo, hi, own, u, id_, copies, place = (rows.column(k).to_numpy() for k in range(8))
            size = key >> 32
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
            for n in np.unique(size):
                pick = np.flatnonzero(size == n)
                part = rows.take(pa.array(pick))
                unit = units(np.ascontiguousarray(fixed_bytes(part.column(9))).view(number))
                ends = np.ascontiguousarray(fixed_bytes(part.column(8))).view(np.uint16)
                # In a group of one block all rows meet, in one of two only those of different blocks.
                block = np.where(lo[pick] == hi[pick], np.arange(len(pick)), own[pick])
                pairs = list(linked(of[pick], place[pick], unit, ends, (key[pick] & 0xFFFF).astype(np.uint16), block, plan, threshold))
                if not pairs:
                    continue
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                gained = np.bincount(i, copies[pick[j]], len(pick)) + np.bincount(j, copies[pick[i]], len(pick))
                root = roots(len(pick), i, j)
                some, tied = np.flatnonzero(gained), np.flatnonzero(root != np.arange(len(pick)))
                none = np.zeros(len(some), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[none, id_[pick[tied]]]), pa.array(np.r_[none, id_[pick[root[tied]]]]), pa.array(np.r_[u[pick[some]], np.full(len(tied), -1)]), pa.array(np.r_[gained[some].astype(np.int64), np.zeros(len(tied), np.int64)])],
                    names=["a", "b", "u", "n"],
                )

    found = dealt.repartition(*group).sortWithinPartitions(*group, "place").mapInArrow(search, "a long, b long, u long, n long")
    hits = materialize(found.groupBy("a", "b", "u").agg(F.sum("n").alias("n")))
    gained = hits.where("u >= 0").select("u", F.col("n").alias("gained"))
    members = components(hits.where("u < 0").select("a", "b")).select(F.col("node").alias("id"), "component")
    links = (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).cast("long")
    by_vector = materialize(distinct.join(gained, "u", "left").join(members, "id", "left").select("v", "copies", links.alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    alone = named.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_counted(named.where("v is not null"), by_vector, "v", "copies").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""What several operators share: tables, checkpoints, ranks under skew and components."""

from __future__ import annotations

import functools
import math
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; in Java and DuckDB regular expressions.
SPACE = r"\x20\x09-\x0D"
#: Bytes of an Arrow batch, so that a batch of long texts fits beside a worker's models; the same for every operator.
BATCH_BYTES = 8 << 20
#: A key of more rows than this is joined by a broadcast of such keys: at most a share of 1 / HOT_ROWS of all rows.
HOT_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session names no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; a temporary one only in local mode, where none is set."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rasterloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row even where use names it in a lambda."""
    return F.transform(F.array(value), use)[0]


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df has not, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The fold that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ranked(df: DataFrame, keys: list[str], hashed: str, ties: list[str], rank: str, rows: int, per_bucket: int = 1024) -> DataFrame:
    """Adds rank, 0-based by (hashed, ties) among the rows of each key, without bringing a key together.

    hashed is a column of evenly spread 32-bit numbers. Its high bits cut a key into buckets of about per_bucket
    rows; ranks count within the bucket, after the sizes of the key's buckets before it.
    """
    bits = max(0, min(31, math.ceil(math.log2(max(1, rows / per_bucket)))))
    bucket, size, start, inside = (fresh(n, df) for n in ("rank_bucket", "rank_size", "rank_start", "rank_inside"))
    cut = df.withColumn(bucket, F.shiftright(F.col(hashed), 32 - bits) if bits else F.lit(0).cast("long"))
    sizes = cut.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, bucket, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    own = Window.partitionBy(*keys, bucket).orderBy(hashed, *ties)
    return (
        cut.withColumn(inside, F.row_number().over(own) - 1)
        .join(starts, [*keys, bucket])
        .withColumn(rank, F.col(start) + F.col(inside))
        .drop(bucket, start, inside)
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    Alternates large-star and small-star steps: each step hangs the neighbours of a node under the smallest of
    them, by a group-by with partial results and an equi-join with what it gave. Both sides of a join are shuffled as
    they are, so that Spark can split hot nodes. Lineage is cut by reliable checkpoints; a round that changes nothing
    ends it.
    """
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def stamp(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = stamp(now)
    if was[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(low.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        if (after := stamp(now)) == was:
            break
        was = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


@functools.cache
def tokenizer(path: str):
    """One tokenizer a worker, in the worker's own thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def join_counted(rows: DataFrame, named: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with named, one row a key, whose column count has the key's rows there; hot keys stay where they lie."""
    hot = F.broadcast(named.where(F.col(count) > HOT_ROWS).drop(count))
    rest = named.where(F.col(count) <= HOT_ROWS).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def in_blocks(posts: DataFrame, keys: list[str], member: str, block: int, spread: int, largest: int, weight: str | None = None, heaviest: int = 1 << 20, alone: bool = False, once: bool = False) -> DataFrame:
    """posts of keys that have more than one, with (lo, hi): the group in which a row meets others of its key.

    A key of at most `block` rows is one group. Of a larger one, rows are cut by the hash of member into blocks, of the
    first size up to `spread` blocks, then into `spread` larger ones, up to `largest`; with weight, also so that a
    block's weights sum to about `heaviest`. Each pair of blocks is a group, so that all pairs of rows meet; with alone,
    so is each block, and own tells which block a row is of. With once, rows are counted where a key's rows meet, after one
    shuffle of posts: where most keys have one row, counts that go apart are as many as the rows themselves.
    """
    sums = [F.count(F.lit(1)).alias("n"), *([F.sum(weight).alias("mass")] if weight else [])]
    parts = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(spread)), F.ceil(F.col("n") / largest), *([F.ceil(F.col("mass") / heaviest)] if weight else []))
    others = F.expr("sequence(0, parts - 1)" if alone else "case when parts = 1 then array(0) else filter(sequence(0, parts - 1), x -> x != own) end")
    if once:
        over = Window.partitionBy(*keys)
        sums = [F.count(F.lit(1)).over(over).alias("n"), *([F.sum(weight).over(over).alias("mass")] if weight else [])]
        cut = posts.select("*", *sums).where("n > 1").withColumn("parts", F.least("n", parts).cast("int")).select(*posts.columns, "parts")
    else:
        sizes = posts.groupBy(*keys).agg(*sums).where("n > 1")
        cut = posts.join(sizes.withColumn("parts", F.least("n", parts).cast("int")).select(*keys, "parts"), keys)
    met = cut.withColumn("own", F.pmod(F.xxhash64(member), F.col("parts")).cast("int")).withColumn("other", F.explode(others))
    return met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("parts", "other")


def whole_groups(batches, keys: int):
    """(rows, starts): tables of whole groups and where each group starts, of batches sorted by their first `keys` whole-number columns."""
    import numpy as np
    import pyarrow as pa

    def cuts(cols: np.ndarray) -> np.ndarray:
        return np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1

    def named(rows) -> np.ndarray:
        return np.stack([rows.column(i).to_numpy().astype(np.int64) for i in range(keys)])

    def out(parts: list):
        rows = pa.Table.from_batches(parts).combine_chunks()
        return rows, np.r_[0, cuts(named(rows))]

    held: list = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = named(batch)
        inner = cuts(cols)
        if held and not len(inner) and (cols[:, 0] == name).all():
            held.append(batch)
            continue
        last = int(inner[-1]) if len(inner) else 0
        if held or last:
            yield out([*held, *([batch.slice(0, last)] if last else [])])
        held, name = [batch.slice(last)], cols[:, -1]
    if held:
        yield out(held)


def fixed_bytes(column):
    """The rows of a column of equally long byte strings, as an array of bytes."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, -1)


def roots(n: int, i, j):
    """For each of n rows the first that links (i, j) reach."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_links(starts, n: int, near):
    """(i, j) arrays that connect what the near pairs of each group connect; near takes two arrays of row numbers.

    Small groups compare all pairs at once, and link each row to the first that it reaches; of larger ones each row meets
    those that no link has yet reached. Links are one fewer than the rows they connect.
    """
    import numpy as np

    ends = np.r_[starts[1:], n]
    wide = ends - starts
    of = np.repeat(np.arange(len(starts)), wide)
    small = wide[of] <= 16
    pairs = []
    for d in range(1, int(min(wide.max(initial=0), 16))):
        i = np.flatnonzero((of[d:] == of[:-d]) & small[d:])
        i = i[near(i, i + d)]
        pairs.append((i, i + d))
    if pairs:
        first = roots(n, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
        tied = np.flatnonzero(first != np.arange(n))
        yield first[tied], tied
    for a, b in zip(starts[wide > 16].tolist(), ends[wide > 16].tolist(), strict=True):
        left = np.arange(a, b)
        while len(left) > 1:
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                i = todo.pop()
                hit = near(np.full(len(left), i), left)
                if hit.any():
                    found, left = left[hit], left[~hit]
                    yield np.full(len(found), i), found
                    todo.extend(found.tolist())

"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of their digests, form blocks. A source of weight w (its share of all weights)
owes a block per 1/w slots: its i-th block, from 0, is released at slot floor(i / w) and due by slot ceil((i + 1) / w).
Each slot goes to the released block of the earliest deadline. As the weights sum to one, every block meets its window,
so that after any number of slots each source is less than one block from its share.

Weights are whole numbers, so the schedule repeats after as many slots as they sum to, which grows with the number of
sources; one period is worked out by an aggregate expression over its slots (of many sources by a heap) and a document's slot follows from its block number by a join with that small
table. Ranks within a source come from bucket sizes, never from one task a source. No document is left out: when a
source runs out its slots stay empty, and the others go on in their proportions.

A null source is a source of its own, named ''. Documents of equal digest (repeated rows, null ids) are ranked by
source, text and then by chance: their slots are defined as a set. An empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh, materialize, ranked

BLOCK_DOCS = 16
#: What quantised weights sum to, about: the length of a period of the schedule; and how many of it there are a source at least.
PERIOD, PER_SOURCE = 1000, 16
#: Sources up to which a schedule is worked out by an expression, in time their number times the period's length; more by a heap.
MOST_SOURCES = 256
#: Slots of a period up to which sources are joined with them by a broadcast, some 40 bytes each.
BROADCAST_SLOTS = 200_000


def targets(counts: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, weight): the square roots of the sources' document counts, in whole numbers that sum to about a period."""
    roots = counts.select("source", F.sqrt(F.col("docs").cast("double")).alias("root"))
    total = roots.agg(F.round(F.sum("root"), 6).alias("all_roots"))
    length = roots.agg(F.greatest(F.lit(period), PER_SOURCE * F.count(F.lit(1))).alias("length"))
    share = F.col("root") / F.col("all_roots")
    return roots.withColumn("all_roots", total.scalar()).withColumn("length", length.scalar()).select("source", F.greatest(F.lit(1), F.floor(F.col("length") * share)).cast("long").alias("weight"))


def pattern_by_heap(weights: DataFrame) -> DataFrame:
    """What `pattern` gives, of any number of sources: the driver holds a row a source and a row a slot of one period."""
    sources = [(s, w) for s, w in weights.orderBy("source").collect() if w > 0]
    d = sum(w for _, w in sources)
    waiting, ready, rows = [(0, i, 0) for i in range(len(sources))], [], []
    for t in range(d):
        while waiting and waiting[0][0] <= t:
            _, i, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(n + 1) * d // sources[i][1]), i, n))
        due, i, n = heapq.heappop(ready)
        source, w = sources[i]
        rows.append((source, n, t, d, w, n * d // w, due))
        if n + 1 < w:
            heapq.heappush(waiting, (-(-(n + 1) * d // w), i, n + 1))
    return weights.sparkSession.createDataFrame(rows, "source string, nth long, slot long, period long, weight long, release long, deadline long")


def pattern(weights: DataFrame) -> DataFrame:
    """(source, nth, release, deadline, slot, period): which slot of a period the nth block of each source takes."""
    ordered = weights.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("s"))
    sums = ordered.withColumn("d", F.aggregate("s.weight", F.lit(0).cast("long"), lambda a, w: a + w)).where("d > 0")

    def choose(state: Column, t: Column) -> Column:
        done = state["done"]
        ready = F.transform(
            F.col("s"),
            lambda x, i: F.when((F.get(done, i) * F.col("d") <= t * x["weight"]) & (F.get(done, i) < x["weight"]), F.struct(F.ceil((F.get(done, i) + 1) * F.col("d") / x["weight"]).cast("long").alias("due"), i.alias("i"))),
        )
        pick = F.array_min(F.filter(ready, lambda x: x.isNotNull()))["i"]
        return F.struct(F.transform(done, lambda n, i: F.when(i == pick, n + 1).otherwise(n)).alias("done"), F.concat(state["order"], F.array(pick)).alias("order"))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order"))
    played = sums.select("s", "d", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("d") - 1), start, choose, lambda a: a["order"]).alias("order"))
    slots = played.select("s", "d", F.posexplode("order").alias("slot", "i")).select(F.get(F.col("s"), F.col("i")).alias("x"), "d", "slot")
    nth = F.row_number().over(Window.partitionBy("x.source").orderBy("slot")) - 1
    w = F.col("weight")
    return slots.select("x.source", "x.weight", "d", F.col("slot").cast("long").alias("slot"), nth.cast("long").alias("nth")).select(
        "source", "nth", "slot", F.col("d").alias("period"), "weight", F.floor(F.col("nth") * F.col("d") / w).alias("release"), F.ceil((F.col("nth") + 1) * F.col("d") / w).alias("deadline")
    )


def scheduled(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, str]:
    """docs with one more column, a struct (block, release, deadline, slot, place), and that column's name.

    weights has (source, weight), whole numbers above 0, for every source; one that it lacks is an error.
    """
    name, source, digest, rank = (fresh(n, docs) for n in ("mix", "mix_source", "mix_digest", "mix_rank"))
    named = docs.withColumn(source, F.coalesce("source", F.lit(""))).withColumn(digest, F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"))
    counts = materialize(named.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("docs")))
    rows = counts.agg(F.sum("docs")).first()[0] or 0
    if weights is not None and (lost := counts.join(weights, "source", "left_anti").first()):
        raise ValueError(f"no weight for the source {lost['source']!r}")
    wanted = weights if weights is not None else targets(counts)
    plan = materialize((pattern if wanted.count() <= MOST_SOURCES else pattern_by_heap)(wanted))  # a period's slots, whatever the corpus
    order = ranked(named, [source], digest, ["doc_id", *(["text"] if "text" in docs.columns else [])], rank, rows)
    block = F.floor(F.col(rank) / block_docs)
    cut = order.withColumn(rank, F.struct(block.alias("block"), (F.col(rank) % block_docs).alias("place")))
    look = plan.groupBy("source").agg(F.first("weight").alias("weight"), F.first("period").alias("period"), F.array_sort(F.collect_list(F.struct("nth", "slot", "release", "deadline"))).alias("slots"))
    look = look.select(F.col("source").alias(source), F.struct("weight", "period", "slots").alias(digest))
    joined = cut.drop(digest).join(F.broadcast(look) if plan.count() <= BROADCAST_SLOTS else look, source)
    at = F.get(F.col(digest)["slots"], (F.col(rank)["block"] % F.col(digest)["weight"]).cast("int"))
    turn = F.floor(F.col(rank)["block"] / F.col(digest)["weight"]) * F.col(digest)["period"]
    made = F.struct(F.col(rank)["block"].alias("block"), *((turn + at[c]).alias(c) for c in ("release", "deadline", "slot")), F.col(rank)["place"].alias("place"))
    return joined.withColumn(name, made).select(*docs.columns, name), name


def query(docs: DataFrame) -> DataFrame:
    found, name = scheduled(docs.select("doc_id", "source"))
    return found.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), *(F.col(name)[c].alias(c) for c in ("block", "release", "deadline", "slot", "place")))


def mixed(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs in the order of their slots, range by range: files read in order are the mixture."""
    found, name = scheduled(docs)
    keys = [F.col(name)["slot"], F.col(name)["place"]]
    n = partitions or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE named AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS digest FROM documents
), counts AS (SELECT source, sqrt(CAST(count(*) AS DOUBLE)) AS root FROM named GROUP BY source),
weights AS (SELECT source, greatest(1, CAST(floor((SELECT greatest({PERIOD}, {PER_SOURCE} * count(*)) FROM counts) * (root / (SELECT round(sum(root), 6) FROM counts))) AS BIGINT)) AS weight FROM counts),
s AS (SELECT list(source ORDER BY source) AS names, list(weight ORDER BY source) AS w, CAST(sum(weight) AS BIGINT) AS d FROM weights),
play(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN w], CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT t + 1, [CASE WHEN i = best THEN done[i] + 1 ELSE done[i] END FOR i IN range(1, len(done) + 1)], best
  FROM (
    SELECT t, done, list_min([{{'due': CAST(ceil((done[i] + 1) * d / w[i]) AS BIGINT), 'i': i}} FOR i IN range(1, len(w) + 1) IF done[i] * d <= (t + 1) * w[i] AND done[i] < w[i]])['i'] AS best
    FROM play, s WHERE t + 1 < d
  )
), slots AS (
  SELECT names[pick] AS source, w[pick] AS weight, d, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM play, s WHERE t >= 0
), ranks AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id) - 1 AS r FROM named
), blocks AS (SELECT doc_id, source, r // {BLOCK_DOCS} AS block, r % {BLOCK_DOCS} AS place FROM ranks)
SELECT b.doc_id, b.source, b.block, b.block // weight * d + CAST(floor(nth * d / weight) AS BIGINT) AS release,
  b.block // weight * d + CAST(ceil((nth + 1) * d / weight) AS BIGINT) AS deadline, b.block // weight * d + slot AS slot, b.place
FROM blocks b JOIN slots ON b.source = slots.source AND b.block % weight = nth
"""

"""Quality rules: repetition counts, and a hashed n-gram log-likelihood ratio of trusted to raw text.

Words and word pairs are hashed into two halves of a fixed number of buckets. One pass over all documents counts the
buckets, for the whole corpus and for a bounded sample of trusted documents; each bucket's weight is the logarithm of
its share among trusted n-grams over its share in the corpus. A document's verdict is the sum of its n-grams' weights
by its number of words, against a fixed threshold. Everything runs as built-in expressions; the weights reach the
executors as a scalar subquery of as many numbers as there are buckets.

Texts are read whole, however long. A null text has no words. A document that fails the base rules is not kept, whatever its ratio. Without trusted
documents every weight is 0 and the base rules decide alone. Repeated rows count and come back as often as they came;
a null doc_id is kept and never trusted; an empty table gives no rows; extra columns stay or don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh, let

BUCKETS = 1 << 16
HALF = BUCKETS // 2
#: Occurrences that both counts of a bucket get, so that what is rare says little.
SMOOTHING = 20.0
#: Documents whose weights sum to less a word are not like the trusted ones.
THRESHOLD = -0.18
#: Trusted documents that the target's counts are taken from.
MOST_TRUSTED = 20_000
BLANKS = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def words(text: Column) -> Column:
    """Runs of anything but space and \\x09-\\x0D, in order."""
    bare = F.expr(BLANKS)
    return let(
        F.btrim(F.coalesce(text, F.lit("")), bare),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")),
    )


def hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _upto(n: Column, last: int) -> Column:
    """0 to n - last, or nothing."""
    return F.when(n >= last, F.sequence(F.lit(0), n - last)).otherwise(F.array().cast("array<int>"))


def buckets(h: Column) -> Column:
    """The buckets of a text's words and word pairs, by the words' hashes."""
    single = F.transform(h, lambda x: F.pmod(x, F.lit(HALF)).cast("int"))
    pair = F.transform(_upto(F.size(h), 2), lambda i: (F.pmod(F.xxhash64(h[i], h[i + 1]), F.lit(HALF)) + HALF).cast("int"))
    return F.concat(single, pair)


def repeated(h: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that a text holds twice or more; first ones count."""

    def covered(found: Column) -> Column:
        n = F.size(found)
        twin = F.filter(found, lambda x, i: ((i > 0) & (F.get(found, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(found, i + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(twin, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("total"), F.lit(-width).alias("last"))
        return F.aggregate(starts, zero, lambda a, s: F.struct((a["total"] + F.least(F.lit(width), s - a["last"])).alias("total"), s.alias("last")), lambda a: a["total"])

    def count(grams: Column) -> Column:
        sorted_ = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(sorted_, covered))

    grams = F.transform(_upto(F.size(h), width), lambda i: F.xxhash64(*(h[i + k] for k in range(width))))
    return let(grams, count)


def weights(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING, most_trusted: int = MOST_TRUSTED) -> DataFrame:
    """One row `w`: each bucket's log-likelihood ratio; trusted has the doc_ids of the target.

    The target is a sample of at most most_trusted ids, by the smallest hashes; the corpus is every document.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_trusted).withColumn("_t", F.lit(1))
    grams = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id", "left")  # most_trusted rows at most
        .select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode(let(hashes(words(F.col("text"))), buckets)).alias("b"))
    )
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    rows = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("rows"))
    total = rows.select("rows", F.aggregate("rows.raw", F.lit(0).cast("long"), lambda a, n: a + n).alias("raw"), F.aggregate("rows.target", F.lit(0).cast("long"), lambda a, n: a + n).alias("target"))
    expected = lambda r: r["raw"] * F.col("target") / F.col("raw")  # noqa: E731  of the target, were it like the corpus
    ratio = lambda r: F.log((r["target"] + smoothing) / (expected(r) + smoothing))
    return total.select(F.when(F.col("target") == 0, F.transform("rows", lambda r: F.lit(0.0))).otherwise(F.transform("rows", ratio)).alias("w"))


def measures(text: Column, weight: Column) -> Column:
    """A struct of a text's counts, its ratio and the verdicts."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", ""))

    def of_words(w: Column) -> Column:
        return let(hashes(w), lambda h: of_hashes(w, h))

    def of_hashes(w: Column, h: Column) -> Column:
        total = F.aggregate(buckets(h), F.lit(0.0), lambda a, b: a + F.get(weight, b))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated(h).cast("long").alias("n_repeat_words"),
            (total / F.greatest(F.size(w), F.lit(1))).alias("ratio"),
        )

    return let(words(text), of_words)


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of the measures and verdicts, and that column's name."""
    name, weight = fresh("quality", docs), fresh("weights", docs)
    with_weights = docs.withColumn(weight, weights(docs, trusted).scalar())
    # Through a generator, so that filters and fields of the struct don't each work it out again.
    measured = with_weights.select(*docs.columns, F.explode_outer(F.array(measures(F.col("text"), F.col(weight)))).alias(name))
    m = F.col(name)
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return measured.withColumn(name, m.withField("base_failed", failed).withField("kept", ~failed & (m["ratio"] >= threshold))), name


def query(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    found, name = judged(docs.select("doc_id", "text"), trusted)
    return found.select("doc_id", *(F.col(name)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")))


def kept(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    found, name = judged(docs, trusted)
    return found.where(F.col(name)["kept"]).select(*docs.columns)

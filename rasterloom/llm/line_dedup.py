"""Boilerplate lines by how often they stand on a site's pages.

A line is what stands between line feeds, without the blanks around it; blank lines are never boilerplate. For each
host, the pages that hold a line (once or more) are divided by all pages of the host. Lines above the ratio go, on
every page of that host; a line that only one page holds is no one's boilerplate, however few the pages (`min_pages`).
With `spare`, a page of which nothing but blanks would be left stays whole, for a near-duplicate operator to judge; by
default the ratio alone decides.

Hashes of distinct lines are counted, with partial sums before the shuffle, so a hot host or line costs no task more
than a row per line. What comes back to the pages is each host's list of boilerplate, no longer than the mean number
of lines of a page over the ratio. It is broadcast if the lists of all hosts are counted and few, and joined by a
shuffle, whose hot hosts Spark splits, if they are not.

A null host is no site: its pages stay as they are. A null text stays null and counts as a page without lines.
Repeated rows are pages of their own. An empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh, let, materialize
from rasterloom.llm.quality import BLANKS

MAX_RATIO = 0.02
MIN_PAGES = 2
#: Boilerplate lines of all hosts together, up to which their lists are broadcast: 8 bytes each.
BROADCAST_LINES = 100_000


def line_key(line: Column) -> Column:
    """A line's hash, 0 where it is blank."""
    return let(F.btrim(line, F.expr(BLANKS)), lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))


def host_of_url(url: Column) -> Column:
    """The host of a URL in lower case, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, ratio) of every line above the ratio."""
    site = pages.select(host.alias("host"), text.alias("text")).where("host is not null")
    totals = site.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_remove(F.array_distinct(F.transform(F.split("text", "\n"), line_key)), F.lit(0).cast("long"))
    holding = site.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= min_pages)
    return holding.join(totals, "host").select("host", "key", (F.col("holding") / F.col("pages")).alias("ratio")).where(F.col("ratio") > max_ratio)


def marked(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, spare: bool = False) -> tuple[DataFrame, str]:
    """pages with one more column, a struct (text, n_lines, n_dropped), and that column's name."""
    lines = boilerplate(pages, host, text, max_ratio, min_pages)
    name, key, bad = (fresh(n, pages) for n in ("deduplicated", "site_key", "site_lines"))
    lists = materialize(lines.groupBy("host").agg(F.collect_list("key").alias(bad)).withColumnRenamed("host", key))
    few = (lists.agg(F.sum(F.size(bad))).first()[0] or 0) <= BROADCAST_LINES
    joined = pages.withColumn(key, host).join(F.broadcast(lists) if few else lists, key, "left")

    def split(parts: Column) -> Column:
        kept = F.filter(parts, lambda x: ~F.array_contains(F.col(bad), line_key(x)))
        return let(kept, lambda rest: outcome(parts, rest))

    def outcome(parts: Column, rest: Column) -> Column:
        stays = F.size(rest) == F.size(parts)
        if spare:
            stays |= F.btrim(F.array_join(rest, ""), F.expr(BLANKS)) == ""
        return F.struct(F.when(stays, text).otherwise(F.array_join(rest, "\n")).alias("text"), F.size(parts).alias("n_lines"), F.when(stays, F.lit(0)).otherwise(F.size(parts) - F.size(rest)).alias("n_dropped"))

    untouched = F.struct(text.alias("text"), F.size(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n_lines"), F.lit(0).alias("n_dropped"))
    found = F.when(F.col(bad).isNull() | text.isNull(), untouched).otherwise(let(F.split(text, "\n"), split))
    return joined.withColumn(name, found).select(*pages.columns, name), name


def _lines(pages: DataFrame, key: str, host: Column, text: Column) -> DataFrame:
    found, name = marked(pages, host, text)
    x = F.col(name)
    return found.select(key, x["n_lines"].cast("long").alias("n_lines"), x["n_dropped"].cast("long").alias("n_dropped"), F.length(x["text"]).cast("long").alias("n_chars"), F.md5(x["text"]).alias("text_md5"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest and length of what is left; a document's site is its source."""
    return _lines(docs.select("doc_id", "source", "text"), "doc_id", F.col("source"), F.col("text"))


def pages_query(pages: DataFrame) -> DataFrame:
    """The same of web pages (page_id, url, html), by the hosts of their URLs."""
    return _lines(pages.select("page_id", "url", "html"), "page_id", host_of_url(F.col("url")), F.col("html"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with what is left of their texts, and n_chars of that if they have it; those of which nothing would be left stay."""
    found, name = marked(docs, F.col("source"), F.col("text"), spare=True)
    left = F.col(name)["text"]
    columns = {"text": left, "n_chars": F.length(left).cast("long")}
    return found.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))


_ORACLE = f"""
WITH given AS ({{given}}), lines AS (
  SELECT id, host, i, l, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT id, host, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM given)
), totals AS (SELECT host, count(*) AS pages FROM given GROUP BY host),
bad AS (
  SELECT l.host, l.k FROM lines l JOIN totals t ON l.host = t.host WHERE l.k <> ''
  GROUP BY l.host, l.k, t.pages HAVING count(DISTINCT id) >= {MIN_PAGES} AND count(DISTINCT id) / t.pages > {MAX_RATIO}
), made AS (
  SELECT id, count(*) AS n_lines, count(*) FILTER (b.k IS NOT NULL) AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (b.k IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.k = b.k GROUP BY id
)
SELECT id AS {{key}}, n_lines, n_dropped, length(text) AS n_chars, md5(text) AS text_md5 FROM made
"""
ORACLE = _ORACLE.format(given="SELECT doc_id AS id, source AS host, text FROM documents", key="doc_id")
PAGES_ORACLE = _ORACLE.format(given="SELECT page_id AS id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host, html AS text FROM pages", key="page_id")

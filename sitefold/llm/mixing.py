"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies: its source's rate (target words by words there are), moved
by length. Documents of at least their source's mean length are rather taken than shorter ones: their odds
go up, and those of shorter ones down, by as much as leaves the expected words at the target and every
inclusion probability between 0 and 1. The whole part of the rate is taken for certain; for the rest p,
documents are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the lowest
ranks are taken until the source's remaining words are reached (a document is in if its middle lies before
that point). u comes from a hash of doc_id, so reruns agree; p counts in whole millionths and words are summed
as whole numbers, so that sums don't depend on their order.

No source is sorted: ranks fall into RANGES ranges whose words are summed per source; one range per source
holds the point where its sample ends, and only the documents of that range are ordered. All others are
decided where they lie, from their source's row alone, so that repeat_documents() moves no other text.

Cases: a null text has size 0; a null source is a source, the last one; documents of equal rank (repeated
rows, null doc_ids) are ordered by size, and equal ones are interchangeable. Sources of size 0 have target 0,
and documents of size 0 are never taken. Very long texts are counted whole. Extra columns are ignored or passed
on; an empty table gives no rows. The table of sources (a row each) is ordered in one task; everything else is
distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, few, read, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
RANGES = 4096
SEED = "mix"
#: Inclusion probabilities count in these.
UNIT = 1_000_000


def _size(text):
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _uniform(doc_id):
    """Between 0 and 1, from 48 bits of the md5 of the id."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every row."""
    return docs.select("doc_id", "source", _size(F.col("text")).alias("size"))


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """per_source(source, source_size) -> with target: words by weight, none above most * source_size.

    Sources reach their cap in the order of cap / weight. Where the words left, shared over the weights left,
    no longer exceed that ratio, the level of words per weight is found.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # the weights left, by subtraction: a frame that ends with the last row costs the square of the rows
    after = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("level", (share * F.sum("source_size").over(everything).cast("double") - before) / after)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.row_number().over(order).alias("i"), F.col("level").alias("level")))
    s = s.withColumn("chosen", F.min(fits).over(everything))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("chosen.level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def inclusion(sized: DataFrame) -> DataFrame:
    """sized(source, size) -> source (as s), source_size, target, n (documents with words), whole, p_long, p_short.

    p in UNITs of documents of at least their source's mean length, and of shorter ones. With f the fraction of
    the rate, d = min(f, 1 - f), and shares of words L and S, these are f + d * S and f - d * L.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    goal = cut(targets(per.select("source", "source_size")).join(per.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s"))
    long = F.col("size") * F.col("n") >= F.col("source_size")
    words = sized.join(few(goal), sized.source.eqNullSafe(goal.s)).where(long).groupBy(F.col("s").alias("l")).agg(F.sum("size").alias("long_words"))
    g = goal.join(words, goal.s.eqNullSafe(words.l), "left").drop("l")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    g = g.withColumn("whole", F.floor(rate).cast("long")).withColumn("f", rate - F.floor(rate))
    d = F.least(F.col("f"), 1 - F.col("f"))
    share = F.coalesce(F.try_divide(F.coalesce("long_words", F.lit(0)), F.col("source_size")), F.lit(0.0))
    up, down = F.col("f") + d * (1 - share), F.col("f") - d * share
    return g.select("s", "source_size", "target", "n", "whole", *[F.round(p * UNIT).cast("long").alias(name) for p, name in ((up, "p_long"), (down, "p_short"))])


def ranked(expected: DataFrame) -> DataFrame:
    """expected(doc_id, source, size, p in UNITs) -> with rank and range; null ones where nothing is left to chance."""
    u, p = _uniform(F.col("doc_id")), F.col("p") / UNIT
    odds = F.when(F.col("p") >= UNIT, F.lit(0.0)).otherwise(F.try_divide(u / (1 - u), F.try_divide(p, 1 - p)))  # p = 1 comes first
    e = expected.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
    return e.withColumn("range", F.floor(F.col("rank") / (1 + F.col("rank")) * RANGES).cast("int"))


def _by_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    return docs.join(few(sources), docs["source"].eqNullSafe(sources["s"])).drop("s")


def _with_odds(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs(doc_id, source, size) -> with the columns of its source, p, rank and range."""
    e = _by_source(docs, sources)
    return ranked(e.withColumn("p", F.when(F.col("size") * F.col("n") >= F.col("source_size"), F.col("p_long")).otherwise(F.col("p_short"))))


def _exact(x):
    return F.sum(x.cast("decimal(38,0)"))


def ends(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with end_range, before and wanted: the range that holds a sample's end, the words before it, and all its words in UNITs."""
    sums = ranked.where("rank IS NOT NULL").groupBy("source", "range").agg(F.sum("size").alias("words"), _exact(F.col("p").cast("decimal(19,0)") * F.col("size")).alias("units"))
    w = Window.partitionBy("source")
    sums = sums.withColumn("wanted", F.sum("units").over(w)).withColumn("before", F.sum("words").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    # of each source the last range that starts before the sample's end; ranges before it are in
    last = sums.where(F.col("before").cast("decimal(38,0)") * UNIT < F.col("wanted")).groupBy(F.col("source").alias("e")).agg(F.max(F.struct(F.col("range").alias("end_range"), "before", "wanted")).alias("end"))
    return sources.join(last, sources["s"].eqNullSafe(last["e"]), "left").select(*sources.columns, "end.*")


def decide(e: DataFrame) -> DataFrame:
    """e(ranked, with whole, end_range, before and wanted of its source) -> with copies. Only documents of a range that holds an end are moved."""
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = e.where("range = end_range")
    twice = 2 * (F.sum("size").over(inside) + F.col("before")) - F.col("size")  # where a document's middle lies, doubled
    edge = edge.withColumn("more", (twice.cast("decimal(38,0)") * UNIT <= 2 * F.col("wanted")).cast("long"))
    rest = e.where("range IS NULL OR end_range IS NULL OR range != end_range").withColumn("more", F.coalesce(F.col("range") < F.col("end_range"), F.lit(False)).cast("long"))
    return edge.unionByName(rest).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0))


def pareto_sample(expected: DataFrame) -> DataFrame:
    """expected(doc_id, source, size, copies >= 0 that are expected) -> doc_id, source, size, taken: words taken, repeats counted."""
    whole = F.floor("copies").cast("long")
    e = ranked(expected.select("doc_id", "source", "size", whole.alias("whole"), F.round((F.col("copies") - whole) * UNIT).cast("long").alias("p")))
    sources = cut(ends(e, expected.select(F.col("source").alias("s")).distinct()))
    return decide(_by_source(e, sources)).select("doc_id", "source", "size", (F.col("size") * F.col("copies")).alias("taken"))


def plan(sized: DataFrame) -> DataFrame:
    """A row per source: all that decides on its documents."""
    sources = cut(inclusion(sized))
    return cut(ends(_with_odds(sized, sources), sources))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    sized = cut(sizes(docs))
    return decide(_with_odds(sized, plan(sized))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """Every row of docs as often as the mix takes it."""
    sources = plan(cut(sizes(docs)))
    row = unused("row", docs.columns)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)).withColumns({"doc_id": F.col(row)["doc_id"], "source": F.col(row)["source"]})
    whole = whole.withColumn("size", F.explode(F.array(_size(F.col(row)["text"]))))  # counted once, however often it is named
    out = decide(_with_odds(whole, sources)).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(f"`{row}`.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), l AS (
  SELECT *, row_number() OVER o AS i, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, i) FROM l WHERE level <= cap / weight), 'inf'::DOUBLE) * weight) AS target FROM l
), n AS (
  SELECT source, count(*) FILTER (size > 0) AS n FROM d GROUP BY source
), e AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target, d.size * n.n >= t.source_size AS long, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN n ON d.source IS NOT DISTINCT FROM n.source
), f AS (
  SELECT *, rate - floor(rate) AS f, CASE WHEN source_size = 0 THEN 0 ELSE (sum(CASE WHEN long THEN size ELSE 0 END) OVER (PARTITION BY source))::DOUBLE / source_size END AS share FROM e
), g AS (
  SELECT *, round((CASE WHEN long THEN f + least(f, 1 - f) * (1 - share) ELSE f - least(f, 1 - f) * share END) * 1000000)::BIGINT AS p FROM f
), r AS (
  SELECT *, CASE WHEN size = 0 OR p <= 0 THEN NULL WHEN p >= 1000000 THEN 0::DOUBLE ELSE (u / (1 - u)) / ((p / 1000000.0::DOUBLE) / (1 - p / 1000000.0::DOUBLE)) END AS rank FROM g
), c AS (
  SELECT *, 2 * sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS twice,
    sum(CASE WHEN rank IS NOT NULL THEN p::HUGEINT * size ELSE 0 END) OVER (PARTITION BY source) AS wanted FROM r
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN rank IS NOT NULL AND twice::HUGEINT * 1000000 <= 2 * wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""
}

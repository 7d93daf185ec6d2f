"""Quality rules with host-level verdicts, in DataFrame functions only.

Base rules judge each text: too few words, or too many words inside 8-word windows that the text repeats.
Failures are counted per host (pre-aggregated before the shuffle); a host's failure rate is shrunk by a beta
prior fitted to all hosts by moments: its mean is the rate of all documents, and its strength follows from how
far hosts' rates, weighed by documents, lie apart beyond what chance does within hosts. Hosts whose shrunk rate
exceeds MOST_FAILING are rejected, and the verdicts are joined back to the documents.

Cases: a null text has no words and fails; a null host is a host. Windows are compared by 64-bit hashes.
Where rates lie no farther apart than chance has it, or there is one host, the prior has strength
MOST_STRENGTH. Very long texts cost their length. Repeated rows count each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, read

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
MOST_FAILING = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more; overlaps count once.

    Windows become hashes; only where one recurs are they sorted, with their places, to find which.
    """

    def places(hashes: Column) -> Column:
        def starts(sorted_: Column) -> Column:
            n = F.size(sorted_)
            again = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & (sorted_[k]["h"] == sorted_[F.greatest(k - 1, F.lit(0))]["h"])) | ((k < n - 1) & (sorted_[k]["h"] == sorted_[F.least(k + 1, n - 1)]["h"])))
            return F.array_sort(F.transform(again, lambda k: sorted_[k]["i"]))

        return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts)

    def covered(at: Column) -> Column:
        n = F.size(at)
        step = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k < n - 1, F.least(F.lit(WINDOW), at[F.least(k + 1, n - 1)] - at[k])).otherwise(WINDOW))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + j] for j in range(WINDOW)]))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(places(hashes), covered))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count))


def measures(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host and the base measures of every row."""
    d = docs.select("doc_id", F.col(host).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "host", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """judged(host, base_failed) -> host, n, failed, rate (shrunk), host_ok."""
    hosts = cut(judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    found = hosts.agg(F.count("*"), F.sum("n"), F.sum("failed"), F.sum(n * n), F.sum(f * f / n)).first()
    mean, strength = prior(*(x or 0 for x in found))
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn("host_ok", F.col("rate") <= MOST_FAILING)


def prior(hosts: int, n: int, failed: int, squares: float, spread: float) -> tuple[float, float]:
    """Mean and strength from the sums, over hosts, of documents, failures, documents squared, and failures squared by documents.

    Of hosts of n documents, rates of variance mean * (1 - mean) * (1 / n + r * (1 - 1 / n)) are expected, r being
    1 / (strength + 1); r is what makes the expected sum of n * (rate - mean)^2 equal the one that is seen.
    """
    mean = failed / n if n else 0.0
    room = n - squares / n - (hosts - 1) if n else 0.0
    if not 0 < mean < 1 or room <= 0:
        return mean, MOST_STRENGTH
    r = ((spread - n * mean * mean) / (mean * (1 - mean)) - (hosts - 1)) / room
    return mean, MOST_STRENGTH if r <= 0 else min(max(1 / r - 1, LEAST_STRENGTH), MOST_STRENGTH)


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the base measures, base_failed, host_rate and kept of every row."""
    m = cut(measures(docs, host).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))))
    v = host_verdicts(m).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_ok")
    out = m.join(v, m.host.eqNullSafe(v.h))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host_rate")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(read(spark, sf_dir, "documents")).drop("host_rate")


ORACLE = {
    "op10_host_rules": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), a AS (
  SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
), r AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM a) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b GROUP BY source
), t AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(failed)::DOUBLE AS f, sum(n::DOUBLE * n) AS squares, sum(failed::DOUBLE * failed / n) AS spread FROM h
), q AS (
  SELECT *, f / n AS mean, n - squares / n - (k - 1) AS room FROM t
), p AS (
  SELECT mean, CASE WHEN mean <= 0 OR mean >= 1 OR room <= 0 OR r <= 0 THEN 1e6 ELSE least(greatest(1 / r - 1, 1), 1e6) END AS s
  FROM (SELECT *, CASE WHEN mean > 0 AND mean < 1 AND room > 0 THEN ((spread - n * mean * mean) / (mean * (1 - mean)) - (k - 1)) / room END AS r FROM q)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (h.failed + mean * s) / (h.n + s) <= 0.5 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source CROSS JOIN p"""
}

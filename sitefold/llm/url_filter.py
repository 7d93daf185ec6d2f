"""URL filter: allow and block rules, and for all other URLs a ratio of two character language models.

Rules name a host (which stands for its subdomains too) and the start of a path; the longest that fits wins.
URLs that rules allow or block train two variable-order Markov models over the characters of host and path,
smoothed by interpolating every order with the next lower one (Witten-Bell). A URL's score is the
difference of its log-likelihoods per character. The threshold is calibrated on a fifth of the ruled URLs,
which the models don't see: it parts allowed and blocked ones best (difference of their shares above it).

Counts cover all ruled URLs and stay distributed, as do the models: tables of n-grams, joined to each
other order by order, then to the URLs' n-grams. The at most HOT n-grams that each make up 1 / HOT of all
occurrences or more (so no more than HOT can exist) are scored by a broadcast before anything is shuffled;
no other n-gram can load a task.

Cases: a null URL or one without :// has empty host and path; it scores 0. A very long URL is cut into characters
once, and told from others by a 128-bit hash, so that it costs its length. Without ruled URLs of both kinds
the threshold is 0, and a score of 0 is allowed. URLs that repeat count as often as they occur and get equal
verdicts; a null page_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

ORDER = 4
FOLDS = 5
HOT = 4096
#: Log-likelihoods are summed as whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
BINS = 2000

#: (rule, allowed): host, then the path's start.
RULES = (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))

_START, _STOP = "\x02", "\x03"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, rule).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of every URL, and its end: the character with the ORDER before it."""
    padded = F.concat(F.lit(_START * ORDER), "s", F.lit(_STOP))

    def grams(chars: Column) -> Column:  # an array of one, so that the characters are cut out once
        return F.transform(F.sequence(F.lit(0), F.size(chars) - ORDER - 1), lambda i: F.concat(*[chars[i + j] for j in range(ORDER + 1)]))

    return urls.withColumn("g", F.explode(F.transform(F.array(F.split(padded, "")), grams)[0]))


def language_models(top: DataFrame) -> DataFrame:
    """top(g of ORDER + 1 characters, a, r: occurrences in accepted and rejected URLs) -> g, llr (UNITs).

    Level k holds the n-grams of k + 1 characters: P(c | context) = (count + kinds * P(c | shorter context)) /
    (context's count + kinds), kinds being how many characters followed the context.
    """
    below = None
    for k in range(ORDER + 1):
        level = top.groupBy(F.expr(f"right(g, {k + 1})").alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        kinds = [F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")]
        if k == 0:
            one = level.agg(*kinds, F.count("*").alias("v")).first()
            for x in ("na", "nr", "ta", "tr"):
                level = level.withColumn(x, F.lit(one[x] or 0))
            level = level.withColumn("pa", F.lit(1.0 / (one["v"] + 1))).withColumn("pr", F.col("pa"))
        else:
            context = F.expr(f"left(g, {k})")
            level = level.withColumn("c", context).join(level.groupBy(context.alias("c")).agg(*kinds), "c").drop("c")
            level = level.withColumn("s", F.expr(f"right(g, {k})")).join(below, "s").drop("s")
        smooth = [F.coalesce(F.try_divide(F.col(c) + F.col(t) * F.col(p), F.col(n) + F.col(t)), F.col(p)).alias(p) for c, t, n, p in (("a", "ta", "na", "pa"), ("r", "tr", "nr", "pr"))]
        level = level.select("g", *smooth)
        below = level.withColumnRenamed("g", "s")
    return level.select("g", F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long").alias("llr"))


def url_id(s: Column) -> Column:
    return F.unhex(F.md5(s.cast("binary")))


def scores(urls: DataFrame) -> DataFrame:
    """urls(s unique and not empty, n, label: true, false or null, calibrates) -> id (url_id of s), score: of "accepted"
    against "rejected" per character, of URLs without a label or that calibrate."""
    urls = urls.withColumn("id", url_id(F.col("s"))).withColumn("size", F.char_length("s") + 1)
    learns = F.col("label").isNotNull() & ~F.col("calibrates")
    counted = [F.sum(F.when((F.col("label") == want) & learns, F.col("n")).otherwise(0)).alias(x) for x, want in (("a", True), ("r", False))]
    top = cut(_grams(urls).groupBy("g").agg(*counted, F.count_if(~learns).alias("seen")))
    total = top.agg(F.sum("seen")).first()[0] or 0
    weights = cut(language_models(top).join(top.select("g", "seen"), "g").where("seen > 0"))
    is_hot = F.col("seen") * HOT >= total
    hot = F.broadcast(weights.where(is_hot).select("g", "llr"))
    key = ["id", "size"]
    split = _grams(urls.where(~learns)).select(*key, "g").join(hot, "g", "left")
    known = split.where("llr IS NOT NULL").groupBy(*key).agg(F.sum("llr").alias("llr"))
    rest = split.where("llr IS NULL").select(*key, "g").join(weights.where(~is_hot).select("g", F.col("llr").alias("x")), "g").groupBy(*key).agg(F.sum("x").alias("llr"))
    return known.unionByName(rest).groupBy(*key).agg(F.sum("llr").alias("llr")).select("id", (F.col("llr") / UNIT / F.col("size")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """scored(score, label, n) of calibrating URLs -> the score that parts the labels best; at most 2 * BINS + 1 rows come back."""
    bin_ = F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(BINS)), F.lit(-BINS)).alias("bin")
    rows = scored.groupBy(bin_).agg(F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("label"), F.col("n")).otherwise(0)).alias("r")).collect()
    a, r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not a or not r:
        return 0.0
    best, above_a, above_r = (0.0, 0.0, 0.0), 0, 0
    rows = sorted(rows, key=lambda x: -x["bin"])
    for x, lower in zip(rows, [*rows[1:], None], strict=True):
        above_a, above_r = above_a + x["a"], above_r + x["r"]
        at = x["bin"] / 100 if lower is None else (x["bin"] + lower["bin"] + 1) / 200  # amid what lies between
        best = max(best, (above_a / a - above_r / r, -abs(at), at))
    return best[2]


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) of every row."""
    p = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    allowed = F.lit(None).cast("boolean")
    for rule, allow in rules:
        allowed = F.when(F.col("rule") == rule, F.lit(allow)).otherwise(allowed)
    p = p.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", allowed)
    key = F.concat("host", "path")
    grouped = p.where(key != "").groupBy(key.alias("s")).agg(F.count("*").alias("n"), F.max("label").alias("label"))
    urls = cut(grouped.withColumn("calibrates", F.crc32(F.col("s").cast("binary")) % FOLDS == 0))
    scored = cut(scores(urls))
    known = urls.where("calibrates AND label IS NOT NULL").select(url_id(F.col("s")).alias("id"), "n", "label").join(scored, "id")
    at = threshold(known)
    # rows that no score decides don't meet in one task: their keys are their pages'
    open_ = F.col("label").isNull() & (key != "")
    out = p.withColumn("id", F.when(open_, url_id(key)).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).cast("binary")))
    out = out.join(scored.select("id", "score"), "id", "left").withColumn("score", F.when(open_, F.col("score")))
    verdict = F.coalesce("label", F.coalesce("score", F.lit(0.0)) >= at)
    return out.select("page_id", "host", "path", "rule", F.when(verdict, "allow").otherwise("block").alias("verdict"), F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))).alias("score"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))

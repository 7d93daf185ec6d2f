"""The queries of the statistics engine, by name, and the SQL that gives the same rows.

Sites, groups and missing values are derived from the test tables' columns; every query reads whole tables.
Means, tests and spreads are rounded in both engines, so that the order of summation can't show.
"""

from __future__ import annotations

import json
import shutil
import statistics
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BadInput, ColumnNotAllowed, PolicyViolation
from ..frame import SiteFrame
from ..functions.scalar import body_mass_index, sample_label
from ..operators import anova as av
from ..operators import clocks as ck
from ..operators import fisher as fi
from ..operators import methylation as me
from ..operators import moments as mo
from ..operators import pca as pc
from ..operators import summary as su
from ..operators import ttest as tt
from ..policy import Policy
from ..sources import idat
from ..sources import tables as so

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

NUMBERS = ("quantity", "extendedprice", "discount", "tax")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Doubles rounded to places, or to those named by column; adding 0 turns -0 into 0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), other.get(c, places)) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def lineitem(spark: SparkSession, sf_dir: str, station: str = "l_linestatus") -> SiteFrame:
    """Numbers of lineitem; every third line of an order has no quantity."""
    li = table(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_quantity"))
    columns = [F.col(station).alias("station"), quantity.alias("quantity"), *[F.col(f"l_{c}").alias(c) for c in NUMBERS[1:]]]
    return SiteFrame(li.select(*columns, F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag")))


LI = """SELECT {station} AS station, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS extendedprice,
  l_discount AS discount, l_tax AS tax, l_linestatus AS status, l_returnflag AS flag FROM lineitem"""


def long_sql(station: str, keys: str = "station", columns=NUMBERS, source: str = LI) -> str:
    """CTEs li and x(keys, column, v)."""
    parts = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS \"column\", {c} AS v FROM li" for c in columns)
    return f"li AS ({source.format(station=station)}), x AS ({parts})"


# ---------------------------------------------------------------- summaries


@query(f"""WITH {long_sql("l_linestatus")} SELECT "column", count(v) AS "count", count(*) - count(v) AS missing, min(v) AS "min", max(v) AS "max",
  round(sum(v), 2) AS "sum", round(avg(v), 8) AS mean, round(stddev_samp(v), 6) AS std FROM x GROUP BY "column" """)
def numeric_summary(spark, sf_dir):
    return rounded(su.numeric_summary(lineitem(spark, sf_dir), NUMBERS), sum=2, mean=8)


@query(f"""WITH {long_sql("l_linestatus")} SELECT station, "column", count(v) AS "count", min(v) AS "min", max(v) AS "max", round(sum(v), 2) AS "sum",
  count(*) - count(v) AS missing, round(avg(v), 8) AS mean, round(var_samp(v), 4) AS var FROM x GROUP BY station, "column" """)
def numeric_station(spark, sf_dir):
    return rounded(su.numeric_station(lineitem(spark, sf_dir), NUMBERS), sum=2, var=4, mean=8)


QUARTILES_SQL = """round(quantile_cont(v::DOUBLE, 0.25), 6) AS q25, round(quantile_cont(v::DOUBLE, 0.5), 6) AS median,
  round(quantile_cont(v::DOUBLE, 0.75), 6) AS q75, round(quantile_cont(v::DOUBLE, 0.75) - quantile_cont(v::DOUBLE, 0.25), 6) AS iqr"""


@query(f"""WITH {long_sql("l_linestatus")} SELECT station, "column", {QUARTILES_SQL} FROM x GROUP BY station, "column" """)
def station_quartiles(spark, sf_dir):
    return rounded(su.quartiles(lineitem(spark, sf_dir), NUMBERS))


@query(f"""WITH {long_sql("l_linestatus")} SELECT "column", {QUARTILES_SQL} FROM x GROUP BY "column" """)
def global_quartiles(spark, sf_dir):
    return rounded(su.quartiles(lineitem(spark, sf_dir), NUMBERS, per_station=False))


def orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    clerk = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority"))
    return SiteFrame(o.select(F.col("o_orderstatus").alias("station"), clerk.alias("priority"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_totalprice").alias("price")))


ORDERS = """SELECT o_orderstatus AS station, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  year(o_orderdate)::VARCHAR AS year, o_totalprice AS price FROM orders"""


@query(f"""WITH {long_sql("", columns=("priority", "year"), source=ORDERS)}
  SELECT "column", count(v) AS "count", count(*) - count(v) AS missing FROM x GROUP BY "column" """)
def categorical_summary(spark, sf_dir):
    return su.categorical_summary(orders(spark, sf_dir), ["priority", "year"])


@query(f"""WITH {long_sql("", columns=("priority", "year"), source=ORDERS)},
  g AS (SELECT station, "column", v AS value, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY ALL),
  c AS (SELECT *, min(n) OVER (PARTITION BY station, "column") AS least FROM g),
  m AS (SELECT "column", count(DISTINCT station) FILTER (least < 5) AS n_masked_stations FROM c GROUP BY 1)
  SELECT "column", value, sum(n)::BIGINT AS n, max(n_masked_stations) AS n_masked_stations FROM c JOIN m USING ("column") WHERE least >= 5 GROUP BY "column", value""")
def value_counts(spark, sf_dir):
    return su.value_counts(orders(spark, sf_dir), ["priority", "year"])


def parts(spark, sf_dir):
    return SiteFrame(table(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("string").alias("station"), "p_name", "p_brand", "p_type"))


@query("""WITH li AS (SELECT (p_size % 3)::VARCHAR AS station, p_name, p_brand, p_type FROM part),
  x AS (SELECT station, 'p_name' AS "column", p_name AS value FROM li UNION ALL SELECT station, 'p_brand', p_brand FROM li UNION ALL SELECT station, 'p_type', p_type FROM li),
  g AS (SELECT station, "column", value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL)
  SELECT * FROM g QUALIFY min(n) OVER (PARTITION BY station, "column") >= 5""")
def value_counts_masked(spark, sf_dir):
    return su.value_counts_masked(parts(spark, sf_dir), ["p_name", "p_brand", "p_type"])


@query(f"""WITH li AS ({LI.format(station="l_linestatus")}) SELECT station, count(*) FILTER (quantity IS NOT NULL AND extendedprice IS NOT NULL) AS complete_rows FROM li GROUP BY station""")
def complete_rows(spark, sf_dir):
    return su.complete_rows(lineitem(spark, sf_dir))


@query(f"""WITH li AS ({ORDERS}) SELECT station, 'price' AS "column", round(sum(pow(price - (SELECT avg(price) FROM li), 2)) / 1e6, 4) AS ssd FROM li GROUP BY station""")
def ssd_about_mean(spark, sf_dir):
    f = orders(spark, sf_dir)
    mean = su.numeric_summary(f, ["price"]).first()["mean"]
    return rounded(su.ssd_about(f, {"price": mean}).withColumn("ssd", F.col("ssd") / 1e6), 4)


@query(f"""WITH li AS ({ORDERS}) SELECT 'price' AS "column", round(stddev_samp(price), 6) AS std FROM li""")
def global_std(spark, sf_dir):
    return rounded(su.numeric_summary(orders(spark, sf_dir), ["price"]).select("column", "std"))


def customers(spark, sf_dir):
    return SiteFrame(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("station"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))


@query("""WITH g AS (SELECT c_nationkey AS station, count(*) AS n_rows, least(count(c_acctbal), count(c_mktsegment)) AS least_values FROM customer GROUP BY 1)
  SELECT station, n_rows, least_values, n_rows >= 59 AND least_values >= 59 AS passes FROM g""")
def guard_min_rows(spark, sf_dir):
    return mo.guarded_stations(customers(spark, sf_dir), ["balance", "segment"], Policy(min_rows=59))


@query("""SELECT c_nationkey AS station, 'balance' AS "column", count(*) AS "count", NULL::DOUBLE AS "min", NULL::DOUBLE AS "max", round(sum(c_acctbal), 2) AS "sum",
  (count(*) - count(c_acctbal))::BIGINT AS missing, round(avg(c_acctbal), 6) AS mean, round(var_samp(c_acctbal), 2) AS var FROM customer GROUP BY 1""")
def stat_suppression(spark, sf_dir):
    return rounded(su.numeric_station(customers(spark, sf_dir), ["balance"], Policy(hidden=frozenset({"min", "max"}))), sum=2, var=2)


@query("""SELECT event_type AS station, count(*) AS n, round(avg((json_extract_string(props, '$.k'))::DOUBLE), 6) AS mean FROM events GROUP BY 1""")
def cast_numeric(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("station"), F.get_json_object("props", "$.k").alias("k"))
    f = su.cast_numeric(SiteFrame(e), ["k"])
    return rounded(mo.station_moments(f, ["k"]).select("station", F.col("n_rows").alias("n"), "mean"))


# ---------------------------------------------------------------- moments and tests

GROUPED = long_sql("l_returnflag", 'station, status AS "group"')


@query(f"""WITH {GROUPED} SELECT station, "group", "column", count(*) AS n_rows, count(v) AS n, round(avg(v), 8) AS mean, round(var_samp(v), 4) AS var,
  round(sum(v), 2) AS "sum", min(v) AS "min", max(v) AS "max", count(*) - count(v) AS missing FROM x GROUP BY station, "group", "column" """)
def station_moments(spark, sf_dir):
    return rounded(mo.station_moments(lineitem(spark, sf_dir, "l_returnflag"), NUMBERS, "status"), var=4, sum=2, mean=8)


@query(f"""WITH {GROUPED} SELECT "group", "column", count(v) AS n, round(avg(v), 8) AS mean, round(var_samp(v), 4) AS var FROM x GROUP BY "group", "column" """)
def combine_moments(spark, sf_dir):
    return rounded(mo.merge_moments(mo.station_moments(lineitem(spark, sf_dir, "l_returnflag"), NUMBERS, "status"), ["group", "column"]), var=4, mean=8)


def t_sql(sides: str, first: str, second: str) -> str:
    """From sides(side, column, n, mean, var): the pooled test, its p-value by the finite series of whole degrees of freedom."""
    return f"""s AS ({sides}), b AS (SELECT a."column", a.n AS n_a, a.mean AS mean_a, a.var AS var_a, b.n AS n_b, b.mean AS mean_b, b.var AS var_b, a.n + b.n - 2 AS dof
    FROM s a JOIN s b ON a."column" = b."column" AND a.side = '{first}' AND b.side = '{second}'),
  t AS (SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / dof * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)) AS t FROM b),
  a AS (SELECT *, atan(abs(t) / sqrt(dof)) AS th FROM t),
  p AS (SELECT *, CASE WHEN dof % 2 = 0
      THEN 1 - sin(th) * list_sum(list_transform(range(0, (dof // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos(th)))))
      ELSE 1 - 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum(list_transform(range(0, ((dof - 1) // 2)::BIGINT), lambda k: exp(0.5 * ln(pi()) - ln(2) + lgamma(k + 1) - lgamma(k + 1.5) + 2 * k * ln(cos(th))))), 0)) END AS p FROM a)
  SELECT "column", n_a, round(mean_a, 6) AS mean_a, round(var_a, 4) AS var_a, n_b, round(mean_b, 6) AS mean_b, round(var_b, 4) AS var_b, dof,
    round(t, 6) AS t_score, round(greatest(p, 0), 6) AS p_value FROM p"""


@query(f"""WITH {GROUPED}, {t_sql('SELECT "group" AS side, "column", count(v) AS n, avg(v) AS mean, var_samp(v) AS var FROM x GROUP BY ALL', "F", "O")}""")
def ttest_grouped(spark, sf_dir):
    return rounded(tt.ttest(lineitem(spark, sf_dir, "l_returnflag"), NUMBERS, "status"), var_a=4, var_b=4)


AS_WRITTEN = """SELECT "group" AS side, "column", sum(n)::BIGINT AS n, sum(n * mean) / sum(n) AS mean,
  (sum((n - 1) * var) + sum(n * pow(mean - m, 2))) / (sum(n) - 1) AS var
  FROM (SELECT *, sum(n * mean) OVER w / sum(n) OVER w AS m FROM (
    SELECT g.station, g."group", g."column", g.n, g.mean, (SELECT sum(pow(x.v - g.mean, 2)) FROM x WHERE x.station = g.station AND x."column" = g."column") / (g.n - 1) AS var
    FROM (SELECT station, "group", "column", count(v) AS n, avg(v) AS mean FROM x GROUP BY ALL HAVING count(v) > 1) g) WINDOW w AS (PARTITION BY "group", "column"))
  GROUP BY ALL"""


@query(f"""WITH {GROUPED}, {t_sql(AS_WRITTEN, "F", "O")}""")
def ttest_grouped_as_written(spark, sf_dir):
    return rounded(tt.ttest(lineitem(spark, sf_dir, "l_returnflag"), NUMBERS, "status", compat="as_written"), var_a=4, var_b=4)


@query(f"""WITH {long_sql("l_linestatus")}, {t_sql('SELECT station AS side, "column", count(v) AS n, avg(v) AS mean, var_samp(v) AS var FROM x GROUP BY ALL', "F", "O")}""")
def ttest_station_vs_station(spark, sf_dir):
    return rounded(tt.ttest(lineitem(spark, sf_dir), NUMBERS), var_a=4, var_b=4)


FEATURES = ("quantity", "extendedprice", "discount")
ANOVA = f"""li AS (SELECT * FROM ({LI.format(station="l_linestatus")}) WHERE quantity IS NOT NULL),
  x AS ({" UNION ALL ".join(f"SELECT station, flag, '{c}' AS \"column\", {c} AS v FROM li" for c in FEATURES)})"""


@query(f"""WITH {ANOVA} SELECT station, flag AS "group", "column", count(*) AS n, round(avg(v), 8) AS mean, round(var_samp(v), 4) AS var FROM x GROUP BY ALL""")
def anova_moments(spark, sf_dir):
    return rounded(av.anova_partials(lineitem(spark, sf_dir), "flag", FEATURES), var=4, mean=8)


def anova_sql(groups: str, between: str, k: str = "k - 1") -> str:
    """groups(column, n, ssw, ssb): sums; three groups have two degrees of freedom, whose tail has a closed form."""
    return f"""g AS ({groups}), s AS (SELECT {between} AS "column", 3::BIGINT AS k, max(n) AS n, sum(ssb) AS ss_between, sum(ssw) AS ss_within FROM g GROUP BY 1),
  f AS (SELECT *, ss_between / ({k}) AS ms_between, ss_within / (n - k) AS ms_within FROM s)
  SELECT "column", k, n, round(ss_between, -3) AS ss_between, round(ss_within, -3) AS ss_within, round(ms_between, 0) AS ms_between, round(ms_within, 0) AS ms_within,
    round(ms_between / ms_within, 6) AS f_statistic, round(pow((n - k) / ((n - k) + 2 * ms_between / ms_within), (n - k) / 2.0::DOUBLE), 6) AS p_value FROM f"""


ANOVA_GROUPS = """SELECT "column", sum(n)::BIGINT AS n, sum(ssw) AS ssw, sum(n * pow(mean - center, 2)) AS ssb FROM (
  SELECT "column", flag, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS ssw, sum(sum(v)) OVER (PARTITION BY "column") / sum(count(*)) OVER (PARTITION BY "column") AS center
  FROM x GROUP BY "column", flag) GROUP BY "column" """
PLACES = {"ss_between": -3, "ss_within": -3, "ms_between": 0, "ms_within": 0}


@query(f"""WITH {ANOVA}, {anova_sql(ANOVA_GROUPS, '"column"')}""")
def anova_per_feature(spark, sf_dir):
    return rounded(av.anova(lineitem(spark, sf_dir), "flag", FEATURES), **PLACES)


@query(f"""WITH {ANOVA}, {anova_sql(ANOVA_GROUPS, "'*'")}""")
def anova_combined(spark, sf_dir):
    return rounded(av.anova(lineitem(spark, sf_dir), "flag", FEATURES, combine_features=True), **PLACES)


ANOVA_SITES = """SELECT "column", sum(n)::BIGINT AS n, sum(ssw) AS ssw, sum(n * pow(mean - center, 2)) AS ssb FROM (
  SELECT station, "column", flag, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS ssw,
    sum(sum(v)) OVER (PARTITION BY station, "column") / sum(count(*)) OVER (PARTITION BY station, "column") AS center
  FROM x GROUP BY station, "column", flag) GROUP BY "column" """


@query(f"""WITH {ANOVA}, {anova_sql(ANOVA_SITES, "'*'", "k")}""")
def anova_as_written(spark, sf_dir):
    return rounded(av.anova(lineitem(spark, sf_dir), "flag", FEATURES, compat="as_written"), **PLACES)


@query(f"""WITH {ANOVA} SELECT flag AS "group", "column", round(avg(v), 8) AS mean, round(var_samp(v), 4) AS variance FROM x GROUP BY ALL""")
def anova_group_statistics(spark, sf_dir):
    return rounded(av.group_statistics(lineitem(spark, sf_dir), "flag", FEATURES), variance=4, mean=8)


@query(f"""WITH {ANOVA}, g AS (SELECT station, flag, "column", avg(v) AS mean, var_samp(v) AS var, sum(count(*)) OVER (PARTITION BY station, "column") AS rows FROM x GROUP BY station, flag, "column"),
  t AS (SELECT "column", count(*) AS total FROM x GROUP BY 1)
  SELECT flag AS "group", "column", round(sum(mean * rows) / max(total), 6) AS mean, round(sum(var * (rows - 1)), -3) AS variance FROM g JOIN t USING ("column") GROUP BY flag, "column" """)
def anova_group_statistics_as_written(spark, sf_dir):
    return rounded(av.group_statistics(lineitem(spark, sf_dir), "flag", FEATURES, compat="as_written"), variance=-3)


@query("""WITH d AS (SELECT l.quality, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id)),
  x AS (SELECT 'quality' AS "column", quality::VARCHAR AS value FROM d UNION ALL SELECT 'toxic', toxic::VARCHAR FROM d)
  SELECT DISTINCT "column", value FROM x WHERE value IS NOT NULL""")
def distinct_categories(spark, sf_dir):
    return fi.distinct_categories(judged(spark, sf_dir), "quality", "toxic")


def judged(spark, sf_dir):
    """Labels of documents, by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("station"))
    return SiteFrame(table(spark, sf_dir, "labels").join(d, "doc_id").select("station", "quality", "toxic"))


@query("""WITH d AS (SELECT d.lang AS station, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)),
  c AS (SELECT s.station, g.quality, o.toxic FROM (SELECT DISTINCT station FROM d) s, (SELECT DISTINCT quality FROM d) g, (SELECT DISTINCT toxic FROM d) o)
  SELECT c.station, c.quality AS "group", c.toxic AS outcome, count(d.station) AS n FROM c LEFT JOIN d USING (station, quality, toxic) GROUP BY ALL""")
def contingency_station(spark, sf_dir):
    return fi.contingency_station(judged(spark, sf_dir), "quality", "toxic")


@query("""SELECT l.quality AS "group", l.toxic AS outcome, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL""")
def contingency(spark, sf_dir):
    return fi.contingency(judged(spark, sf_dir), "quality", "toxic")


def fisher_sql(chosen: str) -> str:
    return f"""WITH d AS (SELECT l.quality AS g, l.toxic AS o FROM labels l JOIN documents d USING (doc_id)),
  t AS (SELECT count(*) FILTER (g = 0 AND o = 0) AS a, count(*) FILTER (g = 0 AND o = 1) AS b, count(*) FILTER (g = 1 AND o = 0) AS c, count(*) FILTER (g = 1 AND o = 1) AS d FROM d),
  w AS (SELECT x, a, lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(b + d - (a + b - x) + 1) AS v
    FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t)),
  m AS (SELECT max(v) AS top, max(v) FILTER (x = a) AS seen FROM w)
  SELECT a, b, c, d, round(a * d / (b * c)::DOUBLE, 6) AS oddsratio,
    round((SELECT sum(exp(v - top)) FILTER ({chosen}) / sum(exp(v - top)) FROM w, m), 6) AS p_value FROM t"""


def _fisher(spark, sf_dir, alternative):
    r = fi.fisher(judged(spark, sf_dir), "quality", "toxic", alternative=alternative)
    (a, b), (c, d) = r.contingency_table
    return rounded(spark.createDataFrame([(a, b, c, d, r.oddsratio, r.p_value)], "a bigint, b bigint, c bigint, d bigint, oddsratio double, p_value double"))


@query(fisher_sql("v <= seen + ln(1 + 1e-7)"))
def fisher_exact(spark, sf_dir):
    return _fisher(spark, sf_dir, "two-sided")


@query(fisher_sql("x <= a"))
def fisher_less(spark, sf_dir):
    return _fisher(spark, sf_dir, "less")


@query(fisher_sql("x >= a"))
def fisher_greater(spark, sf_dir):
    return _fisher(spark, sf_dir, "greater")


# ---------------------------------------------------------------- principal components


@query(f"""WITH li AS (SELECT * FROM ({LI.format(station="l_returnflag")}) WHERE quantity IS NOT NULL) SELECT station, count(*) AS n, {", ".join(f"round(sum({a}), 2) AS sum_{a}" for a in NUMBERS)}, {", ".join(f"round(sum({a} * {b}), 2) AS {a}_{b}" for i, a in enumerate(NUMBERS) for b in NUMBERS[i:])} FROM li GROUP BY station""")
def pca_gram(spark, sf_dir):
    g = pc.gram_station(lineitem(spark, sf_dir, "l_returnflag"), NUMBERS)
    sums = [F.col("sums")[i].alias(f"sum_{a}") for i, a in enumerate(NUMBERS)]
    products = [F.col("products")[i][j].alias(f"{a}_{NUMBERS[j]}") for i, a in enumerate(NUMBERS) for j in range(i, len(NUMBERS))]
    return rounded(g.select("station", "n", *sums, *products), 2)


def cov_sql(cell: str) -> str:
    return f"WITH li AS (SELECT * FROM ({LI.format(station='l_returnflag')}) WHERE quantity IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS col, round({cell.format(a=a, b=b)}, 4) + 0 AS value FROM li" for a in NUMBERS for b in NUMBERS)


@query(cov_sql("covar_samp({a}, {b})"))
def pca_covariance(spark, sf_dir):
    return rounded(pc.covariance(lineitem(spark, sf_dir, "l_returnflag"), NUMBERS), 4)


@query(cov_sql("sum({a} * {b}) / (count(*) - 1)"))
def pca_uncentered(spark, sf_dir):
    return rounded(pc.covariance(lineitem(spark, sf_dir, "l_returnflag"), NUMBERS, center=False), 4)


@query(f"""WITH li AS (SELECT * FROM ({LI.format(station="l_returnflag")}) WHERE quantity IS NOT NULL),
  m AS (SELECT var_samp(quantity) AS a, var_samp(tax * 100) AS c, covar_samp(quantity, tax * 100) AS b FROM li),
  e AS (SELECT 1 AS component, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS v, a + c AS total FROM m UNION ALL SELECT 2, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), a + c FROM m)
  SELECT component::BIGINT AS component, round(v, 6) AS explained_variance, round(v / total, 6) AS explained_variance_ratio FROM e""")
def pca_eigen_2d(spark, sf_dir):
    f = lineitem(spark, sf_dir, "l_returnflag")
    r = pc.pca(SiteFrame(f.df.withColumn("percent", F.col("tax") * 100)), ["quantity", "percent"])
    rows = [(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(r.explained_variance, r.explained_variance_ratio, strict=True))]
    return rounded(spark.createDataFrame(rows, "component bigint, explained_variance double, explained_variance_ratio double"))


@query("""WITH v AS (SELECT i, embedding[i]::DOUBLE AS x FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
  t AS (SELECT round(sum(s), 4) AS total_variance FROM (SELECT var_samp(x) AS s FROM v GROUP BY i))
  SELECT unnest(range(1, 9)) AS component, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS overlap, true AS descending, total_variance FROM t""")
def pca_components(spark, sf_dir):
    """Directions of the 64-dimensional embeddings: of each, how far C v is from its eigenvalue times v, its overlap with the others, and all variance."""
    e = table(spark, sf_dir, "embeddings").withColumn("station", F.col("label") % 3)
    d = e.select(F.max(F.size("embedding"))).first()[0] or 0
    r = pc.pca_of(pc.gram_of_vectors(e, "station", "embedding", d), [f"x{i}" for i in range(d)], 8)
    rows = []
    for j, value in enumerate(r.explained_variance.tolist()):
        v = r.components[:, j]
        other = max((abs(float(v @ r.components[:, k])) for k in range(8) if k != j), default=0.0)
        rows.append((j + 1, float(v @ v), float(abs(r.covariance @ v - value * v).max()), other, bool(j == 0 or value <= r.explained_variance[j - 1]), value / float(r.explained_variance_ratio[j])))
    return rounded(spark.createDataFrame(rows, "component bigint, norm double, residual double, overlap double, descending boolean, total_variance double"), total_variance=4)


@query(f"""WITH li AS (SELECT * FROM ({LI.format(station="l_returnflag")}) WHERE quantity IS NOT NULL) SELECT count(*) AS n, round(sum(quantity), 2) AS sum_quantity, round(sum(quantity * tax), 2) AS product FROM li WHERE station != 'N'""")
def pca_skips_broken_sites(spark, sf_dir):
    """A site whose matrix has another shape is left out of the merge."""
    f = lineitem(spark, sf_dir, "l_returnflag")
    whole = pc.gram_station(SiteFrame(f.df.where("station != 'N'")), ["quantity", "tax"])
    broken = pc.gram_station(SiteFrame(f.df.where("station = 'N'")), ["quantity"])
    n, sums, products = pc.merge_grams(whole.unionByName(broken), 2)
    return rounded(spark.createDataFrame([(n, float(sums[0]), float(products[0, 1]))], "n bigint, sum_quantity double, product double"), 2)


# ---------------------------------------------------------------- methylation


def betas(spark, sf_dir) -> DataFrame:
    """Embeddings as Beta values: a dimension is a probe, a vector a sample of one of three sites."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    beta = 1 / (1 + F.exp(-F.col("x").cast("double")))
    return e.select((F.col("vec_id") % 3).cast("string").alias("station"), F.concat(F.lit("cg"), F.col("i")).alias("probe_id"), F.concat(F.lit("S"), F.col("vec_id")).alias("sample_label"), beta.alias("beta"))


BETAS = """b AS (SELECT (vec_id % 3)::VARCHAR AS station, 'cg' || (i - 1) AS probe_id, 'S' || vec_id AS sample_label, 1 / (1 + exp(-(embedding[i]::DOUBLE))) AS beta
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
  bm AS (SELECT *, log2(beta / (1 - beta)) AS m_value FROM b)"""


def wide_betas(spark, sf_dir) -> DataFrame:
    """A vector is a probe here, its dimensions are samples."""
    e = table(spark, sf_dir, "embeddings")
    d = e.select(F.max(F.size("embedding"))).first()[0] or 0
    return e.select(F.concat(F.lit("cg"), F.col("vec_id")).alias("probe_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"S{i}") for i in range(d)])


@query("""SELECT 'cg' || vec_id AS probe_id, 'S' || (i - 1) AS sample_label, round(embedding[i]::DOUBLE, 6) + 0 AS beta FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def wide_to_long(spark, sf_dir):
    return rounded(me.wide_to_long(wide_betas(spark, sf_dir)))


@query("""SELECT 'cg' || vec_id AS probe_id, """ + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0 AS S{i}" for i in range(64)) + " FROM embeddings")
def long_to_wide(spark, sf_dir):
    w = wide_betas(spark, sf_dir)
    return rounded(me.long_to_wide(me.wide_to_long(w), samples=w.columns[1:]))


@query(f"""WITH {BETAS} SELECT probe_id, sample_label, round(beta, 6) AS beta, round(m_value, 6) + 0 AS m_value FROM bm""")
def beta_m_join(spark, sf_dir):
    b = betas(spark, sf_dir).drop("station")
    return rounded(me.join_beta_m(b, me.with_m_values(b).drop("beta")))


@query(f"""WITH {BETAS}, n AS (SELECT station, count(DISTINCT sample_label) AS n FROM bm GROUP BY 1)
  SELECT station, probe_id, round(avg(beta), 6) AS beta_mean, round(avg(m_value), 6) + 0 AS m_mean, max(n.n) AS n_samples, count(beta) AS n_values FROM bm JOIN n USING (station) GROUP BY ALL""")
def probe_means_station(spark, sf_dir):
    return rounded(me.probe_means_station(SiteFrame(me.with_m_values(betas(spark, sf_dir)))))


@query(f"""WITH {BETAS}, n AS (SELECT station, count(DISTINCT sample_label) AS n FROM bm GROUP BY 1),
  s AS (SELECT station, probe_id, avg(beta) AS b, avg(m_value) AS m FROM bm GROUP BY ALL)
  SELECT probe_id, round(sum(b * n) / sum(n), 6) AS beta_mean_global, round(sum(m * n) / sum(n), 6) + 0 AS m_mean_global, sum(n)::BIGINT AS n_samples_total FROM s JOIN n USING (station) GROUP BY probe_id""")
def probe_means_global(spark, sf_dir):
    return rounded(me.probe_means_global(me.probe_means_station(SiteFrame(me.with_m_values(betas(spark, sf_dir))))))


@query(f"""WITH {BETAS} SELECT probe_id, sample_label, round(beta, 6) AS beta FROM b WHERE substr(probe_id, 3)::INT % 7 != 0 AND substr(probe_id, 3)::INT % 11 != 1""")
def probe_masks(spark, sf_dir):
    b = betas(spark, sf_dir).drop("station")
    i = F.substring("probe_id", 3, 9).cast("int")
    notes = b.select("probe_id").distinct().select("probe_id", (i % 7 == 0).alias("quality"), (i % 11 == 1).alias("snp"))
    return rounded(me.mask_probes(b, notes))


@query("""SELECT 'cg' || l_partkey AS probe_id, l_orderkey || '-' || l_linenumber AS sample_label, round(l_extendedprice / (l_extendedprice + l_quantity * 100 + 100), 6) AS beta,
  round(log2((l_extendedprice / (l_extendedprice + l_quantity * 100 + 100)) / (1 - l_extendedprice / (l_extendedprice + l_quantity * 100 + 100))), 6) + 0 AS m_value FROM lineitem""")
def intensities_to_betas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(F.concat(F.lit("cg"), F.col("l_partkey")).alias("probe_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_label"), F.col("l_extendedprice").alias("meth"), (F.col("l_quantity") * 100).alias("unmeth"))
    return rounded(me.intensities_to_betas(raw))


@query("""WITH b AS (SELECT event_type, value FROM events WHERE user_id % 2 = 0),
  s AS (SELECT event_id, event_type, value FROM events WHERE user_id % 2 = 1),
  n AS (SELECT event_type, count(*) AS n FROM b GROUP BY 1),
  r AS (SELECT event_id, event_type, value, NULL AS own FROM s),
  u AS (SELECT event_id, event_type, value, 0 AS back FROM s UNION ALL SELECT NULL, event_type, value, 1 FROM b),
  c AS (SELECT event_id, event_type, value, back, sum(back) OVER (PARTITION BY event_type ORDER BY value DESC RANGE UNBOUNDED PRECEDING) AS above FROM u)
  SELECT event_id AS probe_id, c.event_type AS sample_label, round(above / n.n, 6) AS p_value FROM c JOIN n USING (event_type) WHERE back = 0""")
def detection_p_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe_id"), F.col("event_type").alias("sample_label"), F.lit("Grn").alias("channel"), F.col("value").alias("intensity"), "user_id")
    p = me.detection_p_values(e.where("user_id % 2 = 1").drop("user_id"), e.where("user_id % 2 = 0").drop("user_id", "probe_id"))
    return rounded(p.select("probe_id", "sample_label", "p_value"))


# ---------------------------------------------------------------- clocks

CLOCKS = (("linear", 30.0, "identity"), ("bent", -0.5, "horvath"), ("sparse", 0.0, "identity"))


def coefficient(clock: str, i: int) -> float | None:
    """Of probe i: every clock takes other probes."""
    if clock == "linear":
        return (i % 5 - 2) * 3.0 if i % 2 == 0 else None
    if clock == "bent":
        return (i % 7 - 3) * 0.25 if i % 3 == 0 else None
    return 10.0 if i in (1, 60, 999) else None


COEFS = [(c, f"cg{i}", coefficient(c, i)) for c, _, _ in CLOCKS for i in (*range(64), 999) if coefficient(c, i) is not None]
CLOCK_SQL = f"""{BETAS}, k(clock, intercept, link) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE, '{c}')" for a, b, c in CLOCKS)}),
  q(clock, probe_id, coef) AS (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in COEFS)}),
  z AS (SELECT station, sample_label, clock, sum(coef * beta) AS score, count(*) AS n_probes FROM b JOIN q USING (probe_id) GROUP BY ALL),
  y AS (SELECT station, sample_label, clock, intercept + score AS x, link, n_probes, (SELECT count(*) FROM q WHERE q.clock = z.clock) - n_probes AS n_missing FROM z JOIN k USING (clock)),
  ages AS (SELECT station, sample_label, clock, CASE WHEN link = 'identity' THEN x WHEN x < 0 THEN 21 * exp(x) - 1 ELSE 21 * x + 20 END AS age, n_probes, n_missing FROM y),
  st AS (SELECT station, clock, count(age) AS n, avg(age) AS mean, stddev_pop(age) AS std, min(age) AS lo, max(age) AS hi FROM ages GROUP BY ALL)"""


def ages(spark, sf_dir) -> DataFrame:
    coefs = spark.createDataFrame(COEFS, "clock string, probe_id string, coef double")
    return ck.clock_ages(SiteFrame(betas(spark, sf_dir)), coefs, spark.createDataFrame(CLOCKS, "clock string, intercept double, link string"))


@query(f"WITH {CLOCK_SQL} SELECT station, sample_label, clock, round(age, 6) + 0 AS age, n_probes, n_missing FROM ages")
def clock_ages(spark, sf_dir):
    return rounded(ages(spark, sf_dir))


@query(f"""WITH {CLOCK_SQL} SELECT station, clock, n, round(mean, 6) + 0 AS mean, round(std, 6) AS std, round(lo, 6) + 0 AS "min", round(hi, 6) + 0 AS "max" FROM st""")
def clock_station_stats(spark, sf_dir):
    return rounded(ck.clock_station_stats(ages(spark, sf_dir)))


@query(f"""WITH {CLOCK_SQL} SELECT clock, sum(n)::BIGINT AS n, count(*) AS n_organizations, round(sum(mean * n) / sum(n), 6) + 0 AS weighted_mean,
  round(sqrt(sum((n - 1) * std * std) / (sum(n) - count(*))), 6) AS std_pooled, round(sqrt(sum(n * std * std) / (sum(n) - count(*))), 6) AS std_pooled_unbiased FROM st GROUP BY clock""")
def clock_global(spark, sf_dir):
    return rounded(ck.clock_global(ck.clock_station_stats(ages(spark, sf_dir))))


@query(f"""WITH {CLOCK_SQL}, t AS (SELECT 'Organization ' || station AS organization, clock, mean FROM st UNION ALL SELECT 'Global (Weighted)', clock, sum(mean * n) / sum(n) FROM st GROUP BY clock)
  SELECT organization, {", ".join(f"round(max(mean) FILTER (clock = '{c}'), 2) + 0 AS {c}" for c, _, _ in CLOCKS)} FROM t GROUP BY organization""")
def clock_means_table(spark, sf_dir):
    return rounded(ck.clock_means_table(ck.clock_station_stats(ages(spark, sf_dir)), [c for c, _, _ in CLOCKS]), 2)


# ---------------------------------------------------------------- scalars


@query("""SELECT DISTINCT (100000 + p_partkey) || '_R0' || (p_size % 9) || 'C01' AS sample_label FROM part""")
def idat_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stem = F.concat(F.lit("/scans/x/"), (100000 + F.col("p_partkey")).cast("string"), F.lit("_R0"), (F.col("p_size") % 9).cast("string"), F.lit("C01"))
    paths = p.select(F.explode(F.array(*[F.concat(stem, F.lit(end)) for end in ("_Grn.idat", "_Red.idat", "_grn.IDAT")])).alias("path"))
    return paths.select(sample_label(F.col("path")).alias("sample_label")).distinct()


@query("""SELECT p_partkey, round(p_retailprice / (p_size * p_size), 6) AS "BMI" FROM part""")
def bmi_derivation(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", body_mass_index(F.col("p_retailprice"), F.col("p_size")).alias("BMI")))


@query("""SELECT c_mktsegment AS category, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1""")
def mean_by_category(spark, sf_dir):
    return rounded(su.mean_by_category(customers(spark, sf_dir), "segment", "balance"))


# ---------------------------------------------------------------- columns, rules and disclosure


def outcome(call) -> str:
    """The name of the error that call raises, or "passes"."""
    try:
        call()
    except (BadInput, ColumnNotAllowed, PolicyViolation, ValueError) as e:
        return type(e).__name__
    return "passes"


def attempts(spark, calls: dict) -> DataFrame:
    return spark.createDataFrame([(k, outcome(v)) for k, v in calls.items()], "request string, result string")


@query("""SELECT * FROM (VALUES ('numeric', 'quantity'), ('numeric', 'extendedprice'), ('numeric', 'discount'), ('numeric', 'tax'), ('other', 'status'), ('other', 'flag'),
  ('named numeric', 'tax'), ('named other', 'quantity'), ('named other', 'flag')) t(kind, "column")""")
def default_columns(spark, sf_dir):
    """All columns where none are named, split into numbers and others; naming numbers makes the rest categories."""
    f = lineitem(spark, sf_dir)
    first, named = su.split_columns(f, []), su.split_columns(f, ["quantity", "tax", "flag"], ["tax"])
    rows = [(kind, c) for kind, names in zip(("numeric", "other", "named numeric", "named other"), (*first, *named), strict=True) for c in names]
    return spark.createDataFrame(rows, "kind string, column string")


@query("""SELECT * FROM (VALUES ('summary of a column that is not there', 'BadInput'), ('t-test of text', 'BadInput'), ('t-test of numbers', 'passes'), ('numbers not among the columns', 'BadInput'),
  ('group is outcome', 'BadInput'), ('analysis of no features', 'BadInput'), ('components of text', 'BadInput'), ('group that is not there', 'BadInput'), ('text as numbers', 'BadInput')) t(request, result)""")
def refused_requests(spark, sf_dir):
    f, o = lineitem(spark, sf_dir), orders(spark, sf_dir)
    return attempts(spark, {
        "summary of a column that is not there": lambda: su.summary(f, ["quantity", "nothing"]),
        "t-test of text": lambda: tt.ttest(f, ["flag"], "status"),
        "t-test of numbers": lambda: tt.ttest(f, ["tax"], "status"),
        "numbers not among the columns": lambda: su.split_columns(f, ["tax"], ["discount"]),
        "group is outcome": lambda: fi.contingency(f, "flag", "flag"),
        "analysis of no features": lambda: av.anova(f, "flag", []),
        "components of text": lambda: pc.pca(f, ["flag"]),
        "group that is not there": lambda: tt.ttest(f, ["tax"], "nothing"),
        "text as numbers": lambda: su.cast_numeric(o, ["priority"]),
    })


@query("""SELECT * FROM (VALUES ('balance', 'ColumnNotAllowed'), ('segment', 'passes'), (' segment', 'passes'), ('secret', 'ColumnNotAllowed'), ('name', 'passes'), ('key', 'ColumnNotAllowed')) t(request, result)""")
def shared_columns(spark, sf_dir):
    """Lists of columns from the environment, split at commas and not trimmed; both lists apply."""
    allowed = Policy.from_env({"SUMMARY_ALLOWED_COLUMNS": "segment, segment,name,key", "SUMMARY_DISALLOWED_COLUMNS": "key,secret"})
    return attempts(spark, {c: (lambda c=c: mo.check_columns([c], allowed)) for c in ("balance", "segment", " segment", "secret", "name", "key")})


@query("""SELECT * FROM (VALUES ('min_rows', 12), ('privacy_threshold', 5), ('ttest_min_rows', 7), ('fisher_min_rows', 3), ('hidden', 2), ('bad number', -1)) t(setting, value)""")
def rules_from_environment(spark, sf_dir):
    env = {"SUMMARY_MINIMUM_ROWS": "12", "T_TEST_MINIMUM_NUMBER_OF_RECORDS": "7", "SUMMARY_ALLOW_MIN": "false", "SUMMARY_ALLOW_VARIANCE": "0", "SUMMARY_ALLOW_MAX": "true"}
    p = Policy.from_env(env)
    bad = -1 if outcome(lambda: Policy.from_env({"SUMMARY_MINIMUM_ROWS": "many"})) == "ValueError" else 0
    rows = [("min_rows", p.min_rows), ("privacy_threshold", p.privacy_threshold), ("ttest_min_rows", p.ttest_min_rows), ("fisher_min_rows", p.fisher_min_rows), ("hidden", len(p.hidden)), ("bad number", bad)]
    return spark.createDataFrame(rows, "setting string, value int")


@query("""WITH n AS (SELECT c_nationkey AS a, count(*) AS n FROM customer WHERE c_nationkey < 4 GROUP BY 1)
  SELECT x.a AS first, y.a AS second, CASE WHEN least(x.n, y.n) <= 60 THEN 'BadInput' ELSE 'passes' END AS result FROM n x JOIN n y ON x.a < y.a""")
def ttest_minimum_rows(spark, sf_dir):
    """Two sites at a time; each needs more rows than the rule says."""
    f = customers(spark, sf_dir)
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    known = {r[0] for r in f.df.where("station < 4").select("station").distinct().collect()}
    rows = [(a, b, outcome(lambda a=a, b=b: tt.ttest(f, ["balance"], stations=[a, b], policy=Policy(ttest_min_rows=60)))) for a, b in pairs if {a, b} <= known]
    return spark.createDataFrame(rows, "first int, second int, result string")


@query("""WITH d AS (SELECT d.lang, count(*) AS n, count(DISTINCT l.quality) AS q, count(DISTINCT l.toxic) AS t FROM labels l JOIN documents d USING (doc_id) GROUP BY 1)
  SELECT lang AS station, CASE WHEN n > (SELECT median(n) FROM d) AND q = 2 AND t = 2 THEN 'passes' ELSE 'BadInput' END AS result FROM d""")
def fisher_minimum_rows(spark, sf_dir):
    """One site at a time, tested before rows without a value are left out; the rule is the median of the sites' rows."""
    f = judged(spark, sf_dir)
    sites = {r["station"]: r["count"] for r in f.df.groupBy("station").count().collect()}
    middle = int(statistics.median(sites.values()))
    rows = [(s, outcome(lambda s=s: fi.fisher(f, "quality", "toxic", stations=[s], policy=Policy(fisher_min_rows=middle)))) for s in sites]
    return spark.createDataFrame(rows, "station string, result string")


@query(f"""WITH li AS ({ORDERS}) SELECT station, NULL::BIGINT AS complete_rows, 0::BIGINT AS shown_values, NULL::DOUBLE AS ssd FROM li GROUP BY station""")
def hidden_counts(spark, sf_dir):
    """Complete rows, counts of values and deviations that sites don't share."""
    f, p = orders(spark, sf_dir), Policy(hidden=frozenset({"num_complete_rows", "counts_unique_values", "variance"}))
    rows = su.complete_rows(f, policy=p)
    shown = su.value_counts_masked(f, ["priority", "year"], p).groupBy("station").agg(F.count("*").alias("shown_values"))
    ssd = su.ssd_about(f, {"price": 1.0}, p).select("station", "ssd")
    return rows.join(shown, "station", "left").join(ssd, "station").select("station", "complete_rows", F.coalesce("shown_values", F.lit(0).cast("long")).alias("shown_values"), "ssd")


@query(f"""WITH {long_sql("l_linestatus")}, q AS (SELECT station, "column", {QUARTILES_SQL} FROM x GROUP BY station, "column")
  SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY station) - 1 AS place, station, q25, median, q75, iqr FROM q""")
def quartile_lists(spark, sf_dir):
    """Every site's quartiles, as one list for each column, in the order of sites."""
    lists = su.quartile_lists(lineitem(spark, sf_dir), NUMBERS)
    return rounded(lists.select("column", F.posexplode("quartiles").alias("place", "q")).select("column", F.col("place").cast("long").alias("place"), "q.*"))


@query(f"""WITH {long_sql("", "station", ("price",), ORDERS)}, c AS (SELECT station, count(*) FILTER (priority IS NOT NULL AND year IS NOT NULL AND price IS NOT NULL) AS n FROM li GROUP BY 1)
  SELECT 'numeric' AS part, 'count' AS name, count(price)::VARCHAR AS value FROM li UNION ALL SELECT 'numeric', 'missing', (count(*) - count(price))::VARCHAR FROM li
  UNION ALL SELECT 'categorical', 'priority ' || count(priority) || ' ' || (count(*) - count(priority)), '' FROM li
  UNION ALL SELECT 'counts_unique_values', year, count(*)::VARCHAR FROM li GROUP BY year HAVING min(5) <= 5
  UNION ALL SELECT 'num_complete_rows_per_node', (row_number() OVER (ORDER BY station) - 1)::VARCHAR, n::VARCHAR FROM c
  UNION ALL SELECT 'quartiles', count(*)::VARCHAR, '' FROM c""")
def summary_json(spark, sf_dir):
    """The whole summary as JSON texts, read back."""
    f = orders(spark, sf_dir)
    got = {k: json.loads(v) for k, v in su.summary(f, ["priority", "year", "price"], policy=Policy(min_rows=1, privacy_threshold=1)).to_json().items()}
    price, priority = got["numeric"]["price"], got["categorical"]["priority"]
    rows = [("numeric", k, str(price[k])) for k in ("count", "missing")] + [("categorical", f"priority {priority['count']} {priority['missing']}", "")]
    rows += [("counts_unique_values", k, str(n)) for k, n in got["counts_unique_values"]["year"].items()]
    rows += [("num_complete_rows_per_node", str(i), str(n)) for i, n in enumerate(got["num_complete_rows_per_node"])] + [("quartiles", str(len(price["median"])), "")]
    return spark.createDataFrame(rows, "part string, name string, value string")


@query("""SELECT l.quality::VARCHAR AS "group", l.toxic::VARCHAR AS outcome, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL""")
def fisher_table_json(spark, sf_dir):
    """The table in split form, read back; pairs that never occur left out, as in SQL."""
    groups, outcomes, data = fi.table_from_json(fi.fisher(judged(spark, sf_dir), "quality", "toxic").table_json())
    return spark.createDataFrame([(str(g), str(o), n) for g, line in zip(groups, data, strict=True) for o, n in zip(outcomes, line, strict=True) if n], "group string, outcome string, n bigint")


@query("""SELECT unnest(range(4)) AS place, unnest(['discount', 'extendedprice', 'quantity', 'tax']) AS "column" """)
def ttest_json_order(spark, sf_dir):
    """Columns of the JSON result, in ascending order."""
    found = json.loads(tt.to_json(tt.ttest(lineitem(spark, sf_dir), NUMBERS)))
    return spark.createDataFrame(list(enumerate(found)), "place bigint, column string")


# ---------------------------------------------------------------- sites and sources


@query("""SELECT CASE WHEN n_regionkey < 2 THEN 'near' ELSE 'far' END AS station, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation WHERE n_regionkey != 4 GROUP BY 1""")
def sites_together(spark, sf_dir):
    """Tables of three sites as one frame, of which two are used."""
    n = table(spark, sf_dir, "nation")
    f = SiteFrame.from_sites({"near": n.where("n_regionkey < 2"), "far": n.where("n_regionkey IN (2, 3)"), "out": n.where("n_regionkey = 4")}).include(["near", "far"])
    return f.df.groupBy("station").agg(F.count("*").alias("n"), F.sum("n_nationkey").cast("long").alias("keys"))


@contextmanager
def scratch(spark):
    """A folder of the shared place, for the length of a query that reads its own files."""
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()).rstrip('/')}/sitefold-files-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def kept(df: DataFrame) -> DataFrame:
    """A few rows, apart from the files they come from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@query("""SELECT 'r' || n_regionkey AS station, n_nationkey, n_name FROM nation WHERE n_regionkey < 2""")
def csv_sites(spark, sf_dir):
    """A CSV file for each site, read as one frame."""
    n = table(spark, sf_dir, "nation")
    with scratch(spark) as d:
        for i in (0, 1):
            n.where(F.col("n_regionkey") == i).select("n_nationkey", "n_name").coalesce(1).write.option("header", True).csv(f"{d}/{i}")
        return kept(so.read_sites(spark, {f"r{i}": f"{d}/{i}" for i in (0, 1)}, schema="n_nationkey int, n_name string").df.select("station", "n_nationkey", "n_name"))


@query("""SELECT 'there' AS name, count(*) AS cpg_sites, 64::BIGINT AS samples, true AS "exists" FROM embeddings WHERE vec_id < 30 UNION ALL SELECT 'absent', 0, 0, false""")
def matrix_files(spark, sf_dir):
    """Rows and samples of matrices of betas; one that can't be read is an empty frame."""
    with scratch(spark) as d:
        wide_betas(spark, sf_dir).where(F.substring("probe_id", 3, 9).cast("int") < 30).coalesce(1).write.option("header", True).csv(f"{d}/m")
        info = so.matrix_info(spark, {"there": f"{d}/m", "absent": f"{d}/none"})
    return spark.createDataFrame([(k, v["cpg_sites"], v["samples"], v["exists"]) for k, v in info.items()], "name string, cpg_sites bigint, samples bigint, exists boolean")


def derby_jar(spark, df: DataFrame, name: str, folder: str) -> str:
    """Address of a read-only database in folder that holds df as a table, which driver and executors can open at once.

    Derby lets one process open a database, or any number if it lies in a jar: executors write the rows as CSV, the
    driver's Derby imports those files into a database of its own, and that goes into a jar. Derby opens no other
    file systems than mounted ones, so folder must be on one.
    """
    jvm, sql = spark.sparkContext._jvm, {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "CLOB"}
    df.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}")
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = [f.getPath() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    derby, none = jvm.org.apache.derby.jdbc.EmbeddedDriver(), jvm.java.util.Properties()
    with tempfile.TemporaryDirectory() as d:
        c = derby.connect(f"jdbc:derby:{d}/db;create=true", none)
        c.createStatement().execute(f"CREATE TABLE {name} ({', '.join(f'{k} {sql[t]}' for k, t in df.dtypes)})")
        for i, f in enumerate(f for f in files if f.getName().endswith(".csv")):
            f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyToLocalFile(f, jvm.org.apache.hadoop.fs.Path(f"file://{d}/{i}.csv"))
            load = c.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, ?, ?, null, null, 'UTF-8', 0)")
            load.setString(1, name.upper())
            load.setString(2, f"{d}/{i}.csv")
            load.execute()
        c.close()
        derby_stop(spark, f"jdbc:derby:{d}/db")
        with open(shutil.make_archive(f"{d}/{name}", "zip", d, "db"), "rb") as packed:
            write_file(spark, f"{folder}/{name}.jar", packed.read())
    return f"jdbc:derby:jar:({jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()}/{name}.jar)db"


def derby_stop(spark, url: str) -> None:
    """Closes a database of the driver's Derby, which says so by an error."""
    jvm = spark.sparkContext._jvm
    try:
        jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(f"{url};shutdown=true", jvm.java.util.Properties())
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise


@query("""SELECT r_regionkey, r_name FROM region""")
def jdbc_table(spark, sf_dir):
    """A table read from a database by the executors."""
    with scratch(spark) as d:
        url = derby_jar(spark, table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "region", d)
        try:
            return kept(so.read_jdbc(spark, url, "region", driver="org.apache.derby.jdbc.EmbeddedDriver").toDF("r_regionkey", "r_name"))
        finally:
            derby_stop(spark, url)


def scans(spark, sf_dir, folder: str) -> DataFrame:
    """Writes a scan file per channel of every supplier's first rows, and one of another kind; the probes they hold."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 4").select("s_suppkey").collect()
    probes = table(spark, sf_dir, "part").where("p_partkey <= 200").select("p_partkey", "p_size").orderBy("p_partkey").collect()
    address, size = np.array([r["p_partkey"] for r in probes]), np.array([r["p_size"] for r in probes])
    for r in s:
        k = r["s_suppkey"]
        for channel, end in (("Grn", "_Grn.idat"), ("Red", "_Red.IDAT")):
            mean = size * (100 + 7 * k) + (5 if channel == "Red" else 0) + address
            write_file(spark, f"{folder}/chips/{200000 + k}_R01C0{k}{end}", idat.write_idat(address, mean, size, size % 6))
    write_file(spark, f"{folder}/chips/notes.txt", b"no scan")
    write_file(spark, f"{folder}/chips/200001_R01C01_Grn.idat.gz", b"packed")
    return table(spark, sf_dir, "part").where("p_partkey <= 200")


def write_file(spark, path: str, raw: bytes) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(raw))
    out.close()


SCANNED = """SELECT (200000 + s_suppkey) || '_R01C0' || s_suppkey AS sample_label, c.channel, p_partkey::BIGINT AS address, (p_size * (100 + 7 * s_suppkey) + CASE WHEN c.channel = 'Red' THEN 5 ELSE 0 END + p_partkey)::INT AS mean,
  p_size::INT AS sd, (p_size % 6)::INT AS n_beads FROM supplier, part, (VALUES ('Grn'), ('Red')) c(channel) WHERE s_suppkey <= 4 AND p_partkey <= 200"""


@query(f"""SELECT DISTINCT sample_label, 'asked' AS place FROM ({SCANNED}) UNION ALL SELECT DISTINCT sample_label, 'fallback' FROM ({SCANNED}) UNION ALL SELECT 'none', 'folder without scans'""")
def scan_manifest(spark, sf_dir):
    """Samples of a folder; of the fallback where it is missing; none of a folder that holds no scans."""
    with scratch(spark) as d:
        scans(spark, sf_dir, d)
        write_file(spark, f"{d}/bare/x.txt", b"")
        asked = idat.sample_manifest(spark, f"{d}/chips").select("sample_label", F.lit("asked").alias("place"))
        other = idat.sample_manifest(spark, None, f"{d}/missing", f"{d}/chips/200001_R01C01_Grn.idat").select("sample_label", F.lit("fallback").alias("place"))
        bare = idat.sample_manifest(spark, f"{d}/bare", fallback=f"{d}/chips").isEmpty()
        return kept(asked.unionByName(other).unionByName(spark.createDataFrame([("none" if bare else "some", "folder without scans")], "sample_label string, place string")))


@query(f"""SELECT * FROM ({SCANNED}) WHERE n_beads >= 3""")
def scan_contents(spark, sf_dir):
    """Intensities of probes with three beads or more."""
    with scratch(spark) as d:
        scans(spark, sf_dir, d)
        return kept(idat.read_idat(spark, d, min_beads=3))


@query(f"""WITH s AS ({SCANNED}), g AS (SELECT *, CASE WHEN address % 2 = 0 THEN 'Grn' ELSE 'Red' END AS own FROM s)
  SELECT sample_label, channel, count(*) AS n, sum(mean)::DOUBLE AS total FROM g WHERE channel != own GROUP BY ALL""")
def out_of_band_background(spark, sf_dir):
    """What probes of one channel show in the other."""
    with scratch(spark) as d:
        p = scans(spark, sf_dir, d)
        manifest = p.select(F.col("p_partkey").cast("long").alias("address"), F.when(F.col("p_partkey") % 2 == 0, "Grn").otherwise("Red").alias("channel"))
        b = me.out_of_band(idat.read_idat(spark, d, 0), manifest)
        return kept(b.groupBy("sample_label", "channel").agg(F.count("*").alias("n"), F.sum("intensity").alias("total")))


@query(f"""WITH s AS ({SCANNED}), o AS (SELECT *, address % 2 = 0 AS green FROM s WHERE n_beads >= 1),
  b AS (SELECT sample_label, channel, mean FROM o WHERE green != (channel = 'Grn')),
  f AS (SELECT * FROM o WHERE green = (channel = 'Grn')),
  p AS (SELECT f.sample_label, f.address // 4 AS probe, min((SELECT avg(CASE WHEN b.mean >= f.mean THEN 1 ELSE 0 END) FROM b WHERE b.sample_label = f.sample_label AND b.channel = f.channel)) AS p FROM f GROUP BY ALL),
  a AS (SELECT sample_label, address // 4 AS probe, count(DISTINCT (address // 2) % 2) AS alleles FROM f GROUP BY ALL)
  SELECT sample_label, 'cg' || probe AS probe_id, true AS "inside", true AS same FROM p JOIN a USING (sample_label, probe) WHERE p <= 0.5 AND alleles = 2""")
def folder_to_betas(spark, sf_dir):
    """From a folder of scans to betas: which probes are detected, that betas lie between 0 and 1, and that M values are theirs."""
    with scratch(spark) as d:
        p = scans(spark, sf_dir, d)
        k = F.col("p_partkey")
        manifest = p.select(k.cast("long").alias("address"), F.when(k % 2 == 0, "Grn").otherwise("Red").alias("channel"), F.concat(F.lit("cg"), F.floor(k / 4)).alias("probe_id"), F.when(F.floor(k / 2) % 2 == 0, "meth").otherwise("unmeth").alias("allele"))
        listed = spark.createDataFrame([(f"{d}/chips",)], "idat_dir string")
        b = me.preprocess_folder(spark, manifest, samples=listed, threshold=0.5)
        same = F.abs(F.col("m_value") - F.log2(F.col("beta") / (1 - F.col("beta")))) < 1e-9
        return kept(b.select("sample_label", "probe_id", ((F.col("beta") > 0) & (F.col("beta") < 1)).alias("inside"), same.alias("same")))


@query("""SELECT 'cg' || vec_id AS probe_id, 'S' || (i - 1) AS sample_label, round(embedding[i]::DOUBLE, 6) + 0 AS beta FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def annotated_to_long(spark, sf_dir):
    """Columns that describe probes are no samples."""
    w = wide_betas(spark, sf_dir).withColumns({"type": F.lit("I"), "channel": F.lit("Grn"), "probe_type": F.lit("cg")})
    return rounded(me.wide_to_long(w))


@query("""SELECT 'cg' || p_partkey AS probe_id, 's' || (p_size % 4) AS sample_label FROM part WHERE p_retailprice > 0 AND p_size % 3 != 0 AND p_partkey % 5 != 0""")
def betas_without_gaps(spark, sf_dir):
    """Probes without an intensity, or masked, have no beta in the output."""
    p = table(spark, sf_dir, "part")
    raw = p.select(F.concat(F.lit("cg"), "p_partkey").alias("probe_id"), F.concat(F.lit("s"), F.col("p_size") % 4).alias("sample_label"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("meth"), (F.col("p_size") * 10.0).alias("unmeth"))
    notes = p.select(F.concat(F.lit("cg"), "p_partkey").alias("probe_id"), (F.col("p_partkey") % 5 == 0).alias("quality"))
    return me.mask_probes(me.intensities_to_betas(raw).where("beta IS NOT NULL"), notes).select("probe_id", "sample_label")


@query("""WITH e AS (SELECT event_type AS sample_label, CASE WHEN event_id % 2 = 0 THEN 'Grn' ELSE 'Red' END AS channel, event_id AS probe_id, value + event_id * 1e-7::DOUBLE AS intensity FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample_label, channel ORDER BY intensity) AS i, count(*) OVER (PARTITION BY sample_label, channel) AS n FROM e),
  k AS (SELECT sample_label, min(n) AS n FROM r GROUP BY 1), t AS (SELECT r.* FROM r JOIN k USING (sample_label) WHERE r.i <= k.n)
  SELECT sample_label, channel, probe_id, round(avg(intensity) OVER (PARTITION BY sample_label, i), 5) AS intensity FROM t""")
def dye_bias(spark, sf_dir):
    """As many probes of each channel, all of different intensities: each rank gets the mean of both channels."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample_label"), F.when(F.col("event_id") % 2 == 0, "Grn").otherwise("Red").alias("channel"), F.col("event_id").alias("probe_id"), (F.col("value") + F.col("event_id") * 1e-7).alias("intensity"))
    channel = Window.partitionBy("sample_label", "channel")
    ranked = e.withColumn("i", F.row_number().over(channel.orderBy("intensity")))
    least = ranked.groupBy("sample_label", "channel").agg(F.count("*").alias("n")).groupBy("sample_label").agg(F.min("n").alias("n"))
    even = ranked.join(least, "sample_label").where("i <= n").drop("i", "n")
    return rounded(me.correct_dye_bias(even), 5)


# ---------------------------------------------------------------- ages of persons, and ages that are missing


@query(f"WITH {CLOCK_SQL} SELECT station, clock, row_number() OVER (PARTITION BY station, clock ORDER BY sample_label) - 1 AS place, round(age, 6) + 0 AS age FROM ages")
def individual_ages(spark, sf_dir):
    """Every sample's age, in the order of samples; only on request."""
    a = ages(spark, sf_dir)
    if outcome(lambda: ck.individual_ages(a)) != "BadInput":
        raise AssertionError("ages of persons are given unasked")
    return rounded(ck.individual_ages(a, True).select("station", "clock", F.posexplode("ages").alias("place", "age")).withColumn("place", F.col("place").cast("long")))


@query(f"""WITH {CLOCK_SQL} SELECT station, clock, count(age) AS n, round(avg(age), 6) + 0 AS mean, round(stddev_pop(age), 6) AS std, round(min(age), 6) + 0 AS "min", round(max(age), 6) + 0 AS "max"
  FROM (SELECT station, clock, CASE WHEN n_missing = 0 THEN age END AS age FROM ages) GROUP BY ALL""")
def clock_missing_ages(spark, sf_dir):
    """Samples that lack a probe of a clock have no age, and no part in its statistics."""
    coefs = spark.createDataFrame(COEFS, "clock string, probe_id string, coef double")
    a = ck.clock_ages(SiteFrame(betas(spark, sf_dir)), coefs, spark.createDataFrame(CLOCKS, "clock string, intercept double, link string"), missing="null")
    return rounded(ck.clock_station_stats(a))


@query(f"""WITH {CLOCK_SQL}, t AS (SELECT 'Organization ' || station AS organization, clock, mean FROM st UNION ALL SELECT 'Global (Weighted)', clock, sum(mean * n) / sum(n) FROM st GROUP BY clock)
  SELECT row_number() OVER (ORDER BY organization = 'Global (Weighted)', organization) - 1 AS line, organization, {", ".join(f"round(max(mean) FILTER (clock = '{c}'), 2) + 0 AS {c}" for c, _, _ in CLOCKS)} FROM t GROUP BY organization""")
def clock_text(spark, sf_dir):
    """The table of means as plain text, read back line by line."""
    names = [c for c, _, _ in CLOCKS]
    text = ck.format_means_table(ck.clock_means_table(ck.clock_station_stats(ages(spark, sf_dir)), names))
    rows = []
    for line in text.splitlines():
        if line.startswith((ck.SITE, ck.GLOBAL)):
            name, *numbers = line.rsplit(maxsplit=len(names))
            rows.append((len(rows), name.strip(), *map(float, numbers)))
    return rounded(spark.createDataFrame(rows, "line bigint, organization string, " + ", ".join(f"{c} double" for c in names)), 2)

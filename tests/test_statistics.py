import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold import BadInput, ColumnNotAllowed, Policy, PolicyViolation, SiteFrame
from sitefold.operators import anova as av
from sitefold.operators import fisher as fi
from sitefold.operators import moments as mo
from sitefold.operators import pca as pc
from sitefold.operators import summary as su
from sitefold.operators import ttest as tt

ROWS = [("a", "x", 1.0, 4, True), ("a", "y", 2.0, 5, False), ("a", "x", None, 6, True), ("a", "y", 4.0, 7, None), ("a", "x", float("nan"), 8, True), ("a", "x", 7.5, None, True)]
ROWS += [("b", "x", 10.0, 1, True), ("b", "y", 20.0, 2, False), ("b", None, 30.0, 3, True), ("b", "y", 45.0, 3, True), ("b", "x", 46.0, 9, True)]
SCHEMA = "station string, grp string, v double, n int, flag boolean"


@pytest.fixture(scope="module")
def frame(spark):
    return SiteFrame(spark.createDataFrame(ROWS, SCHEMA))


def values(station=None, group=None):
    return np.array([r[2] for r in ROWS if r[2] is not None and not math.isnan(r[2]) and station in (None, r[0]) and group in (None, r[1])])


def test_numeric_summary(frame):
    r = {x["column"]: x for x in su.numeric_summary(frame, ["v", "n"]).collect()}["v"]
    v = values()
    assert (r["count"], r["missing"], r["min"], r["max"]) == (len(v), 2, v.min(), v.max())
    assert r["sum"] == pytest.approx(v.sum()) and r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(ddof=1))


def test_quartiles_interpolate(spark):
    f = SiteFrame(spark.createDataFrame([("s", float(x)) for x in (1, 2, 4, 10)], "station string, v double"))
    r = su.quartiles(f, ["v"]).first()
    assert (r["q25"], r["median"], r["q75"], r["iqr"]) == (1.75, 3.0, 5.5, 3.75)


def test_value_counts_mask_whole_column(spark):
    rows = [("a", "p")] * 5 + [("a", "q")] * 4 + [("b", "p")] * 6 + [("b", None)]
    f = SiteFrame(spark.createDataFrame(rows, "station string, c string"))
    assert {(r["station"], r["value"]): r["n"] for r in su.value_counts_masked(f, ["c"]).collect()} == {("b", "p"): 6}
    r = su.value_counts(f, ["c"]).collect()
    assert [(x["value"], x["n"], x["n_masked_stations"]) for x in r] == [("p", 6, 1)]
    assert su.value_counts_masked(f, ["c"], Policy(hidden=frozenset({"counts_unique_values"}))).count() == 0


@pytest.mark.parametrize(("rows", "ok"), [(4, False), (5, True), (6, True)])
def test_minimum_rows(spark, rows, ok):
    f = SiteFrame(spark.createDataFrame([("a", 1.0)] * rows + [("b", 1.0)] * 9, "station string, v double"))
    if ok:
        mo.check_privacy(f, ["v"], Policy())
    else:
        with pytest.raises(PolicyViolation):
            mo.check_privacy(f, ["v"], Policy())


def test_minimum_values_and_column_lists(spark):
    f = SiteFrame(spark.createDataFrame([("a", 1.0)] * 4 + [("a", None)] * 3, "station string, v double"))
    with pytest.raises(PolicyViolation):
        mo.check_privacy(f, ["v"], Policy())
    with pytest.raises(ColumnNotAllowed):
        mo.check_columns(["v"], Policy(allowed_columns=("w",)))
    with pytest.raises(ColumnNotAllowed):
        mo.check_columns(["v"], Policy(allowed_columns=("v",), disallowed_columns=("v",)))


def test_policy_from_env():
    p = Policy.from_env({"SUMMARY_MINIMUM_ROWS": "7", "SUMMARY_ALLOWED_COLUMNS": "a, b", "SUMMARY_ALLOW_MIN": "false"})
    assert (p.min_rows, p.allowed_columns, p.shows("min"), p.shows("max")) == (7, ("a", " b"), False, True)
    with pytest.raises(ValueError):
        Policy.from_env({"SUMMARY_MINIMUM_ROWS": "many"})


def test_summary_and_hidden_metrics(frame):
    policy = Policy(min_rows=1, privacy_threshold=1, hidden=frozenset({"sum", "variance", "num_complete_rows"}))
    s = su.summary(frame, ["v", "n", "grp"], policy=policy)
    d = s.to_dict()
    assert d["numeric"]["v"]["sum"] is None and d["numeric"]["v"]["mean"] is None and d["numeric"]["v"]["std"] is None and d["numeric"]["v"]["count"] == 9
    assert d["num_complete_rows_per_node"] == [None, None]
    assert d["counts_unique_values"]["grp"] == {"x": 6, "y": 4}
    assert set(s.to_json()) == {"numeric", "categorical", "counts_unique_values", "num_complete_rows_per_node"}


def test_summary_numeric_choice(spark):
    f = SiteFrame(spark.createDataFrame([("a", "1", 2), ("a", "3", 4)], "station string, t string, n int"))
    d = su.summary(f, numeric=["t"], policy=Policy(min_rows=1, privacy_threshold=1)).to_dict()
    assert d["numeric"]["t"]["sum"] == 4 and d["categorical"]["n"] == {"count": 2, "missing": 0}
    with pytest.raises(BadInput):
        su.split_columns(f, ["t"], ["n"])
    with pytest.raises(BadInput, match="t"):
        su.cast_numeric(SiteFrame(spark.createDataFrame([("a", "1x")], "station string, t string")), ["t"])


def test_ssd_and_complete_rows(frame):
    r = {(x["station"], x["column"]): x["ssd"] for x in su.ssd_about(frame, {"v": 10.0}).collect()}
    assert r[("a", "v")] == pytest.approx(((values("a") - 10) ** 2).sum())
    assert {x["station"]: x["complete_rows"] for x in su.complete_rows(frame).collect()} == {"a": 2, "b": 4}


def test_merge_is_that_of_the_union(spark):
    rnd = random.Random(5)
    data = [1e9 + rnd.gauss(0, 3) for _ in range(200)]
    for parts in (1, 2, 7):
        rows = [(str(rnd.randrange(parts)), x) for x in data]
        m = mo.merge_moments(mo.station_moments(SiteFrame(spark.createDataFrame(rows, "station string, v double")), ["v"]), ["column"]).first()
        assert m["mean"] == pytest.approx(np.mean(data)) and m["var"] == pytest.approx(np.var(data, ddof=1), rel=1e-6)


def pooled(a, b):
    s = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    return (a.mean() - b.mean()) / math.sqrt(s * (1 / len(a) + 1 / len(b)))


def test_ttest_modes(frame):
    r = tt.to_dict(tt.ttest(frame, ["v"], "grp"))["v"]
    assert r["t_score"] == pytest.approx(pooled(values(group="x"), values(group="y")))
    r = tt.to_dict(tt.ttest(frame, ["v"]))["v"]
    assert r["t_score"] == pytest.approx(pooled(values("a"), values("b")))
    r = tt.to_dict(tt.ttest(frame, ["v"], stations=["b", "a"]))["v"]
    assert r["t_score"] == pytest.approx(pooled(values("b"), values("a")))
    assert set(tt.to_dict(tt.ttest(frame, None, "grp"))) == {"v", "n"}


def test_ttest_as_written(frame):
    r = tt.ttest(frame, ["v"], "grp", compat="as_written").first()

    def side(g):
        cells = []
        for s in "ab":
            x, whole = values(s, g), values(s)
            cells.append((len(x), x.mean(), ((whole - x.mean()) ** 2).sum() / (len(x) - 1)))
        n = sum(c[0] for c in cells)
        mean = sum(c[0] * c[1] for c in cells) / n
        return n, mean, sum((c[0] - 1) * c[2] + c[0] * (c[1] - mean) ** 2 for c in cells) / (n - 1)

    assert (r["n_a"], r["mean_a"], r["var_a"]) == pytest.approx(side("x"))


def test_ttest_refusals(spark, frame):
    with pytest.raises(BadInput):
        tt.ttest(frame, ["grp"])
    with pytest.raises(BadInput):
        tt.ttest(SiteFrame(spark.createDataFrame([("a", 1.0)] * 3 + [("b", 2.0)] * 4, "station string, v double")), ["v"])
    three = SiteFrame(spark.createDataFrame([("a", x, 1.0) for x in "pqr"] * 3, "station string, g string, v double"))
    with pytest.raises(BadInput):
        tt.ttest(three, ["v"], "g")
    one = SiteFrame(spark.createDataFrame([("a", "p", 1.0), ("a", "p", 2.0), ("a", "q", 3.0), ("a", "q", None)], "station string, g string, v double"))
    assert tt.ttest(one, ["v"], "g").count() == 0  # a single value gives no cell


def test_anova(spark):
    rnd = np.random.default_rng(3)
    rows = [(str(i % 2), "pqr"[i % 3], float(rnd.normal(i % 3)), float(rnd.normal())) for i in range(60)] + [("0", None, 1.0, 1.0), ("0", "p", None, 1.0)]
    f = SiteFrame(spark.createDataFrame(rows, "station string, g string, v double, w double"))
    r = {x["column"]: x for x in av.anova(f, "g").collect()}
    groups = [np.array([x[2] for x in rows if x[1] == g and x[2] is not None]) for g in "pqr"]
    n, center = 60, np.concatenate(groups).mean()
    between, within = sum(len(x) * (x.mean() - center) ** 2 for x in groups), sum(((x - x.mean()) ** 2).sum() for x in groups)
    assert r["v"]["n"] == n and r["v"]["f_statistic"] == pytest.approx(between / 2 / (within / (n - 3)))
    c = av.anova(f, "g", combine_features=True).first()
    assert c["ss_within"] == pytest.approx(r["v"]["ss_within"] + r["w"]["ss_within"])
    with pytest.raises(BadInput):
        av.anova(f, "g", [])


def test_fisher(spark):
    rows = [("a", "F", 0)] * 4 + [("a", "F", 1)] * 3 + [("a", "M", 0)] * 5 + [("a", "M", 1)] * 6
    rows += [("b", "F", 0)] * 4 + [("b", "F", 1)] * 10 + [("b", "M", 0)] * 14 + [("b", "M", 1)] * 8 + [("c", "M", 0)] * 9 + [("c", "M", 1)] * 9
    f = SiteFrame(spark.createDataFrame(rows, "station string, g string, o int"))
    r = fi.fisher(f, "g", "o")
    assert r.contingency_table == [[8, 13], [28, 23]] and r.group_values == ["F", "M"] and r.p_value == pytest.approx(0.299711815, abs=1e-9)
    cells = {(x["station"], x["group"], x["outcome"]): x["n"] for x in fi.contingency_station(f, "g", "o").collect()}
    assert len(cells) == 12 and cells[("c", "F", 0)] == 0
    with pytest.raises(BadInput):
        fi.fisher(f, "g", "g")
    with pytest.raises(BadInput):
        fi.fisher(SiteFrame(f.df.where("g = 'M'")), "g", "o")
    with pytest.raises(BadInput):
        fi.fisher(SiteFrame(f.df.union(f.df.where("station = 'a'").limit(3).withColumn("station", F.lit("d")))), "g", "o")


def test_pca(spark):
    x = np.random.default_rng(1).normal(size=(50, 4)) @ np.diag([4, 2, 1, 0.5]) + 100
    rows = [(str(i % 3), *map(float, r)) for i, r in enumerate(x)] + [("0", None, None, 1.0, 1.0)]
    f = SiteFrame(spark.createDataFrame(rows, "station string, `a(1)` double, b double, c double, d double"))
    r = pc.pca(f)
    assert np.allclose(r.covariance, np.cov(x.T)) and r.n_total == 50 and np.allclose(r.components.T @ r.components, np.eye(4))
    assert np.allclose(r.components @ np.diag(r.explained_variance) @ r.components.T, r.covariance)
    assert pc.pca(f, n_components=9).components.shape == (4, 4) and pc.pca(f, n_components=0).components.shape == (4, 1)
    assert pc.pca(f, ["b"]).covariance[0, 0] == pytest.approx(x[:, 1].var(ddof=1)) and pc.pca(f, ["b"], compat="as_written").covariance[0, 0] == 0
    assert np.allclose(pc.pca(f, center=False).covariance, x.T @ x / 49)
    cov = {(c["row"], c["col"]): c["value"] for c in pc.covariance(f).collect()}
    assert cov[("a(1)", "c")] == pytest.approx(r.covariance[0, 2])


def test_grams_of_many_features(spark):
    x = np.random.default_rng(2).normal(size=(40, 33))
    rows = [(None if i % 4 == 3 else i % 4, *map(float, r)) for i, r in enumerate(x)]
    f = SiteFrame(spark.createDataFrame(rows, "station int, " + ", ".join(f"x{i} double" for i in range(33))))
    assert np.allclose(pc.pca(f).covariance, np.cov(x.T))
    v = spark.createDataFrame([(i % 2, list(map(float, r))) for i, r in enumerate(x)] + [(0, None), (0, [1.0])], "station int, e array<float>")
    n, sums, _ = pc.merge_grams(pc.gram_of_vectors(v, "station", "e", 33), 33)
    assert n == 40 and np.allclose(sums, x.sum(0), atol=1e-4)


def test_frames(spark):
    one = spark.createDataFrame([(1, 2.0)], "a int, b double")
    f = SiteFrame.from_sites({"p": one, "q": one})
    assert f.df.count() == 2 and f.include(["p"]).df.count() == 1 and f.include([]).df.count() == 2 and f.columns == ["a", "b"]
    with pytest.raises(BadInput):
        SiteFrame.from_sites({"p": one, "q": one.drop("b")})
    with pytest.raises(BadInput):
        SiteFrame.from_sites({})
    with pytest.raises(BadInput):
        f.require(["c"])
    with pytest.raises(BadInput):
        SiteFrame(one)


def test_exact_quartiles_by_narrowing(spark, monkeypatch):
    from sitefold.operators import quantiles as qu

    monkeypatch.setattr(qu, "DIRECT", 4)
    monkeypatch.setattr(qu, "INSIDE", 3)
    rng = random.Random(5)
    rows = [("a", rng.lognormvariate(0, 9), float(rng.randrange(3)), None) for _ in range(3000)]
    rows += [(None, rng.choice([-math.inf, 0.0, 1.0, math.inf, math.nan]), float(i), 7.0) for i in range(500)]
    rows += [("one", 2.5, None, math.nan), ("b", -1.0, -2.0, 1.0), ("b", None, 4.0, 2.0)]
    f = SiteFrame(spark.createDataFrame(rows, "station string, x double, y double, z double"))

    def brute(values):
        v = sorted(v for v in values if v is not None and not math.isnan(v))
        out = []
        for q in (0.25, 0.5, 0.75):
            place = q * (len(v) - 1)
            lo, hi = (v[math.floor(place)], v[math.ceil(place)]) if v else (None, None)
            out.append(lo if lo == hi else (1 - place % 1) * lo + place % 1 * hi)
        return out

    for per_station in (True, False):
        seen = su.quartiles(f, ["x", "y", "z"], per_station=per_station).collect()
        assert len(seen) == (12 if per_station else 3)
        for r in seen:
            want = brute([x["xyz".index(r["column"]) + 1] for x in rows if not per_station or x[0] == r["station"]])
            got = [r["q25"], r["median"], r["q75"]]
            assert all(g is None if w is None else g == pytest.approx(w, rel=1e-12) for g, w in zip(got, want, strict=True)), (r, want)


def test_intervals_that_miss_their_rank_are_widened():
    from sitefold.operators.quantiles import _Rank

    r = _Rank(50, low=3.0, high=9.0, outer=(None, 20.0))
    r.seen(60, 61, 5, 70, None, 10)
    assert (r.low, r.high, r.slack, r.found, r.ready) == (None, 20.0, 4, None, False)
    r.seen(0, 0, 55, 80, None, 10_000)
    assert r.ready and r.skip == 50


def test_summary_takes_one_aggregate_for_its_rules_and_parts(frame):
    s = su.summary(frame, ["v", "n", "grp"], policy=Policy(min_rows=1, privacy_threshold=1))
    assert "ExistingRDD" in s.numeric._jdf.queryExecution().executedPlan().toString()
    for a, b in ((s.numeric, su.numeric_summary(frame, ["v", "n"])), (s.categorical, su.categorical_summary(frame, ["grp"])), (s.complete_rows, su.complete_rows(frame, ["v", "n", "grp"]))):
        one, two = ({tuple(r): None for r in df.orderBy(df.columns[0]).collect()} for df in (a, b))
        assert list(one) == list(two)
    with pytest.raises(PolicyViolation):
        su.summary(frame, ["v"], policy=Policy(min_rows=6))

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold import BadInput, SiteFrame
from sitefold.operators import clocks as ck
from sitefold.operators import methylation as me

LONG = "station string, probe_id string, sample_label string, beta double, m_value double"


@pytest.fixture(scope="module")
def long(spark):
    rows = [("A", "cg1", " s1", 0.2, -2.0), ("A", "cg1", "s2", 0.4, -0.5), ("A", "cg2", " s1", 0.9, 3.0), ("A", None, " s1", 0.5, 0.0), ("B", "cg1", "s9", 0.6, None), ("B", "cg3", "s9", float("nan"), 1.0)]
    return SiteFrame(spark.createDataFrame(rows, LONG))


def test_probe_means(long):
    s = {(r["station"], r["probe_id"]): r for r in me.probe_means_station(long).collect()}
    assert s[("A", "cg1")]["beta_mean"] == pytest.approx(0.3) and s[("A", "cg2")]["n_samples"] == 2 and s[("A", "cg2")]["n_values"] == 1
    assert len(s) == 4 and s[("B", "cg3")]["beta_mean"] is None
    g = {r["probe_id"]: r for r in me.probe_means_global(me.probe_means_station(long)).collect()}
    assert g["cg1"]["beta_mean_global"] == pytest.approx((0.3 * 2 + 0.6) / 3) and g["cg1"]["n_samples_total"] == 3
    p = {r["probe_id"]: r for r in me.probe_means_global(me.probe_means_station(long), "per_probe").collect()}
    assert p["cg2"]["n_samples_total"] == 1
    with pytest.raises(BadInput):
        me.probe_means_station(SiteFrame(long.df.drop("beta")))


def test_reshape_and_join(spark):
    wide = spark.createDataFrame([("cg1", "I", 0.1, 0.2), ("cg2", "II", 0.3, None)], "id string, type string, s1 double, `s(2)` double")
    long = me.wide_to_long(wide)
    assert long.columns == ["probe_id", "sample_label", "beta"] and long.count() == 4
    back = {r["probe_id"]: (r["s1"], r["s(2)"]) for r in me.long_to_wide(long).collect()}
    assert back == {"cg1": (0.1, 0.2), "cg2": (0.3, None)}
    m = me.with_m_values(long)
    joined = me.join_beta_m(long, m.drop("beta"))
    assert joined.count() == 4 and joined.where("probe_id = 'cg1' AND sample_label = 's1'").first()["m_value"] == pytest.approx(math.log2(0.1 / 0.9))
    for betas, ms in ((long.union(long), m.drop("beta")), (long, m.drop("beta").union(m.drop("beta")))):
        with pytest.raises(Exception, match="repeated"):
            me.join_beta_m(betas, ms).collect()
    with pytest.raises(BadInput):
        me.wide_to_long(spark.createDataFrame([("cg1",)], "id string"))


def test_masks_and_betas(spark):
    raw = spark.createDataFrame([("cg1", "s", 300.0, 100.0), ("cg2", "s", -5.0, 0.0), ("cg3", "s", 900.0, 0.0)], "probe_id string, sample_label string, meth double, unmeth double")
    b = {r["probe_id"]: r["beta"] for r in me.intensities_to_betas(raw).collect()}
    assert b == {"cg1": 0.6, "cg2": 0.0, "cg3": 0.9}
    notes = spark.createDataFrame([("cg1", True, None), ("cg3", False, True), ("cg3", False, True)], "probe_id string, quality boolean, snp boolean")
    assert [r["probe_id"] for r in me.mask_probes(raw, notes).collect()] == ["cg2"]
    assert me.mask_probes(raw, notes, ["quality"]).count() == 2


def test_detection_is_the_tail_of_the_background(spark):
    signals = spark.createDataFrame([("s", "Grn", f"p{i}", float(x)) for i, x in enumerate((0, 5, 9.5, 20))] + [("s", "Grn", "pn", None)], "sample_label string, channel string, probe_id string, intensity double")
    background = spark.createDataFrame([("s", "Grn", float(x)) for x in range(10)], "sample_label string, channel string, intensity double")
    p = {r["probe_id"]: r["p_value"] for r in me.detection_p_values(signals, background).collect()}
    assert [p[f"p{i}"] for i in range(4)] == pytest.approx([1, 0.5, 0, 0]) and p["pn"] is None
    seen = me.mask_undetected(me.detection_p_values(signals, background))
    assert {r["probe_id"] for r in seen.collect()} == {"p2", "p3"}


def test_signal_correction():
    x = me.normal_exponential(np.array([100.0, 500.0, 5000.0]), 200.0, 50.0, 1000.0)
    assert (np.diff(x) > 0).all() and (x > 0).all() and x[2] == pytest.approx(5000 - 200 - 2.5, abs=1)
    far = me.normal_exponential(np.array([-10_000.0]), 200.0, 50.0, 1000.0)
    assert 0 < far[0] < 1


def test_preprocess_end_to_end(spark):
    rnd = np.random.default_rng(4)
    rows = [("s1", f"cg{i}", c, a, float(x)) for i in range(40) for c, a, x in (("Grn", "meth", 4000 + 50 * i), ("Red", "unmeth", 3000 + 40 * (40 - i)))]
    rows += [("s1", "cgdim", "Grn", "meth", 1.0), ("s1", "cgdim", "Red", "unmeth", 1.0)]
    signals = spark.createDataFrame(rows, "sample_label string, probe_id string, channel string, allele string, intensity double")
    background = spark.createDataFrame([("s1", c, float(x)) for c in ("Grn", "Red") for x in rnd.normal(200, 40, 100)], "sample_label string, channel string, intensity double")
    out = {r["probe_id"]: r["beta"] for r in me.preprocess(signals, background).collect()}
    assert "cgdim" not in out and len(out) == 40 and all(0 < b < 1 for b in out.values()) and out["cg39"] > out["cg0"]
    with pytest.raises(BadInput):
        me.preprocess(signals.drop("allele"), background)


@pytest.fixture(scope="module")
def ages_of(spark):
    f = SiteFrame(spark.createDataFrame([("A", "s1", "c1", 0.5), ("A", "s1", "c2", 0.2), ("A", "s2", "c1", 0.1), ("B", "s3", "c2", 1.0)], "station string, sample_label string, probe_id string, beta double"))
    coefs = spark.createDataFrame([("lin", "c1", 10.0), ("lin", "c2", -5.0), ("bent", "c1", 2.0)], "clock string, probe_id string, coef double")
    clocks = spark.createDataFrame([("lin", 30.0, "identity"), ("bent", -0.5, "horvath")], "clock string, intercept double, link string")
    return lambda **k: {(r["sample_label"], r["clock"]): r for r in ck.clock_ages(f, coefs, clocks, **k).collect()}, lambda **k: ck.clock_ages(f, coefs, clocks, **k)


def test_clock_ages(spark, ages_of):
    rows, _ = ages_of
    a = rows()
    assert a[("s1", "lin")]["age"] == pytest.approx(30 + 5 - 1) and a[("s2", "lin")]["n_missing"] == 1
    assert a[("s1", "bent")]["age"] == pytest.approx(21 * 0.5 + 20) and a[("s3", "bent")]["age"] == pytest.approx(21 * math.exp(-0.5) - 1)
    assert rows(missing="null")[("s2", "lin")]["age"] is None
    table = spark.createDataFrame([("c2", 0.4)], "probe_id string, beta double")
    assert rows(missing=table)[("s2", "lin")]["age"] == pytest.approx(30 + 1 - 2)
    assert rows(names=["lin", "none"])[("s1", "none")]["age"] is None and len(rows(names=["lin"])) == 3
    with pytest.raises(BadInput):
        rows(missing="mean")


def test_clock_statistics(spark, ages_of):
    _, frame = ages_of
    ages = frame()
    stats = ck.clock_station_stats(ages)
    s = {(r["station"], r["clock"]): r for r in stats.collect()}
    assert s[("A", "lin")]["mean"] == pytest.approx(32.5) and s[("A", "lin")]["std"] == pytest.approx(1.5) and s[("B", "lin")]["n"] == 1
    g = {r["clock"]: r for r in ck.clock_global(stats).collect()}
    assert g["lin"]["weighted_mean"] == pytest.approx((34 + 31 + 25) / 3) and g["lin"]["std_pooled"] == pytest.approx(math.sqrt(1.5**2 / 1))
    single = ck.clock_global(stats.where("station = 'B'")).first()
    assert single["std_pooled"] is None
    t = {r["organization"]: r for r in ck.clock_means_table(stats, ["lin", "bent"]).collect()}
    assert t["Organization A"]["lin"] == 32.5 and t["Global (Weighted)"]["lin"] == 30.0
    assert "Global (Weighted)" in ck.format_means_table(ck.clock_means_table(stats, ["lin"]))
    with pytest.raises(BadInput):
        ck.individual_ages(ages)
    d = ck.to_dict(stats, ages)
    assert d["individual_ages"]["A"]["lin"] == pytest.approx([34, 31]) and set(d["organization_breakdown"]["A"]) == {"lin", "bent"}
    empty = ck.clock_station_stats(ages.where(F.lit(False)))
    assert "No data" in ck.format_means_table(ck.clock_means_table(empty, ["lin"]))

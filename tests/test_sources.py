import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold import BadInput
from sitefold.functions.scalar import body_mass_index, m_value, sample_label
from sitefold.plans import catalog
from sitefold.sources import idat, tables


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,Height(in), v\nx, 3,\n y,4,2\n")
    df = tables.read_csv(spark, str(p))
    assert df.columns == ["id", "Height(in)", " v"] and [r["id"] for r in df.collect()] == ["x", " y"]
    assert [r["id"] for r in tables.read_csv(spark, str(p), trim=True).collect()] == ["x", "y"]
    f = tables.read_sites(spark, {"p": str(p), "q": str(p)})
    assert f.df.groupBy("station").count().count() == 2


def test_matrices(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("CpG,s1,s2\ncg1,0.1,0.2\n")
    info = tables.matrix_info(spark, {"one": str(p), "none": str(tmp_path / "no.csv")})
    assert info["one"]["cpg_sites"] == 1 and info["one"]["samples"] == 2 and info["one"]["exists"] and not info["none"]["exists"]


def scan(folder, name, n=4):
    folder.mkdir(parents=True, exist_ok=True)
    i = np.arange(n)
    (folder / name).write_bytes(idat.write_idat(1000 + i, 500 + i, 10 + i, i))


def test_idat_discovery_and_manifest(spark, tmp_path):
    for name in ("6264509100_R01C01_Grn.idat", "6264509100_R01C01_Red.idat", "x.txt", "z_Grn.idat.gz"):
        scan(tmp_path / "d", name)
    scan(tmp_path / "d" / "sub", "6264509100_R01C02_Grn.IDAT")
    assert idat.find_idat_files(spark, str(tmp_path / "d")).count() == 3
    m = idat.sample_manifest(spark, str(tmp_path / "d"))
    assert [r["sample_label"] for r in m.collect()] == ["6264509100_R01C01", "6264509100_R01C02"]
    assert idat.sample_manifest(spark, str(tmp_path / "d" / "6264509100_R01C01_Grn.idat")).count() == 2
    assert idat.sample_manifest(spark, str(tmp_path / "none")).count() == 0
    assert idat.sample_manifest(spark, str(tmp_path / "none"), fallback=str(tmp_path / "d")).count() == 2


def test_idat_contents(spark, tmp_path):
    scan(tmp_path, "a_Grn.idat")
    scan(tmp_path, "a_Red.idat")
    rows = idat.read_idat(spark, str(tmp_path), min_beads=2).orderBy("channel", "address").collect()
    assert [(r["sample_label"], r["channel"], r["address"], r["mean"], r["sd"], r["n_beads"]) for r in rows[:2]] == [("a", "Grn", 1002, 502, 12, 2), ("a", "Grn", 1003, 503, 13, 3)]
    manifest = spark.createDataFrame([(1002, "Grn", "cg1", "meth")], "address long, channel string, probe_id string, allele string")
    assert idat.intensities(idat.read_idat(spark, str(tmp_path)), manifest).first()["intensity"] == 502
    with pytest.raises(BadInput):
        idat.read_idat(spark, str(tmp_path / "none"))
    with pytest.raises(BadInput):
        idat.parse_idat(b"nothing at all here")


def test_scalars(spark):
    df = spark.createDataFrame([(0.25, 77.0, 182.0), (0.0, 1.0, 0.0), (None, 0.0, 0.0)], "b double, w double, h double")
    rows = df.select(m_value(F.col("b")).alias("m"), body_mass_index(F.col("w"), F.col("h")).alias("bmi")).collect()
    assert rows[0]["m"] == pytest.approx(np.log2(1 / 3)) and rows[1]["m"] is None and rows[0]["bmi"] == pytest.approx(0.002324598)
    assert rows[1]["bmi"] == float("inf") and np.isnan(rows[2]["bmi"])
    label = spark.createDataFrame([("/a_Red/b_Grn_R01_grn.idat",)], "p string").select(sample_label(F.col("p")).alias("l")).first()["l"]
    assert label == "b_R01"


ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from sitefold.plans import catalog
data, shared = sys.argv[1:]
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.driver.host", "127.0.0.1").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + shared).getOrCreate()
s.createDataFrame([(i, "name %d" % i) for i in range(5)], "r_regionkey int, r_name string").repartition(3).write.parquet("file://" + data + "/region.parquet")
got = catalog.jdbc_table(s, "file://" + data).orderBy("r_regionkey").collect()
assert [tuple(r) for r in got] == [(i, "name %d" % i) for i in range(5)], got
s.stop()
"""


def test_jdbc_where_executors_are_other_processes(tmp_path):
    (tmp_path / "shared").mkdir()
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([home, os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path / "data"), str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not [f for f in os.listdir(tmp_path / "shared") if f.startswith("sitefold-files-")]


def test_jdbc_keeps_odd_values(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, None), (3, " x\ny\\ "), (None, "ä \U0001f600"), (5, "")]
    url = catalog.derby_jar(spark, spark.createDataFrame(rows, "id bigint, name string").repartition(2), "odd", str(tmp_path / "d"))
    got = tables.read_jdbc(spark, url, "odd", driver="org.apache.derby.jdbc.EmbeddedDriver").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
    catalog.derby_stop(spark, url)

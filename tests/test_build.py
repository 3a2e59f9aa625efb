"""Building and refreshing the reference tables, settings and log lines."""

import json
import logging

import pytest

from pkgloom import build
from pkgloom.engine import checkpoint_folder
from pkgloom.plans import images
from pkgloom.settings import JsonLines, load


def test_index_is_built_once_and_ordered(spark, folder, tmp_path):
    target = str(tmp_path)
    packages, links = images.packages(spark, folder), images.links(spark, folder)
    index = build.build_index(spark, target, packages, links)
    rows = index.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    order = [((r.package is not None, r.package or ""), r.projectname_seed, r.family, (r.version is not None, r.version or "")) for r in rows]
    assert order == sorted(order)
    assert build.build_index(spark, target, packages.where("false"), links).count() == len(rows)
    assert build.numbered(index.where("false").drop("id"), "package").count() == 0


def test_refreshes(spark, tmp_path):
    target = str(tmp_path)
    cpe = "publisher string, product string, version string, pos bigint"
    build.build_cpe(spark, target, spark.createDataFrame([("p", "a", None, 1), ("p", "b", "1", 2), ("p", "b", "1", 3)], cpe))
    got = build.build_cpe(spark, target, spark.createDataFrame([("p", "a", None, 1), ("q", "c", "1", 2)], cpe))
    assert {tuple(r) for r in got.collect()} == {(1, "p", "a", None), (2, "p", "b", "1"), (3, "q", "c", "1")}
    lic = "identifier string, name string, osi_approved boolean, seq int"
    build.build_licenses(spark, target, spark.createDataFrame([("A", "a", None, 0), ("A", "aa", True, 1)], lic))
    got = build.build_licenses(spark, target, spark.createDataFrame([("B", "b", False, 0)], lic))
    assert {tuple(r) for r in got.collect()} == {("A", "aa", True), ("B", "b", False)}
    apk = "file_rank int, pos bigint, package string, version string, srcname string, homepage string, description string, licenses string"
    build.build_alpine(spark, target, spark.createDataFrame([(0, 1, "p", "1.0", "s", "h", "d", "L")], apk))
    got = build.build_alpine(spark, target, spark.createDataFrame([(0, 1, "p", "1.0", "s", "", "e", "")], apk))
    assert [tuple(r) for r in got.collect()] == [("p", "s", "h", "p - e", "L")]


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"paths": {"results": "r"}, "logging": {"level": "DEBUG"}}))
    s = load(str(path), {"PKGLOOM__LOGGING__LEVEL": "ERROR", "HOME": "/"})
    assert (s.paths.results, s.paths.reference, s.logging.level) == ("r", "reference", "ERROR")
    with pytest.raises(ValueError):
        load(None, {"PKGLOOM__NOPE__X": "1"})
    record = logging.makeLogRecord({"msg": "hi %s", "args": ("x",), "rows": 3, "levelname": "INFO"})
    assert json.loads(JsonLines().format(record)) | {"time": ""} == {"time": "", "level": "INFO", "logger": None, "message": "hi x", "rows": 3}


def test_refresh_that_stopped_comes_back(spark, tmp_path):
    target = str(tmp_path)
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    build.refresh(spark, target, "t", lambda old: one)
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.old")  # stopped after the old table was set aside
    got = build.refresh(spark, target, "t", lambda old: old.unionByName(one.selectExpr("2 as id", "'b' as v")))
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "b")}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.parquet"]


def test_checkpoints_of_a_cluster_are_shared():
    assert checkpoint_folder("yarn", "hdfs://x/y") == "hdfs://x/y" and checkpoint_folder("local[4]", None)
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(master, None)

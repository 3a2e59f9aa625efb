"""Readers and the stream, on files written here."""

import io
import json
import tarfile

from pyspark.sql import functions as F

from pkgloom.sources import readers
from pkgloom.streaming.incremental import recognise_stream

APK = "C:x\nP:foo\nV:1.0-r0\nT:A tool: with colon\nU:https://foo.example/\nL:MIT\no:foo-src\n\nP:bar\nV:2\nT:\nL:GPL\n\n\nV:9\n"


def test_apk(spark, tmp_path):
    (tmp_path / "idx").write_text(APK)
    got = {r.package: (r.version, r.description, r.homepage, r.licenses, r.srcname) for r in readers.apk_text(spark, str(tmp_path / "idx")).collect()}
    want = {"foo": ("1.0-r0", "A tool: with colon", "https://foo.example/", "MIT", "foo-src"), "bar": ("2", "", "", "GPL", "")}
    assert got == want
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        info = tarfile.TarInfo("APKINDEX")
        info.size = len(APK.encode())
        tar.addfile(info, io.BytesIO(APK.encode()))
    rows = readers.apk_archives(spark, str(path)).collect()
    assert {r.package: (r.version, r.description, r.homepage, r.licenses, r.srcname) for r in rows} == want


def test_cpe_and_spdx(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<cpe-list xmlns:cpe-23="x"><cpe-item><cpe-23:cpe23-item name="cpe:2.3:a:pub:prod:1.0:*:*"/></cpe-item>'
        '<cpe-item><cpe-23:cpe23-item name="cpe:2.3:o:pub:os:1:*"/></cpe-item></cpe-list>'
    )
    assert [tuple(r) for r in readers.cpe_xml(spark, str(tmp_path / "d.xml")).collect()] == [("pub", "prod", "1.0")]
    (tmp_path / "l.json").write_text(json.dumps({"licenses": [{"licenseId": "X-1", "name": "X", "isOsiApproved": True}]}, indent=1))
    assert {tuple(r) for r in readers.spdx_json(spark, str(tmp_path / "l.json")).collect()} == {("X", "X", True), ("X-1", "X", True)}


def test_rss_and_payloads(spark):
    feed = "<rss><channel><item><title>a 1.0</title><pubDate>Mon, 02 Jan 2006 10:00</pubDate></item><item><title>a 2.0</title><pubDate>x</pubDate></item></channel></rss>"
    df = spark.createDataFrame([(1, feed)], "id int, body string")
    assert [(r.pos, r.title) for r in readers.rss_items(df).collect()] == [(0, "a 1.0"), (1, "a 2.0")]
    gap = "<rss><channel><item><title>a</title></item><item><title>b</title><pubDate>2 Jan</pubDate></item><item><pubDate>3 Jan</pubDate></item></channel></rss>"
    rows = readers.rss_items(spark.createDataFrame([(1, gap), (2, None), (3, "<rss/>"), (4, "no feed")], "id int, body string")).collect()
    assert [(r.id, r.pos, r.title, r.published) for r in rows] == [(1, 0, "a", None), (1, 1, "b", "2 Jan")]
    asked = spark.createDataFrame([("u",), ("v",)], "url string")
    answers = spark.createDataFrame([("u", 200, "ok"), ("v", 404, "no")], "url string, status int, body string")
    assert {tuple(r) for r in readers.payloads(asked, answers).collect()} == {("u", "ok"), ("v", None)}


def test_stream_writes_each_result_once(spark, tmp_path):
    schema = "software string, publisher string, version string"
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def new(batch, stored):
        return batch.distinct().join(stored, ["software", "publisher", "version"], "left_anti")

    def run():
        q = recognise_stream(spark.readStream.schema(schema).parquet(source), target, mark, new, schema)
        q.awaitTermination(60)

    first = spark.createDataFrame([("a", "p", "1"), ("a", "p", "1"), ("b", "p", "1")], schema)
    first.coalesce(1).write.mode("append").parquet(source)
    run()
    first.union(spark.createDataFrame([("c", "p", "1")], schema)).coalesce(1).write.mode("append").parquet(source)
    run()
    stored = spark.read.parquet(target)
    assert sorted(r.software for r in stored.collect()) == ["a", "b", "c"]
    assert stored.select(F.countDistinct("batch")).first()[0] == 2

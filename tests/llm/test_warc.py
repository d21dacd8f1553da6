import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from meterline.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    warc.register(spark)


def pages(spark):
    long = "long page é \U0001f600 " * 100
    rows = [(1, "http://a/1", long), (7, "http://a/7", long), (3, None, long), (4, "http://a/4", "short"), (5, "http://a/5", "short"),
            (6, "http://a/6\r\nWARC-Type: forged", None), (8, "u", ""), (None, "n", long), (9, "u", "x" * 1000), (10, "u", "x" * 1000),
            (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (9, "u", "x" * 1000)]
    return spark.createDataFrame(rows, PAGES).repartition(3).withColumn("payload", F.lit("clash"))


def want(rows):
    largest = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 1000 and r.page_id is not None:
            largest[b] = max(largest.get(b, r.page_id), r.page_id)
    out = []
    for r in rows:
        b = (r.html or "").encode()
        first = largest.get(b)
        revisit = first is not None and first != r.page_id
        out.append((r.page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None,
                    None if revisit else b))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in df.collect()), key=repr)


def test_round_trip(spark, tmp_path):
    source = pages(spark)
    for k, roll in enumerate((1 << 25, 500)):
        path = str(tmp_path / str(k))
        warc.records(source).write.format("warc").option("rollBytes", roll).mode("append").save(path)
        assert got(spark.read.format("warc").load(path)) == want(source.collect())
        assert not [f for f in os.listdir(path) if f.startswith("_")]
        assert (len(os.listdir(path)) > 5) == (roll == 500)


def test_files_are_planned_together_and_apart(tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.warc").write_bytes(warc.record(k, "response", "u", 1, "d", None, b"x"))
    (tmp_path / "notes.txt").write_text("no archive")
    size = os.path.getsize(tmp_path / "0.warc")
    reader = lambda n: warc.WarcReader(None, {"path": str(tmp_path), "partitionBytes": str(n)})
    assert [len(p.paths) for p in reader(10**6).partitions()] == [6]
    assert [len(p.paths) for p in reader(2 * size).partitions()] == [2, 2, 2]
    assert [len(p.paths) for p in reader(1).partitions()] == [1] * 6


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("kind", ["response", "revisit"])
def test_cut_archives_are_errors_in_every_reading(spark, tmp_path, kind, zipped):
    whole = warc.record(1, "response", "u", 3, "d", None, b"abc") + warc.record(2, kind, "u", 3, "d", 1, os.urandom(400) if kind == "response" else None)
    path = tmp_path / ("a.warc.gz" if zipped else "a.warc")
    pack = (lambda b: gzip.compress(b)) if zipped else (lambda b: b)
    light = warc.SCHEMA.rpartition(",")[0]
    readings = [lambda f: f, lambda f: f.where("record_type = 'response'"), lambda f: f.where("page_id = 1"), lambda f: f.where("page_id = 99")]
    load = lambda schema: spark.read.format("warc").schema(schema).load(str(tmp_path))
    path.write_bytes(pack(whole))
    assert load(warc.SCHEMA).count() == load(light).count() == 2
    for cut in [whole[:-30], whole[:whole.rindex(b"WARC/1.1") + 60], None]:
        path.write_bytes(pack(cut) if cut else pack(whole)[:-12] if zipped else whole[:-6])
        for schema in (warc.SCHEMA, light):
            for reading in readings:
                with pytest.raises(Exception, match="ends inside a record"):
                    reading(load(schema)).collect()


@pytest.mark.parametrize("length", [b"", b"Content-Length: x\r\n", b"Content-Length: -4\r\n"])
def test_a_record_without_its_length_is_an_error(spark, tmp_path, length):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\n" + length + b"\r\nabcd\r\n\r\n")
    with pytest.raises(Exception, match="without its length"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w")
    warc.records(pages(spark)).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    all_rows = back.collect()
    cases = ["record_type = 'revisit'", "page_id >= 7", "page_id IN (1, 13)", "refers_to IS NULL", "payload_bytes < 1000 AND record_type = 'response'",
             "page_id IS NULL", "record_type <> 'revisit'", "page_id = 4 OR page_id = 5", "target_uri = 'u'"]
    for case in cases:
        kept = spark.createDataFrame(all_rows, back.schema).where(case)
        assert got(back.where(case)) == got(kept), case
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
    from pyspark.sql.types import _parse_datatype_string
    reader = warc.WarcReader(_parse_datatype_string(warc.SCHEMA), {"path": path})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 12), StringContains(("target_uri",), "u")]))
    assert [type(f) for f in left] == [StringContains]
    decoded = []
    real = warc._payload
    monkeypatch.setattr(warc, "_payload", lambda b: decoded.append(1) or real(b))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == [13] and len(decoded) == 1
    light = warc.WarcReader(_parse_datatype_string("page_id long, record_type string"), {"path": path})
    assert sum(b.num_rows for p in light.partitions() for b in light.read(p)) == len(all_rows) and len(decoded) == 1


def test_gzipped_foreign_and_broken_files(spark, tmp_path):
    member = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    plain = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI: http://x\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n" % (19 + 4)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(member) + gzip.compress(plain))
    rows = {r.record_type: r for r in spark.read.format("warc").load(str(tmp_path)).collect()}
    assert bytes(rows["response"].payload) == b"body" and rows["response"].target_uri == "http://x" and rows["response"].page_id is None
    assert bytes(rows["warcinfo"].payload) == b""
    (tmp_path / "b.warc").write_bytes(plain[:-12])
    with pytest.raises(Exception, match="b.warc: ends inside a record"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.records(spark.createDataFrame([], PAGES)).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0

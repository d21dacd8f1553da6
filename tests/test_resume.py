import io
import random

import pytest

from meterline.sources import resume


def expected(data: bytes, first: int, length: int):
    out, at = [], first
    while (end := data.find(b"\n", at, length)) >= 0:
        out.append((data[at:end], at, end + 1))
        at = end + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_any_size_give_each_line_once(seed):
    rng = random.Random(seed)
    data = b"\n".join(bytes(rng.choices(b"abc", k=rng.choice([0, 0, 1, 5, 40, 300]))) for _ in range(80))
    starts = [0, *[k + 1 for k, b in enumerate(data) if b == 10]]
    for _ in range(40):
        first = rng.choice(starts)
        length = rng.randrange(first, len(data) + 1)
        step, block = rng.randrange(1, 200), rng.randrange(1, 150)
        got = []
        for low in range(first, length, step):
            blocks = resume.Blocks(io.BytesIO(data), max(first, low - 1), length, block)
            got += resume.lines_between(blocks, low, min(low + step, length), first)
        assert got == expected(data, first, length)


def test_bytes_read_after_one_appended_line(tmp_path):
    data = b"x" * 99 + b"\n"
    whole = data * 10_000 + b"the new line\n"
    blocks = resume.Blocks(io.BytesIO(whole), len(whole) - 13, len(whole))
    assert list(resume.lines_between(blocks, len(whole) - 13, len(whole), len(whole) - 13)) == [(b"the new line", len(whole) - 13, len(whole))]
    assert blocks.taken == 13


def test_a_range_reads_little_beyond_its_end():
    data = (b"x" * 99 + b"\n") * 10_000
    blocks = resume.Blocks(io.BytesIO(data), 499_999, len(data), 1000)
    assert len(list(resume.lines_between(blocks, 500_000, 510_000, 0))) == 100
    assert blocks.taken <= 12_000


def test_read_from_frames(spark, tmp_path):
    path = tmp_path / "a b%é.jsonl"
    path.write_bytes(b"\xef\xbb\xbffirst\nsecond\n\nfourth\nopen")
    from meterline.sources import tail
    listed = tail.files(spark, str(tmp_path), "*.jsonl")
    for step in (1, 3, 1000):
        rows = resume.read_from(listed.selectExpr("source_file", "0L AS first", "length"), step).orderBy("line_seq").collect()
        assert [(r["value"], r["line_seq"], r["line_end"]) for r in rows] == [("first", 0, 9), ("second", 9, 16), ("", 16, 17), ("fourth", 17, 24)]
    rows = resume.read_from(listed.selectExpr("source_file", "16L AS first", "length")).collect()
    assert sorted(r["value"] for r in rows) == ["", "fourth"]
    assert resume.read_from(listed.selectExpr("source_file", "length AS first", "length")).count() == 0


def test_stream_goes_on_from_its_offsets(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def run():
        query = (resume.stream(spark, str(logs), range_bytes=20).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["source_file"].rpartition("/")[2], r["line_seq"], r["value"]) for r in rows)

    (logs / "a.jsonl").write_text("one\ntwo, a longer line than a range\nthr")
    (logs / "skip.txt").write_text("no\n")
    first = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two, a longer line than a range")]
    assert run() == first
    (logs / "b.jsonl").write_text("x\n")
    with (logs / "a.jsonl").open("a") as f:
        f.write("ee\nfour")
    assert run() == sorted([*first, ("a.jsonl", 36, "three"), ("b.jsonl", 0, "x")])
    assert run() == sorted([*first, ("a.jsonl", 36, "three"), ("b.jsonl", 0, "x")])

"""The line source: half lines wait, each line comes once, also after a restart and across tasks."""

import io
import random

import pytest

from quarry.sources import lines as L


def test_stable_end_and_ranges():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n\xc3\xa9") for _ in range(rng.randint(0, 40)))
        stream, step = io.BytesIO(data), rng.randint(1, 7)
        start = rng.randint(0, len(data))
        found = data[start:].rfind(b"\n")
        end = L.stable_end(stream, start, len(data), step)
        assert end == (start + found + 1 if found >= 0 else start)
        whole = data[start:end].split(b"\n")[:-1]
        got = list(L.lines(stream, start, end, step))
        assert [x for _, x in got] == whole and all(data[a : a + len(x) + 1] == x + b"\n" for a, x in got)


@pytest.fixture
def run(spark, tmp_path):
    spark.dataSource.register(L.Lines)
    (tmp_path / "in").mkdir()

    def once(**options):
        rows = spark.readStream.format("lines").options(path=str(tmp_path / "in"), **options).load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file.rsplit("/", 1)[1], r.offset, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return once


def test_a_file_that_grows_in_steps(run, tmp_path):
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    a.write_bytes("one é\ntwo\nthr".encode())
    (tmp_path / "in" / "c.txt").write_text("other\n")
    assert run() == [("a.jsonl", 0, "one é"), ("a.jsonl", 7, "two")]
    assert len(run()) == 2  # a restart without news; the half line waits
    with a.open("ab") as f:
        f.write(b"ee\n")
    b.write_bytes(b"half")
    want = [("a.jsonl", 0, "one é"), ("a.jsonl", 7, "two"), ("a.jsonl", 11, "three")]
    assert run() == want
    with b.open("ab") as f:
        f.write(b" done\n\nlast\nnot yet")
    many = "".join(f"line {k} {'x' * (k % 50)}\n" for k in range(2000))
    with a.open("ab") as f:
        f.write(many.encode())
    got = run(rangebytes="1000")
    assert [r for r in got if r[0] == "b.jsonl"] == [("b.jsonl", 0, "half done"), ("b.jsonl", 10, ""), ("b.jsonl", 11, "last")]
    assert [r[2] for r in got if r[0] == "a.jsonl"][3:] == many.split("\n")[:-1] and len(got) == 2006
    a.write_bytes(b"new\n")
    with pytest.raises(Exception, match="shorter"):
        run()
    assert ("a.jsonl", 0, "new") in run(shrunk="restart")


def test_messages_show_broken_lines(spark):
    rows = spark.createDataFrame([("f", 0, '{"a": 1, "b": "x"}'), ("f", 9, '{"a": 1'), ("f", 20, "[1]"), ("f", 30, "  "), ("f", 40, '{"a": "no"}'), ("f", 50, "{}")], "file string, offset long, line string")
    got = [tuple(r) for r in L.messages(rows, "a int, b string").orderBy("offset").collect()]
    assert got == [("f", 0, 1, "x", None), ("f", 9, None, None, '{"a": 1'), ("f", 20, None, None, "[1]"), ("f", 40, None, None, '{"a": "no"}'), ("f", 50, None, None, None)]

"""Sections by byte ranges and documents as files with a commit."""

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docsheet.sources import documents, ranges


def document(path: Path, sections: list[tuple[int, bytes]], hole: int = 0, at: int | None = None) -> None:
    """A header, sections one after the other (with a hole before the last) and the table behind them."""
    with path.open("wb") as f:
        f.write(bytes(20))
        places = []
        for k, (uid, data) in enumerate(sections):
            if hole and k == len(sections) - 1:
                f.seek(hole)
            places.append((uid, f.tell()))
            f.write(data)
        table = f.tell()
        f.write(bytes([2 * len(places)]) + b"".join(struct.pack("<II", *p) for p in places))
        f.seek(16)
        f.write(struct.pack("<I", table if at is None else at))


class Counted:
    """A file that counts what is read from it."""

    read_bytes = 0

    def __init__(self, file):
        self.file = file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        Counted.read_bytes += len(data)
        return data


def test_one_section_of_a_huge_file(tmp_path, monkeypatch):
    """1 GB with a hole: a section of 5 bytes takes a header, a table and those bytes."""
    document(tmp_path / "big", [(1, b"first"), (2, b"x" * 1000), (3, b"last!")], hole=1 << 30)
    reader = ranges.PushingReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([ranges.EqualTo(("section_id",), 3), ranges.EqualTo(("chunk",), 0)])) == [ranges.EqualTo(("chunk",), 0)]
    plain = reader.filesystem()

    class Store:
        def open_input_file(self, path):
            return Counted(plain[0].open_input_file(path))

        def __getattr__(self, name):
            return getattr(plain[0], name)

    monkeypatch.setattr(reader, "filesystem", lambda: (Store(), plain[1]))
    splits = reader.partitions()
    rows = [r for s in splits for r in reader.read(s)]
    assert [(r[1], r[2], r[6], r[7]) for r in rows] == [(2, 3, b"last!", "ok")] and Counted.read_bytes < 5000


def test_sections_through_spark(spark, tmp_path):
    ranges.register(spark)
    for k in range(5):
        document(tmp_path / f"f{k}", [(1, b"a" * k), (7, f"seven{k}".encode()), (1, b"")])
    (tmp_path / "short").write_bytes(b"abc")
    document(tmp_path / "lost", [(1, b"a")], at=10**6)
    document(tmp_path / "wide", [(9, bytes(range(250)))])
    table = spark.read.format(ranges.NAME).option("split", 64).option("chunk", 100).load(str(tmp_path))
    rows = table.collect()
    name = lambda r: r["path"].rsplit("/", 1)[1]
    assert {(name(r), r["status"]) for r in rows if r["status"] != "ok"} == {("short", "short"), ("lost", "no table")}
    assert sorted((name(r), bytes(r["data"])) for r in rows if r["section_id"] == 7) == [(f"f{k}", f"seven{k}".encode()) for k in range(5)]
    wide = sorted((r["chunk"], bytes(r["data"])) for r in rows if r["section_id"] == 9)
    assert b"".join(d for _, d in wide) == bytes(range(250)) and [len(d) for _, d in wide] == [100, 100, 50]
    assert table.rdd.getNumPartitions() > 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format(ranges.NAME).option("push", "true").load(str(tmp_path))
        assert pushed.where("section_id = 7").count() == 5 and pushed.where("section_id in (7, 9) and chunk = 0").count() == 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {r["section_id"] for r in spark.read.format(ranges.NAME).option("sections", "0x7,9").load(str(tmp_path)).collect()} == {7, 9}


def files(path):
    return {p.name: p.read_text() for p in path.rglob("*") if p.is_file() and p.suffix in (".txt", ".html", ".xhtml")}


def test_documents_are_written(spark, tmp_path):
    paras = spark.createDataFrame([(1, 0, "a<b", None), (1, 1, None, "Heading 1"), (2, 0, "x", "B")], "d int, n int, para string, s string")
    documents.render_and_save(paras, ["d"], "n", str(tmp_path / "h"), "html5", style=F.col("s"))
    assert files(tmp_path / "h") == {"1.html": "<!DOCTYPE html>\n<html><body>\n<p>a&lt;b</p>\n<h1></h1>\n</body></html>\n", "2.html": "<!DOCTYPE html>\n<html><body>\n<p>x</p>\n</body></html>\n"}
    assert {p.name for p in (tmp_path / "h").iterdir() if not p.suffix} == {"_SUCCESS"}
    odd = spark.createDataFrame([("../a/b", "é"), ("_x", None), (".y", "z"), ("", "e")], "name string, body string")
    documents.save(odd, str(tmp_path / "t"))
    assert files(tmp_path / "t") == {"%2E.%2Fa%2Fb.txt": "é", "%5Fx.txt": "", "%2Ey.txt": "z", "%00.txt": "e"}
    documents.save(odd.limit(1), str(tmp_path / "t"), mode="overwrite")
    assert len(files(tmp_path / "t")) == 1


@pytest.mark.parametrize("bad", ["task", "twice", "there"])
def test_a_failure_leaves_no_document(spark, tmp_path, bad):
    rows = spark.range(0, 40, 1, 4).select(F.format_string("n%d", "id").alias("name"), F.lit("b").alias("body"))
    if bad == "task":
        rows = rows.withColumn("body", F.when(F.col("name") == "n33", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))
    elif bad == "twice":
        rows = rows.unionByName(rows.limit(1))
    else:
        (tmp_path / "out").mkdir()
        (tmp_path / "out" / "n5.txt").write_text("mine")
    with pytest.raises(Exception):
        documents.save(rows, str(tmp_path / "out"))
    assert files(tmp_path / "out") == ({"n5.txt": "mine"} if bad == "there" else {}) and not (tmp_path / "out" / "_temporary").exists()


def test_names_stay_out_of_the_driver(spark, tmp_path):
    """What an attempt reports doesn't grow with its documents; dealt over folders they are found again, and names that are there or come twice are refused."""
    import pickle

    def report(n):
        rows = [{"name": f"n{k}", "body": "b"} for k in range(n)]
        return len(pickle.dumps(documents.DocumentWriter({"path": str(tmp_path / f"r{n:03d}")}, False).write(iter(rows))))

    assert report(1) == report(500) and report(500) < 400
    rows = spark.range(0, 300, 1, 4).select(F.format_string("n%d", "id").alias("name"), F.repeat(F.lit("b"), F.col("id").cast("int")).alias("body"))
    out = str(tmp_path / "out")
    documents.save(rows, out, folders=7)
    found = {f"n{k}.txt": k for k in range(300)}
    assert {r["file"]: r["length"] for r in documents.lengths(spark, out, 7).collect()} == found
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"_SUCCESS", *(f"{k:05d}" for k in range(7))}
    for bad in (rows.where("name = 'n7'"), spark.range(2).select(F.lit("new").alias("name"), F.lit("b").alias("body"))):
        with pytest.raises(Exception, match="documents of one name"):
            documents.save(bad, out, folders=7)
    assert {r["file"]: r["length"] for r in documents.lengths(spark, out, 7).collect()} == found and not (tmp_path / "out" / "_temporary").exists()
    documents.save(rows.limit(2), out, mode="overwrite", folders=7)
    assert documents.lengths(spark, out, 7).count() == 2
    documents.drop(spark, out, 7)
    assert documents.lengths(spark, out, 7).count() == 0 and {p.name for p in (tmp_path / "out").iterdir()} == {"_SUCCESS"}

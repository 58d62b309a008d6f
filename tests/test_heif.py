"""The data source: what it reads, what filters spare, files of any size, and files that are written once."""

import os

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith

from boxloom.plans import items as it
from boxloom.plans.sequences import Sequences
from boxloom.sources import heif
from boxloom.sources import writer as w
from boxloom.sources.boxes import outline
from boxloom.sources.container import parse, parse_boxes
from boxloom.sources.tables import Container


def still(size=10, exif=b"MM", brands=("mif1", "heic")):
    items = [{"id": 1, "type": "hvc1", "props": [1, 2], "parts": [bytes(size)]}, {"id": 2, "type": "Exif", "parts": [exif[:1], exif[1:]]}, {"id": 3, "type": "mime", "content_type": "text/plain", "parts": [b"inside"], "idat": True}]
    return w.still(items, [w.ispe(30, 20), w.hvcc(10)], brands=brands)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.heic", still(50_000)), ("sub/b.heic", still(exif=b"other")), ("junk.heic", b"junk"), ("empty.heic", b""), ("_hidden", still()), ("mini.heic", w.mini(9, 8, 1, exif=b"\0\0\0\0MM")), ("movie.heic", w.movie([w.track([4] * 3, [(3, 20)], [32], [(1, 3)])], 1000, 60, bytes(40)))):
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_rows_are_those_of_whole_files(spark, folder):
    heif.register(spark)
    names = [n for n in ("a.heic", "sub/b.heic", "junk.heic", "empty.heic", "mini.heic", "movie.heic")]
    whole = Container(spark.createDataFrame([(f"{folder}/{n}", bytearray(open(f"{folder}/{n}", "rb").read())) for n in names], "file_id string, content binary"))
    part = heif.container(spark, folder)
    key = lambda r: str(r)
    assert sorted(it.info(part).collect(), key=key) == sorted(it.info(whole).collect(), key=key)
    for table in ("items", "extents", "assocs", "refs"):
        assert sorted(part.rows(table).collect(), key=key) == sorted(whole.rows(table).collect(), key=key)
    assert Sequences(part).info.count() == 1
    columns = ["file_id", "item_id", "item_type", "name", "content_type", "hidden", "payload", "error"]
    still_items = heif.payloads(spark, folder, pattern="*.heic").where("file_id not like '%movie%'").select(*columns)
    assert sorted(still_items.collect(), key=key) == sorted(it.item_payloads(whole).where("file_id not like '%movie%'").select(*columns).collect(), key=key)


def test_few_bytes_are_read(spark, folder):
    heif.register(spark)
    rows = {os.path.basename(r.file_id): (r.file_len, r.bytes_read) for r in spark.read.format("heif").load(folder).select("file_id", "file_len", "bytes_read").collect()}
    assert rows["a.heic"][0] > 50_000 and rows["a.heic"][1] < 1000 and "_hidden" not in rows
    exif = heif.payloads(spark, folder).where("item_type = 'Exif' and file_id like '%b.heic'").collect()
    assert [(bytes(r.payload), r.bytes_read < 1000) for r in exif] == [(b"other", True)]
    plan = heif.payloads(spark, folder).where("item_type = 'Exif'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan  # nothing is left to be filtered behind the scan


def test_filters_choose_files_before_they_are_opened(folder):
    reader = heif.HeifReader(None, {"path": folder, "rows": "items"})
    left = list(reader.pushFilters([GreaterThan(("file_len",), 1000), EqualTo(("item_type",), "Exif"), EqualTo(("name",), "x"), In(("item_id",), (2, 9)), StringEndsWith(("file_id",), "a.heic")]))
    assert left == [EqualTo(("name",), "x")]
    assert [[f[1] for f in p.files] for p in reader.partitions()] == [[f"{folder}/a.heic"]]
    assert reader.holds(item_type="Exif", item_id=9) and not reader.holds(item_type="mime", item_id=2) and not reader.holds(item_type=None, item_id=2)
    other = heif.HeifReader(None, {"path": folder, "files": "2"})
    assert [len(p.files) for p in other.partitions()] == [2, 2, 2]


def test_files_of_more_than_two_gigabytes(spark, tmp_path):
    far, path = (3 << 30) + 17, tmp_path / "large.heic"
    data = still()
    head = data[: data.index(b"mdat") - 4]
    row = parse(data)
    at = row["locations"][1]["parts"][0]["at"]
    size = (8 + far + 100).to_bytes(8, "big")
    moved = head.replace(at.to_bytes(4, "big"), (at + far).to_bytes(4, "big")).replace((at + 2).to_bytes(4, "big"), (at + 2 + far).to_bytes(4, "big"))
    with path.open("wb") as f:
        f.write(moved + (1).to_bytes(4, "big") + b"mdat" + (16 + int.from_bytes(size, "big")).to_bytes(8, "big"))
        f.truncate(len(moved) + 16 + int.from_bytes(size, "big"))
        f.seek(at + far)
        f.write(b"M\xeeM")
    heif.register(spark)
    got = heif.payloads(spark, str(tmp_path)).where("item_type = 'Exif'").collect()
    assert [(bytes(r.payload), r.file_len > 3 << 30, r.bytes_read < 1000) for r in got] == [(b"MM", True, True)]


def test_outline_is_parse():
    for data in (still(), still()[:60], w.mini(9, 8), b"", b"junk", still() + b"\0\0\0\5bad!", still() + b"\0\0\0\1free"):
        assert parse_boxes(outline(lambda at, n: data[at : at + n], len(data), heif.TABLES), len(data)) == parse(data)  # noqa: B023


def test_files_are_written_once(spark, tmp_path):
    out = f"{tmp_path}/out"
    heif.register(spark)
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.heic", bytearray([i] * i)) for i in range(20)], "name string, content binary").repartition(4)
    rows.write.format("heif").mode("append").save(out)
    found = {str(p.relative_to(out)): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {f"d{i % 3}/{i}.heic": bytes([i] * i) for i in range(20)}
    with pytest.raises(Exception, match="two files would have one name"):
        rows.write.format("heif").mode("append").save(out)
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_file()]) == 20


def test_attempts_that_fail_leave_nothing(tmp_path):
    from pyspark.sql import Row

    rows = [Row(name=f"{i}", content=bytes([i])) for i in range(5)]
    job = heif.HeifWriter(f"{tmp_path}/out")

    def broken():
        yield from rows[:3]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        job.write(broken())
    late = job.write(iter(rows))  # an attempt whose result is not used
    done = job.write(iter(rows))
    assert not (tmp_path / "out" / "0").exists()
    job.commit([done, job.write(iter([])), None])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["0", "1", "2", "3", "4"] and late.files != done.files
    other = heif.HeifWriter(f"{tmp_path}/more")
    other.write(iter(rows))
    other.abort([])
    assert [p for p in (tmp_path / "more").rglob("*")] == []
    for bad in ("", "../x", "_x", "/x"):
        with pytest.raises(ValueError, match="no name"):
            other.write(iter([Row(name=bad, content=b"")]))
    twice = heif.HeifWriter(f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="one name"):
        twice.commit([twice.write(iter(rows)), twice.write(iter(rows[:1]))])
    assert [p for p in (tmp_path / "twice").rglob("*") if p.is_file()] == []

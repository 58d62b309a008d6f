"""Files as a stream."""

from boxloom.sources import writer as w
from boxloom.streaming.files import file_stream, write_tables


def test_new_files_are_appended(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"a{i}.heic").write_bytes(w.still([{"id": 1, "type": "hvc1", "props": [1]}], [w.ispe(10 + i, 5)]))
    write_tables(file_stream(spark, source, "*.heic", 2), out, marks).awaitTermination()
    assert sorted(r.width for r in spark.read.parquet(f"{out}/info").collect()) == [10, 11, 12]
    (tmp_path / "in" / "b.heic").write_bytes(b"not an image, but long enough")
    write_tables(file_stream(spark, source, "*.heic", 2), out, marks).awaitTermination()
    rows = spark.read.parquet(f"{out}/info").collect()
    assert len(rows) == 4 and sum(r.error is not None for r in rows) == 1

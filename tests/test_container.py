"""Boxes, properties and container tables, against byte literals and fixtures."""

import struct

import pytest

from boxloom.plans import items as it
from boxloom.sources import properties as pr
from boxloom.sources import writer as w
from boxloom.sources.boxes import Bits, Short, box_tree, boxes
from boxloom.sources.container import Limits, parse
from boxloom.sources.tables import Container, box_rows


def sample() -> bytes:
    items = [
        {"id": 1, "type": "hvc1", "props": [1, 2, 3, 4], "parts": [b"abc", b"de"]},
        {"id": 2, "type": "Exif", "parts": [b"\0\0\0\0MM"]},
        {"id": 3, "type": "mime", "content_type": "application/rdf+xml", "parts": [b"<x/>"], "idat": True},
    ]
    return w.still(items, [w.ispe(10, 20), w.hvcc(10), w.irot(1), w.nclx(1, 13, 6, True)], [("cdsc", 2, [1])])


def test_box_headers():
    big = struct.pack(">I4sQ", 1, b"big ", 20) + b"1234"
    rest = struct.pack(">I4s", 0, b"rest") + b"tail"
    assert [(b.type, b.offset, b.content) for b in boxes(big + rest)] == [("big ", 16, b"1234"), ("rest", 28, b"tail")]
    assert list(boxes(b"\0\0\0\7free")) == []  # smaller than its header
    assert [b.type for b in boxes(w.box("free") + b"\0\0\0\xfffree")] == ["free"]  # leaves the data
    assert list(boxes(struct.pack(">I4sQ", 1, b"big ", 15) + b"12")) == []


def test_box_tree_has_parents():
    tree = box_tree(sample())
    by_id = {r[0]: r for r in tree}
    ipco = next(r for r in tree if r[3] == "ipco")
    assert by_id[ipco[1]][3] == "iprp" and by_id[by_id[ipco[1]][1]][3] == "meta"
    assert [r[3] for r in tree if r[1] == ipco[0]] == ["ispe", "hvcC", "irot", "colr"]


def test_properties():
    assert pr.irot(b"\1") == {"angle": 270} and pr.irot(b"\3") == {"angle": 90} and pr.irot(b"\0") == {"angle": 0}
    assert pr.ispe(bytes(4) + struct.pack(">II", 3, 0)) is None
    assert pr.parse_property("ispe", b"")["kind"] == "unknown"
    assert pr.parse_property("abcd", b"x") == {"kind": "unknown"}
    assert pr.colr(b"rICCxyz")["icc"] == pr.colr(b"profxyz")["icc"] == b"xyz"
    assert pr.auxc(bytes(4) + b"urn\0more") == {"aux_type": "urn", "subtype": b"more"}
    got = pr.hvcc(w.hvcc(10, [b"\x40\1vps", b"\x42\1sps"])[8:])
    assert (got["bit_depth"], got["nals"], got["nal_length"]) == (10, [b"\x40\1vps", b"\x42\1sps"], 4)
    assert pr.av1c(w.av1c(12)[8:])["bit_depth"] == 12
    assert pr.icef(w.icef([5, 7])[8:]) == [{"offset": 0, "size": 5}, {"offset": 5, "size": 7}]
    assert pr.cmpd(struct.pack(">IHH", 2, 0x8000, 4)[:6] + b"uri\0" + struct.pack(">H", 4)) == [0x8000, 4]
    assert pr.clap(struct.pack(">IIIIiIiI", 4, 1, 4, 1, -3, 2, 0, 0)) is None
    got = pr.uncc(w.uncc([8, 10], 1, 4, 0x60, 4, tiles=(2, 3))[8:])
    assert (got["block_le"], got["pad_lsb"], got["tile_cols"], got["tile_rows"], [c["bit_depth"] for c in got["components"]]) == (True, True, 2, 3, [8, 10])


def test_bits():
    b = Bits(b"\xa5\x01")
    assert [b.u(n) for n in (1, 3, 4, 8)] == [1, 2, 5, 1]
    with pytest.raises(Short):
        b.u(1)


def test_parse_rows():
    got = parse(sample())
    assert got["error"] is None and got["primary_id"] == 1
    assert [i["item_type"] for i in got["items"]] == ["hvc1", "Exif", "mime"]
    assert [(e["item_id"], e["ext_no"], e["length"], e["method"]) for e in got["extents"]] == [(1, 0, 3, 0), (1, 1, 2, 0), (2, 0, 6, 0), (3, 0, 4, 1)]
    assert [(a["item_id"], a["prop_idx"]) for a in got["assocs"] if a["prop_idx"]] == [(1, 1), (1, 2), (1, 3), (1, 4)]
    assert got["refs"] == [{"ref_ord": 0, "ref_type": "cdsc", "from_id": 2, "pos": 0, "to_id": 1}]


@pytest.mark.parametrize("make", [sample, lambda: w.mini(30, 40, 6, b"\0\0\0\0MM", b"<x/>", b"icc", b"a"), lambda: w.movie([w.track([4] * 5, [(5, 2)], [32], [(1, 5)], edits=[(10, 0)])], 1000, 10, bytes(20))])
def test_every_prefix_is_rows_or_an_error(make):
    data = make()
    for n in range(len(data) + 1):
        got = parse(data[:n])
        assert (got["error"] is None) or not got["items"]
        box_tree(data[:n])
    for i in range(0, len(data), 3):
        parse(data[:i] + b"\xff" + data[i + 1 :])


def test_damage_is_told():
    assert parse(b"")["error"] == "the file is too short"
    assert parse(w.box("ftyp", b"xxxx", bytes(4)) + bytes(8))["error"] == "no brand of the HEIF family"
    assert parse(w.ftyp() + w.box("free", bytes(9)))["error"].startswith("no meta")
    second = w.still([{"id": 9, "type": "hvc1"}], [w.ispe(1, 1)])
    assert [i["item_id"] for i in parse(sample() + second[len(w.ftyp()) :])["items"]] == [1, 2, 3]  # a second meta is ignored


@pytest.mark.parametrize(("orientation", "angle", "axis"), [(1, None, None), (2, None, 1), (3, 180, None), (4, None, 0), (5, 90, 1), (6, 90, None), (7, 90, 0), (8, 270, None)])
def test_mini(orientation, angle, axis):
    got = parse(w.mini(300, 200, orientation, alpha=b"al", exif=b"\0\0\0\0MM", xmp=b"<x/>", data=b"main"))
    assert got["error"] is None
    assert [(i["item_id"], i["item_type"], i["hidden"]) for i in got["items"]] == [(1, "hvc1", False), (2, "hvc1", True), (6, "Exif", False), (7, "mime", False)]
    kinds = {p["kind"]: p for p in got["props"]}
    assert kinds["ispe"]["ispe"] == {"width": 300, "height": 200}
    assert (kinds.get("irot") or {"irot": {"angle": None}})["irot"]["angle"] == angle
    assert (kinds.get("imir") or {"imir": {"axis": None}})["imir"]["axis"] == axis
    assert [(r["ref_type"], r["from_id"]) for r in got["refs"]] == [("auxl", 2), ("cdsc", 6), ("cdsc", 7)]


def test_mini_limits():
    assert parse(w.mini(300, 200), Limits(width=299))["error"] == "mini: the image is too large"


def files(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")


def test_tables_and_info(spark):
    c = Container(files(spark, sample(), b"junk", w.mini(300, 200, 6)))
    rows = {r.file_id: r for r in it.info(c).collect()}
    assert (rows[0].width, rows[0].height, rows[0].bit_depth, rows[0].has_exif, rows[0].has_xmp, rows[0].has_alpha) == (20, 10, 10, True, True, False)
    assert rows[1].error == "the file is too short" and rows[1].width is None
    assert (rows[2].width, rows[2].height) == (200, 300)
    assert it.xmp(c).collect()[0].xmp == b"<x/>" and it.exif(c).collect()[0].exif == b"MM"
    assert {(r.item_id, bytes(r.payload)) for r in it.payloads(c).where("file_id = 0").collect()} == {(1, b"abcde"), (2, b"\0\0\0\0MM"), (3, b"<x/>")}
    assert box_rows(files(spark, sample())).where("type = 'infe'").count() == 3


def chain(n: int, loop: bool = False) -> bytes:
    """Item 1 is n identities away from one with a size; or the last points at the first."""
    items = [{"id": i, "type": "iden"} for i in range(1, n + 1)] + [{"id": n + 1, "type": "iden" if loop else "hvc1", "props": [] if loop else [1, 2]}]
    refs = [("dimg", i, [i + 1]) for i in range(1, n + 1)] + ([("dimg", n + 1, [1])] if loop else [])
    return w.still(items, [w.ispe(5, 6), w.hvcc(10)], refs)


def test_chains_of_derived_images(spark):
    c = Container(files(spark, chain(1), chain(8), chain(9), chain(2, loop=True)))
    rows = {r.file_id: r for r in it.info(c).collect()}
    assert [(rows[i].width, rows[i].bit_depth) for i in (0, 1)] == [(5, 10), (5, 10)]
    assert [rows[i].error for i in (2, 3)] == ["the primary item has no size"] * 2


def test_first_rows_and_last_properties_count(spark):
    props = [w.ispe(1, 1), w.ispe(2, 3), w.imir(0), w.imir(1)]
    data = w.still([{"id": 1, "type": "hvc1", "props": [2, 1, 3, 4]}, {"id": 1, "type": "av01", "props": [2]}], props)
    row = it.resolved_items(Container(files(spark, data))).collect()[0]
    assert (row.item_type, row.ispe.width) == ("hvc1", 1)
    assert [t.imir.axis for t in row.transforms] == [0, 1]


def test_auxiliary_without_a_name_fits_any(spark):
    data = w.still([{"id": 1, "type": "hvc1", "props": [1]}, {"id": 2, "type": "hvc1", "props": [1]}], [w.ispe(1, 1)], [("auxl", 2, [1])])
    row = it.info(Container(files(spark, data))).collect()[0]
    assert row.has_alpha and row.has_gain_map


def test_kinds(spark):
    def kind(*brands):
        return it.info(Container(files(spark, w.still([{"id": 1, "type": "hvc1", "props": [1]}], [w.ispe(1, 1)], brands=brands)))).collect()[0].kind

    assert [kind("mif1", "avif"), kind("mif1", "heic"), kind("msf1"), kind("mif1"), kind(*["mif1"] * 15, "avif")] == ["avif", "heic", "sequence", "heif", "heif"]


def test_payload_errors(spark):
    data = w.still([{"id": 1, "type": "hvc1", "parts": [b"abc"]}], [w.ispe(1, 1)])
    row = it.payloads(Container(files(spark, data[:-3]))).collect()
    assert row == [] or row[0].error  # the cut file has lost its data
    at = data.index(b"iloc")
    method = data[: at + 15] + b"\2" + data[at + 16 :]
    got = [r.error for r in it.payloads(Container(files(spark, method))).collect()]
    assert got == ["an unknown construction method"]

"""Parameter sets and slice headers, written bit by bit and read back."""

import pytest

from boxloom.functions import hevc_bits as hb
from boxloom.plans.streams import coded_items
from boxloom.sources import writer as w
from boxloom.sources.boxes import Damaged, Short
from boxloom.sources.tables import Container
from boxloom.sources.writer import HevcBits as Out
from boxloom.sources.writer import hevc_pps as pps
from boxloom.sources.writer import hevc_slice as slice_
from boxloom.sources.writer import hevc_sps as sps


def test_sequence_parameters():
    got = hb.sequence_parameters(sps(128, 96, (1, 2, 0, 3), 10, [([-1, -3], [2]), ([-2], [])], (1, 9, 16, 9)))
    assert (got["coded_width"], got["width"], got["height"], got["crop_left"], got["bit_depth"], got["bit_depth_chroma"]) == (128, 122, 90, 2, 10, 10)
    assert (got["full_range"], got["primaries"], got["transfer"], got["matrix"], got["ctb"], got["poc_bits"]) == (True, 9, 16, 9, 32, 8)
    assert got["reference_sets"] == [[(-1, True), (-3, True), (2, True)], [(-2, True)]]
    assert hb.sequence_parameters(sps(chroma=3, crop=(1, 0, 0, 0)))["width"] == 63
    with pytest.raises(Damaged):
        hb.sequence_parameters(sps(8, 8, (4, 0, 0, 0)))


def test_every_prefix_is_an_error_or_a_set():
    data = sps(sets=[([-1], [1])], colour=(0, 1, 1, 1))
    for n in range(len(data)):
        try:
            hb.sequence_parameters(data[:n])
        except (Short, Damaged):
            pass


def test_predicted_reference_sets():
    b = Out()
    b.put(1, 1), b.put(1, 1), b.ue(0)  # from the set before, every difference one less
    for used in (1, 0, 1):
        b.put(used, 1)
        if not used:
            b.put(1, 1)
    assert hb.reference_set(hb.Golomb(b.bytes()), 1, [[(-1, True), (2, True)]]) == [(-1, True), (-2, True), (1, False)]


def test_picture_parameters():
    got = hb.picture_parameters(pps((2, 3)))
    assert (got["qp"], got["tile_columns"], got["tile_rows"], got["cb_qp_offset"], got["cr_qp_offset"], got["dependent_slices"]) == (23, 2, 3, 2, -1, True)


def test_slices_and_order_counts():
    s = hb.sequence_parameters(sps(sets=[([-1], [1]), ([-2], [])]))
    p = hb.picture_parameters(pps())
    read = lambda n: hb.slice_start(n, {0: s}, {0: p})
    assert read(slice_(19, 2))["slice_type"] == "I" and read(slice_(19, 2))["poc_low"] == 0
    got = read(slice_(1, 0, 7, which=1))
    assert (got["slice_type"], got["poc_low"], got["references"]) == ("B", 7, [(-2, True)])
    assert read(slice_(1, 1, 7, first=False, address=2, which=0))["address"] == 2 and read(slice_(1, 1, first=False, address=3, dependent=True))["dependent"]
    with pytest.raises(Damaged):
        hb.slice_start(slice_(19, 2), {}, {})
    lows = [0, 100, 200, 44, 250, 10]
    order = hb.order_counts([read(slice_(19, 2))] + [read(slice_(1, 1, v, which=0)) for v in lows[1:]] + [read(slice_(19, 2))], 8)
    assert order == [0, 100, 200, 300, 250, 266, 0]


def test_coded_items(spark):
    nals = [sps(64, 48, (0, 0, 0, 2), 10, colour=(1, 1, 13, 6)), pps((1, 2))]
    parts = b"".join(len(n).to_bytes(4, "big") + n for n in (slice_(19, 2), slice_(19, 1, first=False, address=1)))
    good = w.still([{"id": 1, "type": "hvc1", "props": [1, 2], "parts": [parts]}], [w.ispe(64, 44), w.hvcc(10, nals)])
    bad = w.still([{"id": 1, "type": "hvc1", "props": [1, 2], "parts": [b"x"]}], [w.ispe(64, 44), w.hvcc(10, [b"\x42\1"])])
    rows = {r.file_id: r for r in coded_items(Container(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad))], "file_id int, content binary"))).collect()}
    assert (rows[1].width, rows[1].height, rows[1].bit_depth, rows[1].matrix, rows[1].slices, rows[1].slice_types, rows[1].tile_rows, rows[1].error) == (64, 44, 10, 6, 2, "IP", 2, None)
    assert rows[2].error

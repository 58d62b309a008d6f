"""HEVC parameter sets and slice headers as far as they tell of pictures: sizes, cropping, depths, colour, reference sets, order counts.

Written from the public standard (ITU-T H.265, clauses 7.3 and 8.3). What stands behind the fields that are read is not looked at."""

from __future__ import annotations

from boxloom.operators.metrics import without_escapes
from boxloom.sources.boxes import Bits, Damaged, Short

VPS, SPS, PPS = 32, 33, 34


class Golomb(Bits):
    """Bits with the variable-length numbers of the standard."""

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise Damaged("a variable-length number is too long")
        return (1 << zeros) - 1 + (self.u(zeros) if zeros else 0)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def unit(nal: bytes) -> tuple[int, int, Golomb]:
    """Type, temporal layer, and the raw bits behind the header."""
    if len(nal) < 2:
        raise Short
    return nal[0] >> 1 & 63, (nal[1] & 7) - 1, Golomb(without_escapes(nal[2:]))


def profile_tier_level(b: Golomb, layers: int) -> dict:
    out = {"profile_space": b.u(2), "tier": b.u(1), "profile": b.u(5), "compatible": b.u(32), "constraints": b.u(48), "level": b.u(8)}
    has = [(b.u(1), b.u(1)) for _ in range(layers)]
    if layers:
        b.u(2 * (8 - layers))
    for profile, level in has:
        b.u(88 * profile)
        b.u(8 * level)
    return out


def scaling_lists(b: Golomb, chroma_32: bool) -> None:
    """Passes over scaling lists; how many coefficients are coded depends on what is coded before."""
    for size in range(4):
        for _ in range(0, 6, 3 if size == 3 and not chroma_32 else 1):
            if not b.u(1):
                b.ue()
                continue
            if size > 1:
                b.se()
            for _ in range(min(64, 1 << (4 + (size << 1)))):
                b.se()


def reference_set(b: Golomb, no: int, sets: list[list[tuple[int, bool]]], in_slice: bool = False) -> list[tuple[int, bool]]:
    """A short-term set as (difference of order counts, used by this picture), nearest first, those before the picture first."""
    if no and b.u(1):
        back = b.ue() + 1 if in_slice else 1
        if back > no:
            raise Damaged("a reference set refers to none")
        sign, step = b.u(1), b.ue() + 1
        delta, base = (-step if sign else step), sets[no - back]
        kept = []
        for d in [*(d for d, _ in base), 0]:
            used = b.u(1)
            if used or b.u(1):
                kept.append((d + delta, bool(used)))
        kept = [x for x in kept if x[0]]
    else:
        before, after = b.ue(), b.ue()
        if before + after > 16:
            raise Damaged("a reference set is too long")
        kept = []
        for n, way in ((before, -1), (after, 1)):
            at = 0
            for _ in range(n):
                at += way * (b.ue() + 1)
                kept.append((at, bool(b.u(1))))
    return sorted((x for x in kept if x[0] < 0), key=lambda x: -x[0]) + sorted(x for x in kept if x[0] > 0)


def video_signal(b: Golomb) -> dict:
    """The beginning of the usability information: aspect, overscan, colour, place of chroma samples."""
    out: dict = {"aspect": None, "full_range": None, "primaries": None, "transfer": None, "matrix": None}
    if b.u(1):
        out["aspect"] = b.u(8)
        if out["aspect"] == 255:
            b.u(32)
    if b.u(1):
        b.u(1)
    if b.u(1):
        b.u(3)
        out["full_range"] = bool(b.u(1))
        if b.u(1):
            out["primaries"], out["transfer"], out["matrix"] = b.u(8), b.u(8), b.u(8)
    return out


def sequence_parameters(nal: bytes) -> dict:
    """The fields of an SPS."""
    kind, _, b = unit(nal)
    if kind != SPS:
        raise Damaged("not a sequence parameter set")
    out: dict = {"vps_id": b.u(4)}
    layers = b.u(3)
    b.u(1)
    out |= profile_tier_level(b, layers)
    out["sps_id"], out["chroma_format"] = b.ue(), b.ue()
    out["separate_planes"] = bool(b.u(1)) if out["chroma_format"] == 3 else False
    if out["chroma_format"] > 3 or out["sps_id"] > 15:
        raise Damaged("an SPS has an unknown chroma format or number")
    out["coded_width"], out["coded_height"] = b.ue(), b.ue()
    window = [b.ue() for _ in range(4)] if b.u(1) else [0] * 4
    sx, sy = (1 if out["chroma_format"] in (0, 3) else 2), (2 if out["chroma_format"] == 1 else 1)
    out["crop_left"], out["crop_right"], out["crop_top"], out["crop_bottom"] = (v * s for v, s in zip(window, (sx, sx, sy, sy), strict=True))
    out["width"], out["height"] = out["coded_width"] - out["crop_left"] - out["crop_right"], out["coded_height"] - out["crop_top"] - out["crop_bottom"]
    if out["width"] <= 0 or out["height"] <= 0:
        raise Damaged("an SPS crops its picture away")
    out["bit_depth"], out["bit_depth_chroma"], out["poc_bits"] = b.ue() + 8, b.ue() + 8, b.ue() + 4
    for _ in range(1 if b.u(1) else layers + 1, layers + 2):
        out["dpb_pictures"], out["reorder_pictures"], out["latency"] = b.ue() + 1, b.ue(), b.ue()
    least, more = b.ue() + 3, b.ue()
    out["min_block"], out["ctb"] = 1 << least, 1 << (least + more)
    least, more = b.ue() + 2, b.ue()
    out["min_transform"], out["max_transform"] = 1 << least, 1 << (least + more)
    b.ue(), b.ue()
    out["scaling_lists"] = bool(b.u(1))
    if out["scaling_lists"] and b.u(1):
        scaling_lists(b, out["chroma_format"] == 3)
    out["amp"], out["sao"], out["pcm"] = (bool(b.u(1)) for _ in range(3))
    if out["pcm"]:
        b.u(8), b.ue(), b.ue(), b.u(1)
    if (n := b.ue()) > 64:
        raise Damaged("an SPS has too many reference sets")
    sets: list[list[tuple[int, bool]]] = []
    for i in range(n):
        sets.append(reference_set(b, i, sets))
    out["reference_sets"] = sets
    out["long_term"] = [(b.u(out["poc_bits"]), bool(b.u(1))) for _ in range(b.ue())] if b.u(1) else None
    out["temporal_mvp"], out["strong_smoothing"] = bool(b.u(1)), bool(b.u(1))
    out |= video_signal(b) if b.u(1) else {"aspect": None, "full_range": None, "primaries": None, "transfer": None, "matrix": None}
    return out


def picture_parameters(nal: bytes) -> dict:
    """The fields of a PPS up to its tiles."""
    kind, _, b = unit(nal)
    if kind != PPS:
        raise Damaged("not a picture parameter set")
    out: dict = {"pps_id": b.ue(), "sps_id": b.ue(), "dependent_slices": bool(b.u(1)), "output_flag": bool(b.u(1)), "extra_bits": b.u(3), "sign_hiding": bool(b.u(1)), "cabac_init": bool(b.u(1)), "refs_l0": b.ue() + 1, "refs_l1": b.ue() + 1, "qp": 26 + b.se(), "constrained_intra": bool(b.u(1)), "transform_skip": bool(b.u(1))}
    out["qp_delta_depth"] = b.ue() if b.u(1) else None
    out["cb_qp_offset"], out["cr_qp_offset"] = b.se(), b.se()
    out["slice_chroma_qp"], out["weighted"], out["weighted_bi"], out["bypass"], tiles, out["wavefronts"] = (bool(b.u(1)) for _ in range(6))
    out["tile_columns"] = out["tile_rows"] = 1
    if tiles:
        out["tile_columns"], out["tile_rows"] = b.ue() + 1, b.ue() + 1
    return out


def slice_start(nal: bytes, sps: dict[int, dict], pps: dict[int, dict]) -> dict:
    """The beginning of a slice header: its kind, place, order count and reference set."""
    kind, layer, b = unit(nal)
    if kind > 31:
        raise Damaged("not a slice")
    out: dict = {"nal_type": kind, "temporal_layer": layer, "first": bool(b.u(1)), "random_access": 16 <= kind <= 23, "no_output_prior": None}
    if out["random_access"]:
        out["no_output_prior"] = bool(b.u(1))
    p = pps.get(b.ue())
    s = sps.get(p["sps_id"]) if p else None
    if s is None:
        raise Damaged("a slice names no parameter set")
    out["pps_id"] = p["pps_id"]
    blocks = -(-s["coded_width"] // s["ctb"]) * -(-s["coded_height"] // s["ctb"])
    out["dependent"], out["address"] = False, 0
    if not out["first"]:
        out["dependent"] = bool(b.u(1)) if p["dependent_slices"] else False
        out["address"] = b.u((blocks - 1).bit_length())
    if out["dependent"]:
        return out
    b.u(p["extra_bits"])
    out["slice_type"] = "BPI"[min(b.ue(), 2)]
    out["shown"] = bool(b.u(1)) if p["output_flag"] else True
    if s["separate_planes"]:
        b.u(2)
    out["poc_low"], out["references"] = 0, []
    if kind not in (19, 20):
        out["poc_low"] = b.u(s["poc_bits"])
        sets = s["reference_sets"]
        if b.u(1):
            out["references"] = sets[b.u((len(sets) - 1).bit_length()) if len(sets) > 1 else 0] if sets else []
        else:
            out["references"] = reference_set(b, len(sets), sets, in_slice=True)
    return out


def order_counts(slices: list[dict], poc_bits: int) -> list[int]:
    """The order count of each picture from the low bits of its first slice, in decoding order (clause 8.3.1)."""
    out, before, span = [], 0, 1 << poc_bits
    for s in slices:
        low = s["poc_low"]
        if s["random_access"] and (s["nal_type"] in (19, 20) or not out):
            high = 0
        else:
            old_low, old_high = before % span, before - before % span
            high = old_high + (span if low < old_low and old_low - low >= span // 2 else -span if low > old_low and low - old_low > span // 2 else 0)
        out.append(high + low)
        # pictures that later ones count from: of the lowest layer, neither skipped leading ones nor sub-layer non-references
        if s["temporal_layer"] == 0 and not (6 <= s["nal_type"] <= 9) and not (s["nal_type"] < 16 and s["nal_type"] % 2 == 0):
            before = out[-1]
    return out

"""Binary header of an acquisition: where fields lie, and how they are read."""

from __future__ import annotations

import struct

# Offsets and struct formats of the basic fields.
HEADER_BYTES = 65_536
BASIC = {"data_offset": (0x008, "<I"), "stage_x": (0x014, "<i"), "stage_y": (0x018, "<i"), "stage_z": (0x04C, "<i"), "duration_s": (0x08C, "<I"), "planned_planes": (0x090, "<I"), "n_masses": (0x198, "<I"), "dwell_us": (3968, "<I")}
TEXT = {"instrument": (0x03D, 16), "date": (0x05C, 12), "time": (0x06C, 8)}
MARKER, SIDE_AT, SIDES = b"Poly_list", (0x34, 0x38), range(16, 8193)
RASTER_BEFORE_DATA = 68
LABEL_AT, NOMINAL_AT, MASS_STRIDE = 0x2C0 + 0x0D, 0x200 + 0x94, 0xC0
BFIELD = {"bfield_dac": (3960, "<i"), "q_dac": (3988, "<i"), "lf4_dac": (3992, "<i"), "hex_dac": (3996, "<i")}
PRIMARY = {"ionizer_mA": (24084, "<d"), "reservoir_mA": (24092, "<d"), "cs_hv_v": (7600, "<i"), "l1_v": (7392, "<i"), "oct45_v": (7540, "<d"), "oct90_v": (7548, "<d"), "oct45_dac": (7676, "<i"), "oct90_dac": (7680, "<i"), "e0p_v": (7556, "<d"), "be_dac": (24068, "<i")}
SECONDARY = {"e0w_dac": (24000, "<i"), "e0s_dac": (24004, "<i"), "lf5_dac": (24020, "<i"), "p2_dac": (24024, "<i"), "p3_dac": (24028, "<i")}
MASS_ROWS_AT, MASS_ROW_STRIDE, MASS_ROWS = 4252, 208, 20
MASS_ROW = {"mass_amu": (32, "<d"), "radius_mm": (40, "<d"), "neg_plate_dac": (48, "<i"), "pos_plate_dac": (52, "<i"), "exit_slit_um": (120, "<d")}
SELECTORS = {"d1": (7484, {"diameters_um": 7492}), "es": (7932, {"widths_um": 7940, "heights_um": 7980}), "as": (8016, {"widths_um": 8024, "heights_um": 8064})}
DETECTOR_HV_AT, DETECTOR_THRESHOLD_AT, SLOTS = 24116, 24156, (1, 2, 3, 6, 7)
PENDING = ("fcp_current_t0", "fcp_current_end", "prim_l0_v", "dead_time_corrected", "qsa_corrected")
# Plausible ranges that tell a known layout.
PLAUSIBLE = {"cs_hv_v": (7600, "<i", 1000, 15000), "ionizer_mA": (24084, "<d", 0.001, 10.0), "mass_row_0": (4284, "<d", 1.0, 300.0)}


def scalar(data: bytes, at: int, fmt: str):
    """The value at an offset; None past the end."""
    return struct.unpack_from(fmt, data, at)[0] if 0 <= at <= len(data) - struct.calcsize(fmt) else None


def text(data: bytes, at: int, size: int = 16) -> str:
    return data[at : at + size].split(b"\0")[0].decode("ascii", "replace").strip()


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) behind the first marker where both are plausible."""
    at = data.find(MARKER)
    while at >= 0:
        w, h = (scalar(data, at + k, "<I") for k in SIDE_AT)
        if w in SIDES and h in SIDES:
            return w, h
        at = data.find(MARKER, at + 1)
    raise ValueError("no image dimensions in the header")


def parse_header(data: bytes, file_size: int) -> dict:
    """Basic fields, channels and derived sizes.  The number of planes follows from the file's size and must come out whole."""
    data = data[:HEADER_BYTES]
    out = {k: scalar(data, at, fmt) for k, (at, fmt) in BASIC.items()} | {k: text(data, at, n) for k, (at, n) in TEXT.items()}
    width, height = image_size(data)
    raster = scalar(data, out["data_offset"] - RASTER_BEFORE_DATA, "<I") or 0
    plane_bytes = out["n_masses"] * width * height * 4
    if not plane_bytes or file_size < out["data_offset"] or (file_size - out["data_offset"]) % plane_bytes:
        raise ValueError("the file's size isn't a whole number of planes")
    channels = []
    for n in range(out["n_masses"]):
        nominal = scalar(data, NOMINAL_AT + n * MASS_STRIDE, "<d")
        channels.append({"ch_idx": n, "label": text(data, LABEL_AT + n * MASS_STRIDE) or "SE", "nom_mass": nominal if nominal is not None and 0 < nominal < 200 else 0.0})
    return out | {"width": width, "height": height, "raster_nm": raster, "pixel_nm": raster / width, "field_um": raster / 1000, "n_planes": (file_size - out["data_offset"]) // plane_bytes, "channels": channels}


def mass_rows(data: bytes, limit: int = MASS_ROWS) -> list[dict]:
    """Rows of the mass table that lie whole in the data."""
    out = []
    for k in range(limit):
        at = MASS_ROWS_AT + k * MASS_ROW_STRIDE
        if at + MASS_ROW_STRIDE > len(data):
            break
        out.append({"row_index": k} | {n: scalar(data, at + o, f) for n, (o, f) in MASS_ROW.items()})
    return out


def match_masses(rows: list[dict], nominal: list[float | None], tolerance: float = 0.05) -> dict[int, dict]:
    """Channel -> nearest row strictly within tolerance; zero and missing masses match nothing."""
    usable = [r for r in rows if r["mass_amu"]]
    out = {}
    for ch, mass in enumerate(nominal):
        near = [r for r in usable if mass and abs(r["mass_amu"] - mass) < tolerance]
        if near:
            out[ch] = min(near, key=lambda r: abs(r["mass_amu"] - mass))
    return out


def selectors(data: bytes) -> dict:
    """Positions, tables of five sizes, and the size at the position (counted from 1)."""
    out = {}
    for name, (at, tables) in SELECTORS.items():
        position = scalar(data, at, "<i")
        out[f"{name}_position"] = position
        for kind, start in tables.items():
            sizes = [v for v in (scalar(data, start + 4 * i, "<i") for i in range(5)) if v is not None]
            out[f"{name}_{kind}"] = sizes
            out[f"{name}_{kind.replace('s_um', '_um')}"] = sizes[position - 1] if position is not None and 1 <= position <= len(sizes) else None
    return out


def detectors(data: bytes, slots=SLOTS) -> dict[int, dict]:
    return {s: {"hv_v": scalar(data, DETECTOR_HV_AT + (s - 1) * 4, "<i"), "threshold_mv": scalar(data, DETECTOR_THRESHOLD_AT + (s - 1) * 8, "<d")} for s in slots}


def layout_problems(data: bytes) -> list[str]:
    """One line for each field outside its plausible range; none for a known layout."""
    out = []
    for name, (at, fmt, lo, hi) in PLAUSIBLE.items():
        v = scalar(data, at, fmt)
        if v is None or not lo <= v <= hi:
            out.append(f"{name} at {at} is {v}, outside {lo}..{hi}")
    return out


def full_metadata(data: bytes, nominal: list[float | None] | None = None, slots=SLOTS) -> dict:
    """All groups of the extended header; fields whose place isn't known are None."""
    data = data[:HEADER_BYTES]
    group = lambda fields: {k: scalar(data, at, fmt) for k, (at, fmt) in fields.items()}
    rows = mass_rows(data)
    matched = match_masses(rows, nominal) if nominal is not None else {r["row_index"]: r for r in rows}
    return {"basic": group({k: v for k, v in BASIC.items() if k not in ("data_offset", "n_masses")}), "bfield": group(BFIELD), "primary": group(PRIMARY), "secondary": group(SECONDARY), "mass_table": matched, "detectors": detectors(data, slots), "selectors": selectors(data), "pending": dict.fromkeys(PENDING), "layout_problems": layout_problems(data)}

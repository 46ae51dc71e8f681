"""Whole-image operators: a tile(acq_id, plane, channel, height, width, counts ARRAY) is one image and one unit of a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ionlake.functions import pixels as X
from ionlake.operators.image import ACQ, super_planes


def _image(pdf, column: str = "counts") -> np.ndarray:
    img = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
    img[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf[column]
    return img


# --- registration


def plane_shifts(voxels: DataFrame, reference: str, ref_plane: int = 0, bin_planes: int = 1, bin_apply: str = "same") -> DataFrame:
    """(acq_id, plane, dy, dx) from cross-correlation of the reference channel with its ref_plane-th (super-)plane.

    Planes are ranked from 0.  same: a plane takes its group's shift, trailing
    planes the last group's; interp: between the groups' centres by a straight
    line, constant outside, rounded half to even; super: shifts by super-plane.
    An acquisition without two whole groups gives no rows.
    """
    import pandas as pd

    if bin_apply not in ("same", "interp", "super") or bin_planes < 1:
        raise ValueError("bin_apply is same, interp or super; bin_planes is 1 or more")
    ranked = voxels.select(ACQ, "plane").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(ACQ).orderBy("plane")) - 1)
    held = voxels.filter(F.col("channel") == reference)
    images = super_planes(held, bin_planes).withColumnRenamed("super_plane", "g")
    if bin_planes > 1:
        enough = images.groupBy(ACQ).agg(F.max("g").alias("last")).filter("last >= 1").select(ACQ)
        images = images.join(enough, ACQ, "left_semi")
    part = lambda name, own: [F.col(f"{name}.{c}").alias(f"{own}{c}") for c in ("y", "x", "counts")]
    cells = F.collect_list(F.struct("y", "x", F.col("counts").cast("double").alias("counts"))).alias("img")
    tiles = images.groupBy(ACQ, "g").agg(cells)
    ref = images.filter(F.col("g") == ref_plane).groupBy(ACQ).agg(cells).select(ACQ, *part("img", "r"))
    tiles = tiles.select(ACQ, "g", *part("img", "i")).join(ref, ACQ)

    def shift(batches):
        for pdf in batches:
            rows = []
            for acq, g, iy, ix, iv, ry, rx, rv in zip(*(pdf[c] for c in (ACQ, "g", "iy", "ix", "icounts", "ry", "rx", "rcounts")), strict=True):
                shape = max(iy.max(), ry.max()) + 1, max(ix.max(), rx.max()) + 1
                a, b = np.zeros(shape), np.zeros(shape)
                a[ry, rx], b[iy, ix] = rv, iv
                rows.append((acq, int(g), *X.cross_correlation_shift(a, b)))
            yield pd.DataFrame(rows, columns=[ACQ, "g", "dy", "dx"])

    kind = voxels.schema[ACQ].dataType.simpleString()
    shifts = tiles.mapInPandas(shift, f"{ACQ} {kind}, g long, dy int, dx int")
    if bin_apply == "super":
        return shifts.select(ACQ, F.col("g").cast("int").alias("plane"), "dy", "dx")
    if bin_planes == 1 or bin_apply == "same":
        groups = shifts.groupBy(ACQ).agg(F.max("g").alias("last"))
        at = ranked.join(groups, ACQ).withColumn("g", F.least(F.floor(F.col("rank") / bin_planes), F.col("last")))
        return at.join(shifts, [ACQ, "g"]).select(ACQ, "plane", "dy", "dx")
    return interpolate_shifts(ranked, shifts.withColumn("centre", F.col("g") * bin_planes + (bin_planes - 1) / 2.0))


def interpolate_shifts(ranked: DataFrame, centres: DataFrame) -> DataFrame:
    """(acq_id, plane, dy, dx) of ranked(acq_id, plane, rank) between centres(acq_id, centre, dy, dx), as an as-of pair by window."""
    point = F.struct(F.col("centre"), F.col("dy").cast("double").alias("dy"), F.col("dx").cast("double").alias("dx"))
    both = ranked.select(ACQ, "plane", F.col("rank").cast("double").alias("at"), F.lit(1).alias("ask")).unionByName(centres.select(ACQ, F.col("centre").alias("at"), F.lit(0).alias("ask"), point.alias("p")), allowMissingColumns=True)
    w = Window.partitionBy(ACQ).orderBy("at", "ask")
    below, above = F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("p", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    held = both.withColumn("lo", below).withColumn("hi", above).filter("ask = 1")

    def value(c):
        t = (F.col("at") - F.col("lo.centre")) / (F.col("hi.centre") - F.col("lo.centre"))
        inner = F.when(F.col("hi.centre") > F.col("lo.centre"), F.col(f"lo.{c}") + t * (F.col(f"hi.{c}") - F.col(f"lo.{c}"))).otherwise(F.col(f"lo.{c}"))
        return F.rint(F.coalesce(inner, F.col(f"lo.{c}"), F.col(f"hi.{c}"))).cast("int")

    return held.select(ACQ, "plane", value("dy").alias("dy"), value("dx").alias("dx"))


def apply_shifts(voxels: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """voxels moved by their plane's shift; what leaves the field goes, what enters it is absent (zero)."""
    held = voxels.join(shifts, [ACQ, "plane"]).withColumn("y", F.col("y") + F.col("dy")).withColumn("x", F.col("x") + F.col("dx")).drop("dy", "dx")
    return held.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def drift_range(shifts: DataFrame) -> DataFrame:
    return shifts.groupBy(ACQ).agg(*(f(c).alias(f"{n}_{c}") for c in ("dy", "dx") for f, n in ((F.min, "min"), (F.max, "max"))))


# --- regions


def _per_image(image: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in image.schema}
    return image.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def detect_regions(image: DataFrame, channel: str, method: str = "otsu", sigma: float = 1.0, percentile: float = 90.0, min_area: int = 25, keep: int = 50, merge: bool = False) -> DataFrame:
    """roi_pixels of detected regions, 4-connected, largest first as r1, r2, ..., or all as edge_all (merge)."""
    import pandas as pd

    def run(pdf):
        binary = X.detect(_image(pdf), method, sigma, percentile)
        lab = binary.astype(int) if merge else X.label(binary, 4)
        area = np.bincount(lab.ravel())[1:]
        order = [i + 1 for i in np.argsort(-area, kind="stable") if merge or area[i] >= min_area][:keep]
        parts = []
        for j, i in enumerate(order, 1):
            y, x = np.nonzero(lab == i)
            parts.append(pd.DataFrame({ACQ: pdf[ACQ].iloc[0], "roi": "edge_all" if merge else f"r{j}", "y": y.astype(np.int32), "x": x.astype(np.int32)}))
        return pd.concat(parts) if parts else pd.DataFrame({ACQ: [], "roi": [], "y": [], "x": []})

    return _per_image(image.filter(F.col("channel") == channel), [ACQ], run, "roi string, y int, x int")


def components(roi_pixels: DataFrame, connectivity: int = 8, min_pixels: int = 1) -> DataFrame:
    """(acq_id, roi, region, y, x): connected parts of each ROI's mask of min_pixels or more, numbered from 1 in scan order."""
    import pandas as pd

    def run(pdf):
        mask = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), bool)
        mask[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = True
        lab = X.label(mask, connectivity)
        big = np.flatnonzero(np.bincount(lab.ravel()) >= min_pixels)
        y, x = np.nonzero(np.isin(lab, big[big > 0]))
        return pd.DataFrame({ACQ: pdf[ACQ].iloc[0], "roi": pdf["roi"].iloc[0], "region": lab[y, x].astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return _per_image(roi_pixels, [ACQ, "roi"], run, "region int, y int, x int")


def mask_contours(roi_pixels: DataFrame, pixel_um: float | None = None) -> DataFrame:
    """(acq_id, roi, line, points): outlines at half height; with pixel_um in micrometres from the field's corner, half a pixel on."""
    import pandas as pd

    def run(pdf):
        mask = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), bool)
        mask[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = True
        lines = X.contours(mask)
        pts = [[{"y": float(p[0]), "x": float(p[1])} for p in ((line + 0.5) * pixel_um if pixel_um else line)] for line in lines]
        return pd.DataFrame({ACQ: pdf[ACQ].iloc[0], "roi": pdf["roi"].iloc[0], "line": range(len(pts)), "points": pts})

    return _per_image(roi_pixels, [ACQ, "roi"], run, "line int, points array<struct<y:double,x:double>>")


FILTERS = {"median": lambda img, s: X.median2d(img, int(s)), "gaussian": X.smooth2d, "sobel": lambda img, s: X.sobel(img)[0], "canny": lambda img, s: X.canny(img, s).astype(float)}


def display_filter(image: DataFrame, kind: str, size: float = 3) -> DataFrame:
    """image(acq_id, channel, y, x, counts) after a display filter: median (window), gaussian or canny (sigma), sobel."""
    import pandas as pd

    def run(pdf):
        out = FILTERS[kind](_image(pdf), size)
        y, x = np.indices(out.shape)
        return pd.DataFrame({ACQ: pdf[ACQ].iloc[0], "channel": pdf["channel"].iloc[0], "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "counts": out.ravel()})

    return _per_image(image, [ACQ, "channel"], run, "y int, x int, counts double")

"""Relational operators on voxels(acq_id, plane, channel, y, x, counts).

One voxel has one row; tables with several are summed first by `voxel_sums`.
Every operator groups and joins by acq_id, so any number of acquisitions is one
query.  A masked value is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

ACQ = "acq_id"
PIXEL = (ACQ, "y", "x")
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
COMPARE = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}


def voxel_sums(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(ACQ, "plane", "channel", "y", "x").agg(F.sum("counts").cast("double").alias("counts"))


# --- planes


def plane_totals(voxels: DataFrame, channel: str | None = None) -> DataFrame:
    """(acq_id, plane, total): counts by plane, of all channels or one."""
    held = voxels if channel is None else voxels.filter(F.col("channel") == channel)
    return held.groupBy(ACQ, "plane").agg(F.sum("counts").cast("double").alias("total"))


def plane_qc(voxels: DataFrame, threshold_pct: float = 30, channel: str | None = None) -> DataFrame:
    """(acq_id, plane, total, median, deviation, suspect): deviation is |total - median| / max(median, 1).

    An acquisition of fewer than two planes has no verdict (NULL).
    """
    totals = plane_totals(voxels, channel)
    centre = totals.groupBy(ACQ).agg(F.median("total").alias("median"), F.count("*").alias("planes"))
    deviation = F.abs(F.col("total") - F.col("median")) / F.greatest(F.col("median"), F.lit(1.0))
    out = totals.join(centre, ACQ).withColumn("deviation", F.when(F.col("planes") >= 2, deviation))
    return out.select(ACQ, "plane", "total", "median", "deviation", (F.col("deviation") > threshold_pct / 100).alias("suspect"))


def renumber_planes(voxels: DataFrame) -> DataFrame:
    """Planes counted from 0 in order; the former number stays as orig_plane."""
    planes = voxels.select(ACQ, "plane").distinct()
    planes = planes.withColumn("renumbered", F.row_number().over(Window.partitionBy(ACQ).orderBy("plane")) - 1)
    if "orig_plane" not in voxels.columns:
        voxels = voxels.withColumn("orig_plane", F.col("plane"))
    return voxels.join(planes, [ACQ, "plane"]).withColumn("plane", F.col("renumbered")).drop("renumbered")


def drop_planes(voxels: DataFrame, bad: DataFrame, renumber: bool = True) -> DataFrame:
    """voxels without the planes of bad(acq_id, plane); unknown and repeated ones are ignored.

    An acquisition that would lose all its planes keeps them all.
    """
    planes = voxels.select(ACQ, "plane").distinct().join(bad.select(ACQ, "plane").distinct().withColumn("bad", F.lit(True)), [ACQ, "plane"], "left")
    left = planes.groupBy(ACQ).agg(F.count(F.when(F.col("bad").isNull(), 1)).alias("left")).filter("left > 0").select(ACQ)
    gone = planes.filter("bad").join(left, ACQ, "left_semi").select(ACQ, "plane")
    out = voxels.join(gone, [ACQ, "plane"], "left_anti")
    return renumber_planes(out) if renumber else out


def auto_drop(voxels: DataFrame, threshold_pct: float = 30, channel: str | None = None, renumber: bool = True) -> DataFrame:
    """voxels without suspect planes (see plane_qc and drop_planes)."""
    return drop_planes(voxels, plane_qc(voxels, threshold_pct, channel).filter("suspect"), renumber)


def super_planes(voxels: DataFrame, n: int) -> DataFrame:
    """Sums of n consecutive planes (by rank); a trailing partial group is left out."""
    planes = voxels.select(ACQ, "plane").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(ACQ).orderBy("plane")) - 1)
    whole = planes.groupBy(ACQ).agg(F.floor(F.count("*") / n).alias("groups"))
    planes = planes.join(whole, ACQ).withColumn("super_plane", F.floor(F.col("rank") / n)).filter("super_plane < groups").select(ACQ, "plane", "super_plane")
    return voxels.join(planes, [ACQ, "plane"]).groupBy(ACQ, "super_plane", "channel", "y", "x").agg(F.sum("counts").cast("double").alias("counts"))


def sum_stack(voxels: DataFrame) -> DataFrame:
    """(acq_id, channel, y, x, counts): sums over planes."""
    return voxels.groupBy(ACQ, "channel", "y", "x").agg(F.sum("counts").cast("double").alias("counts"))


def bin_sum(image: DataFrame, n: int) -> DataFrame:
    """Block sums of n x n pixels; rows and columns beyond the last whole block are cropped.

    n of 1 or less, or beyond a side, leaves an acquisition's pixels as they are.
    """
    if n <= 1:
        return image
    size = image.groupBy(ACQ).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    held = image.join(size, ACQ)
    fits = (F.col("h") >= n) & (F.col("w") >= n)
    held = held.filter(~fits | ((F.col("y") < F.expr(f"h div {n} * {n}")) & (F.col("x") < F.expr(f"w div {n} * {n}"))))
    held = held.withColumn("y", F.when(fits, F.expr(f"y div {n}")).otherwise(F.col("y"))).withColumn("x", F.when(fits, F.expr(f"x div {n}")).otherwise(F.col("x")))
    keys = [c for c in (ACQ, "plane", "channel", "y", "x") if c in image.columns]
    return held.groupBy(*keys).agg(F.sum("counts").cast("double").alias("counts"))


# --- ratios


def ratio(voxels: DataFrame, numerator: str, denominator: str, min_counts: float | None = None, max_rel_err: float | None = None, sum_planes: bool = True, bin: int = 1) -> DataFrame:
    """(acq_id[, plane], y, x, a, b, ratio, sigma, rel_err, valid) with Poisson errors.

    Planes are summed before dividing.  valid: b > 0 and b >= min_counts, and
    rel_err <= max_rel_err where that is set; elsewhere ratio, sigma and rel_err
    are NULL.  With a = 0 and b > 0, ratio is 0, rel_err infinite and sigma NULL.
    One aggregation, no self-join.  bin applies to summed planes only.
    """
    held = voxels.filter(F.col("channel").isin(numerator, denominator))
    if sum_planes and bin > 1:
        held = bin_sum(sum_stack(held), bin)
    keys = PIXEL if sum_planes else (ACQ, "plane", "y", "x")
    part = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("counts"))), F.lit(0)).cast("double")
    out = held.groupBy(*keys).agg(part(numerator).alias("a"), part(denominator).alias("b"))
    a, b = F.col("a"), F.col("b")
    ok = (b > 0) & (b >= F.lit(float(min_counts or 0)))
    rel = F.when(ok & (a > 0), F.sqrt(1 / a + 1 / b)).when(ok, F.lit(float("inf")))
    out = out.withColumn("rel_err", rel)
    if max_rel_err is not None:
        ok = ok & (F.col("rel_err") <= max_rel_err)
    out = out.withColumn("valid", ok).withColumn("rel_err", F.when(F.col("valid"), F.col("rel_err")))
    out = out.withColumn("ratio", F.when(F.col("valid"), a / b))
    out = out.withColumn("sigma", F.when(F.col("valid") & (a > 0), F.col("ratio") * F.col("rel_err")))
    return out.select(*keys, "a", "b", "ratio", "sigma", "rel_err", "valid")


def delta(ratios: DataFrame, reference: float | None = None) -> DataFrame:
    """ratios with delta = (ratio / reference - 1) * 1000; without a reference, the acquisition's median ratio."""
    if reference is not None:
        return ratios.withColumn("delta", (F.col("ratio") / F.lit(float(reference)) - 1) * 1000)
    centre = ratios.groupBy(ACQ).agg(F.median("ratio").alias("reference"))
    return ratios.join(centre, ACQ).withColumn("delta", F.when(F.col("reference") != 0, (F.col("ratio") / F.col("reference") - 1) * 1000)).drop("reference")


def robust_range(values: DataFrame, column: str = "delta") -> DataFrame:
    """(acq_id, range): 2 * 1.4826 * MAD, the standard deviation where MAD is 0, at least 1."""
    centre = values.groupBy(ACQ).agg(F.median(column).alias("m"), F.stddev_pop(column).alias("sd"))
    mad = values.join(centre, ACQ).groupBy(ACQ).agg(F.median(F.abs(F.col(column) - F.col("m"))).alias("mad"), F.first("sd").alias("sd"))
    return mad.select(ACQ, F.greatest(F.when(F.col("mad") > 0, 2 * 1.4826 * F.col("mad")).otherwise(F.col("sd")), F.lit(1.0)).alias("range"))


def display_range(values: DataFrame, column: str, low: float = 1, high: float = 99, cap: float | None = None) -> DataFrame:
    """(acq_id, lo, hi): percentiles of finite values, hi at most cap."""
    finite = F.when(F.abs(column) < float("inf"), F.col(column))
    out = values.groupBy(ACQ).agg(F.percentile(finite, low / 100).alias("lo"), F.percentile(finite, high / 100).alias("hi"))
    return out if cap is None else out.withColumn("hi", F.least("hi", F.lit(float(cap))))


def bulk_ratio(voxels: DataFrame, numerator: str, denominator: str, reference: float | None = None, masked: DataFrame | None = None) -> DataFrame:
    """(acq_id, a, b, ratio, sigma[, delta, sigma_delta]) of all counts, without masks; NULL where a total is 0 or less.

    masked(acq_id, y, x): only these pixels count instead.
    """
    held = voxels.filter(F.col("channel").isin(numerator, denominator))
    if masked is not None:
        held = held.join(masked.select(*PIXEL).distinct(), list(PIXEL), "left_semi")
    part = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("counts"))), F.lit(0)).cast("double")
    out = held.groupBy(ACQ).agg(part(numerator).alias("a"), part(denominator).alias("b"))
    ok = (F.col("a") > 0) & (F.col("b") > 0)
    out = out.withColumn("ratio", F.when(ok, F.col("a") / F.col("b"))).withColumn("sigma", F.when(ok, F.col("ratio") * F.sqrt(1 / F.col("a") + 1 / F.col("b"))))
    if reference is not None:
        r = F.lit(float(reference))
        out = out.withColumn("delta", (F.col("ratio") / r - 1) * 1000).withColumn("sigma_delta", F.col("sigma") / r * 1000)
    return out


def hsi(ratios: DataFrame, intensity: str = "denominator", ratio_min: float | None = None, ratio_max: float | None = None, scale_factor: float = 1.0, intensity_percentile: tuple[float, float] = (1, 99.5)) -> DataFrame:
    """(acq_id, y, x, hue, intensity): the numbers behind a hue-saturation-intensity image.

    hue: ratio between its 1st and 99th percentile, or the given limits over
    scale_factor, clipped to 0..1, 0 where masked; intensity: denominator,
    numerator or their sum between percentiles of its positive values, 0 where masked.
    """
    value = {"denominator": F.col("b"), "numerator": F.col("a"), "sum": F.col("a") + F.col("b")}[intensity]
    held = ratios.withColumn("i", value)
    low, high = intensity_percentile
    positive = F.when(F.col("i") > 0, F.col("i"))
    limits = held.groupBy(ACQ).agg(
        (F.lit(ratio_min / scale_factor) if ratio_min is not None else F.percentile("ratio", 0.01)).alias("r0"),
        (F.lit(ratio_max / scale_factor) if ratio_max is not None else F.percentile("ratio", 0.99)).alias("r1"),
        F.percentile(positive, low / 100).alias("i0"),
        F.percentile(positive, high / 100).alias("i1"),
    )
    held = held.join(limits, ACQ)
    clip = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col(lo)) / (F.col(hi) - F.col(lo))))).otherwise(0.0)
    hue = F.when(F.col("valid"), F.coalesce(clip(F.col("ratio"), "r0", "r1"), F.lit(0.0))).otherwise(0.0)
    level = F.when(F.col("valid"), F.coalesce(clip(F.col("i"), "i0", "i1"), F.lit(0.0))).otherwise(0.0)
    return held.select(*PIXEL, hue.alias("hue"), level.alias("intensity"))


def ratio_median_filter(ratios: DataFrame, k: int = 3) -> DataFrame:
    """(acq_id, y, x, ratio): median of the valid ratios in the k x k window, edges repeated; a masked pixel can be filled."""
    r = k // 2
    size = ratios.groupBy(ACQ).agg(F.max("y").alias("y1"), F.max("x").alias("x1"))
    # a pixel goes to the windows it lies in; at an edge it also stands for the r places beyond
    stands = lambda c, top: F.sequence(F.when(F.col(c) == 0, -r).otherwise(F.col(c)), F.when(F.col(c) == F.col(top), F.col(c) + r).otherwise(F.col(c)))
    windows = lambda c, top: F.filter(F.flatten(F.transform(stands(c, top), lambda v: F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda d: v - d))), lambda t: t.between(0, F.col(top)))
    sent = ratios.filter("ratio is not null").join(size, ACQ).select(ACQ, F.explode(windows("y", "y1")).alias("y"), "x", "x1", "ratio")
    sent = sent.select(ACQ, "y", F.explode(windows("x", "x1")).alias("x"), "ratio", F.lit(0).alias("own"))
    own = ratios.select(*PIXEL, F.lit(None).cast("double").alias("ratio"), F.lit(1).alias("own"))
    return sent.union(own).groupBy(*PIXEL).agg(F.median("ratio").alias("ratio"), F.max("own").alias("own")).filter("own = 1").drop("own")


# --- masks, regions


def mask_counts(image: DataFrame, channel: str, cutoff: float, cmp: str = ">=") -> DataFrame:
    """(acq_id, y, x) where the channel's summed counts compare to cutoff."""
    return image.filter((F.col("channel") == channel) & COMPARE[cmp](F.col("counts"), F.lit(cutoff))).select(*PIXEL)


def mask_percentile(image: DataFrame, channel: str, percentile: float, cmp: str = ">=") -> DataFrame:
    """As mask_counts, with the exact percentile over all pixels, zeros included, as cutoff."""
    if not 0 <= percentile <= 100:
        raise ValueError("percentile must be within 0..100")
    held = image.filter(F.col("channel") == channel)
    cut = held.groupBy(ACQ).agg(F.percentile("counts", percentile / 100).alias("cutoff"))
    return held.join(cut, ACQ).filter(COMPARE[cmp](F.col("counts"), F.col("cutoff"))).select(*PIXEL)


def mask_between(image: DataFrame, channel: str, lower: float | None, upper: float | None) -> DataFrame:
    """(acq_id, y, x) with lower <= counts < upper; None is open.  A mixture component lies between its adjacent crossings."""
    held = image.filter(F.col("channel") == channel)
    if lower is not None:
        held = held.filter(F.col("counts") >= lower)
    return (held if upper is None else held.filter(F.col("counts") < upper)).select(*PIXEL)


def mask_gmm_component(image: DataFrame, channel: str, thresholds: list[float], component: int | str = "highest") -> DataFrame:
    """mask_between the crossings around a component: its number from 0 in order of means, 'highest' or 'lowest'."""
    k = {"highest": len(thresholds), "lowest": 0}.get(component, component)
    if not 0 <= k <= len(thresholds):
        raise ValueError(f"component {component} of {len(thresholds) + 1}")
    return mask_between(image, channel, thresholds[k - 1] if k > 0 else None, thresholds[k] if k < len(thresholds) else None)


def rule_mask(image: DataFrame, rule: dict, thresholds: dict[str, list[float]] | None = None) -> DataFrame:
    """Mask of one rule: mode counts (cutoff, cmp), percentile (cutoff, cmp) or gmm (component)."""
    mode = rule.get("mode", "counts")
    if mode == "counts":
        return mask_counts(image, rule["channel"], rule["cutoff"], rule.get("cmp", ">="))
    if mode == "percentile":
        return mask_percentile(image, rule["channel"], rule["cutoff"], rule.get("cmp", ">="))
    if mode in ("gmm", "gmm_component"):
        label = rule["channel"].replace(" ", "")
        cuts = {k.replace(" ", ""): v for k, v in (thresholds or {}).items()}
        return mask_gmm_component(image, rule["channel"], cuts[label], rule.get("component", "highest"))
    raise ValueError(f"unknown mode {mode}")


def build_roi_masks(image: DataFrame, rules: list[dict], combine: str = "AND", thresholds: dict[str, list[float]] | None = None, min_pixels: int = 1) -> DataFrame:
    """roi_pixels(acq_id, roi, y, x) of every rule and of 'combined'.

    A rule without a name is rule_{i}; of two rules with one name the later
    gives the mask of that name, both enter the combination.
    """
    if combine not in ("AND", "OR"):
        raise ValueError("combine is AND or OR")
    masks = [rule_mask(image, r, thresholds) for r in rules]
    names = {r.get("name") or f"rule_{i}": m for i, (r, m) in enumerate(zip(rules, masks, strict=True))}
    both = reduce(lambda a, b: a.intersect(b) if combine == "AND" else a.union(b).distinct(), masks)
    parts = [m.withColumn("roi", F.lit(n)) for n, m in {**names, "combined": both}.items()]
    out = reduce(DataFrame.unionByName, parts).select(ACQ, "roi", "y", "x")
    if min_pixels > 1:
        out = out.join(out.groupBy(ACQ, "roi").count().filter(F.col("count") >= min_pixels), [ACQ, "roi"], "left_semi")
    return out


def mask_not(image: DataFrame, mask: DataFrame) -> DataFrame:
    return image.select(*PIXEL).distinct().join(mask, list(PIXEL), "left_anti")


def union_rois(base: DataFrame, added: DataFrame, rename: bool = True) -> DataFrame:
    """ROIs of both; a name taken in the same acquisition gets the first _n that neither has (rename), or is overwritten."""
    if not rename:
        return base.join(added.select(ACQ, "roi").distinct(), [ACQ, "roi"], "left_anti").unionByName(added)
    names = added.select(ACQ, "roi").distinct()
    taken = base.select(ACQ, F.col("roi").alias("held")).distinct().withColumn("own", F.lit(True)).union(names.withColumn("own", F.lit(False)))
    same = taken.join(names, (taken[ACQ] == names[ACQ]) & (F.col("held").startswith(F.col("roi")))).select(taken[ACQ], "roi", "held", "own")
    used = same.groupBy(ACQ, "roi").agg(F.max(F.col("own") & (F.col("held") == F.col("roi"))).alias("clash"), F.collect_set(F.try_to_number(F.regexp_extract(F.expr("substring(held, length(roi) + 1)"), "^_([0-9]{1,9})$", 1), F.lit("999999999"))).alias("ns"))
    free = F.array_min(F.array_except(F.sequence(F.lit(2), F.size("ns") + 2), F.transform("ns", lambda v: v.cast("int"))))
    used = used.filter("clash").select(ACQ, "roi", F.concat_ws("_", "roi", free.cast("string")).alias("renamed"))
    return base.unionByName(added.join(used, [ACQ, "roi"], "left").withColumn("roi", F.coalesce("renamed", "roi")).drop("renamed"))


def roi_statistics(image: DataFrame, roi_pixels: DataFrame, rois: DataFrame | None = None) -> DataFrame:
    """(acq_id, roi, channel, n_pixels, fraction, mean, total, p5, p50, p95); total is cut to whole counts.

    rois(acq_id, roi): ROIs to list even when they have no pixel; those give one
    row with n_pixels 0 and NULL statistics.
    """
    everything = image.select(*PIXEL).distinct().groupBy(ACQ).agg(F.count("*").alias("all_pixels"))
    held = image.join(roi_pixels, list(PIXEL)).groupBy(ACQ, "roi", "channel").agg(
        F.count("*").alias("n_pixels"), F.avg("counts").alias("mean"), F.sum("counts").cast("long").alias("total"), F.percentile("counts", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p")
    )
    out = held.join(everything, ACQ).select(ACQ, "roi", "channel", "n_pixels", (F.col("n_pixels") / F.col("all_pixels")).alias("fraction"), "mean", "total", F.col("p")[0].alias("p5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"))
    if rois is not None:
        out = rois.select(ACQ, "roi").distinct().join(out, [ACQ, "roi"], "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0).cast("long")))
    return out


def pooled_ratio(image: DataFrame, roi_pixels: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """(acq_id, roi, n, d, ratio): sums over the ROI's pixels; NULL where d is 0."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("counts"))), F.lit(0)).cast("double")
    held = image.filter(F.col("channel").isin(numerator, denominator)).join(roi_pixels, list(PIXEL))
    out = held.groupBy(ACQ, "roi").agg(part(numerator).alias("n"), part(denominator).alias("d"))
    return out.withColumn("ratio", F.when(F.col("d") != 0, F.col("n") / F.col("d")))


def depth_profile(voxels: DataFrame, roi_pixels: DataFrame, channel: str, denominator: str | None = None, metric: str = "total") -> DataFrame:
    """(acq_id, roi, plane, value): the channel's sum by plane over the ROI's pixels.

    metric mean divides by the ROI's number of pixels; with a denominator the
    value is the ratio of sums, 0 where the denominator's is 0 or less.
    """
    held = voxels.join(roi_pixels, list(PIXEL))
    part = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("counts"))), F.lit(0)).cast("double")
    out = held.groupBy(ACQ, "roi", "plane").agg(part(channel).alias("n"), part(denominator or channel).alias("d"))
    if denominator is not None:
        return out.select(ACQ, "roi", "plane", F.when(F.col("d") > 0, F.col("n") / F.col("d")).otherwise(0.0).alias("value"))
    if metric == "mean":
        size = roi_pixels.groupBy(ACQ, "roi").agg(F.count("*").alias("size"))
        return out.join(size, [ACQ, "roi"]).select(ACQ, "roi", "plane", (F.col("n") / F.col("size")).alias("value"))
    return out.select(ACQ, "roi", "plane", F.col("n").alias("value"))


def roi_centroids(roi_pixels: DataFrame) -> DataFrame:
    return roi_pixels.groupBy(ACQ, "roi").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("area"))


def largest_regions(regions: DataFrame, min_area: int = 1, keep: int = 50, by: tuple[str, ...] = (ACQ,)) -> DataFrame:
    """The `keep` largest regions(acq_id, region, y, x) of min_area pixels or more, renamed r1, r2, ... by area."""
    area = regions.groupBy(*by, "region").agg(F.count("*").alias("area")).filter(F.col("area") >= min_area)
    rank = area.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("area"), "region"))).filter(F.col("rank") <= keep)
    named = rank.select(*by, "region", F.concat(F.lit("r"), F.col("rank")).alias("roi"))
    return regions.join(named, [*by, "region"]).select(*by, "roi", "y", "x")


# --- drawn shapes, over a grid of height x width pixels


def pixel_grid(spark, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def rasterise_rectangle(spark, height: int, width: int, x0: float, y0: float, x1: float, y1: float, flip: bool = True) -> DataFrame:
    """Pixels from floor of the lesser to ceiling of the greater corner, clamped; flip turns rows upside down."""
    lo, hi = (lambda a, b: F.floor(F.lit(float(min(a, b))))), (lambda a, b: F.ceil(F.lit(float(max(a, b)))))
    grid = pixel_grid(spark, height, width)
    held = grid.filter((F.col("x") >= lo(x0, x1)) & (F.col("x") < hi(x0, x1)) & (F.col("y") >= lo(y0, y1)) & (F.col("y") < hi(y0, y1)))
    return held.select((F.lit(height - 1) - F.col("y")).alias("y"), "x") if flip else held


def rasterise_ellipse(spark, height: int, width: int, x0: float, y0: float, x1: float, y1: float, flip: bool = True) -> DataFrame:
    """Pixels whose centre lies in the ellipse inscribed in the rectangle."""
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) / 2, abs(y1 - y0) / 2
    grid = pixel_grid(spark, height, width)
    if not rx or not ry:
        return grid.filter(F.lit(False))
    held = grid.filter(F.pow((F.col("x") + 0.5 - cx) / rx, 2) + F.pow((F.col("y") + 0.5 - cy) / ry, 2) <= 1)
    return held.select((F.lit(height - 1) - F.col("y")).alias("y"), "x") if flip else held


def rasterise_polygon(spark, height: int, width: int, points: list[tuple[float, float]], flip: bool = True) -> DataFrame:
    """Pixels whose centre lies inside the closed polygon of (x, y) corners, by even crossings; under three corners none."""
    grid = pixel_grid(spark, height, width)
    if len(points) < 3:
        return grid.filter(F.lit(False))
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    crossings: Column = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        if ay != by:
            crosses = ((F.lit(ay) > py) != (F.lit(by) > py)) & (px < (F.lit(bx - ax) * (py - ay) / F.lit(by - ay) + ax))
            crossings = crossings + crosses.cast("int")
    held = grid.filter(crossings % 2 == 1)
    return held.select((F.lit(height - 1) - F.col("y")).alias("y"), "x") if flip else held


# --- volume


def point_cloud(voxels: DataFrame, channel: str, percentile: float, cap: int | None = 60_000, seed: int = 0) -> DataFrame:
    """Voxels strictly above the channel's percentile over all its voxels; over cap in an acquisition, a seeded hash order picks them (a display cap)."""
    held = voxels.filter(F.col("channel") == channel)
    cut = held.groupBy(ACQ).agg(F.percentile("counts", percentile / 100).alias("cutoff"))
    out = held.join(cut, ACQ).filter("counts > cutoff").select(ACQ, "plane", "y", "x", "counts")
    if cap is None:
        return out
    order = Window.partitionBy(ACQ).orderBy(F.xxhash64("plane", "y", "x", F.lit(seed)), "plane", "y", "x")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).drop("place")


def iso_levels(voxels: DataFrame, channel: str, n: int) -> DataFrame:
    """(acq_id, levels, spacing): n levels evenly from the median to the 99.5th percentile of positive counts."""
    held = voxels.filter((F.col("channel") == channel) & (F.col("counts") > 0)).groupBy(ACQ).agg(F.percentile("counts", 0.5).alias("lo"), F.percentile("counts", 0.995).alias("hi"))
    spacing = (F.col("hi") - F.col("lo")) / max(n - 1, 1)
    return held.select(ACQ, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("lo") + i * spacing).alias("levels"), spacing.alias("spacing"))


def iso_shells(voxels: DataFrame, channel: str, n: int = 4, band: float = 0.12) -> DataFrame:
    """(acq_id, level, plane, y, x, counts): positive voxels within band * spacing of a level."""
    levels = iso_levels(voxels, channel, n)
    held = voxels.filter((F.col("channel") == channel) & (F.col("counts") > 0)).join(levels, ACQ)
    held = held.select(ACQ, "plane", "y", "x", "counts", "spacing", F.posexplode("levels").alias("level", "value"))
    return held.filter(F.abs(F.col("counts") - F.col("value")) <= band * F.col("spacing")).select(ACQ, "level", "plane", "y", "x", "counts")


def decimation_step(planes: int, height: int, width: int, cap: int = 200_000) -> int:
    """Smallest step with planes * height * width / step**2 <= cap."""
    step = 1
    while planes * height * width / step**2 > cap:
        step += 1
    return step


def decimate(voxels: DataFrame, step: int) -> DataFrame:
    return voxels.filter((F.col("y") % step == 0) & (F.col("x") % step == 0))


def voxel_coordinates(voxels: DataFrame, field_um: float, width: int, height: int) -> DataFrame:
    """voxels with x_um and y_um: index / (side - 1) * field."""
    return voxels.withColumn("x_um", F.col("x") / F.lit(max(width - 1, 1)) * field_um).withColumn("y_um", F.col("y") / F.lit(max(height - 1, 1)) * field_um)


# --- panels: the numbers behind figures


def panel(voxels: DataFrame, kind: str, numerator: str, denominator: str | None = None, reference: float | None = None, min_counts: float | None = None, smooth: int = 0, roi_pixels: DataFrame | None = None) -> DataFrame:
    """(acq_id, y, x, value[, level][, roi]) of one figure panel.

    kind channel: summed counts; ratio; delta (an explicit reference is needed);
    hsi: hue as value and intensity as level.  smooth: window of a median filter
    over the ratio.  With roi_pixels, the ROI that holds the pixel, least name first.
    """
    if kind == "channel":
        out = sum_stack(voxels.filter(F.col("channel") == numerator)).select(*PIXEL, F.col("counts").alias("value"))
    else:
        image = ratio(voxels, numerator, denominator, min_counts)
        if smooth > 1:
            image = image.drop("ratio").join(ratio_median_filter(image, smooth), list(PIXEL)).withColumn("valid", F.col("ratio").isNotNull())
        if kind == "ratio":
            out = image.select(*PIXEL, F.col("ratio").alias("value"))
        elif kind == "delta":
            if reference is None:
                raise ValueError("a delta panel needs a reference")
            out = delta(image, reference).select(*PIXEL, F.col("delta").alias("value"))
        elif kind == "hsi":
            out = hsi(image).select(*PIXEL, F.col("hue").alias("value"), F.col("intensity").alias("level"))
        else:
            raise ValueError("kind is channel, ratio, delta or hsi")
    if roi_pixels is None:
        return out
    return out.join(roi_pixels.groupBy(*PIXEL).agg(F.min("roi").alias("roi")), list(PIXEL), "left")


def stack_summary(voxels: DataFrame) -> DataFrame:
    """(acq_id, channel, planes, height, width, total, top): what a stack holds, by channel."""
    return voxels.groupBy(ACQ, "channel").agg(F.countDistinct("plane").alias("planes"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sum("counts").cast("double").alias("total"), F.max("counts").cast("double").alias("top"))

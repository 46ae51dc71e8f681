"""Spectra: spectrum(scan_id, m, counts).  Ordered operators are window expressions by scan; fits run a scan to a task.

A scan is one instrument sweep of some thousand points, so a scan's rows fit one
task by their nature; scans are many and independent.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ionlake.functions import peaks as P

SCAN = "scan_id"


def _by_m() -> Window:
    return Window.partitionBy(SCAN).orderBy("m")


def window_of(spectrum: DataFrame, low: float, high: float, least: int = 5) -> DataFrame:
    """Points within low..high (all when high <= low) of scans that have `least` of them."""
    if high <= low:
        return spectrum
    held = spectrum.filter(F.col("m").between(low, high))
    return held.withColumn("n", F.count("*").over(Window.partitionBy(SCAN))).filter(F.col("n") >= least).drop("n")


def zero_floor(spectrum: DataFrame, floor: float = 1e-3) -> DataFrame:
    """NULL, NaN and counts under floor become 0."""
    c = F.col("counts")
    return spectrum.withColumn("counts", F.when(c.isNull() | F.isnan(c) | (c < floor), 0.0).otherwise(c))


def level_crossings(spectrum: DataFrame, level: Column | float) -> DataFrame:
    """(scan_id, m): first place where counts meet level, between neighbours by a straight line."""
    level = F.lit(level) if isinstance(level, int | float) else level
    w = _by_m()
    held = spectrum.select(SCAN, "m", "counts", F.lag("m").over(w).alias("m0"), F.lag("counts").over(w).alias("c0"), level.cast("double").alias("level"))
    hit = held.filter("(c0 - level) * (counts - level) <= 0 and counts <> c0")
    at = F.col("m0") + (F.col("level") - F.col("c0")) / (F.col("counts") - F.col("c0")) * (F.col("m") - F.col("m0"))
    return hit.groupBy(SCAN).agg(F.min_by(at, "m").alias("m"))


def edge_levels(spectrum: DataFrame) -> DataFrame:
    """(scan_id, peak, base, plateau): place of the maximum, median of the first tenth (three points at least), median of the peak and two points each side."""
    w = _by_m()
    n = F.count("*").over(Window.partitionBy(SCAN))
    held = spectrum.select(SCAN, "m", "counts", (F.row_number().over(w) - 1).alias("i"), n.alias("n"))
    top = held.groupBy(SCAN).agg(F.max_by(F.struct("i", "m"), F.struct("counts", -F.col("i"))).alias("top"))
    held = held.join(top, SCAN)
    tenth = F.greatest(F.lit(3), F.floor(F.col("n") / 10))
    return held.groupBy(SCAN).agg(F.first("top.m").alias("peak"), F.median(F.when(F.col("i") < tenth, F.col("counts"))).alias("base"), F.median(F.when(F.abs(F.col("i") - F.col("top.i")) <= 2, F.col("counts"))).alias("plateau"))


def resolving_power(spectrum: DataFrame, side: str = "rising", reference: float | None = None) -> DataFrame:
    """(scan_id, dm, mrp, m10, m90, peak, mass): M over the 10-90 % width of one edge; scans without both crossings are left out."""
    levels = edge_levels(spectrum).withColumn("amp", F.greatest(F.col("plateau") - F.col("base"), F.lit(1e-9)))
    held = spectrum.join(levels, SCAN).filter(F.col("m") <= F.col("peak") if side == "rising" else F.col("m") >= F.col("peak"))
    cross = lambda q, name: level_crossings(held, F.col("base") + q * F.col("amp")).withColumnRenamed("m", name)
    out = cross(0.1, "m10").join(cross(0.9, "m90"), SCAN).join(levels.select(SCAN, "peak"), SCAN)
    rounded = F.abs(F.rint("peak"))
    mass = F.lit(float(reference)) if reference else F.when(rounded != 0, rounded).otherwise(F.abs("peak"))
    out = out.withColumn("dm", F.abs(F.col("m90") - F.col("m10"))).withColumn("mass", mass)
    return out.select(SCAN, "dm", F.when(F.col("dm") > 0, F.col("mass") / F.col("dm")).alias("mrp"), "m10", "m90", "peak", "mass")


def gradient(spectrum: DataFrame) -> DataFrame:
    """(scan_id, m, gradient): second-order differences on an uneven grid, first-order at the ends."""
    w = _by_m()
    m, c = F.col("m"), F.col("counts")
    h0, h1 = m - F.lag("m").over(w), F.lead("m").over(w) - m
    g0, g1 = c - F.lag("counts").over(w), F.lead("counts").over(w) - c
    inner = (g1 * h0 * h0 + g0 * h1 * h1) / (h0 * h1 * (h0 + h1))
    held = spectrum.select(SCAN, "m", h0.alias("h0"), h1.alias("h1"), g0.alias("g0"), g1.alias("g1"), inner.alias("inner"))
    value = F.when(F.col("h0").isNull(), F.col("g1") / F.col("h1")).when(F.col("h1").isNull(), F.col("g0") / F.col("h0")).otherwise(F.col("inner"))
    return held.select(SCAN, "m", value.alias("gradient"))


def moving_average(spectrum: DataFrame, n: int = 3) -> DataFrame:
    """counts as the sum of n neighbours over n, as if zeros lay beyond the ends."""
    half = n // 2
    return spectrum.withColumn("counts", F.sum("counts").over(_by_m().rowsBetween(-half, n - 1 - half)) / n)


def moments(spectrum: DataFrame) -> DataFrame:
    """(scan_id, centre, fwhm, skew, kurtosis) with counts as weights, negative ones as 0; NULL where undefined."""
    held = spectrum.withColumn("w", F.greatest("counts", F.lit(0.0)))
    first = held.groupBy(SCAN).agg(F.sum("w").alias("total"), F.sum(F.col("m") * F.col("w")).alias("mw"), F.max("w").alias("top"), F.count("*").alias("n")).filter("total > 0 and n >= 3").withColumn("centre", F.col("mw") / F.col("total"))
    held = held.join(first, SCAN)
    second = held.groupBy(SCAN).agg(F.first("centre").alias("centre"), F.first("total").alias("total"), *(F.sum(F.pow(F.col("m") - F.col("centre"), k) * F.col("w")).alias(f"m{k}") for k in (2, 3, 4)), *(f(F.when(F.col("w") >= F.col("top") / 2, F.col("m"))).alias(a) for f, a in ((F.min, "lo"), (F.max, "hi"))))
    sd = F.sqrt(F.col("m2") / F.col("total"))
    high = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    return second.select(SCAN, "centre", high.alias("fwhm"), F.when(F.col("m2") > 0, F.col("m3") / F.col("total") / F.pow(sd, 3)).alias("skew"), F.when(F.col("m2") > 0, F.col("m4") / F.col("total") / F.pow(sd, 4) - 3).alias("kurtosis"))


def local_maxima(spectrum: DataFrame, height: float = 0.0) -> DataFrame:
    """Points over both neighbours and at least `height` high (candidates; the kernels also apply distance and prominence)."""
    w = _by_m()
    held = spectrum.withColumn("c0", F.lag("counts").over(w)).withColumn("c1", F.lead("counts").over(w))
    return held.filter((F.col("counts") > F.col("c0")) & (F.col("counts") > F.col("c1")) & (F.col("counts") >= height)).drop("c0", "c1")


def find_maxima(spectrum: DataFrame, height: float = 0.0, distance: int = 1, prominence: float | None = None) -> DataFrame:
    """(scan_id, m, counts) of local maxima at least `height` high, `distance` points apart (the higher stays) and as prominent as `prominence`; a plateau's middle counts."""
    return _per_scan(spectrum, lambda m, c, _: [{"m": float(m[i]), "counts": float(c[i])} for i in P.local_maxima(c, height, distance, prominence)], "m double, counts double")


def gap_cluster(points: DataFrame, radius: float, by: str = SCAN, position: str = "m", weight: str = "counts") -> DataFrame:
    """(by, cluster, centre, total, n): groups split where the gap is over radius, with weighted centres; groups without positive weight go."""
    w = Window.partitionBy(by).orderBy(position)
    held = points.withColumn("new", (F.col(position) - F.lag(position).over(w) > radius).cast("int"))
    held = held.withColumn("cluster", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = held.groupBy(by, "cluster").agg(F.sum(weight).alias("total"), F.sum(F.col(position) * F.col(weight)).alias("moment"), F.count("*").alias("n")).filter("total > 0")
    return out.select(by, "cluster", (F.col("moment") / F.col("total")).alias("centre"), "total", "n")


def selection_counts(atoms: DataFrame, step: float) -> DataFrame:
    """(scan_id, bin, count, position, amplitude) of atoms(scan_id, position, amplitude): bins by half-even rounding."""
    return atoms.groupBy(SCAN, F.rint(F.col("position") / step).cast("long").alias("bin")).agg(F.count("*").alias("count"), F.avg("position").alias("position"), F.max("amplitude").alias("amplitude"))


def merge_near(peaks: DataFrame, radius: float) -> DataFrame:
    """(scan_id, mu, a): peaks in order, each folded into the one before while nearer than radius to its merged centre."""
    rows = peaks.groupBy(SCAN).agg(F.array_sort(F.collect_list(F.struct(F.col("mu").cast("double").alias("mu"), F.col("a").cast("double").alias("a")))).alias("ps"))
    empty = F.array().cast("array<struct<mu:double,a:double>>")

    def fold(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        near = last.isNotNull() & (p["mu"] - last["mu"] < radius)
        total = last["a"] + p["a"]
        mu = F.when(total > 0, (last["mu"] * last["a"] + p["mu"] * p["a"]) / total).otherwise((last["mu"] + p["mu"]) / 2)
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(mu.alias("mu"), total.alias("a"))))).otherwise(F.concat(acc, F.array(p)))

    return rows.select(SCAN, F.explode(F.aggregate("ps", empty, fold)).alias("p")).select(SCAN, "p.mu", "p.a")


# --- fits: one scan, or one scan and setting, a task

FIT = "peaks array<struct<mu:double,a:double,mu_se:double,a_se:double>>, w double, sigma double, chi2 double, bic double, aic double, n_data int, n_params int, success boolean"


def _per_scan(spectrum: DataFrame, run, schema: str, by: tuple[str, ...] = (SCAN,)) -> DataFrame:
    import pandas as pd

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        keys = {k: pdf[k].iloc[0] for k in by}
        rows = [keys | r for r in run(pdf["m"].to_numpy(float), np.nan_to_num(pdf["counts"].to_numpy(float)), keys)]
        names = [*by, *(c.split()[0] for c in _fields(schema))]
        return pd.DataFrame(rows, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in spectrum.schema}
    return spectrum.groupBy(*by).applyInPandas(group, ", ".join(f"{k} {kinds[k]}" for k in by) + ", " + schema)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def gaussian_smooth(spectrum: DataFrame, sigma: float) -> DataFrame:
    """(scan_id, m, counts) after a Gaussian of `sigma` points, edges reflected."""
    return _per_scan(spectrum, lambda m, c, _: [{"m": a, "counts": b} for a, b in zip(m.tolist(), P.gaussian_smooth(c, sigma).tolist(), strict=True)], "m double, counts double")


def fit_edges(spectrum: DataFrame, side: str = "rising") -> DataFrame:
    return _per_scan(spectrum, lambda m, c, _: [P.fit_edge(m, c, side)], "sigma double, mu double, amplitude double, baseline double, success boolean")


def deconvolve(spectrum: DataFrame, n: int) -> DataFrame:
    """Each scan fitted with n peaks of shared width and sigma."""
    return _per_scan(spectrum, lambda m, c, _: [P.fit_peaks(m, c, n)], FIT)


def deconvolve_sweep(spectrum: DataFrame, least: int = 1, most: int = 5) -> DataFrame:
    """Every scan with every number of peaks, each fit a task of its own; failed fits are left out."""
    tried = spectrum.withColumn("n", F.explode(F.sequence(F.lit(least), F.lit(most))))

    def run(m, c, keys):
        try:
            return [P.fit_peaks(m, c, int(keys["n"]))]
        except (ValueError, np.linalg.LinAlgError):
            return []

    return _per_scan(tried, run, FIT, (SCAN, "n"))


def best_by_bic(fits: DataFrame) -> DataFrame:
    return fits.groupBy(SCAN).agg(F.min_by(F.struct(*(c for c in fits.columns if c != SCAN)), F.struct("bic", "n")).alias("best")).select(SCAN, "best.*")


def stability_select(spectrum: DataFrame, w: float, sigma: float, step: float = 5e-4, n_lambdas: int = 30, lambdas: tuple[float, float] = (1.0, 1e4), l1_ratios: tuple[float, ...] = (1.0,), radius: float = 2e-3, threshold: float = 0.10, least: float = 0.001, signal: float = 0.005) -> DataFrame:
    """(scan_id, position, count, amplitude, selected): positions a non-negative sparse fit keeps choosing over its penalties.

    Every scan and penalty is a task; a second grouping by scan joins their few positions.
    """
    import pandas as pd

    grid = [(float(a), float(r)) for r in l1_ratios for a in np.logspace(np.log10(lambdas[0]), np.log10(lambdas[1]), n_lambdas)]
    tried = spectrum.withColumn("setting", F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(r).alias("l1")) for a, r in grid)))).select(SCAN, "m", "counts", "setting.alpha", "setting.l1")

    def run(m, c, keys):
        at, amp = P.sparse_fit(m, c, float(keys["alpha"]), float(keys["l1"]), w, sigma, step, radius, least)
        return [{"position": at.tolist(), "amplitude": amp.tolist()}]

    atoms = _per_scan(tried, run, "position array<double>, amplitude array<double>", (SCAN, "alpha", "l1"))
    kind = spectrum.schema[SCAN].dataType.simpleString()

    def pick(found: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("m")
        m, c = points["m"].to_numpy(float), points["counts"].to_numpy(float)
        rows = P.stable_positions([(np.asarray(at, float), np.asarray(amp, float)) for at, amp in zip(found["position"], found["amplitude"], strict=True)], m, c, w, sigma, step, radius, threshold, least, signal) if len(points) and len(found) else []
        out = pd.DataFrame(rows, columns=["position", "count", "amplitude", "selected"])
        out.insert(0, SCAN, points[SCAN].iloc[0] if len(points) else None)
        return out

    return atoms.groupBy(SCAN).cogroup(spectrum.select(SCAN, "m", "counts").groupBy(SCAN)).applyInPandas(pick, f"{SCAN} {kind}, position double, count int, amplitude double, selected boolean")


def deconvolve_sparse(spectrum: DataFrame, step: float = 5e-4, n_lambdas: int = 30, lambdas: tuple[float, float] = (1.0, 1e4), radius: float = 2e-3, threshold: float = 0.10) -> DataFrame:
    """Scans fitted with as many peaks as stability selection finds, after pruning; scans without a stable peak are left out."""
    alphas = np.logspace(np.log10(lambdas[0]), np.log10(lambdas[1]), n_lambdas)

    def run(m, c, _):
        w, sigma = P.peak_template(m, c)
        found = [P.sparse_fit(m, c, a, 1.0, w, sigma, step, radius, 0.001) for a in alphas]
        fit = P.refine_stable(m, c, P.stable_positions(found, m, c, w, sigma, step, radius, threshold), w, sigma)
        return [fit] if fit else []

    return _per_scan(spectrum, run, FIT)


LSF = "n_peaks int, slit_width double, dm double, mrp double, tail_low_ppm double, tail_high_ppm double, edges array<struct<side:string,centre:double,fwhm:double,skew:double,kurtosis:double,sigma:double,m10:double,m50:double,m90:double,distorted:boolean,x:array<double>,esf:array<double>,lsf:array<double>,frequency:array<double>,mtf:array<double>>>"


def line_spread(spectrum: DataFrame, smooth: float = 0.0, window: tuple[float, float] | None = None) -> DataFrame:
    """Edge, line spread and transfer functions of each scan's brightest peak (see the kernel); flat scans are left out."""

    def run(m, c, _):
        out = P.line_spread(m, c, smooth, window)
        return [out | {"edges": [{"side": s} | e for s, e in out["edges"].items()]}] if out else []

    return _per_scan(spectrum, run, LSF)

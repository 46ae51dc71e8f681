"""Distributions of summed counts: quantiles, histograms, mixtures, elbows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ionlake.functions import mixtures as M
from ionlake.operators.image import ACQ, PERCENTILES

COMPONENT = "struct<weight:double,mean_log10:double,std_log10:double,mean_counts:double,quantiles:map<int,double>>"
FIT = (
    f"frac_zeros double, frac_used double, n_used long, quantiles map<int,double>, fits array<struct<k:int,bic:double,aic:double,components:array<{COMPONENT}>,thresholds:array<double>>>, "
    "best_k_bic int, best_k_aic int, largest_drop_k int, kneedle_k int, sensible_k int, agree boolean, recommendations array<struct<k:int,methods:array<string>>>, "
    "tail_warning struct<suggested_k:int,weight:double,mean_counts:double,p5:double,p50:double,p95:double>"
)


def quantiles(image: DataFrame, drop_zeros: bool = True) -> DataFrame:
    """(acq_id, channel, percentile, value): exact quantiles of positive counts (or counts + 0.5), 0 where there are none."""
    value = F.when(F.col("counts") > 0, F.col("counts")) if drop_zeros else F.col("counts") + 0.5
    held = image.groupBy(ACQ, "channel").agg(F.percentile(value, F.array(*(F.lit(p / 100) for p in PERCENTILES))).alias("q"))
    pairs = F.explode(F.arrays_zip(F.array(*(F.lit(p) for p in PERCENTILES)).alias("p"), F.coalesce("q", F.array(*(F.lit(0.0) for _ in PERCENTILES))).alias("v")))
    return held.select(ACQ, "channel", pairs.alias("z")).select(ACQ, "channel", F.col("z.p").alias("percentile"), F.coalesce("z.v", F.lit(0.0)).alias("value"))


def density_histogram(image: DataFrame, bins: int = 80) -> DataFrame:
    """(acq_id, channel, bin, density) of log10 positive counts between their 0.5 and 99.5 percentiles, padded by 5 %."""
    held = image.filter("counts > 0").withColumn("v", F.log10("counts"))
    span = held.groupBy(ACQ, "channel").agg(F.percentile("v", 0.005).alias("a"), F.percentile("v", 0.995).alias("b"))
    pad = 0.05 * (F.col("b") - F.col("a"))
    span = span.select(ACQ, "channel", (F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi")).filter("hi > lo")
    held = held.join(span, [ACQ, "channel"]).filter("v >= lo and v <= hi").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    held = held.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int"))
    counts = held.groupBy(ACQ, "channel", "bin").agg(F.count("*").alias("n"), F.first("width").alias("width"))
    total = counts.groupBy(ACQ, "channel").agg(F.sum("n").alias("total"))
    return counts.join(total, [ACQ, "channel"]).select(ACQ, "channel", "bin", (F.col("n") / F.col("total") / F.col("width")).alias("density"))


def fit_mixtures(image: DataFrame, k_max: int = 6, drop_zeros: bool = True, seed: int = 0, jitter: bool = True, tail_weight: float = 0.15) -> DataFrame:
    """One row a channel with all its mixture fits and picks; under 50 values only the quantiles.  A channel's image fits one task."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        out = M.fit_channel(pdf["counts"], k_max, drop_zeros, seed, jitter, tail_weight)
        return pd.DataFrame([{ACQ: pdf[ACQ].iloc[0], "channel": pdf["channel"].iloc[0]} | out])

    kind = image.schema[ACQ].dataType.simpleString()
    return image.groupBy(ACQ, "channel").applyInPandas(run, f"{ACQ} {kind}, channel string, {FIT}")


def best_thresholds(fits: DataFrame, criterion: str = "sensible", manual_k: dict[str, int] | None = None) -> DataFrame:
    """(acq_id, channel, k, thresholds) by criterion sensible, bic or aic, with a channel's own k where manual_k has one."""
    k = F.col({"sensible": "sensible_k", "bic": "best_k_bic", "aic": "best_k_aic"}[criterion])
    for channel, own in (manual_k or {}).items():
        k = F.when(F.col("channel") == channel, own).otherwise(k)
    held = fits.withColumn("k", k).filter("k is not null")
    return held.select(ACQ, "channel", "k", F.element_at(F.filter("fits", lambda f: f["k"] == F.col("k")), 1)["thresholds"].alias("thresholds"))


def mixture_components(fits: DataFrame) -> DataFrame:
    """(acq_id, channel, k, component, weight, mean_counts, mean_log10, std_log10, p5, p50, p95), components from 0 by mean."""
    held = fits.select(ACQ, "channel", F.explode("fits").alias("f")).select(ACQ, "channel", "f.k", F.posexplode("f.components").alias("component", "c"))
    return held.select(ACQ, "channel", "k", "component", "c.weight", "c.mean_counts", "c.mean_log10", "c.std_log10", *(F.try_element_at("c.quantiles", F.lit(p)).alias(f"p{p}") for p in (5, 50, 95)))


def elbow_largest_drop(curves: DataFrame, by: str = "curve") -> DataFrame:
    """(by, k): k after the largest fall of curves(by, k, value)."""
    fall = F.col("value") - F.lag("value").over(Window.partitionBy(by).orderBy("k"))
    held = curves.withColumn("fall", fall)
    return held.groupBy(by).agg(F.coalesce(F.min_by("k", F.when(F.col("fall").isNotNull(), F.struct("fall", "k"))), F.min_by("k", F.struct("value", "k"))).alias("k"))


def elbow_chord(curves: DataFrame, by: str = "curve") -> DataFrame:
    """(by, k): k farthest from the chord between the ends on scaled axes; the least value's k for curves under three points or flat ones."""
    ends = curves.groupBy(by).agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("value").alias("v0"), F.max("value").alias("v1"), F.min_by("value", "k").alias("first"), F.max_by("value", "k").alias("last"), F.count("*").alias("n"))
    held = curves.join(ends, by)
    usable = (F.col("n") >= 3) & (F.col("k1") > F.col("k0")) & (F.col("v1") > F.col("v0"))
    far = F.abs((F.col("value") - F.col("first")) / (F.col("v1") - F.col("v0")) - (F.col("last") - F.col("first")) / (F.col("v1") - F.col("v0")) * (F.col("k") - F.col("k0")) / (F.col("k1") - F.col("k0")))
    score = F.when(usable, F.round(far, 12)).otherwise(-F.col("value"))
    return held.withColumn("score", score).groupBy(by).agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))


def recommendations(picks: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, k, methods) of picks(by, method, k): methods joined in the given order."""
    place = F.array_position(F.array(*(F.lit(m) for m in order)), F.col("method"))
    held = picks.filter("k is not null").groupBy(by, "k").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "method"))).alias("m"))
    return held.select(by, "k", F.array_join(F.transform("m", lambda s: s["method"]), ",").alias("methods"))

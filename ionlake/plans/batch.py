"""Batches of ratio analyses and the session factory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionlake.functions.tables import reference_ratio
from ionlake.operators import image as I


def session(app: str = "ionlake", **conf) -> SparkSession:
    """A session with adaptive plans and Arrow; resources come from the cluster."""
    held = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.appName(app).config(map=held | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()


def run_analyses(voxels: DataFrame, specs: list[dict]) -> DataFrame:
    """One row an acquisition and spec: bulk ratio, its error, reference, delta and median ratio.

    A spec has numerator and denominator, and may have name, reference,
    min_counts and max_rel_err.  The delta reference is the spec's, else the
    natural ratio of the pair, else the image's median ratio.
    """
    parts = []
    for k, s in enumerate(specs):
        num, den = s["numerator"], s["denominator"]
        known = s.get("reference") or reference_ratio(num, den)
        image = I.ratio(voxels, num, den, s.get("min_counts"), s.get("max_rel_err"))
        centre = image.groupBy(I.ACQ).agg(F.median("ratio").alias("median_ratio"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"))
        out = I.bulk_ratio(voxels, num, den).join(centre, I.ACQ).withColumn("reference", F.lit(float(known)) if known else F.col("median_ratio"))
        delta = F.when(F.col("reference") != 0, (F.col("ratio") / F.col("reference") - 1) * 1000)
        parts.append(out.select(I.ACQ, F.lit(k).alias("spec"), F.lit(s.get("name") or f"{num}/{den}").alias("name"), "a", "b", "ratio", "sigma", "reference", delta.alias("delta"), "median_ratio", "n_valid"))
    return reduce(DataFrame.unionByName, parts)


def report(results: DataFrame) -> DataFrame:
    """(acq_id, spec, line): run_analyses as text."""
    line = F.format_string("%s: %.6g +- %.2g, delta %.1f per mil", "name", "ratio", "sigma", "delta")
    return results.select(I.ACQ, "spec", F.when(F.col("ratio").isNull(), F.concat("name", F.lit(": N/A"))).otherwise(line).alias("line"))


def _line(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def roi_lines(stats: DataFrame) -> DataFrame:
    """(acq_id, roi, channel, line): roi_statistics as text; an empty ROI has one line."""
    text = _line("%s, %s: %d pixels (%.1f%%), mean %.1f, total %d", F.col("roi"), F.col("channel"), F.col("n_pixels"), F.round(F.col("fraction") * 100, 1), F.round("mean", 1), F.col("total"))
    return stats.select(I.ACQ, "roi", "channel", F.when(F.col("n_pixels") > 0, text).otherwise(F.concat("roi", F.lit(": empty"))).alias("line"))


def cluster_lines(labels: DataFrame) -> DataFrame:
    """(k, cluster, line): sizes and shares of the clusters of labels(k, ..., cluster)."""
    sizes = labels.groupBy("k", "cluster").agg(F.count("*").alias("size"))
    held = sizes.join(sizes.groupBy("k").agg(F.sum("size").alias("all")), "k")
    return held.select("k", "cluster", _line("cluster %d of %d: %d pixels (%.1f%%)", F.col("cluster"), F.col("k"), F.col("size"), F.round(F.col("size") / F.col("all") * 100, 1)).alias("line"))


def mixture_lines(components: DataFrame) -> DataFrame:
    """(acq_id, channel, k, component, line) of mixture_components."""
    text = _line("%s, component %d of %d: weight %.1f%%, mean %.4g, from %.4g to %.4g", F.col("channel"), F.col("component") + 1, F.col("k"), F.col("weight") * 100, F.col("mean_counts"), F.col("p5"), F.col("p95"))
    return components.select(I.ACQ, "channel", "k", "component", text.alias("line"))


def header_lines(headers: DataFrame) -> DataFrame:
    """(path, place, line): every field of read_headers that has a value, as 'name: value', then a line a channel and a line a layout problem."""
    plain = [f.name for f in headers.schema if f.name not in ("path", "channels", "full")]
    facts = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in plain)), lambda x: x["value"].isNotNull())
    lines = F.concat(
        F.transform(facts, lambda x: F.concat(F.replace(x["name"], F.lit("_"), F.lit(" ")), F.lit(": "), x["value"])),
        F.transform("channels", lambda c: F.format_string("channel %d: %s, nominal mass %s", c["ch_idx"], c["label"], c["nom_mass"].cast("string"))),
        F.transform(F.coalesce("full.layout_problems", F.array().cast("array<string>")), lambda x: F.concat(F.lit("layout: "), x)),
    )
    return headers.select("path", F.posexplode(lines).alias("place", "line"))


def text_table(table: DataFrame, order: list[str]) -> DataFrame:
    """(place, line): a header and the rows of a small table in order, columns parted by tabs, a missing value as N/A."""
    from pyspark.sql import Window

    cells = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in table.columns))
    body = table.select(F.row_number().over(Window.orderBy(*order)).alias("place"), cells.alias("line"))
    head = table.sparkSession.createDataFrame([(0, "\t".join(table.columns))], "place int, line string")
    return head.union(body)


# Lengths of scale bars in micrometres.
SCALE_BARS = (0.5, 1, 2, 5, 10, 20, 25, 50)


def nice_scale_bar(field_um: float) -> float:
    """The greatest round length under 0.4 of the field; the smallest where none is."""
    return max((s for s in SCALE_BARS if s < 0.4 * field_um), default=SCALE_BARS[0])

"""Registered queries over the driver's tables and their DuckDB oracles.

The tables hold no images, so `stack` lays lineitem out as one: planes are
months, channels return flags, pixels key residues, counts quantities; events by
hour are spectra, embeddings are features.  Floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionlake.functions import tables as T
from ionlake.operators import clusters as C, distributions as D, image as I, species as S, spectra as P, tiles as X
from ionlake.plans.batch import run_analyses
from ionlake.streaming.watch import sessions, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STACK = "SELECT 0 AS acq_id, CAST(year(l_shipdate)*12 + month(l_shipdate) AS INT) AS plane, l_returnflag AS channel, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_partkey % 16 AS INT) AS x, l_quantity AS counts FROM lineitem"
SPECTRUM = "SELECT event_type AS scan_id, CAST(hour(ts) AS DOUBLE) AS m, CAST(count(*) AS DOUBLE) AS counts FROM events GROUP BY 1, 2"
SUMMED = "SELECT acq_id, channel, y, x, sum(counts) AS counts FROM stack GROUP BY ALL"
RATIO = """SELECT *, CASE WHEN b > 0 THEN a/b END AS ratio, b > 0 AS valid FROM (
  SELECT acq_id, y, x, coalesce(sum(counts) FILTER (channel='A'),0) AS a, coalesce(sum(counts) FILTER (channel='N'),0) AS b FROM stack WHERE channel IN ('A','N') GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem")
    return held.select(F.lit(0).alias("acq_id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("plane"), F.col("l_returnflag").alias("channel"), (F.col("l_suppkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x"), F.col("l_quantity").alias("counts"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("scan_id"), F.hour("ts").cast("double").alias("m")).agg(F.count("*").cast("double").alias("counts"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"), "label")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) and its oracle, which may use the CTEs stack, summed, ratios and spectrum."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            named = {"stack": STACK, "summed": SUMMED, "ratios": RATIO, "spectrum": SPECTRUM}
            ORACLES[key] = "WITH RECURSIVE " * ("RECURSIVE" in sql) + "WITH " * ("RECURSIVE" not in sql) + ", ".join(f"{n} AS ({q})" for n, q in named.items()) + (", " + sql.removeprefix("WITH RECURSIVE ").removeprefix("WITH ") if sql.startswith("WITH") else " " + sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded; -0.0 as 0.0."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# --- planes


@query("SELECT acq_id, plane, CAST(sum(counts) AS DOUBLE) AS total FROM stack GROUP BY ALL")
def plane_totals(spark, sf):
    return I.plane_totals(stack(spark, sf))


QC = "q AS (SELECT acq_id, plane, sum(counts) AS total FROM stack GROUP BY ALL), m AS (SELECT median(total) AS median FROM q), qc AS (SELECT acq_id, plane, total, median, abs(total-median)/greatest(median,1) AS deviation, abs(total-median)/greatest(median,1) > 0.3 AS suspect FROM q, m)"


@query(f"WITH {QC} SELECT acq_id, plane, total, median, round(deviation,6) AS deviation, suspect FROM qc")
def plane_qc(spark, sf):
    return rounded(I.plane_qc(stack(spark, sf)))


@query(f"WITH {QC}, k AS (SELECT plane, CAST(row_number() OVER (ORDER BY plane) - 1 AS INT) AS r FROM qc WHERE NOT suspect) SELECT s.acq_id, k.r AS plane, s.channel, CAST(sum(counts) AS DOUBLE) AS counts, s.plane AS orig_plane FROM stack s JOIN k USING (plane) GROUP BY ALL")
def auto_drop(spark, sf):
    return I.auto_drop(stack(spark, sf)).groupBy("acq_id", "plane", "channel", "orig_plane").agg(F.sum("counts").alias("counts"))


@query("SELECT acq_id, plane, channel, CAST(sum(counts) AS DOUBLE) AS counts FROM stack WHERE plane % 7 <> 0 GROUP BY ALL")
def drop_planes(spark, sf):
    voxels = stack(spark, sf)
    bad = voxels.select("acq_id", "plane").distinct().filter("plane % 7 = 0")
    return I.drop_planes(voxels, bad, renumber=False).groupBy("acq_id", "plane", "channel").agg(F.sum("counts").alias("counts"))


@query("SELECT acq_id, plane, channel, y, x, CAST(sum(counts) AS DOUBLE) AS counts FROM stack WHERE channel='A' AND plane % 12 = 6 GROUP BY ALL")
def select_plane_channel(spark, sf):
    return I.voxel_sums(stack(spark, sf).filter("channel = 'A' and plane % 12 = 6"))


@query("WITH p AS (SELECT plane, row_number() OVER (ORDER BY plane) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT plane FROM stack)) SELECT acq_id, CAST(r // 5 AS BIGINT) AS super_plane, channel, y, x, CAST(sum(counts) AS DOUBLE) AS counts FROM stack JOIN p USING (plane) WHERE r // 5 < n // 5 GROUP BY ALL")
def super_planes(spark, sf):
    return I.super_planes(stack(spark, sf), 5)


@query("SELECT acq_id, channel, y, x, CAST(counts AS DOUBLE) AS counts FROM summed")
def sum_stack(spark, sf):
    return I.sum_stack(stack(spark, sf))


@query("SELECT acq_id, channel, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, CAST(sum(counts) AS DOUBLE) AS counts FROM summed WHERE y < 15 AND x < 15 GROUP BY ALL")
def bin_sum(spark, sf):
    out = I.bin_sum(I.sum_stack(stack(spark, sf)), 3)
    return out.withColumn("y", F.col("y").cast("int")).withColumn("x", F.col("x").cast("int"))


# --- ratios

ERRORS = "a, b, round(CASE WHEN ok THEN a/b END,6) AS ratio, round(CASE WHEN ok AND a>0 THEN a/b*sqrt(1/a+1/b) END,6) AS sigma, round(CASE WHEN ok AND a>0 THEN sqrt(1/a+1/b) WHEN ok THEN CAST('Infinity' AS DOUBLE) END,6) AS rel_err, ok AS valid"


@query(f"SELECT acq_id, y, x, {ERRORS} FROM (SELECT *, b>0 AS ok FROM ratios)")
def ratio(spark, sf):
    return rounded(I.ratio(stack(spark, sf), "A", "N"))


@query(f"SELECT acq_id, y, x, {ERRORS} FROM (SELECT *, b>=100 AND b>0 AND a>0 AND sqrt(1/nullif(a,0)+1/nullif(b,0))<=0.05 AS ok FROM ratios)")
def ratio_masked(spark, sf):
    return rounded(I.ratio(stack(spark, sf), "A", "N", min_counts=100, max_rel_err=0.05).withColumn("valid", F.coalesce("valid", F.lit(False))))


@query(f"WITH v AS (SELECT acq_id, plane, y, x, coalesce(sum(counts) FILTER (channel='A'),0) AS a, coalesce(sum(counts) FILTER (channel='R'),0) AS b FROM stack WHERE channel IN ('A','R') GROUP BY ALL) SELECT acq_id, plane, y, x, {ERRORS} FROM (SELECT *, b>0 AS ok FROM v)")
def ratio_per_plane(spark, sf):
    return rounded(I.ratio(stack(spark, sf), "A", "R", sum_planes=False))


@query(f"WITH v AS (SELECT acq_id, CAST(y//2 AS INT) AS y, CAST(x//2 AS INT) AS x, sum(a) AS a, sum(b) AS b FROM ratios GROUP BY ALL) SELECT acq_id, y, x, {ERRORS} FROM (SELECT *, b>0 AS ok FROM v)")
def ratio_binned(spark, sf):
    out = I.ratio(stack(spark, sf), "A", "N", bin=2)
    return rounded(out.withColumn("y", F.col("y").cast("int")).withColumn("x", F.col("x").cast("int")))


@query("WITH c AS (SELECT median(ratio) AS m FROM ratios) SELECT acq_id, y, x, round((ratio/m-1)*1000,4) AS delta FROM ratios, c")
def delta(spark, sf):
    return rounded(I.delta(I.ratio(stack(spark, sf), "A", "N")).select("acq_id", "y", "x", "delta"), 4)


@query("WITH c AS (SELECT median(ratio) AS m FROM ratios), d AS (SELECT (ratio/m-1)*1000 AS d FROM ratios, c), e AS (SELECT median(d) AS md, stddev_pop(d) AS sd FROM d), f AS (SELECT median(abs(d-md)) AS mad, any_value(sd) AS sd FROM d, e) SELECT 0 AS acq_id, round(greatest(CASE WHEN mad>0 THEN 2*1.4826*mad ELSE sd END, 1.0),4) AS range FROM f")
def delta_range(spark, sf):
    return rounded(I.robust_range(I.delta(I.ratio(stack(spark, sf), "A", "N"))), 4)


@query("SELECT 0 AS acq_id, round(quantile_cont(ratio,0.01),6) AS lo, round(least(quantile_cont(ratio,0.99),1.0),6) AS hi FROM ratios")
def display_range(spark, sf):
    return rounded(I.display_range(I.ratio(stack(spark, sf), "A", "N"), "ratio", cap=1.0))


@query("SELECT 0 AS acq_id, a, b, round(a/b,8) AS ratio, round(a/b*sqrt(1/a+1/b),8) AS sigma, round((a/b/0.9-1)*1000,4) AS delta, round(a/b*sqrt(1/a+1/b)/0.9*1000,4) AS sigma_delta FROM (SELECT CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM ratios)")
def bulk_ratio(spark, sf):
    out = I.bulk_ratio(stack(spark, sf), "A", "N", 0.9)
    return out.select("acq_id", "a", "b", *(F.round(c, d).alias(c) for c, d in (("ratio", 8), ("sigma", 8), ("delta", 4), ("sigma_delta", 4))))


@query("WITH l AS (SELECT quantile_cont(ratio,0.01) AS r0, quantile_cont(ratio,0.99) AS r1, quantile_cont(b,0.01) FILTER (b>0) AS i0, quantile_cont(b,0.995) FILTER (b>0) AS i1 FROM ratios) SELECT acq_id, y, x, round(CASE WHEN valid THEN least(1.0,greatest(0.0,(ratio-r0)/(r1-r0))) ELSE 0 END,6) AS hue, round(CASE WHEN valid THEN least(1.0,greatest(0.0,(b-i0)/(i1-i0))) ELSE 0 END,6) AS intensity FROM ratios, l")
def hsi(spark, sf):
    return rounded(I.hsi(I.ratio(stack(spark, sf), "A", "N")))


@query("WITH n AS (SELECT r.acq_id, r.y, r.x, least(15,greatest(0,r.y+dy)) AS ny, least(15,greatest(0,r.x+dx)) AS nx FROM ratios r, (SELECT unnest([-1,0,1]) AS dy), (SELECT unnest([-1,0,1]) AS dx)) SELECT n.acq_id, n.y, n.x, round(median(q.ratio),6) AS ratio FROM n JOIN ratios q ON q.y=n.ny AND q.x=n.nx GROUP BY ALL")
def ratio_median_filter(spark, sf):
    return rounded(I.ratio_median_filter(I.ratio(stack(spark, sf), "A", "N"), 3))


@query("SELECT 0 AS acq_id, 0 AS spec, 'A/N' AS name, a, b, round(a/b,8) AS ratio, round(a/b*sqrt(1/a+1/b),8) AS sigma, round(mr,8) AS reference, round((a/b/mr-1)*1000,4) AS delta, n AS n_valid FROM (SELECT CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b, median(ratio) AS mr, count(ratio) AS n FROM ratios)")
def batch_report(spark, sf):
    out = run_analyses(stack(spark, sf), [{"numerator": "A", "denominator": "N"}])
    return out.select("acq_id", "spec", "name", "a", "b", F.round("ratio", 8).alias("ratio"), F.round("sigma", 8).alias("sigma"), F.round("reference", 8).alias("reference"), F.round("delta", 4).alias("delta"), "n_valid")


# --- masks and regions


def summed(spark, sf):
    return I.sum_stack(stack(spark, sf))


@query("SELECT acq_id, y, x FROM summed WHERE channel='A' AND counts >= (SELECT avg(counts) FROM summed WHERE channel='R')")
def mask_counts(spark, sf):
    image = summed(spark, sf)
    cutoff = image.filter("channel = 'R'").agg(F.avg("counts")).first()[0]
    return I.mask_counts(image, "A", cutoff)


TOP = "SELECT acq_id, y, x FROM summed WHERE channel='{0}' AND counts {1} (SELECT quantile_cont(counts,{2}) FROM summed WHERE channel='{0}')"


@query(TOP.format("A", ">=", 0.9))
def mask_percentile(spark, sf):
    return I.mask_percentile(summed(spark, sf), "A", 90)


@query(f"SELECT acq_id, y, x FROM summed WHERE channel='A' EXCEPT ({TOP.format('A', '>=', 0.9)})")
def mask_not(spark, sf):
    image = summed(spark, sf)
    return I.mask_not(image, I.mask_percentile(image, "A", 90))


RULES = [{"name": "hot", "channel": "A", "mode": "percentile", "cutoff": 60}, {"channel": "N", "mode": "percentile", "cutoff": 50, "cmp": ">"}]


def _rules(how: str) -> str:
    a, b = TOP.format("A", ">=", 0.6), TOP.format("N", ">", 0.5)
    return f"WITH a AS ({a}), b AS ({b}) SELECT acq_id, 'hot' AS roi, y, x FROM a UNION ALL SELECT acq_id, 'rule_1', y, x FROM b UNION ALL SELECT acq_id, 'combined', y, x FROM (SELECT * FROM a {how} SELECT * FROM b)"


@query(_rules("INTERSECT"))
def rules_and(spark, sf):
    return I.build_roi_masks(summed(spark, sf), RULES, "AND")


@query(_rules("UNION"))
def rules_or(spark, sf):
    return I.build_roi_masks(summed(spark, sf), RULES, "OR")


ROI = "r AS (SELECT acq_id, y, x, CASE WHEN y < 8 THEN 'top' ELSE 'bottom' END AS roi FROM summed WHERE channel='A' AND (x + y) % 3 = 0)"


def rois(spark, sf):
    return summed(spark, sf).filter("channel = 'A' and (x + y) % 3 = 0").select("acq_id", F.when(F.col("y") < 8, "top").otherwise("bottom").alias("roi"), "y", "x")


@query(f"WITH {ROI} SELECT s.acq_id, roi, channel, count(*) AS n_pixels, round(count(*)/(SELECT count(DISTINCT (y,x)) FROM summed),6) AS fraction, round(avg(counts),6) AS mean, CAST(floor(sum(counts)) AS BIGINT) AS total, round(quantile_cont(counts,0.05),6) AS p5, round(quantile_cont(counts,0.5),6) AS p50, round(quantile_cont(counts,0.95),6) AS p95 FROM summed s JOIN r USING (y,x) GROUP BY s.acq_id, roi, channel")
def roi_stats(spark, sf):
    return rounded(I.roi_statistics(summed(spark, sf), rois(spark, sf)))


@query(f"WITH {ROI} SELECT s.acq_id, roi, sum(counts) FILTER (channel='A') AS n, sum(counts) FILTER (channel='N') AS d, round(sum(counts) FILTER (channel='A')/sum(counts) FILTER (channel='N'),6) AS ratio FROM summed s JOIN r USING (y,x) GROUP BY s.acq_id, roi")
def pooled_ratio(spark, sf):
    return rounded(I.pooled_ratio(summed(spark, sf), rois(spark, sf), "A", "N"))


@query(f"WITH {ROI} SELECT s.acq_id, roi, plane, CAST(coalesce(sum(counts) FILTER (channel='A'),0) AS DOUBLE) AS value FROM stack s JOIN r USING (y,x) GROUP BY s.acq_id, roi, plane")
def depth_profile(spark, sf):
    return I.depth_profile(stack(spark, sf), rois(spark, sf), "A")


@query(f"WITH {ROI}, v AS (SELECT s.acq_id, roi, plane, coalesce(sum(counts) FILTER (channel='A'),0) AS n, coalesce(sum(counts) FILTER (channel='R'),0) AS d FROM stack s JOIN r USING (y,x) GROUP BY s.acq_id, roi, plane) SELECT acq_id, roi, plane, round(CASE WHEN d>0 THEN n/d ELSE 0 END,6) AS value FROM v")
def depth_ratio(spark, sf):
    return rounded(I.depth_profile(stack(spark, sf), rois(spark, sf), "A", "R"))


@query(f"WITH {ROI} SELECT acq_id, roi, round(avg(y),6) AS y, round(avg(x),6) AS x, count(*) AS area FROM r GROUP BY acq_id, roi")
def roi_centroids(spark, sf):
    return rounded(I.roi_centroids(rois(spark, sf)))


@query(f"WITH {ROI} SELECT acq_id, roi, y, x FROM r UNION ALL SELECT acq_id, 'top_2' AS roi, y, x FROM r WHERE roi='top'")
def union_rois(spark, sf):
    held = rois(spark, sf)
    return I.union_rois(held, held.filter("roi = 'top'"))


COMPONENTS = f"""WITH RECURSIVE {ROI}, walk AS (
  SELECT roi, y, x, y*16+x AS seed FROM r UNION
  SELECT w.roi, n.y, n.x, w.seed FROM walk w JOIN r n ON n.roi=w.roi AND abs(n.y-w.y)<=1 AND abs(n.x-w.x)<=1),
  lab AS (SELECT roi, y, x, min(seed) AS s FROM walk GROUP BY ALL)
SELECT 0 AS acq_id, roi, CAST(dense_rank() OVER (PARTITION BY roi ORDER BY s) AS INT) AS region, y, x FROM lab"""


@query(COMPONENTS)
def components(spark, sf):
    return X.components(rois(spark, sf), 8)


@query(COMPONENTS.replace("SELECT 0 AS acq_id, roi, CAST(dense_rank() OVER (PARTITION BY roi ORDER BY s) AS INT) AS region, y, x FROM lab", ", a AS (SELECT roi, s, count(*) AS n FROM lab GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, roi, s) AS i FROM a QUALIFY i <= 5) SELECT 0 AS acq_id, 'r' || i AS roi, y, x FROM lab JOIN k USING (roi, s)").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def largest_regions(spark, sf):
    parts = X.components(rois(spark, sf), 8).withColumn("region", F.struct(F.col("roi").alias("roi"), F.col("region").alias("n"))).drop("roi")
    return I.largest_regions(parts.withColumn("region", F.format_string("%s %05d", "region.roi", "region.n")), 2, 5)


@query("SELECT CAST(19 - y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range(20)) AS y), (SELECT unnest(range(30)) AS x) WHERE x >= 3 AND x < 18 AND y >= 2 AND y < 9")
def rasterise_rectangle(spark, sf):
    return I.rasterise_rectangle(spark, 20, 30, 17.4, 8.2, 3.7, 2.9)


@query("SELECT CAST(19 - y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range(20)) AS y), (SELECT unnest(range(30)) AS x) WHERE power((x+0.5-10.0)/6.0,2)+power((y+0.5-8.0)/4.0,2) <= 1")
def rasterise_ellipse(spark, sf):
    return I.rasterise_ellipse(spark, 20, 30, 4.0, 4.0, 16.0, 12.0)


POLYGON = [(2.2, 1.1), (25.3, 4.4), (18.9, 17.2), (10.1, 9.7)]


def _inside(points) -> str:
    edges = [(a, b) for a, b in zip(points, [*points[1:], points[0]], strict=True)]
    return " + ".join(f"CAST(({ay} > y+0.5) <> ({by} > y+0.5) AND x+0.5 < {bx - ax}*(y+0.5-{ay})/{by - ay}+{ax} AS INT)" for (ax, ay), (bx, by) in edges)


@query(f"SELECT CAST(19 - y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range(20)) AS y), (SELECT unnest(range(30)) AS x) WHERE ({_inside(POLYGON)}) % 2 = 1")
def rasterise_polygon(spark, sf):
    return I.rasterise_polygon(spark, 20, 30, POLYGON)


# --- volume


@query("WITH v AS (SELECT acq_id, plane, y, x, CAST(sum(counts) AS DOUBLE) AS counts FROM stack WHERE channel='A' GROUP BY ALL) SELECT * FROM v WHERE counts > (SELECT quantile_cont(counts,0.95) FROM v)")
def point_cloud(spark, sf):
    return I.point_cloud(I.voxel_sums(stack(spark, sf)), "A", 95, cap=None)


@query("WITH v AS (SELECT acq_id, plane, y, x, CAST(sum(counts) AS DOUBLE) AS counts FROM stack WHERE channel='A' GROUP BY ALL HAVING sum(counts) > 0), l AS (SELECT quantile_cont(counts,0.5) AS lo, quantile_cont(counts,0.995) AS hi FROM v), k AS (SELECT CAST(i AS INT) AS level, lo + i*(hi-lo)/3 AS mid, (hi-lo)/3 AS sp FROM l, (SELECT unnest(range(4)) AS i)) SELECT acq_id, level, plane, y, x, counts FROM v, k WHERE abs(counts-mid) <= 0.12*sp")
def shells(spark, sf):
    return I.iso_shells(I.voxel_sums(stack(spark, sf)), "A", 4)


@query("SELECT acq_id, plane, channel, y, x, CAST(sum(counts) AS DOUBLE) AS counts, round(x/15.0*20,6) AS x_um, round(y/15.0*20,6) AS y_um FROM stack WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY ALL")
def decimated_coordinates(spark, sf):
    return rounded(I.voxel_coordinates(I.decimate(I.voxel_sums(stack(spark, sf)), 2), 20.0, 16, 16))


# --- distributions


@query("SELECT acq_id, channel, CAST(p AS INT) AS percentile, round(q,6) AS value FROM (SELECT acq_id, channel, unnest([1,5,10,25,50,75,90,95,99]) AS p, unnest(quantile_cont(counts,[0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99])) AS q FROM summed WHERE counts > 0 GROUP BY ALL)".replace(" GROUP BY ALL)", " GROUP BY acq_id, channel)"))
def quantiles(spark, sf):
    return rounded(D.quantiles(summed(spark, sf)))


@query("WITH v AS (SELECT acq_id, channel, log10(counts) AS v FROM summed WHERE counts > 0), s AS (SELECT channel, quantile_cont(v,0.005) AS a, quantile_cont(v,0.995) AS b FROM v GROUP BY 1), t AS (SELECT channel, a-0.05*(b-a) AS lo, b+0.05*(b-a) AS hi FROM s), h AS (SELECT v.acq_id, v.channel, CAST(least(floor((v-lo)/((hi-lo)/40)),39) AS INT) AS bin, (hi-lo)/40 AS w FROM v JOIN t USING (channel) WHERE v BETWEEN lo AND hi), c AS (SELECT acq_id, channel, bin, w, count(*) AS n FROM h GROUP BY ALL) SELECT acq_id, channel, bin, round(n/sum(n) OVER (PARTITION BY channel)/w,6) AS density FROM c")
def density_hist(spark, sf):
    return rounded(D.density_histogram(summed(spark, sf), 40))


CURVE = [("bic", k, v) for k, v in enumerate((980.0, 610.0, 402.0, 371.0, 365.5, 366.0), 1)] + [("inertia", k, v) for k, v in enumerate((50.0, 44.0, 20.0, 13.0, 9.0), 1)]
CURVE_SQL = "c(curve, k, value) AS (VALUES " + ", ".join(f"('{n}', {k}, {v}::DOUBLE)" for n, k, v in CURVE) + ")"


def curves(spark, sf):
    return spark.createDataFrame(CURVE, "curve string, k int, value double")


@query(f"WITH {CURVE_SQL}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY curve ORDER BY k) AS fall FROM c) SELECT curve, CAST(arg_min(k, fall) AS INT) AS k FROM d GROUP BY curve")
def elbow_drop(spark, sf):
    return D.elbow_largest_drop(curves(spark, sf))


@query(f"WITH {CURVE_SQL}, e AS (SELECT curve, min(k) AS k0, max(k) AS k1, min(value) AS v0, max(value) AS v1, arg_min(value,k) AS f, arg_max(value,k) AS l FROM c GROUP BY curve), s AS (SELECT curve, k, abs((value-f)/(v1-v0)-(l-f)/(v1-v0)*(k-k0)/(k1-k0)) AS s FROM c JOIN e USING (curve)) SELECT curve, CAST(arg_max(k, s) AS INT) AS k FROM s GROUP BY curve")
def elbow_chord(spark, sf):
    return D.elbow_chord(curves(spark, sf))


@query("SELECT 'ch' AS channel, 3 AS k, 'bic,kneedle' AS methods UNION ALL SELECT 'ch', 2, 'largest_drop'")
def recommendations(spark, sf):
    picks = spark.createDataFrame([("ch", "kneedle", 3), ("ch", "bic", 3), ("ch", "largest_drop", 2)], "channel string, method string, k int")
    return D.recommendations(picks, "channel", ["bic", "largest_drop", "kneedle"])


@query()
def gmm_fit(spark, sf):
    return D.mixture_components(D.fit_mixtures(summed(spark, sf)))


@query()
def gmm_thresholds(spark, sf):
    return D.best_thresholds(D.fit_mixtures(summed(spark, sf)), "bic")


# --- clusters

CHANNELS = ["A", "N", "R"]


@query("WITH v AS (SELECT acq_id, y, x, channel AS feature, log10(counts+1) AS v FROM summed), s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS sd FROM v GROUP BY 1) SELECT acq_id, y, x, feature, round((v-m)/CASE WHEN sd>0 THEN sd ELSE 1 END,6) AS value FROM v JOIN s USING (feature)")
def feat_zscore(spark, sf):
    return rounded(C.feature_space(summed(spark, sf), CHANNELS, "log_zscored"))


@query("WITH v AS (SELECT acq_id, y, x, channel AS feature, log10(counts+1) AS v FROM summed), s AS (SELECT feature, median(v) AS m FROM v GROUP BY 1), d AS (SELECT feature, 1.4826*median(abs(v-m)) AS mad, any_value(m) AS m FROM v JOIN s USING (feature) GROUP BY 1) SELECT acq_id, y, x, feature, round((v-m)/CASE WHEN mad>0 THEN mad ELSE 1 END,6) AS value FROM v JOIN d USING (feature)")
def feat_robustz(spark, sf):
    return rounded(C.feature_space(summed(spark, sf), CHANNELS, "log_robustz"))


@query("SELECT acq_id, y, x, channel AS feature, round(log10(counts+1),6) AS value FROM summed")
def feat_log(spark, sf):
    return rounded(C.feature_space(summed(spark, sf), CHANNELS, "log"))


@query("WITH p AS (SELECT acq_id, y, x, coalesce(sum(counts) FILTER (channel='A'),0) AS a, coalesce(sum(counts) FILTER (channel='N'),0) AS n, coalesce(sum(counts) FILTER (channel='R'),0) AS r FROM summed GROUP BY ALL) SELECT acq_id, y, x, 'A/N' AS feature, round(CASE WHEN n<>0 THEN a/n ELSE 0 END,6) AS value FROM p UNION ALL SELECT acq_id, y, x, 'R/N', round(CASE WHEN n<>0 THEN r/n ELSE 0 END,6) FROM p".replace("GROUP BY ALL", "GROUP BY acq_id, y, x"))
def feat_ratios(spark, sf):
    return rounded(C.feature_space(summed(spark, sf), CHANNELS, "ratios", [("A", "N"), ("R", "N")]))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i, label FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2), d AS (SELECT e.vec_id, c.label, sum((v-m)*(v-m)) AS d FROM e JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, CAST(arg_min(label, (d, label)) AS INT) AS cluster FROM d GROUP BY vec_id".replace("arg_min(label, (d, label))", "arg_min(label, round(d,9))"))
def nearest_centroid(spark, sf):
    held = vectors(spark, sf)
    means = held.select("label", F.posexplode("vec").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centres = means.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec")).withColumn("k", F.lit(0))
    return C.nearest_centroid(held, centres, ("vec_id",)).select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i FROM embeddings), c AS (SELECT label, i, count(*) AS n, sum(v*v)-count(*)*avg(v)*avg(v) AS ss FROM e GROUP BY 1, 2) SELECT CAST(label AS INT) AS cluster, max(n) AS size, round(sum(ss),5) AS within FROM c GROUP BY label")
def cluster_table(spark, sf):
    held = vectors(spark, sf).select(F.lit(0).alias("acq_id"), F.col("vec_id").alias("y"), F.lit(0).alias("x"), "vec", "label")
    out = C.cluster_table(held, held.select(F.lit(1).alias("k"), "acq_id", "y", "x", F.col("label").alias("cluster")))
    return out.select(F.col("cluster").cast("int").alias("cluster"), "size", F.round("within", 5).alias("within"))


def _clusters(spark, sf, method):
    return C.cluster_pixels(summed(spark, sf), CHANNELS, method)


@query()
def kmeans_labels(spark, sf):
    return _clusters(spark, sf, "kmeans")["labels"]


@query()
def linkage_labels(spark, sf):
    return _clusters(spark, sf, "hierarchical")["labels"]


@query()
def k_metrics(spark, sf):
    return spark.createDataFrame(_clusters(spark, sf, "kmeans")["metrics"], "k int, inertia double, calinski_harabasz double, davies_bouldin double, silhouette double, cubic double")


@query()
def cluster_rois(spark, sf):
    return C.cluster_masks(_clusters(spark, sf, "kmeans")["labels"], 3)


# --- registration


CENTRES = [(0, 1.5, 0, 1), (0, 5.5, 3, -2), (0, 9.5, 8, 4)]


@query("WITH p AS (SELECT CAST(r AS INT) AS plane FROM (SELECT unnest(range(13)) AS r)), c(centre, dy, dx) AS (VALUES " + ", ".join(f"({c}::DOUBLE, {y}::DOUBLE, {x}::DOUBLE)" for _, c, y, x in CENTRES) + "), n AS (SELECT plane, max(CASE WHEN centre <= plane THEN centre END) AS lo, min(CASE WHEN centre >= plane THEN centre END) AS hi FROM p, c GROUP BY 1), j AS (SELECT plane, coalesce(lo,hi) AS lo, coalesce(hi,lo) AS hi FROM n) SELECT 0 AS acq_id, plane, CAST(round_even(a.dy + CASE WHEN hi>lo THEN (plane-lo)/(hi-lo)*(b.dy-a.dy) ELSE 0 END,0) AS INT) AS dy, CAST(round_even(a.dx + CASE WHEN hi>lo THEN (plane-lo)/(hi-lo)*(b.dx-a.dx) ELSE 0 END,0) AS INT) AS dx FROM j JOIN c a ON a.centre=lo JOIN c b ON b.centre=hi")
def interp_shift(spark, sf):
    ranked = spark.range(13).select(F.lit(0).alias("acq_id"), F.col("id").cast("int").alias("plane"), F.col("id").alias("rank"))
    return X.interpolate_shifts(ranked, spark.createDataFrame(CENTRES, "acq_id int, centre double, dy int, dx int"))


@query("WITH s AS (SELECT acq_id, plane, channel, y + plane % 3 - 1 AS y, x + plane % 5 - 2 AS x, counts FROM stack) SELECT acq_id, channel, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(sum(counts) AS DOUBLE) AS counts FROM s WHERE y BETWEEN 0 AND 15 AND x BETWEEN 0 AND 15 GROUP BY ALL")
def apply_shifts(spark, sf):
    voxels = stack(spark, sf)
    shifts = voxels.select("acq_id", "plane").distinct().withColumn("dy", F.col("plane") % 3 - 1).withColumn("dx", F.col("plane") % 5 - 2)
    return I.sum_stack(X.apply_shifts(voxels, shifts, 16, 16))


@query()
def detected_regions(spark, sf):
    return X.detect_regions(summed(spark, sf), "A", "otsu", 1.0, min_area=4)


@query()
def contours(spark, sf):
    return X.mask_contours(rois(spark, sf)).withColumn("points", F.size("points"))


@query()
def display_filters(spark, sf):
    image = summed(spark, sf)
    return reduce(DataFrame.unionByName, (X.display_filter(image, k, s).withColumn("kind", F.lit(k)) for k, s in (("median", 3), ("gaussian", 1.0), ("sobel", 1), ("canny", 1.0))))


# --- spectra

ORDERED = "o AS (SELECT *, lag(m) OVER w AS m0, lag(counts) OVER w AS c0, lead(m) OVER w AS m1, lead(counts) OVER w AS c1, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM spectrum WINDOW w AS (PARTITION BY scan_id ORDER BY m))"


@query(f"WITH {ORDERED}, l AS (SELECT scan_id, avg(counts) AS level FROM spectrum GROUP BY 1), h AS (SELECT scan_id, m, m0 + (level-c0)/(counts-c0)*(m-m0) AS place FROM o JOIN l USING (scan_id) WHERE (c0-level)*(counts-level) <= 0 AND counts <> c0) SELECT scan_id, round(arg_min(place, m),6) AS m FROM h GROUP BY scan_id")
def level_crossing(spark, sf):
    held = spectrum(spark, sf)
    mean = held.groupBy("scan_id").agg(F.avg("counts").alias("level"))
    return rounded(P.level_crossings(held.join(mean, "scan_id"), F.col("level")))


EDGE = f"{ORDERED}, t AS (SELECT scan_id, arg_max(i, counts*1000 - i) AS ti, arg_max(m, counts*1000 - i) AS tm FROM o GROUP BY 1), e AS (SELECT scan_id, any_value(tm) AS peak, median(counts) FILTER (i < greatest(3, n // 10)) AS base, median(counts) FILTER (abs(i-ti) <= 2) AS plateau FROM o JOIN t USING (scan_id) GROUP BY 1), r AS (SELECT o.*, peak, base, greatest(plateau-base, 1e-9) AS amp FROM o JOIN e USING (scan_id) WHERE m <= peak), q AS (SELECT scan_id, arg_min(m0+(base+0.1*amp-c0)/(counts-c0)*(m-m0), m) FILTER ((c0-base-0.1*amp)*(counts-base-0.1*amp) <= 0 AND counts <> c0 AND m0 IS NOT NULL) AS m10, arg_min(m0+(base+0.9*amp-c0)/(counts-c0)*(m-m0), m) FILTER ((c0-base-0.9*amp)*(counts-base-0.9*amp) <= 0 AND counts <> c0 AND m0 IS NOT NULL) AS m90, any_value(peak) AS peak FROM r GROUP BY 1)"


@query(f"WITH {EDGE} SELECT scan_id, round(abs(m90-m10),6) AS dm, round(CASE WHEN abs(m90-m10)>0 THEN (CASE WHEN round(peak)<>0 THEN abs(round(peak)) ELSE abs(peak) END)/abs(m90-m10) END,6) AS mrp, round(m10,6) AS m10, round(m90,6) AS m90, peak, CASE WHEN round(peak)<>0 THEN abs(round(peak)) ELSE abs(peak) END AS mass FROM q WHERE m10 IS NOT NULL AND m90 IS NOT NULL")
def mrp(spark, sf):
    return rounded(P.resolving_power(spectrum(spark, sf)))


@query(f"WITH {ORDERED} SELECT scan_id, m, round(CASE WHEN m0 IS NULL THEN (c1-counts)/(m1-m) WHEN m1 IS NULL THEN (counts-c0)/(m-m0) ELSE ((c1-counts)*(m-m0)*(m-m0)+(counts-c0)*(m1-m)*(m1-m))/((m-m0)*(m1-m)*(m1-m0)) END,6) AS gradient FROM o")
def lsf_gradient(spark, sf):
    return rounded(P.gradient(spectrum(spark, sf)))


@query("WITH a AS (SELECT scan_id, sum(counts) AS t, sum(m*counts)/sum(counts) AS c, max(counts) AS top FROM spectrum GROUP BY 1), b AS (SELECT scan_id, any_value(c) AS c, sum(power(m-c,2)*counts)/any_value(t) AS v2, sum(power(m-c,3)*counts)/any_value(t) AS v3, sum(power(m-c,4)*counts)/any_value(t) AS v4, max(m) FILTER (counts >= top/2) - min(m) FILTER (counts >= top/2) AS f FROM spectrum JOIN a USING (scan_id) GROUP BY 1) SELECT scan_id, round(c,6) AS centre, round(CASE WHEN f>0 THEN f END,6) AS fwhm, round(v3/power(sqrt(v2),3),6) AS skew, round(v4/power(sqrt(v2),4)-3,6) AS kurtosis FROM b")
def lsf_moments(spark, sf):
    return rounded(P.moments(spectrum(spark, sf)))


@query("SELECT scan_id, m, round(sum(counts) OVER (PARTITION BY scan_id ORDER BY m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)/3,6) AS counts FROM spectrum")
def moving_average(spark, sf):
    return rounded(P.moving_average(spectrum(spark, sf)))


@query(f"WITH {ORDERED} SELECT scan_id, m, counts FROM o WHERE counts > c0 AND counts > c1")
def local_maxima(spark, sf):
    return P.local_maxima(spectrum(spark, sf))


GAPS = "WITH p AS (SELECT o_custkey % 7 AS scan_id, o_totalprice AS m, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS counts FROM orders), g AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY scan_id ORDER BY m) > 60 THEN 1 ELSE 0 END AS new FROM p), c AS (SELECT *, sum(new) OVER (PARTITION BY scan_id ORDER BY m ROWS UNBOUNDED PRECEDING) AS cluster FROM g)"


@query(f"{GAPS} SELECT scan_id, CAST(cluster AS BIGINT) AS cluster, round(sum(m*counts)/sum(counts),6) AS centre, CAST(sum(counts) AS DOUBLE) AS total, count(*) AS n FROM c GROUP BY 1, 2")
def gap_cluster(spark, sf):
    points = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("scan_id"), F.col("o_totalprice").alias("m"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("counts"))
    return P.gap_cluster(points, 60).select("scan_id", "cluster", F.round("centre", 6).alias("centre"), "total", "n")


@query("SELECT o_custkey % 7 AS scan_id, CAST(round_even(o_totalprice/5000,0) AS BIGINT) AS bin, count(*) AS count, round(avg(o_totalprice),4) AS position, max(CAST(o_orderkey % 5 + 1 AS DOUBLE)) AS amplitude FROM orders GROUP BY 1, 2")
def selection_counts(spark, sf):
    atoms = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("scan_id"), F.col("o_totalprice").alias("position"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("amplitude"))
    return rounded(P.selection_counts(atoms, 5000), 4)


@query()
def deconvolve(spark, sf):
    return P.best_by_bic(P.deconvolve_sweep(spectrum(spark, sf))).withColumn("peaks", F.size("peaks"))


@query()
def stability(spark, sf):
    return P.stability_select(spectrum(spark, sf), w=3.0, sigma=0.8, step=0.5, radius=2.0)


@query()
def line_spread(spark, sf):
    return P.line_spread(spectrum(spark, sf), smooth=1.0).select("scan_id", "n_peaks", "dm", "mrp", "tail_low_ppm", "tail_high_ppm")


# --- species

ELEMENTS = ["C", "N", "O", "H"]
ATOMS = [r for r in T.isotope_rows() if r[0] in ELEMENTS]


def _ions_sql(nominal: float, mz_tol: float) -> str:
    """Literal isotopes, one range of counts each; the bounds are those of the operator."""
    types = sorted(ATOMS, key=lambda r: (ELEMENTS.index(r[0]), r[2]))
    n = [f"n{i}" for i in range(len(types))]
    total = " + ".join(n)
    hydrogen = " + ".join(n[i] for i, t in enumerate(types) if t[0] == "H")
    mass = " + ".join(f"{n[i]}*{t[3]}" for i, t in enumerate(types))
    nominal_sum = " + ".join(f"{n[i]}*{t[2]}" for i, t in enumerate(types))
    name = " || ".join(f"CASE {n[i]} WHEN 0 THEN '' WHEN 1 THEN '{t[2]}{t[0]}' ELSE '{t[2]}{t[0]}' || {n[i]} END" for i, t in enumerate(types))
    abund = " * ".join(f"power({t[4]}, {n[i]})" for i, t in enumerate(types))
    source = ", ".join(f"(SELECT unnest(range({3 if t[0] == 'H' else 5})) AS {n[i]})" for i, t in enumerate(types))
    return f"ions AS (SELECT {name} || '-' AS formula, ({mass}) + {T.ELECTRON} AS mz, CAST({total} AS INT) AS total_atoms, ({abund}) * power(0.3, {total} - 1) AS plausibility FROM {source} WHERE {total} BETWEEN 1 AND 4 AND {hydrogen} <= 2 AND abs(({nominal_sum}) - {nominal}) < 0.6 AND abs(({mass}) + {T.ELECTRON} - {nominal}) < {mz_tol})"


@query(f"WITH {_ions_sql(26, 0.05)} SELECT formula, round(mz,7) AS mz, total_atoms, round(plausibility,12) AS plausibility FROM ions")
def enumerate_ions(spark, sf):
    out = S.enumerate_ions(spark, ELEMENTS, 26)
    return out.select("formula", F.round("mz", 7).alias("mz"), F.col("total_atoms").cast("int").alias("total_atoms"), F.round("plausibility", 12).alias("plausibility"))


PEAKS = [("s1", 0, 26.0031), ("s1", 1, 26.0110), ("s1", 2, 26.0148), ("s2", 0, 26.0040), ("s2", 1, 26.0160)]
PEAKS_SQL = "peaks(scan_id, peak_index, observed) AS (VALUES " + ", ".join(f"('{s}', {i}, {m}::DOUBLE)" for s, i, m in PEAKS) + ")"


def peaks(spark):
    return spark.createDataFrame(PEAKS, "scan_id string, peak_index int, observed double")


@query(f"WITH {_ions_sql(26, 0.1)}, {PEAKS_SQL}, r AS (SELECT mz FROM ions WHERE formula='12C14N-'), t AS (SELECT p.*, a.observed AS ref, r.mz + p.observed - a.observed AS target, r.mz AS rmz FROM peaks p JOIN peaks a ON a.scan_id=p.scan_id AND a.peak_index=0, r), d AS (SELECT t.*, i.formula, i.mz, row_number() OVER (PARTITION BY scan_id, peak_index ORDER BY abs(i.mz-target), plausibility DESC) AS k FROM t, ions i) SELECT scan_id, peak_index, observed, formula, round(mz,7) AS mz, round((observed-ref)*1000,5) AS delta_obs_mau, round((mz-rmz)*1000,5) AS delta_theo_mau, round((mz-target)*1000,5) AS err_mau FROM d WHERE k=1")
def identify_diff(spark, sf):
    out = S.identify_by_difference(peaks(spark), S.enumerate_ions(spark, ELEMENTS, 26, mz_tol=0.1), 0, "12C14N-")
    return out.select("scan_id", "peak_index", "observed", "formula", F.round("mz", 7).alias("mz"), *(F.round(c, 5).alias(c) for c in ("delta_obs_mau", "delta_theo_mau", "err_mau")))


@query(f"WITH {_ions_sql(26, 0.1)}, {PEAKS_SQL}, t AS (SELECT a.scan_id, c.formula AS anchor, a.peak_index AS ap, p.peak_index, p.observed - (a.observed - c.mz) AS target FROM ions c, peaks a JOIN peaks p USING (scan_id)), d AS (SELECT t.*, i.formula, i.mz, i.plausibility, row_number() OVER (PARTITION BY t.scan_id, anchor, ap, peak_index ORDER BY abs(i.mz-target), i.plausibility DESC) AS k FROM t, ions i), s AS (SELECT scan_id, anchor, ap, sqrt(avg(power(mz-target,2)))*1000 AS rms, string_agg(formula, ' ' ORDER BY peak_index) AS assignment, avg(plausibility) AS mp FROM d WHERE k=1 GROUP BY 1, 2, 3), b AS (SELECT scan_id, assignment, min(rms) AS rms, min(mp) AS mp FROM s GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rms, mp DESC, assignment) AS rank FROM b) SELECT scan_id, CAST(rank AS INT) AS rank, assignment, round(rms,5) AS rms_mau, round(mp,10) AS mean_plausibility FROM z WHERE rank <= 5")
def identify_blind(spark, sf):
    out = S.identify_blind(peaks(spark), S.enumerate_ions(spark, ELEMENTS, 26, mz_tol=0.1))
    return out.select("scan_id", "rank", "assignment", F.round("rms_mau", 5).alias("rms_mau"), F.round("mean_plausibility", 10).alias("mean_plausibility"))


PAIRS = [("13C", "12C"), ("12C15N", "12C14N"), ("A", "N")]


@query("SELECT '13C' AS num, '12C' AS den, 0.0112372::DOUBLE AS reference UNION ALL SELECT '12C15N', '12C14N', 0.0036765 UNION ALL SELECT 'A', 'N', NULL")
def ref_lookup(spark, sf):
    return T.lookup_reference(spark.createDataFrame(PAIRS, "num string, den string")).select("num", "den", "reference")


MASS = "WITH c AS (SELECT 0 AS acq_id, CAST(p_partkey AS INT) AS ch_idx, 10 + p_retailprice/20 AS nom_mass FROM part), r AS (SELECT CAST(s_suppkey AS INT) AS row_index, 10 + (900 + s_suppkey*7 % 1100)/20.0 AS mass_amu FROM supplier)"


@query(f"{MASS}, d AS (SELECT ch_idx, row_index, mass_amu, row_number() OVER (PARTITION BY ch_idx ORDER BY abs(mass_amu-nom_mass), row_index) AS k FROM c, r WHERE abs(mass_amu-nom_mass) < 0.05) SELECT 0 AS acq_id, ch_idx, row_index, round(mass_amu,6) AS mass_amu FROM d WHERE k=1")
def mass_match(spark, sf):
    channels = table(spark, sf, "part").select(F.lit(0).alias("acq_id"), F.col("p_partkey").cast("int").alias("ch_idx"), (10 + F.col("p_retailprice") / 20).alias("nom_mass"))
    rows = table(spark, sf, "supplier").select(F.lit(0).alias("acq_id"), F.col("s_suppkey").cast("int").alias("row_index"), (10 + (900 + F.col("s_suppkey") * 7 % 1100) / 20).alias("mass_amu"))
    return rounded(S.match_mass_rows(channels, rows))


# --- event time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value),4) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return rounded(windowed_counts(table(spark, sf, "events")), 4)


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, user_id, count(*) AS n FROM g GROUP BY user_id, s")
def event_sessions(spark, sf):
    return sessions(table(spark, sf, "events"))


# --- panels and labels


@query("SELECT acq_id, channel, count(DISTINCT plane) AS planes, CAST(max(y)+1 AS INT) AS height, CAST(max(x)+1 AS INT) AS width, CAST(sum(counts) AS DOUBLE) AS total, CAST(max(counts) AS DOUBLE) AS top FROM stack GROUP BY ALL")
def stack_summary(spark, sf):
    return I.stack_summary(stack(spark, sf))


@query(f"WITH {ROI} SELECT q.acq_id, q.y, q.x, round((ratio/0.9-1)*1000,4) AS value, roi FROM ratios q LEFT JOIN r ON r.y=q.y AND r.x=q.x")
def overlay_panel(spark, sf):
    return rounded(I.panel(stack(spark, sf), "delta", "A", "N", reference=0.9, roi_pixels=rois(spark, sf)), 4)


@query("SELECT acq_id, roi, y, x FROM (SELECT acq_id, CASE WHEN (x + y) % 3 = 0 THEN 'third' ELSE 'rest' END AS roi, y, x FROM summed WHERE channel='A') QUALIFY count(*) OVER (PARTITION BY roi) >= 100")
def big_masks(spark, sf):
    held = summed(spark, sf).filter("channel = 'A'").select("acq_id", F.when((F.col("x") + F.col("y")) % 3 == 0, "third").otherwise("rest").alias("roi"), "y", "x")
    return held.join(held.groupBy("acq_id", "roi").count().filter("count >= 100"), ["acq_id", "roi"], "left_semi").select("acq_id", "roi", "y", "x")


LABELS = ["SE", " se ", "12C", "SE det", "Secondary e", "e-", "Sea", "topo", "32S"]


@query("WITH l(label) AS (VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ") SELECT label, lower(trim(label)) IN ('se','secondary electron','e-','e⁻','em','topography','topo') OR starts_with(lower(trim(label)),'se ') OR starts_with(lower(trim(label)),'secondary') AS se FROM l")
def se_channels(spark, sf):
    return spark.createDataFrame([(x,) for x in LABELS], "label string").select("label", T.is_se_channel("label").alias("se"))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS first, c_custkey % 5 AS second FROM customer")
def index_lists(spark, sf):
    held = table(spark, sf, "customer").select("c_custkey", T.index_list(F.concat_ws(";", F.col("c_nationkey").cast("string"), F.lit("x"), (F.col("c_custkey") % 5).cast("string"))).alias("n"))
    return held.select("c_custkey", F.col("n")[0].cast("long").alias("first"), F.col("n")[1].cast("long").alias("second"))

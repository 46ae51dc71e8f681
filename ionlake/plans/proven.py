"""More registered queries, of operators on fixed clusters, thresholds, shifts and metrics, so that SQL can follow them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionlake.functions import tables as T
from ionlake.operators import clusters as C, image as I, spectra as P, species as S, tiles as X
from ionlake.plans import batch
from ionlake.plans.catalog import CHANNELS, ELEMENTS, ORACLES, PEAKS_SQL, ROI, _ions_sql, peaks, query, rois, rounded, spectrum, stack, summed, table

# --- identification

_BLIND = ORACLES["identify_blind"]
_RANKED = _BLIND[: _BLIND.index(" SELECT scan_id, CAST(rank AS INT)")]


@query()
def identify_confidence(spark, sf):
    return rounded(S.confidence(S.identify_blind(peaks(spark), S.enumerate_ions(spark, ELEMENTS, 26, mz_tol=0.1))), 5)


ORACLES["identify_confidence"] = f"{_RANKED}, g AS (SELECT scan_id, rank, lead(rms) OVER (PARTITION BY scan_id ORDER BY rank) - rms AS gap FROM z WHERE rank <= 5) SELECT scan_id, round(gap,5) AS gap, CASE WHEN gap IS NULL OR gap >= 0.75 THEN 'clear winner' WHEN gap < 0.3 THEN 'weak' ELSE 'moderate' END AS confidence FROM g WHERE rank=1"


@query(f"WITH {_ions_sql(26, 0.6)}, {PEAKS_SQL}, top AS (SELECT * FROM ions ORDER BY plausibility DESC, formula LIMIT 8), m AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY observed, peak_index) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM peaks), a AS (SELECT scan_id, formula AS anchor, plausibility AS ap, observed - mz AS shift FROM m, top WHERE i = n // 2), t AS (SELECT a.scan_id, anchor, ap, peak_index, observed - shift AS target FROM a JOIN peaks USING (scan_id)), d AS (SELECT t.*, i.formula, i.mz, row_number() OVER (PARTITION BY scan_id, anchor, peak_index ORDER BY abs(i.mz-target), i.plausibility DESC, i.mz) AS k FROM t, ions i), s AS (SELECT scan_id, anchor, ap, sqrt(avg(power(mz-target,2)))*1000 AS rms, string_agg(formula, ' ' ORDER BY peak_index) AS assignment FROM d WHERE k=1 GROUP BY 1, 2, 3), z AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rms, ap DESC, anchor) AS r FROM s) SELECT scan_id, anchor, assignment, round(rms,5) AS rms_mau, round(rms,5) AS score FROM z WHERE r=1")
def match_by_separation(spark, sf):
    return rounded(S.match_by_separation(peaks(spark), S.enumerate_ions(spark, ELEMENTS, 26, mz_tol=0.6)), 5)


# --- images


@query(
    f"WITH e AS (SELECT max(y) AS h, max(x) AS w FROM summed), o AS (SELECT a.*, unnest(range(-4, 5)) AS dx FROM (SELECT channel, y, x, unnest(range(-4, 5)) AS dy FROM summed) a), g AS (SELECT sum(exp(-0.5*d*d)) AS total FROM (SELECT unnest(range(-4, 5)) AS d)), "
    "near AS (SELECT o.channel, o.y, o.x, o.dy, o.dx, s.counts AS v FROM o, e JOIN summed s ON s.channel=o.channel AND s.y=greatest(0, least(h, o.y+o.dy)) AND s.x=greatest(0, least(w, o.x+o.dx)) WHERE abs(o.dy) <= 1 AND abs(o.dx) <= 1), "
    "folded AS (SELECT o.channel, o.y, o.x, o.dy, o.dx, s.counts AS v FROM o, e JOIN summed s ON s.channel=o.channel AND s.y=CASE WHEN o.y+o.dy < 0 THEN -1-(o.y+o.dy) WHEN o.y+o.dy > h THEN 2*h+1-(o.y+o.dy) ELSE o.y+o.dy END AND s.x=CASE WHEN o.x+o.dx < 0 THEN -1-(o.x+o.dx) WHEN o.x+o.dx > w THEN 2*w+1-(o.x+o.dx) ELSE o.x+o.dx END), "
    "edge AS (SELECT channel, y, x, sum(v*dx*(2-abs(dy))) AS gx, sum(v*dy*(2-abs(dx))) AS gy FROM near GROUP BY 1, 2, 3) "
    "SELECT 0 AS acq_id, channel, y, x, round(median(v),6) AS counts, 'median' AS kind FROM near GROUP BY channel, y, x UNION ALL SELECT 0, channel, y, x, round(sum(v*exp(-0.5*dy*dy)*exp(-0.5*dx*dx))/any_value(total*total),6), 'gaussian' FROM folded, g GROUP BY channel, y, x UNION ALL SELECT 0, channel, y, x, round(sqrt(gx*gx+gy*gy)/4,6), 'sobel' FROM edge"
)
def display_kernels(spark, sf):
    image = summed(spark, sf)
    return rounded(reduce(DataFrame.unionByName, (X.display_filter(image, k, s).withColumn("kind", F.lit(k)) for k, s in (("median", 3), ("gaussian", 1.0), ("sobel", 1)))))


@query("SELECT acq_id, y, x FROM summed WHERE channel='A' AND counts >= 1900 AND counts < 2100")
def mask_gmm_component(spark, sf):
    return I.mask_gmm_component(summed(spark, sf), "A", [1900.0, 2100.0], 1).select("acq_id", "y", "x")


@query("SELECT DISTINCT 0 AS acq_id, -1 AS min_dy, 1 AS max_dy, -2 AS min_dx, 2 AS max_dx FROM (SELECT count(DISTINCT plane) AS n FROM stack) WHERE n >= 15")
def drift_range(spark, sf):
    shifts = stack(spark, sf).select("acq_id", "plane").distinct().select("acq_id", (F.col("plane") % 3 - 1).cast("int").alias("dy"), (F.col("plane") % 5 - 2).cast("int").alias("dx"))
    return X.drift_range(shifts)


@query(
    "WITH a AS (SELECT plane, row_number() OVER (ORDER BY plane) - 1 AS r FROM (SELECT DISTINCT plane FROM stack WHERE channel='A')), n AS (SELECT count(*) // 4 AS groups FROM a), i AS (SELECT r // 4 AS g, y, x, sum(counts) AS v FROM stack JOIN a USING (plane), n WHERE channel='A' AND r // 4 < groups GROUP BY 1, 2, 3), "
    "o AS (SELECT dy, unnest(range(16)) AS dx FROM (SELECT unnest(range(16)) AS dy)), c AS (SELECT b.g, dy, dx, sum(f.v*b.v) AS s FROM i b, o JOIN i f ON f.g=0 AND f.y=(b.y+dy) % 16 AND f.x=(b.x+dx) % 16 GROUP BY 1, 2, 3), "
    "best AS (SELECT g, dy, dx, row_number() OVER (PARTITION BY g ORDER BY s DESC, dy, dx) AS k FROM c), p AS (SELECT g*4 + 1.5 AS centre, CASE WHEN dy > 8 THEN dy-16 ELSE dy END AS dy, CASE WHEN dx > 8 THEN dx-16 ELSE dx END AS dx FROM best WHERE k=1), "
    "w AS (SELECT plane, row_number() OVER (ORDER BY plane) - 1 AS r FROM (SELECT DISTINCT plane FROM stack)), j AS (SELECT plane, r, max(centre) FILTER (centre <= r) AS lo, min(centre) FILTER (centre >= r) AS hi FROM w, p GROUP BY 1, 2), "
    "e AS (SELECT plane, r, coalesce(lo, hi) AS lo, coalesce(hi, lo) AS hi FROM j) "
    "SELECT 0 AS acq_id, plane, CAST(round_even(a.dy + CASE WHEN hi > lo THEN (r-lo)/(hi-lo)*(b.dy-a.dy) ELSE 0 END, 0) AS INT) AS dy, CAST(round_even(a.dx + CASE WHEN hi > lo THEN (r-lo)/(hi-lo)*(b.dx-a.dx) ELSE 0 END, 0) AS INT) AS dx FROM e JOIN p a ON a.centre=lo JOIN p b ON b.centre=hi"
)
def drift_shifts(spark, sf):
    return X.plane_shifts(stack(spark, sf), "A", bin_planes=4, bin_apply="interp")


# --- clusters


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    pixels = summed(spark, sf).select("acq_id", "y", "x").distinct()
    two = pixels.select(F.lit(2).alias("k"), "acq_id", "y", "x", (F.col("x") % 2 + 1).alias("cluster"))
    return two.union(pixels.select(F.lit(3).alias("k"), "acq_id", "y", "x", ((F.col("x") + F.col("y")) % 3 + 1).alias("cluster")))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return C.to_vectors(C.feature_space(summed(spark, sf), CHANNELS, "log"), CHANNELS)


FEATURES = "f AS (SELECT acq_id, y, x, coalesce(max(v) FILTER (channel='A'),0) AS p, coalesce(max(v) FILTER (channel='N'),0) AS q, coalesce(max(v) FILTER (channel='R'),0) AS r FROM (SELECT acq_id, channel, y, x, log10(counts+1) AS v FROM summed) GROUP BY acq_id, y, x)"
DIMENSION = "dim AS (SELECT greatest(1, power(vp+vq+vr, 2) / (vp*vp + vq*vq + vr*vr + 2*(pq*pq + pr*pr + qr*qr))) AS d FROM (SELECT var_samp(p) AS vp, var_samp(q) AS vq, var_samp(r) AS vr, covar_samp(p, q) AS pq, covar_samp(p, r) AS pr, covar_samp(q, r) AS qr FROM f))"
CLUSTERED = "l AS (SELECT 2 AS k, x % 2 + 1 AS g, * FROM f UNION ALL SELECT 3, (x+y) % 3 + 1, * FROM f), c AS (SELECT k, g, count(*) AS n, avg(p) AS mp, avg(q) AS mq, avg(r) AS mr FROM l GROUP BY 1, 2), o AS (SELECT count(*) AS n, avg(p) AS mp, avg(q) AS mq, avg(r) AS mr FROM f)"


@query(f"WITH {FEATURES}, {DIMENSION} SELECT round(d, 6) AS dimension FROM dim")
def effective_dimension(spark, sf):
    return spark.createDataFrame([(round(C.effective_dimension(_features(spark, sf)), 6),)], "dimension double")


@query(
    f"WITH {FEATURES}, {DIMENSION}, {CLUSTERED}, total AS (SELECT sum(power(p-mp,2)+power(q-mq,2)+power(r-mr,2)) AS t FROM f, o), "
    "w AS (SELECT l.k, l.g, avg(sqrt(power(p-mp,2)+power(q-mq,2)+power(r-mr,2))) AS spread, sum(power(p-mp,2)+power(q-mq,2)+power(r-mr,2)) AS w FROM l JOIN c USING (k, g) GROUP BY 1, 2), "
    "m AS (SELECT c.k, count(*) AS g, sum(w.w) AS within, sum(c.n*(power(c.mp-o.mp,2)+power(c.mq-o.mq,2)+power(c.mr-o.mr,2))) AS between_, any_value(o.n) AS n FROM c JOIN w USING (k, g), o GROUP BY 1), "
    "db AS (SELECT k, avg(worst) AS db FROM (SELECT a.k, a.g, max((u.spread+v.spread)/sqrt(power(a.mp-b.mp,2)+power(a.mq-b.mq,2)+power(a.mr-b.mr,2))) AS worst FROM c a JOIN c b ON a.k=b.k AND a.g<>b.g JOIN w u ON u.k=a.k AND u.g=a.g JOIN w v ON v.k=b.k AND v.g=b.g GROUP BY 1, 2) GROUP BY 1), "
    "pairs AS (SELECT a.k, a.y, a.x, a.g AS own, b.g, sum(sqrt(power(a.p-b.p,2)+power(a.q-b.q,2)+power(a.r-b.r,2))) AS s, count(*) AS n FROM l a JOIN l b ON a.k=b.k GROUP BY 1, 2, 3, 4, 5), "
    "near AS (SELECT k, y, x, max(s/(n-1)) FILTER (own=g) AS a, min(s/n) FILTER (own<>g) AS b FROM pairs GROUP BY 1, 2, 3), sil AS (SELECT k, avg((b-a)/greatest(a, b)) AS sil FROM near GROUP BY 1), "
    "e AS (SELECT m.*, d, t, power(k, 2/d) AS a, power(greatest(n/k, 1), 2/d) AS b FROM m, dim, total) "
    "SELECT 1 AS k, round(t,6) AS inertia, NULL::DOUBLE AS calinski_harabasz, NULL::DOUBLE AS davies_bouldin, NULL::DOUBLE AS silhouette, NULL::DOUBLE AS cubic FROM total "
    "UNION ALL SELECT k, round(within,6), round(between_/(g-1)/(within/(n-g)),6), round(db,6), round(sil,6), round(ln((1-(a-1)/(a+b-2))/(within/t))*sqrt(n*d/2)/power(0.001+(a-1)/(a+b-2),1.2),6) FROM e JOIN db USING (k) JOIN sil USING (k)"
)
def cluster_metrics(spark, sf):
    held = C.k_metrics(_features(spark, sf), _labels(spark, sf))
    return rounded(spark.createDataFrame(held, "k int, inertia double, calinski_harabasz double, davies_bouldin double, silhouette double, cubic double"))


@query("WITH v AS (SELECT (x+y) % 3 + 1 AS cluster, channel AS feature, avg(log10(counts+1)) AS v FROM summed GROUP BY 1, 2) SELECT 3 AS k, cluster, feature, round(greatest(power(10, v) - 1, 0), 4) AS counts FROM v")
def centroids_to_counts(spark, sf):
    image = summed(spark, sf)
    vecs = C.to_vectors(C.feature_space(image, CHANNELS, "log_zscored"), CHANNELS)
    centroids = C.cluster_table(vecs, _labels(spark, sf).filter("k = 3")).select("k", "cluster", "vec")
    scales = C.feature_scales(C.feature_space(image, CHANNELS, "log"), "log_zscored")
    return rounded(C.centroids_to_counts(centroids, scales, CHANNELS, "log_zscored"), 4)


@query("SELECT DISTINCT acq_id, 'k3_c' || ((x+y) % 3 + 1) AS roi, y, x FROM summed")
def cluster_masks(spark, sf):
    return C.cluster_masks(_labels(spark, sf), 3)


@query(f"WITH {FEATURES} SELECT f.acq_id, f.y, f.x, round(p,6) AS p, round(q,6) AS q, round(r,6) AS r FROM f JOIN summed s ON s.acq_id=f.acq_id AND s.y=f.y AND s.x=f.x AND s.channel='A' AND s.counts >= 2000 AND f.x <> 3")
def premask(spark, sf):
    image = summed(spark, sf)
    held = C.premask(image, _features(spark, sf), "A", 2000, image.filter("x <> 3").select("acq_id", "y", "x").distinct())
    return rounded(held.select("acq_id", "y", "x", *(F.col("vec")[i].alias(n) for i, n in enumerate("pqr"))))


METRICS = [(1, 900.0, None, None, None, None), (2, 510.0, 0.41, 120.0, 1.2, 1.5), (3, 300.0, 0.62, 260.0, 0.8, 3.0), (4, 140.0, 0.55, 250.0, 0.7, 3.5), (5, 120.0, 0.5, 270.0, 0.9, 2.0), (6, 118.0, 0.62, 200.0, 1.1, 1.0)]
METRICS_SQL = "t(k, inertia, silhouette, calinski_harabasz, davies_bouldin, cubic) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"{v}" if i == 0 else f"{v}::DOUBLE" for i, v in enumerate(r)) + ")" for r in METRICS) + ")"


@query(f"WITH {METRICS_SQL}, d AS (SELECT *, inertia - lag(inertia) OVER (ORDER BY k) AS fall FROM t), e AS (SELECT min(k) AS k0, max(k) AS k1, min(inertia) AS v0, max(inertia) AS v1, arg_min(inertia, k) AS f, arg_max(inertia, k) AS z FROM t), h AS (SELECT arg_max(k, abs((inertia-f)/(v1-v0)-(z-f)/(v1-v0)*(k-k0)/(k1-k0))) AS knee FROM t, e), p AS (SELECT arg_min(k, fall) AS fall_k, arg_max(k, silhouette*1000 - k/1000) AS sil_k, arg_max(k, calinski_harabasz) AS ch_k, arg_min(k, davies_bouldin) AS db_k, arg_max(k, cubic) AS cubic_k, max(cubic) AS cubic FROM d) SELECT CAST(least(fall_k, knee, sil_k) AS INT) AS sensible_k, CAST(fall_k AS INT) AS fall_k, CAST(knee AS INT) AS knee_k, CAST(sil_k AS INT) AS sil_k, CAST(ch_k AS INT) AS ch_k, CAST(db_k AS INT) AS db_k, CAST(cubic_k AS INT) AS cubic_k, cubic FROM p, h")
def select_k(spark, sf):
    names = ("k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin", "cubic")
    got = C.select_k([dict(zip(names, r, strict=True)) for r in METRICS])
    row = [got[c] for c in ("sensible_k", "inertia_largest_drop_k", "inertia_kneedle_k", "silhouette_peak_k", "calinski_harabasz_peak_k", "davies_bouldin_min_k", "cubic_ccc_peak_k", "cubic_ccc_max_value")]
    return spark.createDataFrame([tuple(row)], "sensible_k int, fall_k int, knee_k int, sil_k int, ch_k int, db_k int, cubic_k int, cubic double")


BANDS = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.1]


@query("WITH v(r) AS (VALUES " + ", ".join(f"({r}::DOUBLE)" for r in BANDS) + ") SELECT r, CASE WHEN r >= 0.9 THEN 'strong' WHEN r >= 0.8 THEN 'good' WHEN r >= 0.7 THEN 'moderate' ELSE 'weak' END AS band FROM v")
def cophenetic_bands(spark, sf):
    return spark.createDataFrame([(r, C.cophenetic_band(r)) for r in BANDS], "r double, band string")


# --- spectra


@query("WITH o AS (SELECT scan_id, m, counts, row_number() OVER (PARTITION BY scan_id ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM spectrum), d AS (SELECT unnest(range(-6, 7)) AS d), g AS (SELECT sum(exp(-0.5*power(d/1.5,2))) AS total FROM d), a AS (SELECT o.scan_id, o.m, d, ((i+d) % (2*n) + 2*n) % (2*n) AS j, n FROM o, d) SELECT a.scan_id, a.m, round(sum(o.counts*exp(-0.5*power(d/1.5,2)))/any_value(total),6) AS counts FROM a JOIN o ON o.scan_id=a.scan_id AND o.i=CASE WHEN j < a.n THEN j ELSE 2*a.n-1-j END, g GROUP BY 1, 2")
def gaussian_smooth(spark, sf):
    return rounded(P.gaussian_smooth(spectrum(spark, sf), 1.5))


_NEAR = "o.mu - f.mu < 40"


@query(f"WITH RECURSIVE o AS (SELECT c_nationkey AS scan_id, c_acctbal AS mu, CAST(c_custkey % 5 AS DOUBLE) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey % 5) AS i FROM customer), f(scan_id, i, mu, a, g) AS (SELECT scan_id, i, mu, a, 1 FROM o WHERE i=1 UNION ALL SELECT o.scan_id, o.i, CASE WHEN {_NEAR} THEN CASE WHEN f.a+o.a > 0 THEN (f.mu*f.a+o.mu*o.a)/(f.a+o.a) ELSE (f.mu+o.mu)/2 END ELSE o.mu END, CASE WHEN {_NEAR} THEN f.a+o.a ELSE o.a END, CASE WHEN {_NEAR} THEN f.g ELSE f.g+1 END FROM f JOIN o ON o.scan_id=f.scan_id AND o.i=f.i+1) SELECT scan_id, round(arg_max(mu, i),4) AS mu, arg_max(a, i) AS a FROM f GROUP BY scan_id, g")
def merge_near(spark, sf):
    held = table(spark, sf, "customer").select(F.col("c_nationkey").alias("scan_id"), F.col("c_acctbal").alias("mu"), (F.col("c_custkey") % 5).cast("double").alias("a"))
    return rounded(P.merge_near(held, 40.0), 4)


@query("WITH v AS (SELECT * FROM spectrum WHERE m BETWEEN 6 AND 18), n AS (SELECT scan_id FROM v GROUP BY 1 HAVING count(*) >= 5), a AS (SELECT avg(counts) AS level FROM spectrum) SELECT scan_id, m, counts FROM v JOIN n USING (scan_id)")
def spectrum_window(spark, sf):
    return P.window_of(spectrum(spark, sf), 6, 18)


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR value < 20 THEN 0 ELSE value END AS counts FROM events")
def zero_floor(spark, sf):
    return P.zero_floor(table(spark, sf, "events").select("event_id", F.col("value").alias("counts")), 20.0)


# --- names and lengths

WANTED = ["12c", "C14", "Se", "32S", "14N"]
NAMED = [(0, "12C"), (1, "13C"), (2, "12C14N"), (3, "12C15N"), (4, "32S"), (5, "SE")]


@query("WITH c(ch_idx, label) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in NAMED) + "), w(wanted) AS (VALUES " + ", ".join(f"('{x}')" for x in WANTED) + ") SELECT wanted, CAST(coalesce(min(ch_idx) FILTER (upper(label) = upper(wanted)), min(ch_idx) FILTER (contains(upper(label), upper(wanted)))) AS INT) AS ch_idx FROM w, c GROUP BY wanted")
def resolve_channel(spark, sf):
    channels = spark.createDataFrame(NAMED, "ch_idx int, label string")
    return spark.createDataFrame([(x, T.resolve_channel(channels, x)) for x in WANTED], "wanted string, ch_idx int")


FIELDS = [0.5, 1.3, 5.0, 12.5, 20.0, 51.0, 300.0]


@query("WITH f(field_um) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in FIELDS) + "), b(bar) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in batch.SCALE_BARS) + ") SELECT field_um, coalesce(max(bar) FILTER (bar < 0.4*field_um), min(bar)) AS bar FROM f, b GROUP BY 1")
def scale_bars(spark, sf):
    return spark.createDataFrame([(x, float(batch.nice_scale_bar(x))) for x in FIELDS], "field_um double, bar double")


# --- text

PERCENT = "round({} * 100, 1)"


@query(f"WITH {ROI}, t AS (SELECT s.acq_id, roi, channel, count(*) AS n, count(*)/(SELECT count(DISTINCT (y,x)) FROM summed) AS f, round(avg(counts),1) AS m, CAST(floor(sum(counts)) AS BIGINT) AS total FROM summed s JOIN r USING (y,x) GROUP BY s.acq_id, roi, channel) SELECT acq_id, roi, channel, printf('%s, %s: %d pixels (%.1f%%), mean %.1f, total %d', roi, channel, n, {PERCENT.format('f')}, m, total) AS line FROM t")
def roi_lines(spark, sf):
    return batch.roi_lines(I.roi_statistics(summed(spark, sf), rois(spark, sf)))


@query(f"WITH p AS (SELECT DISTINCT y, x FROM summed), l AS (SELECT 2 AS k, x % 2 + 1 AS cluster FROM p UNION ALL SELECT 3, (x+y) % 3 + 1 FROM p), t AS (SELECT k, cluster, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY k) AS f FROM l GROUP BY k, cluster) SELECT k, cluster, printf('cluster %d of %d: %d pixels (%.1f%%)', cluster, k, n, {PERCENT.format('f')}) AS line FROM t")
def cluster_lines(spark, sf):
    return batch.cluster_lines(_labels(spark, sf))


@query("WITH t AS (SELECT 0 AS place, 'r_name' || chr(9) || 'r_regionkey' AS line UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_name) AS INT), coalesce(r_name, 'N/A') || chr(9) || coalesce(CAST(r_regionkey AS VARCHAR), 'N/A') FROM region) SELECT place, line FROM t")
def text_table(spark, sf):
    return batch.text_table(table(spark, sf, "region").select("r_name", "r_regionkey"), ["r_name"])

"""Clusters of pixels: feature spaces, sweeps over k, scores and the choice of k.

features(acq_id, y, x, vec ARRAY<DOUBLE>): one row a pixel, one place a channel.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ionlake.functions import linkage as L
from ionlake.functions.mixtures import chord_knee, group_picks, largest_drop
from ionlake.operators.image import ACQ, PIXEL

SPACES = ("raw", "log", "log_zscored", "log_robustz", "ratios")


def feature_space(image: DataFrame, channels: list[str], space: str = "log_zscored", ratio_pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """(acq_id, y, x, feature, value) in a feature space.

    raw; log: log10(counts + 1); log_zscored: by mean and population deviation;
    log_robustz: by median and 1.4826 MAD (a spread of 0 counts as 1); ratios:
    of the pairs, 0 where not finite.  Statistics cover all pixels, before any mask.
    """
    if space not in SPACES:
        raise ValueError(f"space is one of {', '.join(SPACES)}")
    if space == "ratios":
        names = {f"{a}/{b}": (a, b) for a, b in ratio_pairs}
        part = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("counts"))), F.lit(0.0))
        cells = [F.struct(F.lit(n).alias("feature"), F.when(part(b) != 0, part(a) / part(b)).otherwise(0.0).alias("value")) for n, (a, b) in names.items()]
        return image.groupBy(*PIXEL).agg(F.array(*cells).alias("c")).select(*PIXEL, F.inline("c"))
    held = image.filter(F.col("channel").isin(*channels)).select(*PIXEL, F.col("channel").alias("feature"), (F.col("counts").cast("double") if space == "raw" else F.log10(F.col("counts") + 1)).alias("value"))
    if space in ("raw", "log"):
        return held
    stats = feature_scales(held, space)
    return held.join(stats, [ACQ, "feature"]).select(*PIXEL, "feature", ((F.col("value") - F.col("centre")) / F.col("spread")).alias("value"))


def feature_scales(values: DataFrame, space: str) -> DataFrame:
    """(acq_id, feature, centre, spread) of values(acq_id, feature, value)."""
    if space == "log_zscored":
        stats = values.groupBy(ACQ, "feature").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("spread"))
    else:
        centre = values.groupBy(ACQ, "feature").agg(F.median("value").alias("centre"))
        stats = values.join(centre, [ACQ, "feature"]).groupBy(ACQ, "feature").agg(F.first("centre").alias("centre"), (F.median(F.abs(F.col("value") - F.col("centre"))) * 1.4826).alias("spread"))
    return stats.withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0))


def to_vectors(values: DataFrame, names: list[str]) -> DataFrame:
    """(acq_id, y, x, vec) with the features in the given order, 0 where a pixel lacks one."""
    part = [F.coalesce(F.max(F.when(F.col("feature") == n, F.col("value"))), F.lit(0.0)) for n in names]
    return values.groupBy(*PIXEL).agg(F.array(*part).alias("vec"))


def premask(image: DataFrame, features: DataFrame, mask_channel: str, min_counts: float | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """features of pixels whose mask channel has min_counts or more, within pixels(acq_id, y, x) where given."""
    if min_counts is not None:
        ok = image.filter((F.col("channel") == mask_channel) & (F.col("counts") >= min_counts)).select(*PIXEL)
        features = features.join(ok, list(PIXEL), "left_semi")
    return features if pixels is None else features.join(pixels, list(PIXEL), "left_semi")


#: Numbers of features that tasks hold whole at most (64 MB); more are clustered by distributed rounds.
HELD = 1 << 23


def kmeans_sweep(features: DataFrame, k_max: int = 10, seed: int = 0, restarts: int = 5, rounds: int = 300, k_min: int = 2) -> tuple[DataFrame, DataFrame]:
    """(labels(k, acq_id, y, x, cluster), centroids(k, cluster, vec)) for k = k_min..k_max; the best of several starts by cost, clusters from 1.

    Up to HELD numbers, every k and start is a task over the broadcast features;
    beyond that each fit is a job of distributed rounds.  All pixels are
    labelled in one pass.
    """
    spark = features.sparkSession
    n, p = features.agg(F.count("*"), F.max(F.size("vec"))).first()
    if n and n * p <= HELD:
        x = np.array(features.orderBy(*PIXEL).select("vec").toArrow().column("vec").combine_chunks().flatten()).reshape(n, p)
        centres = _held_fits(spark, x, range(k_min, k_max + 1), seed, restarts, rounds)
    else:
        centres = _distributed_fits(features, range(k_min, k_max + 1), seed, restarts, rounds)
    table = spark.createDataFrame([(k, i + 1, [float(v) for v in c]) for k, cs in centres for i, c in enumerate(cs)], "k int, cluster int, vec array<double>")
    return nearest_centroid(features, table), table


def _held_fits(spark, x: np.ndarray, ks, seed: int, restarts: int, rounds: int) -> list[tuple[int, np.ndarray]]:
    import pandas as pd

    shared = spark.sparkContext.broadcast(x)

    def run(batches):
        for pdf in batches:
            fits = [L.kmeans(shared.value, int(k), int(start), rounds) for k, start in zip(pdf["k"], pdf["start"], strict=True)]
            yield pd.DataFrame({"k": pdf["k"], "start": pdf["start"], "cost": [c for c, _ in fits], "centres": [m.ravel().tolist() for _, m in fits]})

    # the largest k take longest and go first
    tasks = spark.createDataFrame([(k, seed + r) for k in sorted(ks, reverse=True) for r in range(restarts)], "k int, start int").repartition(len(ks) * restarts)
    fits = tasks.mapInPandas(run, "k int, start int, cost double, centres array<double>").collect()
    best = {k: min((f for f in fits if f["k"] == k), key=lambda f: (f["cost"], f["start"])) for k in ks}
    shared.unpersist()
    return [(k, np.array(best[k]["centres"]).reshape(k, -1)) for k in ks]


def _distributed_fits(features: DataFrame, ks, seed: int, restarts: int, rounds: int) -> list[tuple[int, list]]:
    data = features.withColumn("features", array_to_vector("vec")).cache()
    centres = []
    for k in ks:
        models = [KMeans(k=k, seed=seed + r, maxIter=rounds, initMode="k-means||", tol=1e-4).fit(data) for r in range(restarts)]
        centres.append((k, min(models, key=lambda m: m.summary.trainingCost).clusterCenters()))
    data.unpersist()
    return centres


def hash_sample(features: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of the pixel: the sample that linkage and silhouette are defined on."""
    return features.orderBy(F.xxhash64(*PIXEL, F.lit(seed)), *PIXEL).limit(n)


def hierarchical_sweep(features: DataFrame, k_max: int = 10, subsample: int = 5000, method: str = "ward", seed: int = 0) -> tuple[DataFrame, DataFrame, np.ndarray, float, DataFrame]:
    """(labels, centroids, merges, cophenetic correlation, sample labels): linkage of a sample, cut for each k; all pixels go to the nearest centroid, the sample's own labels are the cuts."""
    spark = features.sparkSession
    rows = hash_sample(features, subsample, seed).select(*PIXEL, "vec").collect()
    x = np.array([r["vec"] for r in rows], float)
    merges = L.linkage(x, method)
    centres, cuts = [], []
    for k in range(2, min(k_max, len(x)) + 1):
        own = L.cut(merges, len(x), k)
        centres += [(k, int(g), [float(v) for v in x[own == g].mean(axis=0)]) for g in np.unique(own)]
        cuts += [(k, *(r[c] for c in PIXEL), int(g)) for r, g in zip(rows, own, strict=True)]
    table = spark.createDataFrame(centres, "k int, cluster int, vec array<double>")
    pixel = ", ".join(f"{c} {features.schema[c].dataType.simpleString()}" for c in PIXEL)
    sample = spark.createDataFrame(cuts, f"k int, {pixel}, cluster int")
    return nearest_centroid(features, table), table, merges, L.cophenetic_correlation(x, merges), sample


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def nearest_centroid(features: DataFrame, centroids: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """(k, keys, cluster): the least squared distance, the first cluster on ties.

    Centroids (k_max of them a k) are held as one array a k beside each pixel, so no pixel row is multiplied.
    """
    packed = centroids.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("cluster", "vec"))).alias("cs"))
    held = features.withColumn("k", F.explode(F.array(*(F.lit(r["k"]) for r in packed.select("k").orderBy("k").collect()))))
    held = held.join(F.broadcast(packed), "k")
    best = F.array_min(F.transform("cs", lambda c: F.struct(squared_distance(F.col("vec"), c["vec"]).alias("d"), c["cluster"].alias("cluster"))))
    return held.select("k", *keys, best["cluster"].alias("cluster"))


def cluster_table(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, cluster, size, vec, within): mean vector and summed squared distance to it."""
    held = labels.join(features, list(PIXEL)).select("k", "cluster", *PIXEL, F.posexplode("vec").alias("i", "v"))
    means = held.groupBy("k", "cluster", "i").agg(F.avg("v").alias("mean"), (F.sum(F.col("v") * F.col("v")) - F.count("v") * F.avg("v") * F.avg("v")).alias("ss"), F.count("v").alias("n"))
    return means.groupBy("k", "cluster").agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("vec"), F.greatest(F.sum("ss"), F.lit(0.0)).alias("within"))


def effective_dimension(features: DataFrame) -> float:
    """(sum of eigenvalues)^2 / sum of their squares of the covariance, at least 1."""
    p = features.select(F.max(F.size("vec"))).first()[0] or 0
    cells = [F.covar_samp(F.col("vec")[i], F.col("vec")[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    if not cells:
        return 1.0
    row = features.agg(*cells).first()
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    eig = np.maximum(np.linalg.eigvalsh(cov), 1e-12)
    return max(float(eig.sum() ** 2 / (eig * eig).sum()), 1.0)


def cubic_criterion(n: int, k: int, within: float, total: float, dim: float) -> float | None:
    """An approximate cubic clustering criterion; only where its peak lies over k matters."""
    if k < 2 or k >= n or not within > 0 or not total > 0:
        return None
    seen = min(max(1 - within / total, 1e-9), 1 - 1e-9)
    a, b = k ** (2 / dim), max(n / k, 1.0) ** (2 / dim)
    if a + b - 2 <= 0:
        return None
    expected = min(max((a - 1) / (a + b - 2), 1e-9), 1 - 1e-9)
    return float(np.log((1 - expected) / (1 - seen)) * np.sqrt(n * dim / 2) / (0.001 + expected) ** 1.2)


def k_metrics(features: DataFrame, labels: DataFrame, sample: int = 5000, seed: int = 0) -> list[dict]:
    """For each k: inertia, calinski_harabasz, davies_bouldin, silhouette (on a hash sample), cubic; k = 1 has the total scatter."""
    table = cluster_table(features, labels).collect()
    everything = cluster_table(features, features.select(F.lit(1).alias("k"), *PIXEL, F.lit(1).alias("cluster"))).first()
    n, total, dim = everything["size"], everything["within"], effective_dimension(features)
    picked = hash_sample(features, sample, seed).join(labels, list(PIXEL)).select("k", "cluster", "vec").collect()
    out = [{"k": 1, "inertia": total, "calinski_harabasz": None, "davies_bouldin": None, "silhouette": None, "cubic": None}]
    centre = np.array(everything["vec"])
    for k in sorted({r["k"] for r in table}):
        own = sorted((r for r in table if r["k"] == k), key=lambda r: r["cluster"])
        c, size, within = np.array([r["vec"] for r in own]), np.array([r["size"] for r in own]), sum(r["within"] for r in own)
        between = float((size * ((c - centre) ** 2).sum(axis=1)).sum())
        g = len(own)
        ch = between / (g - 1) / (within / (n - g)) if g > 1 and within > 0 and n > g else None
        rows = [r for r in picked if r["k"] == k]
        sil = L.silhouette(np.array([r["vec"] for r in rows]), np.array([r["cluster"] for r in rows])) if rows else float("nan")
        out.append({"k": k, "inertia": within, "calinski_harabasz": ch, "davies_bouldin": None, "silhouette": None if np.isnan(sil) else sil, "cubic": cubic_criterion(n, k, within, total, dim)})
    scatter = mean_distances(features, labels, cluster_table(features, labels))
    for m in out[1:]:
        m["davies_bouldin"] = davies_bouldin([r for r in table if r["k"] == m["k"]], {r["cluster"]: r["spread"] for r in scatter if r["k"] == m["k"]})
    return out


def mean_distances(features: DataFrame, labels: DataFrame, table: DataFrame) -> list:
    """(k, cluster, spread): mean distance of a cluster's pixels to its centroid."""
    held = labels.join(features, list(PIXEL)).join(table.select("k", "cluster", F.col("vec").alias("centre")), ["k", "cluster"])
    return held.groupBy("k", "cluster").agg(F.avg(F.sqrt(squared_distance(F.col("vec"), F.col("centre")))).alias("spread")).collect()


def davies_bouldin(table: list, spread: dict[int, float]) -> float | None:
    if len(table) < 2:
        return None
    c, s = np.array([r["vec"] for r in table]), np.array([spread[r["cluster"]] for r in table])
    d = L.distances(c)
    np.fill_diagonal(d, np.inf)
    with np.errstate(divide="ignore"):
        return float(((s[:, None] + s) / d).max(axis=1).mean())


def select_k(metrics: list[dict]) -> dict:
    """Six picks of k and the careful one: the least of largest drop, chord knee and silhouette peak (2 without any)."""
    inertia = [(m["k"], m["inertia"]) for m in metrics if m["inertia"] is not None]
    curve = [v for _, v in inertia]
    pick = lambda name, best: (lambda own: best(own, key=lambda m: (m[name], -m["k"] if best is max else m["k"]))["k"] if own else None)([m for m in metrics if m["k"] > 1 and m.get(name) is not None])
    drop, knee = (largest_drop(curve), chord_knee(curve)) if len(curve) > 1 else (None, None)
    sil, ch, db, cubic = pick("silhouette", max), pick("calinski_harabasz", max), pick("davies_bouldin", min), pick("cubic", max)
    careful = [k for k in (drop, knee, sil) if k]
    picks = [("inertia_largest_drop", drop), ("inertia_kneedle", knee), ("silhouette_peak", sil), ("calinski_harabasz_peak", ch), ("davies_bouldin_min", db), ("cubic_ccc_peak", cubic)]
    return {"sensible_k": min(careful) if careful else 2, **{f"{n}_k": k for n, k in picks}, "cubic_ccc_max_value": max((m["cubic"] for m in metrics if m.get("cubic") is not None), default=None), "recommendations": group_picks(picks)}


def centroids_to_counts(centroids: DataFrame, scales: DataFrame | None, names: list[str], space: str) -> DataFrame:
    """centroids(k, cluster, feature, counts): back in counts, at least 0; ratios as they are.  scales: feature_scales of one acquisition."""
    held = centroids.select("k", "cluster", F.posexplode("vec").alias("i", "v")).withColumn("feature", F.get(F.array(*(F.lit(n) for n in names)), F.col("i")))
    if space in ("log_zscored", "log_robustz"):
        held = held.join(scales.select("feature", "centre", "spread"), "feature").withColumn("v", F.col("v") * F.col("spread") + F.col("centre"))
    value = F.pow(F.lit(10.0), F.col("v")) - 1 if space.startswith("log") else F.col("v")
    return held.select("k", "cluster", "feature", F.greatest(value, F.lit(0.0)).alias("counts"))


def cluster_masks(labels: DataFrame, k: int) -> DataFrame:
    """roi_pixels of the clusters of one k, named k{k}_c{cluster}."""
    return labels.filter(F.col("k") == k).select(ACQ, F.concat(F.lit(f"k{k}_c"), F.col("cluster")).alias("roi"), "y", "x")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("k", "cluster").agg(F.count("*").alias("size"))


def cophenetic_band(r: float) -> str:
    return "strong" if r >= 0.9 else "good" if r >= 0.8 else "moderate" if r >= 0.7 else "weak"


def dendrogram_heights(merges: np.ndarray, k: int, last: int = 30) -> dict:
    """Height above which k clusters remain, and the heights of the last merges."""
    h = np.sort(merges[:, 2])
    return {"cut": float(h[-(k - 1)]) if 1 < k <= len(h) + 1 else None, "last": h[-last:].tolist()}


def cluster_pixels(image: DataFrame, channels: list[str], method: str = "kmeans", k_max: int = 10, space: str = "log_zscored", ratio_pairs: list[tuple[str, str]] = (), min_counts: float | None = None, mask_channel: str | None = None, pixels: DataFrame | None = None, subsample: int = 5000, linkage: str = "ward", seed: int = 0) -> dict:
    """Features, mask, sweep, metrics and choice of k in one call; labels and centroids as DataFrames.

    All acquisitions of image share one set of clusters; filter the image for
    clusters of one.
    """
    names = [f"{a}/{b}" for a, b in ratio_pairs] if space == "ratios" else channels
    values = feature_space(image, channels, space, ratio_pairs)
    features = premask(image, to_vectors(values, names), mask_channel or channels[0], min_counts, pixels).cache()
    extra = {}
    if method == "kmeans":
        labels, centroids = kmeans_sweep(features, k_max, seed)
    elif method == "hierarchical":
        labels, centroids, merges, corr, scored = hierarchical_sweep(features, k_max, subsample, linkage, seed)
        extra = {"merges": merges, "cophenetic": corr, "cophenetic_band": cophenetic_band(corr)}
    else:
        raise ValueError("method is kmeans or hierarchical")
    labels = labels.cache()
    # linkage is scored on the sample that it clustered
    seen = features if method == "kmeans" else features.join(scored.select(*PIXEL).distinct(), list(PIXEL), "left_semi")
    metrics = k_metrics(seen, labels if method == "kmeans" else scored, seed=seed)
    scales = feature_scales(feature_space(image, channels, "log"), space) if space in ("log_zscored", "log_robustz") else None
    labels.unpersist()
    features.unpersist()
    return {"labels": labels, "centroids": centroids, "counts": centroids_to_counts(centroids, scales, names, space), "metrics": metrics, "selection": select_k(metrics), **extra}

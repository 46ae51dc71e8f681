"""Image operators on synthetic stacks with known truth."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.functions import linkage as L, mixtures as M, pixels as X
from ionlake.operators import clusters as C, distributions as D, image as I, tiles as T
from ionlake.plans import catalog

VOXEL = "acq_id int, plane int, channel string, y int, x int, counts long"


def voxels(spark, stack, channels, acq=1):
    p, c, h, w = stack.shape
    rows = [(acq, int(a), channels[b], int(y), int(x), int(stack[a, b, y, x])) for a in range(p) for b in range(c) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, VOXEL)


def regions(side=32, seed=0):
    """Three regions over channels A, B, C: (counts, labels)."""
    rng = np.random.default_rng(seed)
    lab = np.zeros((side, side), int)
    lab[6:26, 6:26] = 1
    lab[12:17, 14:20] = 2
    mean = np.array([[5, 60, 900], [40, 80, 200], [10, 500, 60]], float)
    return np.stack([rng.poisson(mean[c][lab]) for c in range(3)]), lab


def test_bad_planes_are_found_and_dropped(spark):
    rng = np.random.default_rng(0)
    stack = rng.poisson(20, (12, 2, 8, 8))
    for p, f in ((3, 2.0), (7, 0.2), (9, 1.8)):
        stack[p] = (stack[p] * f).astype(int)
    v = voxels(spark, stack, ["A", "SE"])
    assert {r.plane for r in I.plane_qc(v).filter("suspect").collect()} == {3, 7, 9}
    left = I.auto_drop(v)
    assert [r.plane for r in left.select("plane").distinct().orderBy("plane").collect()] == list(range(9))
    assert {r.orig_plane for r in left.select("orig_plane").distinct().collect()} == set(range(12)) - {3, 7, 9}
    everything = v.select("acq_id", "plane").distinct()
    assert I.drop_planes(v, everything).select("plane").distinct().count() == 12
    one = v.filter("plane = 0")
    assert I.plane_qc(one).first().suspect is None


def test_binning_keeps_cropped_totals(spark):
    img = np.arange(70).reshape(1, 1, 7, 10)
    image = I.sum_stack(voxels(spark, img, ["A"]))
    for n in (2, 3):
        got = I.bin_sum(image, n).agg(F.sum("counts")).first()[0]
        assert got == img[0, 0, : 7 // n * n, : 10 // n * n].sum()
    assert I.bin_sum(image, 8).count() == 70 and I.bin_sum(image, 1).count() == 70


def test_ratio_edges(spark):
    stack = np.zeros((1, 2, 1, 5), int)
    stack[0, 0, 0], stack[0, 1, 0] = [0, 4, 0, 9, 9], [4, 0, 0, 3, 9]
    out = {r.x: r for r in I.ratio(voxels(spark, stack, ["A", "B"]), "A", "B", min_counts=4).collect()}
    assert (out[0].ratio, out[0].sigma, out[0].rel_err, out[0].valid) == (0.0, None, float("inf"), True)
    assert not any(out[k].valid or out[k].ratio is not None for k in (1, 2, 3))
    assert out[4].ratio == 1 and out[4].sigma**2 == pytest.approx(2 / 9)
    strict = {r.x: r.valid for r in I.ratio(voxels(spark, stack, ["A", "B"]), "A", "B", max_rel_err=0.5).collect()}
    assert strict == {0: False, 1: False, 2: False, 3: False, 4: True} or not strict[0]


def test_statistics_follow_masks(spark):
    counts, lab = regions(16)
    v = voxels(spark, counts[None], ["A", "B", "C"])
    image = I.sum_stack(v)
    rules = [{"name": "hot", "channel": "A", "mode": "counts", "cutoff": 300}, {"channel": "B", "mode": "percentile", "cutoff": 50}]
    held = {how: I.build_roi_masks(image, rules, how) for how in ("AND", "OR")}
    pixels = {how: {n: {(r.y, r.x) for r in held[how].filter(F.col("roi") == n).collect()} for n in ("hot", "rule_1", "combined")} for how in held}
    assert pixels["AND"]["combined"] == pixels["AND"]["hot"] & pixels["AND"]["rule_1"]
    assert pixels["OR"]["combined"] == pixels["OR"]["hot"] | pixels["OR"]["rule_1"]
    total = {(r.roi, r.channel): r.total for r in I.roi_statistics(image, held["OR"]).collect()}
    assert total["hot", "A"] == counts[0][counts[0] >= 300].sum()
    empty = I.roi_statistics(image, held["OR"], spark.createDataFrame([(1, "none")], "acq_id int, roi string")).collect()
    assert [(r.roi, r.n_pixels, r["mean"]) for r in empty] == [("none", 0, None)]
    depth = {r.roi: r["sum(value)"] for r in I.depth_profile(v, held["OR"], "A").groupBy("roi").agg(F.sum("value")).collect()}
    assert depth["hot"] == total["hot", "A"]


@pytest.mark.parametrize("shape", [(32, 32), (24, 40)])
def test_drift_is_found_and_undone(spark, shape):
    rng = np.random.default_rng(1)
    base = rng.poisson(np.kron(rng.integers(0, 200, (shape[0] // 4, shape[1] // 4)), np.ones((4, 4))))
    moves = [(0, 0), (2, -3), (-4, 5), (1, 1), (6, 0)]
    stack = np.stack([[np.roll(base, m, (0, 1))] for m in moves])
    v = voxels(spark, stack, ["SE"])
    shifts = T.plane_shifts(v, "SE")
    assert {r.plane: (r.dy, r.dx) for r in shifts.collect()} == {p: (-dy, -dx) for p, (dy, dx) in enumerate(moves)}
    fixed = T.apply_shifts(v, shifts, *shape).filter("plane = 2").collect()
    inner = [(r.y, r.x, r.counts) for r in fixed if 8 <= r.y < shape[0] - 8 and 8 <= r.x < shape[1] - 8]
    assert inner and all(base[y, x] == c for y, x, c in inner)


def test_trailing_planes_take_the_last_group(spark):
    rng = np.random.default_rng(2)
    base = rng.poisson(50, (16, 16)) * np.kron(rng.integers(1, 9, (4, 4)), np.ones((4, 4), int))
    stack = np.stack([[np.roll(base, 3 * (p // 5 > 0), 0)] for p in range(12)])
    got = {r.plane: r.dy for r in T.plane_shifts(voxels(spark, stack, ["SE"]), "SE", bin_planes=5).collect()}
    assert got == {p: 0 if p < 5 else -3 for p in range(12)}
    assert T.plane_shifts(voxels(spark, stack[:6], ["SE"]), "SE", bin_planes=5).count() == 0
    assert T.plane_shifts(voxels(spark, stack, ["SE"]), "SE", bin_planes=5, bin_apply="super").count() == 2


def test_clusters_find_three_regions(spark):
    counts, lab = regions(24)
    image = I.sum_stack(voxels(spark, counts[None], ["A", "B", "C"]))
    for method in ("kmeans", "hierarchical"):
        out = C.cluster_pixels(image, ["A", "B", "C"], method, k_max=4)
        three = {(r.y, r.x): r.cluster for r in out["labels"].filter("k = 3").collect()}
        pairs = {(int(lab[p]), c) for p, c in three.items()}
        assert len(three) == 576 and len(pairs) == 3
        metrics = {m["k"]: m for m in out["metrics"]}
        x = np.array([r.vec for r in C.to_vectors(C.feature_space(image, ["A", "B", "C"]), ["A", "B", "C"]).collect()])
        assert metrics[1]["inertia"] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
        assert out["selection"]["silhouette_peak_k"] == 3 and out["selection"]["sensible_k"] in (2, 3)
        assert out["counts"].filter("counts < 0").count() == 0


def test_linkage_small():
    x = np.array([[0.0], [1.0], [5.0], [6.5], [20.0]])
    heights = {"single": [1, 1.5, 4, 13.5], "complete": [1, 1.5, 6.5, 20], "average": [1, 1.5, 5.25, 16.875]}
    for method, h in heights.items():
        assert L.linkage(x, method)[:, 2] == pytest.approx(h)
    assert L.linkage(x, "ward")[0, 2] == pytest.approx(1) and L.linkage(x, "ward")[1, 2] == pytest.approx(1.5)
    assert L.linkage(x, "ward")[2, 2] == pytest.approx(np.sqrt(2 * 2 * 2 / 4) * 5.25)
    assert L.cut(L.linkage(x, "average"), 5, 3).tolist() == [1, 1, 2, 2, 3]
    assert 0.7 < L.cophenetic_correlation(x, L.linkage(x, "average")) <= 1


def test_mixture_finds_two_populations(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.poisson(20, 2500), rng.poisson(600, 1500)])
    fit = M.fit_channel(values)
    assert fit["sensible_k"] == 2 and fit["fits"][1]["components"][0]["weight"] == pytest.approx(0.625, abs=0.01)
    assert 40 < fit["fits"][1]["thresholds"][0] < 500
    rows = [(1, "A", 0, k, float(v)) for k, v in enumerate(values)] + [(1, "few", 0, k, 3.0) for k in range(10)]
    fits = D.fit_mixtures(spark.createDataFrame(rows, "acq_id int, channel string, y int, x int, counts double"), k_max=3)
    cuts = {r.channel: r.thresholds for r in D.best_thresholds(fits).collect()}
    assert list(cuts) == ["A"] and len(cuts["A"]) == 1
    image = spark.createDataFrame(rows, "acq_id int, channel string, y int, x int, counts double")
    assert I.mask_gmm_component(image, "A", cuts["A"], "highest").count() == 1500


def test_tail_warning_and_elbows():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.lognormal(2, 0.3, 6000), rng.lognormal(4, 0.3, 6000), rng.lognormal(6.5, 0.2, 300)])
    fit = M.fit_channel(v, jitter=False)
    assert fit["largest_drop_k"] == 2 and fit["tail_warning"]["suggested_k"] == 3
    assert M.largest_drop([5.0]) == 1 and M.chord_knee([9, 1]) == 2 and M.chord_knee([10, 3, 1, 0.5, 0]) == 2


def test_pixel_kernels():
    diag = np.zeros((8, 8), bool)
    diag[2, 2] = diag[3, 3] = True
    assert X.label(diag, 8).max() == 1 and X.label(diag, 4).max() == 2
    y, x = np.indices((64, 64))
    disc = (y - 30) ** 2 + (x - 33) ** 2 <= 100
    ring = disc & ~((y - 30) ** 2 + (x - 33) ** 2 <= 25)
    assert (X.fill_holes(ring) == disc).all()
    lines = X.contours(disc)
    assert len(lines) == 1 and (lines[0][0] == lines[0][-1]).all() and len(X.contours(ring)) == 2
    p = lines[0]
    assert abs(0.5 * np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1])) == pytest.approx(disc.sum(), rel=0.15)
    noisy = disc * 100.0 + np.random.default_rng(0).normal(0, 3, disc.shape)
    assert (X.detect(noisy, "otsu", 0) == disc).mean() > 0.99 and X.canny(disc * 1.0).sum() > 30
    assert X.median2d(np.pad([[9.0]], 3))[3, 3] == 0 and X.smooth2d(np.ones((5, 5)), 2) == pytest.approx(np.ones((5, 5)))


def test_regions_components_and_names(spark):
    img = np.zeros((1, 1, 40, 40), int)
    img[0, 0, 3:13, 3:13], img[0, 0, 20:26, 20:26], img[0, 0, 35, 35] = 90, 90, 90
    image = I.sum_stack(voxels(spark, img, ["A"]))
    found = T.detect_regions(image, "A", "percentile", sigma=0, percentile=80, min_area=20)
    area = {r.roi: r["count"] for r in found.groupBy("roi").count().collect()}
    assert area == {"r1": 100, "r2": 36}
    assert {r.roi for r in T.detect_regions(image, "A", "otsu", 0, merge=True).select("roi").distinct().collect()} == {"edge_all"}
    parts = T.components(found.withColumn("roi", F.lit("all")), 8, 50)
    assert parts.select("region").distinct().count() == 1
    named = I.union_rois(I.union_rois(found, found.filter("roi = 'r1'")), found.filter("roi = 'r1'"))
    assert {r.roi for r in named.select("roi").distinct().collect()} == {"r1", "r2", "r1_2", "r1_3"}
    assert I.union_rois(found, found.filter("roi = 'r1'"), rename=False).count() == found.count()
    assert I.decimation_step(10, 1024, 1024) == 8


@pytest.mark.parametrize(("name", "ks"), [("gmm_fit", range(1, 7)), ("linkage_labels", range(2, 11))])
def test_registered_sweeps_reach_the_default_k(spark, name, ks):
    out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(r.k for r in out.select("k").distinct().collect()) == list(ks)


def test_point_cloud_caps_each_acquisition(spark):
    rows = [(a, p, "A", y, x, float(a * 1000 + p * 100 + y * 10 + x)) for a in (1, 2) for p in range(4) for y in range(5) for x in range(5)]
    voxels = spark.createDataFrame(rows, "acq_id int, plane int, channel string, y int, x int, counts double")
    out = I.point_cloud(voxels, "A", 50, cap=7).collect()
    assert sorted(r.acq_id for r in out) == [1] * 7 + [2] * 7
    alone = I.point_cloud(voxels.filter("acq_id = 2"), "A", 50, cap=7).collect()
    assert {tuple(r) for r in out if r.acq_id == 2} == {tuple(r) for r in alone}


def test_union_of_names_that_meet_among_the_added(spark):
    pixel = lambda names: spark.createDataFrame([(1, n, k, 0) for k, n in enumerate(names)], "acq_id int, roi string, y int, x int")
    out = I.union_rois(pixel(["a"]), pixel(["a", "a_2"]))
    assert sorted(r.roi for r in out.collect()) == ["a", "a_2", "a_3"]
    both = I.union_rois(pixel(["a", "a_2"]), pixel(["a", "a_2", "b"]))
    assert sorted(r.roi for r in both.collect()) == ["a", "a_2", "a_2_2", "a_3", "b"]


def test_kmeans_of_held_features(spark):
    rng = np.random.default_rng(5)
    middle = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0], [0, 0, 8.0]])
    own = rng.integers(4, size=900)
    x = middle[own] + rng.normal(size=(900, 3)) * 0.5
    rows = [(1, k // 30, k % 30, v.tolist()) for k, v in enumerate(x)]
    features = spark.createDataFrame(rows, "acq_id int, y int, x int, vec array<double>")
    labels, table = C.kmeans_sweep(features, 5)
    found = {(r.y, r.x): r.cluster for r in labels.filter("k = 4").collect()}
    groups = {}
    for k, g in enumerate(own):
        groups.setdefault(int(g), set()).add(found[k // 30, k % 30])
    assert all(len(v) == 1 for v in groups.values()) and len(set.union(*groups.values())) == 4
    for k in (2, 3, 4, 5):
        c = np.array([r.vec for r in table.filter(f"k = {k}").orderBy("cluster").collect()])
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        # near a fixed point of the plain rounds: each centre is its points' mean, each point at its nearest centre
        assert np.allclose(c, [x[near == j].mean(axis=0) for j in range(k)], atol=0.05)
        got = {(r.y, r.x): r.cluster for r in labels.filter(f"k = {k}").collect()}
        assert all(got[i // 30, i % 30] == j + 1 for i, j in enumerate(near))
    cost, centres = L.kmeans(x, 4, 0)
    assert cost == pytest.approx(((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum(), rel=1e-3)
    assert L.kmeans(np.ones((5, 2)), 3, 0)[0] == pytest.approx(0)

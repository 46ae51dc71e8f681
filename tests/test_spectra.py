"""Spectra and species with known truth."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.functions import peaks as P, tables as T
from ionlake.operators import species as S, spectra as O
from ionlake.plans import catalog

M = np.arange(27.40, 27.44, 1e-4)


def scan(*peaks, noise=True, w=0.006, sigma=0.0006, seed=0):
    c = sum(P.slit_peak(M, a, mu, w, sigma) for mu, a in peaks)
    return np.random.default_rng(seed).poisson(c).astype(float) if noise else c


def frame(spark, **scans):
    return spark.createDataFrame([(n, float(m), float(v)) for n, c in scans.items() for m, v in zip(M, c, strict=True)], "scan_id string, m double, counts double")


def test_peak_shape():
    y = P.slit_peak(M, 100, 27.42, 0.006, 0.0006)
    assert y.max() == pytest.approx(100, abs=0.1) and np.trapezoid(y, M) == pytest.approx(0.6, rel=1e-3)
    assert set(P.slit_peak(M, 5, 27.42, 0.006, 0)) == {0.0, 5.0}


def test_edge_and_resolving_power():
    c = scan((27.42, 20_000))
    for side in ("rising", "falling"):
        fit = P.fit_edge(M, c, side)
        assert fit["success"] and fit["sigma"] == pytest.approx(0.0006, rel=0.05)
    assert P.fit_edge(M, c)["mu"] == pytest.approx(27.417, abs=1e-4)
    power = P.resolving_power(M, c)
    assert power["dm"] == pytest.approx(2 * 1.28155 * 0.0006, rel=0.06) and power["mass"] == 27
    assert P.fit_edge(M[:3], c[:3])["success"] is False


def test_fit_of_two_peaks():
    c = scan((27.415, 10_000), (27.421, 500))
    fits = P.sweep_peaks(M, c, 1, 3)
    best = min(fits, key=lambda f: f["bic"])
    assert len(best["peaks"]) == 2 and best["sigma"] == pytest.approx(0.0006, rel=0.1)
    assert [p["mu"] for p in best["peaks"]] == pytest.approx([27.415, 27.421], abs=3e-4)
    assert [p["a"] for p in best["peaks"]] == pytest.approx([10_000, 500], rel=0.1)
    assert all(0 < p["mu_se"] < 2e-3 and p["a_se"] > 0 for p in best["peaks"])
    three = P.fit_peaks(M, c, 3, [27.415, 27.421, 27.435], [1e4, 500, 1.0])
    assert len(P.significant_peaks(M, c, three)["peaks"]) == 2


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(0)
    d = rng.random((60, 12))
    y = d @ np.maximum(rng.normal(size=12), 0) + 3 + rng.normal(size=60) * 0.01
    for alpha, l1 in ((0.001, 1.0), (0.01, 1.0), (0.01, 0.5)):
        b = P.positive_elastic_net(d, y, alpha, l1, 20_000, 1e-10)
        dc, yc = d - d.mean(axis=0), y - y.mean()
        g = dc.T @ (yc - dc @ b) / 60 - alpha * l1 - alpha * (1 - l1) * b
        assert (b >= 0).all() and np.abs(g[b > 0]).max(initial=0) < 1e-6 and (g[b == 0] < 1e-6).all()


def test_sparse_pipeline(spark):
    c = scan((27.412, 8000), (27.424, 1500))
    df = frame(spark, s=c)
    picked = [r.position for r in O.stability_select(df, 0.006, 0.0006, n_lambdas=8).filter("selected").collect()]
    assert sorted(picked) == pytest.approx([27.412, 27.424], abs=6e-4)
    fit = O.deconvolve_sparse(df, n_lambdas=8).first()
    assert [p.mu for p in fit.peaks] == pytest.approx([27.412, 27.424], abs=2e-4)
    assert O.deconvolve_sparse(frame(spark, flat=np.zeros(len(M))), n_lambdas=3).count() == 0


def test_sweep_runs_by_scan(spark):
    df = frame(spark, one=scan((27.42, 5000)), two=scan((27.412, 5000), (27.424, 3000)))
    best = {r.scan_id: r.n for r in O.best_by_bic(O.deconvolve_sweep(df, 1, 2)).collect()}
    assert best == {"one": 1, "two": 2}
    edges = {r.scan_id: r for r in O.fit_edges(df).collect()}
    assert edges["one"].sigma == pytest.approx(0.0006, rel=0.1)


def test_line_spread(spark):
    df = frame(spark, one=scan((27.42, 50_000)), flat=np.full(len(M), 7.0))
    out = O.line_spread(df).collect()
    assert [r.scan_id for r in out] == ["one"]
    r = out[0]
    assert r.n_peaks >= 1 and r.dm == pytest.approx(2 * 1.28155 * 0.0006, rel=0.08)
    exact = P.line_spread(M, scan((27.42, 1000), noise=False))
    assert exact["n_peaks"] == 1 and exact["slit_width"] == pytest.approx(0.006, abs=2e-4)
    rise = exact["edges"]["rising"]
    assert rise["fwhm"] == pytest.approx(2.3548 * 0.0006, abs=2e-4) and rise["mtf"][0] == 1 and not rise["distorted"]
    assert P.line_spread(M, scan((27.42, 10)), window=(1.0, 1.1)) is None


def test_smoothing_and_maxima():
    y = np.array([0, 1, 0, 3, 3, 0, 2, 0.0])
    assert P.local_maxima(y).tolist() == [1, 3, 6] and P.local_maxima(y, 2.5).tolist() == [3]
    assert P.local_maxima(y, distance=4).tolist() == [3] and P.local_maxima(y, prominence=1.5).tolist() == [3, 6]
    assert P.gaussian_smooth(np.full(9, 4.0), 2) == pytest.approx(np.full(9, 4.0))
    assert P.moving_average([3, 3, 3]) == pytest.approx([2, 3, 2])


def test_sql_forms_equal_kernels(spark):
    c = scan((27.42, 900), noise=False)
    df = frame(spark, s=c)
    got = [r.gradient for r in O.gradient(df).orderBy("m").collect()]
    assert got == pytest.approx(np.gradient(c, M), rel=1e-6, abs=1e-6)
    a, b = O.moments(df).first(), P.weighted_moments(M, c)
    assert (a.centre, a.fwhm, a.skew, a.kurtosis) == pytest.approx((b["centre"], b["fwhm"], b["skew"], b["kurtosis"]), abs=1e-5)
    r, k = O.resolving_power(df).first(), P.resolving_power(M, c)
    assert (r.dm, r.mrp, r.m10) == pytest.approx((k["dm"], k["mrp"], k["m10"]))
    merged = O.merge_near(spark.createDataFrame([("s", 1.0, 1.0), ("s", 1.1, 3.0), ("s", 1.16, 4.0), ("s", 3.0, 0.0), ("s", 3.05, 0.0)], "scan_id string, mu double, a double"), 0.1).orderBy("mu").collect()
    expected = P.merge_peaks([{"mu": 1.0, "a": 1.0}, {"mu": 1.1, "a": 3.0}, {"mu": 1.16, "a": 4.0}, {"mu": 3.0, "a": 0.0}, {"mu": 3.05, "a": 0.0}], 0.1)
    assert [v for x in merged for v in (x.mu, x.a)] == pytest.approx([v for x in expected for v in (x["mu"], x["a"])])
    assert O.window_of(df, 27.41, 27.4101).count() == 0 and O.window_of(df, 2, 1).count() == len(M)
    bad = spark.createDataFrame([("s", 1.0, None), ("s", 2.0, float("nan")), ("s", 3.0, 5e-4), ("s", 4.0, 2.0)], "scan_id string, m double, counts double")
    assert [x.counts for x in O.zero_floor(bad).orderBy("m").collect()] == [0, 0, 0, 2]


def test_ions(spark):
    ions = S.enumerate_ions(spark, ["C", "N", "Xx"], 26)
    got = {r.formula: r for r in ions.collect()}
    assert got["12C14N-"].mz == pytest.approx(12 + 14.00307401 + T.ELECTRON) and got["12C14N-"].plausibility == pytest.approx(0.9893 * 0.99636 * 0.3)
    assert "13C2-" in got and all(r.total_atoms <= 4 for r in got.values())
    assert max(r.plausibility for r in S.enumerate_ions(spark, ["C", "N"], 26, ignore_abundance=True).collect()) == pytest.approx(0.3)
    cations = S.enumerate_ions(spark, ["Ca"], 20, polarity=1)
    assert {r.formula: r.charge for r in cations.collect()}["40Ca2+"] == 2
    assert S.enumerate_ions(spark, ["H"], 9).count() == 0
    assert S.enumerate_ions(spark, ["H"], 2).select("formula").collect()[0][0] in ("1H2-", "2H-")


def test_assignments(spark):
    ions = S.enumerate_ions(spark, ["C", "N", "H"], 26, mz_tol=0.1).cache()
    mz = {r.formula: r.mz for r in ions.collect()}
    true = ["12C14N-", "13C2-", "12C2" + "1H2-"]
    peaks = spark.createDataFrame([("s", i, mz[f] + 0.01) for i, f in enumerate(true)], "scan_id string, peak_index int, observed double")
    named = {r.peak_index: r for r in S.identify_by_difference(peaks, ions, 0, "12C14N-").collect()}
    assert [named[i].formula for i in range(3)] == true and abs(named[1].err_mau) < 1e-6
    assert S.identify_by_difference(peaks, ions, 0, "99Zz-").count() == 0
    blind = S.identify_blind(peaks, ions)
    best = blind.filter("rank = 1").first()
    assert best.assignment == " ".join(true) and best.rms_mau < 1e-6 and blind.count() <= 5
    assert S.confidence(blind).first().confidence in ("clear winner", "moderate", "weak")
    match = S.match_by_separation(peaks, ions).first()
    assert match.assignment == " ".join(true) and match.score == match.rms_mau


def test_lookups(spark):
    assert len(T.isotope_rows()) == 147 and T.reference_ratio("12C15N", "12C14N") == 0.0036765 and T.reference_ratio("x", "y") is None
    ch = spark.createDataFrame([(0, "12C 14N"), (1, "12C"), (2, "SE"), (3, "Secondary x")], "ch_idx int, label string")
    assert [T.resolve_channel(ch, w) for w in ("12c", "14n", 7)] == [1, 0, 7]
    with pytest.raises(KeyError):
        T.resolve_channel(ch, "zz")
    assert [r[0] for r in ch.orderBy("ch_idx").select(T.is_se_channel("label")).collect()] == [False, False, True, True]
    row = spark.range(1).select(T.index_list(F.lit("3,7;12 x")).alias("a"), T.lenient_number(F.lit(" 4.5 ")).alias("b"), T.lenient_number(F.lit("n/a")).alias("c"), T.strip_copy_mark(F.lit("12C (1)")).alias("d"), T.axis_name(F.lit("X (µm)")).alias("e")).first()
    assert tuple(row) == ([3, 7, 12], 4.5, None, "12C", "xum")


def test_mass_match_takes_every_channel(spark):
    sf = "/root/testdata/sf0.01"
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_retailprice").toPandas()
    keys = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").toPandas().s_suppkey.to_numpy()
    mass = 10 + (900 + keys * 7 % 1100) / 20
    expected = {}
    for k, price in zip(part.p_partkey, part.p_retailprice, strict=True):
        d, row, m = min(zip(np.abs(mass - (10 + price / 20)), keys, mass, strict=True))
        if d < 0.05:
            expected[k] = (row, round(m, 6))
    got = {r.ch_idx: (r.row_index, r.mass_amu) for r in catalog.QUERIES["mass_match"](spark, sf).collect()}
    assert got == expected


def most_rows(plan):
    """The most rows that any step of a plan that has run put out."""
    kind, own = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_mass_match_measures_no_pairs_of_a_whole_mass(spark):
    """2,000 channels and 2,000 rows of one whole mass are 4 million pairs."""
    n = 2000
    channels = spark.range(n).selectExpr("0 AS acq_id", "int(id) AS ch_idx", f"55.2 + 0.6D * id / {n} AS nom_mass")
    rows = spark.range(n).selectExpr("0 AS acq_id", "int(id) AS row_index", f"55.2 + 0.6D * (id + 0.25D) / {n} AS mass_amu")
    out = S.match_mass_rows(channels, rows)
    assert {r.ch_idx: r.row_index for r in out.collect()} == {k: k for k in range(n)}
    assert n <= most_rows(out._jdf.queryExecution().executedPlan()) <= 6 * n


@pytest.mark.parametrize(("tolerance", "step"), [(0.05, 0.05), (0.05, 0.0125), (0.7, 0.1), (3.0, 0.5), (0.0, 0.05)])
def test_mass_match_equals_trying_every_pair(spark, tolerance, step):
    """Masses on a grid, so that many are equal, equally near or just at the tolerance; missing and odd ones, several acquisitions, channels that are there twice."""
    rng = np.random.default_rng(5)
    odd = [None, 0.0, float("nan"), float("inf"), float("-inf")]
    mass = lambda: odd[rng.integers(5)] if rng.random() < 0.05 else float(rng.integers(-400, 400) * step if rng.random() < 0.7 else rng.uniform(-200, 200) * step)
    channels = [([0, 0, 1, 2, None][rng.integers(5)], [k, k // 3, None][rng.integers(3)], mass()) for k in range(500)]
    rows = [([0, 0, 1, 3, None][rng.integers(5)], [k, k // 2][rng.integers(2)], mass()) for k in range(400)]
    expected = {}
    for acq, ch, nominal in channels:
        near = [(abs(m - nominal), k, m) for a, k, m in rows if nominal and m and a == acq is not None and abs(m - nominal) < tolerance]
        if near:
            expected[acq, ch] = min([*near, expected.get((acq, ch), near[0])])
    got = S.match_mass_rows(spark.createDataFrame(channels, "acq_id int, ch_idx int, nom_mass double"), spark.createDataFrame(rows, "acq_id int, row_index int, mass_amu double"), tolerance).collect()
    assert len(got) == len(expected) and {(r.acq_id, r.ch_idx): (r.row_index, r.mass_amu) for r in got} == {k: v[1:] for k, v in expected.items()}


@pytest.fixture(scope="module")
def hourly(spark, tmp_path_factory):
    """An events table whose hourly counts are three peaks; the middle one of `faint` is seldom selected."""
    at = tmp_path_factory.mktemp("hourly")
    hours = np.arange(24.0)
    rows = []
    for name, centres, heights in (("three", (4, 11, 18), (300, 200, 250)), ("faint", (4, 11.5, 19), (300, 40, 250))):
        counts = np.rint(sum(P.slit_peak(hours, a, mu, 3.0, 0.8) for mu, a in zip(centres, heights, strict=True)))
        rows += [(name, int(h), int(n)) for h, n in zip(hours, counts, strict=True)]
    df = spark.createDataFrame(rows, "event_type string, h int, n int").filter("n > 0")
    df.selectExpr("event_type", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts", "explode(sequence(1, n)) AS event_id").write.parquet(f"{at}/events.parquet")
    return str(at)


def test_registered_deconvolve_finds_three_peaks(spark, hourly):
    assert {r.scan_id: r.n for r in catalog.QUERIES["deconvolve"](spark, hourly).collect()} == {"three": 3, "faint": 3}


def test_registered_stability_rejects_what_few_penalties_choose(spark, hourly):
    rows = catalog.QUERIES["stability"](spark, hourly).filter("selected").collect()
    picked = {n: sorted(r.position for r in rows if r.scan_id == n) for n in ("three", "faint")}
    assert picked["three"] == pytest.approx([4, 11, 18], abs=0.25)
    assert picked["faint"] == pytest.approx([4, 19], abs=0.25)
    assert min(r["count"] for r in rows) >= 3


def test_maxima_by_distance_and_prominence(spark):
    y = [0, 5, 0, 4, 3.5, 9, 9, 1, 2, 1, 7, 0]
    df = spark.createDataFrame([("s", float(k), float(v)) for k, v in enumerate(y)], "scan_id string, m double, counts double")
    at = lambda **kw: [r.m for r in O.find_maxima(df, **kw).orderBy("m").collect()]
    assert at() == [1, 3, 5, 8, 10] and at(height=4.5) == [1, 5, 10]
    assert at(distance=3) == [1, 5, 10]
    assert at(prominence=2) == [1, 5, 10] and at(prominence=0.4) == [1, 3, 5, 8, 10]

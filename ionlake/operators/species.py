"""Ions from isotopes, and peaks assigned to ions.

Candidates of one nominal mass are few (the atoms of an ion are bounded), so
they are joined as a small side; peaks and scans are the large side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ionlake.functions.tables import ELECTRON, isotopes

MAX_PER_ISOTOPE = 4
MAX_H = 2
SIZE_FACTOR = 0.3


def enumerate_ions(spark: SparkSession, elements: list[str], nominal_mass: float, max_atoms: int = 4, polarity: int = -1, mz_tol: float = 0.05, nominal_tol: float = 0.6, ignore_abundance: bool = False, table: DataFrame | None = None) -> DataFrame:
    """(formula, mz, total_atoms, charge, iso_abund, size_penalty, plausibility) of ions near nominal_mass.

    Isotopes are added one after another as ranges of their number, with the
    bounds on atoms and hydrogen applied at each step, so partial ions stay few.
    Unknown elements are ignored; anions have charge 1, cations 1 or 2; of equal
    formulas the most plausible stays.
    """
    rows = (table or isotopes(spark)).filter(F.col("sym").isin(*elements)).select("sym", "a", "mass", "abund").collect()
    order = {sym: k for k, sym in reversed(list(enumerate(elements)))}
    types = sorted(((r["sym"], r["a"], r["mass"], r["abund"]) for r in rows), key=lambda r: (order[r[0]], r[1]))
    held = spark.range(1).select(*(F.lit(v).alias(n) for v, n in ((0, "atoms"), (0, "h"), (0, "nominal"), (0.0, "mass"), (1.0, "abund"), ("", "name"))))
    for sym, a, mass, abund in types:
        room: Column = F.least(F.lit(MAX_PER_ISOTOPE), F.lit(max_atoms) - F.col("atoms"))
        if sym == "H":
            room = F.least(room, F.lit(MAX_H) - F.col("h"))
        n = F.col("n")
        held = held.withColumn("n", F.explode(F.sequence(F.lit(0), room)))
        part = F.when(n == 0, "").when(n == 1, f"{a}{sym}").otherwise(F.concat(F.lit(f"{a}{sym}"), n.cast("string")))
        held = held.select(
            (F.col("atoms") + n).alias("atoms"), (F.col("h") + (n if sym == "H" else F.lit(0))).alias("h"), (F.col("nominal") + n * a).alias("nominal"), (F.col("mass") + n * F.lit(mass)).alias("mass"), (F.col("abund") * F.pow(F.lit(abund), n)).alias("abund"), F.concat("name", part).alias("name")
        )
    charges = [1] if polarity == -1 else [1, 2]
    held = held.filter("atoms > 0").withColumn("charge", F.explode(F.array(*(F.lit(z) for z in charges))))
    mz = (F.col("mass") - F.lit(polarity * ELECTRON) * F.col("charge")) / F.col("charge")
    held = held.withColumn("mz", mz).filter((F.abs(F.col("nominal") / F.col("charge") - nominal_mass) < nominal_tol) & (F.abs(F.col("mz") - nominal_mass) < mz_tol))
    size = F.pow(F.lit(SIZE_FACTOR), F.col("atoms") - 1)
    held = held.select(
        F.concat("name", F.when(F.col("charge") > 1, F.col("charge").cast("string")).otherwise(""), F.lit("-" if polarity == -1 else "+")).alias("formula"),
        "mz", F.col("atoms").alias("total_atoms"), "charge", F.col("abund").alias("iso_abund"), size.alias("size_penalty"), ((F.lit(1.0) if ignore_abundance else F.col("abund")) * size).alias("plausibility"),
    )
    first = F.row_number().over(Window.partitionBy("formula").orderBy(F.desc("plausibility"), "mz"))
    return held.withColumn("r", first).filter("r = 1").drop("r")


def _nearest(targets: DataFrame, ions: DataFrame, keys: list[str]) -> DataFrame:
    """targets(keys, target) with the ion nearest to target; null where no ion lies within the target's whole mass or the adjoining ones.

    The ions, bounded by the number of atoms, are one array a whole mass, which
    is broadcast; targets stay where they are.  Of ions at one distance the more
    plausible wins, then the lighter.
    """
    mass = F.floor("mz")
    cells = ions.select(F.explode(F.array(mass - 1, mass, mass + 1)).alias("cell"), F.struct("mz", "formula", "plausibility").alias("ion")).groupBy("cell").agg(F.collect_list("ion").alias("ions"))
    held = targets.withColumn("cell", F.floor("target")).join(F.broadcast(cells), "cell", "left")
    gaps = F.transform("ions", lambda x: F.struct(F.abs(x["mz"] - F.col("target")).alias("gap"), (-x["plausibility"]).alias("unlikely"), x["mz"].alias("mz"), x["formula"].alias("formula")))
    best = held.withColumn("best", F.array_min(gaps))
    return best.select(*keys, "target", "best.mz", "best.formula", (-F.col("best.unlikely")).alias("plausibility"))


def identify_by_difference(peaks: DataFrame, ions: DataFrame, ref_index: int, ref_formula: str) -> DataFrame:
    """(scan_id, peak_index, observed, formula, mz, delta_obs_mau, delta_theo_mau, err_mau) from one known peak of peaks(scan_id, peak_index, observed).

    Masses follow from the reference peak's by difference; each goes to its
    nearest ion.  No rows where the formula is no candidate or the peak is missing.
    """
    ref = ions.filter(F.col("formula") == ref_formula).select("mz").limit(1).collect()
    if not ref:
        return peaks.sparkSession.createDataFrame([], "scan_id string, peak_index int, observed double, formula string, mz double, delta_obs_mau double, delta_theo_mau double, err_mau double")
    m_ref = ref[0]["mz"]
    anchor = peaks.filter(F.col("peak_index") == ref_index).select("scan_id", F.col("observed").alias("ref"))
    held = peaks.join(anchor, "scan_id").withColumn("target", F.lit(m_ref) + F.col("observed") - F.col("ref"))
    out = _nearest(held.select("scan_id", "peak_index", "observed", "ref", "target"), ions, ["scan_id", "peak_index", "observed", "ref"])
    return out.select("scan_id", "peak_index", "observed", "formula", "mz", ((F.col("observed") - F.col("ref")) * 1000).alias("delta_obs_mau"), ((F.col("mz") - m_ref) * 1000).alias("delta_theo_mau"), ((F.col("mz") - F.col("target")) * 1000).alias("err_mau"))


def _anchored(peaks: DataFrame, anchors: DataFrame, ions: DataFrame) -> DataFrame:
    """(scan_id, anchor, anchor_peak, rms, assignment, mean_plausibility) with peaks shifted so that anchor_peak lies on the anchor ion."""
    held = anchors.join(peaks, "scan_id").withColumn("target", F.col("observed") - F.col("offset"))
    keys = ["scan_id", "anchor", "anchor_peak", "peak_index", "observed"]
    near = _nearest(held.select(*keys, "target"), ions, keys)
    return near.groupBy("scan_id", "anchor", "anchor_peak").agg(
        (F.sqrt(F.avg(F.pow(F.col("mz") - F.col("target"), 2))) * 1000).alias("rms_mau"),
        F.transform(F.array_sort(F.collect_list(F.struct("peak_index", "formula"))), lambda s: s["formula"]).alias("assignment"),
        F.avg("plausibility").alias("mean_plausibility"),
    )


def identify_blind(peaks: DataFrame, ions: DataFrame, top_n: int = 5) -> DataFrame:
    """(scan_id, rank, assignment, rms_mau, mean_plausibility): the best distinct assignments when no peak is known.

    Every ion is tried on every peak of its scan (ions are a bounded list by
    construction); of equal assignments the lowest RMS stays.
    """
    anchors = peaks.withColumn("one", F.lit(1)).join(F.broadcast(ions.select(F.lit(1).alias("one"), F.col("formula").alias("anchor"), F.col("mz").alias("anchor_mz"))), "one")
    anchors = anchors.select("scan_id", "anchor", F.col("peak_index").alias("anchor_peak"), (F.col("observed") - F.col("anchor_mz")).alias("offset"))
    tried = _anchored(peaks, anchors, ions)
    best = tried.groupBy("scan_id", "assignment").agg(F.min(F.struct("rms_mau", "mean_plausibility")).alias("b")).select("scan_id", "assignment", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id").orderBy("rms_mau", F.desc("mean_plausibility"), "assignment")))
    return ranked.filter(F.col("rank") <= top_n).select("scan_id", "rank", F.array_join("assignment", " ").alias("assignment"), "rms_mau", "mean_plausibility")


def match_by_separation(peaks: DataFrame, ions: DataFrame, top_anchors: int = 8, plaus_weight: float = 0.0) -> DataFrame:
    """(scan_id, anchor, assignment, rms_mau, score): the middle peak laid on each of the most plausible ions; the lowest RMS + weight * -log10 plausibility wins."""
    top = ions.orderBy(F.desc("plausibility"), "formula").limit(max(top_anchors, 1)).select(F.lit(1).alias("one"), F.col("formula").alias("anchor"), F.col("mz").alias("anchor_mz"), F.col("plausibility").alias("anchor_plausibility"))
    order = Window.partitionBy("scan_id").orderBy("observed", "peak_index")
    n = F.count("*").over(Window.partitionBy("scan_id"))
    middle = peaks.withColumn("i", F.row_number().over(order) - 1).withColumn("n", n).filter("i = n div 2").withColumn("one", F.lit(1))
    anchors = middle.join(F.broadcast(top), "one").select("scan_id", "anchor", F.col("peak_index").alias("anchor_peak"), (F.col("observed") - F.col("anchor_mz")).alias("offset"), "anchor_plausibility")
    tried = _anchored(peaks, anchors.drop("anchor_plausibility"), ions).join(anchors.select("scan_id", "anchor", "anchor_plausibility"), ["scan_id", "anchor"])
    score = F.col("rms_mau") + F.lit(float(plaus_weight)) * -F.log10(F.greatest("anchor_plausibility", F.lit(1e-12)))
    best = tried.withColumn("score", score).groupBy("scan_id").agg(F.min_by(F.struct("anchor", "assignment", "rms_mau", "score"), F.struct("score", -F.col("anchor_plausibility"), "anchor")).alias("b"))
    return best.select("scan_id", "b.anchor", F.array_join("b.assignment", " ").alias("assignment"), "b.rms_mau", "b.score")


def confidence(solutions: DataFrame) -> DataFrame:
    """(scan_id, gap, confidence) by the RMS gap between the best two solutions; a single one is a clear winner."""
    gap = F.lead("rms_mau").over(Window.partitionBy("scan_id").orderBy("rank")) - F.col("rms_mau")
    held = solutions.withColumn("gap", gap).filter("rank = 1")
    return held.select("scan_id", "gap", F.when(F.col("gap").isNull() | (F.col("gap") >= 0.75), "clear winner").when(F.col("gap") < 0.3, "weak").otherwise("moderate").alias("confidence"))


def match_mass_rows(channels: DataFrame, rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """channels(acq_id, ch_idx, nom_mass) with the nearest of rows(acq_id, row_index, mass_amu) strictly within tolerance; zero and missing masses match nothing.

    The distinct masses of both sides are sorted within cells of four tolerances,
    a row's mass in each cell it reaches, and a channel's mass is measured against
    the row masses next to it on either side, so dense masses don't multiply.  Of
    equally near rows the first wins.  Channels are joined by sorting, since a
    broadcast would lay all of them into the few tasks that hold the masses.
    """
    width = 4 * tolerance or 1.0
    cell = lambda mass: F.floor(mass / width)
    held = channels.filter("nom_mass is not null and nom_mass <> 0").select("acq_id", "ch_idx", "nom_mass")
    targets = held.select("acq_id", "nom_mass").distinct().select("acq_id", cell(F.col("nom_mass")).alias("cell"), F.col("nom_mass").cast("double").alias("at"), "nom_mass")
    first = rows.filter("mass_amu is not null and mass_amu <> 0").groupBy("acq_id", "mass_amu").agg(F.min("row_index").alias("row_index"))
    reach = F.array_distinct(F.array(cell(F.col("mass_amu") - tolerance), cell(F.col("mass_amu") + tolerance)))
    near = first.select("acq_id", F.explode(reach).alias("cell"), F.col("mass_amu").cast("double").alias("at"), F.struct("row_index", "mass_amu").alias("near"))
    sides = [F.expr(f"{side}(near) IGNORE NULLS OVER (PARTITION BY acq_id, cell ORDER BY at)").alias(side) for side in ("lag", "lead")]
    laid = targets.unionByName(near, allowMissingColumns=True).select("acq_id", "nom_mass", *sides).filter("nom_mass is not null")
    gaps = [F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.mass_amu") - F.col("nom_mass")).alias("d"), f"{side}.row_index", f"{side}.mass_amu")) for side in ("lag", "lead")]
    matched = laid.select("acq_id", "nom_mass", F.least(*gaps).alias("b")).filter(F.col("b.d") < tolerance)
    best = held.join(matched.hint("merge"), ["acq_id", "nom_mass"]).groupBy("acq_id", "ch_idx").agg(F.min("b").alias("b"))
    return best.select("acq_id", "ch_idx", F.col("b.row_index").alias("row_index"), F.col("b.mass_amu").alias("mass_amu"))

"""Fixed values and small lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Natural isotope ratios, numerator/denominator.
REFERENCE_RATIOS = {
    "13C/12C": 0.0112372,
    "15N/14N": 0.0036765,
    "34S/32S": 0.0441626,
    "33S/32S": 0.0078772,
    "18O/16O": 0.0020052,
    "17O/16O": 0.0003799,
    "2H/1H": 0.00015576,
    "12C 15N/12C 14N": 0.0036765,
    "13C 14N/12C 14N": 0.0112372,
}

# Labels of secondary-electron channels.
SE_LABELS = ("se", "secondary electron", "e-", "e⁻", "em", "topography", "topo")
SE_PREFIXES = ("se ", "secondary")

# Fixed value: electron mass in u.
ELECTRON = 0.00054858

# Symbol, atomic number, mass number, mass and abundance of each isotope.
ISOTOPES = [
    ("H", 1, 1, 1.00782503, 0.99985),
    ("H", 1, 2, 2.01410178, 0.00015),
    ("He", 2, 4, 4.00260325, 1.0),
    ("Li", 3, 6, 6.01512279, 0.0759),
    ("Li", 3, 7, 7.01600344, 0.9241),
    ("Be", 4, 9, 9.01218307, 1.0),
    ("B", 5, 10, 10.01293695, 0.199),
    ("B", 5, 11, 11.00930536, 0.801),
    ("C", 6, 12, 12.0, 0.9893),
    ("C", 6, 13, 13.00335484, 0.0107),
    ("N", 7, 14, 14.00307401, 0.99636),
    ("N", 7, 15, 15.0001089, 0.00364),
    ("O", 8, 16, 15.99491462, 0.99757),
    ("O", 8, 17, 16.9991317, 0.00038),
    ("O", 8, 18, 17.99915961, 0.00205),
    ("F", 9, 19, 18.99840316, 1.0),
    ("Ne", 10, 20, 19.99244018, 0.9048),
    ("Ne", 10, 22, 21.99138511, 0.0925),
    ("Na", 11, 23, 22.98976928, 1.0),
    ("Mg", 12, 24, 23.9850417, 0.7899),
    ("Mg", 12, 25, 24.98583692, 0.1),
    ("Mg", 12, 26, 25.98259297, 0.1101),
    ("Al", 13, 27, 26.98153853, 1.0),
    ("Si", 14, 28, 27.97692653, 0.92223),
    ("Si", 14, 29, 28.97649466, 0.04685),
    ("Si", 14, 30, 29.97377017, 0.03092),
    ("P", 15, 31, 30.97376199, 1.0),
    ("S", 16, 32, 31.97207117, 0.9499),
    ("S", 16, 33, 32.97145876, 0.0075),
    ("S", 16, 34, 33.967867, 0.0425),
    ("Cl", 17, 35, 34.96885268, 0.7576),
    ("Cl", 17, 37, 36.96590258, 0.2424),
    ("Ar", 18, 36, 35.96754511, 0.00337),
    ("Ar", 18, 40, 39.96238312, 0.996),
    ("K", 19, 39, 38.96370648, 0.93258),
    ("K", 19, 41, 40.96182525, 0.0673),
    ("Ca", 20, 40, 39.96259098, 0.96941),
    ("Ca", 20, 42, 41.95861783, 0.00647),
    ("Ca", 20, 44, 43.95548156, 0.02086),
    ("Sc", 21, 45, 44.95590828, 1.0),
    ("Ti", 22, 46, 45.95262772, 0.0825),
    ("Ti", 22, 47, 46.95175879, 0.0744),
    ("Ti", 22, 48, 47.94794198, 0.7372),
    ("Ti", 22, 49, 48.94786568, 0.0541),
    ("Ti", 22, 50, 49.94478689, 0.0518),
    ("V", 23, 50, 49.94715602, 0.0025),
    ("V", 23, 51, 50.94395704, 0.9975),
    ("Cr", 24, 50, 49.94604184, 0.04345),
    ("Cr", 24, 52, 51.94050623, 0.83789),
    ("Cr", 24, 53, 52.94064815, 0.09501),
    ("Cr", 24, 54, 53.93887916, 0.02365),
    ("Mn", 25, 55, 54.93804451, 1.0),
    ("Fe", 26, 54, 53.93960899, 0.05845),
    ("Fe", 26, 56, 55.93493633, 0.91754),
    ("Fe", 26, 57, 56.93539283, 0.02119),
    ("Fe", 26, 58, 57.93327443, 0.00282),
    ("Co", 27, 59, 58.93319429, 1.0),
    ("Ni", 28, 58, 57.93534241, 0.68077),
    ("Ni", 28, 60, 59.93078588, 0.26223),
    ("Ni", 28, 61, 60.93105557, 0.0114),
    ("Ni", 28, 62, 61.92834537, 0.03634),
    ("Ni", 28, 64, 63.92796682, 0.00926),
    ("Cu", 29, 63, 62.92959772, 0.6915),
    ("Cu", 29, 65, 64.9277897, 0.3085),
    ("Zn", 30, 64, 63.92914201, 0.4917),
    ("Zn", 30, 66, 65.92603381, 0.2773),
    ("Zn", 30, 67, 66.92712775, 0.0404),
    ("Zn", 30, 68, 67.92484455, 0.1845),
    ("Zn", 30, 70, 69.9253192, 0.0061),
    ("Ga", 31, 69, 68.92557353, 0.60108),
    ("Ga", 31, 71, 70.92470258, 0.39892),
    ("Ge", 32, 70, 69.92424875, 0.2057),
    ("Ge", 32, 72, 71.92207583, 0.2745),
    ("Ge", 32, 73, 72.92345896, 0.0775),
    ("Ge", 32, 74, 73.92117776, 0.365),
    ("Ge", 32, 76, 75.92140273, 0.0773),
    ("As", 33, 75, 74.92159457, 1.0),
    ("Se", 34, 74, 73.92247593, 0.0089),
    ("Se", 34, 76, 75.9192137, 0.0937),
    ("Se", 34, 77, 76.91991415, 0.0763),
    ("Se", 34, 78, 77.91730928, 0.2377),
    ("Se", 34, 80, 79.9165218, 0.4961),
    ("Se", 34, 82, 81.91669952, 0.0873),
    ("Br", 35, 79, 78.91833715, 0.5069),
    ("Br", 35, 81, 80.91628962, 0.4931),
    ("Kr", 36, 84, 83.91149773, 0.57),
    ("Rb", 37, 85, 84.91178974, 0.7217),
    ("Rb", 37, 87, 86.90918054, 0.2783),
    ("Sr", 38, 88, 87.90561225, 0.8258),
    ("Y", 39, 89, 88.9058403, 1.0),
    ("Zr", 40, 90, 89.90469877, 0.5145),
    ("Zr", 40, 91, 90.90564022, 0.1122),
    ("Zr", 40, 92, 91.90503533, 0.1715),
    ("Zr", 40, 94, 93.90631252, 0.1738),
    ("Zr", 40, 96, 95.90827757, 0.028),
    ("Nb", 41, 93, 92.90637303, 1.0),
    ("Mo", 42, 92, 91.90680796, 0.1453),
    ("Mo", 42, 94, 93.9050849, 0.0915),
    ("Mo", 42, 95, 94.90583877, 0.1584),
    ("Mo", 42, 96, 95.90467612, 0.1667),
    ("Mo", 42, 97, 96.90601812, 0.096),
    ("Mo", 42, 98, 97.90540482, 0.2439),
    ("Mo", 42, 100, 99.90747718, 0.0982),
    ("Tc", 43, 98, 97.9072124, 1.0),
    ("Ru", 44, 102, 101.9043441, 0.3155),
    ("Rh", 45, 103, 102.905498, 1.0),
    ("Pd", 46, 106, 105.9034804, 0.2733),
    ("Ag", 47, 107, 106.9050916, 0.51839),
    ("Ag", 47, 109, 108.9047553, 0.48161),
    ("Cd", 48, 114, 113.9033585, 0.2873),
    ("In", 49, 115, 114.9038787, 0.9572),
    ("Sn", 50, 120, 119.9022016, 0.3258),
    ("Sb", 51, 121, 120.903812, 0.5721),
    ("Sb", 51, 123, 122.9042132, 0.4279),
    ("Te", 52, 130, 129.9062227, 0.3408),
    ("I", 53, 127, 126.9044719, 1.0),
    ("Xe", 54, 132, 131.904155, 0.2689),
    ("Cs", 55, 133, 132.9054519, 1.0),
    ("Ba", 56, 138, 137.9052472, 0.717),
    ("La", 57, 139, 138.9063587, 0.9991),
    ("Ce", 58, 140, 139.9054387, 0.8845),
    ("Pr", 59, 141, 140.9076528, 1.0),
    ("Nd", 60, 142, 141.9077233, 0.2715),
    ("Pm", 61, 145, 144.9127559, 1.0),
    ("Sm", 62, 152, 151.9197324, 0.2675),
    ("Eu", 63, 153, 152.9212303, 0.5219),
    ("Gd", 64, 158, 157.9241039, 0.2484),
    ("Tb", 65, 159, 158.9253468, 1.0),
    ("Dy", 66, 164, 163.9291748, 0.2826),
    ("Ho", 67, 165, 164.9303221, 1.0),
    ("Er", 68, 166, 165.9302931, 0.3361),
    ("Tm", 69, 169, 168.9342133, 1.0),
    ("Yb", 70, 174, 173.9388621, 0.3183),
    ("Lu", 71, 175, 174.9407718, 0.9741),
    ("Hf", 72, 180, 179.94655, 0.3508),
    ("Ta", 73, 181, 180.9479958, 0.9999),
    ("W", 74, 184, 183.9509312, 0.3064),
    ("Re", 75, 187, 186.9557501, 0.626),
    ("Os", 76, 192, 191.961477, 0.4078),
    ("Ir", 77, 193, 192.9629238, 0.6287),
    ("Pt", 78, 195, 194.9647911, 0.3378),
    ("Au", 79, 197, 196.9665687, 1.0),
    ("Hg", 80, 202, 201.9706434, 0.2986),
    ("Tl", 81, 205, 204.9744275, 0.7048),
    ("Pb", 82, 208, 207.9766525, 0.524),
    ("Bi", 83, 209, 208.9803991, 1.0),
    ("U", 92, 238, 238.0507882, 0.9927),
]


def isotope_rows() -> list[tuple[str, int, int, float, float]]:
    """(sym, z, a, mass, abund) of each isotope."""
    return list(ISOTOPES)


def isotopes(spark: SparkSession, rows: list[tuple[str, int, int, float, float]] = ISOTOPES) -> DataFrame:
    return spark.createDataFrame(rows, "sym string, z int, a int, mass double, abund double")


def reference_ratio(numerator: str, denominator: str) -> float | None:
    """Natural ratio of a pair: exact labels first, else equal but for spaces."""
    key = f"{numerator}/{denominator}"
    if key in REFERENCE_RATIOS:
        return REFERENCE_RATIOS[key]
    return next((v for k, v in REFERENCE_RATIOS.items() if k.replace(" ", "") == key.replace(" ", "")), None)


def reference_ratios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REFERENCE_RATIOS.items()), "pair string, reference double")


def lookup_reference(pairs: DataFrame) -> DataFrame:
    """pairs(num, den) with the reference ratio, NULL where the pair is unknown; the nine-row table is broadcast."""
    table = reference_ratios(pairs.sparkSession)
    loose = table.groupBy(F.replace("pair", F.lit(" "), F.lit("")).alias("loose")).agg(F.min("reference").alias("loose_ref"))
    held = pairs.withColumn("pair", F.concat_ws("/", "num", "den")).withColumn("loose", F.replace("pair", F.lit(" "), F.lit("")))
    out = held.join(F.broadcast(table), "pair", "left").join(F.broadcast(loose), "loose", "left")
    return out.withColumn("reference", F.coalesce("reference", "loose_ref")).drop("pair", "loose", "loose_ref")


def is_se_channel(label: Column | str) -> Column:
    """Whether a label names a secondary-electron channel."""
    text = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    return reduce(lambda a, b: a | b, (text.startswith(p) for p in SE_PREFIXES), text.isin(*SE_LABELS))


def resolve_channel(channels: DataFrame, wanted: str | int) -> int:
    """ch_idx of channels(ch_idx, label): a number as it is; a label by equality, else the first that contains it, without regard to case."""
    if isinstance(wanted, int):
        return wanted
    up = wanted.upper()
    row = channels.agg(
        F.min(F.when(F.upper("label") == up, F.col("ch_idx"))).alias("same"), F.min(F.when(F.upper("label").contains(up), F.col("ch_idx"))).alias("part")
    ).first()
    found = row["same"] if row["same"] is not None else row["part"]
    if found is None:
        raise KeyError(f"no channel matches {wanted!r}")
    return found


def index_list(text: Column | str) -> Column:
    """Whole numbers in a list such as '3,7;12 15'; other parts are left out."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, "[,;\\s]+")
    return F.filter(F.transform(parts, lambda p: p.try_cast("int")), lambda v: v.isNotNull())


def lenient_number(text: Column | str) -> Column:
    return F.trim(F.col(text) if isinstance(text, str) else text).try_cast("double")


def strip_copy_mark(text: Column | str) -> Column:
    """A label without a closing mark such as ' (1)'."""
    return F.regexp_replace(text, "\\s*\\(\\d+\\)\\s*$", "")


def axis_name(header: Column | str) -> Column:
    """A column header in lower case without brackets, micro signs and spaces: 'X (µm)' is 'xum'."""
    text = F.lower(F.col(header) if isinstance(header, str) else header)
    return F.translate(F.replace(F.replace(text, F.lit("µ"), F.lit("u")), F.lit("μ"), F.lit("u")), "() ", "")

"""Spectral-line reference values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag, name, rest air wavelength in Angstrom. Calcium-triplet region.
CAI_REGION = [
    ("paschen", "H I Pa25", 8323.42), ("paschen", "H I Pa24", 8333.78),
    ("paschen", "H I Pa23", 8345.55), ("paschen", "H I Pa22", 8359.00),
    ("paschen", "H I Pa21", 8374.48), ("paschen", "H I Pa20", 8392.40),
    ("paschen", "H I Pa19", 8413.32), ("paschen", "H I Pa18", 8437.96),
    ("paschen", "H I Pa17", 8467.25), ("paschen", "H I Pa16", 8502.49),
    ("paschen", "H I Pa15", 8545.38), ("paschen", "H I Pa14", 8598.39),
    ("paschen", "H I Pa13", 8665.02), ("paschen", "H I Pa12", 8750.47),
    ("paschen", "H I Pa11", 8862.79),
    ("abs", "Ca II", 8498.02), ("abs", "Ca II", 8542.09), ("abs", "Ca II", 8662.14),
    ("abs", "Fe I", 8327.06), ("abs", "Fe I", 8346.51), ("abs", "Fe I", 8387.77),
    ("abs", "Fe I / Ni I", 8471.84), ("abs", "Fe I", 8514.08), ("abs", "Fe I", 8536.87),
    ("abs", "Fe I", 8582.26), ("abs", "Fe I", 8611.80), ("abs", "Fe I", 8621.61),
    ("abs", "Fe I", 8643.63), ("abs", "Fe I", 8688.63), ("abs", "Fe I", 8699.46),
    ("abs", "Fe I", 8710.39), ("abs", "Fe I", 8824.22), ("abs", "Fe I", 8838.43),
    ("abs", "Ti I", 8357.68), ("abs", "Ti I", 8382.54), ("abs", "Ti I", 8408.90),
    ("abs", "Ti I", 8412.36), ("abs", "Ti I", 8435.65), ("abs", "Ti I", 8468.40),
    ("abs", "Ti I", 8510.74), ("abs", "Ti I", 8518.35), ("abs", "Ti I", 8521.13),
    ("abs", "Ti I", 8529.44), ("abs", "Ti I", 8556.98), ("abs", "Ti I", 8666.70),
    ("abs", "Ti I", 8682.98), ("abs", "Ti I", 8734.46), ("abs", "Ti I", 8759.84),
    ("abs", "Ti I", 8786.04),
    ("abs", "Ca I", 8539.15), ("abs", "Mg I", 8806.76), ("abs", "Si I", 8728.01),
    ("abs", "Si I", 8742.45), ("abs", "Ni I", 8361.92), ("abs", "Ni I", 8476.85),
    ("abs", "Ni I", 8692.85), ("abs", "Ni I", 8703.25), ("abs", "Cr I", 8308.45),
    ("abs", "Cr I", 8344.09), ("abs", "Cr I", 8465.42), ("abs", "Ba II", 8559.60),
    ("abs", "V I", 8675.20), ("abs", r"TiO $\delta$", 8859.0), ("abs", "Ca I", 9257.0),
    ("abs", "CN", 9350.0),
    ("paschen", "H I Pa9", 8863.0), ("paschen", "H I Pa8", 9015.0), ("paschen", "H I Pa7", 9229.0),
    ("em", "O I", 8446.36), ("em", "[Cl II]", 8578.70), ("em", "[Fe II]", 8616.95),
    ("em", "[N I]", 8680.28), ("em", "[N I]", 8683.40), ("em", "[C I]", 8727.13),
    ("em", "[S III]", 9068.60), ("em", "[S III]", 9530.60),
]

# Magnesium-b / green region.
MGB_REGION = [
    ("abs", "H I Hbeta", 4861.33), ("abs", "H I Hgamma", 4340.47),
    ("abs", "Fe I", 5015.20), ("abs", "Fe I / blend", 4957.60), ("abs", "Fe I / blend", 5041.10),
    ("abs", "Fe I / blend", 5056.50), ("abs", "Fe I / blend", 5270.40),
    ("abs", "Fe I / blend", 5328.04), ("abs", "Fe I / blend", 5371.49),
    ("abs", "Fe I / blend", 5397.13), ("abs", "Fe I / blend", 5406.00),
    ("abs", "Fe I / blend", 5446.92),
    ("abs", "Mg b", 5167.32), ("abs", "Mg b", 5172.68), ("abs", "Mg b", 5183.60),
    ("abs", "Mg I", 5528.41), ("abs", "MgH", 5138.70),
    ("em", "[O III]", 4958.91), ("em", "[O III]", 5006.84), ("em", "He I", 5015.68),
    ("em", "[N I]", 5197.90), ("em", "[N I]", 5200.26),
]

# Red optical region.
RED_REGION = [
    ("abs", "Fe I", 5709.38), ("abs", "Fe I", 5780.38), ("abs", "Fe I", 6136.61),
    ("abs", "Fe I", 6191.56), ("abs", "Fe I", 6355.03), ("abs", "Fe I", 6393.60),
    ("abs", "Fe I", 6421.36), ("abs", "Fe I", 6430.85), ("abs", "Fe I", 7511.02),
    ("abs", "Fe I", 7531.15),
    ("abs", "Na I D", 5889.95), ("abs", "Na I D", 5895.92),
    ("abs", "Ca I", 6122.22), ("abs", "Ca I", 6162.17), ("abs", "Ca I", 6347.23),
    ("abs", "Ca I", 6373.48), ("abs", "Ba II", 6496.90), ("abs", "Mg I", 5528.41),
    ("abs", "O I", 7771.94), ("abs", "O I", 7774.17), ("abs", "O I", 7775.39),
    ("abs", "K I", 7664.91), ("abs", "K I", 7698.96),
    ("abs", "Na I", 8183.27), ("abs", "Na I", 8194.82),
    ("abs", r"TiO $\gamma'$", 5847.0), ("abs", r"TiO $\gamma'$", 6159.0),
    ("abs", r"TiO $\gamma'$", 6651.0), ("abs", r"TiO $\gamma$", 7055.0),
    ("abs", r"TiO $\gamma$", 7087.0), ("abs", r"TiO $\gamma$", 7126.0),
    ("abs", r"TiO $\gamma$", 7589.0), ("abs", r"TiO $\gamma$", 7676.0),
    ("abs", r"TiO $\delta$", 8432.0),
    ("em", "[O I]", 5577.34), ("em", "He I", 5875.62), ("em", "[O I]", 6300.30),
    ("em", "[O I]", 6363.78), ("em", "[N II]", 5754.60), ("em", r"H$\alpha$", 6562.80),
    ("em", "[N II]", 6548.05), ("em", "[N II]", 6583.45), ("em", "[S II]", 6716.44),
    ("em", "[S II]", 6730.82), ("em", "[Ar III]", 7135.80), ("em", "[S III]", 9068.60),
    ("em", "[S III]", 9530.60),
]

# The calcium triplet, its half-widths, and its depths in synthetic templates.
TRIPLET_CENTRES = [8498.02, 8542.09, 8662.14]
TRIPLET_HALF_WIDTH = 8.0
TRIPLET_DEPTHS = [0.55, 0.70, 0.65]
TRIPLET_WIDTH = 5.0

# Weak absorption features of synthetic templates (centre, depth, width).
WEAK_LINES = [
    (8420.0, 0.05, 2.5), (8468.0, 0.04, 2.0), (8514.0, 0.06, 2.5), (8611.0, 0.05, 2.0),
    (8621.0, 0.05, 2.5), (8688.0, 0.04, 2.0), (8710.0, 0.05, 2.5), (8730.0, 0.03, 2.0),
    (8760.0, 0.04, 2.5), (8807.0, 0.05, 2.5),
]

# Lines injected into mocks and the amplitude ranges of each level.
MOCK_EMISSION_CENTRES = [8446.36, 8578.70, 8616.95, 8680.28, 8683.40, 8727.13, 9068.60]
MOCK_EMISSION_RANGE = {"none": (0.0, 0.0), "moderate": (0.3, 1.0), "strong": (1.0, 3.0)}


def line_rows() -> list[tuple[int, str, str, str, float]]:
    """All lists one after another; lines present in two lists stay twice."""
    lists = [("cai", CAI_REGION), ("mgb", MGB_REGION), ("red", RED_REGION)]
    rows = [(region, *line) for region, lines in lists for line in lines]
    return [(i, *row) for i, row in enumerate(rows)]


def line_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        line_rows(), "line_id int, region string, tag string, name string, centre double"
    )


def triplet_windows(spark: SparkSession, half_width: float = TRIPLET_HALF_WIDTH) -> DataFrame:
    rows = [(c - half_width, c + half_width) for c in TRIPLET_CENTRES]
    return spark.createDataFrame(rows, "lo double, hi double")


def emission_candidates(spark: SparkSession, paschen: bool = False) -> DataFrame:
    tags = ["em", "paschen"] if paschen else ["em"]
    return line_table(spark).filter(F.col("tag").isin(tags))

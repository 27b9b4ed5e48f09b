"""Properties of amino acids as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Letter, volume, class (H hydrophobic, G glycine, C charged, P polar), frequency, hydropathy, transfer energy, surface
#: area, greatest solvent access. Fixed values.
PROPERTIES = [
    ("A", 92, "H", 0.09, 0.25, -1.6, 106, 115), ("C", 106, "P", 0.028, 0.04, -2.0, 135, 135), ("D", 125, "C", 0.055, -0.72, 9.2, 163, 160), ("E", 155, "C", 0.062, -0.62, 8.2, 194, 190),
    ("F", 203, "H", 0.035, 0.61, -3.7, 197, 210), ("G", 66, "G", 0.075, 0.16, -1.0, 84, 75), ("H", 167, "P", 0.021, -0.40, 3.0, 184, 195), ("I", 169, "H", 0.046, 0.73, -3.1, 169, 175),
    ("K", 171, "C", 0.07, -1.10, 8.8, 205, 200), ("L", 168, "H", 0.075, 0.53, -2.8, 164, 170), ("M", 171, "H", 0.017, 0.26, -3.4, 188, 185), ("N", 135, "P", 0.044, -0.64, 4.8, 157, 150),
    ("P", 129, "H", 0.046, -0.07, 0.2, 136, 145), ("Q", 161, "P", 0.039, -0.69, 4.1, 198, 180), ("R", 202, "C", 0.047, -1.76, 12.3, 248, 225), ("S", 99, "P", 0.071, -0.26, -0.6, 130, 115),
    ("T", 122, "P", 0.060, -0.18, -1.2, 142, 140), ("V", 142, "H", 0.069, 0.54, -2.6, 142, 155), ("W", 238, "P", 0.011, 0.37, -1.9, 227, 255), ("Y", 204, "P", 0.035, 0.02, 0.7, 222, 230),
]


def aa_properties(spark: SparkSession) -> DataFrame:
    """Twenty rows, to be broadcast."""
    return spark.createDataFrame(PROPERTIES, "letter string, size int, kind string, frequency double, hp double, ges double, sa int, access int")

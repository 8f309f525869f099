"""Specialty lookup: treatment-function code -> specialty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: specialty code, specialty name, treatment-function code ---
SPECIALTY_ROWS = (
    ("C_100", "General Surgery", 100),
    ("C_101", "Urology", 101),
    ("C_110", "Trauma and Orthopaedic", 108),
    ("C_110", "Trauma and Orthopaedic", 110),
    ("C_110", "Trauma and Orthopaedic", 111),
    ("C_110", "Trauma and Orthopaedic", 115),
    ("C_120", "Ear Nose and Throat", 120),
    ("C_130", "Ophthalmology", 130),
    ("C_140", "Oral Surgery", 140),
    ("C_140", "Oral Surgery", 144),
    ("C_140", "Oral Surgery", 145),
    ("C_150", "Neurosurgery", 150),
    ("C_160", "Plastic Surgery", 160),
    ("C_170", "Cardiothoracic Surgery", 170),
    ("C_170", "Cardiothoracic Surgery", 172),
    ("C_170", "Cardiothoracic Surgery", 173),
    ("C_300", "General Internal Medicine", 300),
    ("C_301", "Gastroenterology", 301),
    ("C_320", "Cardiology", 320),
    ("C_330", "Dermatology", 330),
    ("C_340", "Respiratory Medicine", 340),
    ("C_400", "Neurology", 400),
    ("C_410", "Rheumatology", 410),
    ("C_430", "Elderly Medicine", 430),
    ("C_502", "Gynaecology", 502),
    ("X02", "Other - Medical Services", 180),
    ("X02", "Other - Medical Services", 190),
    ("X02", "Other - Medical Services", 191),
    ("X02", "Other - Medical Services", 192),
    ("X02", "Other - Medical Services", 200),
    ("X02", "Other - Medical Services", 302),
    ("X02", "Other - Medical Services", 303),
    ("X02", "Other - Medical Services", 304),
    ("X02", "Other - Medical Services", 305),
    ("X02", "Other - Medical Services", 306),
    ("X02", "Other - Medical Services", 307),
    ("X02", "Other - Medical Services", 308),
    ("X02", "Other - Medical Services", 309),
    ("X02", "Other - Medical Services", 310),
    ("X02", "Other - Medical Services", 311),
    ("X02", "Other - Medical Services", 312),
    ("X02", "Other - Medical Services", 313),
    ("X02", "Other - Medical Services", 314),
    ("X02", "Other - Medical Services", 315),
    ("X02", "Other - Medical Services", 316),
    ("X02", "Other - Medical Services", 317),
    ("X02", "Other - Medical Services", 318),
    ("X02", "Other - Medical Services", 319),
    ("X02", "Other - Medical Services", 322),
    ("X02", "Other - Medical Services", 323),
    ("X02", "Other - Medical Services", 324),
    ("X02", "Other - Medical Services", 325),
    ("X02", "Other - Medical Services", 326),
    ("X02", "Other - Medical Services", 327),
    ("X02", "Other - Medical Services", 328),
    ("X02", "Other - Medical Services", 329),
    ("X02", "Other - Medical Services", 331),
    ("X02", "Other - Medical Services", 333),
    ("X02", "Other - Medical Services", 335),
    ("X02", "Other - Medical Services", 341),
    ("X02", "Other - Medical Services", 342),
    ("X02", "Other - Medical Services", 343),
    ("X02", "Other - Medical Services", 344),
    ("X02", "Other - Medical Services", 345),
    ("X02", "Other - Medical Services", 346),
    ("X02", "Other - Medical Services", 347),
    ("X02", "Other - Medical Services", 348),
    ("X02", "Other - Medical Services", 349),
    ("X02", "Other - Medical Services", 350),
    ("X02", "Other - Medical Services", 352),
    ("X02", "Other - Medical Services", 360),
    ("X02", "Other - Medical Services", 361),
    ("X02", "Other - Medical Services", 370),
    ("X02", "Other - Medical Services", 371),
    ("X02", "Other - Medical Services", 401),
    ("X02", "Other - Medical Services", 422),
    ("X02", "Other - Medical Services", 424),
    ("X02", "Other - Medical Services", 431),
    ("X02", "Other - Medical Services", 450),
    ("X02", "Other - Medical Services", 451),
    ("X02", "Other - Medical Services", 460),
    ("X02", "Other - Medical Services", 461),
    ("X02", "Other - Medical Services", 501),
    ("X02", "Other - Medical Services", 503),
    ("X02", "Other - Medical Services", 504),
    ("X02", "Other - Medical Services", 505),
    ("X02", "Other - Medical Services", 834),
    ("X03", "Other - Mental Health Services", 656),
    ("X03", "Other - Mental Health Services", 700),
    ("X03", "Other - Mental Health Services", 710),
    ("X03", "Other - Mental Health Services", 711),
    ("X03", "Other - Mental Health Services", 712),
    ("X03", "Other - Mental Health Services", 713),
    ("X03", "Other - Mental Health Services", 715),
    ("X03", "Other - Mental Health Services", 720),
    ("X03", "Other - Mental Health Services", 721),
    ("X03", "Other - Mental Health Services", 722),
    ("X03", "Other - Mental Health Services", 723),
    ("X03", "Other - Mental Health Services", 724),
    ("X03", "Other - Mental Health Services", 725),
    ("X03", "Other - Mental Health Services", 726),
    ("X03", "Other - Mental Health Services", 727),
    ("X03", "Other - Mental Health Services", 728),
    ("X03", "Other - Mental Health Services", 729),
    ("X03", "Other - Mental Health Services", 730),
    ("X03", "Other - Mental Health Services", None),
    ("X04", "Other – Paediatric Services", 142),
    ("X04", "Other – Paediatric Services", 171),
    ("X04", "Other – Paediatric Services", 211),
    ("X04", "Other – Paediatric Services", 212),
    ("X04", "Other – Paediatric Services", 213),
    ("X04", "Other – Paediatric Services", 214),
    ("X04", "Other – Paediatric Services", 215),
    ("X04", "Other – Paediatric Services", 216),
    ("X04", "Other – Paediatric Services", 217),
    ("X04", "Other – Paediatric Services", 218),
    ("X04", "Other – Paediatric Services", 219),
    ("X04", "Other – Paediatric Services", 220),
    ("X04", "Other – Paediatric Services", 221),
    ("X04", "Other – Paediatric Services", 222),
    ("X04", "Other – Paediatric Services", 223),
    ("X04", "Other – Paediatric Services", 230),
    ("X04", "Other – Paediatric Services", 240),
    ("X04", "Other – Paediatric Services", 241),
    ("X04", "Other – Paediatric Services", 242),
    ("X04", "Other – Paediatric Services", 250),
    ("X04", "Other – Paediatric Services", 251),
    ("X04", "Other – Paediatric Services", 252),
    ("X04", "Other – Paediatric Services", 253),
    ("X04", "Other – Paediatric Services", 254),
    ("X04", "Other – Paediatric Services", 255),
    ("X04", "Other – Paediatric Services", 256),
    ("X04", "Other – Paediatric Services", 257),
    ("X04", "Other – Paediatric Services", 258),
    ("X04", "Other – Paediatric Services", 259),
    ("X04", "Other – Paediatric Services", 260),
    ("X06", "Other - Other Services", 920),
)
# share of the census population by ethnic group
CENSUS_SHARE = {
    "asian_background": 0.097,
    "black_background": 0.056,
    "white_background": 0.79,
    "mixed_background": 0.034,
    "other_background": 0.023,
}
# --- end of fixed values ---


def specialty_lookup(spark: SparkSession) -> DataFrame:
    """The lookup as a frame; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame(list(SPECIALTY_ROWS), "specialty_code string, specialty string, tfc bigint")

"""Camera model catalogue and model-string resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import optics

# Published make, model, kind, wide-end horizontal field of view
# (degrees, 360 for panoramic domes) and sensor megapixels.
CAMERA_MODELS = [
    ("Axis", "P3265-LVE", "fixed", 100, 2),
    ("Axis", "P1465-LE", "fixed", 109, 2),
    ("Axis", "Q1656-LE", "fixed", 114, 4),
    ("Hikvision", "DS-2CD2087G2-LU", "fixed", 102, 8),
    ("Hikvision", "DS-2CD2347G2-LU", "fixed", 109, 4),
    ("Hanwha", "XNO-8083R", "fixed", 92, 6),
    ("Hanwha", "QNO-C8083R", "fixed", 100, 5),
    ("Bosch", "DINION 5100i IR", "fixed", 106, 5),
    ("Uniview", "IPC3618SB-ADF28KM", "fixed", 112, 8),
    ("Axis", "M3077-PLVE", "dome", 360, 6),
    ("Axis", "M4318-PLVE", "dome", 360, 12),
    ("Hikvision", "DS-2CD2955G0-ISU", "dome", 360, 5),
    ("Hanwha", "XNF-9010RV", "dome", 360, 12),
    ("Axis", "Q6135-LE", "ptz", 66, 2),
    ("Axis", "P5676-LE", "ptz", 63, 4),
    ("Hikvision", "DS-2DE7A425IW-AEB", "ptz", 59, 4),
    ("Hanwha", "XNP-C9310R", "ptz", 61, 8),
    ("Bosch", "AUTODOME 7100i", "ptz", 57, 4),
]

SPEC = "struct<pos:int,label:string,token:string,kind:string,fov_deg:double,resolution_mp:double>"


def catalogue(spark: SparkSession) -> DataFrame:
    """The dimension table with labels and derived "observe" ranges."""
    rows = [
        (i, m, n, f"{m} {n}", k, float(f), float(p))
        for i, (m, n, k, f, p) in enumerate(CAMERA_MODELS)
    ]
    df = spark.createDataFrame(
        rows,
        "pos int, make string, model string, label string, kind string, fov_deg double, "
        "resolution_mp double",
    )
    return df.withColumn(
        "range_m", optics.model_range_m(F.col("kind"), F.col("fov_deg"), F.col("resolution_mp"))
    )


def _specs() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f"{m} {n}").alias("label"),
                F.lit(n.lower()).alias("token"),
                F.lit(k).alias("kind"),
                F.lit(float(f)).alias("fov_deg"),
                F.lit(float(p)).alias("resolution_mp"),
            )
            for i, (m, n, k, f, p) in enumerate(CAMERA_MODELS)
        ]
    )


def resolve_model(raw: Column) -> Column:
    """Catalogue entry (SPEC struct) for a free-text model: an equal label in
    any case, else the first catalogue model named inside the text."""
    s = F.lower(F.trim(raw))
    specs = _specs()
    exact = F.filter(specs, lambda m: F.lower(m["label"]) == s)
    within = F.filter(specs, lambda m: s.contains(m["token"]))
    return F.when(
        F.coalesce(s, F.lit("")) != "",
        F.coalesce(F.get(exact, F.lit(0)), F.get(within, F.lit(0))),
    )

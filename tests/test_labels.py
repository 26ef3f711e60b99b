"""Labels and normal forms of values that the views don't hold."""

from pyspark.sql import functions as F

from docflow.functions import labels as L


def test_odd_values(spark):
    rows = spark.createDataFrame([(None, "CI"), ("", "CI"), (" ", None), ("AB", None), ("5/1/2026", None), ("3 units of USA", "BL")], "v string, t string")
    found = [r["c"] and tuple(r["c"]) for r in rows.select(L.classified(F.col("v"), F.col("t")).alias("c")).collect()]
    assert found == [None, None, None, None, ("bl_date", "2026-01-05", 0.90), ("country_of_origin", "USA", 0.95)]
    assert rows.limit(0).select(L.classified(F.col("v"), F.col("t"))).count() == 0


def test_odd_forms(spark):
    rows = spark.createDataFrame([(None, "unit"), ("\t ", "hs_code"), ("a b", None), (" Pieces\n", "unit"), ("31 Feb 2026", "bl_date"), ("1.5 MT", "net_weight"), ("heavy", "net_weight")], "v string, t string")
    found = [tuple(r["c"]) for r in rows.select(L.normalised(F.col("v"), F.col("t")).alias("c")).collect()]
    assert found == [
        ("", 0.0, "empty"), ("", 0.0, "empty"), ("a b", 0.5, "cleaned"), ("PCE", 1.0, "mapped"), ("2026-02-31", 0.7, "inferred"), ("1500.0", 1.0, "parsed"), ("heavy", 0.0, "invalid"),
    ]

"""A demonstration table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The products and regions of the demonstration table.
PRODUITS = ["A", "B", "C", "D", "E"]
REGIONS = ["Nord", "Sud", "Est", "Ouest"]


def example_sales(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Daily sales from 2024-01-01; every value is a hash of the row number and the seed."""
    def draw(column: int, below: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(column)), F.lit(below))

    def choice(values: list[str], column: int) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(column, len(values)) + 1).cast("int"))
    price = (F.lit(1000) + draw(4, 49001)) / 100.0
    rows = spark.range(n).select(
        "id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86400).alias("Date"),
        choice(PRODUITS, 1).alias("Produit"), choice(REGIONS, 2).alias("Region"),
        (draw(3, 99) + 1).cast("int").alias("Quantite"), price.alias("Prix_Unitaire"),
        (draw(5, 100) < 80).alias("Client_Satisfait"))
    return rows.withColumn("Revenu", F.round(F.col("Quantite") * F.col("Prix_Unitaire"), 2)).drop("id")

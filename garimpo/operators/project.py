"""Two-dimensional view of an index."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def perplexity(n: int) -> int:
    """Neighbourhood size for n points, between 5 and 30."""
    return min(30, max(5, n // 4))


def project(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``(*keep, x, y)`` on the two principal components; the larger loading of each is positive."""
    rows = df.where(F.col(vector).isNotNull()).select(*keep, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    axes = model.pc.toArray()
    sign = [1.0 if a[abs(a).argmax()] > 0 else -1.0 for a in axes.T]
    p = vector_to_array("p")
    return model.transform(rows).select(*keep, (p[0] * F.lit(sign[0])).alias("x"), (p[1] * F.lit(sign[1])).alias("y"))


def dispersion(points: DataFrame, label: str) -> DataFrame:
    """Points, centre and mean squared distance from it per label."""
    return points.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.var_pop("x") + F.var_pop("y")).alias("spread")
    )

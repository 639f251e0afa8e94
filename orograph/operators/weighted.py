"""Weighted medians and densities of textures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.mesh import texel_size
from orograph.shared import running


def running_weight(df: DataFrame, value, weight, by=()) -> DataFrame:
    """Adds ``running``: the sum of weights up to a row in the order of values. Equal values are one step: rows are
    reduced to one for each value first, and the order is cut into ranges, so no task holds a group."""
    steps = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    return running(steps, [F.col(value)], F.col("w"), "running", by)


def weighted_median(df: DataFrame, value, weight, by=()) -> DataFrame:
    """The first value whose running weight is half of the total or more; rows without weight don't count."""
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    steps = running_weight(rows, value, weight, by)
    total = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.sum(weight).alias("total"))
    met = F.lit(True)
    for c in by:
        met = met & steps[c].eqNullSafe(total[f"__{c}"])
    found = steps.join(total, met).where(F.col("running") * 2 >= F.col("total"))
    return found.groupBy(*by).agg(F.min(value).alias("weighted_median"), F.max("total").alias("total_weight"))


def texel_medians(triangles: DataFrame, by=("tile",), density="density", area="area") -> DataFrame:
    """Texel size of each tile from its triangles' area-weighted median density; infinite for a tile without any."""
    keys = triangles.select(*by).distinct()
    found = weighted_median(triangles, density, area, by)
    return keys.join(found, list(by), "left").select(*by, texel_size(F.coalesce("weighted_median", F.lit(0.0))).alias("texel"))


def density_ratios(df: DataFrame, texels, area, by: str) -> DataFrame:
    """Sum of texels over sum of area, by material and in total (a null key), in one pass."""
    ratio = F.when(F.sum(area) > 0, F.sum(texels) / F.sum(area))
    return df.rollup(by).agg(F.sum(texels).alias("texels"), F.sum(area).alias("area"), ratio.alias("density"), F.grouping(by).cast("int").alias("is_total"))

"""Image statistics over exploded pixels: histograms, medians, stretch parameters. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(planes: DataFrame, key: str, data: str) -> DataFrame:
    """key, value of every pixel that is a number."""
    return planes.select(key, F.explode(data).alias("value")).select(key, F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def channel_stats(px: DataFrame, key: str, bins: int = 4096) -> DataFrame:
    """Per plane: n, min, max, mean, and the median and the 99.99 percentile from a histogram of `bins` bins.

    A quantile is the lowest bin whose cumulative count reaches ceil(q n). The
    histogram is aggregated partially; what a window sees is at most `bins`
    rows a plane.
    """
    span = px.groupBy(key).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    binned = px.join(span.select(key, "lo", "hi"), key).groupBy(key, place.cast("bigint").alias("bin")).agg(F.count("*").alias("c"))
    up_to = binned.withColumn("upto", F.sum("c").over(Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    marked = up_to.join(span, key)
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("n")), F.col("bin")))
    quantiles = marked.groupBy(key).agg(at(0.5).alias("median_bin"), at(0.9999).alias("top_bin"))
    return span.join(quantiles, key)


def midtones(x: Column, m: Column) -> Column:
    """The midtones transfer of a value between 0 and 1."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def stretch_parameters(median: Column, mad: Column) -> tuple[Column, Column]:
    """Shadows and midtones of the automatic stretch: 2.8 scatters below the median are black, the median becomes a quarter."""
    shadows = F.least(F.greatest(median - 2.8 * 1.4826 * mad, F.lit(0.0)), F.lit(1.0))
    return shadows, midtones(median - shadows, F.lit(0.25))


def binned(planes: DataFrame, key: str, data: str, width: int, factor: int = 2) -> DataFrame:
    """key, y, x, value: each block of factor x factor pixels averaged; a rest at the edges is dropped."""
    px = planes.select(key, F.posexplode(data).alias("at", "value"))
    placed = px.select(key, F.floor(F.floor(F.col("at") / width) / factor).alias("y"), F.floor(F.col("at") % width / factor).alias("x"), F.col("value").cast("double").alias("value"))
    return placed.filter(F.col("x") < width // factor).groupBy(key, "y", "x").agg(F.avg("value").alias("value"), F.count("*").alias("n")).filter(F.col("n") == factor * factor).drop("n")


def rotated(planes: DataFrame, key: str, data: str, width: int, height: int) -> DataFrame:
    """key, data: the plane a quarter turned clockwise, by index alone."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.element_at(F.col(data), ((height - 1 - i % height) * width + F.floor(i / height) + 1).cast("int")))
    return planes.select(key, turned.alias(data))


def display_histogram(px: DataFrame, key: str, bins: int = 4096, columns: int = 256) -> DataFrame:
    """Per plane key, col, n, height: the histogram of `bins` bins in `columns` columns with height ln(1 + n); the first and last bin are left out."""
    span = px.groupBy(key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    shown = px.join(span, key).select(key, place.alias("bin")).filter((F.col("bin") > 0) & (F.col("bin") < bins - 1))
    return shown.groupBy(key, F.floor(F.col("bin") * columns / bins).alias("col")).agg(F.count("*").alias("n")).withColumn("height", F.log1p("n"))


def linear_highlights(shadows: Column, median: Column, top: Column) -> Column:
    """The white point of a straight display line: the median becomes 0.15, but not past the bright end of the data."""
    return F.least(F.greatest(F.least(shadows + F.greatest(median - shadows, F.lit(1e-5)) / 0.15, top), shadows + 1e-4), F.lit(1.0))


def normalised(px: DataFrame, key: str, full: float | None = None) -> DataFrame:
    """key, value between 0 and 1: by the type's range (`full`, its greatest value), else by each plane's least and greatest."""
    if full is not None:
        return px.select(key, F.least(F.greatest(F.col("value") / full, F.lit(0.0)), F.lit(1.0)).alias("value"))
    span = px.groupBy(key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return px.join(span, key).select(key, F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"))

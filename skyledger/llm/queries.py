"""Queries of the problems on text collections and free-entered values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import mapping, mixing, packing, reading
from skyledger.session import read


def _label_rows(df: DataFrame, ref: str, names: list[str], is_name: list[bool]) -> DataFrame:
    out = df.select(F.col(ref).alias("ref_id"), F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("label"), F.lit(False).alias("is_name"))
    for name, flag in zip(names, is_name):
        out = out.unionByName(df.select(F.col(ref).alias("ref_id"), F.col(name).alias("label"), F.lit(flag).alias("is_name")))
    return out.filter(F.col("label").isNotNull())


def p6_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Every freely typed object and filter with the entry it means (0: none) and the similarity."""
    frames = read(spark, sf, "frames").select("frame_id", "object", "filter_name")
    targets, filters = read(spark, sf, "targets"), read(spark, sf, "filter_list")
    objects = mapping.map_designations(frames.select(F.col("object").alias("value")), _label_rows(targets, "target_id", ["designation", "common_name"], [False, True]))
    bands = mapping.map_labels(frames.select(F.col("filter_name").alias("value")), _label_rows(filters, "filter_id", ["filter_name"], [False]))
    one = mapping.mapped(frames, "frame_id", "object", objects, targets.select(F.col("designation").alias("label"))).withColumn("field", F.lit("object"))
    two = mapping.mapped(frames, "frame_id", "filter_name", bands, filters.select(F.col("filter_name").alias("label"))).withColumn("field", F.lit("filter_name"))
    return one.unionByName(two).select("frame_id", "field", "value", "ref_id", "sim")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_mapping(spark, sf).select("frame_id", "field", F.col("ref_id").cast("int").alias("ref_id")).distinct()


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text, or of its pieces where it is larger than one."""
    return packing.pack_texts(read(spark, sf, "documents"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p7_packing(spark, sf))


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The texts chosen for each source, with their repetition."""
    return mixing.mix(read(spark, sf, "documents"), read(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents"), read(spark, sf, "mix_targets"))[1]


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Surprisals, difficulty and reading level of every speech long enough to judge."""
    return reading.reading_levels(read(spark, sf, "documents"), read(spark, sf, "level_sample"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_levels(spark, sf).select("doc_id", "level")


QUERIES = {"p7_packing": p7_packing, "p7_fill": p7_fill, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found, "p9_levels": p9_levels, "p6_found": p6_found, "p6_mapping": p6_mapping}
SQL: dict[str, str] = {}

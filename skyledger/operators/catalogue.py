"""Catalogue joins: by normalised name, and the nearest position within a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import astro


def plain_name(name: Column) -> Column:
    """Letters, digits and + in capitals, the number without leading zeros."""
    bare = F.upper(F.regexp_replace(name, r"[^\p{L}\p{N}+]", ""))
    return F.regexp_replace(bare, r"^(\p{L}+)0+(?=\d+$)", "$1")


def lookup(names: DataFrame, name: str, catalogue: DataFrame, ref: str, labels: list[str]) -> DataFrame:
    """names with the lowest `ref` of the entries that one of whose labels is the same name; null where none is.

    A label column may hold an array, each of whose names counts.

    The catalogue's names are an aggregate of the catalogue, joined as Spark
    finds best; its size decides whether it is broadcast.
    """
    keys = None
    for label in labels:
        text = F.explode(label) if dict(catalogue.dtypes)[label].startswith("array") else F.col(label)
        one = catalogue.select(F.col(ref), text.alias("label")).select(F.col(ref), plain_name(F.col("label")).alias("plain")).filter(F.col("plain").isNotNull() & (F.col("plain") != ""))
        keys = one if keys is None else keys.unionByName(one)
    keys = keys.groupBy("plain").agg(F.min(ref).alias(ref))
    return names.withColumn("plain", plain_name(F.col(name))).join(keys, "plain", "left").drop("plain")


def _cells(ra: str, dec: str, radius: float, around: bool):
    """Cells of declination and, inside a band, of right ascension, each at least as wide as the radius; with `around` all that a circle can touch.

    The width in right ascension is that of the band's edge farther from the
    equator, widened for the bands beside it; near a pole a band is one cell.
    """
    band = F.floor(F.col(dec) / radius)

    def cell(k):
        edge = F.least(F.greatest(F.abs(k), F.abs(k + 1)) * radius + radius, F.lit(90.0))
        n = F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / radius), F.lit(1))
        at = F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360.0 * n)
        beside = F.array_distinct(F.array(*[F.pmod(at + i, n) for i in (-1, 0, 1)])) if around else F.array(at)
        return F.transform(beside, lambda x: F.struct(k.alias("band"), x.alias("sector")))

    return F.flatten(F.array(*[cell(band + i) for i in ((-1, 0, 1) if around else (0,))]))


def neighbours(positions: DataFrame, ref: str, radius_deg: float) -> DataFrame:
    """For each position the nearest other one within the radius: ref, near, degrees (to 6 places).

    A position is compared with those of the cells that its circle can touch.
    """
    a = positions.select(F.col(ref), F.col("ra_deg").alias("ra1"), F.col("dec_deg").alias("dec1")).withColumn("cell", F.explode(_cells("ra1", "dec1", radius_deg, True)))
    b = positions.select(F.col(ref).alias("near"), F.col("ra_deg").alias("ra2"), F.col("dec_deg").alias("dec2")).withColumn("cell", F.explode(_cells("ra2", "dec2", radius_deg, False)))
    pairs = a.join(b, "cell").filter((F.col(ref) != F.col("near")) & (F.abs(F.col("dec1") - F.col("dec2")) <= radius_deg))
    d = pairs.withColumn("degrees", F.round(astro.separation(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2")), 6)).filter(F.col("degrees") <= radius_deg)
    return d.groupBy(ref).agg(F.min_by(F.struct("near", "degrees"), F.struct("degrees", "near")).alias("x")).select(ref, "x.near", "x.degrees")


def _degrees(text: Column, hours: Column) -> Column:
    """Degrees of `d m s` text with colons, blanks or letters; hours count fifteenfold."""
    parts = r"^\s*([+-]?)(\d{1,3})[:hd°\s]\s*(\d{1,2})(?:[:m'\s]\s*(\d+(?:\.\d*)?)?)?[s\"]?\s*$"
    get = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, parts, k), F.lit("")).try_cast("double"), F.lit(0.0))
    size = get(2) + get(3) / 60 + get(4) / 3600
    signed = F.when(F.regexp_extract(text, parts, 1) == "-", -size).otherwise(size)
    return F.when(text.rlike(parts), F.when(hours, signed * 15).otherwise(signed))


def header_positions(cards: DataFrame) -> DataFrame:
    """frame_id, ra_deg, dec_deg of the files whose header states both.

    cards: frame_id, hdu, record, keyword, value_text. RA and DEC go before
    OBJCTRA and OBJCTDEC, numbers are degrees, RA in other forms is in hours.
    """
    text = F.regexp_replace("value_text", r"^[\s']+|[\s']+$", "")
    right = F.col("keyword").isin("RA", "OBJCTRA")
    degrees = F.coalesce(text.try_cast("double"), _degrees(text, right))
    degrees = F.when(F.when(right, degrees.between(0, 360)).otherwise(degrees.between(-90, 90)), degrees)
    rank = F.struct(F.col("keyword").isin("OBJCTRA", "OBJCTDEC").alias("later"), "hdu", "record")
    stated = cards.filter(F.col("keyword").isin("RA", "DEC", "OBJCTRA", "OBJCTDEC")).select("frame_id", right.alias("right"), degrees.alias("degrees"), rank.alias("rank")).filter("degrees IS NOT NULL")
    of = lambda side: F.min_by("degrees", F.when(side, F.col("rank")))
    return stated.groupBy("frame_id").agg(of(F.col("right")).alias("ra_deg"), of(~F.col("right")).alias("dec_deg")).filter("ra_deg IS NOT NULL AND dec_deg IS NOT NULL")


def nearest(positions: DataFrame, key: str, entries: DataFrame, ref: str, radius_deg: float = 0.5) -> DataFrame:
    """key, ref, degrees (to 6 places) of the entry within the radius that each position is of.

    positions: key, ra_deg, dec_deg; entries: ref, ra_deg, dec_deg, size_arcmin.
    The distance less size / 120 decides, ties go to the lower ref. A position
    meets the entries of the cells that its circle can touch.
    """
    a = positions.select(key, F.col("ra_deg").alias("ra1"), F.col("dec_deg").alias("dec1")).withColumn("cell", F.explode(_cells("ra1", "dec1", radius_deg, True)))
    b = entries.select(ref, F.col("ra_deg").alias("ra2"), F.col("dec_deg").alias("dec2"), F.coalesce(F.col("size_arcmin") / 120, F.lit(0.0)).alias("less")).withColumn("cell", F.explode(_cells("ra2", "dec2", radius_deg, False)))
    d = a.join(b, "cell").withColumn("degrees", astro.separation(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2"))).filter(F.col("degrees") <= radius_deg)
    best = d.groupBy(key).agg(F.min_by(F.struct(ref, F.round("degrees", 6).alias("degrees")), F.struct((F.col("degrees") - F.col("less")).alias("score"), F.col(ref).alias("ref"))).alias("x"))
    return best.select(key, f"x.{ref}", "x.degrees")

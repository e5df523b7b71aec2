"""Attribute–value rows into one wide row per entity, with typed columns.

Attributes and their types are found first, over all rows; a dictionary says
which attributes mean one field, in which unit, and of which type it is. Each
cell (entity, field) is then resolved by rule: the first readable value counts,
and whether others contradict it, or can't be read, is kept beside it. One
conditional aggregation per field puts the cells into columns; what can't be
filled cleanly is read from the wide row.

Scale: two aggregations with map-side combining, by cell and by entity; their
buffers don't grow with the number of rows of a cell. Only the list of fields,
whose size is that of the schema, reaches the driver; attributes beyond
`most_new` columns share one map column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import values

TYPES = ("double", "bigint", "boolean", "string")
OTHERS = "others"


def discover(rows: DataFrame, attribute: str = "keyword", text: str = "value_text", share: float = 0.9) -> DataFrame:
    """keyword, field, field_type, unit_factor, n of every attribute, inferred from all its values.

    The narrowest type that at least `share` of an attribute's stated values
    can be read as: boolean, bigint, double, else string. The field is the
    attribute's own name. Attributes without a stated value are strings. n
    counts the stated values.
    """
    read = values.with_readings(rows.filter(F.col(attribute).isNotNull()).select(F.col(attribute).alias("keyword"), F.col(text).alias("_text")), "_text")
    stated = F.coalesce(F.col("_bare") != "", F.lit(False))
    parts = read.groupBy("keyword").agg(
        F.count_if(stated).alias("n"), F.count_if(stated & values.of_bare(F.col("_bare")).isNotNull() & ~F.col("_bare").isin("0", "1")).alias("as_boolean"),
        F.count_if(stated & F.col("_int").isNotNull()).alias("as_bigint"), F.count_if(stated & F.col("_num").isNotNull()).alias("as_double"),
    )
    kind = F.lit("string")
    for name in ("double", "bigint", "boolean"):
        kind = F.when((F.col("n") > 0) & (F.col(f"as_{name}") >= share * F.col("n")), name).otherwise(kind)
    return parts.select("keyword", F.col("keyword").alias("field"), kind.alias("field_type"), F.lit(1.0).alias("unit_factor"), "n")


def attributes(rows: DataFrame, dictionary: DataFrame | None = None, share: float = 0.9, most_new: int = 200) -> DataFrame:
    """keyword, field, field_type, unit_factor, inferred_type, n, known of every attribute that occurs or is in the dictionary.

    The dictionary's field, type and unit go before what the values look like.
    An attribute it doesn't know is a field of its own, named in small letters
    and _, with the inferred type; names that clash get a trailing _. Beyond
    the `most_new` most frequent of these the field is `others`. Commentary
    rows, known by their value_type, are no attributes.
    """
    told = rows.filter(F.coalesce("value_type", F.lit("")) != "commentary") if "value_type" in rows.columns else rows
    found = discover(told, share=share).select("keyword", F.col("field_type").alias("inferred_type"), "n")
    if dictionary is None:
        known = rows.sparkSession.createDataFrame([], "keyword string, field string, field_type string, unit_factor double")
    else:
        known = dictionary.select("keyword", "field", "field_type", F.coalesce("unit_factor", F.lit(1.0)).alias("unit_factor")).distinct()
    both = found.join(known, "keyword", "full_outer")
    taken = {r["field"] for r in known.select("field").distinct().collect()} | {"frame_id", OTHERS}
    fresh = both.filter("field IS NULL").select("keyword").orderBy(F.desc("n"), "keyword").limit(most_new).collect()
    named = []
    for r in fresh:
        name = "".join(ch.lower() if ch.isalnum() else "_" for ch in r["keyword"])
        while name in taken:
            name += "_"
        taken.add(name)
        named.append((r["keyword"], name))
    names = rows.sparkSession.createDataFrame(named, "keyword string, own string")
    return both.join(names, "keyword", "left").select(
        "keyword", F.coalesce("field", "own", F.lit(OTHERS)).alias("field"),
        F.when(F.col("field").isNotNull(), F.col("field_type")).when(F.col("own").isNotNull(), F.col("inferred_type")).otherwise("string").alias("field_type"),
        F.coalesce("unit_factor", F.lit(1.0)).alias("unit_factor"), "inferred_type", F.coalesce("n", F.lit(0)).alias("n"), F.col("field").isNotNull().alias("known"),
    )


def typed(rows: DataFrame, dictionary: DataFrame, entity: str = "frame_id", order: list[str] | None = None) -> DataFrame:
    """One row per stated value: entity, field, field_type, keyword, ord, text, num, int, flag, str, readable.

    Empty and undefined values state nothing and are left out, as are
    attributes the dictionary doesn't know and rows without an entity. `ord`
    orders an entity's values. Rows listed twice come twice; what is made of
    them doesn't depend on it.
    """
    order = order or ["hdu", "record"]
    known = dictionary.select("keyword", "field", "field_type", F.coalesce("unit_factor", F.lit(1.0)).alias("unit_factor")).distinct()
    slim = rows.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), *order, "keyword", "value_type", "value_text")
    kind, factor = F.col("field_type"), F.col("unit_factor")
    told = ~F.coalesce(F.col("value_type"), F.lit("")).isin("undefined", "commentary") & F.col("value_text").isNotNull()
    met = values.with_readings(slim.filter(told).join(known, "keyword"), "value_text").filter("_bare <> ''")
    met = met.select(
        "entity", "field", "field_type", "keyword", F.struct(*order, "keyword").alias("ord"), F.col("value_text").alias("text"), F.when(kind == "double", F.col("_num") * factor).alias("num"),
        F.when(kind == "bigint", F.when(factor == 1, F.col("_int")).otherwise(F.round(F.col("_int") * factor).cast("bigint"))).alias("int"), F.when(kind == "boolean", values.of_bare(F.col("_bare"))).alias("flag"), F.when(kind == "string", F.col("_bare")).alias("str"),
    )
    readable = F.coalesce("num", "int").isNotNull() | F.col("flag").isNotNull() | F.col("str").isNotNull()
    return met.withColumn("readable", readable)


def resolve(cells: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Each cell once: entity, field, cell (num, int, flag, str, keyword, repeated, unread, problem).

    Of several readable values the first in `ord` counts. repeated: more than
    one value is stated; unread: one can't be read. problem: `unreadable` where
    values are stated and none is readable, `conflict` where readable numbers
    are further apart than `tolerance` of the larger one, flags differ, or
    texts differ beyond case, outer quotes and blanks.
    """
    n = F.coalesce("num", F.col("int").cast("double"))
    value = F.struct("num", "int", "flag", "str", "keyword")
    g = cells.groupBy("entity", "field").agg(
        F.min_by(value, F.when(F.col("readable"), F.col("ord"))).alias("v"), F.max("readable").alias("any_readable"), (~F.min("readable")).alias("unread"),
        F.min("ord").alias("o0"), F.max("ord").alias("o1"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.min("flag").alias("f0"), F.max("flag").alias("f1"),
        F.min(F.upper("str")).alias("s0"), F.max(F.upper("str")).alias("s1"),
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    apart = no(F.col("hi") - F.col("lo") > tolerance * F.greatest(F.abs("hi"), F.abs("lo"))) | no(F.col("f0") != F.col("f1")) | no(F.col("s0") != F.col("s1"))
    problem = F.when(~F.col("any_readable"), "unreadable").when(apart, "conflict")
    return g.select("entity", "field", F.struct("v.*", (F.col("o0") != F.col("o1")).alias("repeated"), "unread", problem.alias("problem")).alias("cell"))


def pivoted(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """One row per entity: entity and a struct column for each field, by one conditional aggregation a field."""
    if not fields:
        return resolved.select("entity").distinct()
    return resolved.groupBy("entity").agg(*[F.first(F.when(F.col("field") == name, F.col("cell")), ignorenulls=True).alias(name) for name in fields])


def _fields(cells: DataFrame) -> list[tuple[str, str]]:
    return sorted({(r["field"], r["field_type"]) for r in cells.select("field", "field_type").distinct().collect()})


def problems(cells: DataFrame, fields: list[tuple[str, str]] | None = None, tolerance: float = 1e-3) -> DataFrame:
    """entity, field, problem of the cells that can't be filled cleanly, read from the wide row. See `resolve`."""
    names = [n for n, _ in fields or _fields(cells) if n != OTHERS]
    wide = pivoted(resolve(cells, tolerance), names)
    met = F.array_compact(F.array(*[F.when(F.col(n)["problem"].isNotNull(), F.struct(F.lit(n).alias("field"), F.col(n)["problem"].alias("problem"))) for n in names])) if names else F.array().cast("array<struct<field:string,problem:string>>")
    return wide.select("entity", F.explode(met).alias("p")).select("entity", "p.field", "p.problem")


def repeats(cells: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """entity, field, keyword, unread of the cells with more than one value, read from the wide row; keyword is the one that counts."""
    names = [n for n, _ in fields if n != OTHERS]
    wide = pivoted(resolve(cells), names)
    met = F.array_compact(F.array(*[F.when(F.col(n)["repeated"], F.struct(F.lit(n).alias("field"), F.col(n)["keyword"].alias("keyword"), F.col(n)["unread"].alias("unread"))) for n in names]))
    return wide.select("entity", F.explode(met).alias("p")).select("entity", "p.field", "p.keyword", "p.unread")


def widen(cells: DataFrame, fields: list[tuple[str, str]], entity: str = "frame_id") -> DataFrame:
    """One row per entity with a typed column per field.

    Of several readable values the first in `ord` is taken; a cell without a
    readable value is null. The columns are those of `fields` (name, type),
    whatever occurs; a field `others` is a map of attribute to text.
    """
    own = [(n, k) for n, k in fields if n != OTHERS]
    part = {"double": "num", "bigint": "int", "boolean": "flag", "string": "str"}

    def column(name: str, kind: str) -> Column:
        return F.col(name)[part[kind]].cast(kind).alias(name)

    wide = pivoted(resolve(cells.filter(F.col("field") != OTHERS)), [n for n, _ in own])
    if len(own) < len(fields):
        rest = cells.filter(F.col("field") == OTHERS).groupBy("entity", "keyword").agg(F.min_by("str", "ord").alias("str"))
        rest = rest.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "str")))).alias(OTHERS))
        wide = wide.join(rest, "entity", "full_outer")
        return wide.select(F.col("entity").alias(entity), *[column(n, k) for n, k in own], OTHERS)
    return wide.select(F.col("entity").alias(entity), *[column(n, k) for n, k in own])


def fields_of(dictionary: DataFrame) -> list[tuple[str, str]]:
    """The dictionary's fields and types, sorted; as many as the schema has."""
    return _fields(dictionary)

"""Planned header edits: what staged operations would do to each header unit, and whether they may.

Operations are few and known to the driver, so they are folded over the array
of a unit's cards by native expressions, one after another: later ones see what
earlier ones did. A unit that an operation may not touch is refused as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import text
from skyledger.operators import headers

_CARDS = "array<struct<keyword:string,value_type:string,value_text:string,note:string,hierarch:boolean>>"
_CHANGES = "array<struct<kind:string,keyword:string,before:string,after:string>>"
# What a change of these keywords leads to; the first two only where they are removed.
CONSEQUENCES = [
    (["SITELAT", "SITELONG", "OBSGEO-B", "OBSGEO-L", "LATITUDE", "LONGITUD"], True, "no altitude, airmass and moon"), (["DATE-OBS"], True, "no altitude, moon and night"),
    (["INSTRUME", "CREATOR", "TELESCOP", "SWCREATE"], False, "another scope or program is recognised"), (["FOCALLEN", "XPIXSZ", "YPIXSZ", "XBINNING"], False, "another scale and field of view"),
    (["GAIN", "OFFSET", "EXPTIME", "EXPOSURE", "CCD-TEMP", "SET-TEMP", "FILTER", "INSTRUME", "READOUTM"], False, "other calibration frames match"),
    (["IMAGETYP", "FRAME", "STACKCNT", "NCOMBINE", "LIVETIME"], False, "another classification"), (["OBJECT"], False, "another target name"),
    (["BAYERPAT", "XBAYROFF", "YBAYROFF", "ROWORDER"], False, "another colour reconstruction"),
]


@dataclass(frozen=True)
class Op:
    """kind: set, unset, rename (keyword to `value`) or history (`value`). value_type of a set value is told by its text if not given."""

    kind: str
    keyword: str = "HISTORY"
    value: str | None = None
    value_type: str | None = None
    note: str | None = None


def parsed(assignments: DataFrame) -> list[Op]:
    """The operations of `place`, `assignment` rows: KEY=VALUE sets, KEY alone unsets. Of several for one keyword the last counts."""
    told = assignments.select("place", F.trim("assignment").alias("a")).withColumn("p", text.assignment(F.col("a")))
    bare = F.when(text.valid_keyword(F.upper("a")), F.upper("a"))
    told = told.select("place", F.coalesce("p.keyword", bare).alias("keyword"), "p.value_type", "p.value_text").filter("keyword IS NOT NULL")
    last = told.groupBy("keyword").agg(F.max_by(F.struct("place", "value_type", "value_text"), "place").alias("x")).select("keyword", "x.*").orderBy("place")
    return [Op("unset", r["keyword"]) if r["value_type"] is None else Op("set", r["keyword"], r["value_text"], r["value_type"]) for r in last.collect()]


def queued(ops: list[Op]) -> list[Op]:
    """A later operation on a keyword replaces the earlier one, in its place at the end."""
    kept: dict[object, Op] = {}
    for i, op in enumerate(ops):
        key = i if op.kind == "history" else op.keyword
        kept.pop(key, None)
        kept[key] = op
    return list(kept.values())


def from_template(template: DataFrame) -> list[Op]:
    """Operations of a table of keywords, as spark.read.json gives it: one row, a column a keyword, null to unset."""
    row = template.first()
    return [] if row is None else [Op("unset", k.upper()) if v is None else Op("set", k.upper(), str(v)) for k, v in row.asDict().items()]


def _is_value(c: Column) -> Column:
    return F.coalesce(c["value_type"], F.lit("")) != "commentary"


def _first(cards: Column, keyword: str) -> Column:
    """Place from 1 of the first value card of a keyword, 0 if there is none."""
    return F.coalesce(F.array_position(F.transform(cards, lambda c: _is_value(c) & (c["keyword"] == keyword)), True), F.lit(0))


def _card(keyword: Column, kind: Column, value: Column, note: Column) -> Column:
    return F.struct(keyword.alias("keyword"), kind.alias("value_type"), value.alias("value_text"), note.alias("note"), F.lit(False).alias("hierarch"))


def _change(kind: str, keyword: str, before: Column, after: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(keyword).alias("keyword"), before.cast("string").alias("before"), after.cast("string").alias("after"))


def _shown(c: Column) -> Column:
    return text.shown(c["value_type"], F.coalesce(c["value_text"], F.lit("")))


def wrapped_history(line: Column) -> Column:
    """The HISTORY texts of a line: printable characters only, 72 at most each."""
    plain = F.regexp_replace(line, "[^ -~]", "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(plain) / 72).cast("int") - 1, F.lit(0))), lambda k: F.substr(plain, k * 72 + 1, F.lit(72)))


def plan(cards: DataFrame, ops: list[Op], units: DataFrame | None = None, audit: str | None = "edited") -> DataFrame:
    """frame_id, hdu, refused, changes, warnings, consequences, records, blocks, records_after, blocks_after, in_place of every unit.

    cards: frame_id, hdu, record, keyword, value_type, value_text, note,
    hierarch; rows listed twice count once. units: frame_id, hdu, kind and
    errors (array of codes) where known: units with errors are refused. A set
    changes the first value card of its keyword, or adds one after the last
    value card; an unset removes every one; a rename is refused where the new
    name is there already. refused says why nothing is done, else null; then
    there are no changes. With `audit` a line of history tells the changes.
    """
    c = F.col
    member = F.struct("record", F.struct("keyword", "value_type", "value_text", "note", F.coalesce("hierarch", F.lit(False)).alias("hierarch")).alias("c"))
    df = cards.groupBy("frame_id", "hdu").agg(F.transform(F.array_sort(F.collect_set(member)), lambda x: x["c"]).cast(_CARDS).alias("cards"))
    if units is not None:
        df = df.join(units.select("frame_id", "hdu", c("kind").alias("unit_kind"), "errors").dropDuplicates(["frame_id", "hdu"]), ["frame_id", "hdu"], "left")
    else:
        df = df.withColumns({"unit_kind": F.lit(None).cast("string"), "errors": F.array().cast("array<string>")})
    broken = F.when(F.size("errors") > 0, F.concat(F.lit("structural errors: "), F.array_join("errors", ", ")))
    df = df.withColumns({"before": c("cards"), "refused": broken, "changes": F.array().cast(_CHANGES), "warnings": F.array().cast("array<string>"), "consequences": F.array().cast("array<string>")})
    for op in queued(ops):
        df = _history(df, op) if op.kind == "history" else {"set": _set, "unset": _unset, "rename": _rename}[op.kind](df, op)
    df = df.withColumn("changes", F.when(c("refused").isNull(), c("changes")).otherwise(F.array().cast(_CHANGES))).withColumn("cards", F.when(c("refused").isNull(), c("cards")).otherwise(c("before")))
    if audit is not None:
        told = F.filter("changes", lambda x: x["kind"] != "history")
        line = F.transform(told, lambda x: F.when(x["kind"] == "added", F.concat(F.lit("add "), x["keyword"], F.lit("="), x["after"])).when(x["kind"] == "removed", F.concat(F.lit("remove "), x["keyword"])).when(x["kind"] == "renamed", F.concat(F.lit("rename "), x["keyword"])).otherwise(F.concat(F.lit("set "), x["keyword"], F.lit(" "), x["before"], F.lit("->"), x["after"])))
        df = df.withColumn("_line", F.when(F.size(told) > 0, F.concat(F.lit(f"{audit}: "), F.array_join(line, "; "))))
        lines = F.transform(wrapped_history(c("_line")), lambda t: _card(F.lit("HISTORY"), F.lit("commentary"), t, F.lit(None).cast("string")))
        df = df.withColumn("cards", F.when(c("_line").isNotNull(), F.concat("cards", lines.cast(_CARDS))).otherwise(c("cards"))).drop("_line")
    n = lambda cards: F.aggregate(cards, F.lit(0), lambda a, x: a + F.size(headers.format_records(x["keyword"], x["value_type"], x["value_text"], x["note"], x["hierarch"])))
    blocks = lambda r: F.ceil((r + 1) * 80 / 2880).cast("bigint")
    df = df.withColumns({"records": n(c("before")).cast("bigint"), "records_after": n(c("cards")).cast("bigint")}).withColumns({"blocks": blocks(c("records")), "blocks_after": blocks(c("records_after"))})
    return df.select("frame_id", "hdu", "refused", "changes", "warnings", "consequences", "records", "blocks", "records_after", "blocks_after", (c("blocks") == c("blocks_after")).alias("in_place"))


def _refuse(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("refused", F.coalesce("refused", reason))


def _locked(df: DataFrame, keyword: str) -> DataFrame:
    why = text.locked(F.lit(keyword), F.col("unit_kind"))
    return _refuse(df, F.when(why.isNotNull(), F.concat(F.lit(f"{keyword} is locked: it "), why)))


def _note(df: DataFrame, keyword: str, removed: bool, done: Column) -> DataFrame:
    told = [words for keys, only_removed, words in CONSEQUENCES if keyword in keys and (removed or not only_removed)]
    if not told:
        return df
    return df.withColumn("consequences", F.when(done, F.array_distinct(F.concat("consequences", F.array(*map(F.lit, told))))).otherwise(F.col("consequences")))


def _set(df: DataFrame, op: Op) -> DataFrame:
    key, c = op.keyword.strip().upper(), F.col
    df = _locked(df, key)
    if op.value_type is None:
        told = text.assignment(F.lit(f"K={op.value}"))
        kind, value = told["value_type"], told["value_text"]
    else:
        kind, value = F.lit(op.value_type), F.lit(op.value)
    df = _refuse(df, F.when(~text.valid_keyword(F.lit(key)), f"{key} is no valid keyword"))
    df = _refuse(df, F.when(F.rlike(F.concat(value, F.lit(op.note or "")), F.lit("[^ -~]")), f"{key}: value and comment must be printable"))
    df = df.withColumns({"_at": _first(c("cards"), key), "_n": F.size(F.filter("cards", lambda x: _is_value(x) & (x["keyword"] == key)))})
    old = F.try_element_at("cards", F.nullif(c("_at"), F.lit(0)).cast("int"))
    after = text.shown(kind, value)
    df = df.withColumn("warnings", F.when(c("_n") > 1, F.concat("warnings", F.array(F.concat(F.lit(f"{key} appears "), c("_n").cast("string"), F.lit(" times; the first is changed"))))).otherwise(c("warnings")))
    same = (c("_at") > 0) & (_shown(old) == after) & F.lit(op.note is None)
    changed = F.when(c("_at") == 0, F.array(_change("added", key, F.lit(None), after))).when(~same, F.array(_change("modified", key, _shown(old), after))).otherwise(F.array().cast(_CHANGES))
    place = F.size("cards") - F.coalesce(F.nullif(F.array_position(F.reverse(F.transform("cards", _is_value)), True), F.lit(0)), F.size("cards") + 1) + 1
    fresh = _card(F.lit(key), kind, value, F.lit(op.note).cast("string"))
    new = F.transform("cards", lambda x, i: F.when(i + 1 == c("_at"), _card(F.lit(key), kind, value, F.lit(op.note).cast("string") if op.note is not None else x["note"])).otherwise(x))
    put = F.concat(F.slice("cards", F.lit(1), place.cast("int")), F.array(fresh).cast(_CARDS), F.slice("cards", place.cast("int") + 1, F.size("cards")))
    df = df.withColumns({"changes": F.concat("changes", changed), "cards": F.when(c("_at") == 0, put).when(same, c("cards")).otherwise(new.cast(_CARDS)), "_done": ~same})
    return _note(df, key, False, c("_done")).drop("_at", "_n", "_done")


def _unset(df: DataFrame, op: Op) -> DataFrame:
    key, c = op.keyword.strip().upper(), F.col
    df = _locked(df, key)
    mine = lambda x: _is_value(x) & (F.coalesce(x["keyword"], F.lit("")) == key)
    df = df.withColumn("_gone", F.filter("cards", mine))
    gone = F.transform("_gone", lambda x: _change("removed", key, _shown(x), F.lit(None)))
    df = df.withColumns({"changes": F.concat("changes", gone), "cards": F.filter("cards", lambda x: ~mine(x)), "warnings": F.when(F.size("_gone") == 0, F.concat("warnings", F.array(F.lit(f"{key} is not in the header")))).otherwise(c("warnings"))})
    return _note(df, key, True, F.size("_gone") > 0).drop("_gone")


def _rename(df: DataFrame, op: Op) -> DataFrame:
    key, to, c = op.keyword.strip().upper(), (op.value or "").strip().upper(), F.col
    df = _refuse(df, F.when(~text.valid_keyword(F.lit(to)), f"{to} is no valid keyword"))
    df = _refuse(_locked(_locked(df, key), to), F.when(_first(c("cards"), to) > 0, f"cannot rename {key} to {to}: {to} already exists"))
    df = df.withColumn("_at", _first(c("cards"), key))
    old = F.try_element_at("cards", F.nullif(c("_at"), F.lit(0)).cast("int"))
    told = F.array(_change("renamed", f"{key}->{to}", F.concat(F.lit(f"{key} = "), _shown(old)), F.concat(F.lit(f"{to} = "), _shown(old))))
    new = F.transform("cards", lambda x, i: F.when(i + 1 == c("_at"), F.struct(F.lit(to).alias("keyword"), x["value_type"], x["value_text"], x["note"], x["hierarch"])).otherwise(x))
    df = df.withColumns({"changes": F.when(c("_at") > 0, F.concat("changes", told)).otherwise(c("changes")), "cards": new.cast(_CARDS), "warnings": F.when(c("_at") == 0, F.concat("warnings", F.array(F.lit(f"{key} is not in the header")))).otherwise(c("warnings"))})
    return _note(df, key, True, c("_at") > 0).drop("_at")


def _history(df: DataFrame, op: Op) -> DataFrame:
    lines = F.transform(wrapped_history(F.lit(op.value or "")), lambda t: _card(F.lit("HISTORY"), F.lit("commentary"), t, F.lit(None).cast("string")))
    return df.withColumns({"cards": F.concat("cards", lines.cast(_CARDS)), "changes": F.concat("changes", F.array(_change("history", "HISTORY", F.lit(None), F.lit(op.value))))})


def changes(planned: DataFrame) -> DataFrame:
    """A row per change of the units that aren't refused."""
    return planned.select("frame_id", "hdu", F.explode("changes").alias("x")).select("frame_id", "hdu", "x.*")


def totals(planned: DataFrame) -> DataFrame:
    """One row: units that would change, in place or by a rewrite, and that are refused; records added; distinct consequences and warnings."""
    c = F.col
    changed = F.size("changes") > 0
    told = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(changed, c(name))))))
    return planned.agg(
        F.count_if(changed).alias("changed"), F.count_if(changed & c("in_place")).alias("in_place"), F.count_if(changed & ~c("in_place")).alias("rewritten"), F.count_if(c("refused").isNotNull()).alias("refused"),
        F.coalesce(F.sum(F.when(changed, c("records_after") - c("records"))), F.lit(0)).alias("records_added"), F.array_join(told("consequences"), "; ").alias("consequences"), F.array_join(told("warnings"), "; ").alias("warnings"),
    )


def scrub(cards: DataFrame, serial_keywords: list[str] = (), models: DataFrame | None = None) -> DataFrame:
    """frame_id, hdu, keyword, op, value: what takes places, persons and serial numbers out of each unit.

    Private keywords are unset. A serial number that stands in another keyword
    (`serial_keywords`) is replaced by the file's model where `models`
    (frame_id, model) knows it, else unset.
    """
    met = cards.filter(F.coalesce("value_type", F.lit("")) != "commentary").select("frame_id", "hdu", "keyword").distinct()
    unset = met.filter(F.col("keyword").isin(headers.PRIVATE)).select("frame_id", "hdu", "keyword", F.lit("unset").alias("op"), F.lit(None).cast("string").alias("value"))
    serial = met.filter(F.col("keyword").isin(list(serial_keywords)) & ~F.col("keyword").isin(headers.PRIVATE))
    if models is not None:
        serial = serial.join(models.groupBy("frame_id").agg(F.min("model").alias("value")), "frame_id", "left")
    else:
        serial = serial.withColumn("value", F.lit(None).cast("string"))
    return unset.unionByName(serial.select("frame_id", "hdu", "keyword", F.when(F.col("value").isNull(), "unset").otherwise("set").alias("op"), "value"))

"""Header cards as tables: formatting and parsing records, first values, spread, differences, edit plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import order

# Keywords whose values aren't compared between files, since they describe the layout or are commentary.
STRUCTURAL = [
    "SIMPLE", "XTENSION", "BITPIX", "NAXIS", "EXTEND", "PCOUNT", "GCOUNT", "BZERO", "BSCALE", "CHECKSUM",
    "DATASUM", "END", "COMMENT", "HISTORY", "", "ZIMAGE", "ZBITPIX", "ZCMPTYPE", "TFIELDS",
]
STRUCTURAL_INDEXED = r"^(NAXIS|ZNAXIS|ZTILE|ZNAME|ZVAL|TTYPE|TFORM)\d+$"
# Keywords that tell where a site is, whose it is, or which unit of a device was used.
PRIVATE = [
    "SITELAT", "SITELONG", "SITEELEV", "OBSLAT", "OBSLONG", "OBSALT", "LAT-OBS", "LONG-OBS", "ALT-OBS", "OBSGEO-B", "OBSGEO-L", "OBSGEO-H", "OBSGEO-X",
    "OBSGEO-Y", "OBSGEO-Z", "LATITUDE", "LONGITUD", "ALTITUDE", "OBSERVER", "AUTHOR", "OBSERVAT", "SITENAME", "CAMERAID", "SERIALNB", "SERIALNO", "CAMSERNO",
]

_STRING = r"^'((?:[^']|'')*)'"


def exploded(hdus: DataFrame, hdu: int = 0) -> DataFrame:
    """One row per card of each header's unit `hdu`; headers listed twice count once. record is the place in the header."""
    once = hdus.filter(F.col("hdu") == hdu).dropDuplicates(["frame_id", "hdu"])
    return once.select("frame_id", "rig", "batch_no", F.posexplode("cards").alias("record", "c")).select("frame_id", "rig", "batch_no", "record", "c.*")


def unit_cards(hdus: DataFrame) -> DataFrame:
    """As `exploded`, of every unit; frame_id is the struct (hdu, frame_id) that names the unit."""
    once = hdus.dropDuplicates(["frame_id", "hdu"]).withColumn("frame_id", F.struct("hdu", "frame_id"))
    return once.select("frame_id", F.posexplode("cards").alias("record", "c")).select("frame_id", "record", "c.*")


def successive_units(hdus: DataFrame) -> DataFrame:
    """a, b: every unit (hdu, frame_id) and the one before it of the same rig and hdu. Only ids are sorted, over all partitions."""
    units = order.numbered(hdus.select("rig", "frame_id", "hdu").dropDuplicates(["frame_id", "hdu"]), ["rig", "hdu"], ["frame_id"], "n")
    before = units.select(F.col("rig").alias("_rig"), F.col("hdu").alias("_hdu"), (F.col("n") + 1).alias("_n"), F.col("frame_id").alias("before"))
    met = units.join(before, F.col("rig").eqNullSafe(F.col("_rig")) & (F.col("hdu") == F.col("_hdu")) & (F.col("n") == F.col("_n")))
    return met.select(F.struct("hdu", F.col("before").alias("frame_id")).alias("a"), F.struct("hdu", "frame_id").alias("b"))


def first_values(cards: DataFrame, keys: list[str]) -> DataFrame:
    """The first card of each keyword, commentary aside."""
    some = cards.filter((F.col("value_type") != "commentary") & F.col("keyword").isNotNull())
    return some.groupBy(*keys, "keyword").agg(F.min_by(F.struct("value_type", "value_text"), "record").alias("x")).select(*keys, "keyword", "x.value_type", "x.value_text")


def format_record(keyword: Column, value_type: Column, text: Column, note: Column) -> Column:
    """An 80-character record: a value right-justified to 20, a string in quotes padded to 8, the comment cut to fit.

    Long strings are not split here; a record longer than 80 is cut.
    """
    quoted = F.concat(F.lit("'"), F.rpad(F.replace(text, F.lit("'"), F.lit("''")), 8, " "), F.lit("'"))
    long_quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    string = F.when(F.length(F.replace(text, F.lit("'"), F.lit("''"))) < 8, quoted).otherwise(long_quoted)
    plain = F.when(F.length(text) < 20, F.lpad(text, 20, " ")).otherwise(text)
    value = F.when(value_type == "string", string).when(value_type == "undefined", F.lit("")).otherwise(F.coalesce(plain, F.lit("")))
    body = F.concat(F.rpad(F.substring(keyword, 1, 8), 8, " "), F.lit("= "), value)
    full = F.when(note.isNotNull() & (note != ""), F.concat(body, F.lit(" / "), note)).otherwise(body)
    return F.rpad(F.substring(full, 1, 80), 80, " ")


def parse_record(record: Column) -> Column:
    """keyword, value_type, value_text, note of an 80-character record; the inverse of format_record for values that fit."""
    keyword, field = F.rtrim(F.substring(record, 1, 8)), F.substring(record, 11, 70)
    trimmed = F.ltrim(field)
    is_string = trimmed.startswith("'")
    inner = F.rtrim(F.replace(F.regexp_extract(trimmed, _STRING, 1), F.lit("''"), F.lit("'")))
    after = F.when(is_string, F.regexp_replace(trimmed, _STRING, "")).otherwise(trimmed)
    note = F.when(after.contains("/"), F.trim(F.regexp_extract(after, r"^[^/]*/(.*)$", 1)))
    bare = F.trim(F.regexp_extract(after, r"^([^/]*)", 1))
    kind = (
        F.when(F.substring(record, 9, 2) != "= ", "commentary").when(is_string, "string").when(bare == "", "undefined").when(bare.isin("T", "F"), "logical")
        .when(bare.rlike(r"^[+-]?\d+$"), "integer").when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?$"), "float").otherwise("unparsed")
    )
    return F.struct(keyword.alias("keyword"), kind.alias("value_type"), F.when(is_string, inner).otherwise(bare).alias("value_text"), note.alias("note"))


def format_records(keyword: Column, value_type: Column, text: Column, note: Column, hierarch: Column) -> Column:
    """The 80-character records of a card: HIERARCH keys in full, long strings and commentary over several records.

    A comment is cut to the last record's room, as is a number longer than a
    record; those cards don't come back whole.
    """
    text, keyword = F.coalesce(text, F.lit("")), F.coalesce(keyword, F.lit(""))
    long_key = F.coalesce(hierarch, F.lit(False)) | (F.length(keyword) > 8)
    head = F.when(long_key, F.concat(F.lit("HIERARCH "), keyword, F.lit(" = "))).otherwise(F.concat(F.rpad(keyword, 8, " "), F.lit("= ")))
    # a string's pieces: its characters, quotes doubled, as many as each record has room for beside quotes and &
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("open"))
    room = lambda a: F.when(F.size(a["full"]) == 0, F.lit(77) - F.length(head)).otherwise(67)

    def add(a: Column, ch: Column) -> Column:
        c = F.when(ch == "'", F.lit("''")).otherwise(ch)
        over = F.length(a["open"]) + F.length(c) > room(a)
        return F.when(over, F.struct(F.concat(a["full"], F.array(a["open"])).alias("full"), c.alias("open"))).otherwise(F.struct(a["full"].alias("full"), F.concat(a["open"], c).alias("open")))

    split = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, add, lambda a: F.concat(F.transform(a["full"], lambda x: F.concat(F.lit("'"), x, F.lit("&'"))), F.array(F.concat(F.lit("'"), a["open"], F.lit("'")))))
    doubled = F.replace(text, F.lit("'"), F.lit("''"))
    whole = F.array(F.concat(F.lit("'"), F.when(F.length(doubled) < 8, F.rpad(doubled, 8, " ")).otherwise(doubled), F.lit("'")))
    strings = F.when(F.length(doubled) + F.length(head) <= 78, whole).otherwise(split)
    plain = F.when(value_type == "undefined", F.lit("")).when(~long_key & (F.length(text) < 20), F.lpad(text, 20, " ")).otherwise(text)
    values = F.when(value_type == "string", strings).otherwise(F.array(plain))
    lines = F.transform(values, lambda v, i: F.concat(F.when(i == 0, head).otherwise(F.lit("CONTINUE  ")), v))
    told = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" / "), note)).otherwise("")
    lines = F.transform(lines, lambda r, i: F.when(i == F.size(values) - 1, F.concat(r, told)).otherwise(r))
    remarks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / 72).cast("int") - 1, F.lit(0))), lambda k: F.concat(F.rpad(keyword, 8, " "), F.substring(text, k * 72 + 1, F.lit(72))))
    return F.transform(F.when(value_type == "commentary", remarks).otherwise(lines), lambda r: F.rpad(F.substring(r, 1, 80), 80, " "))


def parse_records(records: Column) -> Column:
    """keyword, value_type, value_text, note, hierarch of a card's records; the inverse of format_records."""
    hier = r"^HIERARCH([^=]*)=(.*)$"
    first = records[0]
    long_key = first.rlike(hier)
    # a HIERARCH value is read as that of a common card, whose record may be longer than 80
    as_common = F.when(long_key, F.concat(F.lit("KEY     = "), F.regexp_extract(first, hier, 2))).otherwise(first)
    parsed = F.transform(records, lambda r, i: parse_record(F.when(i == 0, as_common).otherwise(F.regexp_replace(r, "^CONTINUE  ", "CONTINUE= "))))
    remark = ~long_key & ((F.substring(first, 9, 2) != "= ") | F.rtrim(F.substring(first, 1, 8)).isin("COMMENT", "HISTORY", ""))
    joined = F.array_join(F.transform(parsed, lambda p, i: F.when(i < F.size(records) - 1, F.regexp_replace(p["value_text"], "&$", "")).otherwise(p["value_text"])), "")
    remarks = F.rtrim(F.array_join(F.transform(records, lambda r: F.substring(r, 9, 72)), ""))
    note = F.nullif(F.array_join(F.transform(parsed, lambda p: p["note"]), " "), F.lit(""))
    return F.struct(
        F.when(long_key, F.trim(F.regexp_extract(first, hier, 1))).otherwise(F.rtrim(F.substring(first, 1, 8))).alias("keyword"), F.when(remark, "commentary").otherwise(parsed[0]["value_type"]).alias("value_type"),
        F.when(remark, remarks).otherwise(joined).alias("value_text"), F.when(~remark, note).alias("note"), long_key.alias("hierarch"),
    )


def round_trip(cards: DataFrame) -> DataFrame:
    """cards (keyword, value_type, value_text, note, hierarch) with records, what was parsed of them, and whether all of it agrees."""
    c = F.col
    out = cards.withColumn("records", format_records(c("keyword"), c("value_type"), c("value_text"), c("note"), c("hierarch"))).withColumn("parsed", parse_records(c("records")))
    text = F.coalesce(F.when(c("value_type").isin("string", "commentary"), F.rtrim("value_text")).otherwise(F.trim("value_text")), F.lit(""))
    same = c("parsed.keyword").eqNullSafe(c("keyword")) & c("parsed.value_type").eqNullSafe(c("value_type")) & (F.coalesce("parsed.value_text", F.lit("")) == text)
    return out.withColumn("agree", same & c("parsed.note").eqNullSafe(F.nullif(F.trim("note"), F.lit(""))) & c("parsed.hierarch").eqNullSafe(F.coalesce("hierarch", F.lit(False))))


def spread(cards: DataFrame, keys: list[str], top: int = 8) -> DataFrame:
    """Per keyword: files with it, distinct values, class of the spread, and the `top` most common values.

    same: one value; unique: hardly a value twice; range: numbers, more than
    six; else mixed. least and greatest are those of numbers. Structural keywords are left out. Undefined values count
    as empty text. The top list is a report; distinct and class see all values.
    """
    content = cards.filter(~F.col("keyword").isin(STRUCTURAL) & ~F.col("keyword").rlike(STRUCTURAL_INDEXED) & (F.col("value_type") != "commentary"))
    values = first_values_with_record(content, keys)
    tally = values.groupBy(*keys, "keyword", "text").agg(F.count("*").alias("n"), F.max("numeric").alias("numeric"))
    w = Window.partitionBy(*keys, "keyword").orderBy(F.desc("n"), "text")
    ranked = tally.withColumn("rank", F.row_number().over(w) - 1)
    shown = F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") < top, F.struct("rank", "text", "n")))), lambda x: F.concat(x["text"], F.lit(" x "), x["n"].cast("string"))))
    number = F.when(F.col("numeric"), F.translate("text", "Dd", "EE").try_cast("double"))
    out = ranked.groupBy(*keys, "keyword").agg(F.min(number).alias("least"), F.max(number).alias("greatest"), F.sum("n").alias("present"), F.count("*").alias("distinct_n"), F.min("numeric").alias("numeric"), shown.alias("values"))
    kind = F.when(F.col("distinct_n") == 1, "same").when((F.col("distinct_n") * 10 >= F.col("present") * 9) & (F.col("present") > 3), "unique").when(F.col("numeric") & (F.col("distinct_n") > 6), "range").otherwise("mixed")
    span = [F.when(F.col("numeric"), F.col(c)).alias(c) for c in ("least", "greatest")]
    return out.select(*keys, "keyword", "present", "distinct_n", kind.alias("spread"), "values", *span)


def first_values_with_record(cards: DataFrame, keys: list[str]) -> DataFrame:
    own = [*keys, *(["frame_id"] if "frame_id" not in keys else [])]
    first = cards.groupBy(*own, "keyword").agg(F.min_by(F.struct("value_type", "value_text"), "record").alias("x"))
    text = F.when(F.col("x.value_type") == "undefined", "").otherwise(F.coalesce("x.value_text", F.lit("")))
    return first.select(*keys, "keyword", text.alias("text"), F.col("x.value_type").isin("integer", "float").alias("numeric"))


def differences(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, keyword, status, value_a, value_b of the keywords of each pair of files that aren't the same.

    pairs: a, b (frame ids). Of a keyword given twice the last card counts.
    Numbers are equal as numbers, texts without outer blanks.
    """
    last = cards.filter(F.col("value_type") != "commentary").groupBy("frame_id", "keyword").agg(F.max_by(F.struct("value_type", "value_text"), "record").alias("x")).select("frame_id", "keyword", F.col("x.value_type").alias("t"), F.trim("x.value_text").alias("v"))
    left = pairs.join(last.withColumnRenamed("frame_id", "a"), "a").select("a", "b", "keyword", F.col("t").alias("ta"), F.col("v").alias("value_a"), F.lit(True).alias("in_a"))
    right = pairs.join(last.withColumnRenamed("frame_id", "b"), "b").select("a", "b", "keyword", F.col("t").alias("tb"), F.col("v").alias("value_b"), F.lit(True).alias("in_b"))
    both = left.join(right, ["a", "b", "keyword"], "full_outer")
    number = lambda c: F.translate(F.col(c), "Dd", "EE").try_cast("double")
    numeric = F.col("ta").isin("integer", "float") & F.col("tb").isin("integer", "float")
    same = F.when(numeric, number("value_a") == number("value_b")).otherwise(F.col("value_a").eqNullSafe(F.col("value_b")))
    status = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(same, "same").otherwise("changed")
    return both.withColumn("status", status).filter("status <> 'same'").select("a", "b", "keyword", "status", "value_a", "value_b")


def scrub_plan(cards: DataFrame, keywords: list[str] = PRIVATE) -> DataFrame:
    """Per header unit the private keywords to be removed, how many records remain with one more line of history, and whether they fit the same blocks."""
    private = F.col("keyword").isin(keywords)
    named = F.array_join(F.sort_array(F.collect_set(F.when(private, F.col("keyword")))), ",")
    per = cards.groupBy("frame_id", "hdu").agg(F.count("*").alias("records"), F.count_if(private).alias("removed"), named.alias("keywords"))
    blocks = lambda n: F.ceil((n + 1) * 80 / 2880)
    after = F.col("records") - F.col("removed") + 1
    return per.filter("removed > 0").select("frame_id", "hdu", "records", "removed", "keywords", after.alias("records_after"), (blocks(F.col("records")) == blocks(after)).alias("in_place"))


def edit_plan(cards: DataFrame, ops: DataFrame) -> DataFrame:
    """frame_id, keyword, kind, before, after: what staged edits would change, file by file.

    ops: place (order), op ('set', 'unset'), keyword, value. Of several edits
    of one keyword the last counts. A set changes the first card of its
    keyword, or adds one where the file has none; an unset removes every card.
    Edits that change nothing are left out. ops are as few as a user stages.
    """
    last = ops.groupBy("keyword").agg(F.max_by(F.struct("op", "value"), "place").alias("x")).select("keyword", "x.op", "x.value")
    staged = F.array(*[F.struct(F.lit(r["keyword"]).alias("keyword"), F.lit(r["op"]).alias("op"), F.lit(r["value"]).cast("string").alias("value")) for r in last.collect()])
    have = cards.filter(F.col("value_type") != "commentary").groupBy("frame_id", "keyword").agg(F.min_by("value_text", "record").alias("before"), F.count("*").alias("cards"))
    want = cards.select("frame_id").distinct().select("frame_id", F.explode(staged).alias("s")).select("frame_id", "s.*")
    met = want.join(have, ["frame_id", "keyword"], "left")
    kind = F.when((F.col("op") == "unset") & F.col("cards").isNotNull(), "remove").when((F.col("op") == "set") & F.col("cards").isNull(), "add").when((F.col("op") == "set") & ~F.col("before").eqNullSafe(F.col("value")), "modify")
    return met.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("frame_id", "keyword", "kind", "before", F.when(F.col("op") == "set", F.col("value")).alias("after"))

"""Planned moves: where each file would go by a template, in capture order, without two files in one place, with its companions, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import filename, text
from skyledger.operators import order
from skyledger.session import cut


def tokens(files: DataFrame) -> dict[str, Column]:
    """What a template may ask for, of a listing's columns."""
    c, lines = F.col, files.columns
    own = lambda name: c(name) if name in lines else F.lit(None)
    long = F.coalesce(own("total_s").cast("double"), c("exposure_s"))
    iso = c("date_obs").rlike(r"^\d{4}-\d{2}-\d{2}")
    return {
        "name": F.substring_index(F.regexp_replace("path", r"^.*[/\\]", ""), ".f", 1), "object": c("object"), "filter": c("filter_name"), "exptime": text.trimmed(c("exposure_s"), 3), "integration": text.compact_duration(long), "stack": c("stack_count").cast("string"),
        "date": F.when(iso, F.substring("date_obs", 1, 10)), "night": c("night"), "time": F.when(iso & (F.length("date_obs") >= 19), F.replace(F.substring("date_obs", 12, 8), F.lit(":"), F.lit(""))), "gain": text.trimmed(c("gain"), 3),
        "camera": c("camera"), "scope": own("scope").cast("string"), "frame": c("frame"), "seq": F.when(c("_n").isNotNull(), F.lpad(c("_n").cast("string"), 4, "0")),
    }


def plan(files: DataFrame, root: str, by: str = "{object}/{filter}", rename: str | None = None, companions: DataFrame | None = None) -> DataFrame:
    """source, target, companion, note, lacking of every file that would move.

    files: a listing (path, name, date_obs and what the templates ask for).
    The folder is `by` under root, the name `rename` or as it was; {seq} counts
    a folder's files in capture order (date as written, nulls first, then
    path). Where several files, moved or not, would have one place, all but the
    first get _2, _3 and so on, skipping names that a file has anyway.
    companions: paths of other files; those beside a file with its stem, in
    any case, move along. lacking: tokens without a value.
    """
    c = F.col
    stem, ext = text.stem_ext(c("path"))
    df = files.dropDuplicates(["path"]).withColumns({"_n": F.lit(None).cast("bigint"), "_stem": stem, "_ext": ext})
    dirs = [filename.rendered(segment.strip(), tokens(df)) for segment in by.split("/") if segment.strip()]
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), *[d for d, _ in dirs]) if dirs else F.regexp_replace("path", "/[^/]*$", "")
    empty = F.array().cast("array<string>")
    lacking = F.array_distinct(F.flatten(F.array(empty, *[m for _, m in dirs])))
    df = df.withColumns({"_dir": folder, "_lacking": lacking, "_at": F.struct(c("date_obs").isNotNull().alias("dated"), F.coalesce("date_obs", F.lit("")).alias("at"), "path")})
    df = order.numbered(df, ["_dir"], ["_at"], "_n")
    if rename:
        made, missing = filename.rendered(rename, tokens(df))
        df = df.withColumns({"_new": made, "_lacking": F.array_distinct(F.concat("_lacking", missing))})
    else:
        df = df.withColumn("_new", c("_stem"))
    dot = F.when(c("_ext") == "", "").otherwise(F.concat(F.lit("."), c("_ext")))
    df = df.withColumn("_to", F.concat("_dir", F.lit("/"), "_new", dot)).withColumn("_stays", c("_to") == c("path"))
    # a place is taken by the file that stays there, else by the first; the rest count on from 2
    df = order.numbered(df.withColumn("_rank", F.struct((~c("_stays")).alias("moves"), "_n", "path")), ["_to"], ["_rank"], "_k")
    df = cut(df)
    clear = df.filter("_k = 1").select(c("_to").alias("_taken")).distinct()
    clash = df.filter("_k > 1")
    # suffixes that lead to a taken place are skipped: as many more are tried as there are taken ones of the same form
    form = F.regexp_extract("_taken", r"^(.*)_(\d+)(\.[^/]*)?$", 1)
    used = clear.select(F.concat(form, F.coalesce(F.nullif(F.regexp_extract("_taken", r"^(.*)_(\d+)((?:\.[^/]*)?)$", 3), F.lit("")), F.lit(""))).alias("_to"), F.regexp_extract("_taken", r"_(\d+)(?:\.[^/]*)?$", 1).try_cast("bigint").alias("_u")).filter("_u >= 2")
    used = used.join(clash.select("_to").distinct(), "_to").groupBy("_to").agg(F.sort_array(F.collect_set("_u")).alias("_used"))
    skipped = F.aggregate(F.coalesce("_used", F.array().cast("array<bigint>")), c("_k").cast("bigint"), lambda a, u: F.when(u <= a, a + 1).otherwise(a))
    moved = clash.join(used, "_to", "left").withColumn("_to", F.concat("_dir", F.lit("/"), "_new", F.lit("_"), skipped.cast("string"), dot))
    note = F.when(c("_k") > 1, "renamed with a suffix to avoid a clash")
    own = ["path", "_to", "_stem", "_stays", "_lacking"]
    placed = df.filter("_k = 1").select(*own, note.alias("note")).unionByName(moved.select(*own, note.alias("note")))
    moves = placed.filter(~c("_stays")).select(c("path").alias("source"), c("_to").alias("target"), F.lit(False).alias("companion"), "note", c("_lacking").alias("lacking"), "_stem")
    if companions is None:
        return moves.drop("_stem")
    beside = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    cstem, cext = text.stem_ext(c("path"))
    other = companions.select(beside("path").alias("_d"), F.lower(cstem).alias("_s"), cext.alias("_e"), "path").distinct()
    target_stem, _ = text.stem_ext(c("target"))
    along = moves.withColumns({"_d": beside("source"), "_s": F.lower("_stem")}).join(other, ["_d", "_s"]).filter(c("path") != c("source"))
    along = along.select(c("path").alias("source"), F.concat(beside("target"), F.lit("/"), target_stem, F.lit("."), "_e").alias("target"), F.lit(True).alias("companion"), F.lit(None).cast("string").alias("note"), F.array().cast("array<string>").alias("lacking"))
    return moves.drop("_stem").unionByName(along)


def undo(moves: DataFrame) -> DataFrame:
    """The moves that lead back: each target to its source. As all are parked first, their order doesn't matter."""
    return moves.select(F.col("target").alias("source"), F.col("source").alias("target"), "companion")

"""Schemas that drift between files: one fused schema, and a report of each change.

Each source's files come in numbered batches. The schema of a batch is the
tagged union of its files' schemas: every path with the types it occurs in and
how many files carry each. Batches are fused by taking, per path, the type most
files carry as the canonical one and keeping the others as typed branches; a
value of a branch is converted where it states the canonical type. Alternatives
that appear or go from one batch to the next are reported. Changes against the batch before are reported per path; a path that
leaves while another with the same comment, values or meaning comes is one
that was renamed.

Scale: one aggregation over the exploded headers with map-side combining, and
no header is shuffled: a file listed k times counts 1/k each time. Everything
after works on rows per batch, path and type, that is on schema. Values are
looked at only for paths that leave or come, in a second scan.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import values
from skyledger.session import cut, if_small

UNDEFINED = "undefined"


FIELDS = "array<struct<path:string,type:string,text:string,note:string>>"


def header_files(hdus: DataFrame, hdu: int | None = 0) -> DataFrame:
    """source, batch, file, fields of each header; those listed twice come twice.

    fields are the path, type, text and note of every card; commentary cards
    and cards without a keyword are none.
    """
    kept = hdus if hdu is None else hdus.filter(F.col("hdu") == hdu)
    cards = F.filter("cards", lambda c: c["keyword"].isNotNull() & (F.coalesce(c["value_type"], F.lit("")) != "commentary"))
    fields = F.transform(cards, lambda c: F.struct(c["keyword"].alias("path"), c["value_type"].alias("type"), c["value_text"].alias("text"), c["note"].alias("note")))
    return kept.select(F.col("rig").alias("source"), F.col("batch_no").alias("batch"), F.col("frame_id").cast("string").alias("file"), fields.alias("fields"))


def _leaves(node: object, path: str, out: list) -> None:
    for key, value in node.items():
        at = f"{path}{key}"
        if isinstance(value, dict):
            _leaves(value, at + ".", out)
            continue
        kind = {bool: "boolean", int: "number", float: "number", str: "string", list: "array"}.get(type(value), UNDEFINED)
        out.append({"path": at, "type": kind, "text": value if isinstance(value, str) else json.dumps(value, sort_keys=True)})


def _json_leaves(documents: pd.Series) -> pd.Series:
    """Dotted paths of the fields of a JSON object that aren't objects; null or text that is no object gives none."""

    def leaves(text):
        out: list = []
        try:
            node = json.loads(text) if text else None
        except ValueError:
            node = None
        if isinstance(node, dict):
            _leaves(node, "", out)
        return out

    return documents.map(leaves)


def json_leaves(text: Column) -> Column:
    return F.pandas_udf(_json_leaves, "array<struct<path:string,type:string,text:string>>")(text)


def json_files(rules: DataFrame, source: str, batch: str, file: str, text: str) -> DataFrame:
    """As header_files, of a column of JSON objects; its files are known by `file`."""
    slim = rules.select(F.lit(source).alias("source"), F.col(batch).alias("batch"), F.col(file).alias("file"), json_leaves(F.col(text)).alias("leaves"))
    fields = F.transform("leaves", lambda c: F.struct(c["path"].alias("path"), c["type"].alias("type"), c["text"].alias("text"), F.lit(None).cast("string").alias("note")))
    return slim.select("source", "batch", "file", F.coalesce(fields, F.array().cast(FIELDS)).alias("fields"))


def plain_note(note: Column) -> Column:
    """A comment without its unit in brackets, case, signs and blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(note, r"\[[^\]]*\]|\([^)]*\)", "")), "[^a-z0-9]", "")


def _plain_text(text: Column) -> Column:
    return F.coalesce(values.number(text).cast("string"), values.folded(text))


_TAG = "\x01"


def _weighted(files: DataFrame) -> DataFrame:
    """files with `weight`: 1, or 1/k of a file listed k times."""
    listed = cut(files.groupBy("source", "batch", "file").agg(F.count("*").alias("_k")).filter("_k > 1"))
    keys = ["source", "batch", "file"]
    met = files.join(if_small(listed), [files[k].eqNullSafe(listed[k]) for k in keys], "left")
    return met.select(*[files[k] for k in keys], files["fields"], (1 / F.coalesce("_k", F.lit(1))).alias("weight"))


def alternatives(files: DataFrame) -> DataFrame:
    """The tagged union: source, batch, path, type, files.

    The row with type '*' counts the files that carry the path at all; a path
    that is undefined in a file gives that file no other row. The row with
    null path and type '*' counts all files of the batch. Of a file listed with
    different headers each counts in part; sums are rounded.
    """
    typed = F.filter("fields", lambda f: f["type"].isNotNull() & (f["type"] != UNDEFINED))
    # as text, since distinct arrays of text are found by hashing
    tags = F.array_distinct(F.concat(F.transform(typed, lambda f: F.concat(f["path"], F.lit(_TAG), f["type"])), F.transform("fields", lambda f: F.concat(f["path"], F.lit(_TAG), F.lit("*")))))
    tags = F.concat(tags, F.array(F.lit(None).cast("string")))
    counted = _weighted(files).select("source", "batch", "weight", F.explode(tags).alias("tag")).groupBy("source", "batch", "tag").agg(F.round(F.sum("weight")).cast("bigint").alias("files"))
    return counted.select("source", "batch", F.split_part("tag", F.lit(_TAG), F.lit(1)).alias("path"), F.coalesce(F.split_part("tag", F.lit(_TAG), F.lit(2)), F.lit("*")).alias("type"), "files")


def _before(batches: DataFrame) -> DataFrame:
    """source, batch, before: each batch with the one before it; a source's first has none and is left out."""
    order = Window.partitionBy("source").orderBy("batch")
    return batches.select("source", "batch").distinct().withColumn("before", F.lag("batch").over(order)).filter(F.col("before").isNotNull())


def appearing(files: DataFrame) -> DataFrame:
    """source, batch, path, type, change, files of each alternative that the batch before didn't have (appeared) or that this one hasn't (gone).

    files carry the alternative where it is. The first batch has no changes.
    """
    every = cut(alternatives(files))
    united, batches = every.filter("type <> '*'"), _before(every)
    keys = ["source", "batch", "before", "path", "type"]
    old = united.withColumnRenamed("batch", "before").join(batches, ["source", "before"]).select(*keys, F.col("files").alias("old_files"))
    new = united.join(batches, ["source", "batch"]).select(*keys, F.col("files").alias("new_files"))
    both = old.join(new, keys, "full_outer").filter("old_files IS NULL OR new_files IS NULL")
    return both.select("source", "batch", "path", "type", F.when(F.col("old_files").isNull(), "appeared").otherwise("gone").alias("change"), F.coalesce("new_files", "old_files").alias("files"))


def schemas(united: DataFrame, least_share: float = 0.25) -> DataFrame:
    """source, batch, path, type, files, of, of every path that at least `least_share` of a batch's files carry.

    united: as `alternatives` gives it. `type` is the one most of these files
    carry, undefined values aside (ties: the first by name); null where all are
    undefined.
    """
    typed = F.col("type") != "*"
    tally = united.filter("path IS NOT NULL").groupBy("source", "batch", "path").agg(
        F.max(F.when(~typed, F.col("files"))).alias("files"), F.min_by(F.when(typed, F.col("type")), F.when(typed, F.struct(-F.col("files"), F.col("type")))).alias("type"),
    )
    of = united.filter("path IS NULL").select("source", "batch", F.col("files").alias("of"))
    return tally.join(of, ["source", "batch"]).filter(F.col("files") >= least_share * F.col("of")).select("source", "batch", "path", "type", "files", "of")


def _assign(pairs: pd.DataFrame) -> pd.DataFrame:
    """One-to-one pairs of one batch, best first; as many as its schema has paths."""
    pairs = pairs.sort_values(["score", "old", "new"], ascending=[False, True, True], kind="stable")
    old, new, kept = set(), set(), []
    for i, r in zip(pairs.index, pairs.itertuples()):
        if r.old not in old and r.new not in new:
            old.add(r.old), new.add(r.new), kept.append(i)
    return pairs.loc[kept, ["source", "batch", "old", "new"]]


def changes(files: DataFrame, meaning: DataFrame | None = None, least_share: float = 0.25, least_overlap: float = 0.5) -> DataFrame:
    """source, batch, path, change, new_path against the source's previous batch.

    change: added, removed, retyped, or renamed (then new_path is the new name,
    else ''). A path that leaves and one that comes in the same batch are one
    that was renamed if their comments agree, if `meaning` (keyword, field)
    gives both one field, or if at least `least_overlap` of their values are
    shared; not if comments or meanings contradict. The first batch has no
    changes; an empty table has none.
    """
    present = cut(schemas(cut(alternatives(files)), least_share))
    batches = _before(present)
    old = present.select("source", F.col("batch").alias("before"), "path", F.col("type").alias("old_type")).join(batches, ["source", "before"])
    new = present.join(batches, ["source", "batch"]).select("source", "batch", "before", "path", F.col("type").alias("new_type"))
    both = old.withColumn("in_old", F.lit(True)).join(new.withColumn("in_new", F.lit(True)), ["source", "batch", "before", "path"], "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped")
    found = cut(both.withColumn("change", change).filter(F.col("change").isNotNull()).select("source", "batch", "before", "path", "change"))

    # what the paths that leave or come carried, in the batch before or in this one
    moving = found.filter(F.col("change") != "retyped").withColumn("at", F.when(F.col("change") == "removed", F.col("before")).otherwise(F.col("batch")))
    wanted = cut(moving.groupBy("source", F.col("at").alias("batch")).agg(F.collect_set("path").alias("paths")))
    fields = files.join(if_small(wanted), ["source", "batch"]).select("source", F.col("batch").alias("at"), "file", F.explode(F.filter("fields", lambda f: F.array_contains("paths", f["path"]))).alias("f"))
    met = cut(fields.select("source", "at", "file", "f.*").distinct().join(moving.select("source", "at", "path", "batch", "change"), ["source", "at", "path"]))
    stated = F.when(F.col("type") != UNDEFINED, _plain_text(F.col("text")))
    shares = met.select("source", "batch", "path", "change", stated.alias("v")).filter(F.col("v").isNotNull()).groupBy("source", "batch", "path", "change", "v").agg(F.count("*").alias("n"))
    total = shares.groupBy("source", "batch", "path", "change").agg(F.sum("n").alias("of"))
    shares = shares.join(total, ["source", "batch", "path", "change"]).select("source", "batch", "path", "change", "v", (F.col("n") / F.col("of")).alias("share"))
    leaving = shares.filter(F.col("change") == "removed").select("source", "batch", F.col("path").alias("old"), "v", F.col("share").alias("s0"))
    coming = shares.filter(F.col("change") == "added").select("source", "batch", F.col("path").alias("new"), "v", F.col("share").alias("s1"))
    overlap = leaving.join(coming, ["source", "batch", "v"]).groupBy("source", "batch", "old", "new").agg(F.sum(F.least("s0", "s1")).alias("overlap"))
    plain = plain_note(F.col("note"))
    notes = met.filter(plain != "").groupBy("source", "batch", "path", "change", plain.alias("said")).agg(F.count("*").alias("n"))
    notes = notes.groupBy("source", "batch", "path", "change").agg(F.min_by("said", F.struct(-F.col("n"), F.col("said"))).alias("said"))

    def side(change: str, name: str) -> DataFrame:
        mine = moving.filter(F.col("change") == change).select("source", "batch", "path", "change").join(notes, ["source", "batch", "path", "change"], "left")
        if meaning is not None:
            mine = mine.join(meaning.select(F.col("keyword").alias("path"), "field").dropDuplicates(["path"]), "path", "left")
        else:
            mine = mine.withColumn("field", F.lit(None).cast("string"))
        return mine.select("source", "batch", F.col("path").alias(name), F.col("said").alias(f"said_{name}"), F.col("field").alias(f"field_{name}"))

    pairs = side("removed", "old").join(side("added", "new"), ["source", "batch"]).join(overlap, ["source", "batch", "old", "new"], "left")
    said, meant, shared = F.col("said_old") == F.col("said_new"), F.col("field_old") == F.col("field_new"), F.coalesce("overlap", F.lit(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    against = yes(~meant) | (yes(~said) & ~yes(meant))
    likely = pairs.filter(~against & (yes(said) | yes(meant) | (shared >= least_overlap)))
    score = 2.0 * yes(said).cast("double") + 2.0 * yes(meant).cast("double") + shared
    renamed = likely.select("source", "batch", "old", "new", score.alias("score")).groupBy("source", "batch").applyInPandas(_assign, "source string, batch int, old string, new string")
    renamed = cut(renamed)
    gone = renamed.select("source", "batch", F.col("old").alias("path"), F.lit("removed").alias("change")).unionByName(renamed.select("source", "batch", F.col("new").alias("path"), F.lit("added").alias("change")))
    rest = found.select("source", "batch", "path", "change").join(gone, ["source", "batch", "path", "change"], "left_anti").withColumn("new_path", F.lit(""))
    return rest.unionByName(renamed.select("source", "batch", F.col("old").alias("path"), F.lit("renamed").alias("change"), F.col("new").alias("new_path")))


def canonical_names(events: list[tuple[int, str, str]], batches: list[int]) -> list[tuple[int, str, str]]:
    """(batch, path, name) of one source's renamed paths.

    events: (batch, old, new). A path is followed through the renames that come
    after its batch; a file that still carries a name that was given up counts
    as the new one. Paths that end as one are named by the first of them in the
    alphabet.
    """
    events = sorted(events)

    def end(path: str, batch: int) -> tuple[str, int]:
        for _ in range(2 * len(events) + 1):
            before = [e for e in events if e[0] <= batch and path in e[1:]]
            after = [e for e in events if e[0] > batch and path == e[1]]
            step = before[-1] if before and before[-1][1] == path else after[0] if after else None
            if step is None:
                break
            batch, path = step[0], step[2]
        # where a path is last known tells apart two lives of one name
        return path, max((e[0] for e in events if e[0] <= batch and path in e[1:]), default=-1)

    ends = {(b, p): end(p, b) for b in batches for p in sorted({x for e in events for x in e[1:]})}
    first: dict[tuple[str, int], str] = {}
    for (_, p), at in sorted(ends.items(), key=lambda x: x[0][1]):
        first.setdefault(at, p)
    return [(b, p, first[at]) for (b, p), at in ends.items()]


def _canonical(events: pd.DataFrame, batches: pd.DataFrame) -> pd.DataFrame:
    named = canonical_names(list(zip(events["batch"], events["path"], events["new_path"])), sorted(set(batches["batch"]))) if len(events) else []
    source = events["source"].iloc[0] if len(events) else None
    return pd.DataFrame([(source, *x) for x in named], columns=["source", "batch", "path", "name"])


_CANON = {"float": "double", "number": "double", "integer": "bigint", "logical": "boolean", "boolean": "boolean"}


def _stated(f: Column) -> Column:
    return F.coalesce(f["type"], F.lit("")) != UNDEFINED


def unit_files(hdus: DataFrame) -> DataFrame:
    """As header_files, of the units beyond the first: the source of unit k of a rig is `rig#k`."""
    later = hdus.filter(F.col("hdu") > 0)
    return header_files(later.withColumn("rig", F.concat_ws("#", "rig", "hdu")), hdu=None)


def unify(hdus: DataFrame, renames: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One consistent table: a row per header unit and document, a column per canonical path, whatever the file called it.

    rig, batch_no, file, frame_id, hdu, then three columns a path. hdus: every
    unit is a row. documents: as json_files gives them, with null frame_id and
    hdu. renames: source (`rig`, and `rig#k` for later units), batch, path,
    new_path; they hold for their source and batch only.

    The column has the type most files carry. Each other type that the path
    occurs in is a branch, a column `<column>__<type>` with the values of that
    type; in the column itself they are converted where they state its type.
    What can't be converted is in `<column>__other` as `type:text`. Of a path
    stated twice, by one name or several, the first counts and `<column>__more`
    holds the others as `path=type:text`. Headers listed twice count once.
    """
    once = hdus.dropDuplicates(["rig", "batch_no", "frame_id", "hdu"])
    cards = F.filter("cards", lambda c: c["keyword"].isNotNull() & (F.coalesce(c["value_type"], F.lit("")) != "commentary"))
    source = F.when(F.col("hdu") > 0, F.concat_ws("#", "rig", "hdu")).otherwise(F.col("rig"))
    field = lambda path, kind, text: F.struct(path.alias("path"), kind.alias("type"), text.alias("text"))
    fields = F.transform(cards, lambda c: field(c["keyword"], c["value_type"], c["value_text"]))
    rows = once.select("rig", F.col("batch_no").cast("int").alias("batch_no"), F.col("frame_id").cast("string").alias("file"), "frame_id", F.col("hdu").cast("int").alias("hdu"), source.alias("source"), fields.alias("fields"))
    if documents is not None:
        told = F.transform("fields", lambda f: field(f["path"], f["type"], f["text"]))
        rows = rows.unionByName(documents.select(F.col("source").alias("rig"), F.col("batch").cast("int").alias("batch_no"), "file", F.lit(None).cast("bigint").alias("frame_id"), F.lit(None).cast("int").alias("hdu"), "source", told.alias("fields")))
    events = renames.select("source", F.col("batch").cast("int").alias("batch"), "path", "new_path").distinct()
    batches = rows.select("source", F.col("batch_no").alias("batch")).distinct()
    names = events.groupBy("source").cogroup(batches.groupBy("source")).applyInPandas(_canonical, "source string, batch int, path string, name string")
    names = names.groupBy("source", F.col("batch").alias("batch_no")).agg(F.map_from_entries(F.collect_list(F.struct("path", "name"))).alias("names"))
    named = F.transform("fields", lambda f: F.struct(F.coalesce(F.try_element_at(F.col("names"), f["path"]), f["path"]).alias("name"), f["path"].alias("path"), f["type"].alias("type"), f["text"].alias("text")))
    rows = cut(rows.join(names, ["source", "batch_no"], "left").withColumn("fields", F.when(F.col("names").isNull(), F.transform("fields", lambda f: F.struct(f["path"].alias("name"), f["path"].alias("path"), f["type"].alias("type"), f["text"].alias("text")))).otherwise(named)).drop("names"))

    keys = ["rig", "batch_no", "file", "frame_id", "hdu"]
    stated = rows.select(F.struct(*keys).alias("entity"), F.posexplode(F.filter("fields", _stated)).alias("pos", "f")).select("entity", "pos", "f.*")
    tally = rows.select(F.explode("fields").alias("f")).groupBy("f.name", "f.type").count().collect()
    weight: dict[str, dict[str, int]] = {}
    for r in tally:
        own = weight.setdefault(r["name"], {})
        if r["type"] not in (UNDEFINED, "unparsed", None):
            kind = _CANON.get(r["type"], "string")
            own[kind] = own.get(kind, 0) + r["count"]
    # one row a path and header, then one conditional aggregation a path
    told = lambda f: F.concat(f["path"], F.lit("="), F.coalesce(f["type"], F.lit("")), F.lit(":"), F.coalesce(f["text"], F.lit("")))
    cells = stated.groupBy("entity", F.col("name").alias("field")).agg(F.array_sort(F.collect_list(F.struct("pos", "path", "type", "text"))).alias("all"))
    cells = cells.select("entity", "field", F.struct(F.col("all")[0]["type"].alias("type"), F.col("all")[0]["text"].alias("text"), F.when(F.size("all") > 1, F.transform(F.slice("all", F.lit(2), F.size("all")), told)).alias("more")).alias("cell"))
    columns, labels = [], set()
    for path, kinds in sorted(weight.items()):
        kind = max(sorted((kinds or {"string": 1}).items()), key=lambda x: x[1])[0]
        cell = F.col(f"wide.`{path}`")
        text, tag = cell["text"], cell["type"]
        as_kind = {"double": values.number(text), "bigint": values.whole(text), "boolean": values.logical(text), "string": values.bare(text)}
        label = "".join(ch.lower() if ch.isalnum() else "_" for ch in path)
        while label in labels | set(keys):
            label += "_"
        labels.add(label)
        of_kind = lambda k: tag.isin([t for t, c in _CANON.items() if c == k]) if k != "string" else ~tag.isin(list(_CANON))  # noqa: B023, E731
        columns.append(as_kind[kind].alias(label))
        columns += [F.when(of_kind(k), as_kind[k]).alias(f"{label}__{k}") for k in sorted(kinds) if k != kind]
        columns += [F.when(as_kind[kind].isNull() & text.isNotNull(), F.concat(F.coalesce(tag, F.lit("")), F.lit(":"), text)).alias(f"{label}__other"), cell["more"].alias(f"{label}__more")]
    wide = cells.groupBy("entity").agg(*[F.first(F.when(F.col("field") == path, F.col("cell")), ignorenulls=True).alias(path) for path in sorted(weight)])
    # a header without a stated card is a row too
    empty = rows.filter(~F.exists("fields", _stated)).select(F.struct(*keys).alias("entity"))
    wide = wide.unionByName(empty, allowMissingColumns=True).alias("wide")
    return wide.select(*[F.col("wide.entity")[k].alias(k) for k in keys], *columns)

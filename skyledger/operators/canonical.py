"""Canonical facts of files: what each header means, whatever program wrote it.

A file's header becomes one map of keyword to first value. Facts are native
expressions over it: each has its keywords in order, standard ones first, then
those of the rules that hold for the file; a keyword that doesn't state the
fact is passed over. What the header lacks comes from the file name or the
scope's profile. Every fact keeps its source.

Rules (which program or scope wrote a file, and how it is to be read) are data,
as many as there are programs. Matching them is a join on the keyword; reading
by them is folded into the expressions.

Scale: one aggregation per file, whose size is that of a header; all else is
projection.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import filename, text, values
from skyledger.session import cut, if_small

# The facts with their kind and the standard keywords that state them, the most authoritative first.
FACTS = {
    "object": ("string", ["OBJECT", "OBJNAME"]), "telescope": ("string", ["TELESCOP"]), "focal_mm": ("positive", ["FOCALLEN", "FOCAL"]), "aperture_mm": ("positive", ["APTDIA", "APERTURE"]),
    "focal_ratio": ("positive", ["FOCRATIO"]), "camera": ("string", ["INSTRUME"]), "pixel_um": ("positive", ["XPIXSZ", "PIXSIZE1", "PIXSZ"]), "binning": ("whole", ["XBINNING", "CCDXBIN", "BINNING"]),
    "gain": ("number", ["GAIN"]), "offset": ("number", ["OFFSET", "BLKLEVEL"]), "egain": ("positive", ["EGAIN"]), "sensor_temp_c": ("number", ["CCD-TEMP", "CCD_TEMP", "SENSTEMP", "TEMPERAT"]),
    "set_temp_c": ("number", ["SET-TEMP", "SET_TEMP"]), "bayer": ("string", ["BAYERPAT", "COLORTYP"]), "row_order": ("string", ["ROWORDER"]), "filter": ("string", ["FILTER", "FILTNAME"]),
    "frame_type": ("string", ["IMAGETYP", "FRAMETYP", "FRAME"]), "exposure_s": ("number", ["EXPTIME", "EXPOSURE", "EXP_TIME"]), "stack_count": ("whole", ["STACKCNT", "NCOMBINE", "NSTACK"]),
    "total_integration_s": ("positive", ["LIVETIME", "TOTALEXP"]), "date_obs": ("string", ["DATE-OBS", "DATE-BEG"]), "date_local": ("string", ["DATE-LOC"]), "site_lat": ("number", ["SITELAT", "OBSLAT", "LAT-OBS"]),
    "site_lon": ("number", ["SITELONG", "OBSLONG", "LONG-OBS"]), "site_elev_m": ("number", ["SITEELEV", "OBSGEO-H", "ALT-OBS", "OBSALT"]), "mount": ("string", ["MOUNT"]), "pier_side": ("string", ["PIERSIDE"]),
    "focus_pos": ("whole", ["FOCPOS", "FOCUSPOS"]), "focus_temp_c": ("number", ["FOCTEMP", "FOCUSTEM"]),
}
# How much a keyword says about the hardware; others weigh 2.
WEIGHTS = {"INSTRUME": 4, "CREATOR": 3, "TELESCOP": 1}


@dataclass(frozen=True)
class Rule:
    """How the headers of some files are to be read. target: `*` (all), `app:<id>`, or a pattern of scope ids.

    keys: facts to further keywords. ignore, serial: keywords to reasons.
    scale: keyword to factor. aliases: keyword to texts and what they mean.
    mount_in: keyword to patterns of mounts. exptime_total: always, or
    stacked_file. history_count: beginnings of history lines that end in a
    number of frames.
    """

    target: str = "*"
    keys: dict[str, list[str]] = field(default_factory=dict)
    ignore: dict[str, str] = field(default_factory=dict)
    serial: dict[str, str] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    mount_in: dict[str, list[str]] = field(default_factory=dict)
    row_order: str | None = None
    exptime_total: str | None = None
    history_count: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()


def dictionary_rule(dictionary: DataFrame) -> Rule:
    """One rule for all files from keyword, field, unit_factor; fields that are no facts are left out. As many rows as the dictionary."""
    names = {"filter_name": "filter", "offset_adu": "offset"}
    rows = [(names.get(r["field"], r["field"]), r["keyword"], r["unit_factor"]) for r in dictionary.orderBy("field", "keyword").collect()]
    keys: dict[str, list[str]] = {}
    for name, keyword, _ in rows:
        if name in FACTS:
            keys.setdefault(name, []).append(keyword)
    return Rule(keys=keys, scale={k: f for n, k, f in rows if n in FACTS and f not in (None, 1.0)})


# ---- headers as maps

def headers_of(cards: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """frame_id, vals (keyword to value_type, value_text, said, num), history, comments of each file.

    cards: frame_id, hdu, record, keyword, value_type, value_text. The image's
    unit goes before the primary one; of a keyword given twice the first
    counts. The image's unit is the first of `units` (frame_id, hdu, shape)
    with a shape, else the first unit.
    """
    df = cards.filter(F.col("keyword").isNotNull())
    if units is not None:
        image = units.filter(F.size("shape") > 0).groupBy("frame_id").agg(F.min("hdu").alias("_image"))
        df = df.join(image, "frame_id", "left").withColumn("_later", F.col("hdu") != F.coalesce("_image", F.lit(0)))
    else:
        df = df.withColumn("_later", F.lit(False))
    remark = F.coalesce(F.col("value_type"), F.lit("")) == "commentary"
    at = F.struct("_later", "hdu", "record")
    first = df.filter(~remark & ((F.col("hdu") == 0) | ~F.col("_later"))).groupBy("frame_id", "keyword").agg(F.min_by(F.struct("value_type", F.coalesce("value_text", F.lit("")).alias("value_text")), at).alias("v"))
    # each value is read once, here
    said = F.when(F.coalesce("v.value_type", F.lit("")) != "undefined", values.bare(F.col("v.value_text")))
    first = first.select("frame_id", "keyword", F.struct("v.value_type", "v.value_text", said.alias("said"), values.number(said).alias("num")).alias("v"))
    vals = first.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("keyword", "v"))).alias("vals"))
    lines = lambda key: F.transform(F.array_sort(F.collect_set(F.when(F.col("keyword") == key, F.struct("_later", "hdu", "record", F.trim(F.coalesce("value_text", F.lit(""))).alias("line"))))), lambda x: x["line"])
    told = df.filter(remark & F.col("keyword").isin("HISTORY", "COMMENT")).groupBy("frame_id").agg(lines("HISTORY").alias("history"), lines("COMMENT").alias("comments"))
    empty = F.array().cast("array<string>")
    both = vals.join(told, "frame_id", "full_outer")
    return both.select("frame_id", F.coalesce("vals", F.create_map().cast("map<string,struct<value_type:string,value_text:string,said:string,num:double>>")).alias("vals"), F.coalesce("history", empty).alias("history"), F.coalesce("comments", empty).alias("comments"))


# ---- rules that match

def app_rules(rules: DataFrame, revision: str = "revision", app: str = "app_id", rule: str = "rule") -> DataFrame:
    """id, name, role, place, how, key, pattern of the newest rule of each program: what its headers look like. As many rows as there are programs.

    how: match (the value of `key` fits the pattern), present (`key` is there),
    comment or history (a line holds the text). Patterns may be listed or
    separated by |.
    """
    newest = rules.groupBy(app).agg(F.max_by(rule, revision).alias("rule"))
    out = []
    listed = lambda v: [p for x in (v if isinstance(v, list) else [v]) for p in str(x).split("|")] if v else []
    for place, row in enumerate(newest.orderBy(app).collect()):
        r = json.loads(row["rule"])
        own = (row[app], r.get("name"), r.get("role"), place)
        out += [(*own, "match", k, p) for k, ps in (r.get("match") or {}).items() for p in listed(ps)]
        out += [(*own, "present", k, "*") for k in listed(r.get("present"))]
        out += [(*own, how, how.upper(), p) for how in ("comment", "history") for p in listed(r.get(how))]
    return rules.sparkSession.createDataFrame(out, "id string, name string, role string, place int, how string, key string, pattern string")


def matched(heads: DataFrame, rules: DataFrame) -> DataFrame:
    """frame_id, id, name, role, place, evidence, weight of every rule set that a file's header fits.

    An equi-join on the keyword; patterns are tested on the pairs. evidence
    lists what fitted, sorted; weight is that of the keywords (WEIGHTS).
    """
    stated = heads.select("frame_id", F.explode("vals").alias("key", "v")).select("frame_id", "key", F.trim("v.value_text").alias("said"))
    lines = heads.select("frame_id", F.explode(F.concat(F.transform("history", lambda x: F.struct(F.lit("HISTORY").alias("key"), x.alias("said"))), F.transform("comments", lambda x: F.struct(F.lit("COMMENT").alias("key"), x.alias("said"))))).alias("x")).select("frame_id", "x.*")
    said, pattern, how = F.col("said"), F.col("pattern"), F.col("how")
    small = if_small(cut(rules))
    held = F.lower(said).contains(F.trim(F.replace(F.lower(pattern), F.lit("*"), F.lit(""))))
    fits = F.when(how == "present", True).otherwise(text.matches(pattern, said))
    met = stated.join(small.filter(how.isin("match", "present")), "key").filter(fits).unionByName(lines.join(small.filter(how.isin("comment", "history")), "key").filter(held))
    short = F.when(how == "present", F.concat("key", F.lit(" present"))).when(how == "match", F.concat("key", F.lit("="), said)).otherwise(F.concat("key", F.lit(" '"), F.substring(F.lower(said), 1, 48), F.lit("'")))
    weight = F.lit(2)
    for k, w in WEIGHTS.items():
        weight = F.when(F.col("key") == k, w).otherwise(weight)
    found = met.groupBy("frame_id", "id", "name", "role", "place").agg(F.array_sort(F.collect_set(short)).alias("evidence"), F.collect_set(F.struct("key", weight.alias("w"))).alias("_keys"))
    return found.withColumn("weight", F.aggregate("_keys", F.lit(0), lambda a, x: a + x["w"])).drop("_keys")


def software(apps: DataFrame) -> DataFrame:
    """frame_id, software, tags: the programs of each file, capturing ones first, then in the order of the rules."""
    rank = F.struct((F.coalesce("role", F.lit("")) != "capture").alias("later"), "place", "id", "name", "role")
    g = apps.groupBy("frame_id").agg(F.array_sort(F.collect_set(rank)).alias("x"))
    return g.select("frame_id", F.transform("x", lambda a: F.struct(a["id"].alias("id"), a["name"].alias("name"), a["role"].alias("role"))).alias("software"), F.transform("x", lambda a: F.concat(F.lit("app:"), a["id"])).alias("tags"))


def scope(scopes: DataFrame) -> DataFrame:
    """frame_id, scope, scope_name, conflict: the scope with the most weight of evidence, ties by place; conflict names the second, if there is one."""
    w = Window.partitionBy("frame_id").orderBy(F.desc("weight"), "place", "id")
    ranked = scopes.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    of = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    return ranked.groupBy("frame_id").agg(of(1, "id").alias("scope"), of(1, "name").alias("scope_name"), of(2, "id").alias("conflict"))


# ---- facts

def _fact(value: Column, source: Column | str) -> Column:
    return F.struct(value.alias("value"), (F.lit(source) if isinstance(source, str) else source).alias("source"))


def _stated(value: Column, source: str) -> Column:
    return text.once(value, lambda v: F.when(v.isNotNull(), _fact(v, source)))


class _Reader:
    """Expressions over vals, tags (what rules hold for a file) and scope."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def holds(self, rule: Rule) -> Column:
        if rule.target == "*":
            return F.lit(True)
        if rule.target.startswith("app:"):
            return F.array_contains("tags", rule.target)
        return F.coalesce(text.matches(F.lit(rule.target), F.col("scope")), F.lit(False))

    def raw(self, key: str, part: str = "said") -> Column:
        """A keyword's text (or, as `num`, its number), unless it is to be ignored or is undefined."""
        v = F.try_element_at("vals", F.lit(key))[part]
        for rule in self.rules:
            if key in rule.ignore:
                v = F.when(~self.holds(rule), v)
        return v

    def keys(self, name: str) -> list[tuple[str, Column | None]]:
        """A fact's keywords with the condition under which each counts."""
        out: list[tuple[str, Column | None]] = [(k, None) for k in FACTS.get(name, (None, []))[1]]
        for rule in self.rules:
            out += [(k, self.holds(rule)) for k in rule.keys.get(name, []) if k not in [x for x, _ in out]]
        return out

    def _pick(self, name: str, read, kind: str) -> Column:
        tried = []
        for key, condition in self.keys(name):
            value = read(key)
            ok = value.isNotNull() if condition is None else condition & value.isNotNull()
            tried.append(F.when(ok, _fact(value, key)))
        return F.coalesce(*tried) if tried else F.lit(None).cast(f"struct<value:{kind},source:string>")

    def string(self, name: str) -> Column:
        def read(key: str) -> Column:
            out = F.nullif(F.trim(self.raw(key)), F.lit(""))
            for rule in self.rules:
                for told, meant in rule.aliases.get(key, {}).items():
                    out = F.when(self.holds(rule) & (F.lower(out) == told.lower()), F.lit(meant)).otherwise(out)
            return out

        return self._pick(name, read, "string")

    def number(self, name: str, positive: bool = False, parse=None) -> Column:
        def read(key: str) -> Column:
            v = self.raw(key, "num") if parse is None else parse(self.raw(key))
            factor = F.lit(1.0)
            for rule in reversed(self.rules):
                if key in rule.scale:
                    factor = F.when(self.holds(rule), rule.scale[key]).otherwise(factor)
            v = v * factor if any(key in rule.scale for rule in self.rules) else v
            return F.when(v > 0, v) if positive else v

        return self._pick(name, read, "double")

    def whole(self, name: str) -> Column:
        v = self.number(name, positive=True)
        return F.when(v.isNotNull(), _fact(F.round(v["value"]).cast("bigint"), v["source"]))

    def fact(self, name: str) -> Column:
        kind = FACTS[name][0]
        return self.string(name) if kind == "string" else self.whole(name) if kind == "whole" else self.number(name, kind == "positive")


def _position(r: _Reader, keys: tuple[str, str], axis: str, n: int, parse, low: float, high: float, name: str) -> Column:
    """Degrees as a number, as text in either keyword, from the plate solution, or in a keyword of the rules."""
    within = lambda v: F.when((v >= low) & (v <= high if axis == "DEC" else v < high), v)
    tried = [(within(values.plain_number(r.raw(keys[0]))), keys[0]), (parse(r.raw(keys[0])), keys[0]), (parse(r.raw(keys[1])), keys[1])]
    solved = F.when(F.trim(r.raw(f"CTYPE{n}")).startswith(axis), r.raw(f"CRVAL{n}", "num"))
    tried.append((solved, f"CRVAL{n}"))
    own = r.number(name)
    return F.coalesce(*[_stated(v, k) for v, k in tried], F.when(within(own["value"]).isNotNull(), own))


def _with_date(df: DataFrame, r: _Reader) -> DataFrame:
    """Adds date_obs: as written; where it has no time of day and another keyword has, or it isn't written so, as YYYY-MM-DDTHH:MM:SS.mmm.

    Each step is a projection, so that nothing is worked out twice.
    """
    c, clock = F.col, r"^\s*(\d{1,2}):(\d{1,2})(?::(\d+(?:\.\d*)?))?\s*$"
    df = df.withColumn("_d", r.string("date_obs"))
    tod = F.coalesce(*[F.when(r.raw(k).rlike(clock), F.struct(F.lit(k).alias("k"), r.raw(k).alias("v"))) for k in ("TIME-OBS", "UT", "UTSTART", "UT-START")])
    df = df.withColumns({"_p": text_datetime(c("_d.value")), "_tod": F.when(~c("_d.value").rlike("[T :]"), tod)})
    part = lambda k, kind: F.nullif(F.regexp_extract("_tod.v", clock, k), F.lit("")).try_cast(kind)
    timed = c("_tod").isNotNull()
    df = df.withColumns({"_hh": F.when(timed, part(1, "int")).otherwise(c("_p.hour")), "_mm": F.when(timed, part(2, "int")).otherwise(c("_p.minute")), "_ss": F.when(timed, F.coalesce(part(3, "double"), F.lit(0.0))).otherwise(c("_p.second"))})
    two = lambda n: F.lpad(c(n).cast("string"), 2, "0")
    iso = F.concat(F.lpad(c("_p.year").cast("string"), 4, "0"), F.lit("-"), two("_p.month"), F.lit("-"), two("_p.day"), F.lit("T"), two("_hh"), F.lit(":"), two("_mm"), F.lit(":"), F.lpad(F.format_string("%.3f", F.round("_ss", 3)), 6, "0"))
    df = df.withColumn("_iso", iso)
    kept = c("_p").isNull() | (c("_iso").startswith(c("_d.value")) & ~timed)
    source = F.concat(F.lit("derived:"), c("_d.source"), F.coalesce(F.concat(F.lit(","), c("_tod.k")), F.lit("")))
    return df.withColumn("date_obs", F.when(kept, c("_d")).when(c("_d").isNotNull(), _fact(c("_iso"), source))).drop("_d", "_p", "_tod", "_hh", "_mm", "_ss", "_iso")


def text_datetime(s: Column) -> Column:
    """year, month, day, hour, minute, second of YYYY-MM-DD with or without a time, YYYY/MM/DD, or DD/MM/YY of the 1900s; null for others. A 60th second is one."""
    t = F.regexp_replace(F.trim(s), "Z+$", "")
    slash, dash = r"^\s*(\d+)\s*/\s*(\d+)\s*/\s*(\d+)\s*$", r"^(\d+)-(\d+)-(\d+)(?:[T ](\d+)(?::(\d+)(?::(\d+(?:\.\d*)?|\.\d+))?)?)?$"
    g = lambda pattern, k: F.regexp_extract(t, pattern, k)
    n = lambda pattern, k: g(pattern, k).try_cast("int")
    long = F.length(g(slash, 1)) == 4
    zero = lambda k: F.coalesce(F.nullif(g(dash, k), F.lit("")).try_cast("int"), F.lit(0))
    pack = lambda y, m, d, h, mi, sec: F.struct(y.alias("year"), m.alias("month"), d.alias("day"), h.alias("hour"), mi.alias("minute"), sec.alias("second"))
    slashed = pack(F.when(long, n(slash, 1)).otherwise(1900 + n(slash, 3)), n(slash, 2), F.when(long, n(slash, 3)).otherwise(n(slash, 1)), F.lit(0), F.lit(0), F.lit(0.0))
    dashed = pack(n(dash, 1), n(dash, 2), n(dash, 3), zero(4), zero(5), F.coalesce(F.nullif(g(dash, 6), F.lit("")).try_cast("double"), F.lit(0.0)))
    out = F.when(t.rlike(slash), slashed).when(t.rlike(dash), dashed)
    return text.once(out, lambda p: F.when(p["month"].between(1, 12) & p["day"].between(1, 31) & (p["hour"] < 24) & (p["minute"] < 60) & (p["second"] < 61), p))


def facts(files: DataFrame, heads: DataFrame, rules: list[Rule] = (), apps: DataFrame | None = None, scopes: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """frame_id, a column <fact> (value, source) for each of FACTS and ra, dec, sensor, then serials, ignored, software, scope, conflict, notes of every file.

    files: frame_id, name, and planes (of the image) where known. heads: as
    `headers_of` gives it; apps, scopes: as `matched` gives it; profiles: id,
    focal_mm, aperture_mm, pixel_um, sensor of scopes. A file without a header
    has the facts of its name. source is a keyword, filename, model:<scope>,
    or derived:<what from>. Text where a number is asked for states nothing.
    """
    r, c = _Reader(list(rules)), F.col
    empty = F.array().cast("array<string>")
    df = files.select("frame_id", "name", (c("planes") if "planes" in files.columns else F.lit(None)).cast("int").alias("planes")).dropDuplicates(["frame_id"]).join(heads, "frame_id", "left")
    df = df.join(software(apps), "frame_id", "left") if apps is not None else df.withColumns({"software": F.array().cast("array<struct<id:string,name:string,role:string>>"), "tags": empty})
    df = df.join(scope(scopes), "frame_id", "left") if scopes is not None else df.withColumns({k: F.lit(None).cast("string") for k in ("scope", "scope_name", "conflict")})
    if profiles is not None:
        df = df.join(profiles.select(c("id").alias("scope"), *[c(k).alias(f"_p_{k}") for k in ("focal_mm", "aperture_mm", "pixel_um", "sensor")]).dropDuplicates(["scope"]), "scope", "left")
    else:
        df = df.withColumns({f"_p_{k}": F.lit(None).cast("string" if k == "sensor" else "double") for k in ("focal_mm", "aperture_mm", "pixel_um", "sensor")})
    df = df.withColumns({"tags": F.coalesce("tags", empty), "history": F.coalesce("history", empty), "_name": filename.facts(c("name"))})
    there = lambda key: F.try_element_at("vals", F.lit(key)).isNotNull()
    model = F.concat(F.lit("model:"), F.coalesce("scope_name", F.lit("program")))

    # serial numbers and mounts decide what TELESCOP means
    serials = F.array_compact(F.array(*[F.when(r.holds(q) & there(k), F.struct(F.lit(k).alias("key"), F.trim(r.raw(k)).alias("value"))) for q in rules for k in q.serial])) if any(q.serial for q in rules) else F.array().cast("array<struct<key:string,value:string>>")
    ignored = F.array_compact(F.array(*[F.when(r.holds(q) & there(k), F.lit(k)) for q in rules for k in q.ignore])) if any(q.ignore for q in rules) else empty
    mounts = [(k, r.holds(q) & F.coalesce(F.greatest(*[text.matches(F.lit(p), r.raw(k)) for p in [*ps, ps[0]]]), F.lit(False))) for q in rules for k, ps in q.mount_in.items()]
    mount = F.coalesce(*[F.when(ok, _fact(F.trim(r.raw(k)), k)) for k, ok in mounts], r.string("mount")) if mounts else r.string("mount")
    no_scope = F.lit(False)
    for k, ok in mounts:
        no_scope = (no_scope | ok) if k == "TELESCOP" else no_scope
    df = df.withColumns({"serials": serials, "ignored": ignored, "mount": mount})
    no_scope = no_scope | F.exists("serials", lambda s: s["key"] == "TELESCOP")
    by_name = lambda part: F.when(c(f"_name.{part}").isNotNull(), _fact(c(f"_name.{part}"), "filename"))
    by_name_float = lambda part: F.when(c(f"_name.{part}").isNotNull(), _fact(c(f"_name.{part}").cast("double"), "filename"))
    by_model = lambda part: F.when(c(f"_p_{part}").isNotNull(), _fact(c(f"_p_{part}"), model))
    counted = F.lit(None)
    for q in reversed(rules):
        for begin in reversed(q.history_count):
            line = F.get(_lines_that_begin(begin), F.lit(0))
            n = F.regexp_extract(F.trim(F.substr(line, F.lit(len(begin) + 1))), r"^(\d+)", 1).try_cast("bigint")
            counted = F.coalesce(F.when(r.holds(q) & n.isNotNull(), _fact(n, f"HISTORY {begin}")), counted)
    order = F.lit(None)
    for q in reversed(rules):
        if q.row_order:
            order = F.when(r.holds(q), _fact(F.lit(q.row_order), model)).otherwise(order)
    plain = [n for n in FACTS if n not in ("telescope", "focal_mm", "aperture_mm", "pixel_um", "focal_ratio", "binning", "gain", "sensor_temp_c", "row_order", "filter", "frame_type", "exposure_s", "stack_count", "date_obs", "site_lat", "site_lon", "mount")]
    df = df.withColumns({
        **{n: r.fact(n) for n in plain},
        "telescope": F.coalesce(F.when(~no_scope, r.string("telescope")), F.when(c("scope_name").isNotNull(), _fact(c("scope_name"), model))),
        **{f"_h_{n}": r.fact(n) for n in ("focal_mm", "aperture_mm", "pixel_um")}, "sensor": by_model("sensor"),
        "binning": F.coalesce(r.fact("binning"), by_name("binning")), "gain": F.coalesce(r.fact("gain"), by_name_float("gain")), "sensor_temp_c": F.coalesce(r.fact("sensor_temp_c"), by_name("temp_c")),
        "row_order": F.coalesce(r.fact("row_order"), order), "filter": F.coalesce(r.fact("filter"), by_name("filter_name")), "frame_type": F.coalesce(r.fact("frame_type"), by_name("prefix")),
        "exposure_s": F.coalesce(r.fact("exposure_s"), by_name("exposure_s")), "stack_count": F.coalesce(r.fact("stack_count"), counted, by_name("frames")),
        "ra": _position(r, ("RA", "OBJCTRA"), "RA", 1, text.parse_ra, 0.0, 360.0, "ra"), "dec": _position(r, ("DEC", "OBJCTDEC"), "DEC", 2, text.parse_dec, -90.0, 90.0, "dec"),
        "site_lat": F.coalesce(r.fact("site_lat"), r.number("site_lat", parse=text.parse_dec)), "site_lon": F.coalesce(r.fact("site_lon"), r.number("site_lon", parse=text.parse_lon)),
    })
    df = _with_date(df, r)
    for n in ("focal_mm", "aperture_mm", "pixel_um"):
        df = df.withColumn(n, F.coalesce(f"_h_{n}", by_model(n)))
    ratio = F.when(c("focal_mm").isNotNull() & c("aperture_mm").isNotNull(), _fact(c("focal_mm.value") / c("aperture_mm.value"), "derived:focal length,aperture"))
    rgb = F.coalesce(c("planes") == 3, F.lit(False))
    debayered = F.when(rgb & c("bayer").isNotNull(), F.concat("bayer.source", F.lit(" ignored: the image is RGB already")))
    df = df.withColumns({"focal_ratio": F.coalesce(r.fact("focal_ratio"), ratio), "_debayered": debayered, "bayer": F.when(~rgb, c("bayer"))})
    df, totals = _totals(df, r)
    differ = [F.when(F.abs(c(f"_h_{n}.value") - c(f"_p_{n}")) / c(f"_p_{n}") > 0.05, F.concat(c(f"_h_{n}.source"), F.lit(" differs from the profile"))) for n in ("focal_mm", "aperture_mm", "pixel_um")]
    lacks = F.when(c("_h_focal_mm").isNull() & c("_p_focal_mm").isNotNull() & there("FOCALLEN"), F.lit("FOCALLEN is no length; the profile's is used"))
    scaled = [F.when(r.holds(q) & there(k), F.lit(f"{k} x {f}")) for q in rules for k, f in q.scale.items()]
    told = [F.when(r.holds(q), F.lit(n)) for q in rules for n in q.notes]
    clash = F.when(c("conflict").isNotNull(), F.concat(F.lit("the header fits two scopes: "), "scope", F.lit(", "), "conflict"))
    notes = F.array_compact(F.array(*scaled, *told, clash, lacks, *differ, c("_debayered"), *totals))
    return df.select("frame_id", *FACTS, "ra", "dec", "sensor", "serials", "ignored", "software", "scope", "conflict", notes.alias("notes"))


def _lines_that_begin(begin: str) -> Column:
    return F.filter("history", lambda x: x.startswith(begin))


def _totals(df: DataFrame, r: _Reader) -> tuple[DataFrame, list[Column]]:
    """Exposure, count and total where a program writes the total as the exposure, or the three contradict each other; and the notes of it."""
    c = F.col
    stacked = F.coalesce(c("_name.prefix").isin("stacked", "dso_stacked", "result", "integration"), F.lit(False))
    is_total = F.lit(False)
    for q in r.rules:
        if q.exptime_total:
            is_total = is_total | (r.holds(q) & (F.lit(True) if q.exptime_total == "always" else stacked))
    as_total = is_total & c("exposure_s.source").isin("EXPTIME", "EXPOSURE")
    e, n, sub = c("exposure_s"), c("stack_count"), c("_name.exposure_s")
    per_sub = [F.when(r.holds(q) & r.raw(k, "num").isNotNull(), _fact(r.raw(k, "num"), k)) for q in r.rules if q.exptime_total for k in q.keys.get("exposure_s", [])]
    one = F.coalesce(*per_sub, F.when(sub.isNotNull(), _fact(sub, "filename")), F.when(n["value"] > 1, _fact(e["value"] / n["value"], "derived:EXPTIME,stack count")))
    df = df.withColumns({"_as_total": F.coalesce(as_total, F.lit(False)), "_e": e})
    df = df.withColumn("exposure_s", F.when(c("_as_total"), one).otherwise(e))
    times = F.round(c("_e.value") / c("exposure_s.value"))
    fits = c("_as_total") & n.isNull() & (c("exposure_s.value") > 0) & (times >= 2) & (F.abs(times * c("exposure_s.value") - c("_e.value")) <= 0.01 * c("_e.value"))
    df = df.withColumns({"stack_count": F.when(F.coalesce(fits, F.lit(False)), _fact(times.cast("bigint"), "derived:EXPTIME,sub exposure")).otherwise(n), "total_integration_s": F.when(c("_as_total"), F.coalesce("total_integration_s", "_e")).otherwise(c("total_integration_s"))})
    # the total in EXPTIME, told by the file name
    keyed = ~c("exposure_s.source").startswith("derived:") & (c("exposure_s.source") != "filename")
    total = c("stack_count.value") * sub
    implied = F.coalesce((c("stack_count.value") > 1) & keyed & (sub > 0) & (F.abs(c("exposure_s.value") - total) <= 0.01 * total), F.lit(False))
    df = df.withColumn("_implied", implied).withColumn("total_integration_s", F.when(c("_implied"), F.coalesce("total_integration_s", "exposure_s")).otherwise(c("total_integration_s")))
    df = df.withColumn("exposure_s", F.when(c("_implied"), _fact(sub, "filename")).otherwise(c("exposure_s")))
    expected = c("stack_count.value") * c("exposure_s.value")
    against = F.coalesce((c("stack_count.value") > 1) & (c("total_integration_s.value") < 0.5 * expected), F.lit(False))
    df = df.withColumn("_against", F.when(against, F.concat(c("total_integration_s.source"), F.lit(" contradicts the stack count and exposure"))))
    kept = F.when(~against, c("total_integration_s"))
    df = df.withColumn("total_integration_s", F.coalesce(kept, F.when(c("stack_count.value") > 1, _fact(expected, "derived:stack count,exposure"))))
    return df, [F.when(c("_as_total"), F.concat(c("_e.source"), F.lit(" is the total integration"))), F.when(c("_implied"), F.lit("the exposure is the total integration, as the file name tells")), c("_against")]


def entries(canonical: DataFrame, files: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The listing of files: what folder questions are asked of. files: frame_id, path, name, bytes, size; verdicts: as `classify.verdicts` gives it."""
    c = F.col
    of = {"exposure_s": "exposure_s", "stack_count": "stack_count", "filter": "filter_name", "object": "object", "date_obs": "date_obs", "gain": "gain", "focal_mm": "focal_mm", "sensor_temp_c": "sensor_temp_c", "set_temp_c": "set_temp_c", "binning": "binning", "offset": "offset_adu", "camera": "camera"}
    df = files.join(canonical.select("frame_id", *[c(f"{k}.value").alias(v) for k, v in of.items()], c("pixel_um.value").alias("_um"), c("site_lon.value").alias("_lon")), "frame_id", "left")
    scale = F.when((c("_um") > 0) & (c("focal_mm") > 0), F.round(206.264806 * c("_um") / c("focal_mm"), 3))
    p = text_datetime(c("date_obs"))
    jd = F.unix_date(F.try_to_date(F.concat_ws("-", p["year"].cast("string"), p["month"].cast("string"), p["day"].cast("string")), "y-M-d")) + (p["hour"] * 3600 + p["minute"] * 60 + p["second"]) / 86400.0
    night = F.date_from_unix_date(F.floor(jd + F.coalesce("_lon", F.lit(0.0)) / 360.0 - 0.5).cast("int")).cast("string")
    df = df.withColumns({"pixel_scale": scale, "night": night}).drop("_um", "_lon")
    return df if verdicts is None else df.join(verdicts.select("frame_id", "label", c("kind").alias("frame"), "integrated"), "frame_id", "left")

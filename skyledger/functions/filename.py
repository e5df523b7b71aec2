"""Facts from file names, and file names from facts, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a file name can begin with, before a separator, in the order they are tried.
PREFIXES = [
    "dso_stacked", "stacked", "masterlight", "masterdark", "masterflat", "masterbias", "master", "r_pp", "pp",
    "bkg", "result", "light", "dark", "flat", "bias", "darkflat", "offset", "integration",
]


def stem(name: Column) -> Column:
    """The name without folder and without extensions of up to four letters."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(\.[A-Za-z]{1,4})+$", "")


def prefix(name: Column) -> Column:
    # alternatives are tried in order, as the words are
    found = F.regexp_extract(F.lower(stem(name)), "^(" + "|".join(PREFIXES) + ")[_ -]", 1)
    return F.when(found != "", found)


def _token(name: Column, pattern: str) -> Column:
    found = F.regexp_extract(stem(name), r"(?i)(?:^|[_ ])" + pattern + r"(?=$|[_ ])", 1)
    return F.when(found != "", found)


def exposure(name: Column) -> Column:
    """Seconds of the first exposure token: 20.0s, 60s60, 608.3ms or 460x10s."""
    t = F.regexp_extract(stem(name), r"(?i)(?:^|[_ ])(?:\d+x)?([\d.]+(?:ms|s))\d*(?=$|[_ ])", 1)
    n = F.regexp_extract(t, r"([\d.]+)", 1).try_cast("double")
    return F.when(F.lower(t).endswith("ms"), n / 1000).otherwise(n)


def binning(name: Column) -> Column:
    return _token(name, r"bin(\d+)").try_cast("bigint")


def gain(name: Column) -> Column:
    return F.coalesce(_token(name, r"gain(\d+(?:\.\d+)?)"), _token(name, r"[\d.]+s(\d+)")).try_cast("double")


# Filter names that may follow an exposure token.
FILTERS = ["LP", "IRCUT", "UVIR", "L", "R", "G", "B", "Ha", "OIII", "SII", "HO", "SHO", "Duo", "Dual"]
_N = r"([\d.-]+)"


def facts(name: Column) -> Column:
    """prefix, exposure_s, gain, binning, temp_c, frames, filter_name that a file name states.

    Tokens are apart by _ and blanks: 20.0s, 608.3ms, 60s60 (60 s at gain 60),
    460x10s (460 frames of 10 s), gain100, Bin1, -14.9C. Of exposures the first
    counts, of gain, bin and temperature tokens the last. A filter follows the
    exposure. After a prefix of stacks the next number is the frames.
    """
    tokens = F.filter(F.split(stem(name), "[_ ]"), lambda t: t != "")
    # each token in small letters and the one after it
    paired = lambda ts: F.transform(ts, lambda t, i: F.struct(F.lower(t).alias("t"), F.get(ts, i + 1).alias("next")))
    get = lambda t, pattern, k: F.regexp_extract(t, pattern, k)
    num = lambda t, pattern, k=1: get(t, pattern, k).try_cast("double")
    dwarf, plain, milli, times = rf"^{_N}s(\d+)$", rf"^{_N}s$", rf"^{_N}ms$", rf"^(\d+)x{_N}s$"

    def kind(p: Column) -> Column:
        t = p["t"]
        is_dwarf, is_plain, is_milli, is_times = num(t, dwarf).isNotNull(), num(t, plain).isNotNull(), num(t, milli).isNotNull(), num(t, times, 2).isNotNull()
        listed = F.lower(p["next"]).isin([f.lower() for f in FILTERS])
        return F.struct(
            F.when(is_dwarf, num(t, dwarf)).when(is_plain, num(t, plain)).when(is_milli, num(t, milli) / 1000).when(is_times, num(t, times, 2)).alias("exposure_s"),
            F.when(is_dwarf, get(t, dwarf, 2).try_cast("bigint")).alias("dwarf_gain"), F.when(is_dwarf | (is_plain & listed), p["next"]).alias("filter_name"), F.when(is_times, get(t, times, 1).try_cast("bigint")).alias("frames"),
            F.when(t.rlike(r"^gain[+-]?\d+$"), F.substr(t, F.lit(5)).try_cast("bigint")).alias("gain"), F.when(t.rlike(r"^bin[+-]?\d+$"), F.substr(t, F.lit(4)).try_cast("bigint")).alias("binning"),
            F.when(t.rlike(rf"^{_N}c$") & (t.contains(".") | t.startswith("-")), num(t, rf"^{_N}c$")).alias("temp_c"),
        )

    known = F.transform(F.transform(F.array(tokens), paired)[0], kind)
    first = lambda k, what: F.get(F.filter(F.transform(k, lambda x: x[what]), lambda v: v.isNotNull()), F.lit(0))
    last = lambda k, what: F.get(F.reverse(F.filter(F.transform(k, lambda x: x[what]), lambda v: v.isNotNull())), F.lit(0))
    begin = prefix(name)
    counted = F.when(begin == "stacked", F.get(tokens, F.lit(1))).when(begin == "dso_stacked", F.get(tokens, F.lit(2)))
    return F.transform(F.array(known), lambda k: F.struct(
        begin.alias("prefix"), first(k, "exposure_s").alias("exposure_s"), F.coalesce(last(k, "gain"), first(k, "dwarf_gain")).alias("gain"), last(k, "binning").alias("binning"), last(k, "temp_c").alias("temp_c"),
        F.coalesce(first(k, "frames"), F.when(counted.rlike(r"^[+-]?\d+$"), counted.try_cast("bigint"))).alias("frames"), first(k, "filter_name").alias("filter_name"),
    ))[0]


# What a template may ask for.
TOKENS = ["name", "object", "filter", "exptime", "integration", "stack", "date", "night", "time", "gain", "camera", "scope", "frame", "seq"]


def rendered(template: str, values: dict[str, Column]) -> tuple[Column, Column]:
    """The name that `template` gives, and the tokens it lacks (array). A token without a value becomes `unknown`.

    template: text with {token}; values: text columns by token. Characters that
    no file name may hold become _, outer blanks go.
    """
    parts, missing, rest = [], [], template
    while "{" in rest:
        before, after = rest.split("{", 1)
        parts.append(F.lit(before))
        if "}" not in after:
            parts.append(F.lit("{" + after))
            rest = ""
            break
        key, rest = after.split("}", 1)
        value = values.get(key, F.lit(None).cast("string"))
        parts.append(F.coalesce(F.trim(safe(value)), F.lit("unknown")))
        missing.append(F.when(value.isNull(), key))
    parts.append(F.lit(rest))
    lacking = F.array_distinct(F.array_compact(F.array(*missing))) if missing else F.array().cast("array<string>")
    return F.trim(safe(F.concat(*parts))), lacking


def safe(part: Column) -> Column:
    """Characters that no file name may hold become _."""
    return F.regexp_replace(part, r'[/\\:*?"<>|\p{Cntrl}]', "_")


def compact_duration(seconds: Column) -> Column:
    """18h57m; minutes alone below an hour, seconds alone below a minute."""
    s = F.round(seconds).cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    two = F.lpad(m.cast("string"), 2, "0")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(h == 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(h.cast("string"), F.lit("h"), two, F.lit("m")))

"""Header and display text as native column expressions: patterns, keywords, assignments, numbers, durations, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions import values

# Keywords that describe the layout, in the order of the standard.
LAYOUT = ["SIMPLE", "XTENSION", "BITPIX", "NAXIS", "EXTEND", "PCOUNT", "GCOUNT", "TFIELDS", "END"]
# Keywords that are never set by hand, and why.
MANAGED = {
    "BZERO": "changes what every stored pixel value means", "BSCALE": "changes what every stored pixel value means", "BLANK": "changes which pixels count as undefined",
    "CHECKSUM": "is maintained on write", "DATASUM": "is maintained on write", "CONTINUE": "is part of a long-string value", "END": "ends the header",
}
# Keywords of a plate solution, whole and by their beginning.
WCS = ["WCSAXES", "LONPOLE", "LATPOLE", "RADESYS", "MJDREF", "A_ORDER", "B_ORDER", "AP_ORDER", "BP_ORDER", "IMAGEW", "IMAGEH", "PLTSOLVD"]
WCS_BEGIN = ["CTYPE", "CRVAL", "CRPIX", "CDELT", "CROTA", "CUNIT", "CD1_", "CD2_", "PC1_", "PC2_", "PV", "LTM"]
TABLE_BEGIN = ["TFORM", "TTYPE", "TBCOL", "TDIM", "TFIELDS", "THEAP", "TZERO", "TSCAL", "TNULL"]


def once(value: Column, use) -> Column:
    """use(value), with `value` evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def wildcard(pattern: Column) -> Column:
    """The regular expression of a pattern in which * stands for any text; both are compared trimmed and in small letters."""
    literal = F.regexp_replace(F.lower(F.trim(pattern)), r"([\\.\[\]{}()+?^$|#&~-])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("$"))


def matches(pattern: Column, value: Column) -> Column:
    return F.rlike(F.lower(F.trim(value)), wildcard(pattern))


def fuzzy(query: Column, text: Column) -> Column:
    """How well a query is met by a text, as a subsequence; null if it isn't. An empty query is met by anything with 0.

    A contiguous match is 1000 less its place, 200 more at the start of a word;
    another is 500 less its spread and its place.
    """
    q, t = F.lower(F.trim(query)), F.lower(text)
    start = F.position(q, t)
    first = F.when(start == 1, 200).when(F.rlike(F.substr(t, start - 1, F.lit(1)), F.lit(r"[\s_.\-]")), 200).otherwise(0)
    # greedy: each letter at its first place after the one before
    none = F.struct(F.lit(1).alias("at"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(True).alias("ok"))

    def take(a: Column, ch: Column) -> Column:
        place = F.position(ch, t, a["at"])
        found = a["ok"] & (place > 0)
        return F.when(found, F.struct((place + 1).alias("at"), F.coalesce(a["first"], place - 1).alias("first"), (place - 1).alias("last"), F.lit(True).alias("ok"))).otherwise(F.struct(a["at"].alias("at"), a["first"].alias("first"), a["last"].alias("last"), F.lit(False).alias("ok")))

    loose = F.aggregate(F.filter(F.split(q, ""), lambda c: c != ""), none, take, lambda a: F.when(a["ok"], 500 - (a["last"] - a["first"]) - a["first"]))
    return F.when(q == "", 0).when(start > 0, 1000 - (start - 1) + first).otherwise(loose)


def valid_keyword(keyword: Column) -> Column:
    """Eight or fewer of A-Z, 0-9, - and _."""
    return F.coalesce(keyword.rlike("^[A-Z0-9_-]{1,8}$"), F.lit(False))


def is_wcs(keyword: Column) -> Column:
    return keyword.isin(WCS) | keyword.rlike("^(" + "|".join(WCS_BEGIN) + ")") | keyword.rlike("^(A|B|AP|BP)_[0-9]")


def is_layout(keyword: Column) -> Column:
    return keyword.isin(LAYOUT) | keyword.rlike("^NAXIS[0-9]+$")


def locked(keyword: Column, unit_kind: Column | None = None) -> Column:
    """Why a keyword may not be edited; null if it may."""
    why = None
    for name, reason in MANAGED.items():
        why = F.when(keyword == name, reason) if why is None else why.when(keyword == name, reason)
    why = why.when(is_layout(keyword), "describes the data layout").when(keyword.rlike("^(" + "|".join(TABLE_BEGIN) + ")[0-9]*$"), "describes a table column")
    if unit_kind is not None:
        why = why.when((unit_kind == "compressed_image") & keyword.startswith("Z"), "is part of the tile-compression description")
    return why


def assignment(text: Column) -> Column:
    """keyword, value_type, value_text of `KEY=VALUE`; null where the keyword isn't valid. Quotes force a string."""
    key, value = F.upper(F.trim(F.substring_index(text, "=", 1))), F.regexp_replace(text, "^[^=]*=", "")
    t = F.trim(value)
    quoted = t.rlike("(?s)^'.*'$") & (F.length(t) > 1)
    number = t.rlike(r"^[-+0-9.eE]+$") & F.coalesce(F.abs(t.try_cast("double")) < float("inf"), F.lit(False))
    kind = F.when(quoted, "string").when(t.isin("T", "F"), "logical").when(t.rlike("^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull(), "integer").when(number, "float").otherwise("string")
    told = F.when(quoted, F.substr(t, F.lit(2), F.length(t) - 2)).when(kind == "string", value).otherwise(t)
    return F.when(text.contains("=") & valid_keyword(key), F.struct(key.alias("keyword"), kind.alias("value_type"), told.alias("value_text")))


def shown(value_type: Column, text: Column) -> Column:
    """A value as lists and comparisons show it: strings in quotes, others as written."""
    return F.when(value_type == "string", F.concat(F.lit("'"), F.trim(text), F.lit("'"))).otherwise(text)


def trimmed(number: Column, places: int) -> Column:
    """A number with at most `places` decimals and no trailing zeros."""
    text = F.format_string(f"%.{places}f", F.round(number, places))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("bigint").cast("string"), 2, "0")


def compact_duration(seconds: Column) -> Column:
    """18h57m; minutes alone below an hour, seconds alone below a minute."""
    s = F.round(seconds).cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), _two(m), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def report_duration(seconds: Column) -> Column:
    """4h 12m; minutes alone (rounded) below an hour, seconds alone below half a minute."""
    m = F.round(seconds / 60).cast("bigint")
    return F.when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit("h "), _two(m % 60), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(F.round(seconds).cast("bigint").cast("string"), F.lit(" s")))


def spaced_duration(seconds: Column) -> Column:
    """4 h 12 m; minutes alone below an hour, seconds alone below a minute."""
    s = F.round(seconds).cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(" h "), _two(m), F.lit(" m"))).when(m > 0, F.concat(m.cast("string"), F.lit(" m"))).otherwise(F.concat(s.cast("string"), F.lit(" s")))


def interval(days: Column) -> Column:
    """How far apart two instants are, in the largest unit that fits."""
    tenth = F.format_string("%.1f", F.round(days * 24, 1))
    return F.when(days >= 1, F.concat(F.round(days).cast("bigint").cast("string"), F.lit(" days apart"))).when(days * 24 >= 1, F.concat(tenth, F.lit(" h apart"))).otherwise(F.concat(F.round(days * 1440).cast("bigint").cast("string"), F.lit(" min apart")))


def ra_text(degrees: Column) -> Column:
    """20h57m10.8s, carried over in tenths of a second."""
    tenths = F.pmod(F.round(degrees * 2400).cast("bigint"), F.lit(864_000))
    seconds = F.concat(_two(F.floor(tenths / 10) % 60), F.lit("."), (tenths % 10).cast("string"))
    return F.concat(_two(F.floor(tenths / 36_000)), F.lit("h"), _two(F.floor(tenths / 600) % 60), F.lit("m"), seconds, F.lit("s"))


def dec_text(degrees: Column) -> Column:
    """+31°14′07″."""
    s = F.round(F.abs(degrees) * 3600).cast("bigint")
    return F.concat(F.when(degrees < 0, "−").otherwise("+"), _two(F.floor(s / 3600)), F.lit("°"), _two(F.floor(s / 60) % 60), F.lit("′"), _two(s % 60), F.lit("″"))


def sexagesimal(text: Column) -> Column:
    """One to three numbers apart by blanks, colons, units or quotes, as a fraction of the first; the sign is that of the text."""
    body = F.regexp_replace(F.trim(text), r"^[+-]+", "")
    parts = F.filter(F.split(body, r"[\s:hmsd°′″'\"]+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^[0-9]*\.?[0-9]*([eE][+-]?[0-9]+)?$"), p.try_cast("double")))

    def size(n: Column) -> Column:
        total = F.aggregate(F.zip_with(n, F.array(F.lit(1.0), F.lit(60.0), F.lit(3600.0)), lambda a, d: F.coalesce(a / d, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(n).between(1, 3) & ~F.exists(n, lambda x: x.isNull()), total * F.when(F.trim(text).startswith("-"), -1.0).otherwise(1.0))

    return once(numbers, size)


def parse_ra(text: Column) -> Column:
    """Degrees of a right ascension: numbers are degrees, other forms hours."""
    hours = once(sexagesimal(text), lambda h: F.when((h >= 0) & (h < 24), h * 15))
    return once(values.plain_number(text), lambda v: F.when(v.isNotNull(), F.when((v >= 0) & (v < 360), v)).otherwise(hours))


def parse_dec(text: Column) -> Column:
    return once(F.coalesce(values.plain_number(text), sexagesimal(text)), lambda v: F.when(v.between(-90, 90), v))


def parse_lon(text: Column) -> Column:
    return once(F.coalesce(values.plain_number(text), sexagesimal(text)), lambda v: F.when(v.between(-180, 360), v))


def stem_ext(path: Column) -> tuple[Column, Column]:
    """Name without folder and extension, and the extension; .fits.fz and the like stay together."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    pattern = r"^(.*?)\.((?:fits|fit|fts)\.fz)$"
    multi = name.rlike(pattern)
    return F.when(multi, F.regexp_extract(name, pattern, 1)).when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name), F.when(multi, F.regexp_extract(name, pattern, 2)).when(name.contains("."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise("")

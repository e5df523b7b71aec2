"""All valid readings of a date or time written as text, as native expressions.

`with_time_readings` adds an array of structs (kind, micros): every instant in UTC
that the text can mean, given what is known of its source (time zone, whether
its clock runs on UTC, the order of day and month). `with_date_readings` does
the same for dates. Text that states no date, or an impossible one, gives an empty
array; null gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone letters and the offsets (minutes east of UTC) they are used for.
ZONE_LETTERS = {
    "UTC": [0], "GMT": [0], "Z": [0], "WET": [0], "WEST": [60], "BST": [60, 360],
    "IST": [330, 60, 120], "CET": [60], "CEST": [120], "EET": [120], "EEST": [180],
    "MSK": [180], "CAT": [120], "WAT": [60], "EAT": [180], "SAST": [120], "PKT": [300],
    "JST": [540], "KST": [540], "HKT": [480], "SGT": [480], "AWST": [480], "ACST": [570],
    "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780],
    "EST": [-300], "EDT": [-240], "CST": [-360, 480], "CDT": [-300], "MST": [-420],
    "MDT": [-360], "PST": [-480], "PDT": [-420], "AKST": [-540], "AKDT": [-480],
    "HST": [-600], "AST": [-240], "ADT": [-180], "BRT": [-180], "ART": [-180],
}
# English month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d+))?"
_ZONE = r"\s*(Z|[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?)?"
_MON = r"([A-Za-z]{3})[a-z]*\.?"
# Each family: pattern, and where year|month|day|hour|minute|second|fraction|half|zone|order come from.
_FAMILIES = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:T|\s+){_TIME}()?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|ymd"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?()\s*(Z|[+-]\d{4})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|ymd"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}),?(?:T|\s+){_TIME}\s*([AaPp][Mm])?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|num"),
    (rf"^(?:[A-Za-z]{{3}},\s*)?(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}),?\s+{_TIME}\s*([AaPp][Mm])?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|ymd"),
    (rf"^{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TIME}\s*([AaPp][Mm])?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|ymd"),
]
_DATES = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", "$1|$2|$3|ymd"),
    (r"^(\d{4})(\d{2})(\d{2})(?:T.*)?$", "$1|$2|$3|ymd"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[T ].*)?$", "$3|$1|$2|num"),
    (rf"^(?:[A-Za-z]{{3}},\s*)?(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}|\d{{2}})(?: .*)?$", "$3|$2|$1|ymd"),
    (rf"^{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})(?: .*)?$", "$3|$1|$2|ymd"),
]

READINGS = "array<struct<kind:string,micros:bigint>>"


def clean(text: Column) -> Column:
    """The text without outer blanks and quotes."""
    return F.regexp_replace(text, r"^[\s\u00a0'\"]+|[\s\u00a0'\"]+$", "")


def _pieces(text: Column, families: list[tuple[str, str]]) -> Column:
    out = None
    for pattern, layout in families:
        hit = F.split(F.regexp_replace(text, pattern, layout), r"\|")
        out = F.when(text.rlike(pattern), hit) if out is None else out.when(text.rlike(pattern), hit)
    return out


def _int(text: Column) -> Column:
    return text.try_cast("bigint")


def _month(text: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(text, 1, 3)))
    return F.when(text.rlike("^[0-9]"), text).otherwise(named.cast("string"))


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of year, month and day as text; null for a date that doesn't exist (year 0 included)."""
    return F.unix_date(F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d"))


def _orders(order: Column, declared: Column) -> Column:
    both = F.array(F.struct(F.lit("dmy").alias("kind"), F.col("_dmy").alias("day")), F.struct(F.lit("mdy").alias("kind"), F.col("_mdy").alias("day")))
    one = F.array(F.struct(F.lit("ymd").alias("kind"), F.col("_mdy").alias("day")))
    return F.when(order == "ymd", one).otherwise(F.filter(both, lambda x: declared.isNull() | (x["kind"] == declared)))


def _declared(name: str | None, as_type: str = "string") -> Column:
    return F.lit(None).cast(as_type) if name is None else F.col(name)


def _date_steps(df: DataFrame, families: list[tuple[str, str]], date_order: str | None) -> DataFrame:
    """Adds _p (the pieces) and _days; each step is a projection, so that no expression is evaluated twice."""
    df = df.withColumn("_p", _pieces(F.col("_t"), families))
    year = F.col("_p")[0]
    df = df.withColumns({"_y": F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), "_m": _month(F.col("_p")[1])})
    df = df.withColumns({"_mdy": day_number(F.col("_y"), F.col("_m"), F.col("_p")[2]), "_dmy": F.when(F.element_at("_p", -1) == "num", day_number(F.col("_y"), F.col("_p")[2], F.col("_p")[1]))})
    df = df.withColumn("_days", _orders(F.element_at("_p", -1), _declared(date_order)))
    df = df.withColumn("_days", F.filter("_days", lambda x: x["day"].isNotNull()))
    # 05/05/2024 reads the same in either order
    same = (F.size("_days") == 2) & (F.try_element_at("_days", F.lit(1))["day"] == F.try_element_at("_days", F.lit(2))["day"])
    either = F.array(F.struct(F.lit("any").alias("kind"), F.try_element_at("_days", F.lit(1))["day"].alias("day")))
    return df.withColumn("_days", F.when(same, either).otherwise(F.col("_days")))


def with_date_readings(df: DataFrame, text: str, date_order: str | None = None, into: str = "readings") -> DataFrame:
    """Adds the dates the text can state, as micros of their midnight; a time in the text is dropped."""
    own = df.columns
    df = _date_steps(df.withColumn("_t", clean(F.col(text))), _DATES, date_order)
    days = F.transform("_days", lambda x: F.struct(x["kind"].alias("kind"), (x["day"] * 86_400_000_000).alias("micros")))
    return df.select(*own, F.coalesce(days, F.array().cast(READINGS)).alias(into))


def with_time_readings(df: DataFrame, text: str, zone: str | None = None, clock: str | None = None, date_order: str | None = None, into: str = "readings") -> DataFrame:
    """Adds the instants that a text with date and time of day can mean.

    zone: column with the IANA name of the source's zone (null: UTC). clock:
    column with 'utc' or 'local', what times without a zone are (null: either).
    date_order: column with 'dmy' or 'mdy' for numeric dates that don't start
    with the year (null: either).
    """
    own = df.columns
    df = df.withColumn("_t", clean(F.col(text))).withColumn("_zone", F.coalesce(_declared(zone), F.lit("UTC")))
    df = _date_steps(df, _FAMILIES, date_order)
    hour, half = _int(F.col("_p")[3]), F.upper(F.col("_p")[7])
    df = df.withColumns({
        "_h": F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0)),
        "_mi": _int(F.col("_p")[4]),
        "_s": F.when(F.col("_p")[5] == "", 0).otherwise(_int(F.col("_p")[5])),
        "_f": F.coalesce(_int(F.rpad(F.substring(F.col("_p")[6], 1, 6), 6, "0")), F.lit(0)),
        "_z": F.upper(F.col("_p")[8]),
    })
    valid = F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    offset = (_int(F.substring("_z", 2, 2)) * 60 + F.when(F.length("_z") > 3, _int(F.right("_z", F.lit(2)))).otherwise(0)) * F.when(F.col("_z").startswith("-"), -1).otherwise(1)
    named = F.create_map(*[x for k, v in ZONE_LETTERS.items() for x in (F.lit(k), F.array(*[F.lit(o).cast("bigint") for o in v]))])
    df = df.withColumns({
        "_day_us": F.when(valid, ((F.col("_h") * 60 + F.col("_mi")) * 60 + F.col("_s")) * 1_000_000 + F.col("_f")),
        "_offsets": F.when(F.col("_z").rlike("^[+-]"), F.array(offset)).when(F.col("_z") != "", named[F.col("_z")]),
    })
    df = df.withColumn("_walls", F.transform("_days", lambda x: F.struct(x["kind"].alias("kind"), (x["day"] * 86_400_000_000 + F.col("_day_us")).alias("micros"))))
    df = df.withColumn("_walls", F.filter("_walls", lambda x: x["micros"].isNotNull()))
    wall_of = lambda u: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), F.col("_zone")))

    # times with a zone: letters used for several offsets are those of the source's own zone, where that can be
    at = F.flatten(F.transform("_walls", lambda w: F.transform(F.col("_offsets"), lambda o: F.struct(w["kind"].alias("kind"), (w["micros"] - o * 60_000_000).alias("micros"), w["micros"].alias("wall")))))
    df = df.withColumn("_stated", F.when(F.col("_z") != "", at))
    df = df.withColumn("_shown", F.when(F.size("_stated") > 1, F.filter("_stated", lambda x: wall_of(x["micros"]) == x["wall"])))
    stated = F.transform(F.when(F.size("_shown") > 0, F.col("_shown")).otherwise(F.col("_stated")), lambda x: F.struct(x["kind"].alias("kind"), x["micros"].alias("micros")))

    # times without one: UTC, or the first and, where the clock went back, also the second instant with this wall time;
    # a wall time skipped by the clock change is read as the clock before the change showed it
    as_utc = F.transform("_walls", lambda w: F.struct(F.concat(w["kind"], F.lit("+utc")).alias("kind"), w["micros"].alias("micros")))
    bare = F.col("_z") == ""
    local = bare & ~F.coalesce(_declared(clock) == "utc", F.lit(False))
    first = F.transform("_walls", lambda w: F.struct(w["kind"].alias("kind"), w["micros"].alias("wall"), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(w["micros"]), F.col("_zone"))).alias("micros")))
    df = df.withColumn("_first", F.when(local, first))
    later = lambda m: F.transform(F.filter("_first", lambda w: wall_of(w["micros"] + m * 60_000_000) == w["wall"]), lambda w: F.struct(F.concat(w["kind"], F.lit(f"+local{m or ''}")).alias("kind"), (w["micros"] + m * 60_000_000).alias("micros")))
    at_once = F.transform("_first", lambda w: F.struct(F.concat(w["kind"], F.lit("+local")).alias("kind"), w["micros"].alias("micros")))
    as_local = F.concat(at_once, later(30), later(60))
    clocked = F.when(_declared(clock) == "utc", as_utc).when(_declared(clock) == "local", as_local).otherwise(F.concat(as_utc, as_local))

    # counts of seconds, milliseconds or days; day counts carry whole milliseconds at best
    df = df.withColumn("_n", F.when(F.col("_t").rlike(r"^(\d{10}(\.\d+)?|\d{13}|\d{5}\.\d+|\d{7}\.\d+)$"), F.col("_t").try_cast("decimal(24,10)")))
    digits = F.length(F.substring_index("_t", ".", 1))
    days = F.col("_n") - F.when(digits == 5, F.lit("40587.0")).otherwise(F.lit("2440587.5")).cast("decimal(8,1)")
    counted = F.when(digits == 10, F.col("_n") * 1_000_000).when(digits == 13, F.col("_n") * 1_000).otherwise(F.round(days * 86_400_000) * 1_000)
    df = df.withColumn("_all", F.when(F.col("_n").isNotNull(), F.array(F.struct(F.lit("count").alias("kind"), counted.cast("bigint").alias("micros")))).when(bare, clocked).otherwise(stated))
    df = df.withColumn("_all", F.coalesce(F.col("_all"), F.array().cast(READINGS)))
    # readings that agree count once
    apart = F.filter("_all", lambda u, i: (i == 0) | ~F.exists(F.slice("_all", F.lit(1), i), lambda v: v["micros"] == u["micros"]))
    return df.select(*own, F.when(F.size("_all") > 1, apart).otherwise(F.col("_all")).alias(into))


def date_text(micros: Column) -> Column:
    """YYYY-MM-DD of an instant, in UTC whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(micros / 86_400_000_000).cast("int")).cast("string")


def utc_text(micros: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ, fractions cut off, in UTC whatever the session's time zone."""
    second = F.pmod(F.floor(micros / 1_000_000), F.lit(86_400))
    two = lambda n: F.lpad(n.cast("bigint").cast("string"), 2, "0")
    return F.concat(date_text(micros), F.lit("T"), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60), F.lit("Z"))

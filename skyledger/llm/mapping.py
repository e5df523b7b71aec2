"""Free-entered values mapped to the closest entry of a reference list.

A set-similarity join with prefix filter: values and entries become sets of
tokens (letters and pairs of letters; numbers as wholes), each set is ordered
by how rare its tokens are over both sides, and only sets that share a token
of their rare prefixes are compared, after the length and the positional
filter. Jaccard similarity is then computed exactly and the best entry kept.
Numbers must agree: a designation with another number is another object.

Scale: only distinct values are compared, once each; rare prefixes keep the
candidate groups small, and the result goes back to the rows by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut

# Accented Latin letters and their plain ones, in the same order.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőřśšşťţùúûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorsssttuuuuuuuyyzzz"
# What observers add to a name without meaning another entry.
ADDED = [
    r"\([^)]*\d+\s*/\s*\d+[^)]*\)", r"\(\s*(?:broadband|\d+(?:\.\d+)?\s*(?:in|mm|nm|inch))\s*\)", r"\b\d+(?:\.\d+)?\s*nm\b", r"_?\d+(?:\.\d+)?\s*nm\b", r"\d+(?:\.\d+)?\s*(?:\"|mm\b|inch\b)",
    r"[-_ ]*\b(?:panel|pane|tile|night|part|mosaic)\s*#?\d+(?:\s*/\s*\d+)?", r"[_ ]p\d+\s*$", r"\b(?:lrgb|rgb|hoo|sho|widefield|mosaic|filter)\b", r"^\s*the\s+",
]

TOKENS = "array<string>"
#: Similarity from which a name needs no further check, and letters that may differ below it.
LIKE, SLIPS = 0.75, 2
#: Slack of the filters, so that rounding drops no pair that reaches the threshold exactly.
EPS = 1e-9


def folded(text: Column) -> Column:
    """Lower case, plain letters, without what observers add."""
    out = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN)
    for pattern in ADDED:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"[\s\u00a0]+", " "))


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z0-9]", "")


def _counted(text: Column) -> Column:
    """Tokens of a text's letters: the second `a` is a2, so that a set keeps how often each occurs."""
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    often = F.transform(letters, lambda c: F.struct(c.alias("c"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("n")))
    return F.flatten(F.transform(F.filter(often, lambda x: x["n"] > 0), lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.concat(x["c"], i.cast("string")))))


def _pairs(word: Column) -> Column:
    """Letter pairs of a word of two letters or more."""
    return F.zip_with(F.slice(F.split(word, ""), F.lit(1), F.length(word) - 1), F.slice(F.split(word, ""), F.lit(2), F.length(word) - 1), lambda a, b: F.concat(a, b))


def with_tokens(df: DataFrame, words: str, numbers: str) -> DataFrame:
    """Adds `tokens`: letters with their counts, letter pairs inside each word, and the numbers as one token. Linear in the text's length."""
    df = df.withColumn("_w", F.filter(F.split(words, "[^a-z]+"), lambda w: w != ""))
    df = df.withColumn("_c", F.array_join("_w", ""))
    pairs = F.flatten(F.transform(F.filter("_w", lambda w: F.length(w) > 1), _pairs))
    number = F.when(F.col(numbers) != "", F.array(F.concat(F.lit("#"), F.col(numbers)))).otherwise(F.array().cast(TOKENS))
    return df.withColumn("tokens", F.array_distinct(F.concat(_counted(F.col("_c")), pairs, number))).drop("_w", "_c")


def similarity_join(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """id, ref, sim of every pair with Jaccard similarity of at least `threshold`.

    left: id, tokens; right: ref, tokens; tokens are sets. Both keep their
    extra column `numbers`, which must be equal. Empty sets match nothing.
    """
    # sets outside the other side's sizes can't reach the threshold; the sizes are one row
    bounds = right.agg(F.min(F.size("tokens")).alias("lo"), F.max(F.size("tokens")).alias("hi")).first()
    n = F.size("tokens")
    left = left.filter((n >= threshold * (bounds["lo"] or 0) - EPS) & (n * threshold <= (bounds["hi"] or 0) + EPS))
    sides = left.select(F.lit(0).alias("side"), "id", "numbers", "tokens").unionByName(right.select(F.lit(1).alias("side"), F.col("ref").alias("id"), "numbers", "tokens"))
    exploded = sides.select("side", "id", "numbers", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    rarity = exploded.groupBy("token").agg(F.count("*").alias("n"))
    ranked = exploded.join(rarity, "token").groupBy("side", "id", "numbers", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    ranked = cut(ranked.withColumn("tokens", F.col("ranked.token")).drop("ranked"))
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - EPS) + 1
    prefix = ranked.select("side", "id", "numbers", "size", F.posexplode(F.slice("tokens", F.lit(1), keep.cast("int"))).alias("at", "token"))
    x = prefix.filter("side = 0").select("id", "numbers", F.col("size").alias("nx"), F.col("at").alias("ax"), "token")
    y = prefix.filter("side = 1").select(F.col("id").alias("ref"), "numbers", F.col("size").alias("ny"), F.col("at").alias("ay"), "token")
    met = x.join(y, ["token", "numbers"])
    fits = (F.col("ny") + EPS >= threshold * F.col("nx")) & (F.col("nx") + EPS >= threshold * F.col("ny"))
    best = 1 + F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) - 1
    least = threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - EPS
    # a pair's first common token is the one the positional bound holds for; later ones are dropped by the grouping
    pairs = met.filter(fits).groupBy("id", "ref").agg(F.max(best + F.least("ax", "ay")).alias("bound"), F.max(least).alias("least")).filter(F.col("bound") >= F.col("least")).select("id", "ref")
    lt = ranked.filter("side = 0").select("id", F.col("tokens").alias("tx"))
    rt = ranked.filter("side = 1").select(F.col("id").alias("ref"), F.col("tokens").alias("ty"))
    both = pairs.join(lt, "id").join(rt, "ref")
    common = F.size(F.array_intersect("tx", "ty"))
    return both.select("id", "ref", (common / (F.size("tx") + F.size("ty") - common)).alias("sim")).filter(F.col("sim") >= threshold)


def _readings(values: DataFrame, text: str) -> DataFrame:
    """Adds f (folded), and for what begins like a designation its letters and numbers: one number, or two."""
    df = values.withColumn("f", folded(F.col(text)))
    lead = r"^([a-z][a-z. ]{0,7}?)[\s._-]*0*([1-9]\d*)(?:[\s._-]+0*([1-9]\d*))?(?![\d/])"
    df = df.withColumn("_hit", F.col("f").rlike(lead))
    return df.withColumns({
        "d_words": F.when(F.col("_hit"), _letters(F.regexp_extract("f", lead, 1))),
        "d_one": F.when(F.col("_hit"), F.regexp_extract("f", lead, 2)),
        "d_two": F.when(F.col("_hit") & (F.regexp_extract("f", lead, 3) != ""), F.concat(F.regexp_extract("f", lead, 2), F.lit("-"), F.regexp_extract("f", lead, 3))),
    }).drop("_hit")


def _sets(df: DataFrame, key: str, word_forms: list[tuple[str, str]]) -> DataFrame:
    """key, form, numbers, tokens of each form (a words and a numbers column) that has words."""
    out = None
    for form, (words, numbers) in enumerate(word_forms):
        one = df.select(F.col(key), F.lit(form).alias("form"), F.col(words).alias("words"), F.coalesce(F.col(numbers), F.lit("")).alias("numbers")).filter(F.col("words").isNotNull() & (F.col("words") != ""))
        out = one if out is None else out.unionByName(one)
    return with_tokens(out, "words", "numbers")


def _best(pairs: DataFrame) -> DataFrame:
    """The most similar entry of each value; ties go to the form first read, then to the lowest entry."""
    w = Window.partitionBy("value").orderBy(F.desc("designated"), F.desc("sim"), "form", "ref_id")
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("value", "ref_id", "sim")


def map_designations(values: DataFrame, entries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """value, ref_id, sim of each value that means an entry; the others are left out.

    values: value (distinct). entries: ref_id, label, is_name. A value that
    begins like a designation is compared with designations whose numbers
    agree; if none does, and for other values, with the names. A name is also
    known by its words but the last, where that is no other entry's. A name
    less similar than LIKE counts only if at most SLIPS letters differ or it
    is the beginning of the entry's.
    """
    read = cut(_readings(values.select("value").filter(F.col("value").isNotNull()).distinct(), "value"))
    entries = entries.select("ref_id", "label", "is_name").filter(F.col("label").isNotNull())
    names = entries.filter("is_name").select("ref_id", folded(F.col("label")).alias("words"))
    short = names.withColumn("words", F.regexp_replace("words", r"\s+\S+$", "")).join(names.select("words"), "words", "left_anti")
    only = Window.partitionBy("words")
    short = short.withColumn("_n", F.count("*").over(only)).filter("_n = 1").drop("_n")
    names = names.unionByName(short.select("ref_id", "words")).distinct().withColumn("numbers", F.lit(""))
    designations = _readings(entries.filter(~F.col("is_name")), "label").select("ref_id", F.col("d_words").alias("words"), F.coalesce("d_two", "d_one").alias("numbers")).filter(F.col("words").isNotNull())
    reference = names.withColumn("designated", F.lit(False)).unionByName(designations.withColumn("designated", F.lit(True))).distinct()
    reference = reference.withColumn("ref", F.concat_ws("|", "ref_id", "words", "numbers"))
    right = cut(with_tokens(reference, "words", "numbers"))
    named = read.withColumn("plain", F.regexp_replace("f", r"[^a-z ,.\-_]+", " "))
    left = _sets(named.withColumn("none", F.lit("")), "value", [("d_words", "d_two"), ("d_words", "d_one"), ("plain", "none")])
    # a form without numbers is a name, and a designation form has numbers
    left = left.filter((F.col("form") == 2) == (F.col("numbers") == "")).withColumn("id", F.concat_ws("|", "form", "numbers", "value"))
    left = cut(left)
    pairs = similarity_join(left, right, threshold).join(left.select("id", "value", "form"), "id").join(right.select("ref", "ref_id", "designated"), "ref")
    # a name shares letters with many; beyond a clear likeness it must be a slip of two letters or an abbreviation
    told, meant = _letters(F.col("plain")), _letters(F.col("words"))
    pairs = pairs.join(named.select("value", "plain"), "value").join(right.select("ref", "words"), "ref")
    close = (F.col("sim") >= LIKE) | (F.levenshtein(told, meant) <= SLIPS) | meant.startswith(told)
    return _best(pairs.filter(F.col("designated") | close))


def map_labels(values: DataFrame, entries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """As map_designations, for short labels without numbering, such as filters.

    II and III are 2 and 3; digits must agree. An entry is also known by the
    beginning of one of its labels of three letters or more and by its letters
    without vowels, where that is no other entry's.
    """

    def plain(text: Column) -> Column:
        f = F.regexp_replace(folded(text), r"^\d+\s*[-:]\s*", "")
        # a number after a blank belongs to the label only as a line's ionisation stage
        f = F.regexp_replace(f, r"[ _-]+\d{2,}\b", " ")
        return F.replace(F.replace(_letters(f), F.lit("iii"), F.lit("3")), F.lit("ii"), F.lit("2"))

    split = lambda df: df.withColumns({"words": F.regexp_replace("p", "[0-9]", ""), "numbers": F.regexp_replace("p", "[^0-9]", "")})
    full = entries.select("ref_id", plain(F.col("label")).alias("p"), F.lit(0).alias("derived")).distinct()
    begin = full.filter(F.col("p").rlike("^[a-z]{4,}$")).select("ref_id", F.explode(F.transform(F.sequence(F.lit(3), F.length("p") - 1), lambda n: F.substr(F.col("p"), F.lit(1), n))).alias("p"), F.lit(1).alias("derived"))
    bones = full.filter(F.col("p").rlike("^[a-z]{4,}$")).select("ref_id", F.concat(F.substring("p", 1, 1), F.regexp_replace(F.substring("p", 2, 99), "[aeiou]", "")).alias("p"), F.lit(1).alias("derived"))
    derived = begin.unionByName(bones).filter(F.length("p") >= 3).distinct().join(full.select("p"), "p", "left_anti")
    derived = derived.withColumn("_n", F.size(F.collect_set("ref_id").over(Window.partitionBy("p")))).filter("_n = 1").drop("_n").select("ref_id", "p", "derived")
    reference = split(full.unionByName(derived)).filter(F.col("p") != "").withColumn("ref", F.concat_ws("|", "ref_id", "p"))
    right = cut(with_tokens(reference, "words", "numbers"))
    left = split(values.select("value").filter(F.col("value").isNotNull()).distinct().withColumn("p", plain(F.col("value")))).filter(F.col("words") != "").withColumn("id", F.col("value"))
    left = cut(with_tokens(left, "words", "numbers"))
    pairs = similarity_join(left, right, threshold).join(left.select("id", "value"), "id").join(right.select("ref", "ref_id", "derived"), "ref")
    # a shortened label counts only where it is met letter by letter
    pairs = pairs.filter((F.col("derived") == 0) | (F.col("sim") == 1.0))
    return _best(pairs.select("value", "ref_id", "sim", F.lit(0).alias("form"), (1 - F.col("derived")).alias("designated")))


def mapped(rows: DataFrame, item: str, value: str, found: DataFrame, exact: DataFrame) -> DataFrame:
    """item, value, ref_id (0: none), sim of each distinct row whose value isn't null and not exactly one of `exact`."""
    slim = rows.select(F.col(item), F.col(value).alias("value")).filter(F.col("value").isNotNull()).distinct()
    odd = slim.join(exact.select(F.col("label").alias("value")).distinct(), "value", "left_anti")
    return odd.join(found, "value", "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(0)))

"""What a file is, by weighted evidence from its header, its name and its exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import filename, values

KINDS = ("light", "dark", "flat", "bias", "dark_flat")


def kind_of_text(text: Column) -> Column:
    """The kind a frame-type value or a name prefix names; dark-flat before dark and flat, offset is bias, and so is zero as the whole text."""
    t = F.regexp_replace(F.lower(text), "[-_ ]", "")
    return F.when(t.rlike("darkflat|flatdark"), "dark_flat").when(t.rlike("bias|offset") | (t == "zero"), "bias").when(t.contains("dark"), "dark").when(t.contains("flat"), "flat").when(t.rlike("light|object|science"), "light")


def classify(files: DataFrame) -> DataFrame:
    """frame_id, kind, score, confidence, evidence.

    files: frame_id, name, frame_type (header text), exposure_s, object. The
    score is the best kind's votes less half of the second's; ties go to the
    kind voted for first. Without a vote the kind is unknown, confidence 0.
    """
    by_key, by_name = kind_of_text(F.col("frame_type")), kind_of_text(filename.prefix(F.col("name")))
    short = F.col("exposure_s") < 0.005
    vote = lambda k, w, why, c: F.when(c & k.isNotNull(), F.struct(k.alias("kind"), F.lit(w).alias("weight"), F.lit(why).alias("why")))
    some = F.array_compact(F.array(vote(by_key, 60, "header", F.lit(True)), vote(by_name, 25, "name", F.lit(True)), vote(F.lit("bias"), 30, "exposure", F.coalesce(short, F.lit(False)))))
    df = files.withColumn("_v", some)
    df = df.withColumn("_v", F.when((F.size("_v") == 0) & F.col("object").isNotNull(), F.array(F.struct(F.lit("light").alias("kind"), F.lit(20).alias("weight"), F.lit("object").alias("why")))).otherwise(F.col("_v")))
    total = lambda k: F.aggregate(F.filter("_v", lambda v: v["kind"] == k), F.lit(0), lambda a, v: a + v["weight"])
    first = lambda k: F.coalesce(F.nullif(F.array_position(F.transform("_v", lambda v: v["kind"]), k), F.lit(0)), F.lit(99))
    ranked = F.array_sort(F.array(*[F.struct((-total(k)).alias("minus"), first(k).alias("at"), F.lit(k).alias("kind")) for k in KINDS]))
    df = df.withColumn("_r", ranked)
    best, second = -F.col("_r")[0]["minus"], -F.col("_r")[1]["minus"]
    score = best - F.floor(second / 2)
    why = F.array_join(F.transform("_v", lambda v: F.concat(v["why"], F.lit("="), v["kind"])), ",")
    return df.select("frame_id", F.when(best > 0, F.col("_r")[0]["kind"]).otherwise("unknown").alias("kind"), score.cast("bigint").alias("score"), F.when(best > 0, F.round(50 + 50 * F.tanh(score / 40.0)).cast("bigint")).otherwise(0).alias("confidence"), why.alias("evidence"))


# The keywords of each fact, the first that states one counts.
KEYS = {
    "frame_type": ["IMAGETYP", "FRAMETYP", "FRAME"], "object": ["OBJECT", "OBJNAME"], "stack_count": ["STACKCNT", "NCOMBINE", "NSTACK"], "total_s": ["LIVETIME", "TOTALEXP"],
    "exposure_s": ["EXPTIME", "EXPOSURE", "CAM EXPOSURE TIME", "EXP_MS"], "bayer": ["BAYERPAT", "COLORTYP"], "ra": ["RA", "OBJCTRA"], "crval1": ["CRVAL1"], "crval2": ["CRVAL2"],
    "ctype1": ["CTYPE1"], "ctype2": ["CTYPE2"], "bitpix": ["BITPIX"], "naxis": ["NAXIS"], "naxis3": ["NAXIS3"],
}
_NUMBERS = {"stack_count", "total_s", "exposure_s", "crval1", "crval2", "bitpix", "naxis", "naxis3"}
_POSITIVE = {"stack_count", "total_s"}
STACKING = "stacking|siril stack|imageintegration|integration"
# Words in HISTORY that tell a processing step; the first four change no picture.
STEPS = {
    "calibration": "calibrat|preprocess", "registration": "registration|register|star alignment|align", "stacking": STACKING, "crop": "crop",
    "background extraction": "background extraction|bge|graxpert|dynamicbackground|automaticbackground|gradient", "colour calibration": "spcc|pcc|photometric|color calibration|colour calibration",
    "green removal": "scnr", "deconvolution": "deconvol|blurx", "noise reduction": "denois|noise reduction|noisex|nxt", "star removal": "starnet|starx|star removal",
    "stretch": "stretch|histogramtransformation|histogram transformation|ghs|asinh|curves|mtf", "saturation": "saturation",
}
_EVIDENCE = "struct<text:string,supports:string,weight:int>"


def _short(line: Column) -> Column:
    return F.when(F.length(line) > 48, F.concat(F.substring(line, 1, 48), F.lit("…"))).otherwise(line)


def facts(cards: DataFrame) -> DataFrame:
    """Per frame_id the facts of KEYS (struct of key, text, number), the first stacking line of HISTORY and the steps with their first lines.

    cards: frame_id, hdu, record, keyword, value_type, value_text. Blank values
    state nothing, nor does text where a number is asked for; of a keyword given
    twice the first counts. One aggregation of fixed width, however long a HISTORY is.
    """
    text, at = values.bare(F.col("value_text")), F.struct("hdu", "record")
    number = values.number(F.col("value_text"))
    number = F.when(F.col("keyword") == "EXP_MS", number / 1000).otherwise(number)
    stated = ~F.coalesce(F.col("value_type"), F.lit("")).isin("undefined", "commentary") & (text != "")
    out = []
    for name, keys in KEYS.items():
        ok = stated & F.col("keyword").isin(keys)
        if name in _NUMBERS:
            ok = ok & number.isNotNull() & ((number > 0) if name in _POSITIVE else F.lit(True))
        if name == "ra":
            ok = ok & (number.between(0, 360) | text.rlike(r"^\d{1,2}[: h]+\d{1,2}([: m]+\d+(\.\d*)?s?)?$"))
        rank = F.array_position(F.array(*map(F.lit, keys)), F.col("keyword"))
        out.append(F.min_by(F.struct(F.col("keyword").alias("key"), text.alias("text"), number.alias("number")), F.when(ok, F.struct(rank.alias("rank"), at.alias("at")))).alias(name))
    line = F.trim("value_text")
    said = lambda pattern: (F.col("keyword") == "HISTORY") & F.lower(line).rlike(pattern)
    out.append(F.min_by(line, F.when(said(STACKING), at)).alias("stacking"))
    steps = [F.min(F.when(said(words), F.struct(at.alias("at"), F.lit(k).alias("place"), F.lit(name).alias("name"), _short(line).alias("evidence")))) for k, (name, words) in enumerate(STEPS.items())]
    out.append(F.transform(F.array_sort(F.array_compact(F.array(*steps))), lambda s: F.struct(s["name"].alias("name"), s["evidence"].alias("evidence"))).alias("processing"))
    wanted = [k for keys in KEYS.values() for k in keys] + ["HISTORY"]
    return cards.filter(F.col("keyword").isin(wanted)).groupBy("frame_id").agg(*out)


def _curve(score: Column) -> Column:
    return F.round(50 + 50 * F.tanh(F.abs(score) / 40.0)).cast("int")


def verdicts(files: DataFrame, cards: DataFrame, units: DataFrame) -> DataFrame:
    """frame_id, label, kind, integrated, confidence, evidence, processing, processed, linear of every file.

    files: frame_id, name, exposure_s, stack_count, object of the listing, one
    row per file; cards as in `facts`; units: frame_id, hdu, kind, bitpix, shape. A
    file without header or units is judged by its listing and name. What the
    listing states goes before the header, the header before the file name.
    Evidence is sorted by weight; linear is false where HISTORY tells a stretch, else null.
    """
    image = units.filter((F.size("shape") > 0) & (F.col("kind") != "bin_table")).groupBy("frame_id").agg(F.min_by(F.struct("bitpix", "shape"), "hdu").alias("image"))
    df = files.select("frame_id", "name", F.col("exposure_s").alias("listed_exposure"), F.col("stack_count").alias("listed_count"), F.col("object").alias("listed_object"))
    df = df.join(facts(cards), "frame_id", "left").join(image, "frame_id", "left")
    c, no = F.col, F.lit(False)
    yes = lambda x: F.coalesce(x, no)
    bitpix = F.coalesce("image.bitpix", c("bitpix.number").cast("bigint"))
    planes = F.when(c("image").isNotNull(), F.when(F.size("image.shape") >= 3, c("image.shape")[2]).otherwise(1)).when(c("naxis.number").isNotNull(), F.when(c("naxis.number") >= 3, c("naxis3.number")).otherwise(1))
    sky = c("ra").isNotNull() | yes((c("crval1").isNotNull() & c("ctype1.text").startswith("RA")) | (c("crval2").isNotNull() & c("ctype2.text").startswith("RA")))
    df = df.select(
        "frame_id", "frame_type", "total_s", "bayer", "stacking", F.coalesce("processing", F.array().cast("array<struct<name:string,evidence:string>>")).alias("processing"), bitpix.alias("bitpix"), planes.alias("planes"),
        F.coalesce("listed_exposure", "exposure_s.number", filename.exposure(c("name"))).alias("exposure"), F.when(c("listed_exposure").isNull(), c("exposure_s.key")).alias("exposure_key"),
        F.coalesce(c("listed_count"), F.round("stack_count.number").cast("bigint")).alias("count"), F.when(c("listed_count").isNull(), c("stack_count.key")).alias("count_key"),
        (yes(F.trim("listed_object") != "") | c("object").isNotNull() | sky).alias("target"), filename.prefix(c("name")).alias("prefix"),
    )

    def seen(condition: Column, text: Column, supports: Column | str, weight: int) -> Column:
        supports = F.lit(supports) if isinstance(supports, str) else supports
        return F.when(yes(condition), F.struct(text.alias("text"), supports.alias("supports"), F.lit(weight).alias("weight")))

    by_key, by_name = kind_of_text(c("frame_type.text")), kind_of_text(c("prefix"))
    named = F.concat(F.lit("file name starts '"), c("prefix"), F.lit("'"))
    equals = lambda key, value: F.concat(key, F.lit("="), value.cast("string"))
    votes = F.array_compact(F.array(
        seen(by_key.isNotNull(), equals(c("frame_type.key"), c("frame_type.text")), by_key, 60), seen(by_name.isNotNull(), named, by_name, 25),
        seen(c("exposure") < 0.005, equals(F.coalesce("exposure_key", F.lit("exposure")), c("exposure")), "bias", 30),
    ))
    total, exposure = c("total_s.number"), c("exposure")
    counted = equals(F.coalesce("count_key", F.lit("stack count")), c("count"))
    integration = F.array_compact(F.array(
        seen(c("count") > 1, counted, "integrated", 50), seen(c("count") <= 1, counted, "single", -30), seen(c("count").isNull(), F.lit("no STACKCNT / NCOMBINE"), "single", -25),
        seen((exposure > 0) & (total > 1.5 * exposure), F.concat(equals(c("total_s.key"), total), F.lit(" > exposure "), exposure.cast("string")), "integrated", 25),
        seen((exposure > 0) & (total <= 1.5 * exposure) & (F.abs(total - exposure) < 1e-6), F.concat(c("total_s.key"), F.lit(" equals exposure")), "single", -10),
        seen(F.lower("frame_type.text").contains("master"), F.lit("frame type says 'master'"), "integrated", 40),
        seen(c("stacking").isNotNull(), F.concat(F.lit("HISTORY '"), _short(c("stacking")), F.lit("'")), "integrated", 30),
        seen(c("prefix").isin("stacked", "dso_stacked", "result", "integration") | c("prefix").startswith("master"), named, "integrated", 20),
        seen(c("bitpix") < 0, F.concat(equals(F.lit("BITPIX"), c("bitpix")), F.lit(" (float)")), "integrated", 10), seen((c("bitpix") == 16) & c("count").isNull(), F.lit("BITPIX=16"), "single", -20),
        seen(c("bayer").isNotNull() & (c("planes") == 1) & c("count").isNull(), F.concat(equals(c("bayer.key"), c("bayer.text")), F.lit(" on a single-plane (raw CFA) image")), "single", -15),
    ))
    df = df.select("frame_id", "processing", "target", votes.alias("votes"), integration.alias("signs"))
    df = df.withColumn("integ", F.aggregate("signs", F.lit(0), lambda a, e: a + e["weight"]))
    lone = F.when((F.size("votes") == 0) & c("target"), F.lit("has a target (OBJECT / RA / DEC)")).when((F.size("votes") == 0) & (c("integ") >= 40), F.lit("integrated, no calibration frame type"))
    df = df.withColumn("extra", F.array_compact(F.array(seen(lone.isNotNull(), lone, "light", 20)))).withColumn("all_votes", F.concat("votes", "extra"))
    score = lambda k: F.aggregate(F.filter("all_votes", lambda v: v["supports"] == k), F.lit(0), lambda a, v: a + v["weight"])
    first = lambda k: F.coalesce(F.nullif(F.array_position(F.transform("all_votes", lambda v: v["supports"]), k), F.lit(0)), F.lit(99))
    df = df.withColumn("ranked", F.array_sort(F.array(*[F.struct((-score(k)).alias("minus"), first(k).alias("at"), F.lit(k).alias("kind")) for k in KINDS])))
    best, second = -c("ranked")[0]["minus"], -c("ranked")[1]["minus"]
    df = df.select("frame_id", "processing", "votes", "extra", "signs", "integ", F.when(best > 0, c("ranked")[0]["kind"]).otherwise("unknown").alias("kind"), (best - F.floor(second / 2)).alias("score"))
    integrated, kind = c("integ") > 0, c("kind")
    processed = F.exists("processing", lambda s: ~s["name"].isin("stacking", "registration", "calibration", "crop"))
    noun = F.when(kind == "dark_flat", "dark-flat").otherwise(kind)
    base = (
        F.when(kind == "unknown", "Unknown").when((kind == "light") & integrated, "Stacked light").when(kind == "light", "Light sub")
        .when(integrated, F.concat(F.lit("Master "), noun)).otherwise(F.concat(F.upper(F.substring(noun, 1, 1)), F.substring(noun, 2, 20), F.lit(" frame")))
    )
    # equal weights stay in the order in which they were seen, and a text counts once
    seen_all = F.transform(F.concat("votes", "extra", "signs"), lambda e, i: F.struct((-F.abs(e["weight"])).alias("minus"), i.alias("i"), F.struct(e["text"].alias("text"), e["supports"].alias("supports"), F.abs(e["weight"]).alias("weight")).alias("e")))
    ordered = F.transform(F.array_sort(seen_all), lambda x: x["e"])
    texts = lambda a: F.transform(a, lambda e: e["text"])
    df = df.withColumns({"ordered": ordered, "processed": processed, "base": base})
    once = F.filter("ordered", lambda e, i: F.array_position(texts(c("ordered")), e["text"]) == i + 1)
    return df.select(
        "frame_id", F.when(c("processed"), F.concat("base", F.lit(", processed"))).otherwise(c("base")).alias("label"), "kind", integrated.alias("integrated"),
        F.when(kind == "unknown", 0).otherwise(F.least(_curve(c("score")), _curve(c("integ")))).alias("confidence"), once.cast(f"array<{_EVIDENCE}>").alias("evidence"), "processing", "processed",
        F.when(F.exists("processing", lambda s: s["name"] == "stretch"), False).alias("linear"),
    )

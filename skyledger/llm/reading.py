"""Reading level of each document, by surprisal under interpolated n-gram models.

Of each language one model per level is trained on rated documents: the chance
of a word is a mixture of its share after the word before it, its share in the
level, and its share in the language's whole corpus. Every word of a document
has a surprisal under each model; of the document's distribution the mean and
four quantiles are kept, each gives a difficulty (the mean level weighted by
how well each model foretells the document), and the difficulties are weighted
by how well each alone foretells the ratings. Isotonic regression on the rated
documents maps the result to levels. A rated document is scored without its
own counts, or it would look easier to foretell than it is.

Scale: a model is a table of counts over a fixed number of hash buckets, so
its size is bounded by parameters, whatever the corpus. The counts are summed
over all documents (the language's words) and over at most `max_rated` rated
documents a language (pairs, words of a level); the tables are broadcast, and
documents are scored where they lie: no word is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut, spread

LEVELS = (1, 2, 3, 4)
#: Weights of the pair, the word in the level, the word in the language.
MIX = (0.5, 0.3, 0.2)
#: How sharply a better model counts, per unit of surprisal a word.
SHARPNESS = 8.0
#: Quantiles of a document's surprisals that are kept beside their mean.
QUANTILES = (0.25, 0.5, 0.75, 0.9)
#: Bits of the hash buckets of words and of pairs; a language's model has at most 2^WORD_BITS * 9 + 2^PAIR_BITS * 4 counts.
WORD_BITS, PAIR_BITS = 18, 21

# Formulas of the house, which are no words of the member's own, and a piece of text that each can't be without.
FORMULAS = [
    (["CORRIGENDUM"], r"CORRIGENDUM – replaces the issue of the day\.?"),
    (["Hear, hear", "Hört, hört", "Très bien"], r"–\s*(?:Hear, hear|Hört, hört|Très bien)\s*!\s*–"),
    (["Pursuant to Standing Order"], r"Pursuant to Standing Order \d+\s*\(\d+\), and with the leave of the House, I rise to speak to the question as amended\.?"),
    (["Gemäß §"], r"Gemäß § \d+ Abs\. \d+[^.]*\."),
    (["Conformément à l'article"], r"Conformément à l'article \d+, alinéa \d+, du Règlement, je prends la parole sur la question ainsi modifiée\.?"),
    (["Thank you, M", "Vielen Dank, ", "Merci, M"], r"(?:Thank you, (?:Madam|Mr) President|Vielen Dank, (?:Frau Präsidentin|Herr Präsident)|Merci, (?:Madame la Présidente|Monsieur le Président))\.?"),
    (["President,", "Präsident", "Présidente,", "Président,"], r"Madam President, honourable members,|Mr President,|Frau Präsidentin, meine Damen und Herren,|Herr Präsident!|Madame la Présidente, mes chers collègues,|Monsieur le Président,"),
    (["Let me be clear", "I repeat", "Again", "One more point", "Um es klar zu sagen", "Noch einmal", "Ein weiterer Punkt", "Soyons clairs", "Je répète", "Encore un point"], r"\b(?:Let me be clear|I repeat|Again|One more point|Um es klar zu sagen|Noch einmal|Ein weiterer Punkt|Soyons clairs|Je répète|Encore un point)\s*:"),
]
CLOSING = r"(?:I commend the motion to the House|I give way|Thank you|Ich bitte um Zustimmung|Vielen Dank|Nous voterons ce texte|Je vous remercie)[.;,!]?$"
# the speaker in front: one word, or a title and names, perhaps with a party
SPEAKER = r"^\s*(?:[\p{L}\d'’_-]+|(?:The member for |Abg\. |M\. |Mme |Mx |Dr\.? )?(?:\p{Lu}[\p{L}\d'’.-]*,?\s*){1,6}(?:\([^)]*\))?)\s*:"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _without(needs: list[str], pattern: str) -> Callable[[Column], Column]:
    def strip(text: Column) -> Column:
        met = F.lit(False)
        for piece in needs:
            met = met | F.contains(text, F.lit(piece))
        return F.when(met, F.regexp_replace(text, pattern, " ")).otherwise(text)

    return strip


def own_words(text: Column) -> Column:
    """The member's own words: without speaker, interruptions in brackets (paragraph numbers stay) and formulas."""
    out = F.trim(_once(text, _without(*FORMULAS[0])))
    out = F.regexp_replace(out, SPEAKER, " ")
    for needs, pattern in [(["["], r"\[[^\]]*\]"), (["("], r"\((?!\d+\))[^)]*\)"), *FORMULAS[1:]]:
        out = _once(out, _without(needs, pattern))
    # a closing formula is in the last characters
    out = _once(F.regexp_replace(out, r"\s+$", ""), lambda t: F.concat(F.substr(t, F.lit(1), F.greatest(F.length(t) - 60, F.lit(0))), F.regexp_replace(F.right(t, F.lit(60)), CLOSING, " ")))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def speeches(documents: DataFrame, least_words: int = 60) -> DataFrame:
    """doc_id, lang, words of every document to be judged; lang is null where it isn't stated.

    Chair turns, null texts and documents of fewer words of the member's own
    are left out. `words` are hashes, and begin with the mark of the text's
    start.
    """
    kept = documents.filter((F.coalesce("turn_type", F.lit("")) != "chair") & F.col("text").isNotNull())
    kept = spread(kept.select("doc_id", "lang", "text")).select("doc_id", F.regexp_extract(F.lower("lang"), "^[a-z]{2}", 0).alias("lang"), own_words(F.col("text")).alias("own"))
    # words are runs without blanks that hold a letter or a digit
    counted = kept.filter(F.regexp_count("own", F.lit(r"[\p{L}\d]\S*")) >= least_words)
    words = F.regexp_extract_all(F.lower("own"), F.lit(r"[\p{L}\p{M}]+|\d+"), 0)
    # numbers are one word
    hashed = F.transform(F.concat(F.array(F.lit("<s>")), words), lambda w: F.xxhash64(F.when((w >= "0") & (w < ":"), "0").otherwise(w)))
    return counted.select("doc_id", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), hashed.alias("words"))


def _buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word but the first: the bucket of the one before, its own, and the pair's."""
    u = words.view(np.uint64)
    h, w = u[:-1], u[1:]
    mixed = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(32)
    pair = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PAIR_BITS)
    low = np.uint64((1 << WORD_BITS) - 1)
    return (h & low).astype(np.int64), (w & low).astype(np.int64), pair.astype(np.int64)


_COUNTS = "lang string, kind string, level int, bucket bigint, n bigint"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("level", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])


def _documents(batch: pa.RecordBatch):
    """lang, levels and words of each row."""
    words = batch.column("words")
    values, at = words.flatten().to_numpy(zero_copy_only=False), words.offsets.to_numpy()
    at = at - at[0]
    for i, (lang, levels) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("levels").to_pylist())):
        yield lang, levels or (), values[at[i] : at[i + 1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bucket is met: words of a language (b), and of rated documents pairs (p), words before (h) and words (u) by level."""
    for batch in batches:
        found: dict[tuple[str, str, int], list[np.ndarray]] = {}
        for lang, levels, words in _documents(batch):
            if lang is None or len(words) < 2:
                continue
            h, w, pair = _buckets(words)
            found.setdefault((lang, "b", 0), []).append(w)
            for level in levels:
                for kind, x in (("p", pair), ("h", h), ("u", w)):
                    found.setdefault((lang, kind, level), []).append(x)
        for (lang, kind, level), parts in found.items():
            bucket, n = np.unique(np.concatenate(parts), return_counts=True)
            k = len(bucket)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([kind] * k), pa.array(np.full(k, level, dtype=np.int32)), pa.array(bucket), pa.array(n.astype(np.int64))], schema=_COUNTS_ARROW)


def _models(counts: pd.DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Per language with rated documents the tables: b by word, h and u by word and level, p by place and level, and `place` of a pair."""
    models = {}
    for lang, mine in counts.groupby("lang"):
        if not (mine["kind"] == "p").any():
            continue
        of = {kind: rows for kind, rows in mine.groupby("kind")}
        m = {"b": np.zeros(1 << WORD_BITS)}
        m["b"][of["b"]["bucket"]] = of["b"]["n"]
        for kind in "hu":
            m[kind] = np.zeros((1 << WORD_BITS, len(LEVELS)), dtype=np.float32)
            m[kind][of[kind]["bucket"], of[kind]["level"] - 1] = of[kind]["n"]
        keys, at = np.unique(of["p"]["bucket"], return_inverse=True)
        m["p"] = np.zeros((len(keys) + 1, len(LEVELS)), dtype=np.float32)
        m["p"][at + 1, of["p"]["level"] - 1] = of["p"]["n"]
        m["pair"] = keys
        models[lang] = m
    return models


def _surprisals(m: dict[str, np.ndarray], words: np.ndarray, levels: tuple[int, ...] = ()) -> np.ndarray:
    """Per level the surprisal of each word but the first; the counts of a document rated `levels` are taken out."""
    h, w, pair = _buckets(words)
    hw, before, own, total = m["p"][m["place"][pair]], m["h"][h], m["u"][w], m["t"]
    if levels:
        hw, before, own, total = hw.copy(), before.copy(), own.copy(), total.copy()
        for x, table in ((pair, hw), (h, before), (w, own)):
            _, at, n = np.unique(x, return_inverse=True, return_counts=True)
            for level in levels:
                table[:, level - 1] = np.maximum(table[:, level - 1] - n[at], 0)
        for level in levels:
            total[level - 1] = max(total[level - 1] - len(w), 0)
    in_pair = np.minimum(hw / np.maximum(before, 1), 1) * (before > 0)
    in_level = np.minimum(own / np.maximum(total, 1), 1) * (total > 0)
    in_language = (m["b"][w] + 0.5) / (m["all"] + m["known"])
    return -np.log(MIX[0] * in_pair + MIX[1] * in_level + MIX[2] * in_language[:, None]).T


def _difficulties(stats: np.ndarray) -> np.ndarray:
    """Of each statistic (a row, a column per level) the mean level, weighted by how well each model foretells."""
    weights = np.exp(-SHARPNESS * (stats - stats.min(axis=1, keepdims=True)))
    return (weights * np.array(LEVELS)).sum(axis=1) / weights.sum(axis=1)


_SCORES = "doc_id bigint, lang string, words bigint, means array<double>, spread array<double>, by array<double>, held array<double>, levels array<int>"
_SCORES_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("means", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64())),
    ("by", pa.list_(pa.float64())), ("held", pa.list_(pa.float64())), ("levels", pa.list_(pa.int32())),
])


def _stats(s: np.ndarray) -> np.ndarray:
    """Mean and quantiles (rows) of the surprisals under each level (columns)."""
    n = s.shape[1]
    places = [min(n - 1, int(q * n)) for q in QUANTILES]
    ordered = np.partition(s, sorted(set(places)), axis=1)
    return np.vstack([s.mean(axis=1), *[ordered[:, k] for k in places]])


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {}
        for lang, m in shared.value.items():
            place = np.zeros(1 << PAIR_BITS, dtype=np.int32)
            place[m["pair"]] = np.arange(1, len(m["pair"]) + 1)
            models[lang] = {**m, "place": place, "t": m["u"].sum(axis=0, dtype=np.float64), "all": m["b"].sum(), "known": (m["b"] > 0).sum()}
        for batch in batches:
            rows = []
            for doc, (lang, levels, words) in zip(batch.column("doc_id").to_pylist(), _documents(batch)):
                tried = [lang] if lang in models else sorted(models) if lang is None else []
                if len(words) < 2 or not tried:
                    continue
                found = [(name, _stats(_surprisals(models[name], words))) for name in tried]
                name, stats = min(found, key=lambda x: (x[1][0].min(), x[0]))
                held = _difficulties(_stats(_surprisals(models[name], words, tuple(levels)))).tolist() if levels and lang else None
                rows.append((doc, name, len(words) - 1, stats[0].tolist(), stats[1:, stats[0].argmin()].tolist(), _difficulties(stats).tolist(), held, list(levels)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows), _SCORES_ARROW)], schema=_SCORES_ARROW)

    return score


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
    """Isotonic fit of y over x: the fitted values in order of x, and its blocks (value, size, first x, last x)."""
    blocks: list[list[float]] = []
    for a, b in zip(x.tolist(), y.tolist()):
        blocks.append([float(b), 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            right, left = blocks.pop(), blocks.pop()
            n = left[1] + right[1]
            blocks.append([(left[0] * left[1] + right[0] * right[1]) / n, n, left[2], right[3]])
    return np.concatenate([np.full(int(b[1]), b[0]) for b in blocks]), blocks


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights of the statistics, and difficulties at which the isotonic fit passes 1.5, 2.5 and 3.5."""
    rows = rows.sort_values(["draw", "level"], kind="stable")
    by, level = np.stack(rows["held"].to_numpy()), rows["level"].to_numpy()
    errors = []
    for x in by.T:
        order = np.lexsort((level, x))
        off = np.sort((_monotone(x[order], level[order])[0] - level[order]) ** 2)
        # a tenth of the ratings may be wrong
        errors.append(float(off[: max(1, len(off) * 9 // 10)].mean()))
    weights = 1 / (np.array(errors) + 1e-3) ** 2
    weights /= weights.sum()
    x = by @ weights
    order = np.lexsort((level, x))
    _, blocks = _monotone(x[order], level[order])
    cuts = []
    for edge in (1.5, 2.5, 3.5):
        above, below = [b for b in blocks if b[0] >= edge], [b for b in blocks if b[0] < edge]
        cuts.append((above[0][2] + below[-1][3]) / 2 if above and below else (-np.inf if above else np.inf))
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "weights": [weights.tolist()], "c2": [cuts[0]], "c3": [cuts[1]], "c4": [cuts[2]]})


def reading_levels(documents: DataFrame, rated: DataFrame, least_words: int = 60, max_rated: int = 20_000) -> DataFrame:
    """doc_id, lang, words, surprisal_1..4, spread, difficulty, level of every document to be judged.

    rated: doc_id, level. A document without a stated language is judged in
    the one that foretells it best; its rating isn't used. A language without
    rated documents, or a document with no word, gives no level row. Ratings
    other than 1 to 4 or null are left out; a document rated twice counts with
    each rating. Of more than `max_rated` ratings as many are drawn by hash.
    A document listed twice is judged once. spread: the quantiles QUANTILES of
    the surprisals under the model that foretells the document best.
    """
    marks = rated.filter(F.col("level").isin(*LEVELS)).select("doc_id", F.col("level").cast("int").alias("level")).distinct()
    n = marks.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    marks = marks.filter(draw < int((1 << 30) * min(1.0, max_rated / max(n, 1)))).groupBy("doc_id").agg(F.sort_array(F.collect_set("level")).alias("levels"))
    spoken = cut(speeches(documents, least_words).join(marks, "doc_id", "left").select("doc_id", "lang", "levels", "words"))
    counts = spoken.mapInArrow(_count, _COUNTS).groupBy("lang", "kind", "level", "bucket").agg(F.sum("n").alias("n"))
    shared = spoken.sparkSession.sparkContext.broadcast(_models(counts.toPandas()))
    scored = cut(spoken.mapInArrow(_score(shared), _SCORES))
    held = scored.filter("held IS NOT NULL").select("lang", "held", F.explode("levels").alias("level"), F.xxhash64("doc_id").alias("draw"))
    fits = held.groupBy("lang").applyInPandas(_fit, "lang string, weights array<double>, c2 double, c3 double, c4 double")
    once = scored.groupBy("doc_id").agg(F.min(F.struct("lang", "words", "means", "spread", "by")).alias("x")).select("doc_id", "x.*")
    judged = once.join(F.broadcast(fits), "lang").withColumn("difficulty", F.aggregate(F.zip_with("by", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    level = 1 + sum(((F.col("difficulty") >= F.col(c)).cast("int") for c in ("c2", "c3", "c4")), F.lit(0))
    return judged.select("doc_id", "lang", "words", *[F.col("means")[k - 1].alias(f"surprisal_{k}") for k in LEVELS], "spread", "difficulty", level.cast("int").alias("level"))

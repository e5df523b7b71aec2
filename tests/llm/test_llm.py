"""Mapping, packing, mixing and reading levels against brute force, bounds and held-out ratings."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import mapping, mixing, packing, reading


# ---- mapping

ENTRIES = [(1, "VGC 144", False), (2, "VGC 219", False), (3, "Hx 2-42", False), (3, "Wn 3078", False), (4, "Qb 27", False), (4, "Copperleaf Nebula", True), (5, "LDX 1263", False), (5, "Osprey Galaxy", True)]
MEANT = {
    "vgc144": 1, "VGC 00144 panel 2": 1, "VCG 219": 2, "VG219_P3": 2, "VGC 220": 0, "hx 2 42": 3, "HX2_42 (mosaic 2/6)": 3, "Hx 2-43": 0, "wn_3078": 3, "Q.b. 27 - night 2": 4,
    "Cpoperleaf Nebula": 4, "CopperleafNebula": 4, "Copper Kettle Nebula": 0, "the osprey galaxy": 5, "Osprey Gal": 5, "Osprey": 5, "Galaxy, Osprey": 5, "Comet Q9": 0, "?": 0, "": 0, "L" * 5000: 0,
}


def test_designations(spark):
    values = spark.createDataFrame([(k,) for k in [*MEANT, *MEANT, None]], "value string")
    found = {r["value"]: r["ref_id"] for r in mapping.map_designations(values, spark.createDataFrame(ENTRIES, "ref_id int, label string, is_name boolean")).collect()}
    assert {k: found.get(k, 0) for k in MEANT} == MEANT
    assert mapping.map_designations(values.limit(0), spark.createDataFrame(ENTRIES, "ref_id int, label string, is_name boolean")).count() == 0


FILTERS = [(1, "L"), (1, "Luminance"), (2, "R"), (2, "Red"), (3, "Ha"), (3, "H-alpha"), (4, "OIII"), (4, "O3"), (4, "Oxygen III"), (5, "SII"), (5, "S2"), (6, "Clear")]
BANDS = {"lum": 1, "Lum.": 1, "red filter": 2, "R (broadband)": 2, "h-alpha 7nm": 3, "H-alhpa": 3, "[OIII]": 4, "oxigen III": 4, "O3 6.5nm": 4, "S-II": 5, "s2": 5, "Clr": 6, "claer": 6, "4-R": 2, "Filter 3": 0, "unknown": 0, "-": 0}


def test_labels(spark):
    values = spark.createDataFrame([(k,) for k in BANDS], "value string")
    found = {r["value"]: r["ref_id"] for r in mapping.map_labels(values, spark.createDataFrame(FILTERS, "ref_id int, label string")).collect()}
    assert {k: found.get(k, 0) for k in BANDS} == BANDS


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(2)
    sets = lambda n: [sorted(rng.sample("abcdefghijklmnop", rng.randint(1, 9))) for _ in range(n)]
    left, right = sets(60), sets(60)
    l = spark.createDataFrame([(f"l{i}", "", t) for i, t in enumerate(left)], "id string, numbers string, tokens array<string>")
    r = spark.createDataFrame([(f"r{i}", "", t) for i, t in enumerate(right)], "ref string, numbers string, tokens array<string>")
    for threshold in (0.4, 0.6):
        got = {(x["id"], x["ref"]): round(x["sim"], 9) for x in mapping.similarity_join(l, r, threshold).collect()}
        jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        want = {(f"l{i}", f"r{j}"): round(jac(a, b), 9) for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right)) if jac(a, b) >= threshold}
        assert got == want


# ---- packing

def test_sizes_fit_and_little_is_lost():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 3000)
    slots = packing.pack_sizes(sizes, 1000, 1.0, 0.001)
    room = np.bincount(slots, weights=sizes)
    assert room.max() <= 1000 and len(room) <= np.ceil(sizes.sum() / 1000) * 1.01 + 1
    assert len(packing.pack_sizes(np.array([], dtype=int), 10, 1, 1)) == 0


def test_texts(spark):
    texts = ["word " * n for n in (3, 900, 2500, 10, 0, 40)] + [None, "", "same", "same"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    packed = packing.pack_texts(docs, capacity=1000, shard_items=3).collect()
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, t in enumerate(texts) if t}
    for rows in by_doc.values():
        rows.sort(key=lambda r: r["piece"])
        assert [r["first_token"] for r in rows] == [1000 * k for k in range(len(rows))] and all(r["tokens"] == 1000 for r in rows[:-1])
    assert len(by_doc[2]) > 1 and len(by_doc[1]) == 1
    fills = packing.fill(packing.pack_texts(docs, capacity=1000), 1000).collect()
    assert max(r["tokens"] for r in fills) <= 1000
    assert packing.pack_texts(docs.limit(0)).count() == 0


# ---- mixing

def test_route_meets_quotas_within_repeats():
    groups = {("a",): 1000, ("b",): 100, ("a", "b"): 50}
    total, plan = mixing.route(groups, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    # b can be met from three times (100 + 50)
    assert total in (900, 901)
    for s in "ab":
        assert sum(n for _, _, x, n in plan if x == s) == total // 2
    used = {}
    for g, j, _, n in plan:
        used[g, j] = used.get((g, j), 0) + n
    assert all(n <= groups[g] for (g, _), n in used.items())
    # nothing is repeated while a first copy is left over
    assert sum(n for g, j, s, n in plan if s == "a" and j > 1) == 0


def test_shares(spark):
    rng = random.Random(4)
    rows = [(i, s, f"{s} {i} " + "word " * rng.randint(1, 60)) for i, s in enumerate(["big"] * 900 + ["small"] * 60)] + [(5000, "small", "big 0 shared text"), (5001, "big", "big 0 shared text"), (5002, "none", "x"), (5003, "big", None), (5004, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 2)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert all(abs(r["share"] - r["target_share"]) < 0.01 and r["repetitions"] <= r["max_repeats"] for r in got.values())
    per = selection.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("repetition").alias("d")).filter("n <> d").count()
    assert per == 0 and selection.filter("doc_id IN (5002, 5003, 5004)").count() == 0
    assert {tuple(r) for r in mixing.mix(docs, targets)[0].collect()} == {tuple(r) for r in selection.collect()}


# ---- reading levels

WORDS = {1: "cat dog run big red".split(), 2: "budget council teacher vote letter".split(), 3: "regulator amendment deliberate consultation fiscal".split(), 4: "jurisdictional extrapolation presuppose harmonisation elude".split()}


def _speech(rng, level, n=90):
    return " ".join(rng.choice(WORDS[level] if rng.random() < 0.8 else WORDS[rng.choice([1, 2, 3, 4])]) for _ in range(n))


def test_levels_on_held_out_documents(spark):
    rng = random.Random(9)
    level = {i: rng.choice([1, 2, 3, 4]) for i in range(400)}
    rows = [(i, _speech(rng, k), "en" if i % 10 else None, "speech") for i, k in level.items()] + [(900, "cat " * 80, "en", "chair"), (901, "cat " * 20, "en", "speech"), (902, None, "en", "speech"), (903, "", "en", "speech")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, turn_type string")
    rated = spark.createDataFrame([(i, k if i % 25 else min(4, k + 1)) for i, k in level.items() if i < 150], "doc_id bigint, level int")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(docs, rated).collect()}
    assert set(got) == set(level)
    held = [i for i in level if i >= 150]
    assert np.mean([got[i] == level[i] for i in held]) > 0.95


def test_own_words(spark):
    cases = {
        "Mx Ferrowby: Thank you, Madam President. The wells are safe. [Laughter] I give way.": "The wells are safe.",
        "The member for Osterquay (Ravi-Ann Corvaine): Again: See Order 58(2) now. (Sustained applause) Thank you.": "See Order 58(2) now.",
        "Il y a une raison simple : le vent. Je vous remercie.": "Il y a une raison simple : le vent.",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["o"] for r in df.select("t", reading.own_words(F.col("t")).alias("o")).collect()} == cases


def test_extra_columns_that_clash(spark):
    """Columns named like those the operators make inside, and rows listed twice."""
    docs = spark.createDataFrame([(i, f"cat dog {i} " * 40, "en", "speech", "a", 1, "x", [1], "y") for i in (1, 2, 2)], "doc_id bigint, text string, lang string, turn_type string, source string, n int, words string, tokens array<int>, size string")
    assert packing.pack_texts(docs, capacity=50).count() > 3
    targets = spark.createDataFrame([("a", 1.0, 2, "z")], "source string, target_share double, max_repeats int, tokens string")
    assert mixing.mix(docs, targets.drop("tokens"))[1].count() == 1
    rated = spark.createDataFrame([(1, 2, 7), (2, 3, 7)], "doc_id bigint, level int, n int")
    assert {r["doc_id"] for r in reading.reading_levels(docs, rated).collect()} == {1, 2}
    values = spark.createDataFrame([("vgc 144", "f", 1)], "value string, f string, numbers int")
    assert mapping.map_designations(values, spark.createDataFrame(ENTRIES, "ref_id int, label string, is_name boolean").withColumn("f", F.lit(1))).count() == 1

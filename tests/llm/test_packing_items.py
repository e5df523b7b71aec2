"""Packing where a doc_id doesn't tell rows apart."""

from skyledger.llm import packing


def test_repeated_and_null_ids(spark):
    long, short = "word " * 400, "a few words only"
    rows = [(7, long), (7, long), (None, long), (None, long)] + [(7, short)] * 40 + [(None, short)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    packed = packing.pack_texts(docs, capacity=100, shard_items=10)
    assert packed.select("item", "piece").distinct().count() == packed.count() and packed.select("item").distinct().count() == len(rows)
    assert all(r["tokens"] <= 100 and r["fill"] <= 1 for r in packing.fill(packed, 100).collect())
    full = packed.filter("container LIKE 'full%'")
    assert full.count() >= 12 and full.select("container").distinct().count() == full.count()
    shards = {r["container"].split("-")[1] for r in packed.filter("container LIKE 'mixed%'").collect()}
    assert len(shards) > 4

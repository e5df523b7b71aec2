"""Sources mixed to target shares of all tokens, small ones repeated within a cap.

Texts that occur in several sources can stand for any of them, so texts are
grouped by the set of sources they occur in. Tokens are routed from these
groups to the sources' quotas by a min-cost flow in which each further
repetition of a group costs more. The total is given, or grows until sources
that hold more than a given part of the shares have run out; a source that
runs out, or has no text, gives what it has and its shortfall is reported.
Which texts make up a routed amount is decided by a seeded hash, so a run can
be repeated.

Scale: only group totals (at most 2^sources of them) reach the driver, where
the flow is solved, once for each source that runs out; texts are chosen by hash ranges, found in a histogram of
bounded size, so that no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.tokens import TOKENIZER, n_tokens
from skyledger.session import cut, spread

BUCKETS = 65_536


def _augment(n: int, edges: list[list[int]], out: list[list[int]], s: int, t: int, limit: int | None = None) -> tuple[int, int]:
    """Min-cost flow by cheapest paths; edges are [to, room, cost], each followed by its reverse."""
    flow = cost = 0
    while limit is None or flow < limit:
        dist: list[float] = [float("inf")] * n
        dist[s], came = 0, [-1] * n
        for _ in range(n):
            changed = False
            for u in range(n):
                if dist[u] == float("inf"):
                    continue
                for e in out[u]:
                    to, room, price = edges[e]
                    if room > 0 and dist[u] + price < dist[to]:
                        dist[to], came[to], changed = dist[u] + price, e, True
            if not changed:
                break
        if dist[t] == float("inf"):
            break
        step, v = (limit - flow) if limit is not None else 1 << 62, t
        while v != s:
            step = min(step, edges[came[v]][1])
            v = edges[came[v] ^ 1][0]
        v = t
        while v != s:
            edges[came[v]][1] -= step
            edges[came[v] ^ 1][1] += step
            v = edges[came[v] ^ 1][0]
        flow, cost = flow + step, cost + step * int(dist[t])
    return flow, cost


def route(
    groups: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None, most_short: float = 0.1
) -> tuple[int, list[tuple[tuple[str, ...], int, str, int]]]:
    """The total, and (group, repetition, source, tokens) of the cheapest routing.

    groups: tokens of each set of sources. A group can be repeated for a
    source as often as that source allows; the j-th repetition costs j - 1 a
    token. A source gets its share of the total, or all it has. Without `total`
    it is the largest at which sources with at most `most_short` of all shares
    have run out, those without any text aside.
    """
    names = sorted(shares)
    deepest = max(repeats.values(), default=0)
    layers = [(g, j) for g in sorted(groups) for j in range(1, deepest + 1) if any(repeats[s] >= j for s in g if s in shares)]
    at_source = {s: 2 + len(layers) + k for k, s in enumerate(names)}

    def solve(amount: float):
        n = 2 + len(layers) + len(names)
        edges: list[list[int]] = []
        out: list[list[int]] = [[] for _ in range(n)]

        def add(u: int, v: int, room: int, price: int) -> int:
            out[u].append(len(edges))
            edges.append([v, room, price])
            out[v].append(len(edges))
            edges.append([u, 0, -price])
            return len(edges) - 2

        links = []
        for i, (g, j) in enumerate(layers):
            add(0, 2 + i, groups[g], j - 1)
            links += [(g, j, s, add(2 + i, at_source[s], groups[g], 0)) for s in g if s in shares and repeats[s] >= j]
        for s in names:
            add(at_source[s], 1, int(shares[s] * amount), 0)
        _augment(n, edges, out, 0, 1)
        # the sources from which no more can be drawn: those that the cut leaves on the sink's side
        reached, queue = {0}, [0]
        while queue:
            for e in out[queue.pop()]:
                if edges[e][1] > 0 and edges[e][0] not in reached:
                    reached.add(edges[e][0])
                    queue.append(edges[e][0])
        short = [s for s in names if at_source[s] not in reached]
        return short, [(g, j, s, edges[e + 1][1]) for g, j, s, e in links if edges[e + 1][1] > 0]

    if total is None:
        # the flow grows with the total along ever flatter lines, one for each set of sources that have run out; the total
        # sought lies where a line of sets that may run out meets one of sets that may not, and no third line is lower
        def supply(short: list[str]) -> int:
            return sum(groups[g] for g, j in layers if any(s in short and repeats[s] >= j for s in g))

        held = lambda short: sum(shares[s] for s in short)
        may, may_not = [], [s for s in names if supply([s])]
        total = int(supply(may_not) / held(may_not)) if may_not else 0
        while may_not and len(may) < len(may_not):
            short = [s for s in solve(total)[0] if s in at_source and supply([s])]
            line = lambda x: supply(x) - total * held(x)
            if line(short) >= min(line(may), line(may_not)) - 1:
                break
            may, may_not = (short, may_not) if held(short) <= most_short else (may, short)
            total = int((supply(may_not) - supply(may)) / (held(may_not) - held(may)))
    return total, solve(total)[1]


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, most_short: float = 0.1, seed: int = 7, tokenizer: str = TOKENIZER, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, repetition, tokens) and the shares reached.

    documents: doc_id, source, text. Texts that agree are one text, given by
    its first document in the source it is chosen for; null and empty texts
    and sources without a target are left out. Each amount is met to within
    one text, never above the routed amount's last text. `size` names a column
    that has the tokens already. total, most_short: see `route`. Shares:
    source, target_share, max_repeats, texts, tokens, share, repetitions, quota
    (its share of the total) and shortfall (what of the quota its texts can't
    give).
    """
    counted = (lambda t: n_tokens(t, tokenizer)) if size is None else lambda t: F.col("_size")
    wanted = {r["source"]: r for r in targets.filter(F.col("target_share") > 0).collect()}
    kept = documents.filter(F.col("source").isin(list(wanted)) & F.col("text").isNotNull() & (F.col("text") != ""))
    known = F.lit(0) if size is None else F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    keyed = kept.select("doc_id", "source", F.sha2("text", 256).alias("key"), "text", known.alias("_size"))
    sized = cut(spread(keyed).select("key", "source", "doc_id", counted(F.col("text")).alias("tokens")))
    texts = sized.groupBy("key").agg(F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("group"))
    texts = cut(texts.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(BUCKETS))))
    histogram = cut(texts.groupBy("group", "bucket").agg(F.sum("tokens").alias("tokens")))
    groups = {tuple(r["group"]): int(r["tokens"]) for r in histogram.groupBy("group").agg(F.sum("tokens").alias("tokens")).collect()}
    total, plan = route(groups, {s: r["target_share"] for s, r in wanted.items()}, {s: int(r["max_repeats"]) for s, r in wanted.items()}, total, most_short)
    routed: dict[str, int] = {}
    for _, _, s, amount in plan:
        routed[s] = routed.get(s, 0) + amount
    quotas = {s: int(r["target_share"] * total) for s, r in wanted.items()}

    # each repetition of a group is dealt along its hash order: [start, end) tokens to each source
    rows, at = [], {}
    for g, j, s, amount in plan:
        start = at.get((g, j), 0)
        rows.append((list(g), j, s, start, start + amount))
        at[g, j] = start + amount
    spark = documents.sparkSession
    ranges = spark.createDataFrame(rows, "group array<string>, repetition int, source string, start bigint, end bigint")
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = histogram.select("group", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["group", "bucket"]).withColumn("place", F.col("base") + F.col("inside"))
    # a text belongs to the range its middle falls into
    middle = F.col("place") + F.col("tokens") / 2
    chosen = placed.join(F.broadcast(ranges), "group").filter((middle >= F.col("start")) & (middle < F.col("end"))).select("key", "source", "repetition")
    firsts = sized.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    selection = chosen.join(firsts, ["key", "source"]).select("doc_id", "source", "repetition", "tokens")
    reached = selection.groupBy("source").agg(F.countDistinct("doc_id").alias("texts"), F.sum("tokens").alias("tokens"), F.max("repetition").alias("repetitions"))
    everything = Window.partitionBy()
    shares = targets.filter(F.col("target_share") > 0).join(reached, "source", "left").fillna(0, ["texts", "tokens", "repetitions"])
    shares = shares.withColumn("share", F.col("tokens") / F.sum("tokens").over(everything))
    asked = spark.createDataFrame([(s, q, q - routed.get(s, 0)) for s, q in quotas.items()], "source string, quota bigint, shortfall bigint")
    return selection, shares.join(asked, "source").select("source", "target_share", "max_repeats", "texts", "tokens", "share", "repetitions", "quota", "shortfall")

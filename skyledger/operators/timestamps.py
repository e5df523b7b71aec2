"""Mixed timestamp formats and zones brought to one unambiguous form.

Every text gives the array of all instants it can mean (functions.timeparse);
where there are several, a Viterbi pass over the source's record order takes
the cheapest path. Steps that go back in time or put two records of one item
apart cost; long gaps cost a little. A reading that tells the order of day and
month, or whether the clock runs on UTC, costs if the last one that told did
tell otherwise; a record with one reading tells as much as any.

Scale: rows with one reading that leaves nothing open need no pass. Sequences
are cut into small blocks by number of rows, so that a source with a third of
all rows is many tasks; only blocks with an open row reach Python, with the
rows at the borders of the blocks beside them. Each such block gives the matrix
of its cheapest costs between its first and last row. These matrices are
chained in groups of at most FAN, groups of groups and so on, until one group
a source is left; its ends are settled, then those of the groups inside, and
at last the paths in the blocks. No task sees more than FAN blocks, and the
result equals one Viterbi pass over the whole sequence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import timeparse
from skyledger.operators import order
from skyledger.session import cut, if_small, spread

#: Costs of a step: another kind of reading, time running back, records of one item apart, per e-fold of hours.
SWITCH, BACKWARD, APART, GAP = 1.0, 10.0, 20.0, 0.1
BLOCK_ROWS, FAN = 500, 256


def _parts(kind: str) -> tuple[str, str]:
    """The order of day and month and the clock that a kind of reading tells; "local" and "local60" are one clock."""
    first, _, second = kind.partition("+")
    return (first if first in ("dmy", "mdy") else ""), second.rstrip("0123456789")


def _apart(a_item, a_micros, b_item, b_micros) -> np.ndarray:
    delta = (b_micros[None, :] - a_micros[:, None]) / 1e6
    cost = GAP * np.log1p(np.abs(delta) / 3600)
    return cost + (APART * (np.abs(delta) > 2) if a_item == b_item else BACKWARD * (delta < -1))


def _step(a_item, a_micros, a_kinds, b_item, b_micros, b_kinds) -> np.ndarray:
    """Costs from every reading of one record to every reading of the next, if both tell all there is to tell."""
    switch = np.array([[sum(bool(x and y and x != y) for x, y in zip(_parts(i), _parts(j))) for j in b_kinds] for i in a_kinds])
    return SWITCH * switch + _apart(a_item, a_micros, b_item, b_micros)


def _states(row: dict, orders: list[str], clocks: list[str]) -> tuple:
    """item, micros, told kinds, whether the reading itself tells them, and its place: a reading for each kind last told."""
    out = []
    for k, r in enumerate(row["readings"]):
        told = _parts(r["kind"])
        own = [names.index(t) + 1 if t in names else 0 for t, names in zip(told, (orders, clocks))]
        for i in [own[0]] if own[0] else range(len(orders) + 1):
            for j in [own[1]] if own[1] else range(len(clocks) + 1):
                out.append((r["micros"], i, j, own[0] > 0, own[1] > 0, k))
    micros, *rest = zip(*out)
    return row["item"], np.array(micros, dtype=np.int64), *(np.array(x) for x in rest)


def _begin(a: tuple) -> np.ndarray:
    """Costs of a sequence's first record: nothing was told before it."""
    _, _, i, j, tells_i, tells_j, _ = a
    return np.where((~tells_i & (i > 0)) | (~tells_j & (j > 0)), np.inf, 0.0)


def _move(a: tuple, b: tuple) -> np.ndarray:
    cost = _apart(a[0], a[1], b[0], b[1])
    for x, y, tells in ((a[2], b[2], b[4]), (a[3], b[3], b[5])):
        if y.any() or x.any():
            other = x[:, None] != y[None, :]
            cost = cost + np.where(tells[None, :], SWITCH * (other & (x[:, None] > 0)), np.where(other, np.inf, 0.0))
    return cost


def _forward(chain: list[tuple], start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cheapest costs of every state of the last row (one line per line of `start`), and the way back of the first line."""
    best, back = np.atleast_2d(start), []
    for a, b in zip(chain, chain[1:]):
        total = best[:, :, None] + _move(a, b)[None]
        back.append(total[0].argmin(axis=0))
        best = total.min(axis=1)
    return best, back


def _from_each(n: int) -> np.ndarray:
    return np.where(np.eye(n) > 0, 0.0, np.inf)


_LINK = "seq string, block bigint, orders array<string>, clocks array<string>, first_row struct<item:bigint,part:string,readings:array<struct<kind:string,micros:bigint>>>, last_row struct<item:bigint,part:string,readings:array<struct<kind:string,micros:bigint>>>, costs array<array<double>>"
_ENDS = "seq string, block bigint, enter_at int, leave_at int"


def _sorted_chain(rows: pd.DataFrame) -> list[tuple]:
    orders, clocks = list(rows["orders"].iloc[0]), list(rows["clocks"].iloc[0])
    return [_states({"item": i, "readings": r}, orders, clocks) for i, r in zip(rows["item"], rows["readings"])]


def _matrix(rows: pd.DataFrame) -> pd.DataFrame:
    chain = _sorted_chain(rows.sort_values(["item", "part"], kind="stable"))
    costs = _forward(chain, _from_each(len(chain[0][1])))[0]
    return pd.DataFrame({"seq": [rows["seq"].iloc[0]], "block": [rows["block"].iloc[0]], "costs": [costs.tolist()]})


class _Links:
    """Blocks of one sequence in order, with the states of their first and last rows and the costs between."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows.sort_values("block", kind="stable").reset_index(drop=True)
        orders, clocks = list(self.rows["orders"].iloc[0]), list(self.rows["clocks"].iloc[0])
        self.first = [_states(r, orders, clocks) for r in self.rows["first_row"]]
        self.last = [_states(r, orders, clocks) for r in self.rows["last_row"]]
        # a block that leaves nothing open has one state at either end
        self.inner = [np.array([list(x) for x in c]) if c is not None else np.zeros((1, 1)) for c in self.rows["costs"]]

    def folded(self) -> np.ndarray:
        best = self.inner[0]
        for k in range(1, len(self.inner)):
            for step in (_move(self.last[k - 1], self.first[k]), self.inner[k]):
                best = (best[:, :, None] + step[None]).min(axis=1)
        return best

    def ends(self, start: np.ndarray, leave: int | None = None) -> pd.DataFrame:
        """Of each block the states its first and its last row take."""
        best, ways = start, []
        for k in range(len(self.inner)):
            came = None
            if k:
                total = best[:, None] + _move(self.last[k - 1], self.first[k])
                came, best = total.argmin(axis=0), total.min(axis=0)
            total = best[:, None] + self.inner[k]
            ways.append((came, total.argmin(axis=0)))
            best = total.min(axis=0)
        at = int(best.argmin()) if leave is None else leave
        enter_at, leave_at = [0] * len(ways), [0] * len(ways)
        for k in reversed(range(len(ways))):
            leave_at[k] = at
            enter_at[k] = int(ways[k][1][at])
            if k:
                at = int(ways[k][0][enter_at[k]])
        return pd.DataFrame({"seq": self.rows["seq"], "block": self.rows["block"], "enter_at": enter_at, "leave_at": leave_at})


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    links = _Links(rows)
    first, last = links.rows.iloc[0], links.rows.iloc[-1]
    one = {"seq": first["seq"], "block": first["group"], "orders": first["orders"], "clocks": first["clocks"], "first_row": first["first_row"], "last_row": last["last_row"], "costs": links.folded().tolist()}
    return pd.DataFrame({k: [v] for k, v in one.items()})


def _top(rows: pd.DataFrame) -> pd.DataFrame:
    links = _Links(rows)
    return links.ends(_begin(links.first[0]))


def _inside(rows: pd.DataFrame) -> pd.DataFrame:
    links = _Links(rows)
    return links.ends(_from_each(len(links.first[0][1]))[int(rows["enter_at"].iloc[0])], int(rows["leave_at"].iloc[0]))


def _path(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["item", "part"], kind="stable")
    chain = _sorted_chain(rows)
    at = int(rows["leave_at"].iloc[0])
    _, back = _forward(chain, _from_each(len(chain[0][1]))[int(rows["enter_at"].iloc[0])])
    taken = [at]
    for b in reversed(back):
        at = int(b[at])
        taken.append(at)
    taken.reverse()
    micros = [int(c[1][k]) for c, k in zip(chain, taken)]
    return pd.DataFrame({"seq": rows["seq"], "item": rows["item"], "part": rows["part"], "micros": micros})


def _told(at: int, kinds: list[str]):
    """The distinct names among `kinds` that the readings tell; fewer than two leave nothing open."""
    told = F.split_part("kind", F.lit("+"), F.lit(at))
    told = F.regexp_replace(told, r"\d+$", "")
    names = F.sort_array(F.collect_set(F.when(told.isin(kinds), told)))
    return F.when(F.size(names) > 1, names).otherwise(F.array().cast("array<string>"))


def choose_readings(df: DataFrame, block_rows: int = BLOCK_ROWS, unread: bool = False, fan: int = FAN) -> DataFrame:
    """One instant per record: the readings on the cheapest path of each sequence.

    df: seq (any key), item (bigint, rising in record order), part (string,
    several records of one item), readings (timeparse.READINGS), and any other
    columns, which are kept. Rows that agree in seq, item and part are one
    record listed again. Rows without a reading are left out, or with `unread`
    kept with a null. Gives df's rows with `micros` instead of `readings`.
    """
    n, own = F.size("readings"), [c for c in df.columns if c != "readings"]
    only = F.when(n == 1, F.try_element_at("readings", F.lit(1)))
    # read several times below, and a filter pushed into the parsing would repeat it
    slim = cut(df.select(*own, n.alias("n"), only["micros"].alias("micros"), only["kind"].alias("kind"), F.when(n > 1, F.col("readings")).alias("readings")))
    settled_now = slim.filter((F.col("n") == 1) | (F.col("n") == 0) if unread else F.col("n") == 1).select(*own, "micros")
    # what there is to tell in each sequence with an open choice
    opened = cut(slim.filter("n > 1").select("seq", F.explode("readings.kind").alias("kind")).groupBy("seq").agg(_told(1, ["dmy", "mdy"]).alias("orders"), _told(2, ["utc", "local"]).alias("clocks")))
    if opened.isEmpty():
        return settled_now
    one = F.array(F.struct(F.coalesce("kind", F.lit("")).alias("kind"), F.col("micros").alias("micros")))
    tells = lambda names, at: (F.size(names) == 0) | F.array_contains(names, F.regexp_replace(F.split_part(F.coalesce("kind", F.lit("")), F.lit("+"), F.lit(at)), r"\d+$", ""))
    read = slim.filter("n > 0").select("seq", "item", "part", "n", "kind", "micros", "readings").join(if_small(opened), "seq")
    read = read.select("seq", "item", "part", "orders", "clocks", F.coalesce("readings", one).alias("readings"), ((F.col("n") > 1) | ~tells("orders", 1) | ~tells("clocks", 2)).alias("open"))
    read = read.withColumn("bucket", order.bucket("item", block_rows))
    numbered = cut(order.blocks(read, "seq", "item", block_rows).select("seq", "bucket", "block"))
    # only blocks with an open row, and those beside them, matter to the path
    opens = read.filter("open").select("seq", "bucket").distinct().join(numbered, ["seq", "bucket"]).select("seq", "block").distinct()
    around = opens.select("seq", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), F.col("block").alias("by"))
    marks = cut(around.groupBy("seq", "block").agg(F.max(F.col("block") == F.col("by")).alias("open")).join(numbered, ["seq", "block"]))
    near = read.drop("open").join(if_small(marks), ["seq", "bucket"])
    near = cut(near.drop("bucket").dropDuplicates(["seq", "block", "item", "part"]))
    row = F.struct("item", "part", "readings")
    links = near.groupBy("seq", "block").agg(F.first("orders").alias("orders"), F.first("clocks").alias("clocks"), F.min_by(row, F.struct("item", "part")).alias("first_row"), F.max_by(row, F.struct("item", "part")).alias("last_row"))
    needed = near.filter("open").drop("open")
    matrices = needed.groupBy("seq", "block").applyInPandas(_matrix, "seq string, block bigint, costs array<array<double>>")
    levels, most = [links.join(matrices, ["seq", "block"], "left")], marks.agg(F.max("block")).first()[0] or 0
    while most >= fan:
        levels[-1] = cut(levels[-1])
        levels.append(levels[-1].withColumn("group", F.floor(F.col("block") / fan)).groupBy("seq", "group").applyInPandas(_fold, _LINK))
        most //= fan
    ends = levels.pop().groupBy("seq").applyInPandas(_top, _ENDS)
    for level in reversed(levels):
        above = ends.withColumnRenamed("block", "group")
        ends = level.withColumn("group", F.floor(F.col("block") / fan)).join(above, ["seq", "group"]).groupBy("seq", "group").applyInPandas(_inside, _ENDS)
    paths = needed.join(ends, ["seq", "block"]).groupBy("seq", "block").applyInPandas(_path, "seq string, item bigint, part string, micros bigint")
    settled = slim.filter("n > 1").select(*own).join(paths, ["seq", "item", "part"]).select(*own, "micros")
    return settled_now.unionByName(settled)


def read_times(df: DataFrame, rigs: DataFrame, block_rows: int = BLOCK_ROWS, unread: bool = False) -> DataFrame:
    """df (rig, frame_id, part, date_obs and any other columns) with `micros` instead of `date_obs`; see frame_times."""
    known = rigs.select("rig", "zone_name", "clock", "date_order").dropDuplicates(["rig"])
    named = spread(df).filter(F.col("rig").isNotNull() & F.col("frame_id").isNotNull()).join(known, "rig", "left")
    named = named.withColumnsRenamed({"rig": "seq", "frame_id": "item"})
    read = timeparse.with_time_readings(named, "date_obs", "zone_name", "clock", "date_order").drop("zone_name", "clock", "date_order", "date_obs")
    return choose_readings(read, block_rows, unread).withColumnsRenamed({"seq": "rig", "item": "frame_id"})


def frame_times(frames: DataFrame, subgrades: DataFrame, rigs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Instants of `date_obs` of both tables: src, rig, frame_id, micros.

    Both tables write the times of the same frames, so they form one sequence
    per rig. A value listed twice counts once; rows without rig or frame_id
    are left out; a rig missing in `rigs` is taken
    to keep UTC with either order of day and month. Null, empty or unreadable
    values give no row.
    """
    one = lambda df, src: df.select(F.lit(src).alias("part"), "rig", "frame_id", "date_obs").filter(F.col("date_obs").isNotNull())
    both = one(frames, "frames.date_obs").unionByName(one(subgrades, "subgrades.date_obs"))
    return read_times(both, rigs, block_rows).select(F.col("part").alias("src"), "rig", "frame_id", "micros").distinct()


def frame_nights(frames: DataFrame, rigs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dates of `frames.night` that aren't written YYYY-MM-DD: src, rig, frame_id, micros of the midnight."""
    known = rigs.select("rig", "date_order").dropDuplicates(["rig"])
    odd = frames.select("rig", F.col("frame_id").alias("item"), F.col("night").alias("text")).filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    read = timeparse.with_date_readings(odd.join(known, "rig", "left"), "text", "date_order").select(F.col("rig").alias("seq"), "item", F.lit("frames.night").alias("part"), "readings")
    return choose_readings(read, block_rows).select(F.col("part").alias("src"), F.col("seq").alias("rig"), F.col("item").alias("frame_id"), "micros").distinct()


def normalised(frames: DataFrame, subgrades: DataFrame, rigs: DataFrame) -> DataFrame:
    """src, frame_id, norm of every value that states a time (or, for night, a date written otherwise)."""
    times = frame_times(frames, subgrades, rigs).withColumn("norm", timeparse.utc_text(F.col("micros")))
    nights = frame_nights(frames, rigs).withColumn("norm", timeparse.date_text(F.col("micros")))
    return times.unionByName(nights).select("src", "frame_id", "norm").distinct()

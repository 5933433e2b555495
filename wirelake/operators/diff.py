"""Difference of two packet streams as an edit script of least cost.

Streams are compared window by window of packets. After a window that still has packets behind it the
next one starts right after its last equal pair (or else its last modified one) where that lies in the
last quarter of both windows, so an insertion or a drop doesn't put later windows out of step.

Windows follow each other, so a stream is first cut at places that both streams surely share: packets
whose bytes occur once in each, before which everything that so corresponds lies on the left and after
which on the right. Between two cuts a task goes through its windows; streams without such places are
one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.dissect import dissect_bytes
from wirelake.operators.edit import table_of
from wirelake.operators.order import running

DROP, INSERT, NEVER = 2.0, 5.0, 1e20
MODIFY, EXTRA = 7.0, 1.05
WINDOW = 100
STRETCH = 1000
RESULT = T.StructType([
    T.StructField("op", T.StringType()), T.StructField("before_no", T.LongType()), T.StructField("after_no", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("moved_to", T.LongType()),
])


def edit_script(cost: np.ndarray, drop: np.ndarray, insert: np.ndarray) -> tuple[float, list[tuple[str, int, int]]]:
    """Least total and its steps (PASS, DROP, INSERT, MODIFY); ties prefer keeping a pair.

    The table of totals is filled along its anti-diagonals, each at once.
    """
    n, m = cost.shape
    d = np.zeros((n + 1, m + 1))
    d[1:, 0], d[0, 1:] = np.cumsum(drop), np.cumsum(insert)
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        j = k - i
        if len(i):
            d[i, j] = np.minimum(np.minimum(d[i - 1, j - 1] + cost[i - 1, j - 1], d[i - 1, j] + drop[i - 1]), d[i, j - 1] + insert[j - 1])
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append(("PASS" if cost[i, j] == 0 else "MODIFY", i, j))
        elif i and d[i, j] == d[i - 1, j] + drop[i - 1]:
            i -= 1
            out.append(("DROP", i, -1))
        else:
            j -= 1
            out.append(("INSERT", -1, j))
    return float(d[n, m]), out[::-1]


class Side:
    """A packet of one stream: its number, bytes and digest, and its headers once they are asked for."""

    __slots__ = ("no", "data", "dltype", "digest", "_parts")

    def __init__(self, no: int, data: bytes, dltype: int):
        self.no, self.data, self.dltype, self._parts = no, data, dltype, None
        self.digest = hashlib.sha256(dltype.to_bytes(4, "big") + data).digest()

    def parts(self) -> list[tuple[int, np.ndarray]]:
        """(protocol, bytes) of each header, and of what follows the last."""
        if self._parts is None:
            units = dissect_bytes(self.data, self.dltype)[1:]
            raw = np.frombuffer(self.data, dtype=np.uint8)
            self._parts = [(u.prid, raw[u.soff : u.poff]) for u in units] + [(-1, raw[units[-1].poff :] if units else raw)]
        return self._parts


def packet_cost(a: Side, b: Side) -> float:
    """Cost of turning one packet into another: edits of units, and of bits inside units of one kind."""
    bit = MODIFY / (8 * max(len(a.data), len(b.data), 1))
    pa_, pb = a.parts(), b.parts()
    cost = np.full((len(pa_), len(pb)), NEVER)
    for i, (kind, x) in enumerate(pa_):
        for j, (other, y) in enumerate(pb):
            if kind == other:
                n = min(len(x), len(y))
                cost[i, j] = bit * (float(np.bitwise_count(x[:n] ^ y[:n]).sum()) + 8 * EXTRA * abs(len(x) - len(y)))
    sizes = lambda parts: np.array([bit * EXTRA * 8 * len(h) for _, h in parts])
    if [k for k, _ in pa_] == [k for k, _ in pb]:
        straight = float(np.trace(cost))
        if straight <= min(sizes(pa_).min(), sizes(pb).min()):
            return straight
    return edit_script(cost, sizes(pa_), sizes(pb))[0]


def costs(before: list[Side], after: list[Side], modify: bool) -> np.ndarray:
    """Cost of every pair of a window. A packet with an equal one in the other window is paired with such only."""
    cost = np.full((len(before), len(after)), NEVER)
    there: dict[bytes, list[int]] = {}
    for j, y in enumerate(after):
        there.setdefault(y.digest, []).append(j)
    own = {x.digest for x in before}
    for i, x in enumerate(before):
        if x.digest in there:
            cost[i, there[x.digest]] = 0.0
        elif modify:
            for j, y in enumerate(after):
                if y.digest not in own and x.dltype == y.dltype:
                    cost[i, j] = packet_cost(x, y)
    return cost


def resume(steps: list[tuple[str, int, int]], n: int, m: int) -> int:
    """How many steps of a window count before the next one starts."""
    for wanted in ("PASS", "MODIFY"):
        for k in range(len(steps) - 1, -1, -1):
            op, i, j = steps[k]
            if op == wanted:
                if i + 1 >= n * 3 // 4 and j + 1 >= m * 3 // 4:
                    return k + 1
                break
    return len(steps)


def diff_stretch(before: list[Side], after: list[Side], window: int = WINDOW, modify: bool = True) -> list[dict]:
    """The edit script of two stretches, window after window."""
    out, a, b = [], 0, 0
    while a < len(before) or b < len(after):
        xs, ys = before[a : a + window], after[b : b + window]
        cost = costs(xs, ys, modify)
        _, steps = edit_script(cost, np.full(len(xs), DROP), np.full(len(ys), INSERT))
        last = a + len(xs) >= len(before) and b + len(ys) >= len(after)
        steps = steps if last else steps[: resume(steps, len(xs), len(ys))]
        for op, i, j in steps:
            price = {"PASS": 0.0, "DROP": DROP, "INSERT": INSERT}.get(op)
            out.append({"op": op, "before_no": xs[i].no if i >= 0 else None, "after_no": ys[j].no if j >= 0 else None, "cost": float(cost[i, j]) if price is None else price, "moved_to": None, "digest": (xs[i] if i >= 0 else ys[j]).digest})
        a, b = a + sum(i >= 0 for _, i, _ in steps), b + sum(j >= 0 for _, _, j in steps)
    waiting: dict[bytes, list[dict]] = {}
    for row in out:
        if row["op"] in ("DROP", "INSERT"):
            mates = waiting.setdefault(row["digest"], [])
            if mates and mates[0]["op"] != row["op"]:
                mate = mates.pop(0)
                mate["moved_to"], row["moved_to"] = (row["before_no"] or row["after_no"]), (mate["before_no"] or mate["after_no"])
            else:
                mates.append(row)
    return out


def _numbered(stream: DataFrame, name: str) -> DataFrame:
    """(src_id, n, no, h, data, dltype): every packet's place from 0, and its digest."""
    rows = running(stream.select("src_id", "pkt_no", "data", "dltype"), F.lit(1), "__n", inclusive=False)
    return rows.select(F.lit(0).alias("src_id"), F.col("__n").alias("n"), F.col("pkt_no").alias("no"), F.sha2(F.concat(F.col("dltype").cast("string").cast("binary"), "data"), 256).alias("h"), "data", "dltype")


def _extreme(rows: DataFrame, value: str, at: str, largest: bool) -> Column:
    """The largest value before a row, or the smallest after it, inside its block and over whole blocks."""
    size = F.max if largest else F.min
    span = (Window.unboundedPreceding, -1) if largest else (1, Window.unboundedFollowing)
    inside = size(value).over(Window.partitionBy("__b").orderBy(at).rowsBetween(*span))
    return (F.greatest if largest else F.least)(inside, F.col(f"__{value}_{int(largest)}"))


def cuts(before: DataFrame, after: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(i, j): places where both streams can be cut, at most one for every stretch of the first.

    Narrow rows only: blocks of the pairs that occur once in each stream carry their extremes on.
    """
    once = lambda df, name: df.groupBy("h").agg(F.min("n").alias(name), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    pairs = once(before, "i").join(once(after, "j"), "h").select("i", "j", F.floor(F.col("i") / stretch).alias("__b"))
    blocks = pairs.groupBy("__b").agg(F.max("j").alias("hi"), F.min("j").alias("lo"))
    w = Window.orderBy("__b")
    blocks = blocks.select("__b", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__j_1"), F.min("lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__j_0"))
    rows = pairs.join(blocks, "__b")
    clean = (F.coalesce(_extreme(rows, "j", "i", True), F.lit(-1)) < F.col("j")) & (F.coalesce(_extreme(rows, "j", "i", False), F.lit(1 << 62)) > F.col("j"))
    return rows.withColumn("__ok", clean).where("__ok").groupBy("__b").agg(F.min(F.struct("i", "j")).alias("c")).select("c.i", "c.j")


def diff(before: DataFrame, after: DataFrame, window: int = WINDOW, modify: bool = True, stretch: int = STRETCH) -> DataFrame:
    """(op, before_no, after_no, cost, moved_to): what turns the first stream into the second."""
    a, b = _numbered(before, "a"), _numbered(after, "b")
    found = cuts(a, b, max(stretch, 4 * window))

    def dealt(rows: DataFrame, at: str) -> DataFrame:
        marks = found.select(F.col(at).alias("__at"))
        marked = rows.join(marks, F.col("n") == F.col("__at"), "left")
        return running(marked, F.when(F.col("__at").isNotNull(), 1).otherwise(0), "stretch", order=("src_id", "n")).select(*[F.col(c).alias(c) for c in ("stretch", "n", "no", "data", "dltype")])

    def sides(table: pa.Table) -> list[Side]:
        return [Side(r["no"], r["data"], r["dltype"]) for r in table.sort_by("n").to_pylist()]

    def fit(x: pa.Table, y: pa.Table) -> pa.Table:
        return table_of(diff_stretch(sides(x), sides(y), window, modify), RESULT)

    return dealt(a, "i").groupBy("stretch").cogroup(dealt(b, "j").groupBy("stretch")).applyInArrow(fit, RESULT)

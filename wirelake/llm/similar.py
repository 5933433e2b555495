"""Near-duplicate rows at a word-shingle similarity, by prefix keys, wide SimHash and pivot distance tables.

Every row gets its set of distinct shingle hashes and a 256-bit SimHash fingerprint of that set. Two
sets at the similarity share a shingle among the first of each, in any order that all rows use: of n
shingles the first n - ceil(SIMILARITY * n) + 1. These are a row's keys, in order of their hashes but
with those that are keys of very many rows last.

Rows that share a key are compared by their fingerprints: pairs are discarded by their distances to
reference fingerprints (pivots), survivors verified by their own distance, at a limit that is far from
both a pair at the similarity (39 bits of 256, 48 for the smallest sets) and unrelated rows (128).
What is linked so, over any number of steps, is a loose class. Inside loose classes the shingle sets
themselves are compared, so a class of near duplicates consists of exact links only.

``settle`` finds what connects the rows of a group without comparing all pairs of a large one: parts
of a bounded size with some rows of the group in each of them come first; then the rows that are
outside the group's largest class so far meet every row of the group, again in parts of a bounded
size. So no link is lost, and a group of copies costs work in proportion to its rows.

Cases: a null text counts as empty; rows without words link to each other only. Rows with fewer words
than a shingle are compared by their whole sequence. Rows that repeat an id are rows of their own. A
null id loses to any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import free, fresh, map_texts, materialize, shuffles_freed, small_side, tidy, with_row_uid
from wirelake.llm.components import components
from wirelake.llm.simhash import SEED, shingles

WORDS = 5
SIMILARITY = 0.8
NEAR = 76
PART = 1024
SHINGLES = 1_000_000
LEADERS = 32
HEAVY = 1_000_000
SMALL = 48
PIVOTS = 16
_STEPS = np.array([0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], dtype=np.uint64)
_PRINT = ["f0", "f1", "f2", "f3"]


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.array([one(p, SEED) for p in shingles(text, size)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Four 64-bit words of majority bits; zeros for no shingles."""
    out = np.zeros(4, dtype=np.uint64)
    for k in range(4 if len(hashes) else 0):
        h = _mix(hashes + _STEPS[k]) if k else hashes
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 16384):
            counts += np.unpackbits(h[at : at + 16384, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def prefix_keys(hashes: np.ndarray, heavy: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The keys of a row's sorted distinct shingle hashes; heavy (sorted) ones go last. Rows without shingles share a key."""
    n = len(hashes)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    if len(heavy):
        common = heavy[np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)] == hashes
        hashes = np.r_[hashes[~common], hashes[common]]
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16)


def _pivot_table(fps: np.ndarray) -> np.ndarray:
    refs = np.random.default_rng(7).integers(0, 1 << 64, (PIVOTS, 4), dtype=np.uint64)
    return np.stack([_distances(fps, r[None]) for r in refs], axis=1)


def _near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those within most bits: pivots discard, the distance verifies."""
    for k in range(table.shape[1]):
        if not len(i):
            break
        stay = np.abs(table[i, k] - table[j, k]) <= most
        i, j = i[stay], j[stay]
    stay = _distances(fps[i], fps[j]) <= most
    return i[stay], j[stay]


def spanning(roots: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that, with the classes in roots, connect all that linked(row, other rows) connects.

    Small classes go first: each of their rows is held against all rows that aren't in its class yet.
    """
    order, start = np.argsort(roots, kind="stable"), 0
    _, sizes = np.unique(roots[order], return_counts=True)
    classes = []
    for n in sizes:
        classes.append(order[start : start + n])
        start += n
    name = np.empty(len(roots), dtype=np.int64)
    for k, own in enumerate(classes):
        name[own] = k
    left, a, b = np.ones(len(roots), dtype=bool), [], []
    for k in np.argsort(sizes, kind="stable"):
        if not left[classes[k][0]]:
            continue
        reached = list(classes[k])
        left[classes[k]] = False
        while reached:
            others = np.flatnonzero(left)
            if not len(others):
                return a, b
            x = reached.pop()
            for y in linked(int(x), others):
                if left[y]:
                    a.append(int(x))
                    b.append(int(y))
                    left[classes[name[y]]] = False
                    reached += list(classes[name[y]])
    return a, b


def loose_links(keys: np.ndarray, roots: np.ndarray, fps: np.ndarray, most: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows that are near by fingerprint inside runs of equal keys: all pairs of small runs, what connects larger ones."""
    table = _pivot_table(fps)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[starts, len(keys)])
    of = np.repeat(size, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(SMALL, len(keys))):
        i = np.flatnonzero((of[:-step] > step) & (of[:-step] <= SMALL) & (keys[:-step] == keys[step:]))
        if not len(i):
            break
        i, j = _near(fps, table, i, i + step, most)
        a.append(i)
        b.append(j)
    for at, n in zip(starts[size > SMALL], size[size > SMALL], strict=True):
        own, rows = fps[at : at + n], table[at : at + n]

        def linked(x: int, others: np.ndarray, own=own, rows=rows) -> np.ndarray:
            return _near(own, rows, np.full(len(others), x), others, most)[1]

        i, j = spanning(roots[at : at + n], linked)
        a.append(at + np.array(i, dtype=np.int64))
        b.append(at + np.array(j, dtype=np.int64))
    return np.concatenate(a), np.concatenate(b)


def exact_links(roots: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, most: int = NEAR) -> tuple[list[int], list[int]]:
    """Links that connect the rows whose shingle sets have the similarity; the fingerprints discard pairs first."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mine, table = np.zeros(len(names), dtype=bool), _pivot_table(fps)

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        others = _near(fps, table, np.full(len(others), x), others, most)[1]
        others = others[(np.minimum(sizes[others], sizes[x]) >= similarity * np.maximum(sizes[others], sizes[x]) - 1e-9)]
        if not len(others):
            return others
        own = ids[ends[x] - sizes[x] : ends[x]]
        mine[own] = True
        both = np.array([np.count_nonzero(mine[ids[ends[y] - sizes[y] : ends[y]]]) for y in others])
        mine[own] = False
        return others[both >= similarity * (sizes[others] + sizes[x] - both) - 1e-9]

    return spanning(roots, linked)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that links (i, j) connect it with."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        was = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == was).all():
            break
    return low


def _by_bucket(rows: DataFrame, found: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct links (u, v) of what found connects, as places, in whole buckets in order of bucket and node.

    Every row is linked to the smallest node it is connected with in its bucket, so buckets that hold
    the same rows give the same links.
    """
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "node")

    def ready(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf["node"].to_numpy()
        low = stars(len(nodes), *found(pdf))
        own = np.flatnonzero(low != np.arange(len(nodes)))
        return pd.DataFrame({"u": nodes[own], "v": nodes[low[own]]}).drop_duplicates()

    def fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            same = held and pdf["bucket"].iloc[-1] == held[-1]["bucket"].iloc[-1]
            held.append(pdf)
            if same and pdf["bucket"].iloc[0] == pdf["bucket"].iloc[-1]:
                continue
            whole = pd.concat(held, ignore_index=True)
            done = int(np.searchsorted(whole["bucket"].to_numpy(), whole["bucket"].iloc[-1]))
            if done:
                yield ready(whole.iloc[:done])
            held = [whole.iloc[done:]]
        if held:
            yield ready(pd.concat(held, ignore_index=True))
        tidy()

    return rows.mapInPandas(fit, "u long, v long").distinct()


def _prints(pdf: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(pdf[_PRINT].to_numpy()).view(np.uint64)


def loose(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return loose_links(pdf["bucket"].to_numpy(), pdf["root"].to_numpy(), _prints(pdf))


def exact(similarity: float) -> Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]:
    def found(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        fps, roots, buckets = _prints(pdf), pdf["root"].to_numpy(), pdf["bucket"].to_numpy()
        edges = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True])
        a, b = [], []
        for at, end in zip(edges, edges[1:], strict=False):
            if end - at > 1:
                sets = [np.frombuffer(h, dtype=np.uint64) for h in pdf["hashes"].iloc[at:end]]
                i, j = exact_links(roots[at:end], fps[at:end], sets, similarity)
                a += [at + x for x in i]
                b += [at + x for x in j]
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    return found


def settle(groups: DataFrame, payload: DataFrame, found: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """Links (u, v) that connect, in every group, the rows that found would link if it saw all of the group.

    groups is a written table (group, node, weight); payload has node and what found reads. A group with
    more than PART rows or SHINGLES weight is large. Nodes are hashes: the smallest ones, about LEADERS
    of a group, are its rows that go into every part, and links lead to the smallest node.
    """
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") * 2.0 / PART, F.col("w") * 2.0 / SHINGLES)).cast("int")
    sizes = materialize(sizes.withColumn("p", F.when((F.col("n") <= PART) & (F.col("w") <= SHINGLES), 1).otherwise(parts)), f"{name}-sizes")
    large = small_side(sizes.where("p > 1").select("group", "p", "n"))
    inside = groups.join(large, "group")
    own = inside.select("node", F.xxhash64("group", F.pmod(F.xxhash64("node"), F.col("p"))).alias("bucket"))
    leads = inside.where((F.col("node") / float(1 << 64) + 0.5) * F.col("n") < LEADERS)
    leads = leads.select("node", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p").cast("long") - 1)).alias("k")).select("node", F.xxhash64("group", "k").alias("bucket"))
    small = groups.join(large, "group", "left_anti").join(sizes.where("p = 1").select("group"), "group", "left_semi").select("node", F.xxhash64("group").alias("bucket"))
    dealt = small.unionByName(own.unionByName(leads).distinct())
    links = materialize(_by_bucket(dealt.join(payload, "node").withColumn("root", F.col("node")), found), name)
    if sizes.where("p > 1").isEmpty():
        free(sizes)
        return links
    classes = components(links)
    placed = materialize(inside.join(classes, "node", "left").select("group", "node", "weight", F.coalesce("root", "node").alias("root")), f"{name}-placed")
    each = placed.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    tops = each.groupBy("group").agg(F.max(F.struct("n", "root", F.col("w").alias("wt"))).alias("t"), F.sum("n").alias("n"), F.sum("w").alias("w")).where(F.col("t.n") < F.col("n"))
    p, out_n, out_w = (F.ceil(F.greatest(a * 2.0 / PART, b * 2.0 / SHINGLES)).cast("int") for a, b in ((F.col("n"), F.col("w")), (F.col("n") - F.col("t.n"), F.col("w") - F.col("t.wt")), (F.lit(1), F.lit(0))))
    open_ones = small_side(materialize(tops.select("group", p.alias("p"), out_n.alias("q"), F.col("t.root").alias("top")), f"{name}-open"))
    rest = placed.join(open_ones, "group")
    every = rest.withColumn("j", F.pmod(F.xxhash64("node"), F.col("p"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q").cast("long") - 1)))
    outside = rest.where("root <> top").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("q"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p").cast("long") - 1)))
    met = every.select("node", "root", F.xxhash64("group", "i", "j").alias("bucket")).unionByName(outside.select("node", "root", F.xxhash64("group", "i", "j").alias("bucket"))).distinct()
    more = materialize(_by_bucket(met.join(payload, "node"), found), f"{name}-more")
    free(sizes, placed)
    return links.unionByName(more)


def shingle_sets(rows: DataFrame, size: int = WORDS) -> DataFrame:
    """node, n, same (a digest of the set), f0 to f3 and hashes of rows (node, text)."""

    def made(texts: list[str | None]) -> dict:
        sets = [np.unique(shingle_hashes(t, size)) for t in texts]
        prints = np.array([wide_fingerprint(s) for s in sets], dtype=np.uint64).reshape(-1, 4).view(np.int64)
        blobs = [s.tobytes() for s in sets]
        same = [hashlib.blake2b(b, digest_size=16).digest() for b in blobs]
        return {"n": [len(s) for s in sets], "same": same, "hashes": blobs} | {f: pa.array(prints[:, k]) for k, f in enumerate(_PRINT)}

    return map_texts(rows, made, n="long", same="binary", f0="long", f1="long", f2="long", f3="long", hashes="binary")


def keyed(sets: DataFrame, heavy: np.ndarray, similarity: float) -> DataFrame:
    """(group, node, weight): a row for each prefix key of each set."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [prefix_keys(np.frombuffer(h, dtype=np.uint64), heavy, similarity).view(np.int64) for h in part.column("hashes").to_pylist()]
                nodes = np.repeat(part.column("node").to_numpy(), [len(k) for k in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(nodes)], names=["group", "node"])

    return sets.select("node", "hashes").mapInArrow(fit, "group long, node long").withColumn("weight", F.lit(1))


def similar_classes(docs: DataFrame, text_col: str = "text", uid_col: str = "__uid", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the rows that have a near duplicate; node is the row's uid.

    Whole shingle sets are on disk only until the keys are taken. Those of rows in loose classes are
    made again from the texts, so comparing them moves these rows and no others.
    """
    rows = docs.select(F.col(uid_col).alias("node"), F.col(text_col).alias("text"))
    every = materialize(shingle_sets(rows, size), "sets")
    equal = materialize(every.groupBy("same").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").select("same", "v"), "equal")
    copies = materialize(every.join(small_side(equal), "same").where("node <> v").select(F.col("node").alias("u"), "v"), "copies")
    sets = every.join(small_side(copies).select(F.col("u").alias("node")), "node", "left_anti")
    keys = materialize(keyed(sets, np.zeros(0, dtype=np.uint64), similarity), "keys")
    with shuffles_freed(docs.sparkSession):
        often = keys.groupBy("group").count().where(F.col("count") > PART).orderBy(F.desc("count"), "group").limit(HEAVY).select("group").toPandas()
    if len(often):
        free(keys)
        keys = materialize(keyed(sets, np.sort(often["group"].to_numpy().view(np.uint64)), similarity), "keys")
    prints = materialize(sets.select("node", "n", *_PRINT), "prints")
    free(every)
    near = components(settle(keys, prints.select("node", *_PRINT), loose, "loose"))
    free(keys)
    groups = materialize(prints.select("node", "n").join(near, "node").select(F.col("root").alias("group"), "node", F.col("n").alias("weight")), "near")
    again = rows.join(small_side(groups.select("node")), "node", "left_semi")
    whole = materialize(shingle_sets(again, size).select("node", "hashes", *_PRINT), "compared")
    links = settle(groups, whole, exact(similarity), "exact")
    classes = components(links.unionByName(copies))
    free(prints, groups, whole)
    return classes


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one row (the smallest id) of each class of near duplicates."""
    uid = fresh(docs, "__uid")
    marked = with_row_uid(docs, uid)
    classes = similar_classes(marked, text_col, uid, size, similarity)
    ids = marked.select(F.col(uid).alias("node"), F.col(id_col).alias("id")).join(classes, "node")
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("b")).select("root", F.col("b.node").alias("best"))
    node, own = fresh(marked, "__node"), fresh(marked, "__own")
    gone = small_side(materialize(ids.join(best, "root").where("node <> best").select(F.col("node").alias(node), F.col("id").alias(own)), "gone"))
    return marked.join(gone, (F.col(uid) == F.col(node)) & F.col(id_col).eqNullSafe(F.col(own)), "left_anti").select(*docs.columns)

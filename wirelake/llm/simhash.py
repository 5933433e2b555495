"""SimHash near-duplicates found with pivot distance tables.

A document's fingerprint has bit b set when b is set in over half of its shingles' XXH64 hashes.
Distinct fingerprints are dealt into buckets by equal bit blocks: with max_bits + 1 blocks, two
fingerprints that differ in at most max_bits bits agree on one block at least. Inside a bucket a
table of Hamming distances to fixed reference fingerprints is computed; a pair whose distances to
some reference differ by more than max_bits can't be near (triangle inequality) and is discarded,
and survivors are verified by their own distance. Buckets are made narrower (blocks of blocks) as
the table grows, and one that is still large is split into pairs of parts, so no task gets an
unbounded group and no link is lost. A large part gives a spanning forest of its links, not all
pairs, which is what components need.

Cases: a null text counts as empty; texts without words have fingerprint zero, linked like any
other. Rows that repeat an id or a text share a component. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import fresh, map_texts, materialize, with_row_uid
from wirelake.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
PART = 1024
SMALL = 48
N_PIVOTS = 16


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined runs of size words; the whole sequence when there are fewer words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - size]]
    return [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :], strict=True)]


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text."""
    one = xxhash.xxh64_intdigest
    parts = shingles(text, size)
    if not parts:
        return 0
    hashes = np.array([one(p, SEED) for p in parts], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        counts += np.unpackbits(hashes[at : at + 16384, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long), with the columns of keep."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(text_col).alias("text"))

    def made(texts: list[str | None]) -> dict:
        return {"fp": pa.array(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))}

    return map_texts(rows, made, fp="long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(mask, width) of max_bits + 1 blocks of the 64 bits."""
    edges = np.linspace(0, 64, max_bits + 2).round().astype(int)
    return [(((1 << int(b)) - 1) ^ ((1 << int(a)) - 1), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def masks(n: int, max_bits: int, part: int = PART) -> list[int]:
    """Bit masks such that near fingerprints agree on one of them; more bits for more rows."""
    found, bits = [m for m, _ in _blocks(max_bits)], 64 // (max_bits + 1)
    while n >> bits > part // 8 and bits < 40:
        nested = []
        for m in found:
            rest = [1 << b for b in range(64) if not m >> b & 1]
            cut = np.linspace(0, len(rest), max_bits + 2).round().astype(int)
            nested += [m | sum(rest[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        found, bits = sorted(set(nested)), bits + (64 - bits) // (max_bits + 1)
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, n, dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to references."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def _near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those within max_bits: pivots discard, the distance verifies."""
    for k in range(table.shape[1]):
        if not len(i):
            break
        stay = np.abs(table[i, k] - table[j, k]) <= max_bits
        i, j = i[stay], j[stay]
    stay = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return i[stay], j[stay]


def _forest(fps: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs of one group: what was reached is not compared again."""
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            _, j = _near(fps, table, np.full(len(left), x), left, max_bits)
            if len(j):
                links += [(x, y) for y in j]
                reached += list(j)
                left = np.setdiff1d(left, j, assume_unique=True)
    return links


def links_of_sorted(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Near links inside runs of equal keys: all pairs of small runs, a forest of larger ones."""
    table = distance_table(fps, pivots())
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[edges, len(keys)])
    of = np.repeat(size, size)
    a, b = [], []
    for step in range(1, SMALL):
        i = np.flatnonzero((of[:-step] > step) & (of[:-step] <= SMALL) & (keys[:-step] == keys[step:])) if step < len(keys) else np.array([], dtype=int)
        if not len(i):
            break
        i, j = _near(fps, table, i, i + step, max_bits)
        a.append(fps[i])
        b.append(fps[j])
    for at, n in zip(edges[size > SMALL], size[size > SMALL], strict=True):
        for i, j in _forest(fps[at : at + n], table[at : at + n], max_bits):
            a.append(fps[at + i : at + i + 1])
            b.append(fps[at + j : at + j + 1])
    none = [np.array([], dtype=np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def near_links(fps: DataFrame, max_bits: int = 4, part: int = PART) -> DataFrame:
    """Links (u, v) that connect every two distinct fingerprints within max_bits bits.

    fps has one row per distinct fingerprint. All links of small buckets and a spanning forest of
    each larger part are returned, so components are exact.
    """
    spark = fps.sparkSession
    wanted = masks(fps.count(), max_bits, part)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(wanted)])).alias("b")).select("fp", "b.*")
    sizes = keyed.groupBy("band", "value").count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(part)).cast("int")
    dealt = keyed.join(sizes, ["band", "value"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp", "band"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("fp", F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "fp")

    def fit(batches):
        keys, vals = np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
        for pdf in batches:
            keys, vals = np.r_[keys, pdf["bucket"].to_numpy()], np.r_[vals, pdf["fp"].to_numpy().view(np.uint64)]
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                a, b = links_of_sorted(keys[:done], vals[:done], max_bits)
                yield pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})
                keys, vals = keys[done:], vals[done:]
        if len(keys):
            a, b = links_of_sorted(keys, vals, max_bits)
            yield pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})

    return dealt.mapInPandas(fit, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, fp, component_id (the smallest id of the component) and the columns of keep, per row."""
    rows = materialize(with_fingerprints(docs, id_col, text_col, size, keep), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(near_links(nodes.select("fp"), max_bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialize(named.join(low, "root").select("fp", "component_id"), "classes")
    return rows.join(of, "fp")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of docs of which one of each component stays: the first row of its smallest id."""
    uid = fresh(docs, "__uid")
    marked = with_row_uid(docs, uid)
    found = near_duplicates(marked, id_col, text_col, size, max_bits, (uid,))
    kept = fresh(marked, "__kept")
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min(uid).alias(kept)).select(kept)
    return marked.join(stay, F.col(uid) == F.col(kept), "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

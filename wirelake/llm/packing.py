"""Pattern packing by non-negative least squares.

Documents become token pieces of at most ``size`` ids. Of the pieces only the histogram of lengths
(one number for each of ``size`` lengths) reaches the driver. There, patterns of up to three
lengths that fill a sequence exactly are enumerated, non-negative least squares finds how often to
repeat each so that the histogram is used up, the counts are rounded down, and what is left is
packed best-fit, longest first, by count. The plan lists for each length which of its pieces, by
rank, go to which sequences and offsets; ranks are counted in hash buckets of each length, so a
length that a third of the pieces share is split.

Cases: a null or empty text is the end token alone. Ties in rank go by id and piece, and rows that
repeat an id are packed as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import TEXTS_AT_ONCE, extended, materialize, small_batches
from wirelake.llm.tokens import encoder, special_tokens

SIZE = 1024
END = 2


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than size."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; the ids (binary) on request."""
    small_batches(docs.sparkSession)
    specials = tuple(special_tokens(path).items())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def fit(batches):
        encode = encoder(path, specials)
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(first, TEXTS_AT_ONCE)
                row, piece, start, length, crc, raws = [], [], [], [], [], []
                for r, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                    for k, (at, n) in enumerate(cut(len(ids), size)):
                        raw = ids[at : at + n].tobytes()
                        row.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw))
                        if with_ids:
                            raws.append(raw)
                made = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(made + [pa.array(raws, pa.binary())] * with_ids, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(fit, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to three of the given lengths (0: none) that sum to size."""
    has = np.zeros(size + 1, dtype=bool)
    has[lengths] = True
    out = [np.array([[0, 0, size]])] if has[size] else []
    lengths = lengths[lengths < size]
    pair = lengths[(lengths * 2 >= size) & has[size - lengths]]
    out.append(np.stack([np.zeros_like(pair), size - pair, pair], axis=1))
    for a in lengths:
        c = lengths[(lengths >= a) & (size - a - lengths >= lengths)]
        c = c[has[size - a - c]]
        out.append(np.stack([np.full_like(c, a), c, size - a - c], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=int)


def least_squares(found: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that brings the lengths used, sum of x over patterns, close to the histogram.

    Accelerated projected gradient on the weighted squares; a length weighs as its share of tokens,
    so that long pieces, which are hard to place later, are used up first.
    """
    n, size = len(found), len(histogram)
    if not n:
        return np.zeros(0)
    weight = 0.1 + 0.9 * np.arange(size) / size
    target, flat = histogram * weight, found.ravel()
    w = np.where(flat > 0, weight[flat], 0.0).reshape(found.shape)

    def used(x):
        return np.bincount(flat, weights=(w * x[:, None]).ravel(), minlength=size)

    norm, probe = 1.0, np.random.default_rng(0).random(n)
    for _ in range(20):
        probe = (w * used(probe)[found]).sum(axis=1)
        norm = np.linalg.norm(probe)
        probe /= max(norm, 1e-12)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - (w * (used(y) - target)[found]).sum(axis=1) / (norm * 1.02))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def best_fit(left: dict[int, int], bins: dict[int, dict[tuple, int]]) -> None:
    """Put the lengths left (by count), longest first, where they leave the least space.

    bins: free space -> pattern -> count; changed in place.
    """
    size = max(bins)
    for length in sorted(left, reverse=True):
        todo = left[length]
        for space in sorted(s for s in bins if s >= length and s < size):
            while todo and bins[space]:
                pattern, n = bins[space].popitem()
                take = min(n, todo)
                if n > take:
                    bins[space][pattern] = n - take
                fits, todo = 1, todo - take
                while space - length * (fits + 1) >= 0 and todo >= take:
                    fits, todo = fits + 1, todo - take
                to = bins.setdefault(space - fits * length, {})
                grown = pattern + (length,) * fits
                to[grown] = to.get(grown, 0) + take
            if not todo:
                break
        each = size // length
        for fits, n in ((each, todo // each), (todo % each, 1)):
            if fits and n:
                to = bins.setdefault(size - fits * length, {})
                grown = (length,) * fits
                to[grown] = to.get(grown, 0) + n


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple, int]]:
    """(lengths of a sequence, how many such sequences); uses the histogram up exactly."""
    left = histogram.astype(np.int64).copy()
    found = patterns(np.flatnonzero(left), size)
    x = np.floor(least_squares(found, histogram.astype(float)) + 1e-6).astype(np.int64)
    bins: dict[int, dict[tuple, int]] = {size: {}, 0: {}}
    for k in np.argsort(-x, kind="stable"):
        if not x[k]:
            break
        lengths = tuple(int(v) for v in found[k][::-1] if v)
        need = {v: lengths.count(v) for v in lengths}
        n = min([int(x[k]), *(int(left[v]) // m for v, m in need.items())])
        if n:
            for v, m in need.items():
                left[v] -= n * m
            bins[0][lengths] = bins[0].get(lengths, 0) + n
    best_fit({int(v): int(left[v]) for v in np.flatnonzero(left)}, bins)
    return [(p, n) for space in sorted(bins) for p, n in bins[space].items()]


def slots(chosen: list[tuple[tuple, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), first sequence and offset of each run of ranks."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in chosen:
        at = 0
        for v in lengths:
            rows.append(((v << 40) + rank[v], sequence, at))
            rank[v] += n
            at += v
        sequence += n
    table = np.array(sorted(rows) or np.zeros((0, 3)), dtype=np.int64)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    counted = found.groupBy("length").count().collect()
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in counted:
        histogram[r["length"]] = r["count"]
    keys, sequences, offsets = slots(plan(histogram, size))
    buckets = max(32, int(histogram.sum()) // 50_000)
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches):
        for batch in batches:
            key = (batch.column("length").to_numpy() << 40) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            made = [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "sequence_id", "offset"])

    names = found.columns
    rows = ranked.select(*names, F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(place, extended(found.schema, sequence_id="long", offset="long"))


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    return pack(materialize(pieces(docs, path, id_col, text_col, size, end), "pieces"), size)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

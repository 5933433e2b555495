"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is cut into blocks of whole documents. A block's positions are indexed by the hash of
the window of ``window`` words that starts there; the index of all blocks is dealt over reference
parts by that hash, as columnar blobs, so the shuffle moves a few bytes a word. Every document is
parsed greedily against all parts: a window's reference is the earliest position in (document,
start) order with the same words, consecutive windows with consecutive references extend one
factor, and at a factor's boundary the next reference is looked up. Factors are thus at least
``window`` words long, the overlap of two factors at a boundary is covered by both, and the words
that factors cover are the duplicate spans.

A block first looks up its own windows, so a passage that a third of all documents share leaves
each block once and its index entries never meet in one task.

Cases: a null text has no words. Null ids sort last. Rows that repeat an id are the same document:
their windows at the same start don't remove each other. Texts shorter than a window keep all
words. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import TEXTS_AT_ONCE, fresh, materialize, small_batches, tidy, with_row_uid

WINDOW = 20
BLOCK_WORDS = 2_000_000
PART_BYTES = 12 << 20
LAST = np.iinfo(np.int64).max
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, all words at once."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = _BLANK[raw]
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    codes = _mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[raw]
    codes[blank] = 0
    place = np.arange(len(raw), dtype=np.int64)
    inside = np.repeat(starts, lengths)
    at = np.flatnonzero(~blank)
    table = _powers(int(lengths.max()), _B)
    codes[at] *= table[place[at] - inside]
    sums = np.add.reduceat(codes, starts)
    return _mix(sums ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each run of window word hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        out *= _B
        out += words[k : k + n]
    return _mix(out)


def _pack(*columns: np.ndarray) -> bytes:
    body = b"".join(struct.pack("<BI", np.dtype(c.dtype).itemsize, len(c)) + c.tobytes() for c in columns)
    return zlib.compress(body, 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    body, at, out = zlib.decompress(blob), 0, []
    while at < len(body):
        width, n = struct.unpack_from("<BI", body, at)
        out.append(np.frombuffer(body, dtype={1: np.uint8, 4: np.uint32, 8: np.int64}[width], count=n, offset=at + 5))
        at += 5 + width * n
    return out


def _earlier(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of entries whose hash occurs at an earlier (doc, start), and of the earliest one."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    many = np.r_[same, False] | np.r_[False, same]
    order, h = order[many], h[many]
    if not len(order):
        return order, order
    fine = np.lexsort((start[order], doc[order], h))
    order, h = order[fine], h[fine]
    first = np.r_[True, h[1:] != h[:-1]]
    of = order[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
    later = (doc[order] > doc[of]) | ((doc[order] == doc[of]) & (start[order] > start[of]))
    return order[later], of[later]


def _flush(block: list, window: int, parts: int, number: int):
    """Index rows of one block: its documents, what it found in itself, and a blob for each part.

    The first row's part is beyond the parts that answer; it passes through the same shuffle.
    """
    ids, uids, texts = zip(*block, strict=True)
    ids, uids = np.array(ids, dtype=np.int64), np.array(uids, dtype=np.int64)
    hashes = [window_hashes(word_hashes(t), window) for t in texts]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    row = np.repeat(np.arange(len(ids), dtype=np.int64), counts)
    start = np.arange(len(row), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    doc = ids[row]
    mine, ref = _earlier(h, doc, start)
    name = (TaskContext.get().partitionId() << 24) | number
    yield name, parts + name % parts, _pack(ids, uids, row[mine].astype(np.uint32), start[mine].astype(np.uint32), doc[ref], start[ref].astype(np.uint32))
    left = np.ones(len(h), dtype=bool)
    left[mine] = False
    h, row, start = h[left], row[left], start[left]
    part = (h % np.uint64(parts)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for k in range(parts):
        own = order[bounds[k] : bounds[k + 1]]
        if len(own):
            r, s = row[own], start[own]
            fresh = np.r_[True, r[1:] != r[:-1]]
            step = np.where(fresh, s, np.r_[0, s[1:] - s[:-1]])
            docs_here, sizes = r[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(r)])
            yield name, k, _pack(docs_here.astype(np.uint32), ids[docs_here], sizes.astype(np.uint32), step.astype(np.uint32), h[own].view(np.int64))


def index(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """(block, part, blob) of docs (id, uid, text as binary)."""

    def fit(batches):
        block, size, number = [], 0, 0
        for pdf in batches:
            for i, u, t in zip(pdf["id"].fillna(LAST).astype("int64"), pdf["uid"], pdf["text"], strict=True):
                block.append((i, u, t or b""))
                size += len(t or b"")
                if size >= BLOCK_WORDS * 6:
                    yield pd.DataFrame(list(_flush(block, window, parts, number)), columns=["block", "part", "blob"])
                    block, size, number = [], 0, number + 1
        if block:
            yield pd.DataFrame(list(_flush(block, window, parts, number)), columns=["block", "part", "blob"])
        tidy()

    return docs.mapInPandas(fit, "block long, part int, blob binary")


def look_up(entries: DataFrame, parts: int) -> DataFrame:
    """Each part answers its entries: blobs (row, start, ref doc, ref start) by block; part -1 is a block's own row."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] >= parts:
            return pdf.assign(part=-1)
        hs, docs, starts, rows, blocks = [], [], [], [], []
        for k, blob in enumerate(pdf["blob"]):
            r, ids, sizes, step, h = _unpack(blob)
            first = np.cumsum(sizes.astype(np.int64)) - sizes
            total = np.cumsum(step.astype(np.int64))
            base = np.repeat(total[first] - step[first], sizes)
            hs.append(h.view(np.uint64))
            starts.append(total - base)
            docs.append(np.repeat(ids, sizes))
            rows.append(np.repeat(r, sizes))
            blocks.append(np.full(len(h), k, dtype=np.uint32))
        h, doc, start, row, block = map(np.concatenate, (hs, docs, starts, rows, blocks))
        hit, ref = _earlier(h, doc, start)
        fine = np.lexsort((start[hit], row[hit], block[hit]))
        hit, ref = hit[fine], ref[fine]
        out, names = [], pdf["block"].to_numpy()
        cuts = np.searchsorted(block[hit], np.arange(len(names) + 1))
        for k, name in enumerate(names):
            a, b = hit[cuts[k] : cuts[k + 1]], ref[cuts[k] : cuts[k + 1]]
            if len(a):
                out.append((name, 0, _pack(row[a], start[a].astype(np.uint32), doc[b], start[b].astype(np.uint32))))
        return pd.DataFrame(out, columns=["block", "part", "blob"])

    return entries.groupBy("part").applyInPandas(fit, "block long, part int, blob binary")


def greedy_factors(start: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int) -> np.ndarray:
    """(start, length, ref_doc, ref_start) of the factors of one document, in order."""
    if not len(start):
        return np.zeros((0, 4), dtype=np.int64)
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_start[1:] != ref_start[:-1] + 1)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(start)] - 1
    return np.stack([start[at], start[last] - start[at] + window, ref_doc[at], ref_start[at]], axis=1)


def _by_block(window: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        got = {int(p): b for p, b in zip(pdf["part"], pdf["blob"], strict=True) if p < 0}
        ids, uids, row, start, ref_doc, ref_start = _unpack(got[-1])
        cols = [[row], [start], [ref_doc], [ref_start]]
        for p, blob in zip(pdf["part"], pdf["blob"], strict=True):
            if p >= 0:
                for into, c in zip(cols, _unpack(blob), strict=True):
                    into.append(c)
        row, start, ref_doc, ref_start = (np.concatenate(c).astype(np.int64) for c in cols)
        order = np.lexsort((start, row))
        row, start, ref_doc, ref_start = row[order], start[order], ref_doc[order], ref_start[order]
        cuts = np.searchsorted(row, np.arange(len(ids) + 1))
        out = []
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            f = greedy_factors(start[a:b], ref_doc[a:b], ref_start[a:b], window)
            out.append((ids[k], uids[k], zlib.compress(f.tobytes(), 1)))
        return pd.DataFrame(out, columns=["id", "uid", "factors"])

    return fit


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, uid and the zlib-packed int64 factors (start, length, ref_doc, ref_start) of each row that has any.

    docs has id (long), uid (long) and text (binary).
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, math.ceil(total / PART_BYTES))
    found = look_up(index(docs.withColumn("id", F.coalesce("id", F.lit(int(LAST)))), window, parts), parts)
    return materialize(found.groupBy("block").applyInPandas(_by_block(window), "id long, uid long, factors binary"), "factors")


def unpack_factors(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=np.int64).reshape(-1, 4) if blob else np.zeros((0, 4), dtype=np.int64)


def covered(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words some factor covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, found[:, 0], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept_text and factors of every row."""
    small_batches(docs.sparkSession)
    uid = fresh(docs, "__uid")
    marked = with_row_uid(docs, uid)
    rows = marked.select(F.col(id_col).cast("long").alias("id"), F.col(uid).alias("uid"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = factors(rows, window).select(F.col("id").alias("f_id"), F.col("uid").alias("f_uid"), "factors")
    both = rows.join(found, (rows["uid"] == found["f_uid"]) & (F.coalesce(rows["id"], F.lit(int(LAST))) == found["f_id"]), "left").select("id", "text", "factors")

    names = ["id", "n_words", "n_removed", "kept", "factors"]

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                out = []
                for text, blob in zip(batch.column("text").to_pylist(), batch.column("factors").to_pylist(), strict=True):
                    words, gone = (text or b"").split(), None
                    if blob is not None:
                        gone = covered(len(words), unpack_factors(blob))
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    removed = 0 if gone is None else int(gone.sum())
                    out.append((len(words) + removed, removed, b" ".join(words)))
                made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *made, batch.column("factors")], names=names)
        tidy()

    return both.mapInArrow(cut, "id long, n_words long, n_removed long, kept binary, factors binary")


def query(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network predicts every word of a text from the ``SIDE`` words on either side of it, the word
itself being masked: neighbours are embedded, a hidden layer sees all of them with their places,
and a two-level softmax gives the probability of the word's class and of the word within its class.
A document's score is the sum of these conditional log-probabilities over all its words.

The vocabulary comes from counts over all documents and grows with their number of words. A word
outside it is predicted as unknown and then spelled: a model of byte pairs, counted over all such words,
gives its bytes and its end, so every word has a probability of its own and all of them sum to one.

Training is by rounds of local gradient descent: each task starts from the same weights, goes over its
own documents (every ``STRIDE``-th word is a target, from a place that differs by document and moves by
one each round, so over the rounds every word is a target once), and returns its weights; these are
averaged by their numbers of targets along a tree, so no task and not the driver gets more than
``FAN_IN`` of them. The result thus depends on how the input is dealt over tasks. Texts are split and
spelled once: their words' ids are written to the shared folder, for the rounds and the scores.

Cases: a null or empty text has no words, a sum of 0 and no mean. Rows that repeat an id are scored
each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import free, map_texts, materialize, small_batches

SIDE = 2
GROWTH = 0.7
DIM = 16
HIDDEN = 32
ROUNDS = 2
STRIDE = ROUNDS
RATE = 0.05
FAN_IN = 32
UNKNOWN, EDGE = 0, 1
STEP = 8192
CHUNK = 65536
ROWS = 2048  # of softmax input at once, so that it stays in a core's cache
SAFE = 80.0  # exp(-SAFE) is an ordinary 32-bit number
END = 255  # no byte of a text in UTF-8


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def classes_for(words: int) -> int:
    """How many classes, each of as many words, a corpus of so many words gets."""
    return max(8, int(GROWTH * words**0.25))


def byte_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte of words (that hold no space) and the one after it, with END around every word; where each word's pairs start."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode(), dtype=np.uint8).copy()
    ends = np.flatnonzero(codes == ord(" "))
    codes[ends] = END
    return codes[:-1], codes[1:], ends[:-1]


class Vocabulary:
    """Word ids from 2 on, their counts by id, and the spelling of all other words."""

    def __init__(self, ids: dict[str, int], counts: np.ndarray, pairs: np.ndarray):
        self.ids, self.counts = ids, counts
        self.classes = int(round(len(counts) ** 0.5))
        by = pairs + 0.01
        self.spelling = np.log(by / by.sum(axis=1, keepdims=True))

    def spelled(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word's bytes and its end."""
        if not words:
            return np.zeros(0)
        a, b, starts = byte_pairs(words)
        return np.add.reduceat(self.spelling.ravel().take(a.astype(np.intp) << 8 | b), starts)

    def encode(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(UNKNOWN)), dtype=np.int32, count=len(words))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts over all documents (text)."""
    small_batches(docs.sparkSession)

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(words_of(text))
            if len(seen) > 400_000:
                yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})

    counted = materialize(docs.select("text").mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    side = classes_for(total)
    top = counted.orderBy(F.desc("n"), "w").limit(side * side - 2).collect()
    ids = {r["w"]: k for k, r in enumerate(top, 2)}
    counts = np.ones(side * side, dtype=np.float64)
    counts[2 : 2 + len(top)] = [r["n"] for r in top]
    counts[UNKNOWN] = max(1, total - sum(r["n"] for r in top))

    def spell(batches):
        pairs = np.zeros(1 << 16)
        for pdf in batches:
            rest = pdf[~pdf["w"].isin(ids)]
            if len(rest):
                x, y, starts = byte_pairs(list(rest["w"]))
                sizes = np.diff(np.r_[starts, len(x)])
                pairs += np.bincount(x.astype(np.int64) << 8 | y, weights=np.repeat(rest["n"].to_numpy(float), sizes), minlength=1 << 16)
        at = np.flatnonzero(pairs)
        yield pd.DataFrame({"p": at, "n": pairs[at]})

    pairs = np.zeros(1 << 16)
    for r in counted.mapInPandas(spell, "p int, n double").groupBy("p").agg(F.sum("n").alias("n")).collect():
        pairs[r["p"]] = r["n"]
    pairs = pairs.reshape(256, 256)
    return Vocabulary(ids, counts, pairs)


def id_type(size: int) -> type:
    """The narrowest type of stored word ids of a vocabulary."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def by_words(texts: Iterable) -> Iterator[list]:
    """Texts, as their words or ids, in lists of about CHUNK words."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def contexts(ids: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The neighbours of each place, EDGE beyond the text's ends."""
    padded = np.full(len(ids) + 2 * side, EDGE, dtype=np.int32)
    padded[side : side + len(ids)] = ids
    out = np.empty((len(ids), 2 * side), dtype=np.int32)
    for k in range(2 * side):
        at = k + (k >= side)
        out[:, k] = padded[at : at + len(ids)]
    return out


def targets(ids: np.ndarray, stride: int, seed: int) -> slice:
    """The places of a text that are targets in the round of this seed."""
    return slice((zlib.crc32(ids.tobytes()) + seed) % stride, None, stride)


def summed_products(a: np.ndarray, b: np.ndarray, rows: int = 128) -> np.ndarray:
    """a.T @ b by batches of rows; small products are faster here than one long one."""
    n = len(a) // rows * rows
    if not n:
        return a.T @ b
    out = np.matmul(a[:n].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, rows, b.shape[1])).sum(axis=0)
    return out + a[n:].T @ b[n:] if n < len(a) else out


class WindowNetwork:
    """Weights and steps; word id w belongs to class w % classes at place w // classes."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        f, size = np.float32, len(counts)
        self.classes = n = int(round(size**0.5))
        by = counts.reshape(n, n).T
        self.p = {
            "e": rng.normal(0, 0.3, (size, DIM)).astype(f),
            "w": rng.normal(0, 1 / np.sqrt(2 * SIDE * DIM), (2 * SIDE * DIM, HIDDEN)).astype(f),
            "b": np.zeros(HIDDEN, f),
            "c": np.zeros((HIDDEN, n), f),
            "cb": np.log(by.sum(axis=1) / by.sum()).astype(f),
            "o": np.zeros((n, HIDDEN, n), f),
            "ob": np.log(by / by.sum(axis=1, keepdims=True)).astype(f),
        }
        self._tables = None
        self._ones, self._steps = np.ones(n, f), np.arange(ROWS) * n

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def hidden(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The hidden layer and a one, from a table of each neighbour's share by word and place."""
        out = np.ones((len(x), HIDDEN + 1), dtype=tables[0].dtype)
        for at in range(0, len(x), ROWS):
            near = x[at : at + ROWS]
            a = tables[0].take(near[:, 0], axis=0)
            for k in range(1, 2 * SIDE):
                a += tables[k].take(near[:, k], axis=0)
            np.tanh(a, out=out[at : at + ROWS, :HIDDEN])
        return out

    @staticmethod
    def _with_bias(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights with the bias as a last row, less a shift that keeps exp from overflowing; where it can't underflow to no sum either.

        The hidden layer lies within -1 and 1, so an output is at most the sum of its weights' sizes from its bias.
        """
        reach = np.abs(w).sum(axis=-2)
        top, low = (b + reach).max(axis=-1, keepdims=True), (b - reach).max(axis=-1, keepdims=True)
        return np.concatenate([w, (b - top)[..., None, :]], axis=-2), (top - low)[..., 0] < SAFE

    def _spread(self, h: np.ndarray, w: np.ndarray, safe: bool, at: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax of each row before division and the flat place of ``at`` in it; got takes the output there and the divisors."""
        z = h @ w
        if not safe:
            z -= z.max(axis=1, keepdims=True)
        at = self._steps[: len(z)] + at
        got[0] = z.reshape(-1).take(at)
        np.exp(z, out=z)
        np.matmul(z, self._ones, out=got[1])
        return z, at

    def _log_at(self, h: np.ndarray, w: np.ndarray, safe: bool, at: np.ndarray) -> np.ndarray:
        """Log-softmax of each row at one place."""
        got = np.empty((2, len(h)), dtype=h.dtype)
        for k in range(0, len(h), ROWS):
            self._spread(h[k : k + ROWS], w, safe, at[k : k + ROWS], got[:, k : k + ROWS])
        return got[0] - np.log(got[1])

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by class, and the bounds of each class in it."""
        cls = (y % self.classes).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        return order, np.searchsorted(cls[order], np.arange(self.classes + 1))

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log-probability of each target y given its neighbours x."""
        p, out = self.p, np.empty(len(y), dtype=np.float64)
        if self._tables is None:
            tables = [p["e"] @ p["w"][k * DIM : (k + 1) * DIM] for k in range(2 * SIDE)]
            tables[0] += p["b"]
            self._tables = tables, self._with_bias(p["c"], p["cb"]), self._with_bias(p["o"], p["ob"])
        tables, (wc, safe), (wo, each_safe) = self._tables
        for at in range(0, len(y), CHUNK):
            order, bounds = self._by_class(y[at : at + CHUNK])
            t, h = y[at : at + CHUNK][order], self.hidden(x[at : at + CHUNK][order], tables)
            got = self._log_at(h, wc, safe, t % self.classes)
            place = t // self.classes
            for c in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[c], bounds[c + 1]
                got[a:b] += self._log_at(h[a:b], wo[c], each_safe[c], place[a:b])
            out[at + order] = got
        return out

    def _error(self, h: np.ndarray, w: np.ndarray, safe: bool, at: np.ndarray, got: np.ndarray, g: np.ndarray, dh: np.ndarray, n: int) -> None:
        """What _spread finds in got; gradients of the mean over n of the negative log-probability at one place of each row are added to g (by w) and dh."""
        inner = w[:HIDDEN].T
        for k in range(0, len(h), ROWS):
            part, own = h[k : k + ROWS], got[:, k : k + ROWS]
            z, flat = self._spread(part, w, safe, at[k : k + ROWS], own)
            z.reshape(-1)[flat] -= own[1]
            share = (1 / (n * own[1]))[:, None]
            g += summed_products(part * share, z)
            dh[k : k + ROWS] += (z @ inner) * share

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-probability and its gradients; ``e`` as (ids, rows), each id once."""
        p, n = self.p, len(y)
        order, bounds = self._by_class(y)
        x, y = x[order], y[order]
        e = p["e"].take(x, axis=0).reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), dtype=e.dtype)
        np.tanh(e @ p["w"] + p["b"], out=h[:, :HIDDEN])
        (wc, safe), (wo, each_safe) = self._with_bias(p["c"], p["cb"]), self._with_bias(p["o"], p["ob"])
        gc, go, dh = np.zeros_like(wc), np.zeros_like(wo), np.zeros((n, HIDDEN), dtype=e.dtype)
        first, second = np.empty((2, n), dtype=e.dtype), np.empty((2, n), dtype=e.dtype)
        self._error(h, wc, safe, y % self.classes, first, gc, dh, n)
        place, bounds = y // self.classes, bounds.tolist()
        for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < b:
                self._error(h[a:b], wo[c], each_safe[c], place[a:b], second[:, a:b], go[c], dh[a:b], n)
        loss = sum(float((np.log(total) - picked).sum(dtype=np.float64)) for picked, total in (first, second))
        g = {"c": gc[:-1], "cb": gc[-1], "o": go[:, :-1], "ob": go[:, -1]}
        h = h[:, :HIDDEN]
        da = dh * (1 - h * h)
        g["w"], g["b"] = summed_products(e, da), da.sum(axis=0)
        ids, rows = x.T.ravel().astype(np.intp), (p["w"] @ da.T).reshape(2 * SIDE, DIM, n)
        met = np.flatnonzero(np.bincount(ids))
        g["e"] = (met, np.stack([np.bincount(ids, rows[:, k].ravel())[met] for k in range(DIM)], axis=1).astype(e.dtype))
        return loss / n, g

    def descend(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> float:
        """One Adagrad step."""
        self._tables = None
        loss, g = self.gradients(x, y)
        ids, rows = g.pop("e")
        s = state.setdefault("e", np.full_like(self.p["e"], 1e-8))
        s[ids] += rows * rows
        self.p["e"][ids] -= np.float32(rate) * rows / np.sqrt(s[ids])
        for k, v in g.items():
            s = state.setdefault(k, np.full_like(self.p[k], 1e-8))
            t = v * v
            s += t
            np.divide(v, np.sqrt(s, out=t), out=t)
            t *= np.float32(rate)
            self.p[k] -= t
        return loss

    def packed(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).tobytes()

    def unpacked(self, flat: np.ndarray) -> WindowNetwork:
        """A network of this one's shape with other weights."""
        out, at = WindowNetwork(np.ones(self.classes**2)), 0
        for k in sorted(self.p):
            n = self.p[k].size
            out.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return out


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    n = pdf["n"].to_numpy(dtype=np.float64)
    total = sum(np.frombuffer(blob, dtype=np.float32).astype(np.float64) * (k / n.sum()) for k, blob in zip(n, pdf["weights"], strict=True))
    return pd.DataFrame({"node": [int(pdf["node"].iloc[0]) // FAN_IN], "n": [int(n.sum())], "weights": [total.astype(np.float32).tobytes()]})


def _round(rows: DataFrame, start: WindowNetwork, rate: float, stride: int, seed: int) -> WindowNetwork:
    """Every task descends on its own documents (words, as encoded gives them); the weights come back averaged."""
    kind = id_type(len(start.p["e"]))

    def local(batches):
        own, state, seen = start.unpacked(np.frombuffer(start.packed(), dtype=np.float32)), {}, 0
        xs, ys, held = [], [], 0
        rng = np.random.default_rng(seed)

        def step():
            x, y = np.concatenate(xs), np.concatenate(ys)
            order = rng.permutation(len(y))
            for part in np.array_split(order, max(1, len(y) // STEP)):
                own.descend(x[part], y[part], state, rate)

        for pdf in batches:
            for blob in pdf["words"]:
                t = np.frombuffer(blob, dtype=kind).astype(np.int32)
                if len(t):
                    at = targets(t, stride, seed)
                    xs.append(contexts(t)[at])
                    ys.append(t[at])
                    held += len(ys[-1])
                    if held >= 8 * STEP:
                        step()
                        seen, held, xs, ys = seen + held, 0, [], []
        if held:
            step()
            seen += held
        if seen:
            yield pd.DataFrame({"node": [TaskContext.get().partitionId()], "n": [seen], "weights": [own.packed()]})

    schema = "node long, n long, weights binary"
    got = materialize(rows.select("words").mapInPandas(local, schema), "weights")
    while (left := got.count()) > 1:
        got = materialize(got.withColumn("__g", F.floor(F.col("node") / FAN_IN)).groupBy("__g").applyInPandas(lambda pdf: _average(pdf[["node", "n", "weights"]]), schema), "weights")
        if left <= FAN_IN and got.count() > 1:
            got = got.withColumn("node", F.lit(0).cast("long"))
    last = got.first()
    return start if last is None else start.unpacked(np.frombuffer(last["weights"], dtype=np.float32))


def encoded(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words (the ids of every whole text's words) and spelled (the log-probability of its unknown words' bytes)."""
    rows, kind = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_type(len(words.counts))

    def made(texts: list[str | None]) -> dict:
        blobs, sums = [], []
        for split in by_words(map(words_of, texts)):
            flat = list(chain.from_iterable(split))
            own, cuts = words.encode(flat), np.cumsum([0, *map(len, split)])
            odd, each = own == UNKNOWN, np.zeros(len(own) + 1)
            each[1:][odd] = words.spelled(list(compress(flat, odd.tolist())))
            sums += np.diff(np.cumsum(each)[cuts]).tolist()
            own = own.astype(kind)
            blobs += [own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return {"words": blobs, "spelled": sums}

    return map_texts(rows, made, words="binary", spelled="double")


def _fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, stride: int = STRIDE) -> tuple[Vocabulary, WindowNetwork, DataFrame]:
    """Vocabulary, network and encoded rows of docs (doc_id, text)."""
    words = vocabulary(docs)
    rows, network = materialize(encoded(docs, words), "encoded"), WindowNetwork(words.counts)
    for k in range(rounds):
        network = _round(rows, network, rate / (1 + k), stride, k)
    return words, network, rows


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, stride: int = STRIDE) -> tuple[Vocabulary, WindowNetwork]:
    """Vocabulary and network of docs (text)."""
    words, network, rows = _fit(docs.select("text", F.lit(0).alias("doc_id")), rounds, rate, stride)
    free(rows)
    return words, network


def _scored(rows: DataFrame, network: WindowNetwork) -> DataFrame:
    """Scores of encoded texts."""
    kind = id_type(len(network.p["e"]))

    def made(blobs: list[bytes]) -> dict:
        sums, sizes, unknown = [], [], []
        for own in by_words(np.frombuffer(b, dtype=kind).astype(np.int32) for b in blobs):
            y, x = np.concatenate(own), np.concatenate([contexts(t) for t in own])
            cuts = np.cumsum([0, *map(len, own)])
            total = np.concatenate([[0.0], np.cumsum(network.log_probs(x, y))])
            strange = np.concatenate([[0], np.cumsum(y == UNKNOWN)])
            sums += np.diff(total[cuts]).tolist()
            sizes += np.diff(cuts).tolist()
            unknown += np.diff(strange[cuts]).tolist()
        return {"n_words": sizes, "n_unknown": unknown, "log_prob": sums}

    got = map_texts(rows, made, "words", n_words="long", n_unknown="long", log_prob="double")
    got = got.withColumn("log_prob", F.col("log_prob") + F.col("spelled")).drop("spelled")
    return got.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def score(docs: DataFrame, words: Vocabulary, network: WindowNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_unknown, log_prob (sum) and mean_log_prob of every whole text."""
    return _scored(encoded(docs, words, id_col, text_col), network)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, network, rows = _fit(docs)
    return _scored(rows, network).withColumnRenamed("id", "doc_id")

"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths over byte embeddings, each pooled by its maximum over a window, feed a
softmax over the languages of the labelled rows. A text is cut into windows of ``WINDOW`` bytes
that cover all of it (the last one is filled up with a padding byte); windows are classified in
batches, and a text's distribution is the mean over its windows, weighted by the letters they hold.
For prediction the first layer is tabulated: a filter's response is a sum of table rows, one for
each pair of neighbouring bytes.

The network is fitted on about ``TRAIN_ROWS`` labelled rows for each language (all of them where there
are fewer), chosen by a hash of their id, and of these on windows from the first, middle and last
``TRAIN_CHARS`` characters: both are bounds of the training sample only. Prediction reads whole texts.

Cases: a text that is null or has no letter is ``und`` with score 0. Rows whose language is null are
not learned from. Rows that repeat an id are predicted each. Without labelled rows every text is
``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import map_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
PAD = 0
TRAIN_ROWS = 1500
TRAIN_WINDOWS = 12_000
TRAIN_CHARS = 768
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All of a text's bytes as rows of size; the last row is padded."""
    n = -(-len(data) // size)
    out = np.full(n * size, PAD, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, size)


class ByteNetwork:
    """Embeddings, filters of several widths, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.p["ob"] = np.zeros(len(labels), dtype=np.float32)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch."""
        p, n = self.p, len(x)
        e = p["e"][x]
        hidden, kept = [], []
        for w in WIDTHS:
            m = x.shape[1] - w + 1
            stack = np.concatenate([e[:, k : k + m] for k in range(w)], axis=2)
            z = stack @ p[f"w{w}"] + p[f"b{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0]
            hidden.append(np.maximum(top, 0))
            kept.append((stack, at, top))
        h = np.concatenate(hidden, axis=1)
        logits = h @ p["o"] + p["ob"]
        logits -= logits.max(axis=1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=1, keepdims=True)
        loss = -np.log(q[np.arange(n), y] + 1e-9).mean()
        d = q.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": h.T @ d, "ob": d.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = d @ p["o"].T
        for k, w in enumerate(WIDTHS):
            stack, at, top = kept[k]
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
            chosen = stack[np.arange(n)[:, None], at]
            g[f"w{w}"] = np.einsum("nfd,nf->df", chosen, dz)
            g[f"b{w}"] = dz.sum(axis=0)
            back = (dz[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, DIM)
            for j in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], at + j], back[:, :, j])
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 1) -> ByteNetwork:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                _, g = self._step(x[own], y[own])
                t += 1
                step = rate * 0.6**epoch
                for k, a in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    a -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def _lookup(self):
        """Per width: tables by byte pair, and by a single byte where the width is odd."""
        if self._tables is None:
            e, out = self.p["e"], []
            for w in WIDTHS:
                by = [e @ self.p[f"w{w}"][k * DIM : (k + 1) * DIM] for k in range(w)]
                by[0] = by[0] + self.p[f"b{w}"]
                pairs = [(k, (by[k + 1][:, None] + by[k][None, :]).reshape(65536, FILTERS).astype(np.float32)) for k in range(0, w - 1, 2)]
                out.append((w, pairs, by[w - 1] if w % 2 else None))
            self._tables = out
        return self._tables

    def predict(self, x: np.ndarray, batch: int = 32) -> np.ndarray:
        """Probabilities of windows."""
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        for at in range(0, len(x), batch):
            own = x[at : at + batch]
            pair = own[:, :-1].astype(np.int32) | own[:, 1:].astype(np.int32) << 8
            hidden = []
            for w, pairs, single in self._lookup():
                m = own.shape[1] - w + 1
                z = None
                for k, t in pairs:
                    part = t.take(pair[:, k : k + m], axis=0)
                    z = part if z is None else np.add(z, part, out=z)
                if single is not None:
                    z += single.take(own[:, w - 1 : w - 1 + m], axis=0)
                hidden.append(np.maximum(z.max(axis=1), 0))
            logits = np.concatenate(hidden, axis=1) @ self.p["o"] + self.p["ob"]
            logits -= logits.max(axis=1, keepdims=True)
            q = np.exp(logits)
            out[at : at + batch] = q / q.sum(axis=1, keepdims=True)
        return out


def fit(rows: DataFrame) -> ByteNetwork | None:
    """Train on a bounded sample of labelled rows (id, text, label)."""
    usable = rows.where("label is not null and text is not null")
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    labels = sorted(counts)
    if not labels:
        return None
    shares = [F.when(F.col("label") == k, F.lit(int((1 << 30) * min(1.0, TRAIN_ROWS / n)))) for k, n in counts.items()]
    parts = f"array(substring(text, 1, {TRAIN_CHARS}), substring(text, greatest(1, cast(length(text) / 2 as int)), {TRAIN_CHARS}), substring(text, -{TRAIN_CHARS}, {TRAIN_CHARS}))"
    marked = usable.withColumn("h", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)))
    picked = marked.where(F.col("h") < F.coalesce(*shares)).select("label", "h", "id", F.expr(parts).alias("parts"))
    xs, ys = [], []
    rng = np.random.default_rng(2)
    for r in sorted(picked.collect(), key=lambda r: (r["label"], r["h"], str(r["id"]))):
        for part in r["parts"]:
            data = part.encode()
            if not _LETTER.search(part):
                continue
            at = int(rng.integers(0, max(1, len(data) - WINDOW)))
            xs.append(windows(data[at : at + int(rng.integers(24, WINDOW + 1))])[:1])
            ys.append(labels.index(r["label"]))
    if not xs:
        return None
    x, y = np.concatenate(xs), np.array(ys)
    share = np.bincount(y, minlength=len(labels))
    order = rng.permutation(len(y))
    each = max(TRAIN_WINDOWS // len(labels), 1)
    own = np.concatenate([rng.choice(order[y[order] == k], each) for k in range(len(labels)) if share[k]])
    return ByteNetwork(labels).train(x[own], y[own])


def predict(docs: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred and score of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def classify(texts: list[str | None]) -> dict:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        own = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if network is not None else []
        for at in range(0, len(own), 64):
            some = own[at : at + 64]
            cut = [windows(texts[k].encode()) for k in some]
            x = np.concatenate(cut)
            q = network.predict(x)
            weight = _IS_LETTER[x].sum(axis=1) + 1e-3
            edges = np.cumsum([0, *map(len, cut)])[:-1]
            total = np.add.reduceat(q * weight[:, None], edges, axis=0)
            total /= total.sum(axis=1, keepdims=True)
            for k, row in zip(some, total, strict=True):
                names[k], scores[k] = network.labels[int(row.argmax())], min(1.0, float(row.max()))
        return {"lang_pred": names, "score": scores}

    return map_texts(rows, classify, lang_pred="string", score="double")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = fit(docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    return predict(docs, learned).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")

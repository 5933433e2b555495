"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: compatibility forms, case, accents, look-alike letters of other scripts and
digits or signs that stand for letters. The lexicon holds whole words and word beginnings; a term's
weight is its smoothed log odds between labelled toxic and clean documents, and every term enters that
passes a likelihood ratio test over all labelled rows. Phrases of a term and its neighbour that only clean
documents use are exceptions: a match inside one doesn't count. The weight of the matches, also
taken by the document's length, goes through a logistic curve that is fitted on about
``CALIBRATION_ROWS`` labelled rows (all of them where there are fewer), chosen by a hash of their id.

Cases: a null or empty text has no match and gets the curve's lowest score. Rows without a label,
with a null label or whose labels contradict each other count once for each label. Labels without
documents are ignored. Without any usable label the lexicon is empty and every score is zero. Rows
that repeat an id are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import map_texts, materialize, small_batches, small_side, where_texts

CALIBRATION_ROWS = 50_000
LEAST_G2 = 20.0
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3

_ALIKE = dict(zip("авекмнорстухіјѕԁɡӏзбαβεικνορτυχω", "abekmhopctyxijsdgl36abeikvoptuxw", strict=True))
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_LETTERS = str.maketrans(_ALIKE | {"l": "i", "ß": "s", "ı": "i"})
_STOOD_FOR = str.maketrans(_SIGNS)
_REMEMBERED = 100_000
_LONGEST = 48
_MARKS = re.compile(r"[̀-ͯ​-‏­﻿]+")
_MIXED = re.compile(r"[^\W_]*(?:[0-9@$!|][^\W_]+|[^\W\d_][0-9])[\w@$]*")
_GAPS = re.compile(r"[\W_]+")


def _fold_part(part: str) -> str:
    plain = part.rstrip(".,;:?!")
    if plain.isascii() and plain.isalpha():
        return plain.lower().replace("l", "i")
    t = part.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).lower()
    t = _MIXED.sub(lambda m: m[0].translate(_STOOD_FOR) if re.search(r"[^\W\d_]", m[0]) else m[0], t)
    return _GAPS.sub(" ", t.translate(_LETTERS)).strip()


class _Parts(dict):
    """Folded forms of blank-separated parts; folding never looks past a blank, so they are kept."""

    def __missing__(self, part: str) -> str:
        folded = _fold_part(part)
        if len(part) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[part] = folded
        return folded


_PARTS = _Parts()


def fold(text: str | None) -> str:
    """Folded words, a space before and after each."""
    folded = " ".join(filter(None, map(_PARTS.__getitem__, (text or "").split())))
    return f" {folded} "


def terms(folded: str) -> set[str]:
    """Words (`` word ``) and word beginnings (`` begin``) of a folded text."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    _built: object = None

    def automaton(self):
        if self._built is None and self.weights:
            found = ahocorasick.Automaton()
            for phrase in self.exceptions:
                found.add_word(phrase, (phrase, None))
            for term, w in self.weights.items():
                found.add_word(term, (term, w))
            found.make_automaton()
            self._built = found
        return self._built

    def __getstate__(self):
        return self.__dict__ | {"_built": None}

    def matches(self, folded: str) -> dict[int, tuple[str, float]]:
        """Start of a word -> its heaviest term and weight, outside exception phrases."""
        found, best, spans = self.automaton(), {}, []
        if found is None:
            return best
        for end, (term, w) in found.iter(folded):
            at = end - len(term) + 1
            if w is None:
                spans.append((at, end))
            elif at not in best or best[at][1] < w:
                best[at] = (term, w)
        return {at: x for at, x in best.items() if not any(a <= at <= b - 1 for a, b in spans)} if spans else best

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        raw = math.fsum(w for _, w in self.matches(folded).values())
        return math.log1p(raw), raw / math.sqrt(folded.count(" "))

    def scores(self, x: np.ndarray) -> np.ndarray:
        b, w1, w2 = self.curve
        return 1 / (1 + np.exp(-np.clip(b + w1 * x[:, 0] + w2 * x[:, 1], -30, 30)))


def _counts(rows: DataFrame, of) -> DataFrame:
    """(term, a, b): in how many toxic and clean rows of (text, label) of() has a term."""

    def frame(toxic: Counter, clean: Counter) -> pd.DataFrame:
        names = list(toxic.keys() | clean.keys())
        return pd.DataFrame({"term": names, "a": [toxic[n] for n in names], "b": [clean[n] for n in names]})

    def fit(batches):
        toxic, clean = Counter(), Counter()
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                (toxic if label else clean).update(of(fold(text)))
            if len(toxic) + len(clean) > 400_000:
                yield frame(toxic, clean)
                toxic, clean = Counter(), Counter()
        if toxic or clean:
            yield frame(toxic, clean)
        _PARTS.clear()

    return rows.mapInPandas(fit, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method, weights kept non-negative."""
    design = np.c_[np.ones(len(x)), x]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        ridge = np.diag([1e-6, 0.05, 0.05])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w = w + step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(rows: DataFrame) -> Lexicon:
    """Learn from labelled rows (id, text, label 0/1). Counts cover all rows; the curve a bounded sample."""
    small_batches(rows.sparkSession)
    rows = materialize(rows.where("label is not null"), "labelled")
    n = {r["label"]: r["count"] for r in rows.groupBy(F.col("label").cast("int").alias("label")).count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    total = float(toxic + clean)
    share = toxic / total
    counted = _counts(rows, terms).where(F.col("a") * clean > F.col("b") * toxic)
    a, b, seen = F.col("a").cast("double"), F.col("b").cast("double"), (F.col("a") + F.col("b")).cast("double")

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    g2 = 2 * (part(a, seen * share) + part(b, seen * (1 - share)) + part(F.lit(float(toxic)) - a, (F.lit(total) - seen) * share) + part(F.lit(float(clean)) - b, (F.lit(total) - seen) * (1 - share)))
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    top = counted.withColumn("g2", g2).withColumn("w", odds).where((F.col("g2") >= LEAST_G2) & (F.col("w") > 1.5)).orderBy("term").collect()
    found = Lexicon({r["term"]: float(r["w"]) for r in top})
    if any(r["b"] for r in top):

        def phrases(folded: str) -> set[str]:
            out = set()
            for at, (term, _) in found.matches(folded).items():
                end = folded.find(" ", at + 1)
                before, after = folded.rfind(" ", 0, max(at, 0)) if at else -1, folded.find(" ", end + 1)
                if before >= 0:
                    out.add(folded[before : end + 1])
                if after > 0:
                    out.add(folded[at : after + 1])
            return out

        met = _counts(rows, phrases).where("a = 0 and b >= 5").orderBy("term").collect()
        found = Lexicon(found.weights, frozenset(r["term"] for r in met))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, CALIBRATION_ROWS / total)))
    got = with_features(sample, found, "label").select("f0", "f1", "label").toPandas()
    found.curve = _logistic(got[["f0", "f1"]].to_numpy(float), got["label"].to_numpy(float))
    return found


def with_features(rows: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """f0 and f1 of each row of (text, and the columns of keep)."""

    def made(texts: list[str | None]) -> dict:
        x = np.array([lexicon.features(t) for t in texts], dtype=float).reshape(-1, 2)
        return {"f0": x[:, 0], "f1": x[:, 1]}

    return map_texts(rows.select(*keep, "text"), made, done=_PARTS.clear, f0="double", f1="double")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 from THRESHOLD on) of each row."""

    def made(texts: list[str | None]) -> dict:
        s = lexicon.scores(np.array([lexicon.features(t) for t in texts], dtype=float).reshape(-1, 2))
        return {"score": s, "predicted": (s >= THRESHOLD).astype("int32")}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, made, done=_PARTS.clear, score="double", predicted="int")


def clean_rows(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of docs under THRESHOLD, all their columns."""

    def stay(texts: list[str | None]) -> list[bool]:
        return list(lexicon.scores(np.array([lexicon.features(t) for t in texts], dtype=float).reshape(-1, 2)) < THRESHOLD)

    return where_texts(docs, stay, text_col, done=_PARTS.clear)


def labelled(docs: DataFrame, labels: DataFrame, fold_out: Column | None = None) -> DataFrame:
    """(id, text, label) of labelled documents, without those of the fold that is held out."""
    marks = labels.where("toxic is not null").select(F.col("doc_id").alias("__doc"), F.col("toxic").cast("int").alias("label"))
    rows = docs.where(~fold_out) if fold_out is not None else docs
    rows = rows.select(F.col("doc_id").alias("id"), "text")
    return rows.join(small_side(materialize(marks, "marks")), F.col("id") == F.col("__doc")).select("id", "text", "label")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id")))
    return score(docs, found).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")

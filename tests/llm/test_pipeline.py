"""The corpus pipeline's stages one after another, against plain versions of each."""

import math
import re

import numpy as np
from test_dedup import brute_classes, groups
from test_texts import brute_leaks, placed_well

import corpus_pipeline
from wirelake.llm import decontaminate, toxicity

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def plain_score(text, lexicon):
    """A lexicon's score by looking for every term and exception at every place."""
    folded = toxicity.fold(text)
    places = lambda s: [k for k in range(len(folded)) if folded.startswith(s, k)]
    spans = [(k, k + len(e) - 1) for e in lexicon.exceptions for k in places(e)]
    best = {}
    for term, w in lexicon.weights.items():
        for at in places(term):
            if not any(a <= at <= b - 1 for a, b in spans):
                best[at] = max(best.get(at, 0.0), w)
    raw = math.fsum(best.values())
    b, w1, w2 = lexicon.curve
    return 1 / (1 + math.exp(-float(np.clip(b + w1 * math.log1p(raw) + w2 * raw / math.sqrt(folded.count(" ")), -30, 30))))


def plain_leaks(docs, items, seeds=decontaminate.SEEDS, least=decontaminate.LEAST):
    """As brute_leaks, by one table of all items' places."""
    cut = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    own = {k: cut(t) for k, t in items}
    marks = [[x for x, c in enumerate(m) if c == "1"] for m in seeds]
    table = {}
    for k, words in own.items():
        for s, (m, at) in enumerate(zip(seeds, marks, strict=True)):
            for q in range(len(words) - len(m) + 1):
                table.setdefault((s, *(words[q + x] for x in at)), []).append((k, q))
    out = set()
    for d, text in docs:
        words = cut(text)
        hits = {(k, p - q) for s, (m, at) in enumerate(zip(seeds, marks, strict=True)) for p in range(len(words) - len(m) + 1) for k, q in table.get((s, *(words[p + x] for x in at)), ())}
        for k, g in hits:
            run = best = 0
            for i in range(max(0, -g), min(len(own[k]), len(words) - g)):
                run = max(run, 0) + (1 if words[g + i] == own[k][i] else -4)
                best = max(best, run)
            if best >= least:
                out.add(d)
    return out


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = docs.select("doc_id", "text")
    lexicon = toxicity.fit(toxicity.labelled(source, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.held_out("doc_id")))
    left = sorted((r.doc_id, r.text) for r in source.collect())
    texts, names = dict(left), docs.columns
    left = [(d, t) for d, t in left if plain_score(t, lexicon) < toxicity.THRESHOLD]
    wanted = [{d for d, _ in left}]
    stay = {min(own, key=lambda r: (-len(r[1] or ""), r[0]))[0] for own in groups(left).values()}
    left = [(d, t) for d, t in left if d in stay]
    wanted.append({d for d, _ in left})
    roots, low = brute_classes(left), {}
    for (d, _), r in zip(left, roots, strict=True):
        low.setdefault(r, d)
    left = [(d, t) for d, t in left if d in set(low.values())]
    wanted.append({d for d, _ in left})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = plain_leaks(left, items)
    assert all(len(re.findall(r"\w+", t)) > 10 for _, t in items) and {d for d, _ in brute_leaks(left[:60], items)} == leaks & {d for d, _ in left[:60]}
    wanted.append({d for d, _ in left} - leaks)
    assert len(texts) > len(wanted[0]) > len(wanted[1]) >= len(wanted[2]) > len(wanted[3]) > 0
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        rows = docs.collect()
        assert docs.columns == names and len(rows) == len(want)
        assert {r.doc_id for r in rows} == want, name
        assert all(r.text == texts[r.doc_id] for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == wanted[-1]
    placed_well(last)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last)


def test_an_empty_table_passes_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), SMALL)
    assert docs.count() == 0


def test_odd_rows_pass_through(spark, tmp_path):
    """Null and repeated ids, null texts, a very long text, and columns with the names that stages use."""
    big, body = (1 << 60) + 1, " ".join(f"w{k}" for k in range(40))
    rows = [(big, body, 1, "a"), (None, "other words that stand alone here", 2, "b"), (3, None, 3, None), (3, "", 4, "c"), (5, "more " * 30000, 5, "d"), (6, body.upper() + " tail", 6, "e"), (big, body, 7, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __uid int, node string").coalesce(1)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), SMALL)
        assert docs.columns == names
    kept = docs.collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept) == sorted([(0, len(rows[1][1])), (3, 0), (5, 150000), (6, len(body) + 5)]) and re.fullmatch(r"W.*tail", next(r.text for r in kept if r.doc_id == 6))

"""Exact, substring and near duplicates against brute force on small tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from wirelake.llm import components, exact_dedup, similar, simhash, substring_dedup

SCHEMA = "doc_id long, text string, digest int, uid string"
ODD = [(1, None, 1, "a"), (2, "", 2, "b"), (3, " \t\n", None, None), (4, "one two", 4, "d"), (4, "one two", 4, "d"), (5, "onetwo", 5, "e"), (6, "o n e t w o", 6, "f"), (None, "alone", 7, "g"), (7, "word " * 30000, 8, "h")]


def groups(rows):
    by = {}
    for r in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    return by


def test_exact_dedup_of_odd_rows(stored):
    got = exact_dedup.exact_dedup(stored(ODD, SCHEMA)).collect()
    assert len(got) == len(ODD)
    for norm, rows in groups(ODD).items():
        digest = hashlib.sha256(norm.encode()).digest()
        own = [r for r in got if bytes(r.digest) == digest]
        assert len(own) == len(rows) and all(r.group_size == len(rows) for r in own)
        best = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        assert {r.keep_id for r in own} == {best[0]}
        assert sum(r.kept for r in own) == 1


def test_exact_dedup_splits_texts_that_share_a_digest(spark, stored, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda col, bits: exact_dedup.F.lit("00"))
    got = exact_dedup.exact_dedup(stored([(1, "a", 0, ""), (2, "b", 0, ""), (3, "a ", 0, "")], SCHEMA)).collect()
    monkeypatch.undo()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)}


def test_exact_dedup_splits_a_shared_digest_beside_null_and_repeated_ids(spark, stored, monkeypatch):
    rows = [(None, "b b", 0, ""), (None, "bb", 0, ""), (4, " bb", 0, ""), (4, "bb ", 0, ""), (7, None, 0, ""), (2, "", 0, ""), (9, "b", 0, "")]
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda col, bits: exact_dedup.F.lit("00"))
    got = exact_dedup.exact_dedup(stored(rows, SCHEMA)).collect()
    monkeypatch.undo()
    assert sorted((r.id or 0, r.keep_id, r.group_size) for r in got) == [(0, 4, 4), (0, 4, 4), (2, 2, 2), (4, 4, 4), (4, 4, 4), (7, 2, 2), (9, 9, 1)]
    assert sorted(r.id for r in got if r.kept) == [2, 4, 9]


def test_exact_dedup_keeps_columns_and_takes_empty_tables(stored):
    docs = stored(ODD, SCHEMA)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups(ODD))
    assert exact_dedup.exact_dedup(docs.where("doc_id < 0")).count() == 0


def brute_substrings(docs, window):
    seen, out = set(), {}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in docs}
    for k in sorted(words):
        w, gone = words[k], set()
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if key in seen:
                gone.update(range(at, at + window))
            seen.add(key)
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substrings_against_brute_force(stored, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 60)
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(45)]
    docs = [(k, " ".join([*(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(40))), *passage[(a := rng.randrange(20)) : a + rng.randrange(26)], *["rep"] * rng.choice([0, 25])])) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "  x y"), (63, "long " * 2000)]
    got = substring_dedup.substring_dedup(stored([(*d, 0, "") for d in docs], SCHEMA)).collect()
    assert {r.id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got} == brute_substrings(docs, 20)


def test_substrings_of_odd_rows(stored):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text, 1, "a"), (2**60 + 1, text, 2, "b"), (-(2**60) - 1, None, None, None), (5, "word " * 30000, 3, "c"), (5, "word " * 30000, 3, "c")]
    got = sorted(substring_dedup.substring_dedup(stored(rows, SCHEMA.replace("digest", "uid").replace("uid string", "blob string"))).collect(), key=lambda r: (r.id is None, r.id or 0, r.n_removed))
    assert [(r.id, r.n_words, r.n_removed) for r in got] == [(-(2**60) - 1, 0, 0), (5, 30000, 29999), (5, 30000, 29999), (2**60 + 1, 30, 0), (None, 30, 30)]


def test_substrings_of_an_empty_table(stored):
    assert substring_dedup.substring_dedup(stored([], SCHEMA)).count() == 0


def brute_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) > size else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, bits):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(ids))}


def test_simhash_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fps = {d: brute_fingerprint(t) for d, t in docs}
    want = brute_components([d for d, _ in docs], [fps[d] for d, _ in docs], 4)
    got = simhash.query(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d, _ in docs}


@pytest.mark.parametrize("part", [8, 1024])
def test_near_links_connect_what_is_near(spark, part):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(6)} | {0, 3, 1 << 5})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, part)
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert {f: roots.get(f, f) for f in fps} == brute_components(fps, fps, 4)


def test_simhash_of_odd_rows(stored):
    got = {r.id: r for r in simhash.near_duplicates(stored(ODD, SCHEMA).where("doc_id is not null")).collect()}
    assert got[1].fp == got[2].fp == got[3].fp == 0
    assert {got[k].component_id for k in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(stored([], SCHEMA, "none")).count() == 0


def test_near_copies_go_and_others_stay(stored):
    rng = random.Random(1)
    text = [f"w{rng.randrange(500)}" for _ in range(300)]
    near = [" ".join(text[:k] + ["changed"] + text[k + 1 :]) for k in (50, 150, 250)]
    other = " ".join(text[::-1])
    docs = stored([(10, " ".join(text), 0, ""), *[(11 + k, t, 0, "") for k, t in enumerate(near)], (20, other, 0, ""), (21, None, 0, ""), (22, "", 0, "")], SCHEMA)
    kept = similar.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10, 20, 21]
    assert similar.kept_rows(stored([], SCHEMA, "none")).count() == 0


def near_variants(count, length=240):
    """A base, and copies of it that are each near to the base but not to each other."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = [" ".join(base)]
    for k in range(count):
        own = list(base)
        for n, at in enumerate(rng.sample(range(length // 8), 4)):
            own[at * 8 + 4] = f"v{k}x{n}"
        out.append(" ".join(own))
    return out


def test_a_large_group_of_variants_of_one_base(stored):
    texts = near_variants(150)
    sets = [set(similar.shingle_hashes(t).tolist()) for t in texts]
    share = lambda a, b: len(a & b) / len(a | b)
    assert min(share(sets[0], s) for s in sets[1:]) >= 0.8
    assert sum(share(sets[k], sets[k + 1]) < 0.8 for k in range(1, 150)) > 140
    docs = stored([(k + 1 if k else 900, t, 0, "") for k, t in enumerate(texts)], SCHEMA)
    assert similar.kept_rows(docs).count() == 1


def test_copies_that_differ_in_repeats_only(stored):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    line = [f"l{k}" for k in range(10)]
    docs = [(k, " ".join(words + line * times), 0, "") for k, times in enumerate((1, 2, 20, 60))]
    sets = [set(similar.shingle_hashes(d[1]).tolist()) for d in docs]
    assert min(len(a & b) / len(a | b) for a in sets for b in sets) >= 0.9
    assert [r.doc_id for r in similar.kept_rows(stored(docs, SCHEMA)).collect()] == [0]


@pytest.mark.parametrize("heavy", [False, True])
def test_every_pair_at_the_similarity_shares_a_key(stored, heavy):
    rng = np.random.default_rng(8)
    made = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for n in (4, 9, 36, 180, 900):
        for _ in range(200):
            both, own = made(n // 9 * 8 or n), made(2 * (n // 9) or 1)
            a, b = np.unique(np.r_[both, own[: len(own) // 2]]), np.unique(np.r_[both, own[len(own) // 2 :]])
            assert len(both) >= 0.8 * (len(both) + len(own))
            often = np.sort(rng.choice(both, len(both) // 2, replace=False)) if heavy else both[:0]
            assert len(np.intersect1d(similar.prefix_keys(a, often), similar.prefix_keys(b, often)))
            assert (similar._distances(similar.wide_fingerprint(a)[None], similar.wide_fingerprint(b)[None]) <= similar.NEAR).all()


def test_pairs_just_over_the_similarity(stored):
    rng = random.Random(9)
    docs = []
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(184)]
        docs.append((2 * k, " ".join(words), 0, ""))
        for at in (20, 70, 120, 170):
            words[at] = "changed"
        docs.append((2 * k + 1, " ".join(words), 0, ""))
    kept = similar.kept_rows(stored(docs, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 600, 2))


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_exact_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(exact_dedup.ORACLE.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    got = exact_dedup.query(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute_classes(docs):
    """Row number -> smallest row number of its class by exact similarity of all pairs."""
    sets = [set(similar.shingle_hashes(t).tolist()) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (a == sets[j]) or both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(docs))]


@pytest.mark.parametrize("part, shingles", [(1024, 1_000_000), (24, 1_000_000), (1024, 6_000)])
def test_kept_rows_equal_brute_force(stored, monkeypatch, part, shingles):
    """Chains, variants, templates and copies, in groups that are larger than a part."""
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "SHINGLES", shingles)
    monkeypatch.setattr(similar, "LEADERS", 4)
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = near_variants(70)
    line = new(14)
    for _ in range(25):
        body = new(rng.randrange(20, 120))
        for _ in range(rng.randrange(1, 6)):
            body = body[:-3] + new(3) if rng.random() < 0.6 else [*body[3:], *new(2)]
            texts.append(" ".join([*line, *body, *line]))
    template = new(160)
    texts += [" ".join([*template, *new(rng.randrange(5, 70))]) for _ in range(90)]
    texts += [texts[k].upper() for k in range(0, len(texts), 9)] + [None, "", " ", "two words", "Two words", "a b c d e"]
    rng.shuffle(texts)
    docs = [(k, t) for k, t in enumerate(texts)]
    root = brute_classes(docs)
    low = {}
    for k, r in enumerate(root):
        low.setdefault(r, k)
    kept = similar.kept_rows(stored([(k, t, 0, "") for k, t in docs], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())


def test_near_copies_of_odd_rows(stored):
    rows = [(None, "p q r s t u", 1, "a"), (2**60 + 1, "p q r s t u", 2, "b"), (7, "x y z", 3, None), (7, "x y z", 3, None), (9, None, None, None), (10, "word " * 40000, 1, "")]
    docs = stored(rows, "doc_id long, text string, __uid int, node string")
    kept = similar.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["__uid"]) for r in kept.collect()) == [(7, 3), (9, None), (10, 1), (2**60 + 1, 2)]


def test_sets_of_rows_in_no_loose_class_stay_where_they_are(stored, monkeypatch):
    """Whole sets are gone before rows are linked; only those of rows that are near another are compared."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    texts += [f"{t} more" for t in texts[:6]]
    seen, settle = [], similar.settle
    monkeypatch.setattr(similar, "settle", lambda g, payload, found, name: seen.append((payload.columns, payload.count())) or settle(g, payload, found, name))
    docs = stored([(k, t, 0, "") for k, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in similar.kept_rows(docs).collect()) == list(range(40))
    assert "hashes" not in seen[0][0] and seen[0][1] == 46
    assert "hashes" in seen[1][0] and seen[1][1] == 12

"""Packing, decontamination, language, archives, toxicity, scores and secrets on small tables."""

import math
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from wirelake.llm import decontaminate, language_id, packing, pseudo_likelihood, secrets_scan, toxicity, warc

SF, SF_MORE, SF_MOST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score double, label string"
ODD = [(1, None, 1.0, "a"), (2, "", None, "b"), (3, "plain words", 0.5, None), (3, "plain words", 0.5, None), (4, "x " * 50000, 0.1, "c")]


def placed_well(rows, size=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_of_a_whole_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, at in enumerate(starts):
            part = ids[at : starts[k + 1] if k + 1 < len(starts) else len(ids)]
            want[d.doc_id, k] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = packing.query(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    least = math.ceil(sum(n for _, n, _ in want.values()) / 1024)
    assert least <= placed_well(rows) <= math.ceil(least * 1.02) + 1


def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from wirelake.llm.tokens import encoder, special_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, tok, rng = encoder(path, tuple(special_tokens(path).items())), Tokenizer.from_file(path), random.Random(7)
    assert encode("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]
    some = ["<|endoftext|>", "<|endof", " ", "  ", "\n\n", "\t", "don't", "'LL", "1234", "é", "中文", "\U0001f600", "\u0301", "\x00", "\u200b", "word", "Wörter", "=" * 30, "\xa0", "ſ", "١٢"]
    texts = ["".join(rng.choices(some, k=rng.randrange(12))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x2FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(500)]
    for text in texts:
        assert encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text


BIG = (1 << 60) + 1
NULLS = [(BIG, "some plain words of a text", 1.0, "a"), (None, "words without an id", 1.0, "b"), (-BIG, None, None, None)]


def test_ids_stay_exact_beside_nulls(spark, stored, tmp_path):
    import public_tokenizers

    docs, own = stored(NULLS, SCHEMA).coalesce(1), {BIG, None, -BIG}
    assert {r.doc_id for r in packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()} == own
    assert {r.id for r in language_id.predict(docs, language_id.ByteNetwork(["xx", "yy"])).collect()} == own
    assert {r.id for r in toxicity.score(docs, toxicity.Lexicon()).collect()} == own
    assert {r.doc_id for r in toxicity.clean_rows(docs, toxicity.Lexicon()).collect()} == own
    words = pseudo_likelihood.Vocabulary({}, np.ones(64), np.ones((256, 256)))
    assert {r.id for r in pseudo_likelihood.score(docs, words, pseudo_likelihood.WindowNetwork(np.ones(64))).collect()} == own


def test_only_letters_make_a_language(stored):
    docs = stored([(k, t, 0.0, "") for k, t in enumerate(["²", "½ ①", "Ⅷ", "_", "ª", "中"])], SCHEMA)
    got = {r.id: r.lang_pred for r in language_id.predict(docs, language_id.ByteNetwork(["xx", "yy"])).collect()}
    assert [got[k] == "und" for k in range(6)] == [True, True, True, True, False, False]


def test_packing_of_odd_rows(stored):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.packed(stored(ODD, SCHEMA), path).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4} and sum(r.doc_id == 3 for r in rows) == 2
    placed_well(rows)
    assert packing.packed(stored([], SCHEMA, "none"), path).count() == 0


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(0)
    for _ in range(5):
        h = np.zeros(1025, dtype=np.int64)
        np.add.at(h, np.minimum(rng.lognormal(5, 1, 3000).astype(int) + 1, 1024), 1)
        used, n = np.zeros(1025, dtype=np.int64), 0
        for lengths, k in packing.plan(h):
            assert sum(lengths) <= 1024
            n += k
            for v in lengths:
                used[v] += k
        assert (used == h).all()
        assert n <= 1.01 * math.ceil((h * np.arange(1025)).sum() / 1024) + 1


def brute_leaks(docs, items, seeds=decontaminate.SEEDS, least=decontaminate.LEAST):
    import re

    cut = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    if any(least <= len(cut(i)) < min(map(len, seeds)) for _, i in items):
        seeds = (*seeds, "1" * least)
    out = {}
    for d, text in docs:
        words = cut(text)
        for k, item in items:
            own = cut(item)
            hit = set()
            for m in seeds:
                at = [x for x, c in enumerate(m) if c == "1"]
                places = {}
                for q in range(len(own) - len(m) + 1):
                    places.setdefault(tuple(own[q + x] for x in at), []).append(q)
                for p in range(len(words) - len(m) + 1):
                    hit |= {p - q for q in places.get(tuple(words[p + x] for x in at), [])}
            best = 0
            for g in hit:
                run = 0
                for i in range(max(0, -g), min(len(own), len(words) - g)):
                    run = max(run, 0) + (1 if words[g + i] == own[i] else -4)
                    best = max(best, run)
            if best >= least:
                out[d, k] = best
    return out


def test_leaks_against_brute_force(stored):
    rng = random.Random(2)
    words = [f"t{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for k in range(8)] + [(20, None), (21, "")]
    docs = []
    for k in range(40):
        body = rng.choices(words, k=rng.randrange(60))
        if k % 2:
            leak = (rng.choice(items[:8])[1]).split()
            for at in range(6, len(leak), 9 + k % 5):
                leak[at] = "swapped"
            body[10:10] = leak
        docs.append((k, " ".join(body).upper() if k % 3 == 0 else ", ".join(body)))
    docs += [(90, None), (91, "")]
    want = brute_leaks(docs, items)
    assert want
    table, tests = stored([(*d, 0.0, "") for d in docs], SCHEMA), stored(items, "item_id long, text string", "benchmark")
    for most in (decontaminate.BROADCAST_HASHES, 0):
        got = decontaminate.contaminated(table, tests, broadcast_hashes=most).collect()
        assert {(r.id, r.item_id): r.score for r in got} == want
    kept = decontaminate.clean_rows(table, tests)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(table, tests.where("item_id < 0")).count() == 0
    assert decontaminate.contaminated(table.where("doc_id < 0"), tests).count() == 0


def test_language_of_held_out_rows(spark):
    got = language_id.query(spark, SF_MORE).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").collect()}
    assert len(got) == len(lang)
    own = [r for r in got if r.held_out and lang[r.doc_id][0] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in own) >= 0.95 * len(own)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_of_odd_rows(spark, stored):
    docs = stored([*ODD, (9, "123 !?", 0.0, "a")], SCHEMA)
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    network = language_id.ByteNetwork(["xx", "yy"])
    got = {r.id: r.lang_pred for r in language_id.predict(docs, network).collect()}
    assert got[1] == got[2] == got[9] == "und" and got[4] in ("xx", "yy")
    assert language_id.fit(docs.where("doc_id < 0").selectExpr("doc_id as id", "text", "label")) is None


def test_archives(spark, stored):
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\n\r\nhello\nworld"
        data = warc.arc_start(version) + warc.arc_record(version, "http://a.example/x y", "192.0.2.7", "20240203", "text/html", body) + b"broken line\n" + warc.arc_record(version, "dns:a", "192.0.2.7", "20240203101112", "text/dns", b"")
        rows = warc.converted("s", data)
        assert [(r["url"], r["date"], r["payload"], r["is_http"]) for r in rows] == [("http://a.example/x y", "2024-02-03T00:00:00Z", b"hello\nworld", True), ("dns:a", "2024-02-03T10:11:12Z", b"", False)]
        assert [x[1]["skipped"] for x in warc.parse_arc(data)] == [0, 12]
    want = duckdb.sql(warc.ORACLE.replace("FROM pages", f"FROM '{SF}/pages.parquet'")).fetchall()
    got = warc.query(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_archives_of_odd_pages(spark, stored, tmp_path):
    big = "é" * 200
    pages = stored([(5, "http://x", big, 1), (2, None, big, 2), (3, "a\nb", None, 3), (4, "u:1", "WARC/1.1\r\n\r\n" * 9, 4), (6, "u:2", "short", 5), (7, "u:3", "short", 6), (None, "u:4", big, 7), (None, None, "short", 8), (2**60 + 1, "u:5", "tiny", 9)], "page_id long, url string, html string, length int", "pages")
    rows = warc.convert_pages(pages, f"{tmp_path}/out").collect()
    assert len(rows) == 9 and sorted((r.record_type, r.payload_bytes) for r in rows if r.key is None) == [("response", 5), ("revisit", 400)]
    got = {r.key: r for r in rows if r.key is not None}
    assert {k: (r.record_type, r.payload_bytes) for k, r in got.items()} == {5: ("revisit", 400), 2: ("response", 400), 3: ("response", 0), 4: ("response", 126 - 18), 6: ("response", 5), 7: ("response", 5), 2**60 + 1: ("response", 4)}
    assert got[5].refers_to_id == got[2].record_id
    assert warc.convert_pages(pages.where("page_id < 0"), f"{tmp_path}/none").count() == 0


def test_folding():
    assert toxicity.fold("Hеll0, Wörld") == " heiio worid "
    assert toxicity.fold(None) == "  " and toxicity.fold("year 2024") == " year 2024 "


def test_exceptions_and_spans():
    lexicon = toxicity.Lexicon({" bad ": 2.0, " bad": 1.0}, frozenset({" bad guy "}), (0.0, 1.0, 1.0))
    assert [w for _, w in lexicon.matches(toxicity.fold("a bad thing")).values()] == [2.0]
    assert not lexicon.matches(toxicity.fold("a bad guy"))
    assert [w for _, w in lexicon.matches(toxicity.fold("badly")).values()] == [1.0]


def test_toxicity_of_held_out_rows(spark):
    got = {r.doc_id: r for r in toxicity.query(spark, SF_MOST).collect()}
    marks = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{SF_MOST}/labels.parquet").where("toxic is not null").collect() if r.doc_id in got and got[r.doc_id].held_out]
    hits = sum(t and p for t, p in marks)
    assert hits >= 0.9 * sum(t for t, _ in marks) and sum(p and not t for t, p in marks) <= 0.02 * len(marks)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_toxicity_of_odd_rows(stored):
    docs = stored(ODD, SCHEMA)
    empty = toxicity.Lexicon()
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
    assert toxicity.clean_rows(docs, empty).count() == len(ODD)
    assert toxicity.fit(docs.selectExpr("doc_id as id", "text", "cast(null as int) as label")).weights == {}


def test_network_is_a_distribution_and_descends():
    n = 32 * 32
    net = pseudo_likelihood.WindowNetwork(np.ones(n))
    net.p["c"] += np.random.default_rng(0).normal(0, 0.5, net.p["c"].shape).astype(np.float32)
    x = np.repeat(np.array([[5, 9, 2, 1]], dtype=np.int32), n, axis=0)
    assert np.exp(net.log_probs(x, np.arange(n))).sum() == pytest.approx(1, abs=1e-4)
    ids = np.tile(np.arange(2, 12, dtype=np.int32), 60)
    state, was = {}, net.gradients(pseudo_likelihood.contexts(ids), ids)[0]
    assert was == pytest.approx(-net.log_probs(pseudo_likelihood.contexts(ids), ids).mean(), rel=1e-4)
    for _ in range(30):
        net.descend(pseudo_likelihood.contexts(ids), ids, state, 0.1)
    assert net.gradients(pseudo_likelihood.contexts(ids), ids)[0] < was - 1


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = pseudo_likelihood.WindowNetwork(rng.integers(1, 50, 64).astype(float))
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64) + rng.normal(0, 0.2, v.shape)
    ids = rng.integers(0, 64, 40).astype(np.int32)
    x = pseudo_likelihood.contexts(ids)
    _, g = net.gradients(x, ids)
    rows, whole = g.pop("e")[1], np.zeros_like(net.p["e"])
    whole[np.unique(x)] = rows
    for name, grad in (g | {"e": whole}).items():
        for at in rng.integers(0, net.p[name].size, 6):
            flat, h = net.p[name].reshape(-1), 1e-5
            flat[at] += h
            up = net.gradients(x, ids)[0]
            flat[at] -= 2 * h
            down = net.gradients(x, ids)[0]
            flat[at] += h
            assert (up - down) / (2 * h) == pytest.approx(grad.reshape(-1)[at], abs=1e-5), name


def plain_log_probs(net, x, y):
    """Two softmaxes as they are written: a pass for the bias, one for the largest output of each row, and so on."""
    p, n, got = net.p, net.classes, np.zeros(len(y))
    h = np.tanh(p["e"][x].reshape(len(y), -1) @ p["w"] + p["b"])

    def log_at(z, at):
        z -= z.max(axis=1, keepdims=True)
        picked = z[np.arange(len(z)), at]
        return picked - np.log(np.exp(z, out=z).sum(axis=1))

    for c in range(n):
        own = np.flatnonzero(y % n == c)
        got[own] = log_at(h[own] @ p["c"] + p["cb"], y[own] % n) + log_at(h[own] @ p["o"][c] + p["ob"][c], y[own] // n)
    return got


def random_network(classes, scale):
    rng = np.random.default_rng(5)
    net = pseudo_likelihood.WindowNetwork(rng.integers(1, 50, classes**2).astype(float))
    for k in "co":
        net.p[k] = rng.normal(0, scale, net.p[k].shape).astype(np.float32)
    ids = rng.integers(0, classes**2, 60_000).astype(np.int32)
    return net, pseudo_likelihood.contexts(ids), ids


@pytest.mark.parametrize("scale", [0.1, 1, 60])
def test_log_probs_and_gradients_at_small_and_large_weights(scale):
    net, x, y = random_network(9, scale)
    exact = pseudo_likelihood.WindowNetwork(np.ones(81))
    exact.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    assert net.log_probs(x, y) == pytest.approx(plain_log_probs(exact, x, y), rel=1e-3, abs=1e-2)
    loss, g = net.gradients(x[:500], y[:500])
    assert loss == pytest.approx(-net.log_probs(x[:500], y[:500]).mean(), rel=1e-3)
    assert all(np.isfinite(v).all() for v in [*(v for k, v in g.items() if k != "e"), g["e"][1]])


def test_scoring_takes_less_time_than_plain_softmaxes():
    net, x, y = random_network(75, 0.1)
    took = {net.log_probs: [], lambda x, y: plain_log_probs(net, x, y): []}
    for _ in range(5):
        for run, times in took.items():
            began = time.process_time()
            run(x, y)
            times.append(time.process_time() - began)
    fast, plain = (min(t) for t in took.values())
    assert fast < 0.7 * plain


def test_texts_are_encoded_once_with_wide_ids_and_spellings(stored):
    size = 257**2
    words = pseudo_likelihood.Vocabulary({"x": size - 1, "é": 70}, np.ones(size), np.random.default_rng(1).integers(0, 9, (256, 256)).astype(float))
    docs = stored([(1, "X odd É naïve x", 0.0, ""), (2, None, 0.0, ""), (3, " ", 0.0, ""), (BIG, "odd", 0.0, "")], SCHEMA)
    got = {r.id: r for r in pseudo_likelihood.encoded(docs, words).collect()}
    assert np.frombuffer(got[1].words, dtype=np.uint32).tolist() == [size - 1, 0, 70, 0, size - 1]
    assert [len(got[k].words) for k in (2, 3, BIG)] == [0, 0, 4]

    def spelled(word):
        raw = [255, *word.encode(), 255]
        return sum(words.spelling[a, b] for a, b in zip(raw, raw[1:], strict=False))

    assert [got[k].spelled for k in (1, 2, 3, BIG)] == pytest.approx([spelled("odd") + spelled("naïve"), 0, 0, spelled("odd")])


def test_empty_table_is_fitted_and_scored(stored):
    docs = stored([], SCHEMA)
    words, net = pseudo_likelihood.fit(docs)
    assert pseudo_likelihood.score(docs, words, net).count() == 0


def brute_log_prob(text, words, net):
    """Each word's probability from the weights, one word at a time."""
    own, total = words.encode(text.lower().split()), 0.0
    for k, y in enumerate(own):
        near = [own[k + d] if 0 <= k + d < len(own) else pseudo_likelihood.EDGE for d in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([net.p["e"][w] for w in near]) @ net.p["w"] + net.p["b"])
        n = net.classes
        for z, at in ((h @ net.p["c"] + net.p["cb"], y % n), (h @ net.p["o"][y % n] + net.p["ob"][y % n], y // n)):
            total += z[at] - np.log(np.exp(z).sum())
        if y == pseudo_likelihood.UNKNOWN:
            raw = [255, *text.lower().split()[k].encode(), 255]
            total += sum(words.spelling[a, b] for a, b in zip(raw, raw[1:], strict=False))
    return total


def test_scores_against_brute_force_and_beyond_single_words(spark):
    """Trained on four fifths of a table: scores equal those of one word at a time, and unseen texts are predicted better than by counts alone."""
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet").select("doc_id", "text")
    words, net = pseudo_likelihood.fit(docs.where("doc_id % 5 <> 0").repartition(4))
    rest = docs.where("doc_id % 5 = 0")
    got = {r.id: r for r in pseudo_likelihood.score(rest, words, net).collect()}
    texts = {r.doc_id: r.text for r in rest.collect()}
    for d in sorted(texts)[:12]:
        if len((texts[d] or "").split()) < 600:
            assert got[d].log_prob == pytest.approx(brute_log_prob(texts[d] or "", words, net), rel=1e-3, abs=1e-2)
    share = np.log(words.counts / words.counts.sum())
    single = sum(float(share[words.encode(pseudo_likelihood.words_of(t))].sum()) + float(words.spelled([w for w in pseudo_likelihood.words_of(t) if w not in words.ids]).sum()) for t in texts.values())
    assert sum(r.log_prob for r in got.values()) > single + 0.1 * sum(r.n_words for r in got.values())


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(4)
    words = pseudo_likelihood.Vocabulary({}, np.ones(64), rng.integers(0, 9, (256, 256)).astype(float))
    p = words.spelling
    assert np.exp(p).sum(axis=1) == pytest.approx(np.ones(256))
    assert words.spelled(["ab", "b"]) == pytest.approx([p[255, 97] + p[97, 98] + p[98, 255], p[255, 98] + p[98, 255]]) and len(words.spelled([])) == 0


@pytest.mark.parametrize("words", [1, 2, 7, 8, 101])
def test_every_word_is_a_target_over_the_rounds(words):
    ids = np.arange(2, 2 + words, dtype=np.int32)
    seen = [ids[pseudo_likelihood.targets(ids, pseudo_likelihood.STRIDE, k)] for k in range(pseudo_likelihood.ROUNDS)]
    assert sorted(np.concatenate(seen).tolist()) == ids.tolist()


def test_scores_prefer_seen_order(spark, stored):
    rows = [(k, "alpha beta gamma delta " * 40, 0.0, "") for k in range(20)]
    docs = stored([*rows, (50, None, 0.0, ""), (51, "", 0.0, ""), (52, "delta alpha alpha beta gamma gamma " * 5, 0.0, "")], SCHEMA)
    ids, net = pseudo_likelihood.fit(docs, rate=0.2)
    got = {r.id: r for r in pseudo_likelihood.score(docs, ids, net).collect()}
    assert got[0].mean_log_prob > got[52].mean_log_prob
    assert (got[50].n_words, got[50].log_prob, got[50].mean_log_prob) == (0, 0.0, None)
    assert got[0].n_words == 160 and got[51].n_words == 0


def test_secrets(spark, stored):
    token = "ghp_" + "a7Bq9ZkLm2Xw5Rt8Yc1N" + "sD4gJ6hF0pQ3vE7u"
    docs = stored([*ODD, (7, f"see {token} here", 0.0, ""), (8, "the sha256 digest 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 of it", 0.0, ""), (9, "extraordinarily interesting_sentence_version_2 words", 0.0, "")], SCHEMA)
    got = {r.id: r for r in secrets_scan.scan(docs).collect()}
    assert got[7].is_secret and got[7].token == token and got[7].pos == 1
    assert not got[8].is_secret and not got[9].is_secret
    assert secrets_scan.scan(docs.where("doc_id < 0")).count() == 0


def test_candidates_against_brute_force(stored):
    """Every place of every token, with what stands before and after it."""
    import re

    rng = random.Random(8)
    some = ["ab12cd34ef56ab12cd34", "key=", '"', "a,b", "x", "ghp_0123456789abcdefg", ":", "word", "0123456789012345", ";;"]
    docs = [(k, " ".join("".join(rng.choices(some, k=rng.randrange(1, 6))) for _ in range(rng.randrange(8))), 0.0, "") for k in range(60)]
    docs += [(70, "ab12cd34ef56ab12cd34,ab12cd34ef56ab12cd34", 0.0, ""), (71, None, 0.0, ""), (None, "ab12cd34ef56ab12cd34", 0.0, "")]
    want = []
    for d, text, *_ in docs:
        parts = re.split(r"\s+", text or "")
        for p, part in enumerate(parts):
            for m in re.finditer(secrets_scan.CANDIDATE, part):
                left = " ".join([*parts[max(p - 2, 0) : p], ""])
                right = " ".join(["", *parts[p + 1 : p + 2]])
                want.append((str(d), p, m[0], left + part[: m.start()], part[m.end() :] + right))
    got = [(str(r.id), r.pos, r.token, r.before, r.after) for r in secrets_scan.candidates(stored(docs, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)


def test_findings_of_other_templates(spark, stored):
    """Precision and recall on kinds of findings that the training rows don't have."""
    rng = random.Random(5)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters, digits, hexes = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    rows = []
    for _ in range(60):
        rows += [
            (f"export AUTH_SECRET={pick(letters + digits, 30)}1 ; run", 1), (f"client token: {pick(hexes, 36)}9a here", 1), (f"curl -H 'Bearer {pick(letters + digits, 44)}7' -X", 1),
            (f"the file is /usr/share/{pick('abcdefgh', 9)}/lib{pick(digits, 3)}/{pick('abcdefgh', 8)} in it", 0), (f"call me on {pick(digits, 15)} please", 0), (f"md5 checksum {pick(hexes, 31)}0 of the archive", 0), (f"see chapter_{pick(digits, 2)}_of_the_longer_book now", 0),
        ]
    docs = stored([(k, t, float(y), "") for k, (t, y) in enumerate(rows)], SCHEMA)
    found = {r.id for r in secrets_scan.scan(docs).collect() if r.is_secret}
    real = {k for k, (_, y) in enumerate(rows) if y}
    assert len(found & real) >= 0.85 * len(real) and len(found - real) <= 0.2 * len(found)

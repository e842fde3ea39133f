"""Operators of the training-data pipeline against brute force, round trips and held-out accuracy, and on odd input."""

from __future__ import annotations

import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import chat_format, components, decontam, embed_dedup, html_crf, langid, ngram_join, pii, sp_scan, toxicity, url_filter

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, "x"), (2, "", "en", "x"), (3, " \n\t ", "en", "x"), (None, "same text here for all", "en", "x"), (4, "same text here for all", "en", "x"), (4, "same text here for all", "en", "x"), (5, "word " * 60_000, "en", "x"), (6, "🙂" * 500, None, "x"), (7, "a" * 100_000, "en", "x")]
WORDS = "thon reat ingly erst onwh hein asto ther thion lyed nthe ores whan eared tinor stes".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators add."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, score string").withColumns({c: F.lit("clash") for c in ("lang_pred", "predicted", "base", "spans", "token_ids", "decoded", "key", "node", "pii_key_")})


def text_of(r, n):
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


def texts(n, seed=1):
    """Random texts with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x = r.random()
        if out and x < 0.25:
            w = r.choice(out).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                if w:
                    w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(" ".join(w))
        else:
            out.append(text_of(r, r.choice([0, 1, 3, 6, 30, 120])) + (" common passage of seven words right here" if x > 0.8 else ""))
    return out


def classes(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- 1


def test_language_vectors_bind_and_bundle():
    v = langid.letter_vectors(np.array([97, 98]))
    assert set(np.unique(v)) == {-1, 1} and abs(int(v[0].astype(int) @ v[1])) < 200
    a, b = langid.bundles(["abc abd", "abc"]), langid.gram_vectors(np.array([[32, 97, 98], [97, 98, 99], [98, 99, 32]]))
    assert (a[1] == b.astype(int).sum(0)).all()
    assert (langid.bundles(["Abc--!! 12 ABD"]) == a[:1]).all() and not langid.bundles(["", "12!", None]).any()


def test_language_held_out(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = langid.op1_language_id(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd):
    p = langid.learn(odd)
    rows = langid.identify(odd, p).collect()
    assert p.langs == ["en"] and len(rows) == len(ODD)
    assert {(r.doc_id, r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 6)} == {(k, "und", 0.0) for k in (1, 2, 3, 6)}
    assert langid.identify(odd.where("false"), langid.learn(odd.where("false"))).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(odd.where("false"))).collect()} == {"und"}


# ---- 2


def test_jaccard_join_equals_brute_force(spark):
    rows = list(enumerate(texts(250), 10))
    shingle = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {i: shingle(t.split()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id: r.n_links for r in got} == {i: sum(i in x for x in links) for i in sets}
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {i for i in sets if want[i] == i}


def test_jaccard_join_of_a_family_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAMILY_WEIGHT", 1500)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 8)
    r = random.Random(5)
    base = text_of(r, 100).split()
    rows = []
    for i in range(120):
        w = list(base)
        w[r.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.n_links for x in got} == {119} and {x.class_id for x in got} == {0}


@pytest.mark.parametrize("group, tile", [(4, 8), (200, 8)])
def test_jaccard_join_of_one_dense_family(spark, monkeypatch, group, tile):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", group)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    r, rows = random.Random(9), []
    base = text_of(r, 90).split()
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            w[r.randrange(90)] = f"y{r.randrange(5)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(86)} for i, w in ((i, t.split()) for i, t in rows)}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_links for x in got} == {i: sum(i in x for x in links) for i in sets} and {x.doc_id: x.class_id for x in got} == classes(sets, links)


def test_intersections_of_sets():
    g = np.random.default_rng(3)
    lists = [np.unique(g.integers(0, 60, g.integers(0, 50))) for _ in range(40)] + [np.arange(60)] * 3
    sets = ngram_join.Sets(np.concatenate(lists).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in lists])])
    left, right = np.triu_indices(len(lists), 1)
    want = [len(np.intersect1d(lists[a], lists[b])) for a, b in zip(left, right, strict=True)]
    n = len(lists)
    assert sets.pairs(left, right).tolist() == want and sets.tile(0, n, 0, n)[left, right].tolist() == want and sets.tile(5, 9, 30, n).shape == (4, n - 30)
    assert ngram_join.Sets(np.zeros(0, np.int64), np.zeros(3, int)).pairs(np.array([0]), np.array([1])).tolist() == [0]


def test_pairs_within_groups():
    for most in (3, 10, 1000):
        got = [(a, b) for x, y in components.pairs_within(np.array([0, 1, 4, 4, 11, 13]), most) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(got) == [(a, b) for lo, hi in ((1, 4), (4, 11), (11, 13)) for a in range(lo, hi) for b in range(a + 1, hi)]


def test_what_workers_gather_is_merged():
    import pyarrow as pa

    g = components.Gathered(pa.int64(), 4)
    g.link(pa.array([5, 4]), pa.array([4, 3]))
    assert not list(g.forest()) and not list(g.totals())
    g.link(pa.array([5, 9]), pa.array([3, 8]))
    g.add(pa.array([1, 2, 1]), np.array([1, 2, 3]))
    ((src, dst),), ((node, n),) = list(g.forest()), list(g.totals(True))
    assert len(src) == 3 and classes([3, 4, 5, 8, 9], list(zip(src.to_pylist(), dst.to_pylist(), strict=True))) == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert dict(zip(node.to_pylist(), n.to_pylist(), strict=True)) == {1: 4, 2: 2} and not list(g.forest(True))


def test_posterior_bound():
    assert ngram_join.least_matches() == sorted(ngram_join.least_matches())
    least = ngram_join.least_matches()[-1]
    p = np.random.default_rng(1).beta(least + 1, ngram_join.HASHES - least + 1, 400_000)
    assert (p >= 0.8).mean() < 1e-4  # a pair that barely stays is nearly sure to be none
    assert least / ngram_join.HASHES < 0.7


def test_jaccard_join_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(odd).collect()), key=str)
    assert [x for x in got if x[0] == 4] == [(4, 4, 2)] * 2 and (None, 4, 2) in got
    assert {x for x in got if x[0] in (1, 2, 3, 6)} == {(k, k, 0) for k in (1, 2, 3, 6)}
    assert len(ngram_join.keep_one(odd).collect()) == len(ODD) - 2 and ngram_join.near_duplicates(odd.where("false")).count() == 0


def test_shingle_hashes_do_not_depend_on_the_batch():
    a = ["one two three four five six", "", "x", "one two three four five"]
    h, off = ngram_join.shingles(a)
    assert np.diff(off).tolist() == [2, 0, 1, 1] and h[0] == h[3]
    for i, t in enumerate(a):
        assert (ngram_join.shingles([t])[0] == h[off[i] : off[i + 1]]).all()


# ---- components


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == classes(nodes, [e for e in edges if e[0] != e[1]])


# ---- 3

MODEL = os.path.exists(sp_scan.MODEL)
needs_model = pytest.mark.skipif(not MODEL, reason="no tokenizer files")


def by_chunks(m, text, chunk):
    """The operator's steps on one text, without Spark."""
    t = m.normal(text)
    starts = list(range(0, max(1, len(t)), chunk))
    if len(starts) > 1 and len(t) - starts[-1] <= 2 * m.longest:
        starts.pop()
    rows = []
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else len(t)
        low, high = max(0, a - m.longest), min(len(t), b + m.longest)
        rows.append((a - low, b - low, t[low:high], k == len(starts) - 1))
    entries = [[sp_scan.FREE] if k == 0 else [*m.states(p, a), *([sp_scan.FREE] if m.seams(p, a, a) else [])] for k, (a, _, p, _) in enumerate(rows)]
    path = sp_scan.resolve([m.matrix(p, a, b, e, last) for (a, b, p, last), e in zip(rows, entries, strict=True)])
    return [i for (a, b, p, last), (s, x) in zip(rows, path, strict=True) for i in m.numbers(m.between(p, a, b, s, x, last))]


@needs_model
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcdeinrst  ▁\n\t🙂é中", "the", " international", "ization", "   ", "ing ", "0123", "{}();"]), max_size=120).map("".join), st.sampled_from([40, 64, 100]))
def test_scan_equals_the_library(text, chunk):
    m = sp_scan.model(sp_scan.MODEL)
    want = m.sp.encode(text)
    assert m.numbers(m.pieces(m.normal(text))) == want
    assert by_chunks(m, text, chunk) == want


@needs_model
def test_encode_in_spark(spark, odd):
    m = sp_scan.model(sp_scan.MODEL)
    rows = sp_scan.decode(sp_scan.encode(odd, chunk=1500)).collect()  # more chunks than one span holds
    assert len(rows) == len(ODD) and all(r.token_ids == (None if r.text is None else m.sp.encode(r.text)) and r.text == r.decoded for r in rows)
    assert sp_scan.encode(odd.where("false")).count() == 0


@needs_model
def test_a_worker_drops_the_model_for_other_operators():
    from siftline.llm import common

    sp_scan.model.cache_clear()
    m = sp_scan.model(sp_scan.MODEL)
    list(common.lean(sp_scan._trace(sp_scan.MODEL))(iter(())))
    assert sp_scan.model(sp_scan.MODEL) is m and sp_scan.__name__ in common.kept
    list(common.lean(pii._merged)(iter(())))
    assert sp_scan.__name__ not in common.kept and sp_scan.model(sp_scan.MODEL) is not m


def test_compose_is_associative():
    r = random.Random(3)
    matrix = lambda: {((r.randrange(3), 0), (r.randrange(3), 0)): float(r.randrange(9)) for _ in range(6)}
    for _ in range(50):
        a, b, c = matrix(), matrix(), matrix()
        assert sp_scan.compose(sp_scan.compose(a, b), c) == sp_scan.compose(a, sp_scan.compose(b, c))


# ---- 4


def test_vectors_equal_brute_force(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = base[i % 12] + g.normal(size=16) * g.choice([0.0, 0.05, 0.12, 2.0])
        rows.append((i, [float(x) for x in v], None if i % 37 == 0 else i % 3))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0] * 8, 1), (1005, [1.0] * 8, 1), (1006, [float("inf")] * 16, 1), (1007, [1.0, None] * 8, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sound = {i: (np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if i is not None and v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in sound for b in sound if a < b and sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and sound[a][0] @ sound[b][0] >= 0.98]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    want = classes([r[0] for r in rows if r[0] is not None], links)
    assert len(links) > 300 and len(got) == len(rows)
    assert {i: got[i].component_id for i in want} == want and {i: got[i].n_links for i in want} == {i: sum(i in x for x in links) for i in want}
    assert all(r.kept == (r.vec_id == r.component_id) for i, r in got.items() if i is not None)
    assert embed_dedup.near_vectors(df.where("false")).count() == 0
    clash = df.withColumns({c: F.lit("clash") for c in ("n_links", "component_id", "kept", "v", "key2", "node", "copies", "pass", "part")})
    assert {tuple(r) for r in embed_dedup.near_vectors(clash.where("vec_id < 40")).collect()} == {tuple(r) for r in embed_dedup.near_vectors(df.where("vec_id < 40")).collect()}


def test_windows_do_not_depend_on_partitions():
    assert embed_dedup.handed_on({0: 10, 1: 3, 2: 0, 3: 2, 4: 9}, 4) == [(1, 0, 4), (3, 1, 3), (3, 0, 1), (4, 3, 2), (4, 1, 2)]
    g = np.random.default_rng(5)
    a, b = g.integers(0, 1 << 60, 500), g.integers(0, 1 << 60, 500)
    b[:200] = a[:200] ^ (np.int64(1) << g.integers(0, 60, 200))
    want = [next((k for k in range(60) if (int(x) >> (59 - k)) & 1 != (int(y) >> (59 - k)) & 1), 60) for x, y in zip(a, b, strict=True)]
    assert embed_dedup.shared_bits(a, b).tolist() == want and (embed_dedup.shared_bits(a, a) == 60).all()


def test_bound_of_a_pass():
    key = np.sort(np.random.default_rng(6).integers(0, 1 << 60, 300))
    miss = embed_dedup.log_miss(np.zeros(300, int), key, 8, 0.98)
    assert (miss[:8] == 0).all() and (miss[-8:] == 0).all() and (miss[8:-8] < 0).all()
    assert (embed_dedup.log_miss(np.zeros(300, int), np.zeros(300, np.int64), 8, 0.98) == 0).all()  # a window of equal keys alone bounds nothing
    assert embed_dedup.log_miss(np.arange(300) // 5, key, 8, 0.98)[8] < -10  # its label ends on both sides of the window


def test_recall_on_a_dense_label(spark):
    """Planted pairs just above the threshold, among vectors that share a direction."""
    g, n, k, d = np.random.default_rng(1), 4000, 200, 64
    x = g.normal(size=(n, d))
    x = 0.3 * x / np.linalg.norm(x, axis=1)[:, None] + 0.95 * np.eye(d)[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = g.normal(size=(k, d))
    z -= (z * x[:k]).sum(1)[:, None] * x[:k]
    x = np.vstack([x, 0.9805 * x[:k] + np.sqrt(1 - 0.9805**2) * z / np.linalg.norm(z, axis=1)[:, None]])
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")).collect()}
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() > 0


# ---- 5


def plain_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(digits(m[0])) <= 15]
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@..1234567890 -+()é_", max_size=80))
def test_base_spans_equal_the_patterns(x):
    assert pii.base_spans(x) == plain_spans(x)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"w{i} contact tel: +1 (555) 555-{1000 + i} thanks") for i in range(30)] + [(100, "noise here tel: 555.01.4321 thanks"), (101, "no cue before 555.02.4321 stays"), (102, None), (103, ""), (100, "noise here tel: 555.01.4321 thanks")]
    rows += [(200 + i, f"before {i}.{i}.5.7{i} and other words before them") for i in range(40)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    assert got[100] == [("phone", 16, 27)] and not got[101] and not got[102] and not got[103] and len(got[5]) == 1
    assert {r.text for r in pii.redact(found).where("doc_id in (5, 100)").collect()} == {"w5 contact tel: [PHONE] thanks", "noise here tel: [PHONE] thanks"}


def test_copies_of_a_text_do_not_weaken_its_cues(spark):
    rows = [(i, f"w{i} contact tel: +1 (555) 555-{1000 + i} thanks") for i in range(30)] + [(100, "noise here tel: 555.01.4321 thanks")] * 300
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).where("doc_id = 100").collect()
    assert len(found) == 300 and all([tuple(s) for s in r.spans] == [("phone", 16, 27)] for r in found)


def test_planted_formats_are_found_by_their_cues(spark):
    """Precision and recall of added spans: formats that no base pattern knows, beside cues that seeds taught, and the same without cues."""
    r = random.Random(12)
    word = lambda: r.choice(WORDS) + r.choice("abcdefgh")
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    seeds = {"phone": lambda: f"+44 20 7{d(3)} {d(4)}", "email": lambda: f"{word()}@{word()}.org", "ip": lambda: f"10.{r.randrange(200)}.{r.randrange(200)}.7"}
    unseen = {"phone": [lambda: f"020 7{d(3)} {d(4)}", lambda: f"(555) {d(3)}-{d(4)}", lambda: f"555.{d(2)}.{d(4)}", lambda: d(8)], "email": [lambda: f"{word()} (at) {word()}.org", lambda: f"{word()}[at]{word()}[dot]net", lambda: f"{word()}@{word()}"], "ip": [lambda: f"fe80:0:{d(2)}:{d(3)}", lambda: f"10-2{d(1)}-31-{d(2)}"]}
    cue = {"phone": ["tel: ", "tel:", "Phone="], "email": ["mail: ", "e-mail="], "ip": ["host: ", "addr="]}
    rows, want = [], set()
    for kind, make in seeds.items():
        rows += [f"{text_of(r, 6)} {r.choice(cue[kind])}{make()} {text_of(r, 5)}" for _ in range(120)]
    for kind, makes in unseen.items():
        for i in range(60):
            left, what = f"{text_of(r, 7)} {r.choice(cue[kind])}", makes[i % len(makes)]()
            want.add((len(rows), kind, len(left), len(left) + len(what)))
            rows.append(f"{left}{what} {text_of(r, 4)}")
    rows += [f"{text_of(r, 5)} {makes[i % len(makes)]()} {text_of(r, 5)}" for makes in unseen.values() for i in range(60)]
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()
    got = {(x.doc_id, *s) for x in found for s in x.spans if s not in x.base}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_looks_beside_base_spans():
    x = "a@b.org jo (at) x.org 020 7946 0958 1.2.3.4 5551234-b 4111 1111 1111 1112 @x"
    base = pii.base_spans(x)
    assert [(k, x[s:e]) for k, s, e in pii.looks(x, base)] == [("email", "jo (at) x.org"), ("card", "4111 1111 1111 1112"), ("phone", "020 7946 0958")]
    assert pii.cues("tel:555") == ["tel:555", "tel:"] and pii.cues("tel:") == ["tel:"] and pii.cue("y" * 99) != pii.cue("y" * 98) and pii.cue("Say,") == "say"
    assert ("phone", 4, 404) not in pii.looks("tel:" + "5" * 400, [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@. 1234567890-+()[]:t", max_size=60))
def test_looks_touch_no_base_span(x):
    base = pii.base_spans(x)
    for _, s, e in pii.looks(x, base):
        assert s < e and not any(a < e and b > s for _, a, b in base)


def test_redaction_of_many_spans():
    n = 30_000
    spans = [{"kind": "ip", "start": 8 * i, "end": 8 * i + 7} for i in range(n)] + [{"kind": "card", "start": 8 * n - 4, "end": 8 * n + 1}]
    assert pii.redacted("1.1.1.1 " * n + "xy", spans) == "[IP] " * (n - 1) + "[IP]y"


def test_personal_data_odd_rows(spark, odd):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == len(ODD) and all(r.base == [] for r in rows)
    assert pii.find_personal_data(odd.where("false")).count() == 0


# ---- 6


def test_list_intervals(spark):
    e = spark.createDataFrame([("l", "block", "host", "bad.com", a, t) for a, t in (("add", "2024-01-01"), ("remove", "2024-02-01"), ("add", "2024-03-01"))] + [("l", "allow", "prefix", "bad.com/ok", "add", "2024-01-15"), ("l", "block", "host", None, "add", "2024-01-01")], "list string, verdict string, kind string, pattern string, action string, dated string").withColumn("dated", F.to_timestamp("dated"))
    c = spark.createDataFrame([(1, "http://www.bad.com/x", "2024-01-10"), (2, "http://bad.com/", "2024-02-10"), (3, "http://bad.com/", "2024-03-01"), (4, "http://BAD.com:80/ok/y?z", "2024-01-20"), (5, "http://bad.com/okay", "2024-01-20"), (6, "http://notbad.com/", "2024-01-20"), (7, None, "2024-01-20"), (8, "x", "2024-01-20"), (9, "http://bad.com/", None), (1, "http://www.bad.com/x", "2024-01-10")], "id int, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched")).withColumn("decision", F.lit("clash"))
    got = sorted((r.id, r.decision) for r in url_filter.judge(c, e).collect())
    assert got == [(1, "block"), (1, "block"), (2, "unlisted"), (3, "block"), (4, "allow"), (5, "block"), (6, "unlisted"), (7, "unknown"), (8, "unknown"), (9, "unknown")]
    assert url_filter.judge(c.where("false"), e).count() == 0 and {r.decision for r in url_filter.judge(c, e.where("false")).collect()} == {"unlisted", "unknown"}


def test_captures_with_clashing_columns(spark):
    e = spark.createDataFrame([("l", "block", "host", "bad.com", "add", "x")], "list string, verdict string, kind string, pattern string, action string, url string").withColumns({"dated": F.timestamp_seconds(F.lit(1)), "fetched": F.lit("clash")})
    c = spark.createDataFrame([(1, "http://bad.com/" + "y" * 100_000)], "id int, url string").withColumns({"fetched": F.timestamp_seconds(F.lit(2)), **{k: F.lit("clash") for k in ("list", "pattern", "kind", "verdict", "host", "valid_from", "at_")}})
    (row,) = url_filter.judge(c, e).collect()
    assert (row.decision, row.list, row.pattern, row.kind, row.host) == ("block", "l", "bad.com", "clash", "clash")


# ---- 7


def test_preference_pairs(spark):
    rows = [(1, s, 0, "user", "q") for s in ("chosen", "rejected")] + [(1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "<|bad|>"), (1, "chosen", 2, "user", "more"), (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "a"), (3, "chosen", 0, None, None), (None, "chosen", 0, "user", "x"), (1, "chosen", 0, "user", "q")]
    got = {r.pair_id: r for r in chat_format.pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    one = got[1]
    assert one.prompt == "<|user|>\nq<|end|>\n" and one.prompt_turns == 1 and one.chosen.startswith("<|assistant|>\ngood<|end|>\n<|user|>\nmore")
    a, b = map(int, one.chosen_spans.split(":"))
    assert one.chosen[a:b] == "good<|end|>\n" and "< |bad|>" in one.rejected
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt_turns == 1 and got[3].rejected == "" and got[3].chosen == "<|user|>\n<|end|>\n" and set(got) == {1, 2, 3}


def test_preference_odd_tables(spark):
    kinds = "pair_id long, side string, turn long, role string, text string"
    assert chat_format.pairs(spark.createDataFrame([], kinds)).count() == 0
    df = spark.createDataFrame([(1, "chosen", 0, "user", "x" * 200_000), (1, "rejected", 0, "assistant", "")], kinds).withColumns({k: F.lit("clash") for k in ("prompt", "chosen", "rejected", "said", "t", "c", "prompt_turns")})
    (row,) = chat_format.pairs(df).collect()
    assert row.prompt == "" and len(row.chosen) > 200_000 and row.rejected == "<|assistant|>\n<|end|>\n" and row.rejected_spans == "14:22"


# ---- 8


def test_field_on_held_out_pages():
    f, wrong, total = html_crf.learned(), 0, 0
    for page, labels in html_crf.labelled_pages(150, 4242):
        got = f.decode(html_crf.blocks(page), {})
        wrong, total = wrong + sum(g != bool(y) for g, y in zip(got, labels, strict=True)), total + len(labels)
    assert wrong < 0.02 * total


P = "<p>Thoren and ingly erst the onwh. Reat hein ther, thion asto.</p>"


@pytest.mark.parametrize("page, want", [
    (f'<div class="header"><a href="/">Home</a></div><div class="content"><h1>Title here</h1>{P}<div class="ad">Buy now.</div>{P}</div><div class="footer">&copy; x</div>', "Title here P P"),
    (f'<main><h1>T e</h1>{P}{P}</main><section id="comments"><h2>Comments</h2><div class="comment"><p>Great, thanks a lot. Really.</p></div></section>', "T e P P"),
    (f'<noscript>No</noscript><div id="main"><p>A&nbsp;&lt;b&gt; &#233;<br/>c</p>{P}</div><p class="copyright">All rights reserved</p>', "A <b> é c P"),
    (f"<article>{P}<!-->{P}<!--->{P}<!-- a > b --!>{P}</article>", "P P P P"),
    (f"<article>{P}<p>The value of <math><mi>a</mi><mo>+</mo><mn>2</mn><annotation>a+2</annotation></math> is larger, and <svg viewBox='0 0 1 1'><title>t</title><text>so</text></svg> it stays. {P[3:]}</article>", "P The value of a+2 is larger, and so it stays. P"),
    (f"<article>{P}{P}</article><div class='a b c d e f g h i j k l m n comments'><p>Great, thanks a lot. Really.</p></div>", "P P"),
    (f"<article>{P}<script>x('<p>no</p>')</script><!-- <p>no</p> --><style>p{{}}</style>{P}", "P P"), ("", ""), (None, ""),
])
def test_main_text(page, want):
    assert html_crf.main_text(page, html_crf.learned()).replace(re.sub("<.*?>", "", P), "P") == want


@pytest.mark.parametrize("n", [100, 450, 5000])
def test_cues_anywhere_in_a_block(n):
    assert "cue" in html_crf.text_features("x" * n + " see our privacy policy", 0) and "cue" not in html_crf.text_features("x" * n, 0)


@pytest.mark.parametrize("n", [1, 60])
def test_raw_elements_end_at_their_end_tag(n):
    page = f"<article><p>{'İ' * n} en.</p><script>x</SCRIPT><b>ab</b><p>last words of all.</p></article>"
    assert "".join(b.text for b in html_crf.blocks(page)) == "İ" * n + " en.ablast words of all."


def test_extract_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "no tags at all, only one long sentence. And then another one."), (5, f"<article>{P * 2000}</article>"), (5, f"<article>{P * 2000}</article>"), (None, f"<article>{P}</article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("clash"), "key": F.lit("x")})
    got = html_crf.extract(df).collect()
    plain = re.sub("<.*?>", "", P)
    assert sorted((r.page_id or 0, r.n_chars) for r in got if r.page_id != 4) == [(0, len(plain)), (1, 0), (2, 0), (3, 0), *[(5, 2000 * (len(plain) + 1) - 1)] * 2] and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) and r.key == "x" for r in got) and html_crf.extract(df.where("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a\"", "<", ">", "<a href=", "x y", "&amp", "<!--", "-->", "<br/>", "</div>", "<script>", "</script>", "<li>", "\"", "'", "<table><tr><td>", "<p", "é"]), max_size=40).map("".join))
def test_any_markup_is_read(page):
    html_crf.main_text(page, html_crf.learned())


def test_long_damaged_page_is_linear():
    html_crf.main_text("<p " + "a='" * 200_000, html_crf.learned())
    html_crf.main_text("<div>" * 20_000 + "x", html_crf.learned())


# ---- 9


def test_reparameterised_questions(spark):
    frame = "Then: {} has {} apples and gives {} apples to Anna every single day. How many apples does he keep after {} days have gone by?"
    rows = [(1, frame.format("Tom", 5, 2, 5)), (2, frame.format("Jim", 7, 4, 9)), (3, "Nothing of this kind is in here, only apples and days."), (4, None), (5, ""), (6, "so " + frame.format("Tom", 3, 1, 3).upper()), (1, frame.format("Tom", 5, 2, 5))]
    items = spark.createDataFrame([(1, frame.format("Sue", 3, 1, 3)), (1, frame.format("Sue", 3, 1, 3)), (2, "so short"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()]
    assert got.count((1, 1)) == 2 and {d for d, _ in got} <= {1, 6}  # 2 uses different fillers where the item's are equal
    assert {r.doc_id for r in decontam.drop_contaminated(docs, items).collect()} >= {2, 3, 4, 5}
    assert decontam.contaminated(docs, items.where("false")).count() == 0 and decontam.contaminated(docs.where("false"), items).count() == 0


def test_literal_items_are_all_found(spark):
    r = random.Random(6)
    items = [(i, text_of(r, 20)) for i in range(30)]
    docs = [(i, text_of(r, 40) + " " + items[i][1] + ". " + text_of(r, 40)) for i in range(30)] + [(100 + i, text_of(r, 90)) for i in range(60)]
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(30)}


def test_items_of_figures(spark):
    items = [(1, "Compute 12 + 45."), (2, "Solve 3x + 5 = 20 for x"), (3, "10 20 30 40 50 60"), (4, "they bought red apples and green pears at some market, 5 6 5 6 5 6 5")]
    docs = [(1, "Now compute 12 + 45. Then rest."), (2, "Now compute 13 + 45. Then rest."), (3, "Please solve 3x + 5 = 20 for x today."), (4, "Please solve 4x + 6 = 21 for x today."), (5, "we plot x 7, 9 for x in here"), (6, "it says 10 20 30 40 50 60 there"), (7, "it says 11 20 30 40 50 61 there"), (8, "they bought red apples and green pears at some market, 5 6 7 8 9 1 2")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (4, 2), (6, 3), (8, 4)} and all(r.coverage == 1 for r in got if r.doc_id != 8)
    assert {r.doc_id: r.exact_slots for r in got} == {1: True, 3: True, 4: False, 6: True, 8: True}


def test_reparameterised_recall_against_brute_force(spark):
    """Names that open sentences, names and numbers of several words: every planted question is found, and nothing else."""
    r = random.Random(11)
    names, towns = ["Tom", "Sue", "Jim", "Anna Lee", "Mary Ann"], ["Paris", "New York", "Rome", "San Jose"]
    figures = ["7", "12", "40", "1,250", "twenty five", "ninety"]
    w = lambda n: " ".join(text_of(r, n).split())
    frames = [f"{{0}} {w(5)} {{2}} {w(4)} in {{1}} {w(6)}. {{0}} then {w(5)} {{3}} {w(5)} and {{1}} {w(4)}." for _ in range(25)]
    fill = lambda f: f.format(r.choice(names), r.choice(towns), *r.sample(figures, 2))
    items = [(i, fill(f)) for i, f in enumerate(frames)]
    docs, want = [], set()
    for i, f in enumerate(frames * 4):
        docs.append((i, f"{text_of(r, 20)}. {fill(f)} {text_of(r, 20)}"))
        want.add((i, i % 25))
    docs += [(1000 + i, f"{text_of(r, 20)} in Paris 7 {text_of(r, 30)} New York 12") for i in range(40)]
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_slots_over_a_shifted_alignment():
    import pyarrow as pa

    def matched(*diags):
        d = pa.array([[{"diag": k, "wpos": w, "fills": [{"i": i, "d": x} for i, x in f]} for k, w, f in diags]], pa.list_(pa.struct([("diag", pa.int32()), ("wpos", pa.list_(pa.int32())), ("fills", pa.list_(pa.struct([("i", pa.string()), ("d", pa.string())])))])))
        out = next(decontam._consistent([pa.record_batch([pa.array([b"k"]), pa.array([1]), pa.array([9], pa.int32()), d], ["key", "item_id", "n_windows", "diags"])]))
        return out.column(3)[0].as_py(), out.column(4)[0].as_py()

    a = (5, [0, 1, 2, 3], [("n:3", "n:4"), ("p:sue", "p:tom")])
    assert matched(a, (6, [6, 7], [("p:sue", "p:tom")])) == (6, False)
    assert matched(a, (6, [6, 7], [("p:sue", "p:jim")])) == (4, False) and matched(a, (6, [6, 7], [("p:ann", "p:tom")])) == (4, False)
    assert matched((0, [1], [("n:3", "n:3")])) == (1, True) and matched((0, [1], [("n:3", "n:3"), ("n:3", "n:4")])) == (0, True)


def test_decontamination_odd_rows(spark, odd):
    item = "Seven quiet rivers carry green paper boats toward the old harbour every spring"
    docs = odd.withColumns({c: F.lit("clash") for c in ("item_id", "hash", "pos", "slots", "t", "wpos", "out", "coverage")})
    docs = docs.union(docs.where("doc_id = 5").withColumns({"doc_id": F.lit(50).cast("long"), "text": F.concat("text", F.lit(". " + item + ". "), "text")}))
    items = spark.createDataFrame([(1, item, "x"), (None, item, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, hash string")
    got = decontam.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.exact_slots) for r in got] == [(50, 1, True)]
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_templates():
    t, nums, names, units = decontam.template("Tom has twenty five apples. In New York, Anna Lee pays 7 euros to McDonald and Éva")
    assert t.split() == "\x04tom has \x01 apples. \x04in \x02 , \x02 pays \x01 \x03 to mcdonald and \x02".split() and nums == ["twenty five", "7"] and units == ["euros"]
    assert names == ["new york", "anna lee", "éva"]


def test_slices_of_the_benchmark_agree(spark, monkeypatch):
    r = random.Random(7)
    items = spark.createDataFrame([(i, text_of(r, 20)) for i in range(20)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("x y z. "), "text").alias("text"))
    monkeypatch.setattr(decontam, "SLICE", 50)
    assert decontam.contaminated(docs, items).count() == 20


# ---- 10


def test_grammar():
    lex = toxicity.Lexicon({"idiot": 5.0, "vequ*": 4.0})
    pattern = lambda t: {p for p, v in zip(toxicity.PATTERNS, lex.patterns(t) or [], strict=False) if v}
    assert pattern("such an idiot here") == {"insult"} and pattern("you are an idiot") == {"insult+"}
    assert pattern("he is not an idiot") == {"insult~+"} and pattern("the paper said idiot") == {"insult'"}
    assert pattern("i will kill you") == {"threat", "threat>"} and pattern("vequxyz") == {"insult"} and pattern("nothing. here") == set()
    assert pattern("not here. idiot") == {"insult"} and lex.patterns(None) is None and lex.patterns("") is None
    assert pattern("not an idiot, you") == {"insult~", "insult~>"} and {k for _, k in [(1, x) for x in toxicity.Lexicon({"zap": 4.0}, frozenset(["zap"])).read("zap")[:1]]} == {"threat"}


def test_weights_are_on_the_arcs():
    """A clause's score is the sum over its patterns of arc weight times word weight, by the composed machine alone."""
    r = random.Random(4)
    lex = toxicity.Lexicon({"idiot": 5.0, "moron": 3.0})
    arcs = [r.uniform(-1, 2) for _ in toxicity.PATTERNS]
    machine = toxicity.weighted_grammar(arcs)
    for _ in range(300):
        clause = " ".join(r.choice(["idiot", "moron", "kill", "you", "not", "said", "\"", "reat", "asto"]) for _ in range(r.randrange(1, 9)))
        want = sum(a * x for a, x in zip(arcs, lex.patterns(clause) or [0.0] * len(arcs), strict=True))
        best, total = lex.scores(clause, machine)
        assert abs(best - max(0.0, want)) < 1e-9 and abs(total - max(0.0, want)) < 1e-9
    assert lex.scores("idiot. moron", machine)[1] == pytest.approx(sum(max(0.0, arcs[0] * x) for x in (5.0, 3.0)))


def test_threats_are_learned(spark):
    r = random.Random(13)
    rows = [(i, f"{text_of(r, 8)} i {r.choice(['will', 'must', 'can'])} {r.choice(['zarg', 'blick'])} {r.choice(['you', 'them', 'him'])} {text_of(r, 4)}. {text_of(r, 3)} snark {text_of(r, 8)}" if i % 2 else text_of(r, 25), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.learn(df, df)
    assert {"zarg", "blick"} <= m.threats and "snark" in m.weights and "snark" not in m.threats


def test_toxicity_held_out(spark):
    r = random.Random(8)
    bad = "idiot moron scum loser".split()
    rows, labels = [], []
    for i in range(500):
        w = text_of(r, 40).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(40), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.learn(docs, marked.where("doc_id < 300"))
    got = {x.doc_id: x for x in toxicity.toxicity(docs, m).collect()}
    assert all(got[i].predicted == y for i, y in labels) and set(bad) <= set(m.weights)
    for none in (marked.where("false"), marked.where("toxic = 1"), marked.where("toxic = 0")):
        assert toxicity.toxicity(docs, toxicity.learn(docs, none)).count() == 500


def test_toxicity_odd_rows(spark, odd):
    rows = toxicity.toxicity(odd, toxicity.Model({"word": 5.0}, [-3.0, 1.0, 1.0])).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and {r.doc_id for r in rows if r.predicted} == {5}

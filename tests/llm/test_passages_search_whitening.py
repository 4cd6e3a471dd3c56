"""Word-window repeats, ranked search and whitening against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import common, decontam, language, near_dedup, ranked_search, suffix_trees, whitening


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def frame(spark, rows):
    """Texts with columns that clash with names used inside."""
    common.ship(spark)
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], "doc_id long, text string, g string, h int, data string, first int").repartition(3)


def brute_windows(rows, length):
    """doc_id -> (n_words, n_removed, sha) by looking at every window; rows of one id and text count once."""
    words = {r: [w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w] for r in rows}
    seen, gone = set(), {r: set() for r in words}
    for r in sorted(words, key=lambda r: r[0]):
        w = words[r]
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[r].update(range(s, s + length))
            seen.add(k)
    return {r[0]: (len(w), len(gone[r]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[r]).encode()).hexdigest()) for r, w in words.items()}


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    shared = [prose(rng, rng.randint(20, 90)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared).split()
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            a = rng.randint(0, len(p) // 3)
            parts += [" ".join(p[a:]), prose(rng, rng.randint(0, 30))]
        rows.append((i * 7 % 120, rng.choice(["", "\n"]) + " \t".join(parts)))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a " * 19), (204, "a " * 20), (205, "a " * 400), (206, "a b " * 300), (207, "Ünï é ñ 語 " * 30)]
    rows += [(208, rows[3][1]), (209, rows[3][1]), (210, prose(rng, 8000)), (211, "x" * 100_000), (3, dict(rows)[3])]
    return rows


@pytest.mark.parametrize("group", [suffix_trees.GROUP, 3])
def test_repeated_windows_match_brute_force(spark, passages, group, monkeypatch):
    monkeypatch.setattr(suffix_trees, "GROUP", group)
    got = suffix_trees.remove_repeated_passages(frame(spark, passages)).collect()
    want = brute_windows(set(passages), 20)
    assert len(got) == len(passages)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert sum(r["n_removed"] > 0 for r in got) > 60


@pytest.mark.parametrize("length", [1, 2, 5, 33])
def test_repeated_windows_of_any_length(spark, passages, length):
    got = suffix_trees.remove_repeated_passages(frame(spark, passages), length=length).collect()
    want = brute_windows(set(passages), length)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_repeated_windows_null_ids_and_text_ids(spark):
    text = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), ("b", text), ("a", "new " + text)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_trees.remove_repeated_passages(df).collect()}
    assert got == {None: 0, "a": 40, "b": 40}
    assert suffix_trees.remove_repeated_passages(df.limit(0)).count() == 0


def test_chunks_of_trees_hold_whole_groups(spark, passages, monkeypatch):
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 40, 500))
    monkeypatch.setattr(suffix_trees, "CHUNK_ROWS", 25)
    cuts = list(suffix_trees._whole_groups(group))
    assert cuts[0][0] == 0 and cuts[-1][1] == 500 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert all(group[end - 1] != group[end] for _, end in cuts[:-1])


def brute_search(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in term.findall(t or "")]
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = set()
    for item, text in set(items):
        scored = []
        for i, w in held:
            score = 0
            for x in set(words(text)):
                tf = w.count(x)
                if tf:
                    m = 10 + (90 * len(w) * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        for rank, (score, null, i) in enumerate(sorted(scored)[:top], 1):
            out.add((item, rank, None if null else i, -score))
    return out


@pytest.mark.parametrize("segment", [ranked_search.SEGMENT, 16])
def test_ranked_search_matches_brute_force(spark, segment, monkeypatch):
    rng = random.Random(4)
    docs = [(i * 13 % 300, prose(rng, rng.randint(1, 80), 120)) for i in range(300)]
    docs += [(400 + k, docs[5][1]) for k in range(30)] + [(500, None), (501, ""), (502, " -- "), (503, "Ünï w3-W4_w5 語"), (504, "w1 " * 5000), (None, docs[9][1])]
    items = [(i, prose(rng, rng.randint(1, 30), 140)) for i in range(25)] + [(30, None), (31, "..."), (32, "nothing-here"), (33, docs[5][1]), (33, docs[5][1]), (34, "W3 ünï ÜNÏ"), (None, "w1 w2")]
    monkeypatch.setattr(ranked_search, "SEGMENT", segment)
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, rank int")
    got = [tuple(r) for r in ranked_search.search(frame(spark, docs), queries).collect()]
    want = brute_search(docs, items, 10)
    assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 100)
    assert {tuple(r) for r in ranked_search.search(frame(spark, docs), queries, top=3).collect()} == brute_search(docs, items, 3)


def test_ranked_search_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b"), (2, "b")]), spark.createDataFrame([(1, "b")], "item_id int, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert [r["doc_id"] for r in ranked_search.search(docs, items).orderBy("rank").collect()] == [2, 1]


def vectors(rng, n, width):
    base = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 0.2
    return [[float(np.float32(v)) for v in row] for row in base]


def check_whitening(got, rows, components, scale=64):
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(scale * c) + 1_000_000 for c in v] for i, v in fine}
    fit = sorted({tuple(v) for v in x.values()})
    n, width = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * v - s for v, s in zip(row, sums, strict=True)] for row in fit], dtype=float) / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(components, int((value > 1e-12 * value[0]).sum()))
    assert len(got) == len(fine) * k
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x[i], sums, strict=True))
        z = (np.array([n * v - s for v, s in zip(x[i], sums, strict=True)], dtype=float) / n) @ vector[:, c] / math.sqrt(value[c])
        assert abs(abs(r["whitened"]) - abs(z)) < 1e-6 and abs(r["explained"] - value[c] / value.sum()) < 1e-9 and r["identity_error"] < 1e-6
    return width


def test_whitening_matches_plain_covariance(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(vectors(rng, 300, 20)))
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(500, None), (501, [None] * 20), (502, [math.nan] * 20), (503, [math.inf] + [0.0] * 19), (504, [-3000.5] + [0.25] * 19)]
    common.ship(spark)
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int").repartition(5)
    check_whitening(whitening.whiten(df).collect(), rows, 16)


def test_whitening_of_few_rows_other_lengths_and_none(spark):
    common.ship(spark)
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    rows = [("a", [0.0, 1.0, 2.0]), ("b", [1.0, 1.0, 2.5]), (None, [1.0, 1.0, 2.5]), ("c", [4.0, 1.0, -2.0])]
    got = whitening.whiten(make([*rows, ("d", [1.0]), ("e", [])])).collect()
    check_whitening([r for r in got if r["vec_id"] is not None], [r for r in rows if r[0] is not None], 16)
    assert len(got) == 8 and {r["component"] for r in got} == {1, 2}
    assert whitening.whiten(make(rows).limit(0)).count() == 0
    assert whitening.whiten(make([("a", [1.0, 2.0]), ("b", [1.0, 2.0])])).count() == 0  # no variance, no component
    huge = whitening.whiten(make([("a", [1e17, 0.0]), ("b", [-1e17, 1.0]), ("c", [0.0, 5.0])])).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] != "c")


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 40, (130, 5))
    x[:, 2] = 0
    bits = [int(v).bit_length() for v in x.max(axis=0)]
    got = whitening.weighted(whitening.plane_products(whitening.bit_planes(x.view(np.uint64), bits)), bits)
    for i in range(5):
        for j in range(i, 5):
            assert got[i][j] == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True))


def test_near_duplicates_share_words_not_forms(spark):
    """Two words of one polynomial hash modulo 2**64 at any odd base (Thue-Morse over two letters and its complement) stay apart."""
    common.ship(spark)
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    got = near_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_near_duplicates_of_a_group_around_the_threshold(spark, monkeypatch):
    """Many copies of one text whose edits leave some pairs above 0.8 and some below: components as by all pairs, with short lists and few hubs."""
    common.ship(spark)
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 2)
    rng = random.Random(8)
    base = prose(rng, 120, 5000).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in rows}
    least = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least
    assert 1 < len(set(least.values())) < 70


def test_decontamination_pairs_grow_with_windows_not_items(spark):
    """A thousand items of one length: a window is compared with those it shares shingles with, and marks stay in words."""
    common.ship(spark)
    rng = random.Random(12)
    items = [(i, " ".join(f"q{rng.randrange(5000)}" for _ in range(12))) for i in range(1000)]
    held = [(k, f"{prose(rng, 30)} {items[k * 37][1]} {prose(rng, 30)}") for k in range(20)] + [(100 + k, prose(rng, 80)) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r["doc_id"]: (r["kept"], r["item_id"]) for r in decontam.decontaminate(spark.createDataFrame(held, "doc_id long, text string"), bench).collect()}
    assert got == {k: (False, k * 37) for k in range(20)} | {100 + k: (True, None) for k in range(20)}
    hindi = "यह एक लंबा वाक्य है जिसमें कई शब्द हैं"
    assert [len(r["w"]) for r in spark.createDataFrame([(hindi,)], "t string").select(decontam.words(decontam.F.col("t")).alias("w")).collect()] == [len(hindi.split())]


def test_language_filters_grow_with_rich_scripts(spark, monkeypatch):
    """More trigrams than a small filter holds: the filter grows, is filled to a third at most, and still tells the languages."""
    common.ship(spark)
    rng = random.Random(21)
    rich = lambda: "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(900))
    rows = [(i, rich() if i % 2 else " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(60)), "zh" if i % 2 else "xx") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "SLOTS", 1 << 13)
    filters = language.fit(docs)
    assert filters.bits.shape[1] > 1 << 18 and max(filters.fill) < 0.4
    got = language.identify(docs, filters).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5)

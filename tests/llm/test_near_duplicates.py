import random
import re
from itertools import combinations

import numpy as np

from crawlquarry.llm import near_duplicates as nd
from crawlquarry.llm.words import WordHashes, shingles, unique_by_owner

S = nd.Settings(width=3, threshold=0.6, min_words=20, bands=60, rows=6)


def sets(text, width=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}, len(w)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for v in range(4):
            x = list(base)
            for _ in range(v * 3):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts[f"g{g}v{v}"] = " ".join(x)
    texts["copy"] = texts["g0v0"].upper().replace(" ", "  ,")
    texts["short"] = "a b c"
    texts["none"], texts["empty"], texts["one"] = None, "", "same " * 50
    return texts


def brute(texts):
    s = {k: sets(t) for k, t in texts.items() if t}
    s = {k: v for k, (v, n) in s.items() if n >= S.min_words}
    return {tuple(sorted((a, b))) for a, b in combinations(s, 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6}


def test_pairs_and_groups(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [("g1v0", texts["g1v0"], 2), (None, "x", 1)], "key string, text string, id int")
    found = nd.near_duplicates(df, S)
    got = {(r.key_a, r.key_b) for r in nd.key_pairs(found).collect()}
    want = brute(texts)
    assert len(want) > 30 and got <= want and len(want - got) <= 0.02 * len(want)
    groups = {r.key: r.group_id for r in nd.duplicate_groups(found).collect()}
    assert groups["g0v0"] == groups["copy"] == groups["g0v1"] != groups["g1v0"]
    assert "short" not in groups and "none" not in groups


def test_blocks_and_both_fetches_agree(spark):
    texts = corpus(2)
    df = spark.createDataFrame(list(texts.items()), "key string, text string")
    small = nd.Settings(width=3, threshold=0.6, min_words=20, bands=60, rows=6, block=2)
    a = {tuple(r) for r in nd.key_pairs(nd.near_duplicates(df, S)).collect()}
    b = {tuple(r) for r in nd.key_pairs(nd.near_duplicates(df, small, small=1)).collect()}
    assert a == b


def test_large_classes_are_stars(spark):
    texts = corpus(4)
    rows = list(texts.items()) + [(f"z{i}", texts["g0v0"]) for i in range(9)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "key string, text string"), S)
    listed = [tuple(r) for r in nd.key_pairs(found).collect()]
    every, star = brute(dict(rows)), set(listed)
    assert len(listed) == len(star)
    # The same form at every size: each copy with the least key, and both with the texts they resemble.
    copies = {"g0v0", "copy", *(f"z{i}" for i in range(9))}
    least = min(copies)
    assert {p for p in star if set(p) <= copies} == {tuple(sorted((least, c))) for c in copies - {least}}
    apart = {p for p in every if not set(p) & copies}
    assert {p for p in star if not set(p) & copies} <= apart and len(apart - star) <= 0.03 * len(apart)
    linked = {p for p in every if len(set(p) & copies) == 1}
    assert linked and {p for p in star if len(set(p) & copies) == 1} == linked


def test_a_key_with_two_texts_is_verified_on_one(spark):
    texts = corpus(5)
    rows = [("k", texts["g2v0"]), ("k", texts["g3v0"]), ("a", texts["g2v0"]), ("b", texts["g3v0"]), ("k", None)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "key string, text string"), S)
    partner = "a" if texts["g2v0"] > texts["g3v0"] else "b"
    assert [tuple(r) for r in nd.key_pairs(found).collect()] == [tuple(sorted((partner, "k")))]


def test_one_band_over_all_texts_is_spread(spark):
    # Every class shares a band; the cells of the grid bound what one task compares.
    s = nd.Settings(width=3, threshold=0.6, min_words=3, bands=2, rows=2, block=16, sketch=4)
    rows = [(i, bytes([i % 5, i % 3, 7, 7]), [42, 1000 + i]) for i in range(200)]
    signed = spark.createDataFrame(rows, "id long, sketch binary, bands array<long>")
    got = {tuple(r) for r in nd.candidate_pairs(signed, s).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(rows[a][1], rows[b][1])) >= s.sketch_matches()
    assert got == {(a, b) for a in range(200) for b in range(a + 1, 200) if alike(a, b)}


def test_superminhash_estimates_and_blocks():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**62, 3000).astype(np.uint64)
    b = np.concatenate([a[:2000], rng.integers(0, 2**62, 1000).astype(np.uint64)])
    v, o = unique_by_owner(np.concatenate([a, b]), np.repeat([0, 1], [3000, 3000]))
    h = nd.superminhash(v, o, 2, 512)
    assert abs((h[0] == h[1]).mean() - 0.5) < 0.08
    assert (h == nd.superminhash(v, o, 2, 512, block=700)).all()


def test_groups_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in nd.groups(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_empty_and_long(spark):
    assert nd.key_pairs(nd.near_duplicates(spark.createDataFrame([], "key string, text string"), S)).count() == 0
    long = " ".join(f"t{i}" for i in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long + " end")], "key string, text string")
    assert nd.key_pairs(nd.near_duplicates(df, S)).collect()[0]["key_a"] == "a"


def test_shingles_of_edges():
    v, o, n = shingles([None, "", "one two", "Ein_zwei DREI vier", "…"], 3, WordHashes())
    assert list(n) == [0, 0, 2, 4, 0] and list(o) == [3, 3]

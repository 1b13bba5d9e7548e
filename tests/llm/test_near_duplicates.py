"""Chosen-path join, cross-split overlap and their parts against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import chosen_path as CP
from rankloom.llm import overlap as O
from rankloom.llm.codepoints import runs, word_hashes
from rankloom.llm.minwise import signatures

WORDS = [f"w{i}" for i in range(3000)]


def shingles(t, k=3):
    w, cur = [], ""
    for c in (t or "").lower():
        if c.isalnum():
            cur += c
        elif cur:
            w.append(cur)
            cur = ""
    w += [cur] if cur else []
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(8, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            w = list(base)
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(rng.choice([" ", "  ", "_", "\n"]).join(w).title() if rng.random() < 0.3 else " ".join(w))
    return out


def test_words_and_runs():
    texts = ["Ab_cd  é9-x", "", "one two", "a b c a b c", "中文 字 x" * 2]
    doc, h = word_hashes(texts)
    assert np.bincount(doc, minlength=5).tolist() == [4, 0, 2, 6, 5]
    doc, s = runs(texts, 3)
    assert np.bincount(doc, minlength=5).tolist() == [2, 0, 0, 3, 3]
    assert set(runs(["AB CD ef"], 3)[1]) == set(runs(["ab, cd... EF!"], 3)[1])


def test_signatures_estimate_likeness():
    a = " ".join(WORDS[:400])
    b = " ".join(WORDS[:300] + WORDS[1000:1100])
    i, h, n, tokens, sketch = signatures([a, b, "x y", a.upper()], 3)
    assert i.tolist() == [0, 1, 3] and (h[0] == h[2]).all() and (h[0] != h[1]).any()
    assert abs((tokens[0] == tokens[1]).mean() - likeness(shingles(a), shingles(b))) < 0.25


def brute(rows, k=3, t=0.6):
    sets = [(i, shingles(x, k)) for i, x in rows if i is not None and x is not None]
    return {(min(a, b), max(a, b)) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if a != b and likeness(x, y) >= t}


@pytest.fixture
def small_nodes(monkeypatch):
    monkeypatch.setattr(CP, "SMALL_NODE", 4)
    monkeypatch.setattr(CP, "LEVELS", 3)


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, t string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    links, copies = CP.near_duplicates(df, "k", "t", k=3, threshold=0.6)
    return {(r.key_a, r.key_b) for r in CP.expanded(links, copies).collect()}


def test_equals_brute_force(spark):
    rows = list(enumerate(corpus())) + [(900, None), (901, ""), (902, "a b"), (None, WORDS[0]), (903, " ".join(WORDS * 3))]
    rows += [(1000 + i, rows[0][1].upper()) for i in range(5)]
    assert pairs_of(spark, rows) == brute(rows)


def test_deep_trees_and_blocks(spark, small_nodes):
    """Many texts alike in nearly all runs stay in one node to the last level and are compared in blocks."""
    base = WORDS[:60]
    rows = [(i, " ".join(base[:30] + [f"x{i}"] + base[30:])) for i in range(25)] + [(100 + i, t) for i, t in enumerate(corpus(2, 10))]
    assert pairs_of(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert pairs_of(spark, []) == set()
    assert pairs_of(spark, [(1, "a b c d")]) == set()
    assert pairs_of(spark, [(1, None), (2, "")]) == set()


def test_classes_and_links(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h!"), (3, "a b c d e f g x"), (4, "q r s t u")]
    df = spark.createDataFrame(rows, "k bigint, t string")
    links, copies = CP.near_duplicates(df, "k", "t", k=3, threshold=0.6)
    assert [(r.a, r.b) for r in links.collect()] == [(1, 3)] and [(r.id, r.rep) for r in copies.collect()] == [(2, 1)]


def test_overlap_equals_brute_force(spark):
    texts = corpus(4, 30)
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["train", "train", "validation", "test", None, "other"])) for i, t in enumerate(texts)]
    rows += [(500, None, "train"), (501, "", "test"), (502, "a b", "test"), (503, "a b", "train"), (504, texts[0], "train"), (505, texts[0].upper(), "test"), (506, texts[0] + ".", "validation")]
    df = spark.createDataFrame(rows, "k bigint, t string, split string").withColumn("side", F.lit("clash"))
    found, copies = O.cross_split_matches(df, "k", "t", "split", k=3, threshold=0.6)
    got = {(r.eval_id, r.train_id) for r in O.expanded(found, copies).collect()}
    ev = [(i, shingles(t)) for i, t, s in rows if s in ("validation", "test")]
    tr = [(i, shingles(t)) for i, t, s in rows if s == "train"]
    assert got == {(a, b) for a, x in ev for b, y in tr if likeness(x, y) >= 0.6} and (505, 504) in got
    none, _ = O.cross_split_matches(df.filter("split = 'train'"), "k", "t", "split", k=3, threshold=0.6)
    assert none.count() == 0


def family(shared, near, own, groups, size):
    """Groups of texts: words that all texts have, words of the group, words of the text."""
    words = lambda name, n: [f"{name}x{i}" for i in range(n)]
    return [(g * size + i, " ".join(words("all", shared) + words(f"g{g}", near) + words(f"g{g}t{i}", own))) for g in range(groups) for i in range(size)]


def test_recall_of_a_large_family(spark):
    """Several hundred texts, all alike just above the threshold."""
    rows = family(102, 0, 32, 1, 400)
    want = brute(rows)
    assert len(want) == 400 * 399 // 2
    assert len(pairs_of(spark, rows) & want) >= 0.9995 * len(want)


def test_recall_in_deep_trees(spark, monkeypatch):
    """Pairs just above the threshold in groups of texts that share less than half of their runs: large nodes at many levels."""
    monkeypatch.setattr(CP, "SMALL_NODE", 8)
    rows = family(42, 35, 24, 20, 20)
    want = brute(rows)
    assert len(want) == 20 * 20 * 19 // 2
    assert len(pairs_of(spark, rows) & want) >= 0.999 * len(want)


def test_trees_suffice_at_every_level():
    for t in (0.5, 0.6, 0.8, 0.9):
        roots = len(CP.root_places(t, CP.trees_for(t)))
        assert all(CP.missed(t, roots, level) <= 1e-4 for level in range(1, CP.LEVELS + 1))


def union_find(pairs):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(rng.randrange(2000, 2300), rng.randrange(2300, 2600)) for _ in range(250)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {r.id: r.label for r in CP.components(links).collect()} == union_find(pairs)
    assert CP.components(links.limit(0)).count() == 0


def groups_of(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, t string")
    links, copies = CP.near_duplicates(df, "k", "t", k=3, threshold=0.6, groups_only=True)
    links = CP.materialize(links, "links")
    found = {r.id: r.label for r in CP.components(links).collect()}
    found |= {r.id: found.get(r.rep, r.rep) for r in copies.collect()} | {r.rep: found.get(r.rep, r.rep) for r in copies.collect()}
    return found, links


def test_groups_by_hubs_equal_those_of_all_links(spark, monkeypatch):
    monkeypatch.setattr(CP, "SMALL_NODE", 8)
    monkeypatch.setattr(CP, "LEVELS", 3)
    for rows in (family(42, 35, 24, 6, 12), list(enumerate(corpus(5, 40))) + [(900 + i, corpus(5, 1)[0].upper()) for i in range(3)]):
        found, _ = groups_of(spark, rows)
        assert found == union_find(brute(rows))


def test_a_node_of_many_near_alike_texts_ends(spark):
    """Variants of one page cost a comparison each, not one a pair."""
    n = 20_000
    page = F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(40)], F.concat(F.lit("v"), "k"), *[F.lit(f"z{i}") for i in range(40)])
    df = spark.range(n).select(F.col("id").alias("k")).withColumn("t", page)
    links, _ = CP.near_duplicates(df, "k", "t", k=3, threshold=0.6, groups_only=True)
    links = CP.materialize(links, "links")
    assert n - 1 <= links.count() < 3 * n
    assert CP.components(links).agg(F.count_distinct("label"), F.count(F.lit(1))).first() == (1, n)


def test_large_sets_of_copies_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(CP, "SMALL_NODE", 3)
    copies = spark.createDataFrame([(i, 0) for i in range(1, 20)] + [(31, 30)], "id bigint, rep bigint")
    links = spark.createDataFrame([(0, 30)], "a bigint, b bigint")
    got = [(r.key_a, r.key_b) for r in CP.expanded(links, copies).collect()]
    everyone = [*range(20), 30, 31]
    assert sorted(got) == sorted((a, b) for a in everyone for b in everyone if a < b)

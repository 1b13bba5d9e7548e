"""The encoding against the public libraries, and the mix against its promises."""

import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.VOCABULARIES), reason="needs the vocabularies")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\xa0", "\u3000", "1", "²", "é", "e\u0301", "中", "😀", "_", "-", ".", "''", "'S", "\r\n", "\u200b", "\x1c", "\x85", "x" * 50, "<|endoftext|>", "hello", "World", "\x00"]


def test_equals_the_library(spark, reference):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += [None, "", "a" * 5000, " " * 3000 + "x", "é" * 2000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20000)), "it's we'll I'd they've 's 'LL"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(0)).repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encoded(df, "doc_id", "text", bpe.read_ranks()).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (reference.encode_ordinary(t) if t else []), repr(t)[:200]
    counts = {r.doc_id: r.n_tokens for r in bpe.encoded(df, "doc_id", "text", bpe.read_ranks(), counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_rows_keep_their_number(spark):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (1, "x"), (2, None)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), len(r.ids)) for r in bpe.encoded(df, "doc_id", "text", bpe.read_ranks()).collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
    assert bpe.encoded(df.limit(0), "doc_id", "text", bpe.read_ranks()).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    v = bpe.Vocabulary(bpe.read_ranks())
    text = ["one two three one"]
    first = v.encode(text)[1].tolist()
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    assert v.encode(text)[1].tolist() == first
    v.known, v.check = v.known, v.check ^ v.check  # as if other pieces had these hashes
    assert v.encode(text)[1].tolist() == first


def docs(spark, n=4000, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["a", "b", "c", "x", None], [60, 25, 3, 10, 2])[0], rng.choice([0, 5, 40, 200, 900])) for i in range(n)] + [(1, "a", 50), (None, "b", 10)]
    return spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint").withColumn("slot", F.lit("clash"))


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, share double, cap int")


def test_shares_caps_and_report(spark):
    t = targets(spark, [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("missing", 0.1, 5)])
    mix, plan = mixing.mixed(docs(spark), t)
    rows = mix.toPandas()
    per = rows.groupby("source").n_tokens.sum()
    for s, w in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert per[s] / per.sum() == pytest.approx(w, abs=0.01)
    uses = rows.groupby(["source", "id"]).use
    assert (rows.groupby("source").use.max() <= [1, 2, 3]).all() and (uses.nunique() <= 3).all()
    first = rows[rows.slot < rows.slot.max() / 4].groupby("source").n_tokens.sum()
    assert first["a"] / first.sum() == pytest.approx(4 / 9, abs=0.05)
    report = {r.source: r for r in mixing.shares(mix, plan).collect()}
    assert not report["a"].spent and report["missing"].tokens == 0 and report["missing"].reachable_share == 0 and report["a"].actual_share == pytest.approx(4 / 9, abs=0.01)


def test_mix_edges(spark):
    d = docs(spark, 50)
    for t in ([], [("nobody", 1.0, 1)], [("a", 0.0, 1)], [("a", None, None), (None, 1.0, 1)], [("a", 0.5, 0)]):
        mix, _ = mixing.mixed(d, targets(spark, t))
        assert mix.count() == 0
    mix, plan = mixing.mixed(d, targets(spark, [("a", 0.2, None), ("a", 0.3, 4)]))
    (one,) = plan.collect()
    assert one.max_repeats == 1 and one.target_share == pytest.approx(0.5) and mix.count() > 0
    assert mixing.mixed(d.limit(0), targets(spark, [("a", 1.0, 1)]))[0].count() == 0


def mirrored(k, bits):
    return int(format(k, f"0{bits}b")[::-1], 2)


def test_slots_equal_the_sequence():
    rng = random.Random(3)
    for bits in (1, 5, 9):
        cuts = sorted({0, 1 << bits, *(rng.randrange(1 << bits) for _ in range(6))})
        for first, end in zip(cuts, cuts[1:]):
            want = [k for k in range(1 << bits) if first <= mirrored(k, bits) < end]
            n = end - first
            got = mixing.nth_slot(np.arange(n), np.full(n, first), np.full(n, n), bits)
            assert got.tolist() == want
    big = mixing.nth_slot(np.array([0, 10**12]), np.array([5, 5]), np.array([1 << 50, 1 << 50]), 52)
    assert (big >= 0).all() and (big < 1 << 52).all() and mirrored(int(big[1]), 52) - 5 < 1 << 50


def test_ten_thousand_sources_share_the_slots(spark):
    n = 10_000
    d = spark.range(3 * n).select("id", F.concat(F.lit("s"), F.pmod("id", F.lit(n)).cast("string")).alias("source"), F.lit(100).cast("bigint").alias("n_tokens"))
    t = spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit(1.0 / n).alias("share"), F.lit(2).alias("cap"))
    mix, plan = mixing.mixed(d, t)
    _, bits, _ = mixing.plan(t, d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    assert plan.agg(F.sum("slots")).first()[0] == 1 << bits
    assert mix.select("source").distinct().count() > 0.5 * n and mix.agg(F.max("use")).first()[0] <= 2
    sched = mixing.schedule(plan, bits)
    assert sched.count() == sched.select("slot").distinct().count() == 1 << bits


def test_spent_sources_fall_short_and_say_so(spark):
    t = targets(spark, [("a", 0.4, 1), ("c", 0.6, 2)])
    size = 400_000
    mix, plan = mixing.mixed(docs(spark), t, total=size)
    report = {r.source: r for r in mixing.shares(mix, plan).collect()}
    assert report["c"].spent and not report["a"].spent
    assert report["c"].tokens == 2 * report["c"].source_tokens and report["a"].tokens == pytest.approx(0.4 * size, rel=0.01)
    assert report["c"].actual_share < 0.6

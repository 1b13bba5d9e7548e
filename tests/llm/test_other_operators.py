"""Top-N, canonical copies, q-digests, cut texts and stuffed pages on small tables and edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import canonical, qdigest, stuffing, topn, truncation


# top N


def plain_top(rows, n):
    best: dict = {}
    for t, s, x in rows:
        if x is not None and x == x:
            best.setdefault(t, {})[s] = max(best.get(t, {}).get(s, float("-inf")), x)
    return {(t, s, r + 1) for t, d in best.items() for r, (s, _) in enumerate(sorted(d.items(), key=lambda p: (-p[1], p[0] is None, p[0] or 0))[:n])}


def test_top_n_equals_sorting(spark):
    rng = random.Random(1)
    special = [None, float("nan"), float("-inf"), float("inf"), 0.0, -0.0, 1e-320, -2.5, 0.5]
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(40)]), rng.choice(special + [rng.gauss(0, 1)] * 9)) for _ in range(3000)]
    rows += [("ties", i % 500, 0.25) for i in range(2000)] + [("two", i % 2, 0.1 * (i % 2)) for i in range(400)] + [("low", i, float("-inf")) for i in range(50)]
    df = spark.createDataFrame(rows, "task_id string, sid int, score double").withColumn("item", F.lit("clash")).withColumn("rank", F.lit(9)).repartition(5)
    got = {(r.task_id, r.sid, r["rank"]) for r in topn.top_n_per_group(df, ["task_id"], "score", "sid", 5).collect()}
    assert got == plain_top(rows, 5)
    assert topn.top_n_per_group(df.limit(0), ["task_id"], "score", "sid", 5).count() == 0


def test_thresholds_cut_and_never_too_deep(spark):
    rows = [("a", i, i / 10_000) for i in range(10_000)] + [("b", i % 3, float(i)) for i in range(500)] + [("c", i, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k0 string, item int, score double").withColumn("__bin", topn.score_bin(F.col("score")))
    large = topn.sizes(df, ["k0"], 80)
    assert {r.g_k0: r.g_rows for r in large.collect()} == {"a": 10_000, "b": 500}
    (floor,) = topn.thresholds(df, large, ["k0"], 5).collect()  # b has three items only
    assert floor.f_k0 == "a"
    assert 5 <= df.filter((F.col("k0") == "a") & (F.shiftright("__bin", floor.f_shift) >= floor.f_floor)).count() < 500


@pytest.mark.parametrize("n", [1, 5, 30, 100])
@pytest.mark.parametrize("most", [1, 50_000])
def test_thresholds_by_broadcast_and_by_shuffle(spark, n, most):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "a", "b", "c", None, f"g{i % 40}"]), rng.choice([None, *range(150)]), round(rng.random(), 2)) for i in range(6000)]
    df = spark.createDataFrame(rows, "task_id string, sid int, score double").repartition(4)
    got = {(r.task_id, r.sid, r["rank"]) for r in topn.top_n_per_group(df, ["task_id"], "score", "sid", n, gain=1, most=most).collect()}
    assert got == plain_top(rows, n)


def test_more_groups_with_thresholds_than_are_broadcast(spark):
    df = spark.range(420_000).select(F.floor(F.col("id") / 7).alias("g"), F.pmod("id", F.lit(7)).cast("int").alias("i"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("s"))
    got = topn.top_n_per_group(df, ["g"], "s", "i", 1, gain=4)
    want = df.groupBy("g").agg(F.max(F.struct("s", (-F.col("i")).alias("j"))).alias("m")).select("g", (-F.col("m.j")).alias("i"))
    assert got.count() == 60_000 and got.join(want, ["g", "i"]).count() == 60_000
    assert "TakeOrderedAndProject" not in got._jdf.queryExecution().toString()


def test_bins_never_fall(spark):
    values = sorted([float("-inf"), -1e300, -3.0, -1.0, -1e-310, 0.0, 1e-310, 0.1, 0.125, np.nextafter(0.125, 0), 1.0, np.nextafter(1.0, 0), 2.0, 1e300, float("inf")] + np.random.default_rng(1).normal(size=500).tolist())
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    bins = [r.b for r in df.select("i", topn.score_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    leaves = [r.b for r in df.select("i", qdigest.leaf(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins) and leaves == sorted(leaves) and 0 < min(leaves) and max(leaves) < 1 << qdigest.BITS


# copies


def test_copies(spark):
    rows = [
        (5, '{"task_id":"A/1","solution":"X = 1\\n","count":"2"}'),
        (3, '{ "count": null, "solution":"x=1", "task_id":" a / 1" }'),
        (9, '{"solution":"\\u00c9 x","task_id":"a_1"}'),
        (7, '{"task_id":"a/1","solution":"é-X","count":3}'),
        (8, '{"task_id":"b/1","solution":"x=1","count":1}'),
        (1, None),
        (2, "no json"),
        (4, '{"task_id":"a/1"}'),
        (6, '{"task_id":"a/1","solution":""}'),
        (10, '{"task_id":"a/1","solution":"..."}'),
        (11, '{"task_id":"a/1","solution":"' + "y" * 100_000 + '"}'),
        (12, '{"task_id":"a/1","solution":"' + "Y " * 100_000 + '","count":"many"}'),
        (5, '{"task_id":"A/1","solution":"X = 1\\n","count":"2"}'),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, payload string").withColumn("h", F.lit("clash"))
    keys = canonical.payload_keys(df).cache()
    groups = canonical.collapse(keys)
    got = {r.keep_id: (r.copies, r.total) for r in groups.collect()}
    assert got == {3: (3, 5), 7: (2, 4), 8: (1, 1), 6: (2, 2), 11: (2, 2)}
    assert {(r.keep_id, r.copy_id) for r in canonical.copy_pairs(keys, groups).collect()} == {(3, 5), (7, 9), (6, 10), (11, 12)}
    assert canonical.collisions(groups).count() == 0
    forged = groups.withColumn("h", F.lit(b"0"))
    assert canonical.collisions(forged).first().forms == 5
    assert canonical.collapse(canonical.payload_keys(df.limit(0))).count() == 0


# q-digests


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=1, max_size=400), min_size=1, max_size=5), st.integers(5, 60))
def test_merged_digests_keep_the_bound(parts, k):
    old, qdigest.K = qdigest.K, k
    try:
        total: dict = {}
        for p in parts:
            node, count = np.unique(np.array(p) + (1 << qdigest.BITS), return_counts=True)
            for a, b in zip(*qdigest.compress(node, count)):
                total[int(a)] = total.get(int(a), 0) + int(b)
        node, count = qdigest.compress(np.array(list(total)), np.array(list(total.values())))
        values = np.sort(np.concatenate([np.array(p) for p in parts]))
        n, inner = len(values), node < (1 << qdigest.BITS)
        assert count.sum() == n and (count[inner] <= n // k).all() and len(node) <= 3 * k + 1
        for q, leaf in zip((0.1, 0.5, 0.99), qdigest.quantiles(node, count, (0.1, 0.5, 0.99))):
            rank = max(1, int(np.ceil(q * n - 1e-9)))
            assert (values <= leaf).sum() >= rank and (values < leaf).sum() <= rank - 1 + qdigest.BITS * (n // k)
    finally:
        qdigest.K = old


def test_percentiles(spark):
    rows = [("a", d, float(v)) for d in range(3) for v in range(1, 101)] + [("n", 0, None), ("n", 0, float("nan")), (None, 0, -2.0), ("z", 0, 0.0), ("i", 0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, day int, v double").withColumn("extra", F.lit(1))
    daily = qdigest.digests(qdigest.leaf_counts(df, ["g", "day"], "v"), ["g", "day"])
    got = qdigest.percentiles(qdigest.merged(daily, ["g"]), ["g"], (0.5, 0.95)).collect()
    by = {(r.g, r.percentile): r for r in got}
    assert by["a", 0.5].value == pytest.approx(50, rel=0.002) and by["a", 0.95].value == pytest.approx(95, rel=0.002)
    assert by["a", 0.5].n == 300 and by["a", 0.5].rank_error == 0
    assert by[None, 0.5].value == pytest.approx(-2, rel=0.002) and by["z", 0.5].value == 0 and by["i", 0.5].value > 1e19
    assert not any(r.g == "n" for r in got)
    assert qdigest.merged(daily.limit(0), ["g"]).count() == 0


# cut texts


CODE = "def f(x):\n    y = [a for a in x]\n    return max(y, 3)\n\nprint(f(input()))"


@pytest.mark.parametrize(
    "text, end",
    [
        (CODE, truncation.DONE),
        ("```python\n" + CODE + "\n```", truncation.DONE),
        (CODE[:-24], truncation.OPEN),
        (CODE[:-24] + "\n```", truncation.OPEN),
        (CODE[:48], truncation.OPEN),
        (CODE + " ...", truncation.OPEN),
        (CODE[:40] + "\ufffd", truncation.OPEN),
        ("def f(x:\n    y = (1\n    return x + 1\n", truncation.CLOSED),
        ("def broken(((\n    foo bar baz\n    return 'text here'", truncation.CLOSED),
        ("Add 3 and 4 to get 7. Then double it to get 14. The answer is 14.", truncation.CLOSED),
        ("Add 3 and 4 to get 7. Then double it to get 14.\n#### 14", truncation.DONE),
        ("Add 3 and 4 to get 7. Then double it to ge", truncation.OPEN),
        ("Add 3 and 4 to get 7. Then 2 crates gives 2 * 7 = 1", truncation.OPEN),
        ("pass", truncation.CLOSED),
        ("", truncation.CLOSED),
        (" \n" * 50, truncation.CLOSED),
    ],
)
def test_ends(text, end):
    assert truncation.end_of(text)[2] == end


def test_limits_are_found(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        body = "".join(f"def f{j}(a):\n    b{j} = a + {rng.randrange(1000)}\n    return b{j} * 2\n\n" for j in range(rng.randrange(2, 14))).strip()
        cut = rng.random() < 0.5 and len(body) > 300
        rows.append((i, "limited", body[:300] if cut else body, None if i % 5 == 0 else len(body) // 3))
    rows += [(1000, None, None, 3), (1001, None, "", 3), (1002, "other", "x" * 100_000 + " end.", None)]
    df = spark.createDataFrame(rows, "k bigint, src string, t string, n int").withColumn("source", F.lit("clash"))
    e = truncation.ends(df, "k", "t", "n", "src").cache()
    assert ("limited", "chars", 300) in {(r.source, r.measure, r.length) for r in truncation.spikes(e).collect()}
    got = {r.key: r.cut for r in truncation.truncated(df, "k", "t", "n", "src").collect()}
    assert 1000 not in got and got[1001] is False and got[1002] is False
    want = {r[0]: r[2] is not None and len(r[2]) == 300 for r in rows[:600]}
    wrong = [k for k, v in want.items() if got[k] != v]
    assert len(wrong) <= 0.03 * len(want)  # cuts that fall on the end of a line show nothing
    assert truncation.truncated(df.limit(0), "k", "t", "n", "src").count() == 0


# stuffed pages


SENTENCE = "The old cat must see the new house before the dog can walk. "
PAGES = {
    "keywords": ("cheap red shoes best red shoes red shoes online " * 30, True),
    "lines": ("wild raven solver\n" * 40, True),
    "tags": (" ".join(f"#tag{i % 50}" if i % 2 else f"#red{'abcdefgh'[i % 8]}" for i in range(60)), True),
    "products": ("Products: " + " · ".join(f"{a} {b}" for a in ("red", "old", "new", "big") for b in ("lamp", "cup", "oar", "tent", "boat")), True),
    "links": ("\n".join(f"{i}. https://a{i}.example/b/c{i}.html" for i in range(30)), True),
    "anchors": (" ".join(f'<a href="http://x{i}.test/y">good {i}</a>' for i in range(30)) + "\n" + SENTENCE, True),
    "prose": (SENTENCE * 2 + "A bird in the hand is worth two in the bush. Never was so much owed by so many to so few in the field.", False),
    "prose with tags": ("".join(f"The {a} one must go to the {b} before it is late. " for a, b in zip("abcdefghij", "klmnopqrst")) + "\n#one #two #three", False),
    "code": ("def f(a, b):\n    return [a, b]\n" * 20, False),
    "log": ("\n".join(f"trial {i} sid {i * 7} ran {i % 30} tests in {i}.52s passed" for i in range(40)), False),
    "data": ("input\n" + "\n".join(" ".join(str((i * j) % 997) for j in range(9)) for i in range(30)), False),
    "glossary": ("\n".join(f"term{c}: the {c} part of a thing that is used for the {c} step." for c in "abcdefghijklmnop"), False),
    "empty": ("", False),
    "blank": (" \n\t", False),
    "null": (None, False),
}


def test_pages(spark):
    rows = [(i, t, "en" if i % 2 else None) for i, (t, _) in enumerate(PAGES.values())] + [(100 + i, SENTENCE + f"Then the number {i} is in the box of the house.", "EN") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("key", F.lit("clash")).withColumn("words", F.lit(1))
    got = {r.doc_id for r in stuffing.stuffed_pages(df, "doc_id", "text", "lang").collect()}
    names = list(PAGES)
    assert {names[i] for i in got if i < 100} == {n for n, (_, spam) in PAGES.items() if spam} and max(got) < 100
    assert stuffing.stuffed_pages(df.limit(0), "doc_id", "text", "lang").count() == 0
    assert stuffing.stuffed_pages(df.filter("text is null"), "doc_id", "text", "lang").count() == 0


def english(spark, pages):
    """Pages among 40 of English sentences; the names of those found."""
    names = list(pages)
    rows = [(i, pages[n]) for i, n in enumerate(names)] + [(100 + i, SENTENCE + f"Then the number {i} is in the box of the house.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    return {names[r.doc_id] if r.doc_id < 100 else r.doc_id for r in stuffing.stuffed_pages(df, "doc_id", "text", "lang").collect()}


def shuffled(n, times, seed=1):
    words = [a + b for a in ("lap", "desk", "tab", "note", "net", "chrome") for b in ("top", "let", "book", "pad", "case", "bag")][:n] * times
    random.Random(seed).shuffle(words)
    return words


def test_top_words_and_duplicate_lines(spark):
    pages = {
        "shuffled": " ".join(shuffled(36, 10)),
        "one keyword": " ".join(f"laptop word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)),
        "lines twice": "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(6)) for i in range(20) for _ in range(2)),
        "different words": " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(180)),
        "different lines": "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(6)) for i in range(20)),
        "sentences twice": "\n".join(f"The {x} cat must see the {x} house before the dog can walk to it." for x in ("old", "new", "red") for _ in range(2)),
    }
    assert english(spark, pages) == {"shuffled", "one keyword", "lines twice"}


def test_keyword_phrases_with_full_stops(spark):
    rng = random.Random(3)
    phrase = lambda: f"{rng.choice(('The best', 'Buy the', 'A new'))} cheap laptop for {rng.choice(('gaming', 'school', 'office', 'travel'))}."
    once = ("The old cat sleeps in the sun.", "A bird must leave before it is dark.", "We read to the children all day.", "Snow fell on the roof of his barn.")
    sorts, uses = ("cheap", "small", "light", "fast", "quiet"), ("gaming", "school", "office", "travel", "video", "music", "coding", "photos", "study")
    varied = " ".join(f"Buy the {rng.choice(sorts)} laptop for {rng.choice(uses)} online." for _ in range(60))
    assert 0.25 < stuffing.measure(varied)["fresh"] < 0.5
    pages = {"varied": varied, "phrases": " ".join(phrase() for _ in range(40)), "few phrases": " ".join(x for s in once for x in (phrase(), s)), "prose": PAGES["prose"][0], "glossary": PAGES["glossary"][0]}
    assert stuffing.measure(pages["phrases"])["prose"] == stuffing.measure(pages["phrases"])["words"]
    assert english(spark, pages) == {"phrases", "varied"}


SWAHILI = ["Mtu huyu ni wa kwanza kwa sababu {} yake na {} ya watu ni kubwa.", "Kama {} ni nzuri, basi {} ya mji na kijiji ni bora kwa watu wa hapa.", "Watoto wa {} na wazee ya {} ni hapa kwa siku ya leo na kesho."]


def test_a_language_without_a_list_learns_its_function_words(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bkmpst") + rng.choice("aeiou") for _ in range(4))
    prose = [" ".join(rng.choice(SWAHILI).format(name(), name()) for _ in range(8)) for _ in range(60)]
    spam = [" ".join(rng.choice(("nunua", "simu", "bei", "rahisi", "gari")) for _ in range(120)), "\n".join(" ".join(name() for _ in range(3)) for _ in range(30))]
    rows = [(i, t, "sw") for i, t in enumerate(prose)] + [(100 + i, t, "SW") for i, t in enumerate(spam)] + [(200, "x y", "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    words = stuffing.function_words(df, "text", "lang")
    assert {"ni", "wa", "ya", "na", "kwa"} <= words["sw"] and "simu" not in words["sw"] and "xx" not in words and words["en"] == stuffing.FUNCTION["en"]
    pages = stuffing.measured(df, "doc_id", "text", "lang", words).filter("key < 100")
    assert pages.filter("prose = words").count() == 60
    assert {r.doc_id for r in stuffing.stuffed_pages(df, "doc_id", "text", "lang").collect()} == {100, 101}


HEAD = "class Queue:\n    def __init__(self):\n        self.items = []\n\n"


@pytest.mark.parametrize(
    "text",
    [
        HEAD + "    def put(self, x):\n        self.items.append(x)",
        HEAD + "    def reset(self, n):\n        self.items = [n]",
        HEAD + "    def close(self):\n        pass",
        HEAD + "    def get(self):\n        raise ValueError('no item')",
        HEAD + "    def get(self):\n        raise NotImplementedError",
        HEAD + "    def each(self):\n        for x in self.items:\n            yield x",
        HEAD + "    def drop(self):\n        while self.items:\n            if self.items.pop(): break",
        HEAD + "    def count(self, n):\n        while n > 0:\n            print(n)\n            n = n - 1",
        HEAD + "def main():\n    print(Queue().items)\n\nif __name__ == '__main__':\n    main()",
        HEAD + "queue = Queue()\nresult = len(queue.items)",
        HEAD + "class Empty(Exception):\n    \"\"\"No item is left.\"\"\"",
    ],
)
def test_complete_programs_of_other_endings(spark, text):
    assert truncation.end_of(text)[2] == truncation.WEAK
    df = spark.createDataFrame([(1, text, 30, "a")], "k bigint, t string, n int, src string")
    assert truncation.truncated(df, "k", "t", "n", "src").first()["cut"] is False


@pytest.mark.parametrize("end", ["def", "def pu", "    def put(self, x):", "    def put(self, x):\n        se", "    def put(self, x):\n        if x != sum(x[1:])", "    def put(self, x):\n        self.items = x.ge", "    def put(self, x):\n        last = 2", "    def put(self, x):\n        self.items = ot", "    def put(self, x):\n        \"\"\"Put it"])
def test_broken_ends_need_no_spike(end):
    assert truncation.end_of(HEAD + end)[2] == truncation.OPEN


def test_short_texts_and_limits(spark):
    rng = random.Random(4)
    words = ("apples", "pears", "boxes", "of", "and", "then", "seven", "in", "each", "crate", "with", "more")
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, "chars", prose(12)[:32].rstrip().ljust(32, "x"), None) for i in range(40)] + [(100 + i, "chars", prose(4 + i % 20), None) for i in range(60)]
    rows += [(200 + i, "tokens", prose(40)[:100 + i].rstrip(".") + "x", 32) for i in range(40)] + [(300 + i, "tokens", prose(14 + i % 9), 20 + i % 30) for i in range(60)]
    rows += [(400 + i, "junk", "I can not solve this one", 6) for i in range(30)] + [(500 + i, "junk", t, i) for i, t in enumerate(("pass", "return 0", "x = 1", "...", "", "n/a ..."))]
    rows += [(600, "junk", "def solve(n):\n retu", 6), (601, "junk", "def f(", 3), (602, "junk", "a broken \ufffd", 3)]
    df = spark.createDataFrame(rows, "k bigint, src string, t string, n int")
    e = truncation.ends(df, "k", "t", "n", "src").cache()
    found = {(r.source, r.measure, r.length) for r in truncation.spikes(e).collect()}
    assert {("chars", "chars", 32), ("tokens", "tokens", 32)} <= found and not any(x[0] == "junk" for x in found)
    cut = {r.key for r in truncation.cut_rows(e).filter("cut").collect()}
    assert cut == {*range(40), *range(200, 240), 600, 601, 602}

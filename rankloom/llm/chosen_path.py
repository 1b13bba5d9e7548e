"""Problem 2: near-duplicate records with small edits.

Method: chosen-path set similarity join. A text is the set of its word runs, with minwise tokens of it. A tree sends
each text down paths: a node chooses, by its own hash and so alike for all its texts, some of the token places that its
path hasn't used, and a text goes on to the child named by its token there. Nodes of up to SMALL_NODE texts are compared
exhaustively through a sketch; larger ones branch again. A root has 1/threshold children on average. Below, BRANCH times
as many places are chosen: with 1/threshold of them a pair at the threshold would keep one shared path a level on
average, and such a process dies out. The number of trees is the one that keeps such a pair down to the last level.
A large node that holds more than half of its parent's texts isn't parted by branching, as its texts are alike; these,
and what is still large at the last level, are compared block by block. Candidates are then checked exactly.

That gives every link, of which n mutually similar texts have n * (n - 1) / 2. Groups need no more than a tree of links:
there, each text of a large node is first checked against one text of the node, its hub. Texts connected by such links
aren't compared again, and nodes that hold nothing else are done; the others branch on. A million
variants of one page cost a million comparisons. Groups are the connected parts of the links, by rounds of smallest labels.

Copies (equal sets) are represented by their smallest id throughout, so a text that holds a third of all rows costs as
much as any other. Each level costs one aggregation and one join, both over integers only; the largest nodes are joined
where their rows lie.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.minwise import SKETCH, TOKENS, run_sets, signed
from rankloom.operators.skew import bounded_join, hot_split_join
from rankloom.session import Steps, materialize, release

#: Nodes of at most so many texts are compared exhaustively.
SMALL_NODE = 2048
#: Levels of a tree; what is still large below is compared in blocks of SMALL_NODE texts.
LEVELS = 8
#: Places that a large node chooses, in parts of 1/threshold: the shared children of a pair at the threshold, on average.
BRANCH = 2.5
#: Tables of ids up to this many rows are broadcast (2.4 MB); longer ones go through a shuffle.
BROADCAST_IDS = 300_000

SK = [f"s{i}" for i in range(SKETCH)]


def sized(df: DataFrame) -> DataFrame:
    """``df`` (a written table of ids) marked for broadcast if it is short enough, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def chosen_places(threshold: float) -> float:
    """Places that a large node chooses, on average."""
    return min(BRANCH / threshold, (TOKENS - LEVELS) / 2)


def missed(threshold: float, roots: int, levels: int) -> float:
    """Share of the pairs at the threshold that share no node of the last of ``levels``, if all above are large."""
    few, out = math.floor(chosen_places(threshold)), 0.0
    more = chosen_places(threshold) - few
    for alike in range(TOKENS + 1):  # tokens that the pair shares: fixed, whatever the number of trees
        lost = 0.0  # that a shared node leads to none at the last level
        for used in range(levels - 1, 0, -1):
            p = max(0, alike - used) / (TOKENS - used)
            die = 1 - p + p * lost
            lost = (1 - more) * die**few + more * die ** (few + 1)
        ways = sum(math.comb(alike, i) * math.comb(TOKENS - alike, roots - i) * lost**i for i in range(roots + 1))
        out += math.comb(TOKENS, alike) * threshold**alike * (1 - threshold) ** (TOKENS - alike) * ways / math.comb(TOKENS, roots)
    return out


def trees_for(threshold: float, recall: float = 0.9999) -> int:
    """Trees that miss a pair at the threshold with at most ``1 - recall``, at whatever level it is compared.

    For thresholds below 0.5 the tokens don't suffice at the deeper levels; each place is used once then.
    """
    most = math.floor(TOKENS * threshold)  # each place is a root's child once
    return next((t for t in range(4, most) if missed(threshold, math.floor(t / threshold), LEVELS) <= 1 - recall), max(4, most))


def root_places(threshold: float, trees: int, seed: int = 11) -> list[tuple[int, int]]:
    """(tree, place) of the roots' children: one or two places a tree, 1/threshold on average, no place twice."""
    rng, out, places = random.Random(seed), [], []
    for tree in range(trees):
        n = math.floor((tree + 1) / threshold) - math.floor(tree / threshold)
        for _ in range(n):
            if not places:
                places = rng.sample(range(TOKENS), TOKENS)
            out.append((tree, places.pop()))
    return out


def differing(a: Column, b: Column) -> Column:
    """How many of the 16 groups of four bits differ in two integers."""
    x = a.bitwiseXOR(b)
    y = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bit_count(y.bitwiseAND(F.lit(0x1111111111111111)))


def allowed_differences(threshold: float, sigmas: float = 4.0) -> int:
    """Differing places of the sketch that a pair at the threshold exceeds only by chance of ``sigmas`` deviations."""
    p = threshold + (1 - threshold) / 16
    return min(TOKENS - 1, math.ceil(TOKENS * (1 - p) + sigmas * math.sqrt(TOKENS * p * (1 - p))))


def near(threshold: float) -> Column:
    """Whether the sketches ``s0..`` and ``t0..`` can be those of a pair at the threshold."""
    far = sum((differing(F.col(f"s{i}"), F.col(f"t{i}")) for i in range(1, SKETCH)), differing(F.col("s0"), F.col("t0")))
    return far <= allowed_differences(threshold)


def _hubs(large: DataFrame, reps: DataFrame, threshold: float, level: int, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links ``a, b`` of texts of large nodes with their node's hub.

    A node's hub is the first of its texts, those without a label before others, in an order that all nodes of a level
    share, so that a family of texts has the same hub in all its nodes.
    """
    order = F.struct(F.col("label").isNotNull(), F.xxhash64("id", F.lit(level)), F.col("id"))
    hubs = large.groupBy("node").agg(F.min_by("id", order).alias("hub"), F.count(F.lit(1)).alias("texts")).withColumnRenamed("node", "at")
    star = bounded_join(large.select("node", "id"), materialize(hubs, "hubs"), ["node"], ["at"], "texts").filter("id <> hub").select("id", "hub").distinct()
    star = star.join(reps.select("id", *SK), "id")
    per = star.groupBy("hub").agg(F.count(F.lit(1)).alias("texts")).join(reps.select(F.col("id").alias("hub"), *[F.col(x).alias(f"t{i}") for i, x in enumerate(SK)]), "hub")
    star = bounded_join(star, materialize(per.withColumnRenamed("hub", "center"), "hub-sketches"), ["hub"], ["center"], "texts").filter(near(threshold))
    star = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    return materialize(verify(star), "hub-links").select("a", "b")


def _counted(rows: DataFrame, cross: bool) -> DataFrame:
    """The rows of nodes that can hold a pair between texts not known to be connected, with the node's number of texts."""
    n = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.count("label").alias("labels"), F.min("label").alias("first"), F.max("label").alias("last"))
    one = (F.col("labels") == F.col("n")) & (F.col("first") == F.col("last"))
    n = n.filter((F.col("n") > 1) & ~F.coalesce(one, F.lit(False)) & ((F.col("lo") < F.col("hi")) if cross else F.lit(True))).select("node", "n")
    return hot_split_join(rows, materialize(n, "nodes"), "node", "n")


def _compare(leaf: DataFrame, reps: DataFrame, threshold: float, cross: bool) -> DataFrame:
    """Candidate pairs ``a, b`` within nodes: all pairs of a node whose sketches are near enough."""
    rows = leaf.join(reps.select("id", *SK), "id")
    # rows of a large node meet block by block: the unit (i, j) holds the blocks i and j
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / SMALL_NODE).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("node", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = rows.select("node", "id", "side", "label", *SK)
    other = rows.toDF("node", "id_b", "side_b", "label_b", *[f"t{i}" for i in range(SKETCH)])
    order = (F.col("side") < F.col("side_b")) if cross else (F.col("id") < F.col("id_b"))
    apart = F.coalesce(F.col("label") != F.col("label_b"), F.lit(True))
    pairs = rows.join(other, "node").filter(order & apart & near(threshold))
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def _children(threshold: float) -> Column:
    """(node, used) of the children of a large node that the text with ``tokens`` goes on to."""
    mean = chosen_places(threshold)
    few = math.floor(mean)
    number = few + (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < round(1000 * (mean - few))).cast("int")
    free = F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda p: ~F.array_contains("used", p))
    # each node has its own order of the places, so that those of its path are drawn alike by all its texts
    drawn = F.slice(F.array_sort(F.transform(free, lambda p: F.struct(F.xxhash64("node", p).alias("h"), p.alias("p")))), 1, number)
    return F.transform(drawn, lambda c: F.struct(F.xxhash64("node", c["p"], F.element_at("tokens", c["p"] + 1)).alias("node"), F.array_append("used", c["p"]).alias("used")))


def candidates(reps: DataFrame, threshold: float, cross: bool = False, trees: int | None = None, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs of ids (``a < b``, or with ``cross`` those of side 0 and 1) that share a node and are near by sketch.

    ``reps`` (written): ``id, side, tokens`` and the sketch, one row for each set. With ``verify``, which checks pairs exactly,
    the pairs are only those that groups need: texts connected through hubs aren't paired with each other.
    """
    places = root_places(threshold, trees or trees_for(threshold))
    child = lambda t, p: F.struct(F.xxhash64(F.lit(t), F.lit(p), F.element_at("tokens", p + 1)).alias("node"), F.array(F.lit(p)).alias("used"))
    none = F.lit(None).cast("bigint")
    rows = reps.select(F.explode(F.array(*[child(t, p) for t, p in places])).alias("c"), "id", "side").select("c.*", "id", "side", none.alias("above"), none.alias("label"))
    found, stars = [], None
    for level in range(1, LEVELS + 1):
        kept = materialize(_counted(rows, cross), f"level{level}")
        alike = F.lit(level == LEVELS)
        if verify is None:
            alike = alike | F.coalesce(F.col("n") * 2 > F.col("above"), F.lit(False))
        deeper = (F.col("n") > SMALL_NODE) & ~alike
        found.append(_compare(kept.filter(~deeper), reps, threshold, cross))
        large = kept.filter(deeper)
        if large.isEmpty():
            break
        if verify is not None:
            hubs = _hubs(large, reps, threshold, level, verify)
            found.append(hubs)
            stars = hubs if stars is None else stars.unionByName(hubs)
            large = large.drop("label").join(components(stars), "id", "left")
        large = large.select("node", "used", "id", "label", F.col("n").alias("above")).join(reps.select("id", "side", "tokens"), "id")
        rows = large.select(F.explode(_children(threshold)).alias("c"), "id", "side", "above", "label").select("c.*", "id", "side", "above", "label")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (written: ``a, b``) whose likeness is at least the threshold, with it (``likeness``).

    Only the texts that occur in a pair are read into sets.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = materialize(run_sets(texts.join(sized(ids), "id", "left_semi"), k), "sets")
    d = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    both = F.size(F.array_intersect("x", "y"))
    d = d.withColumn("likeness", both / (F.size("x") + F.size("y") - both))
    return d.filter(F.col("likeness") >= threshold).select("a", "b", "likeness")


def distinct_sets(texts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(one row for each different set of word runs and side; ``id, rep``: the row that stands for each text)."""
    all_ = materialize(signed(texts, k), "signatures")
    groups = all_.groupBy("h", "side").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = materialize(groups.select(F.concat("h", F.unhex(F.hex("side"))).alias("k"), "rep", "copies"), "copies")
    copies = hot_split_join(all_.select(F.concat("h", F.unhex(F.hex("side"))).alias("k"), "id"), groups, "k", "copies")
    copies = materialize(copies.filter("id <> rep").select("id", "rep"), "members")
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    reps = all_.join(F.broadcast(copies.select("id")) if few else copies.select("id"), "id", "left_anti")
    return reps if few else materialize(reps, "representatives"), copies


def near_duplicates(df: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, groups_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links between different texts whose likeness reaches the threshold, and the copies of each.

    Returns (``a, b, likeness``: pairs of representatives, a < b; ``id, rep``: every text that is a copy of another
    set, with the smallest key of that set). Copies are not expanded into pairs; no link between different sets is
    left out but for the recall of the method (0.9999 at the threshold, at every depth of the trees, more above it; less
    in deep trees for thresholds below 0.5).

    Null texts and texts with fewer than ``k`` words take no part; a row with a null key takes none either. Rows with
    equal keys are one document. An empty table gives no rows; other columns of ``df`` are not read.
    """
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.lit(0).alias("side"), F.col(text).alias("text")).filter("id is not null and text is not null")
    reps, copies = distinct_sets(texts, k)
    verify = (lambda pairs: verified(materialize(pairs, "checked"), texts, k, threshold)) if groups_only else None
    with Steps() as levels:
        found = candidates(reps, threshold, verify=verify)
    pairs = materialize(found, "pairs")
    levels.release()
    return verified(pairs, texts, k, threshold), copies


def components(links: DataFrame) -> DataFrame:
    """``id, label`` of every id in ``links`` (``a, b``): the smallest id that it is connected with.

    Each round a text takes the smallest label of its neighbours, then the label of that label, so that paths halve; rounds
    go on until no label falls. An id that many others are linked to, or a label that many have, is joined where the rows lie.
    """
    edges = materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "edges")
    degree = edges.groupBy("y").agg(F.count(F.lit(1)).alias("weight"), F.least(F.min("x"), F.first("y")).alias("label"))
    labels = materialize(degree.select(F.col("y").alias("id"), "label", "weight"), "labels")
    while True:
        mine = labels.select(F.col("id").alias("of"), F.col("label").alias("near"), "weight")
        low = bounded_join(edges, mine, ["y"], ["of"], "weight").groupBy("x").agg(F.min("near").alias("low"))
        hooked = labels.join(low, labels["id"] == low["x"]).select("id", "weight", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        hooked = materialize(hooked, "hooked")
        users = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("users"))
        above = hooked.select(F.col("id").alias("up"), F.col("label").alias("top")).join(users.withColumnRenamed("label", "up"), "up")
        jumped = bounded_join(hooked, materialize(above, "above"), ["label"], ["up"], "users")
        jumped = materialize(jumped.select("id", "weight", "was", F.col("top").alias("label")), "labels")
        if jumped.filter("label < was").isEmpty():
            return jumped.select("id", "label")
        release(labels)
        release(hooked)
        labels = jumped.select("id", "label", "weight")
        labels._rankloom_path = jumped._rankloom_path


def expanded(links: DataFrame, copies: DataFrame) -> DataFrame:
    """All pairs of rows behind links and copies: ``key_a, key_b`` with key_a < key_b. The result is as long as there are pairs; a
    large set of copies is paired block by block, so that no task has it whole."""
    reps = links.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(copies.select("rep")).distinct()
    members = copies.unionByName(reps.select(F.col("rep").alias("id"), "rep"))
    left, right = members.toDF("x", "a"), members.toDF("y", "b")
    between = links.join(left, "a").join(right, "b").select("x", "y")
    sizes = materialize(copies.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("n")).withColumnRenamed("rep", "of"), "sizes")
    mine = bounded_join(members, sizes, ["rep"], ["of"], "n").withColumn("blocks", F.ceil(F.col("n") / SMALL_NODE).cast("int"))
    mine = mine.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = mine.select("rep", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("id").alias("x"))
    # a pair of one block meets in the unit (i, i) only, one of two blocks in (i, j)
    once = (F.col("i") == F.col("j")) | (F.col("block") != F.col("block_y"))
    within = unit.join(unit.toDF("rep", "i", "j", "block_y", "y"), ["rep", "i", "j"]).filter((F.col("x") < F.col("y")) & once).select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def _solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/solutions.parquet").select("solution_key", "solution")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, copies = near_duplicates(_solutions(spark, sf_dir), "solution_key", "solution", k=3, threshold=0.6)
    return expanded(materialize(links, "links"), copies)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text that has a copy or a link: ``solution_key, class_id`` (its set), ``links`` (other sets)."""
    links, copies = near_duplicates(_solutions(spark, sf_dir), "solution_key", "solution", k=3, threshold=0.6)
    degree = materialize(links, "links").select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    reps = degree.select("rep").unionByName(copies.select("rep")).distinct()
    members = copies.unionByName(reps.select(F.col("rep").alias("id"), "rep"))
    out = members.join(degree, "rep", "left")
    return out.select(F.col("id").alias("solution_key"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of connected rows, copies included: ``solution_key, group_id`` (its smallest key) of rows that aren't alone."""
    links, copies = near_duplicates(_solutions(spark, sf_dir), "solution_key", "solution", k=3, threshold=0.6, groups_only=True)
    groups = materialize(components(materialize(links, "links")), "groups")
    group = lambda d: d.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    reps = groups.select(F.col("id").alias("solution_key"), F.col("label").alias("group_id"))
    alone = copies.select("rep").distinct().join(groups.select(F.col("id").alias("rep")), "rep", "left_anti").select(F.col("rep").alias("solution_key"), F.col("rep").alias("group_id"))
    rest = group(copies).select(F.col("id").alias("solution_key"), F.coalesce("label", "rep").alias("group_id"))
    return reps.unionByName(alone).unionByName(rest)


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_groups": p2_groups}

#: Brute force over word runs: the sets of runs of three words (``sh``) and their sizes (``sz``) of a table ``t(k, x)``.
RUNS = """w as (select k, regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+') w from t where x is not null),
l as (select k, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) l from w where len(w) >= 3),
sz as (select k, len(l) n from l), sh as (select k, unnest(l) s from l)"""
LINKS = f"""t as (select solution_key k, solution x from solutions), {RUNS},
c as (select a.k key_a, b.k key_b, count(*) c from sh a join sh b on a.s = b.s and a.k < b.k group by 1, 2),
links as (select key_a, key_b, c / (x.n + y.n - c)::double likeness from c join sz x on x.k = key_a join sz y on y.k = key_b where c / (x.n + y.n - c)::double >= 0.6)"""

SQL: dict[str, str] = {
    "p2_groups": f"""with recursive {LINKS}, e as (select key_a x, key_b y from links union all select key_b, key_a from links),
r as (select distinct x k, x g from e union select e.y, r.g from r join e on e.x = r.k where r.g <= e.y)
select k solution_key, min(g) group_id from r group by 1""",
    "p2_found": f"with {LINKS} select key_a, key_b from links",
    "p2_classes": f"""with {LINKS}, cls as (select k, min(k) over (partition by list_sort(l)) class_id from l),
deg as (select x.class_id, count(distinct y.class_id) links from (select key_a a, key_b b from links union all select key_b, key_a from links) e join cls x on x.k = e.a join cls y on y.k = e.b where x.class_id <> y.class_id group by 1)
select k solution_key, class_id, coalesce(links, 0) links from cls left join deg using (class_id) where links is not null or class_id in (select class_id from cls group by 1 having count(*) > 1)""",
}

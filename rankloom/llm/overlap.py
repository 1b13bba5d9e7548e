"""Problem 4: records of evaluation splits that also occur, exactly or almost, in the training split.

Method: records are canonicalised (case, punctuation, white space), hashed to 128 bits, and the hashes of the
evaluation splits are joined with those of the training split. One hash for the whole record finds equal records only;
for almost equal ones the same join runs over hashes of parts of the canonical record, its minwise word runs, through
the tree of ``chosen_path`` with the evaluation records on one side and the training records on the other. Its
candidates are checked exactly. Matches are counted by split and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.chosen_path import RUNS, candidates, sized, verified
from rankloom.llm.minwise import signed
from rankloom.operators.skew import bounded_join, hot_split_join
from rankloom.session import Steps, materialize

EVALUATION, TRAIN = 0, 1


def canonical_words(text):
    """Lower case, and one space for everything between words; null if there is no word."""
    t = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(t != "", t)


def sides(df: DataFrame, key: str, text: str, split: str, train: str, evaluation: tuple[str, ...]) -> DataFrame:
    """``id, side, text`` of the rows of either side; rows of other or null splits, without key or text, take no part."""
    side = F.when(F.col(split) == train, TRAIN).when(F.col(split).isin(*evaluation), EVALUATION)
    d = df.select(F.col(key).cast("bigint").alias("id"), side.cast("int").alias("side"), F.col(text).alias("text"))
    return d.filter("id is not null and side is not null and text is not null")


def cross_split_matches(
    df: DataFrame, key: str, text: str, split: str, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"), k: int = 5, threshold: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Matches between evaluation and training records, and the copies of each.

    Returns (``a, b, likeness``: an evaluation and a training record whose likeness over runs of ``k`` words reaches
    the threshold, each the smallest key of its copies, equal ones with likeness 1; ``id, rep``: the other copies).

    Texts with fewer than ``k`` words take no part, nor do null texts, keys and splits. Copies aren't expanded. A split
    without rows on either side gives no matches. Other columns of ``df`` are not read.
    """
    texts = sides(df, key, text, split, train, evaluation)
    canon = texts.withColumn("text", canonical_words("text"))
    keyed = canon.filter(F.size(F.split("text", " ")) >= k).select("id", "side", F.unhex(F.md5("text")).alias("h"))
    keyed = materialize(keyed, "records")
    groups = keyed.groupBy("h", "side").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups, "hashes")
    train_side = groups.filter(F.col("side") == TRAIN).select("h", F.col("rep").alias("b"))
    exact = groups.filter(F.col("side") == EVALUATION).select("h", F.col("rep").alias("a")).join(train_side, "h").select("a", "b")

    with_side = lambda d: d.withColumn("k", F.concat("h", F.unhex(F.hex("side"))))
    many = with_side(groups.filter("copies > 1")).select("k", "rep", "copies")
    copies = hot_split_join(with_side(keyed).select("k", "id"), many, "k", "copies").filter("id <> rep").select("id", "rep")
    copies = materialize(copies, "copies")

    own = texts.join(sized(copies.select("id")), "id", "left_anti")
    reps = materialize(signed(own, k), "signatures")
    with Steps() as levels:
        found = candidates(reps, threshold, cross=True)
    near = materialize(found.unionByName(exact).distinct(), "pairs")
    levels.release()
    return verified(near, own, k, threshold), copies


def expanded(matches: DataFrame, copies: DataFrame) -> DataFrame:
    """All pairs of rows behind the matches: ``eval_id, train_id, likeness``."""
    members = lambda c: copies.select("rep", "id").unionByName(matches.select(F.col(c).alias("rep"), F.col(c).alias("id")).distinct())
    d = matches.join(members("a").toDF("a", "eval_id"), "a").join(members("b").toDF("b", "train_id"), "b")
    return d.select("eval_id", "train_id", "likeness")


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = spark.read.parquet(f"{sf_dir}/problems.parquet")
    found, copies = cross_split_matches(d, "problem_key", "description", "split", k=3, threshold=0.6)
    return d, materialize(found, "matches"), copies


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, copies = _matches(spark, sf_dir)
    pairs = expanded(found, copies)
    return pairs.select(F.least("eval_id", "train_id").alias("key_a"), F.greatest("eval_id", "train_id").alias("key_b"))


def per_record(matches: DataFrame, copies: DataFrame) -> DataFrame:
    """``eval_id, best, pairs`` of every evaluation record with a match, from the sizes of the sets of copies: their pairs are
    counted, not made."""
    sizes = materialize(copies.groupBy("rep").agg(F.count(F.lit(1)).alias("more")), "copy-counts")
    per = matches.join(sizes.withColumnRenamed("rep", "b"), "b", "left").groupBy("a").agg(F.max("likeness").alias("best"), F.sum(F.coalesce("more", F.lit(0)) + 1).alias("pairs"))
    per = materialize(per.join(sizes.withColumnRenamed("rep", "a"), "a", "left").withColumn("more", F.coalesce("more", F.lit(0))), "matched")
    others = bounded_join(copies, per, ["rep"], ["a"], "more")
    return others.select(F.col("id").alias("eval_id"), "best", "pairs").unionByName(per.select(F.col("a").alias("eval_id"), "best", "pairs"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: its records, those found in the training split, equal and nearly equal, and pairs."""
    d, found, copies = _matches(spark, sf_dir)
    per = per_record(found, copies)
    base = d.filter(F.col("split").isin("validation", "test")).select("split", "source", F.col("problem_key").alias("eval_id"))
    out = base.join(per, "eval_id", "left").groupBy("split", "source")
    return out.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("best").isNotNull()).alias("in_train"),
        F.count_if(F.col("best") == 1).alias("in_train_equal"),
        F.count_if(F.col("best") < 1).alias("in_train_near"),
        F.coalesce(F.sum("pairs"), F.lit(0).cast("bigint")).alias("pairs"),
    )


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
_PAIRS = f"""t as (select problem_key k, description x from problems where split in ('train', 'validation', 'test')), {RUNS},
side as (select problem_key k, split = 'train' train from problems),
c as (select a.k e, b.k r, count(*) c from sh a join side sa on sa.k = a.k and not sa.train join sh b on a.s = b.s join side sb on sb.k = b.k and sb.train group by 1, 2),
m as (select e, r, c / (x.n + y.n - c)::double likeness from c join sz x on x.k = e join sz y on y.k = r where c / (x.n + y.n - c)::double >= 0.6)"""

SQL: dict[str, str] = {
    "p4_found": f"with {_PAIRS} select least(e, r) key_a, greatest(e, r) key_b from m",
    "p4_report": f"""with {_PAIRS}, per as (select e, max(likeness) best, count(*) pairs from m group by 1)
select split, source, count(*) records, count(best) in_train, count(*) filter (best = 1) in_train_equal, count(*) filter (best < 1) in_train_near, coalesce(sum(pairs), 0)::bigint pairs
from problems left join per on e = problem_key where split in ('validation', 'test') group by 1, 2""",
}

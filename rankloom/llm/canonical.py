"""Problem 6: one record for all that differ only in spelling, with the number of copies.

Method: canonicalise characters, case, white space, punctuation and field order; hash the result to 128 bits; aggregate
counts per hash with map-side combining; check every group for collisions with a second, independent hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.skew import hot_split_join
from rankloom.session import materialize

#: The fields of a payload that are read, whatever their order and layout; a count may come as a number or as text.
PAYLOAD = "task_id string, solution string, count string"


def canonical(text: Column) -> Column:
    """Lower case, and nothing but letters and digits of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def keyed(df: DataFrame, record_id: str, fields: list[Column], weight: Column) -> DataFrame:
    """``id, h, check, weight`` of each record: ``h`` has the 128 bits of the canonical fields, taken in the order given.

    Records in which a field is null have no canonical form and take no part; an empty field, or one without letters and
    digits, is a form like any other. The fields are separated by a character that no canonical form holds. ``check`` is a
    second hash; records are copies only if both agree. Texts are hashed whole. Rows that repeat an id are copies of each
    other and count, but make no pair of an id with itself. An empty table gives no rows; other columns aren't read.
    """
    forms = [canonical(f) for f in fields]
    d = df.select(F.col(record_id).alias("id"), F.concat(*[x for f in forms for x in (f, F.lit("|"))]).alias("form"), weight.alias("weight"))
    d = d.filter(F.col("form").isNotNull())
    return d.select("id", F.unhex(F.md5("form")).alias("h"), F.xxhash64("form").alias("check"), "weight")


def collapse(keys: DataFrame) -> DataFrame:
    """One row for each set of copies: ``h, check, keep_id`` (the smallest id), ``copies`` (rows) and ``total`` (weights).

    Sums and minima combine on the map side, so a set that holds a third of all rows moves one row per partition.
    """
    return keys.groupBy("h", "check").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"), F.sum("weight").alias("total"))


def collisions(groups: DataFrame) -> DataFrame:
    """The 128-bit hashes under which the second hash found more than one form; ``collapse`` has kept those apart."""
    return groups.groupBy("h").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1")


def copy_pairs(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """``keep_id, copy_id``: each record but the smallest of its set, with that smallest one."""
    both = lambda d: d.withColumn("k", F.concat("h", F.unhex(F.hex("check"))))
    left = both(keys).select("k", F.col("id").alias("copy_id"))
    right = both(groups.filter("copies > 1")).select("k", "keep_id", "copies")
    return hot_split_join(left, right, "k", "copies").filter("copy_id <> keep_id").select("keep_id", "copy_id")


def payload_keys(raw: DataFrame) -> DataFrame:
    """The keys of ``raw_records``: one solution of one task, from its JSON payload.

    A null or unreadable payload and one without task or solution take no part; a count that is missing, null or no
    number is 1.
    """
    p = raw.select(F.col("record_id"), F.from_json("payload", PAYLOAD).alias("p"))
    n = F.coalesce(F.expr("try_cast(trim(p.count) as bigint)"), F.lit(1).cast("bigint"))
    return keyed(p, "record_id", [F.col("p.task_id"), F.col("p.solution")], n)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("record_id", "payload")
    keys = materialize(payload_keys(raw), "p6-keys")
    return copy_pairs(keys, materialize(collapse(keys), "p6-groups"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("record_id", "payload")
    return collapse(payload_keys(raw)).select("keep_id", "copies", "total")


QUERIES = {"p6_found": p6_found, "p6_records": p6_records}

#: The payload's canonical form, in SQL.
_FORM = """
select record_id, try_cast(trim(payload->>'$.count') as bigint) n,
  regexp_replace(lower(payload->>'$.task_id'), '[^\\p{L}\\p{N}]+', '', 'g') || '|' ||
  regexp_replace(lower(payload->>'$.solution'), '[^\\p{L}\\p{N}]+', '', 'g') form
from raw_records where payload is not null
"""

SQL = {
    "p6_found": f"""with f as ({_FORM}), g as (select *, min(record_id) over (partition by form) keep from f where form is not null)
select keep keep_id, record_id copy_id from g where record_id <> keep""",
    "p6_records": f"""with f as ({_FORM}) select min(record_id) keep_id, count(*) copies, cast(sum(coalesce(n, 1)) as bigint) total
from f where form is not null group by form""",
}

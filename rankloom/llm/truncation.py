"""Problem 1: texts cut off by field limits or in transfer.

Method: per source, histograms of the length of the text in characters and in bytes and of its number of tokens are
searched for spikes (lengths that occur far more often than their neighbours do); values at such a length are cut if
their end is open. A limit leaves a spike; a broken transfer leaves none, so that away from spikes only a broken end
counts, or one that is hardly ever meant, while at a spike weaker signs suffice: any statement that can end a program.

What was added after the cut (white space, a closing fence, a mark such as ``...``) is set aside before lengths and
ends are looked at. Complete programs with errors aren't cut: only the end is looked at, never the whole syntax.
"""

from __future__ import annotations

import builtins
import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.session import materialize

#: Texts shorter than this are often junk: of their ends only broken code, a lost character or a mark counts away from
#: spikes, and prose of LEAST_WORDS or more without an end at spikes.
LEAST_CHARS, LEAST_WORDS = 40, 4
#: A spike holds at least SPIKE_ROWS values, and TIMES as many as the mean of its neighbours within REACH.
SPIKE_ROWS, TIMES, REACH = 6, 5.0, 40
#: A limit in bytes may lose the rest of a character: such values lie up to three bytes below.
SLACK = 3
#: Bytes per token below this part of the source's lower quartile: there were more tokens than the text holds.
FEW_BYTES = 0.93

#: Ends: one that closes the whole text, one that closes a part, one with weak and one with strong signs of a cut.
DONE, CLOSED, WEAK, OPEN = -1, 0, 1, 2

FENCE = re.compile(r"\r?\n[ \t]*```[ \t]*\s*$")
MARK = re.compile(r"(?:\s*(?:\.\.\.|…|\[(?:\.\.\.|…|truncated|cut|snip)\]|<(?:truncated|cut)>|\(truncated\)))\s*$", re.I)
#: Lines that only programs have; a sentence may begin with "return" or "for" too.
CODE = re.compile(r"^[ \t]*(?:def \w+\s*\(|class \w+[(:]|import \w[\w., ]*$|from \w[\w.]* import\b|print\(|(?:for \w.* in|while|if) .*:\s*$)|^[ \t]+return\b", re.M)
FINAL = re.compile(r"(?:####|\banswer\b\D{0,12}|\btotal\b\D{0,12}|\bresult\b\D{0,12}|[=:])[ \t]*\$?-?\d[\d,.]*%?$", re.I)
IDENT = re.compile(r"[^\W\d]\w*")
STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"")
KNOWN = frozenset(keyword.kwlist) | frozenset(dir(builtins))
PAIRS = {")": "(", "]": "[", "}": "{"}
#: Methods that are called, not read: a line that ends in one, or in the beginning of one, breaks off.
METHODS = frozenset(m for t in (str, list, dict, set) for m in dir(t) if m[0] != "_")
HEAD = re.compile(r"(?:(?:async|def|class|for|while|if|elif|else|try|except|finally|with)\b|(?:match|case) [^=]*:|@)")
STORE = re.compile(r"([^\W\d]\w*)(?:\s*:[^=]*)?\s*(?:[-+*/%&|^]|//|\*\*|<<|>>)?=(?!=)")


def without_additions(text: str) -> tuple[str, bool]:
    """The text without a closing fence and a mark at its end, and whether there was a mark."""
    t = FENCE.sub("", text)
    m = MARK.search(t)
    return (t[: m.start()], True) if m else (t, False)


def code_end(t: str) -> int:
    """How open the end of a program is."""
    lines = t.rstrip().split("\n")
    last = lines[-1].rstrip("\r")
    line = last.strip()
    above = "\n".join(lines[:-1])
    if t.count('"""') % 2 or t.count("'''") % 2:
        return OPEN
    if line.startswith("#"):
        return OPEN if last[:1] in " \t" else WEAK
    bare = STRING.sub("''", line)
    if bare.count("'") % 2 or bare.count('"') % 2:
        return OPEN
    stack = []
    for c in bare:
        if c in "([{":
            stack.append(c)
        elif c in PAIRS and stack and stack[-1] == PAIRS[c]:
            stack.pop()
    if stack or re.search(r"(?:[-+*/%=<>,.:&|^~@\\(\[{]|\b(?:and|or|not|in|is|if|else|for|lambda))$", bare):
        return OPEN
    if re.match(r"(?:return\b|print\()", line):
        names = IDENT.findall(re.sub(r"\.\s*\w+", "", STRING.sub("", line)))
        seen = frozenset(IDENT.findall(above))
        if names and names[-1] not in seen and names[-1] not in KNOWN and line.endswith(names[-1]):
            return OPEN
        return OPEN if line == "return" else DONE if line.startswith("print(") else CLOSED
    if last[:1] not in " \t" and re.match(r"\w+(?:\.\w+)*\(.*\)$", line):  # a call at the top level
        return CLOSED
    return statement_end(last, lines[:-1], bare)


def broken_name(bare: str, seen: frozenset) -> bool:
    """Whether a line ends in a name that the text hasn't had, or in a method that isn't called."""
    m = re.search(r"(\.\s*)?\b([^\W\d]\w*)$", bare)
    if not m or m[2] in seen:
        return False
    return any(x.startswith(m[2]) for x in METHODS) if m[1] else m[2] not in KNOWN


def body_of(line: str) -> str:
    """What follows the colon of a compound statement in its line."""
    depth = 0
    for i, c in enumerate(line):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and not depth and line[i + 1 : i + 2] != "=":
            return line[i + 1 :].strip()
    return ""


def statement_end(last: str, above: list[str], bare: str) -> int:
    """How open a last line is that is no comment, return, print or call at the top level: WEAK if it can be complete."""
    line = body_of(bare) if HEAD.match(bare) else bare
    if not line:  # a compound statement without its body
        return OPEN
    indent = len(last) - len(last.lstrip())
    heads, least = [], indent  # the lines that hold this one, the nearest first
    for i in range(len(above) - 1, -1, -1):
        x = above[i].strip()
        if x and len(above[i]) - len(above[i].lstrip()) < least:
            least = len(above[i]) - len(above[i].lstrip())
            heads.append((i, x))
            if re.match(r"(?:async )?def |class ", x) or not least:
                break
    within = bool(heads) and bool(re.match(r"(?:async )?def ", heads[-1][1]))
    text = "\n".join(above)
    if re.fullmatch(r"[^\W\d]\w*", line) and line not in ("pass", "break", "continue", "yield", "raise"):
        # a name alone: shown by a notebook at the top level, else nothing
        return WEAK if not indent and line in frozenset(IDENT.findall(text)) else OPEN
    if not re.match(r"(?:import|from|global|nonlocal|del|class)\b", line) and broken_name(line, frozenset(IDENT.findall(text))):
        return OPEN
    if within and re.fullmatch(r"[rRuUbBfF]*(?:'')+", line):  # a function of a docstring only
        return OPEN
    store = STORE.match(line)
    if within and store:  # a local name that nothing reads any more
        name = re.compile(rf"\b{store[1]}\b")
        body = above[heads[-1][0] + 1 :]
        loops = [i for i, x in heads if re.match(r"(?:async )?(?:for|while)\b", x)]
        if not any(re.match(r"\s*(?:global|nonlocal)\b", x) and name.search(x) for x in body) and not (loops and name.search("\n".join(above[loops[-1] :]))):
            return OPEN
    return WEAK


def prose_end(t: str) -> int:
    """How open the end of worked reasoning is."""
    line = t.rstrip().rsplit("\n", 1)[-1].strip()
    if re.search(r"[.!?。！？][\"')\]»”]*$|[)\]\"”»]$", line):
        return CLOSED
    if FINAL.search(line):
        clause = re.split(r"[.!?] ", line)[-1]
        return DONE if re.search(r"####|answer|total|result", clause, re.I) else CLOSED if (len(clause.split()) <= 4 and not re.search(r"[*/+]", clause)) else OPEN
    return OPEN


def short_end(t: str, mark: bool) -> int:
    """How open the end of a short text is."""
    many = len(t.split()) >= LEAST_WORDS
    if t.rstrip().endswith("�") or (mark and many) or (CODE.search(t) and code_end(t) == OPEN):
        return OPEN
    return WEAK if many and not CODE.search(t) and prose_end(t) == OPEN else CLOSED


def end_of(text: str) -> tuple[int, int, int]:
    """(characters, bytes without additions, how open the end is)."""
    t, mark = without_additions(text)
    size = len(t), len(t.encode("utf-8", "replace"))
    if len(text.strip()) < LEAST_CHARS:
        return *size, short_end(t, mark)
    if mark or t.rstrip().endswith("�"):
        return *size, OPEN
    if not t.strip():
        return *size, CLOSED
    end = code_end(t) if CODE.search(t) else prose_end(t)
    if end == CLOSED and text.lstrip().startswith("```") and t == text:
        end = WEAK  # the fence was opened and not closed
    return *size, end


def ends(df: DataFrame, key: str, text: str, tokens: str, source: str) -> DataFrame:
    """``key, source, chars, bytes, tokens, openness, same`` (a hash of the text) of the rows with a text; the source
    ``null`` is one of its own."""
    kind = df.select(key).dtypes[0][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [end_of(t) for t in batch.column(4).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), *cols], ["key", "source", "tokens", "same", "chars", "bytes", "openness"])

    d = df.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("null")).alias("source"), F.col(tokens).cast("bigint").alias("tokens"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    d = d.filter(F.col("text").isNotNull())
    return d.mapInArrow(work, f"key {kind}, source string, tokens bigint, same bigint, chars bigint, bytes bigint, openness bigint")


def spikes(rows: DataFrame) -> DataFrame:
    """``source, measure, length, n, usual``: the lengths at which values pile up, by source and measure.

    The histogram has one row per source, measure and length, counted with map-side combining; its windows see lengths,
    not values. Of a spike's values at least a quarter have an open end, else the length is merely frequent. Lengths are
    searched down to 1; a short text counts once, however often it comes, as junk is the same text again and again.
    """
    short = F.col("chars") < LEAST_CHARS
    once = rows.filter(short).dropDuplicates(["source", "same"])
    long = rows.filter(~short).unionByName(once).withColumn("open", (F.col("openness") == OPEN) | (short & (F.col("openness") == WEAK))).select("source", "open", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"), F.lit("tokens"), F.col("tokens"))).alias("measure", "length"))
    hist = long.filter(F.col("length") >= 1).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("open"))
    around = Window.partitionBy("source", "measure").orderBy("length")
    total = F.sum("n").over(around.rangeBetween(-REACH, REACH))
    near = F.sum("n").over(around.rangeBetween(-SLACK, SLACK))
    hist = hist.withColumn("usual", (total - near) / (F.greatest(F.lit(0), F.least(F.lit(REACH), F.col("length") - 1) - SLACK) + float(REACH - SLACK)))
    found = (F.col("n") >= SPIKE_ROWS) & (F.col("n") >= TIMES * F.greatest("usual", F.lit(0.5))) & (F.col("open") * 4 >= F.col("n"))
    return hist.filter(found).select("source", "measure", "length", "n", "open", "usual")


def cut_rows(rows: DataFrame) -> DataFrame:
    """The rows of ``ends`` (written) with ``limit`` (the spike's measure, if any) and ``cut``."""
    by = spikes(rows).groupBy("source").agg(*[F.collect_set(F.when(F.col("measure") == m, F.col("length"))).alias(f"at_{m}") for m in ("chars", "bytes", "tokens")])
    ratio = F.try_divide("bytes", "tokens")
    few = rows.groupBy("source").agg(F.percentile_approx(ratio, 0.25, 1000).alias("usual_bytes"))
    # one row per source: broadcast if it turns out small, else a join whose large partitions adaptive execution splits
    d = rows.join(few.join(by, "source", "left"), "source", "left")
    has = lambda m, c: F.coalesce(F.array_contains(f"at_{m}", c), F.lit(False))
    at_bytes = has("bytes", F.col("bytes"))
    for i in range(1, SLACK + 1):  # a character lost at the limit, only in texts that have some of several bytes or marks of it
        at_bytes = at_bytes | has("bytes", F.col("bytes") + i)
    limit = F.when(has("chars", F.col("chars")), "chars").when(at_bytes, "bytes").when(has("tokens", F.col("tokens")), "tokens")
    short = F.coalesce(ratio < FEW_BYTES * F.col("usual_bytes"), F.lit(False))
    cut = (F.col("openness") == OPEN) | (limit.isNotNull() & ((F.col("openness") == WEAK) | ((F.col("openness") == CLOSED) & short)))
    return d.select("key", "source", limit.alias("limit"), cut.alias("cut"))


def truncated(df: DataFrame, key: str, text: str, tokens: str, source: str) -> DataFrame:
    """``key, source, limit, cut`` of every row with a text.

    Null texts give no row, empty ones are never cut, short ones only as said at LEAST_CHARS. Every delivery of a row counts. A null number of
    tokens takes no part in its histogram; a null source is a source. An empty table gives no rows. Other columns of
    ``df`` are not read. Texts are looked at whole.
    """
    return cut_rows(materialize(ends(df, key, text, tokens, source), "ends"))


def _solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/solutions.parquet").select("solution_key", "solution", "num_tokens", "source")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = truncated(_solutions(spark, sf_dir), "solution_key", "solution", "num_tokens", "source")
    return d.filter("cut").select(F.col("key").alias("solution_key"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: texts, cut ones, their share, and how many of them lie at a limit."""
    d = truncated(_solutions(spark, sf_dir), "solution_key", "solution", "num_tokens", "source")
    at = F.count_if(F.col("cut") & F.col("limit").isNotNull())
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("share"), at.alias("at_a_limit"))


def p1_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _solutions(spark, sf_dir)
    return spikes(materialize(ends(d, "solution_key", "solution", "num_tokens", "source"), "ends"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_spikes": p1_spikes}
SQL: dict[str, str] = {}

"""Problem 9: pages of repeated keywords, link lists or lists of tags and products instead of sentences.

Method: thresholds on signals of stuffing, calibrated per language. A page is cut into segments (lines, and sentences
within them). A segment's words count as stuffing if they are

* in links: addresses, or the text of links (link-text ratio);
* hash tags, or short items between separators, many in a row and without function words (separator density);
* covered by word runs that the page repeats, in segments that are no sentences: without an end mark, or without the
  function words of the page's language (n-gram shares, missing function words);
* in such segments made of the page's top words, or in lines that the page repeats, on pages whose share of top words
  or of duplicate lines is beyond what is usual in their language.

Sentences, code, log lines and numbers never count. What repetition and what share of function words is usual for a
language is measured over all its pages; the thresholds lie beyond it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.skew import bounded_join
from rankloom.session import materialize

#: Share of a page's words that must be stuffing. Sentences without end marks, titles and names leave some words
#: uncounted on either side, so this lies in the middle of the range between the kinds of page.
SHARE = 0.5
#: Share of a page's words that must be stuffing outside of sentences before words in sentences count, unless the page
#: stutters extremely.
LEAST_SHARE = 0.25
#: A page stutters if its share of different runs of three words is below this part of its language's median.
STUTTER = 0.7
#: Below this part of the median the page stutters extremely; or below twice that part, with more top words and fewer
#: function words than usual, as glossaries and other sentences of one form have usual ones.
EXTREME = 0.25
#: Part of the usual share of function words below which there are fewer.
FEWER = 0.8
#: Runs among which that share is taken, so that it doesn't fall with the length of the page.
WINDOW = 120
#: Pages that a language must have for a norm of its own.
LEAST_PAGES = 20
#: Pages with fewer words are no lists.
LEAST_WORDS = 12
#: Short items in a row that make a list.
LEAST_ITEMS = 8
#: A top word occurs so often, and makes up such a share of the page's words without function words.
TOP_TIMES, TOP_SHARE = 3, 0.015
#: Top words among a segment's words from which the segment is made of them; function words that it may have.
TOP_PART, TOP_FUNCTION = 0.4, 0.2
#: Share of the way from the median of the page's language to 1 that top words or duplicate lines must reach.
BEYOND = 0.4

#: Words of up to so many letters that stand on such a share of a language's pages are its function words, the most
#: frequent ones up to a number. A word of a list page stands on few other pages; what most pages share is grammar.
FUNCTION_LETTERS, FUNCTION_PAGES, FUNCTION_MOST = 5, 0.25, 100
#: A language with less than this part of all pages has no list of its own, so that there are at most as many lists as the
#: inverse says, whatever is written into the column.
LANGUAGE_PART = 0.001

#: Function words by language, the ones that hardly any sentence lacks. Fixed values. Chinese: by character. All other
#: languages' are learned from their pages.
FUNCTION_WORDS = {
    "en": "a an the of to in on at by for and or if is are was were so that this it as with each when then not no must may will can would from than but be before after near until wants i we you he she they has have do does using their its which who what how all any there here",
    "de": "der die das den dem des ein eine einen einem eines und oder wenn ist sind nicht mit von zu zum zur im in auf für als bei bevor sobald obwohl alle jeden jede es wir sie er ich dass nach vor aus",
    "fr": "le la les l un une des du de d et ou si est sont pas avec pour dans sur au aux que qui quand même dès avant chaque cette ce ces il elle nous vous je ne se en par plus",
    "es": "el la los las un una unos unas de del y o si es son no con para por en que cuando aunque antes cada esta este estos se al lo su como más está",
    "ru": "и в на не с что как если когда пока все каждый это из по для от до у к о бы но а же он она они мы вы я вышло",
    "zh": "的 了 是 在 和 当 如 果 为 时 之 这 个 每 所 有 不 就 我 们 你 他 也 都 与",
}
FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

WORD = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+")
LINK = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]{0,200}\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\"')\]]+", re.I | re.S)
TAG = re.compile(r"#[^\W\d_][\w-]*")
CODE = re.compile(r"^\s*(?:def |class |import |from \w+ import|return\b|for .*:\s*$|while .*:\s*$|if .*:\s*$|else:|#\s|```|>>>|\"\"\"|@\w)|[={}]|\w\(|\)\s*$.*:|\w\[|^\s*\w+\.py:|^\s{4,}\S")
END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])")
CLOSED = re.compile(r"[.!?…。！？:][\"')\]]*\s*$")
SEPARATOR = re.compile(r"\s*(?:[·•|/,;、，；>»~]|\s[-–—*]\s|\t)\s*")
ITEM = re.compile(r"^(?:[-*•]\s+|\d+[.)]\s+)?(?:(?:tags?|keywords?|products?|labels?|topics?)\s*:?\s+)?((?:[^\W\d_][\w'’-]*)(?: [^\W\d_][\w'’-]*){0,3})$", re.I)

#: A word of letters as Spark's own patterns take it; each Chinese or Japanese character is one.
SHORT = r"[㐀-鿿぀-ヿ]|[\p{L}\p{M}&&[^㐀-鿿぀-ヿ]]+"

MARK = "\x00"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments(text: str) -> Iterator[tuple[str, bool, str]]:
    """The sentences and rests of each line, whether the line is code or a log, and the line."""
    for line in text.split("\n"):
        if not line.strip():
            continue
        code = bool(CODE.search(line))
        for s in [line] if code else END.split(line):
            if s and s.strip():
                yield s, code, line.strip()


def measure(text: str, own: frozenset = FUNCTION["en"], every: frozenset = frozenset().union(*FUNCTION.values())) -> dict:
    """The signals of one page, with the function words of its language and of all languages; where the page has less than
    half as many of its own language as of all, it isn't in that language.

    ``words``; those in ``links``, ``items`` (tags and short items in a row), in repeated runs outside of sentences
    (``loose``) and in sentences (``repeated``); ``prose``, the words of sentences, and ``function``, their function
    words; the share of top words (``top``), of duplicate lines (``dup_lines``) and of different runs of three words
    (``fresh``). Of the other words outside of sentences, those in segments made of top words (``topped``), and in lines
    that occur again (``again``; not counted in ``topped`` too).
    """
    links = 0

    def cut(m: re.Match) -> str:
        nonlocal links
        links += len(WORD.findall(m.group()))
        return f" {MARK} "

    rest = LINK.sub(cut, text) if ("http" in text or "www." in text or "](" in text or "<a" in text.lower()) else text
    parts = list(segments(rest))
    tokens = [words_of(s) for s, _, _ in parts]
    total = links + sum(map(len, tokens))
    out = {"words": total, "links": links, "items": 0, "loose": 0, "prose": 0, "repeated": 0, "function": 0, "other": 0, "topped": 0, "again": 0, "dup_lines": 0.0, "top": 0.0, "fresh": 1.0}
    if total < LEAST_WORDS:
        return out
    pairs: list[tuple] = []
    triples: list[tuple] = []
    content: Counter = Counter()
    for w, (_, code, _) in zip(tokens, parts):
        if not code:
            content.update(w)
            pairs.extend(zip(w, w[1:]))
            triples.extend(zip(w, w[1:], w[2:]))
    known = own if 2 * sum(n for x, n in content.items() if x in own) >= sum(n for x, n in content.items() if x in every) else every
    for x in [x for x in content if x in known or x[0].isdigit()]:
        del content[x]
    grams = {g for c in (Counter(pairs), Counter(triples)) for g, n in c.items() if n >= 3}
    if triples:
        out["fresh"] = sum(len(set(triples[i : i + WINDOW])) for i in range(0, len(triples), WINDOW)) / len(triples)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    out["dup_lines"] = 1 - len(set(lines)) / max(1, len(lines))
    times = Counter(x.strip() for x in rest.split("\n"))
    often = max(TOP_TIMES, TOP_SHARE * content.total())
    heavy = {x for x, n in content.items() if n >= often}
    out["top"] = sum(content[x] for x in heavy) / max(1, content.total())
    run: list[int] = []  # words of the short items in a row

    def close() -> None:
        n = sum(run)
        out["items" if len(run) >= LEAST_ITEMS else "other"] += n
        run.clear()

    for (s, code, line), w in zip(parts, tokens):
        n = len(w)
        if not n:
            continue
        tags = [x for m in TAG.findall(s) for x in WORD.findall(m)] if "#" in s else []
        if len(tags) >= 0.6 * n:
            run.extend([1] * len(tags))
            out["other"] += n - len(tags)
            continue
        if code:
            close()
            out["other"] += n
            continue
        fn = sum(map(known.__contains__, w))
        if fn <= 0.1 * n:
            items = [ITEM.match(p) for p in SEPARATOR.split(s.strip().rstrip(".")) if p]
            if items and sum(map(bool, items)) >= 0.8 * len(items) and (n <= 4 or len(items) >= 3) and not (len(items) < 4 and CLOSED.search(s)):
                run.extend([n // len(items)] * (len(items) - 1) + [n - (n // len(items)) * (len(items) - 1)])
                continue
        close()
        if sum(x[0].isdigit() for x in w) > 0.3 * n:
            out["other"] += n
            continue
        hit = 0
        if grams:
            covered = bytearray(n)
            for size, runs in ((3, zip(w, w[1:], w[2:])), (2, zip(w, w[1:]))):
                for i, g in enumerate(runs):
                    if g in grams:
                        covered[i : i + size] = b"\1" * size
            hit = sum(covered)
        stutters = n >= 4 and hit >= 0.6 * n and len(set(w)) < 0.7 * n
        if not stutters and fn >= max(1, 0.08 * n) and CLOSED.search(s):
            out["prose"] += n
            out["repeated"] += hit
            out["function"] += fn
        else:
            out["loose"] += hit
            out["other"] += n - hit
            if fn <= TOP_FUNCTION * n and sum(map(heavy.__contains__, w)) >= TOP_PART * n:
                out["topped"] += n - hit
            elif times[line] > 1:
                out["again"] += n - hit
    close()
    return out


SHARES = ("dup_lines", "top", "fresh")
FIELDS = ["words", "links", "items", "loose", "prose", "repeated", "function", "topped", "again", *SHARES]


def _lang(lang: str) -> Column:
    return F.lower(F.coalesce(F.col(lang), F.lit("und")))


def function_words(df: DataFrame, text: str, lang: str) -> dict[str, frozenset]:
    """The function words of every language: the fixed ones, and for the other languages, counted over all their pages, those
    that stand on many of them.

    Words are counted once a page, with map-side combining. Lists are bounded (see LANGUAGE_PART and FUNCTION_MOST), so they
    are collected. A language of fewer pages than LEAST_PAGES has none.
    """
    d = df.select(_lang(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    pages = d.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))
    pages = pages.withColumn("all", F.sum("pages").over(Window.partitionBy()))  # one row per language
    pages = pages.filter(~F.col("lang").isin("und", *FUNCTION) & (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LANGUAGE_PART * F.col("all")))
    kept = [r.lang for r in pages.select("lang").collect()]
    if not kept:
        return dict(FUNCTION)
    found = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(SHORT), F.lit(0))), lambda w: F.length(w) <= FUNCTION_LETTERS)
    words = d.filter(F.col("lang").isin(kept)).select("lang", F.explode(found).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = words.join(pages, "lang").filter(F.col("n") >= FUNCTION_PAGES * F.col("pages"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, set] = {}
    for r in words.withColumn("i", first).filter(F.col("i") <= FUNCTION_MOST).select("lang", "word").collect():
        out.setdefault(r.lang, set()).add(r.word)
    return FUNCTION | {k: frozenset(v) for k, v in out.items()}


def measured(df: DataFrame, key: str, text: str, lang: str, words: dict[str, frozenset]) -> DataFrame:
    """``key, lang`` (lower case, ``und`` if null) and the signals of every page; null texts have no words."""
    kind = df.select(key).dtypes[0][1]
    lists = df.sparkSession.sparkContext.broadcast(words)  # at most 1 / LANGUAGE_PART lists of FUNCTION_MOST short words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = lists.value, frozenset()
        every = none.union(*known.values())
        for batch in batches:
            rows = [measure(t or "", known.get(x, none), every) for x, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([r[f] for r in rows], pa.float64() if f in SHARES else pa.int64()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["key", "lang", *FIELDS])

    d = df.select(F.col(key).alias("key"), _lang(lang).alias("lang"), F.col(text).alias("text"))
    out = ", ".join(f"{f} {'double' if f in SHARES else 'bigint'}" for f in FIELDS)
    return d.mapInArrow(work, f"key {kind}, lang string, {out}")


def norms(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is usual per language, and over all pages (one row): the median of each share, few and usual function words."""
    usual = [F.percentile_approx(x, 0.5, 1000).alias(f"{x}_norm") for x in SHARES]
    usual += [F.percentile_approx(F.try_divide("function", "prose"), q, 1000).alias(f"{x}_norm") for x, q in (("function", 0.1), ("functions", 0.5))]
    d = pages.filter(F.col("words") >= LEAST_WORDS)
    per = d.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), *usual).filter(F.col("pages") >= LEAST_PAGES)
    return per, d.agg(*[u.alias(f"any_{n}") for u, n in zip(usual, (*SHARES, "function", "functions"))])


def stuffed_pages(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, share, stutters`` of the pages whose share of stuffing reaches SHARE.

    Segments of top words count where top words, repeated lines where duplicate lines are more than usual in the page's
    language. Words repeated within sentences count too on pages with LEAST_SHARE of stuffing outside of them that stutter beyond
    what is usual in their language, or whose sentences have less than half of the function words that nearly all pages
    of the language have; on pages that stutter extremely they count whatever lies outside of sentences.

    Null, empty and short pages (fewer than LEAST_WORDS words) are none; every row of a page delivered again counts; a
    null or unknown language is judged by the norm over all. An empty table gives no rows. Other columns aren't read.
    """
    pages = materialize(measured(df, key, text, lang, function_words(df, text, lang)), "pages")
    per, over_all = norms(pages)
    per = materialize(per.withColumnRenamed("lang", "of"), "norms")
    d = bounded_join(pages, per, ["lang"], ["of"], "pages", "left").crossJoin(F.broadcast(over_all))
    fresh, function = F.coalesce("fresh_norm", "any_fresh"), F.coalesce("function_norm", "any_function")
    stutters = F.col("fresh") < STUTTER * fresh
    bare = F.coalesce(F.col("function") < 0.5 * function * F.col("prose"), F.lit(False))
    norm = lambda x: F.coalesce(f"{x}_norm", f"any_{x}")
    beyond = lambda x: F.col(x) >= norm(x) + BEYOND * (1 - norm(x))
    outside = F.col("links") + F.col("items") + F.col("loose")
    outside += F.when(beyond("top"), F.col("topped")).otherwise(0)
    outside += F.when(beyond("dup_lines"), F.col("again")).otherwise(0)
    fewer = F.coalesce(F.col("function") < FEWER * norm("functions") * F.col("prose"), F.lit(False))
    extreme = (F.col("fresh") < EXTREME * fresh) | ((F.col("fresh") < 2 * EXTREME * fresh) & beyond("top") & fewer)
    inside = ((stutters | bare) & (outside >= LEAST_SHARE * F.col("words"))) | extreme
    stuffing = outside + F.when(inside, F.col("repeated")).otherwise(0)
    out = d.withColumn("share", F.try_divide(stuffing, F.col("words"))).withColumn("stutters", stutters)
    out = out.filter((F.col("words") >= LEAST_WORDS) & (F.col("share") >= SHARE))
    return out.select(F.col("key").alias(key), "share", "stutters")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return stuffed_pages(d, "doc_id", "text", "lang").select("doc_id")


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}

"""String functions, all as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "\n```"
DUMMY = "__DUMMY__"


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rstrip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def before_fence(c: Column) -> Column:
    """The text before the closing code fence, or all of it."""
    return F.substring_index(c, FENCE, 1)


def before_stops(c: Column, stops: Sequence[str]) -> Column:
    """A sample up to the first of the stop words, or all of it."""
    for s in stops:
        c = F.substring_index(c, s, 1)
    return c


def after_open_fence(c: Column) -> Column:
    """The text after the first opening Python fence, or all of it."""
    return F.when(F.contains(c, F.lit("```python")), F.substring(c, F.locate("```python", c) + 9, 1 << 30)).otherwise(c)


def as_program(c: Column, fenced: bool) -> Column:
    """A raw prediction as a program: carriage returns and trailing space removed, the fenced part taken."""
    t = F.regexp_replace(rstrip_ws(c), "\r", "")
    if fenced:
        t = strip_ws(after_open_fence(t))
    return F.substring_index(t, "\n```\n", 1)


def before_dummy(rendered: Column) -> Column:
    """What a template renders before the place of the program."""
    return F.substring_index(rendered, DUMMY, 1)


def after_prefix(full: Column, prefix: Column) -> Column:
    """The rest of a text after a prefix, by length."""
    return F.substring(full, F.length(prefix) + 1, F.greatest(F.length(full) - F.length(prefix), F.lit(0)))


def lint_report(c: Column) -> dict[str, Column]:
    """Score and message counts of a lint report; a missing or negative score is null."""
    raw = F.regexp_extract(c, r"rated at (-?\d+\.\d+)/10", 1)
    score = F.when(raw.rlike(r"^\d"), raw.try_cast("double"))
    kinds = {"errors": "E", "warnings": "W", "conventions": "C", "refactors": "R", "fatals": "F"}
    return {"score": score} | {n: F.regexp_count(c, F.lit(f":[0-9]+:[0-9]+: {k}[0-9]+:")) for n, k in kinds.items()}


def model_parameters(c: Column) -> Column:
    """The parameters that a model's name states: ``1_5b`` is 1.5e9, ``350m`` 3.5e8; null if it states none."""
    n = F.regexp_replace(F.regexp_extract(F.lower(c), r"(\d+(?:[._]\d+)?)([bm])(?![a-z0-9])", 1), "_", ".")
    unit = F.regexp_extract(F.lower(c), r"(\d+(?:[._]\d+)?)([bm])(?![a-z0-9])", 2)
    return n.try_cast("double") * F.when(unit == "b", 1e9).when(unit == "m", 1e6)


def clock(seconds: Column) -> Column:
    """``HH:MM:SS.ss``."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%05.2f", (whole / 3600).cast("bigint"), ((whole % 3600) / 60).cast("bigint"), seconds - F.floor(whole / 60) * 60)


def safe_name(text: str) -> str:
    """A name as part of a path."""
    return text.replace("/", "_")


def dataset_dir_name(parts: Sequence[tuple[str, object]]) -> str:
    """Settings as a folder name: true flags by name, others by name and value, false and null ones left out."""
    return "_".join(k if v is True else f"{k}={v}" for k, v in parts if v not in (None, False))


def file_task(name: Column) -> Column:
    """The task of a prediction file: its base name up to ``.raw``, ``_exec`` or the first dot."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.regexp_extract(base, r"^(.*?)(?:\.raw|_exec|\.|$)", 1)


def file_shard(name: Column) -> Column:
    """The number at the end of a shard's name."""
    return F.regexp_extract(name, r"(\d+)(?:\.[a-z]+)*$", 1).try_cast("int")


def composite_id(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def renamed_setup(setup: str) -> str:
    """``t0.8_n128`` as the name used in subsets: dots become ``p``."""
    return re.sub(r"(\d)\.(\d)", r"\1p\2", setup)

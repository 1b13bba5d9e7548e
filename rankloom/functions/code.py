"""Functions over Python programs. They need a parser, so they run in Arrow batches, and each different program of a batch
is looked at once."""

from __future__ import annotations

import ast
import difflib
import sys
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import black
except ImportError:  # formatting is optional
    black = None


def parsed(code: str) -> ast.Module | None:
    """The syntax tree, or nothing if the program is invalid in any way the parser knows."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def is_valid(code: str) -> bool:
    return parsed(code) is not None


def imported_packages(code: str) -> list[str]:
    """Top-level names of the packages that a program imports, sorted; relative imports and invalid programs have none."""
    tree, out = parsed(code), set()
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Import):
            out.update(a.name.partition(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
            out.add(node.module.partition(".")[0])
    return sorted(out)


def without_comments(code: str) -> str:
    """The program written anew from its tree, without comments; unchanged if it is invalid."""
    tree = parsed(code)
    try:
        return ast.unparse(tree) if tree else code
    except (RecursionError, ValueError):
        return code


def formatted(code: str) -> str:
    """The program in the formatter's style with a newline at its end; only the newline where that isn't possible."""
    if black is not None:
        try:
            code = black.format_str(code, mode=black.Mode())
        except Exception:
            pass
    return code if code.endswith("\n") else code + "\n"


def cleaned(code: str) -> str:
    """The form in which programs are compared for votes."""
    return formatted(without_comments(code)).strip()


def last_docstring(code: str) -> str | None:
    """The docstring of the last function at the top level."""
    tree = parsed(code)
    functions = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if tree else []
    return ast.get_docstring(functions[-1]) if functions else None


def unified_diff(a: str, b: str) -> str:
    return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm=""))


def standard_modules() -> list[str]:
    """The names of the standard library's modules."""
    return sorted(sys.stdlib_module_names)


def _udf(f: Callable, kind: str) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x in s:
            if x is None:
                out.append(None)
                continue
            if x not in known:
                known[x] = f(x)
            out.append(known[x])
        return pd.Series(out, index=s.index, dtype=object)

    return lambda c: F.pandas_udf(run, kind)(c)


#: Column forms of the functions above; null programs stay null.
valid_syntax = _udf(is_valid, "boolean")
imports = _udf(imported_packages, "array<string>")
strip_comments = _udf(without_comments, "string")
format_code = _udf(formatted, "string")
clean_code = _udf(cleaned, "string")
docstring = _udf(last_docstring, "string")


def diff(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else unified_diff(p, q) for p, q in zip(x, y)], dtype=object)

    return F.pandas_udf(run, "string")(a, b)

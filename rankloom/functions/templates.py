"""Prompts: problem, program and outcome put into one of the known forms, with examples and chat turns.

The strings are fixed values: results must equal them to the character.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import DUMMY

TICKS = "```"


@dataclass(frozen=True)
class Template:
    """A form: what surrounds the problem and the program, the question that ends it, and the outcome's words."""

    before_problem: str
    after_problem: str
    without_problem: str
    before_program: str
    after_program: str
    question: str
    positive: str = "Yes"
    negative: str = "No"
    trim_program: bool = False


TEMPLATES = {
    "qsol_task": Template("# Question\n", "\n\n", "\n", "# Proposed Solution\n```python\n", "\n```", "\n# Is the solution correct (Answer [Yes]/[No])?\n", "[Yes]", "[No]"),
    "base": Template('```python\n"""\n', '\n"""\n', "```python\n", "", "\n```", "# Is the solution correct (Answer Yes/No)?"),
    "prob_sol_yn": Template("[PROBLEM]\n", "\n[/PROBLEM]\n", "", "[SOLUTION]\n```python\n", "\n```\n[/SOLUTION]", "\n"),
    "prob_sol_gb": Template("[PROBLEM]\n", "\n[/PROBLEM]\n", "", "[SOLUTION]\n```python\n", "\n```\n[/SOLUTION]", "\n", "Good", "Bad"),
    "prob_sol_pf": Template("[PROBLEM]\n", "\n[/PROBLEM]\n", "", "[SOLUTION]\n```python\n", "\n```\n[/SOLUTION]", "\n", "[PASSED]", "[FAILED]"),
    "prob_sol_cls": Template("[PROBLEM]\n", "\n[/PROBLEM]\n", "", "[SOLUTION]\n```python\n", "\n```\n[/SOLUTION]", "", trim_program=True),
    "raw_yn": Template("", "\n----------\n\n", "", "", "", "\n"),
    "qsol_old": Template("# Question\n", "\n\n", "\n", "# Proposed Solution\n```python\n", "\n```\n\n# Is the solution correct (Answer [Yes]/[No])?", "\n", "[Yes]", "[No]"),
}


def outcome(t: Template, passed: Column) -> Column:
    return F.when(passed, t.positive).otherwise(t.negative)


def prompt(t: Template, problem: Column, program: Column, newline: bool = False, examples: Sequence[str] = (), instruction: str = "") -> Column:
    """Problem and program in the form; a null or empty problem leaves its part out. ``examples`` are rendered ones."""
    code = F.regexp_replace(program, r"^\s+|\s+$", "") if t.trim_program else program
    lead = F.when(F.coalesce(F.length(problem), F.lit(0)) > 0, F.concat(F.lit(t.before_problem), problem, F.lit(t.after_problem))).otherwise(F.lit(t.without_problem))
    out = F.concat(lead, F.lit(t.before_program), code, F.lit(t.after_program))
    head = (f"{instruction}\n" if instruction else "") + "".join(f"# Example {i}:\n{e}\n\n" for i, e in enumerate(examples, 1))
    if examples:
        head += f"# Example {len(examples) + 1}:\n"
    out = F.concat(F.lit(head), out) if head else out
    return F.when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n"))) if newline else out


def completion(t: Template, passed: Column | None = None) -> Column:
    """The question with the outcome, or without one for scoring."""
    return F.concat(F.lit(t.question), outcome(t, passed)) if passed is not None else F.lit(t.question)


def example(t: Template, problem: str, program: str, passed: bool) -> str:
    """One in-context example, with its real outcome."""
    code = program.strip() if t.trim_program else program
    lead = f"{t.before_problem}{problem}{t.after_problem}" if problem else t.without_problem
    return f"{lead}{t.before_program}{code}{t.after_program}{t.question}{t.positive if passed else t.negative}"


def prefix(t: Template, problem: Column) -> Column:
    """What comes before the program: the form rendered with a dummy program, up to the dummy."""
    return F.substring_index(prompt(t, problem, F.lit(DUMMY)), DUMMY, 1)


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(user: Column, system: str | None = None, assistant: Column | None = None, shots: Sequence[tuple[str, str]] = ()) -> Column:
    """A conversation as an array of turns: system message, worked shots, the user's turn, and an answer to continue."""
    turns = [turn("system", F.lit(system))] if system else []
    for q, a in shots:
        turns += [turn("user", F.lit(q)), turn("assistant", F.lit(a))]
    turns.append(turn("user", user))
    if assistant is not None:
        turns.append(turn("assistant", assistant))
    return F.array(*turns)


def rendered_chat(turns: Column, opening: str = "<|", closing: str = "|>\n", end: str = "<|end|>\n") -> Column:
    """The turns as one text: ``<|role|>``, content, end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(opening), t["role"], F.lit(closing), t["content"], F.lit(end))), "")


def split_at_last_user(turns: Column) -> tuple[Column, Column]:
    """(prompt turns, the answer's content if the last turn is one)."""
    last = F.element_at(turns, -1)
    answer = F.when(last["role"] == "assistant", last["content"])
    return F.when(answer.isNotNull(), F.slice(turns, 1, F.size(turns) - 1)).otherwise(turns), answer


def without_bos(text: Column, bos: str) -> Column:
    return F.when(text.startswith(bos), F.substring(text, len(bos) + 1, 1 << 30)).otherwise(text)

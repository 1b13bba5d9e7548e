"""Settings as frozen records, checked when they are made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from rankloom.functions.text import dataset_dir_name
from rankloom.operators.filters import stage_column

DATASETS = ("code_contests", "gsm8k", "mbpp", "humaneval")
#: Those with tests to run.
EXECUTED = ("humaneval", "mbpp", "code_contests")
#: Stages for which flags are built.
KNOWN_STAGES = ("is_valid_syntax", "has_no_lint_errors", "e3s1t", "e3s2t", "e3s3t", "e3s4t", "e3s5t", "e3s10t")
SEEDS = (1, 1999, 2024)

#: The worked examples of the suites with two shots: problem, program and outcome. Fixed values.
TWO_SHOTS = (
    (
        "Write a function that counts the occurrences of elements in an array.\nassert count_unique([1, 3, 1, 2, 2, 2]) == {1: 2, 3: 1, 2: 3}",
        "def count_unique(arr):\n    return {i: arr.count(i) for i in set(arr)}",
        True,
    ),
    (
        "Write a function to round the given number to the nearest multiple of 10.\n>>> nearest_multiple_10('29')\n30\n>>> nearest_multiple_10('15')\n10",
        "def nearest_multiple_10(num: str):\n    \"\"\" Write a function to round the given number to the nearest multiple of 10.\n    >>> nearest_multiple_10('29')\n    30\n"
        "    >>> nearest_multiple_10('15')\n    10\n    \"\"\"\n    num = int(num)\n    return (num + 5) // 10 * 10",
        False,
    ),
)


@dataclass(frozen=True)
class TaskConfig:
    name: str
    clean_solutions: bool | None = None
    remove_comments: bool | None = None
    icl_examples: tuple[tuple[str, str, bool], ...] = ()


@dataclass(frozen=True)
class EvalSuite:
    """Tasks under one filter stage; a task without its own cleaning settings has the suite's."""

    name: str
    tasks: tuple[TaskConfig, ...] = tuple(TaskConfig(d) for d in DATASETS)
    filter_stage: str | None = None
    remove_timeouts: bool = False
    clean_solutions: bool = False
    remove_comments: bool = False
    rstrip_query: bool = False
    ks: tuple[int, ...] = (4, 16, 64)

    def __post_init__(self) -> None:
        if self.filter_stage is not None and stage_column(self.filter_stage) not in KNOWN_STAGES:
            raise ValueError(f"suite {self.name}: no flags are built for stage {self.filter_stage!r}")
        done = [replace(t, clean_solutions=self.clean_solutions if t.clean_solutions is None else t.clean_solutions, remove_comments=self.remove_comments if t.remove_comments is None else t.remove_comments) for t in self.tasks]
        object.__setattr__(self, "tasks", tuple(done))

    def __getitem__(self, task: str) -> TaskConfig:
        return next(t for t in self.tasks if t.name == task)


SUITES: Mapping[str, EvalSuite] = {
    s.name: s
    for s in (
        EvalSuite("zero_shot"),
        EvalSuite("zero_shot_syntax", filter_stage="is_valid_syntax"),
        EvalSuite("zero_shot_lint", filter_stage="has_no_lint_errors"),
        EvalSuite("zero_shot_3s1t", tasks=tuple(TaskConfig(d) for d in EXECUTED), filter_stage="execute_3s1t"),
        *(EvalSuite(f"zero_shot_3s{n}t", tasks=tuple(TaskConfig(d) for d in EXECUTED), filter_stage=f"execute_3s{n}t") for n in (2, 3, 4, 5, 10)),
        EvalSuite("two_shot", tasks=tuple(TaskConfig(d, icl_examples=TWO_SHOTS) for d in DATASETS)),
        EvalSuite("debug", tasks=(TaskConfig("mbpp"),)),
        EvalSuite("debug_filter", tasks=(TaskConfig("humaneval"),), filter_stage="execute_3s1t"),
    )
}


def suite(name: str) -> EvalSuite:
    if name not in SUITES:
        raise ValueError(f"unknown suite {name!r}; known: {', '.join(SUITES)}")
    return SUITES[name]


@dataclass(frozen=True)
class PreprocessorConfig:
    template: str = "qsol_task"
    prompt_newline: bool = True
    instruction: str = ""
    max_problem_tokens: int | None = None


@dataclass(frozen=True)
class ScoringConfig:
    """At most one part of the prompt is masked."""

    method: str = "binary_logit"
    max_tokens_per_batch: int = 4096
    mask_query: bool = False
    mask_problem: bool = False
    mask_dummy: bool = False

    def __post_init__(self) -> None:
        if sum((self.mask_query, self.mask_problem, self.mask_dummy)) > 1:
            raise ValueError("mask_query, mask_problem and mask_dummy exclude each other")


@dataclass(frozen=True)
class DataConfig:
    examples_per_problem: int = -1
    include_failed: bool = True
    include_syntax: bool = False
    pass_level: str = "passed"
    max_prog_chars: int = 10_000
    num_train_examples: int | None = None
    validation_pct: float = 0.1
    max_validation: int = 250
    seed: int = SEEDS[0]

    def dir_name(self) -> str:
        return dataset_dir_name([("train", True), (self.pass_level, True), ("failed", self.include_failed), ("syntax", self.include_syntax), ("per", self.examples_per_problem if self.examples_per_problem >= 0 else None)])


@dataclass(frozen=True)
class RunConfig:
    """One evaluation: whose candidates, under which suite, with which scorer."""

    generator: str
    sampling_setup: str
    suite: EvalSuite = field(default_factory=lambda: SUITES["zero_shot"])
    scoring: ScoringConfig = ScoringConfig()
    preprocessing: PreprocessorConfig = PreprocessorConfig()

"""Task settings: what columns a task reads and what its model needs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

TASK_TYPES = ("token_classification", "sequence_classification", "causal_lm", "seq2seq_lm", "inverse_cloze", "regression", "span_offsets")
COLUMN_KINDS = {"text": "string", "tokens": "array<string>", "embeds": "array<float>"}
NOT_TASKS = ("domain", "training")


@dataclass(frozen=True)
class TaskSpec:
    name: str
    type: str
    input_columns: Mapping[str, str] = field(default_factory=dict)  # name to kind
    label_column: str | None = None
    max_length: int = 128
    weight: float = 1.0

    def columns(self, kind: str) -> list[str]:
        return [n for n, k in self.input_columns.items() if k == kind]

    def schema(self) -> str:
        return ", ".join(f"{n} {COLUMN_KINDS[k]}" for n, k in self.input_columns.items())


@dataclass(frozen=True)
class TaskSet:
    domain: str
    snapshot: str
    tasks: tuple[TaskSpec, ...]

    def __getitem__(self, name: str) -> TaskSpec:
        for t in self.tasks:
            if t.name == name:
                return t
        raise KeyError(name)


def parse_task_set(settings: Mapping) -> TaskSet:
    """From a parsed settings file: ``domain`` and ``training`` are required, every other key is a task."""
    for key in NOT_TASKS:
        if key not in settings:
            raise ValueError(f"the setting {key!r} is missing")
    tasks = []
    for name, s in settings.items():
        if name in NOT_TASKS:
            continue
        if s.get("type") not in TASK_TYPES:
            raise ValueError(f"task {name!r}: no type {s.get('type')!r}")
        columns = dict(s.get("input_columns", {}))
        if not columns:
            raise ValueError(f"task {name!r} has no input columns")
        if unknown := set(columns.values()) - set(COLUMN_KINDS):
            raise ValueError(f"task {name!r}: no column kind {sorted(unknown)}")
        tasks.append(TaskSpec(name, s["type"], columns, s.get("label_column"), s.get("max_length", 128), s.get("weight", 1.0)))
    training = settings["training"]
    return TaskSet(settings["domain"], str(training.get("snapshot", "")), tuple(tasks))

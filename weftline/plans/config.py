"""The configuration of a run: TOML with defaults, checked as a whole; unknown keys are errors."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace

from weftline.plans.matrix import digest, merged


@dataclass(frozen=True)
class Task:
    name: str = "task"
    initial_alignment: str = ""
    asked: str = ""
    reference: str = ""
    train_reference: str = ""
    domain: str | None = None
    source_ontology: str = ""
    target_ontology: str = ""
    vocabulary: str = "default"
    partial_reference: bool = False


@dataclass(frozen=True)
class Oracle:
    source: str = "stub"
    modulus: int = 2
    answers: str = ""
    answer_format: str = "true_false"
    response_mode: str = "structured"
    failure_tolerance: int | None = None
    max_workers: int = 24
    api_key: str = "EMPTY"


@dataclass(frozen=True)
class Prompts:
    template: str = "synonyms_only"
    property_template: str = "prop_labels_only"
    instance_template: str = "inst_labels_only"
    developer: str = "generic"


@dataclass(frozen=True)
class FewShot:
    strategy: str = "zero_shot"
    k: int = 0
    budget: int | None = None
    positive_share: float = 0.5
    seed: int = 0


@dataclass(frozen=True)
class Output:
    folder: str = "out"
    retain_confidence: bool = False
    metrics: tuple[str, ...] = ("global",)


@dataclass(frozen=True)
class Config:
    task: Task = field(default_factory=Task)
    oracle: Oracle = field(default_factory=Oracle)
    prompts: Prompts = field(default_factory=Prompts)
    few_shot: FewShot = field(default_factory=FewShot)
    output: Output = field(default_factory=Output)

    def __post_init__(self) -> None:
        from weftline.functions.templates import INSTRUCTIONS, REGISTRY
        from weftline.operators.retrieval import mode_of

        mode_of(self.few_shot.strategy)
        for name in (self.prompts.template, self.prompts.property_template, self.prompts.instance_template):
            if name not in REGISTRY:
                raise ValueError(f"unknown template {name}")
        if (self.oracle.answer_format, self.oracle.response_mode) not in INSTRUCTIONS:
            raise ValueError("unknown answer format or response mode")
        if self.oracle.source not in ("stub", "recorded"):
            raise ValueError(f"unknown oracle {self.oracle.source}")
        if self.few_shot.k and mode_of(self.few_shot.strategy) == "zero_shot":
            raise ValueError("zero_shot takes no examples")
        if self.few_shot.k and mode_of(self.few_shot.strategy) == "query_rag":
            raise ValueError("examples for each question are made by operators.retrieval; a run takes static ones only")
        if self.few_shot.k and not self.task.train_reference:
            raise ValueError("static examples need task.train_reference")

    @property
    def run_id(self) -> str:
        """Sixteen digits that say what identifies a run: all but the output folder and the key."""
        said = asdict(self)
        said["output"].pop("folder")
        said["oracle"].pop("api_key")
        return digest(said)[:16]


def build(values: dict) -> Config:
    parts = {}
    known = {f.name: f.default_factory for f in fields(Config)}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown section {name}")
        wrong = set(value) - {f.name for f in fields(known[name]())}
        if wrong:
            raise ValueError(f"unknown keys in {name}: {', '.join(sorted(wrong))}")
        parts[name] = replace(known[name](), **{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
    return Config(**parts)


def load(path: str, overrides: dict | None = None) -> Config:
    with open(path, "rb") as f:
        return build(merged(tomllib.load(f), overrides or {}))


def flat(values: dict, head: str = "") -> list[tuple[str, object]]:
    """Dotted names and values."""
    out: list[tuple[str, object]] = []
    for k, v in values.items():
        out += flat(v, f"{head}{k}.") if isinstance(v, dict) else [(head + k, v)]
    return out


def secret(value: str) -> str:
    """The value, or that of the environment variable that ENV:NAME names; an unset one is an error."""
    if not value.startswith("ENV:"):
        return value
    found = os.environ.get(value[4:].strip(), "")
    if not found:
        raise ValueError(f"{value[4:].strip()} is not set")
    return found

"""Settings of a run, checked as they are read."""

from __future__ import annotations

from typing import Literal

from pydantic import BaseModel, ConfigDict, Field, field_validator

# Names that settings may choose between.
BENCHMARKS = ("extract_bench", "real_kie", "insurance_claims")
POSITIONS = {"last": "last", "mean": "mean", "all": "all", "all_tokens": "all"}


class Strict(BaseModel):
    model_config = ConfigDict(extra="allow")


class Data(Strict):
    benchmark: Literal["extract_bench", "real_kie", "insurance_claims"]
    path: str
    domains: list[str] | None = None
    max_documents: int | None = Field(None, ge=1)
    min_chars: int = Field(1, ge=0)


class Activations(Strict):
    """Layers count from 1: the embedding's own output, 0, is not kept by any extractor."""

    layers: list[int] = Field(min_length=1)
    position: str = "last"

    @field_validator("layers")
    @classmethod
    def distinct_layers(cls, v: list[int]) -> list[int]:
        if min(v) < 1:
            raise ValueError("layers count from 1")
        return sorted(set(v))

    @field_validator("position")
    @classmethod
    def known_position(cls, v: str) -> str:
        if v not in POSITIONS:
            raise ValueError(f"position is one of {sorted(POSITIONS)}")
        return POSITIONS[v]


class Labeling(Strict):
    fuzzy_threshold: float = Field(0.85, ge=0, le=1)
    number_tolerance: float = Field(0.01, ge=0, le=1)


class Experiment(Strict):
    name: str = Field(min_length=1)


class Settings(Strict):
    experiment: Experiment
    data: Data
    activations: Activations
    labeling: Labeling = Labeling()
    artifacts_dir: str = "artifacts"

    @property
    def artifacts_path(self) -> str:
        return f"{self.artifacts_dir.rstrip('/')}/{self.experiment.name}"

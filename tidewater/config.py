"""Settings of a run, from a TOML file or given; nothing is read from the environment."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from .operators.models import BASELINES, MODELS
from .sources.sinks import value_id


@dataclass(frozen=True)
class Config:
    horizon: int = 7
    season: int | None = None
    step: str | None = None
    margin: float = 0.02
    max_fit: int = 2048
    threshold: float = 3.5
    repair: str = "safe"
    models: tuple[str, ...] = tuple(MODELS)
    # What only changes how results are shown.
    title: str = ""

    def __post_init__(self) -> None:
        if self.repair not in ("off", "safe", "aggressive"):
            raise ValueError("INVALID_CONFIG: repair is off, safe or aggressive")
        unknown = set(self.models) - set(MODELS)
        if unknown:
            raise ValueError(f"INVALID_CONFIG: unknown models {sorted(unknown)}")
        if not self.horizon >= 1:
            raise ValueError("INVALID_CONFIG: horizon is at least 1")

    @property
    def pool(self) -> tuple[str, ...]:
        """The models that compete; baselines always do."""
        return tuple(dict.fromkeys([*BASELINES, *self.models]))

    @property
    def identity(self) -> str:
        """An id of all that changes results."""
        return value_id("config", {k: v for k, v in asdict(self).items() if k != "title"})


def load(path: str) -> Config:
    """The settings of a TOML file; keys that mean nothing are refused, not passed over."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    unknown = set(raw) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"INVALID_CONFIG: unknown keys {sorted(unknown)}")
    if "models" in raw:
        raw["models"] = tuple(raw["models"])
    return Config(**raw)

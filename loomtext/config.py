"""Engine settings: which families to compute and with what parameters; later settings override earlier ones."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

FAMILIES = ("diversity", "overlap", "connectives", "givenness")


@dataclass(frozen=True)
class EngineConfig:
    families: tuple[str, ...] = FAMILIES
    adjectives: tuple[str, ...] = ()
    mattr_window: int = 50
    key: str = "doc_id"
    min_words: int = 20
    max_words: int = 400
    budget: int = 30_000_000
    threshold: float = 0.8
    valid_ratio: float = 0.7
    max_retries: int = 2

    def __post_init__(self):
        unknown = set(self.families) - set(FAMILIES)
        if unknown or not self.families:
            raise ValueError(f"families are {', '.join(FAMILIES)}; got {', '.join(map(str, self.families)) or 'none'}")


def merged(*settings: dict) -> EngineConfig:
    """One configuration from dictionaries; unknown names are errors, as are settings that contradict."""
    known = {f.name for f in fields(EngineConfig)}
    both: dict = {}
    for s in settings:
        if extra := set(s) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        both |= s
    return replace(EngineConfig(), **both)

"""Options of a deduplication run, with the names the command line uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

_UNITS = {"G": 1 << 30, "M": 1 << 20, "K": 1 << 10}


def parse_size(text: str | int) -> int:
    """'2G', '16M', '4K' or plain bytes."""
    if isinstance(text, int):
        return text
    text = text.strip()
    unit = _UNITS.get(text[-1:].upper(), 1)
    return int(text[:-1] if unit > 1 else text) * unit


@dataclass(frozen=True)
class DedupConfig:
    """What to sketch, how to pick a base, and how to code a record against it."""

    sf_num: int = 10
    sf_component_num: int = 1
    feature_method: str = "2df"
    block_size: int = 2
    dimension: int = 2
    delta: str = "blocks"
    data_type: str = "decoded"
    chunking: str = "v"
    patch_size: int = 1 << 30
    #: Pipelines that fill batches of their own; with ``chaos`` they take files in turn, else whole directories.
    road_num: int = 1
    chaos: bool = False
    min_score: int = 1
    least_matched: float = 0.0
    collapse_runs: bool = False
    force_indexed: bool = False
    uniform_sample: bool = False
    feature_check: bool = True
    #: A sketch function of one's own: (planes, file, config) -> sf, pos, dc and windows.
    sketch: Callable | None = None

    def __post_init__(self):
        if not 1 <= self.sf_num * self.sf_component_num <= 64:
            raise ValueError("sf_num * sf_component_num must be 1 to 64")
        if self.feature_method not in ("2df", "rabin", "gear"):
            raise ValueError("feature_method is 2df, rabin or gear")
        if self.feature_method == "2df" and not 2 <= self.block_size <= 8:
            raise ValueError("block_size is 2 to 8 for 2df")
        if self.feature_method == "2df" and self.dimension not in (1, 2):
            raise ValueError("2df has dimension 1 or 2")
        if self.feature_method == "gear" and self.dimension == 2:
            raise ValueError("gear has no two-dimensional form")
        if self.road_num < 1:
            raise ValueError("road_num is 1 or more")
        if self.delta not in ("blocks", "bytes") or self.data_type not in ("decoded", "raw") or self.chunking not in ("v", "f"):
            raise ValueError("delta: blocks or bytes; data_type: decoded or raw; chunking: v or f")

    @property
    def features(self) -> int:
        return self.sf_num * self.sf_component_num

    @classmethod
    def from_options(cls, options: dict[str, str]) -> DedupConfig:
        known = {f.name: f for f in fields(cls)}
        made = {}
        for name, value in options.items():
            if name not in known or name == "sketch":
                raise ValueError(f"unknown option {name}")
            kind = type(getattr(cls, name))
            made[name] = parse_size(value) if name == "patch_size" else value in ("1", "yes", "true", True) if kind is bool else kind(value)
        return cls(**made)

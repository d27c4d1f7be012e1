"""What a collection is: components, metric, cascade, quantization and lexical settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from lumenspar.functions.quantize import mode_of


@dataclass(frozen=True)
class Component:
    name: str
    metric: str
    full_dimension: int
    weight: float = 1.0


@dataclass(frozen=True)
class CascadeLayer:
    """First-stage search on the first coordinates of a component, then a re-rank."""

    component: str
    cutoff_dimension: int
    rerank_top_k: int = 100


@dataclass(frozen=True)
class CollectionSpec:
    name: str
    components: tuple[Component, ...]
    cascade: tuple[CascadeLayer, ...] = ()
    quantization: str = "scalar"
    probe_k: int = 3
    oversample: int = 4
    m: int = 16
    ef_construction: int = 64
    lexical: dict = field(default_factory=dict)

    @property
    def dimension(self) -> int:
        return sum(c.full_dimension for c in self.components)

    @property
    def metric(self) -> str:
        """Hybrid if a Lorentz and a flat component meet, else the first component's."""
        kinds = {c.metric for c in self.components}
        if "lorentz" in kinds and kinds & {"l2", "euclidean", "cosine"}:
            return "hybrid"
        return self.components[0].metric if self.components else "l2"

    @property
    def mode(self) -> str:
        return mode_of(self.quantization, self.metric, self.dimension)

    def configured(self, **changes: int) -> CollectionSpec:
        """A copy with other search settings (probe_k, oversample, m, ef_construction)."""
        allowed = {"probe_k", "oversample", "m", "ef_construction"}
        if bad := set(changes) - allowed:
            raise ValueError(f"not a setting: {sorted(bad)}")
        return CollectionSpec(**{**self.__dict__, **changes})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CollectionSpec:
        data = json.loads(text)
        data["components"] = tuple(Component(**c) for c in data["components"])
        data["cascade"] = tuple(CascadeLayer(**c) for c in data["cascade"])
        return cls(**data)

"""Standoff annotations, and the contract for renderers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import Confidence, Provenance
from .graph import Graph

CLASSIFYING, IDENTIFYING, TAGGING, LINKING, COMMENTING, EDITING, HIGHLIGHTING = "classifying", "identifying", "tagging", "linking", "commenting", "editing", "highlighting"


@dataclass(frozen=True)
class Selection:
    """A place in a source with an id of its own."""

    id: str
    source_id: str
    selector: Any

    def to_dict(self) -> dict[str, Any]:
        return {"id": self.id, "source": self.source_id, "selector": self.selector.to_dict()}


@dataclass(frozen=True)
class Annotation:
    """``target`` is an element id, an (element id, attribute) pair or a selection."""

    id: str
    target: Any
    body: Any
    motivation: str = COMMENTING
    provenance: Provenance | None = None
    confidence: Confidence | None = None

    def target_element_id(self) -> str | None:
        if isinstance(self.target, str):
            return self.target
        return self.target[0] if isinstance(self.target, tuple) and self.target else None

    def to_dict(self) -> dict[str, Any]:
        target = self.target.to_dict() if isinstance(self.target, Selection) else list(self.target) if isinstance(self.target, tuple) else self.target
        out = {"id": self.id, "target": target, "body": self.body, "motivation": self.motivation}
        for name in ("provenance", "confidence"):
            if (value := getattr(self, name)) is not None:
                out[name] = value.to_dict()
        return out


def annotations_for(annotations: DataFrame, elements: DataFrame) -> DataFrame:
    """Annotations (``target`` is an element id) of the elements ``id``."""
    return annotations.join(elements.select(F.col("id").alias("target")), "target", "left_semi")


@dataclass
class AnnotatedGraph:
    graph: Graph
    annotations: Sequence[Annotation] = ()
    presentation: Mapping[str, Any] = field(default_factory=dict)

    def annotations_for(self, element_id: str) -> list[Annotation]:
        return [a for a in self.annotations if a.target_element_id() == element_id]


@dataclass(frozen=True)
class RenderArtifact:
    content: Any
    media_type: str
    metadata: Mapping[str, Any] = field(default_factory=dict)


@runtime_checkable
class GraphRenderer(Protocol):
    name: str
    output_media_type: str

    def render(self, graph: AnnotatedGraph, *, options: Mapping[str, Any] | None = None) -> RenderArtifact: ...

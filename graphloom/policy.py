"""How hard a model is asked, and when a person should look."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ExtractionPolicy:
    """``overrides`` replace the whole policy for an element or a type id."""

    max_retries: int = 2
    self_consistency_samples: int = 1
    review_below: float = 0.5
    overrides: Mapping[str, ExtractionPolicy] = field(default_factory=dict)

    def for_element(self, element_id: str, type_id: str | None = None) -> ExtractionPolicy:
        return self.overrides.get(element_id) or self.overrides.get(type_id or "") or self

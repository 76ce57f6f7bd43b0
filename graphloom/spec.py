"""Grammar of a graph: typed elements with inheritance, attribute constraints and enums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Value kinds an attribute can declare, with the Spark type of a typed view.
PRIMITIVES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "decimal": T.DoubleType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.StringType(),
    "datetime": T.StringType(),
}

#: Attribute names kept for time by convention.
VALID_FROM, VALID_TO, OBSERVED_AT, RECORDED_AT = "valid_from", "valid_to", "observed_at", "recorded_at"
TEMPORAL = (VALID_FROM, VALID_TO, OBSERVED_AT, RECORDED_AT)


def is_temporal_attribute(name: str) -> bool:
    return name in TEMPORAL


@dataclass(frozen=True)
class AttrSchema:
    name: str
    range: str = "string"
    required: bool = False
    multivalued: bool = False
    enum: tuple[str, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    description: str | None = None

    def __post_init__(self) -> None:
        if self.enum is not None:
            object.__setattr__(self, "enum", tuple(self.enum))


@dataclass(frozen=True)
class EnumDef:
    name: str
    permissible_values: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "permissible_values", tuple(self.permissible_values))


@dataclass(frozen=True)
class ElementType:
    id: str
    description: str | None = None
    is_a: str | None = None
    mixins: tuple[str, ...] = ()
    attributes: tuple[AttrSchema, ...] = ()
    abstract: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "mixins", tuple(self.mixins))
        object.__setattr__(self, "attributes", tuple(self.attributes))


@dataclass(frozen=True)
class NodeType(ElementType):
    pass


@dataclass(frozen=True)
class EdgeType(ElementType):
    subject_type: str | None = None
    object_type: str | None = None


@dataclass(frozen=True)
class GraphSpec:
    node_types: tuple[NodeType, ...] = ()
    edge_types: tuple[EdgeType, ...] = ()
    enums: tuple[EnumDef, ...] = ()
    id: str | None = None
    version: str | None = None
    _by_id: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        for name in ("node_types", "edge_types", "enums"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        for element in (*self.edge_types, *self.node_types):  # nodes win over edges
            self._by_id[element.id] = element

    def node_type(self, id: str) -> NodeType | None:
        return next((t for t in self.node_types if t.id == id), None)

    def edge_type(self, id: str) -> EdgeType | None:
        return next((t for t in self.edge_types if t.id == id), None)

    def element_type(self, id: str) -> ElementType | None:
        return self._by_id.get(id)

    def enum(self, name: str) -> EnumDef | None:
        return next((e for e in self.enums if e.name == name), None)

    def permissible(self, attr: AttrSchema) -> tuple[str, ...] | None:
        """Values of an inline enum or of the enum that the range names."""
        if attr.enum is not None:
            return attr.enum
        named = self.enum(attr.range)
        return named.permissible_values if named else None

    def iter_element_types(self) -> Iterator[ElementType]:
        yield from self.node_types
        yield from self.edge_types

    def parents(self, id: str) -> tuple[str, ...]:
        element = self.element_type(id)
        return () if element is None else (*([element.is_a] if element.is_a else []), *element.mixins)

    def supertypes(self, id: str) -> list[str]:
        """The type and all it inherits from, each once; cycles are harmless."""
        seen, todo = [], [id]
        while todo:
            one = todo.pop()
            if one not in seen:
                seen.append(one)
                todo += self.parents(one)
        return seen

    def is_subtype(self, id: str, ancestor: str) -> bool:
        return ancestor in self.supertypes(id)

    def subtype_closure(self) -> list[tuple[str, str]]:
        """(type, ancestor) pairs, for joins."""
        return [(t.id, s) for t in self.iter_element_types() for s in self.supertypes(t.id)]


def effective_attributes(spec: GraphSpec, id: str) -> dict[str, AttrSchema]:
    """Own and inherited attributes; later parents override earlier ones, own ones override all."""

    def gather(one: str, path: tuple[str, ...]) -> dict[str, AttrSchema]:
        element = spec.element_type(one)
        if element is None or one in path:
            return {}
        out: dict[str, AttrSchema] = {}
        for parent in spec.parents(one):
            out |= gather(parent, (*path, one))
        return out | {a.name: a for a in element.attributes}

    return gather(id, ())


def to_struct_type(spec: GraphSpec, id: str) -> T.StructType:
    """Spark schema of a typed view of one element type."""
    fields = []
    for attr in effective_attributes(spec, id).values():
        kind = PRIMITIVES.get(attr.range, T.StringType())
        fields.append(T.StructField(attr.name, T.ArrayType(kind) if attr.multivalued else kind, not attr.required))
    return T.StructType(fields)

"""Grammars through LinkML and back."""

import graphloom as g


def test_every_field_comes_back():
    spec = g.GraphSpec(
        (
            g.NodeType("thing", description="any", abstract=True, attributes=(g.AttrSchema("n", "integer", required=True, minimum=0, maximum=0.0, description="a count"),)),
            g.NodeType("bare"),
            g.NodeType("both", is_a="thing", mixins=("bare",), attributes=(g.AttrSchema("e", enum=("x", "y"), multivalued=True), g.AttrSchema("p", pattern="^a"))),
        ),
        (g.EdgeType("knows", subject_type="thing", object_type="bare", description="d"), g.EdgeType("open", attributes=(g.AttrSchema("w", "Kind"),))),
        (g.EnumDef("Kind", ("k", "l")), g.EnumDef("None", ())),
        id="s-1",
    )
    schema = g.to_linkml(spec)
    assert g.load_linkml(schema) == spec
    assert schema["name"] == "s_1" and schema["classes"]["bare"] == {"attributes": {}} and schema["classes"]["knows"]["represents_relationship"] is True
    assert schema["classes"]["thing"]["attributes"]["n"] == {"range": "integer", "required": True, "minimum_value": 0, "maximum_value": 0.0, "description": "a count"}


def test_sparse_schemas():
    assert g.load_linkml({}) == g.GraphSpec()
    got = g.load_linkml({"classes": {"a": None, "b": {"attributes": {"x": None, "y": {"permissible_values": {}}}, "mixins": None}}, "enums": {"e": None}})
    assert got == g.GraphSpec((g.NodeType("a"), g.NodeType("b", attributes=(g.AttrSchema("x"), g.AttrSchema("y")))), (), (g.EnumDef("e", ()),))

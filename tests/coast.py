"""An invented lighthouse log: lines of prose, a list of vessels and one of lamps, with their grammar."""

from graphloom import AttrSchema, EdgeType, EnumDef, GraphSpec, NodeType, Source, SourceBundle

LOG = """Log of the north coast
Mara Voss keeps Gull Rock since 1871, and Ilse Brandt keeps Cape Sorrow since 1880.
At 18:40 Gull Rock saw Amalia 3.5 miles off, bearing 120
At 19:05 Gull Rock saw Amalia 2 miles off, bearing 95
At 23:50 Cape Sorrow saw Petrel 1,200 yards off, bearing 7
"""
VESSELS = [{"vessel": "Amalia", "rig": "brig", "port": "Port Lorne", "tons": "1,150"}, {"vessel": "Petrel", "rig": "cutter", "port": "Hythe", "tons": "38.5"}]
LAMPS = [{"place": "Gull Rock", "colour": "white", "hours": "11"}, {"place": "Gull Rock", "colour": "red", "hours": "0.5"}, {"place": "Cape Sorrow", "colour": "white", "hours": "1,002"}]

SPEC = GraphSpec(
    id="coast",
    version="1",
    enums=(EnumDef("Colour", ("white", "red", "green")),),
    node_types=(
        NodeType("craft", abstract=True, attributes=(AttrSchema("tons", "decimal", required=True, minimum=1),)),
        NodeType("vessel", is_a="craft", attributes=(AttrSchema("rig", pattern="^[a-z]+$"),)),
        NodeType("keeper", attributes=(AttrSchema("name", required=True),)),
        NodeType("light", attributes=(AttrSchema("name", required=True), AttrSchema("year", "integer", minimum=1700, maximum=1999))),
        NodeType("port"),
        NodeType("lamp", attributes=(AttrSchema("colour", "Colour"), AttrSchema("hours", "decimal", minimum=0))),
    ),
    edge_types=(
        EdgeType("keeps", subject_type="keeper", object_type="light"),
        EdgeType("saw", subject_type="light", object_type="craft", attributes=(AttrSchema("far", "decimal"), AttrSchema("unit", enum=("miles", "yards")), AttrSchema("bearing", "integer", minimum=0, maximum=359))),
        EdgeType("hails_from", subject_type="vessel", object_type="port"),
        EdgeType("shines_at", subject_type="lamp", object_type="light"),
    ),
)
SIGHTING = r"At (?P<time>\d\d:\d\d) (?P<place>\w+ \w+) saw (?P<ship>\w+) (?P<far>[\d.,]+) (?P<unit>miles|yards) off, bearing (?P<bearing>\d+)"
LAMP = "lamp:{place}-{colour}"
BINDINGS = {
    "keeper": ("regex_node", {"pattern": r"(?P<name>[A-Z]\w+ [A-Z]\w+) keeps", "id_attribute": "name"}),
    "light": ("regex_node", {"pattern": r"keeps (?P<name>\w+ \w+) since (?P<year>\d{4})", "id_attribute": "name", "casts": {"year": "int"}}),
    "keeps": ("regex_edge", {"pattern": r"(?P<who>[A-Z]\w+ [A-Z]\w+) keeps (?P<place>\w+ \w+)", "source_id_template": "keeper:{who}", "target_id_template": "light:{place}", "exclude_groups": ["who", "place"]}),
    "saw": ("regex_edge", {"pattern": SIGHTING, "source_id_template": "light:{place}", "target_id_template": "vessel:{ship}", "casts": {"far": "number", "bearing": "int"}, "exclude_groups": ["place", "ship"]}),
    "vessel": ("table_map", {"records_source": "vessels", "id_from": "vessel", "attributes": ["rig", "tons"], "casts": {"tons": "number"}}),
    "port": ("table_map", {"records_source": "vessels", "id_from": "port", "attributes": {"name": "port"}}),
    "hails_from": ("table_map", {"records_source": "vessels", "kind": "edge", "source_template": "vessel:{vessel}", "target_template": "port:{port}"}),
    "lamp": ("table_map", {"records_source": "lamps", "id_template": LAMP, "attributes": ["colour", "hours"], "casts": {"hours": "number"}}),
    "shines_at": ("table_map", {"records_source": "lamps", "kind": "edge", "source_template": LAMP, "target_template": "light:{place}"}),
}


def sources(log: str = LOG) -> SourceBundle:
    return SourceBundle([Source("log", log), Source("vessels", VESSELS, "table"), Source("lamps", LAMPS, "table")])

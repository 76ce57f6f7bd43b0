"""DuckDB SQL for the engine's queries, written against the tables themselves."""

from __future__ import annotations


def slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), ''), 'x')"


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Each e-mail address with its number and offsets: text up to a match is what the pieces before it add up to.
MATCHES = f"""
found AS (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS ms, regexp_split_to_array(text, '{EMAIL}') AS around FROM documents),
long AS (SELECT doc_id, text, ms, around, unnest(range(1, len(ms) + 1)) AS k FROM found WHERE len(ms) > 0),
spans AS (SELECT doc_id, text, k - 1 AS m, ms[k] AS exact,
  CAST(list_sum(list_transform(around[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM long)
"""
NORMAL = "list_aggregate(list_filter(string_split_regex(trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ('inc','ltd','llc','corp','co','company','gmbh','plc','sa','ag','srl','bv','dr','mr','mrs','ms','prof','mme','m','the')), 'string_agg', ' ')"
LOCATED = f"""
located AS (SELECT 'located:' || c_custkey AS id, 'customer:' || {slug("c_name")} AS source, 'nation:' || {slug("n_name")} AS target, 'located_in' AS type FROM customer JOIN nation ON c_nationkey = n_nationkey),
lies AS (SELECT 'in:' || {slug("n_name")} AS id, 'nation:' || {slug("n_name")} AS source, 'region:' || {slug("r_name")} AS target, 'in_region' AS type FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (SELECT 'customer:' || {slug("c_name")} AS id, 'customer' AS type, c_name AS name, max(c_custkey) AS k FROM customer GROUP BY ALL
  UNION ALL SELECT 'nation:' || {slug("n_name")}, 'nation', n_name, NULL FROM nation UNION ALL SELECT 'region:' || {slug("r_name")}, 'region', r_name, NULL FROM region),
edges AS (SELECT * FROM located UNION ALL SELECT * FROM lies)
"""
PARTS = f"""
parts AS (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand || ' Ltd.' END AS name, p_size FROM part),
named AS (SELECT *, 'brand:' || {slug(NORMAL.format(x="name"))} AS cid FROM parts)
"""
#: Nodes with their attributes as JSON members and as bare texts, by name; edges have none.
MEMBERS = f"""
{LOCATED}, own AS (
  SELECT DISTINCT id, type, ['name'] AS names, [name] AS bare, ['"' || name || '"'] AS vals FROM nodes WHERE type <> 'customer'
  UNION ALL SELECT 'customer:' || {slug("c_name")}, 'customer', ['balance', 'key', 'name', 'segment'], [CAST(c_acctbal AS VARCHAR), CAST(c_custkey AS VARCHAR), c_name, c_mktsegment],
    [CAST(c_acctbal AS VARCHAR), CAST(c_custkey AS VARCHAR), '"' || c_name || '"', '"' || c_mktsegment || '"'] FROM customer
), last AS (SELECT (SELECT max(id) FROM own) AS n, (SELECT max(id) FROM edges) AS e)
"""


def lines(*texts: str) -> str:
    """Fixed lines as SQL."""
    return " || chr(10) || ".join("'" + t.replace("'", "''") + "'" for t in texts)


def members(indent: int) -> str:
    """A node's attributes as JSON members, one a line."""
    return f"array_to_string(list_transform(list_zip(names, vals), lambda x: '\"' || x[1] || '\": ' || x[2]), ',' || chr(10) || repeat(' ', {indent}))"


SALES = "sales AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, 'o' || l_orderkey AS source, 'p' || max(l_partkey) AS target, max(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)"

#: A document's first four words of letters; no document's text is null in these tables unless ``words`` is.
TITLES = """
titles AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: w <> '')[1:4] AS words FROM documents)
"""
#: Names lose legal forms and honorifics before they are compared.
GRAMS = f"""
{TITLES}, own AS (SELECT DISTINCT array_to_string(words, ' ') AS value FROM titles WHERE words IS NOT NULL),
plain AS (SELECT value, coalesce(nullif({NORMAL.format(x="value")}, ''), lower(value)) AS p FROM own),
sets AS (SELECT value, list_distinct(list_transform(range(1, length(p) + 3), lambda i: substr(chr(2) || chr(2) || p || chr(3) || chr(3), i, 3))) AS g FROM plain)
"""

ORACLES: dict[str, str] = {
    "resolve_by_judge": f"""
WITH {TITLES}, ids AS (SELECT unnest(['d', 'v']) || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, lower(array_to_string(words, '')) AS letters FROM titles)
SELECT id, CASE WHEN letters IS NULL THEN id ELSE min(id) OVER (PARTITION BY letters) END AS cid FROM ids""",
    "similar_title_pairs": f"""
WITH {GRAMS} SELECT x.value AS a, y.value AS b FROM sets AS x JOIN sets AS y ON x.value < y.value
WHERE len(list_intersect(x.g, y.g)) >= 0.35 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) - 1e-9""",

    "extract_located_in": f"WITH {LOCATED} SELECT id, source, target FROM located",
    "graph_counts_by_type": f"WITH {LOCATED} SELECT 'node' AS kind, type, count(DISTINCT id) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "typed_view_customer": f"SELECT 'customer:' || {slug('c_name')} AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, c_custkey AS key FROM customer",
    "table_map_nodes": f"SELECT 'customer:' || {slug('c_name')} AS id, c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS key FROM customer",
    "table_map_edges": f"SELECT 'e:' || c_custkey AS id, 'customer:' || {slug('c_name')} AS source, 'nation:' || {slug('n_name')} AS target, 'located_in' AS type FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "table_map_positional_ids": "SELECT 'nation:' || n_nationkey AS id, n_name FROM nation",
    "cell_grounding": f"SELECT 'supplier:' || {slug('s_name')} AS id, 's' AS source_id, CAST(s_suppkey AS BIGINT) AS row, 's_name' AS column, CAST(1 AS DOUBLE) AS score FROM supplier",
    "slug_names": f"SELECT p_partkey, {slug('p_name')} AS slug, {slug('p_type')} AS type_slug FROM part",
    "cast_values": "SELECT 'order:' || o_orderkey AS id, CASE WHEN regexp_matches(regexp_replace(o_orderpriority, '[^0-9.\\-]', '', 'g'), '^-?[0-9]+$') THEN CAST(CAST(regexp_replace(o_orderpriority, '[^0-9.\\-]', '', 'g') AS BIGINT) AS VARCHAR) ELSE o_orderpriority END AS day, CAST(o_orderkey AS VARCHAR) AS key FROM orders",
    "regex_nodes_email": f"SELECT DISTINCT 'email:' || {slug('x')} AS id, 'email' AS type FROM (SELECT unnest(regexp_extract_all(text, '{EMAIL}')) AS x FROM documents)",
    "regex_edges_links": f"""
WITH f AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*"') AS ms, regexp_split_to_array(html, '<a href="[^"]*"') AS around FROM pages),
l AS (SELECT page_id, ms, around, unnest(range(1, len(ms) + 1)) AS k FROM f WHERE len(ms) > 0),
x AS (SELECT page_id, k, ms[k][10:-2] AS path, CAST(list_sum(list_transform(around[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda s: length(s))), 0) AS BIGINT) AS start FROM l),
n AS (SELECT *, row_number() OVER (ORDER BY page_id, k) - 1 AS i FROM x)
SELECT 'links_to:page-links->path-' || {slug('path')} || ':' || i AS id, 'path:' || {slug('path')} AS target, start, CAST(page_id AS VARCHAR) AS page FROM n""",
    "match_offsets": f"WITH {MATCHES} SELECT doc_id, CAST(m AS INTEGER) AS m, start, start + length(exact) AS stop, exact FROM spans",
    "quote_context": f"WITH {MATCHES} SELECT doc_id, CAST(m AS INTEGER) AS m, exact, substring(text, CAST(greatest(0, start - 24) + 1 AS BIGINT), CAST(least(24, start) AS BIGINT)) AS prefix, substring(text, CAST(start + length(exact) + 1 AS BIGINT), 24) AS suffix FROM spans",
    "reanchor_in_context": f"""
WITH {MATCHES}, own AS (SELECT doc_id, CAST(m AS INTEGER) AS m, exact, CAST(least(24, start) AS BIGINT) AS before, CAST(length(text) - start - length(exact) AS BIGINT) AS behind FROM spans),
places AS (SELECT doc_id, m, CAST(length(exact) AS BIGINT) AS n, CASE WHEN before = 0 AND behind = 0 THEN 2 ELSE 5 + length(exact) + before END AS start FROM own)
SELECT doc_id, m, true AS kept, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end" FROM places
UNION ALL SELECT doc_id, m, false, NULL, NULL FROM places""",
    "sql_extract": f"SELECT 'priority:' || {slug('o_orderpriority')} AS id, CAST(count(*) AS VARCHAR) AS n, max(CAST(o_orderkey AS VARCHAR)) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
    "json_query_events": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) > 50",
    "json_where_in_ne": "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) IN (1, 2, 5, 8)",
    "node_merge_last_wins": "SELECT 'customer:' || o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey",
    "attribute_conflict_report": """
SELECT 'customer:' || o_custkey AS node, attribute, old, new FROM (
  SELECT o_custkey, 'status' AS attribute, lag(o_orderstatus) OVER w AS old, o_orderstatus AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
  UNION ALL SELECT o_custkey, 'priority', lag(o_orderpriority) OVER w, o_orderpriority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
) WHERE old <> new""",
    "skipped_edge_report": "SELECT 'o' || o_orderkey AS edge, 'placed' AS type, 'c' || (o_custkey + 7) AS source, 's' || o_orderstatus AS target, 'missing-endpoint' AS reason FROM orders WHERE NOT (o_custkey + 7 IN (SELECT c_custkey FROM customer) AND o_orderstatus IN ('F', 'O'))",
    "kept_edge_rows": "SELECT 'o' || o_orderkey AS id, 'c' || (o_custkey + 7) AS source, 's' || o_orderstatus AS target FROM orders WHERE o_custkey + 7 IN (SELECT c_custkey FROM customer) AND o_orderstatus IN ('F', 'O')",
    "edges_between_two": "SELECT 'o' || o_orderkey AS id, 'c8' AS source, 'sF' AS target FROM orders WHERE o_custkey = 1 AND o_orderstatus = 'F'",
    "validate_nodes": """
WITH c AS (SELECT *, 'c' || c_custkey AS element_id, c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS checked FROM customer)
SELECT element_id, 'unknown-type' AS code FROM c WHERE c_custkey % 11 = 0
UNION ALL SELECT element_id, 'untyped' FROM c WHERE c_custkey % 11 <> 0 AND c_custkey % 13 = 0
UNION ALL SELECT element_id, 'missing-required' FROM c WHERE checked AND c_custkey % 7 = 0
UNION ALL SELECT element_id, 'minimum' FROM c WHERE checked AND c_acctbal < 0
UNION ALL SELECT element_id, 'enum' FROM c WHERE checked AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
UNION ALL SELECT element_id, 'maximum' FROM c WHERE checked AND c_custkey > 1000""",
    "validate_parts": """
WITH p AS (SELECT *, 'p' || p_partkey AS element_id FROM part)
SELECT element_id, 'pattern' AS code FROM p WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]')
UNION ALL SELECT element_id, 'range-type' FROM p WHERE p_partkey % 5 = 0
UNION ALL SELECT element_id, 'minimum' FROM p WHERE p_partkey % 5 <> 0 AND p_size < 5
UNION ALL SELECT element_id, 'maximum' FROM p WHERE p_partkey % 5 <> 0 AND p_size > 40""",
    "validate_edges": """
WITH e AS (SELECT *, 'e' || c_custkey AS element_id FROM customer)
SELECT element_id, 'unknown-type' AS code FROM e WHERE c_custkey % 17 = 0
UNION ALL SELECT element_id, 'missing-endpoint' FROM e WHERE c_custkey % 17 <> 0 AND c_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT element_id, 'endpoint-type' FROM e WHERE c_custkey % 17 <> 0 AND c_nationkey + 1 IN (SELECT n_nationkey FROM nation) AND (c_nationkey + 1) % 5 = 0
UNION ALL SELECT element_id, 'endpoint-type' FROM e WHERE c_custkey % 17 <> 0 AND (c_custkey % 11 = 0 OR c_custkey % 13 = 0)""",
    "normalize_entity_names": f"SELECT p_partkey, coalesce({NORMAL.format(x=chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + ', Inc.' + chr(39))}, '') AS name FROM part",
    "resolve_clusters": f"WITH {PARTS} SELECT id, cid FROM named",
    "resolve_nodes": f"WITH {PARTS} SELECT cid AS id, arg_min(name, id) AS name, CAST(arg_min(p_size, id) AS VARCHAR) AS size FROM named GROUP BY cid",
    "resolve_remapped_edges": f"WITH {PARTS} SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS id, cid AS source, cid AS target FROM lineitem JOIN named ON named.id = 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')",
    "resolve_merge_report": f"WITH {PARTS} SELECT cid AS canonical, CAST(count(*) AS INTEGER) AS n, min(id) AS first FROM named GROUP BY cid HAVING count(*) > 1",
    "resolve_components": """
WITH RECURSIVE links AS (
  SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS u, 'n' || s_nationkey AS v FROM supplier
  UNION ALL SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'b' || CAST(floor(s_acctbal / 2000) AS BIGINT) FROM supplier
), both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS node, u AS low FROM both_ways UNION SELECT b.v, r.low FROM reach r JOIN both_ways b ON r.node = b.u)
SELECT node, min(low) AS component FROM reach GROUP BY node""",
    "reify_connectors": f"WITH {SALES} SELECT 'contains_subject:' || id AS id, id AS source, source AS target, 'contains_subject' AS type FROM sales UNION ALL SELECT 'contains_object:' || id, id, target, 'contains_object' FROM sales",
    "unreify_round_trip": f"WITH {SALES} SELECT id, source, target, 'contains' AS type, quantity FROM sales",
    "trace_stab": f"WITH {MATCHES}, probes AS (SELECT doc_id, unnest(range(0, length(text) + 1, 50)) AS p FROM documents) SELECT CAST(doc_id AS VARCHAR) AS source_id, p AS \"offset\", doc_id || ':' || m AS element_id FROM spans JOIN probes USING (doc_id) WHERE start <= p AND p < start + length(exact)",
    "trace_overlap": f"WITH {MATCHES}, probes AS (SELECT doc_id, unnest(range(0, length(text) + 1, 400)) AS p FROM documents) SELECT CAST(doc_id AS VARCHAR) AS source_id, p AS \"from\", doc_id || ':' || m AS element_id FROM spans JOIN probes USING (doc_id) WHERE start < p + 90 AND p < start + length(exact)",
    "edge_bag_counts": """
WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
e AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(sum(least(coalesce(a.n, 0), coalesce(e.n, 0))) AS BIGINT) AS n_both, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS n_actual, CAST(sum(coalesce(e.n, 0)) AS BIGINT) AS n_expected FROM a FULL JOIN e USING (o_custkey, o_orderstatus)""",
    "node_set_counts": "SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS n_both, (SELECT count(DISTINCT doc_id) FROM labels) AS n_actual, (SELECT count(DISTINCT doc_id) FROM documents) AS n_expected",
    "numeric_tolerance_scores": "SELECT l_returnflag, count(*) FILTER (WHERE abs(round(l_extendedprice / 100) * 100 - l_extendedprice) <= greatest(0.5, 0.01 * abs(l_extendedprice))) AS n_passed, count(*) AS n FROM lineitem GROUP BY 1",
    "text_match_scores": "SELECT p_partkey, CAST(CASE WHEN p_name = '  ' || upper(p_name) || ' ' THEN 1 ELSE 0 END AS DOUBLE) AS exact, CAST(1 AS DOUBLE) AS normalized, lower(regexp_replace(trim('  ' || upper(p_name) || ' '), '\\s+', ' ', 'g')) AS norm FROM part",
    "set_match_scores": "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_type, ' ')) AS a, list_distinct([string_split(p_type, ' ')[1], 'COPPER']) AS e FROM part) SELECT p_partkey, round(2.0 * len(list_intersect(a, e)) / (len(a) + len(e)), 9) AS f1 FROM p",
    "semantic_cosine": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT e AS q FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS cosine FROM v, p""",
    "text_join": "SELECT conv_id, CAST(length(t) AS INTEGER) AS n, sha256(t) AS sha FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "embedding_record_rows": f"""
WITH {LOCATED} SELECT DISTINCT id, 'node' AS kind, type, type || ': name=' || name AS text FROM nodes WHERE type <> 'customer'
UNION ALL SELECT 'customer:' || {slug("c_name")}, 'node', 'customer', 'customer: balance=' || c_acctbal || '; key=' || c_custkey || '; name=' || c_name || '; segment=' || c_mktsegment FROM customer
UNION ALL SELECT id, 'edge', type, source || ' ' || type || ' ' || target FROM edges""",
    "cytoscape_element_rows": f"WITH {LOCATED} SELECT DISTINCT id, 'node' AS kind, type AS label, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target FROM nodes UNION ALL SELECT id, 'edge', type, source, target FROM edges",
    "turtle_triples": f"""
WITH {LOCATED}, n AS (SELECT DISTINCT id, type, name FROM nodes),
own AS (SELECT 'customer:' || {slug("c_name")} AS id, unnest(['balance ' || c_acctbal, 'segment "' || c_mktsegment || '"', 'key ' || c_custkey]) AS said FROM customer)
SELECT id, 'g:' || replace(id, ':', '_') || ' rdf:type g:' || type || ' .' AS line FROM n
UNION ALL SELECT id, 'g:' || replace(id, ':', '_') || ' g:name "' || name || '" .' FROM n
UNION ALL SELECT id, 'g:' || replace(id, ':', '_') || ' g:' || said || ' .' FROM own
UNION ALL SELECT id, 'g:' || replace(source, ':', '_') || ' g:' || type || ' g:' || replace(target, ':', '_') || ' .' FROM edges""",
    "cypher_parameters": f"""
WITH {LOCATED} SELECT DISTINCT id, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target, '{{"types":["' || type || '"],"name":"' || name || '"}}' AS props FROM nodes WHERE type <> 'customer'
UNION ALL SELECT 'customer:' || {slug("c_name")}, NULL, NULL, '{{"types":["customer"],"balance":' || c_acctbal || ',"key":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}}' FROM customer
UNION ALL SELECT id, source, target, '{{}}' FROM edges""",
    "graph_digests": f"""
WITH {MEMBERS}, texts AS (
  SELECT 'node' AS kind, '{{"id":"' || id || '","types":["' || type || '"],"attributes":{{' || array_to_string(list_transform(list_zip(names, vals), lambda x: '"' || x[1] || '":' || x[2]), ',') || '}}}}' AS text FROM own
  UNION ALL SELECT 'edge', '{{"id":"' || id || '","source":"' || source || '","target":"' || target || '","type":"' || type || '","attributes":{{}}}}' FROM edges
), hashed AS (SELECT kind, sha256(text) AS h FROM texts)
SELECT kind, count(*) AS n, concat_ws(':', {", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for k in range(4))}) AS digest FROM hashed GROUP BY kind""",
    "element_records": f"""
WITH {MEMBERS} SELECT 'node' AS kind, id, '{{"id":"' || id || '","types":["' || type || '"],' || array_to_string(list_transform(list_zip(names, vals), lambda x: '"' || x[1] || '":' || x[2]), ',') || '}}' AS record FROM own
UNION ALL SELECT 'edge', id, '{{"id":"' || id || '","type":"' || type || '","source":"' || source || '","target":"' || target || '"}}' FROM edges""",
    "canonical_document_lines": f"""
WITH {MEMBERS} SELECT 0 AS section, '' AS key, {lines("{", '  "$schema": "urn:graphloom:graph:1",', '  "directed": true,')} AS text
UNION ALL SELECT 1, '', '  "edges": ['
UNION ALL SELECT 2, id, '    {{' || chr(10) || '      "attributes": {{}},' || chr(10) || '      "id": "' || id || '",' || chr(10) || '      "source": "' || source || '",' || chr(10) || '      "target": "' || target || '",' || chr(10) || '      "type": "' || type || '"' || chr(10) || '    }}' || CASE WHEN id < e THEN ',' ELSE '' END FROM edges, last
UNION ALL SELECT 3, '', '  ],'
UNION ALL SELECT 4, '', '  "nodes": {{'
UNION ALL SELECT 5, id, '    "' || id || '": {{' || chr(10) || '      "attributes": {{' || chr(10) || repeat(' ', 8) || {members(8)} || chr(10) || '      }},' || chr(10) || '      "types": [' || chr(10) || '        "' || type || '"' || chr(10) || '      ]' || chr(10) || '    }}' || CASE WHEN id < n THEN ',' ELSE '' END FROM own, last
UNION ALL SELECT 6, '', '  }},'
UNION ALL SELECT 9, '', {lines('  "spec": {', '    "id": "trade",', '    "version": "1"', "  },", '  "version": "1.0"', "}")}""",
    "jgf_document_lines": f"""
WITH {MEMBERS} SELECT 0 AS section, '' AS key, {lines("{", '  "graph": {', '    "directed": true,')} AS text
UNION ALL SELECT 1, '', '    "edges": ['
UNION ALL SELECT 2, id, '      {{' || chr(10) || '        "id": "' || id || '",' || chr(10) || '        "metadata": {{}},' || chr(10) || '        "relation": "' || type || '",' || chr(10) || '        "source": "' || source || '",' || chr(10) || '        "target": "' || target || '"' || chr(10) || '      }}' || CASE WHEN id < e THEN ',' ELSE '' END FROM edges, last
UNION ALL SELECT 3, '', '    ],'
UNION ALL SELECT 4, '', '    "nodes": {{'
UNION ALL SELECT 5, id, '      "' || id || '": {{' || chr(10) || '        "label": "' || type || '",' || chr(10) || '        "metadata": {{' || chr(10) || repeat(' ', 10) || {members(10)} || ',' || chr(10) || '          "types": [' || chr(10) || '            "' || type || '"' || chr(10) || '          ]' || chr(10) || '        }}' || chr(10) || '      }}' || CASE WHEN id < n THEN ',' ELSE '' END FROM own, last
UNION ALL SELECT 6, '', '    }}'
UNION ALL SELECT 9, '', {lines("  }", "}")}""",
    "graphml_document_lines": f"""
WITH {MEMBERS} SELECT 0 AS section, '' AS key, {
        lines(
            '<?xml version="1.0" encoding="UTF-8"?>',
            '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
            *(f'  <key id="n{i}" for="node" attr.name="{name}" attr.type="string"/>' for i, name in enumerate(["balance", "key", "name", "segment", "types"])),
            '  <key id="e0" for="edge" attr.name="type" attr.type="string"/>',
            '  <graph edgedefault="directed">',
        )
    } AS text
UNION ALL SELECT 1, id, '    <node id="' || id || '">' || chr(10) || '      <data key="n4">' || type || '</data>' ||
  array_to_string(list_transform(list_zip(names, bare), lambda x: chr(10) || '      <data key="n' || (list_position(['balance', 'key', 'name', 'segment'], x[1]) - 1) || '">' || replace(replace(x[2], '&', '&amp;'), '<', '&lt;') || '</data>'), '') || chr(10) || '    </node>' FROM own
UNION ALL SELECT 2, id, '    <edge id="' || id || '" source="' || source || '" target="' || target || '">' || chr(10) || '      <data key="e0">' || type || '</data>' || chr(10) || '    </edge>' FROM edges
UNION ALL SELECT 3, '', {lines("  </graph>", "</graphml>")}""",
    "dot_document_lines": f"""
WITH {MEMBERS} SELECT 0 AS section, '' AS key, {lines("digraph graphloom {", "  rankdir=LR;")} AS text
UNION ALL SELECT 1, id, '  "' || id || '" [label="' || list_extract(bare, list_position(names, 'name')) || '"];' FROM own
UNION ALL SELECT 2, id, '  "' || source || '" -> "' || target || '" [label="' || type || '"];' FROM edges
UNION ALL SELECT 3, '', '}}'""",
    "mermaid_document_lines": f"""
WITH {MEMBERS}, place AS (SELECT *, 'n' || (row_number() OVER (ORDER BY id) - 1) AS p FROM own)
SELECT 0 AS section, '' AS key, 'flowchart LR' AS text
UNION ALL SELECT 1, id, '  ' || p || '["' || coalesce(list_extract(bare, list_position(names, 'segment')), id) || '"]' FROM place
UNION ALL SELECT 2, edges.id, '  ' || a.p || ' -->|' || edges.type || '| ' || b.p FROM edges JOIN place AS a ON a.id = source JOIN place AS b ON b.id = target""",
    "json_file_items": "SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS place, sha256(coalesce(text, '')) AS sha, lang FROM documents",
    "separated_round_trip": """
SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS place, sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha, coalesce(lang, '') AS lang FROM documents""",
    "corpus_summary": "SELECT round(avg(CAST(quality AS DOUBLE)), 9) AS mean_score, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 9) AS pass_rate, count(*) AS n FROM labels",
    "evidence_lookup": f"""
WITH {LOCATED} SELECT DISTINCT id AS element_id, type AS source, 'query:table_map' AS strategy, 'deterministic' AS method FROM nodes
UNION ALL SELECT id, CASE type WHEN 'located_in' THEN 'located' ELSE 'lies' END, 'query:table_map', 'deterministic' FROM edges""",
    "json_query_strategy": """
WITH e AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT 'mark:' || k AS id, CAST(k AS VARCHAR) AS k, '$[' || i || ']' AS place FROM e WHERE k > 50""",
    "graph_match_scores": """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE abs(c_acctbal - round(c_acctbal)) <= 0.25) AS fit FROM customer), n AS (SELECT count(*) AS n FROM nation), s AS (SELECT count(*) AS n FROM supplier),
parts AS (SELECT 2.0 * (c.n + n.n) / (2 * (c.n + n.n) + s.n) AS f1, CAST(c.n + c.fit + 2 * n.n AS DOUBLE) / (2 * c.n + 2 * n.n) AS a, CAST(2 * c.n + 2 * n.n AS BIGINT) AS compared FROM c, n, s)
SELECT round((f1 + 1 + a) / 3, 9) AS score, round(f1, 9) AS nodes, CAST(1 AS DOUBLE) AS edges, round(a, 9) AS attributes, compared FROM parts""",
    "parallel_edge_scores": """
WITH a AS (SELECT o_orderpriority AS type, o_custkey AS c, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL),
e AS (SELECT o_orderpriority AS type, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS status, count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY ALL),
same AS (SELECT a.type, sum(least(a.n, e.n)) AS n FROM a JOIN e USING (type, c, status) GROUP BY a.type),
whole AS (SELECT x.type, sum(least(x.n, y.n)) AS n FROM (SELECT type, c, sum(n) AS n FROM a GROUP BY ALL) AS x JOIN (SELECT type, c, sum(n) AS n FROM e GROUP BY ALL) AS y USING (type, c) GROUP BY x.type)
SELECT whole.type AS type, CAST(whole.n AS BIGINT) AS compared, CAST(coalesce(same.n, 0) AS BIGINT) AS equal FROM whole LEFT JOIN same USING (type)""",
    "resolve_by_registry": f"WITH {PARTS} SELECT id, CASE WHEN name = 'Brand#11 Ltd.' THEN 'brand:one' WHEN upper(name) IN ('BRAND#12', 'BRAND#12 LTD.') THEN 'brand:two' ELSE id END AS cid FROM parts",
    "resolve_by_cascade": f"""
WITH {PARTS}, whole AS (SELECT id, replace(upper(name), ' LTD.', '') AS brand, max(CAST(name = 'Brand#11 Ltd.' AS INTEGER)) OVER (PARTITION BY replace(upper(name), ' LTD.', '')) AS one, min(id) OVER (PARTITION BY replace(upper(name), ' LTD.', '')) AS low FROM parts)
SELECT id, CASE WHEN one = 1 THEN 'brand:one' WHEN brand = 'BRAND#12' THEN 'brand:two' ELSE low END AS cid FROM whole""",
    "validate_lists": "SELECT 'c' || c_custkey AS element_id, 'range-type' AS code FROM customer UNION ALL SELECT 'c' || c_custkey, 'not-multivalued' FROM customer WHERE c_acctbal >= 0",
    "annotations_of_documents": "SELECT CAST(doc_id AS VARCHAR) AS target, quality AS body, 'classifying' AS motivation FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "attribute_evidence_rows": "SELECT 's' || s_suppkey AS element_id, attribute, source FROM supplier, (VALUES ('name', 'whole'), ('balance', 'own')) AS t(attribute, source)",
    "trace_cells": f"SELECT s_suppkey AS row, 'supplier:' || {slug('s_name')} AS element_id FROM supplier",
    "corpus_evaluation": "WITH n AS (SELECT 2.0 * a / (2 * a + b) AS f1 FROM (SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM region) AS b)) SELECT round((1 + (f1 + 1) / 2) / 2, 9) AS mean_score, CAST(1 AS DOUBLE) AS pass_rate, CAST(2 AS BIGINT) AS n FROM n",
    "lexical_similarity": "SELECT p_partkey, round(2.0 * length(p_brand) / (2 * length(p_brand) + 1), 9) AS ratio FROM part",
    "composite_scores": "SELECT p_partkey, CASE WHEN p_name = upper(p_name) THEN 1.0 ELSE 0.75 END::DOUBLE AS score FROM part",
    "nodes_of_one_type": f"SELECT 'nation:' || {slug('n_name')} AS id, n_name AS name FROM nation",
}

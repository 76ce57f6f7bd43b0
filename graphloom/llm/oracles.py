"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

#: A-Z lower-cased only; DuckDB's translate() works on characters.
NORMALISED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, {NORMALISED} AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({NORMALISED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array({NORMALISED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM wins
), spots AS (
  SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, k, spots.n AS n, item_id FROM spots JOIN wins ON spots.n = wins.n AND spots.win = wins.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN names ON d.doc_id = names.doc_id
"""

#: Base32 of a SHA-1: 8 groups of 5 hexadecimal digits give 4 letters each.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha1(payload), {5 * g + 1}, 5) AS INTEGER) >> {15 - 5 * k}) & 31 AS INTEGER), 1)" for g in range(8) for k in range(4)
)

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, payload, min(page_id) OVER (PARTITION BY payload) AS low FROM p)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM q
"""

OP2 = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), by_turn AS (
  SELECT pair_id, turn, list_sort(list({'r': role, 't': text}) FILTER (WHERE chosen)) AS c, list_sort(list({'r': role, 't': text}) FILTER (WHERE NOT chosen)) AS r
  FROM t GROUP BY pair_id, turn
), differ AS (
  SELECT pair_id, min(turn) AS first FROM by_turn WHERE c IS DISTINCT FROM r GROUP BY pair_id
), placed AS (
  SELECT t.*, CASE WHEN differ.pair_id IS NULL THEN true WHEN turn IS NULL THEN false ELSE coalesce(turn < first, true) END AS in_prompt
  FROM t LEFT JOIN differ ON t.pair_id = differ.pair_id
), shown AS (
  SELECT pair_id, turn // 1000 AS block, turn, chosen, in_prompt, role = 'assistant' AND NOT in_prompt AS trained, 13 + length(replace(replace(role, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>')) AS head,
         '<|im_start|>' || replace(replace(role || chr(10) || text, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') || '<|im_end|>' || chr(10) AS rendered
  FROM placed WHERE chosen OR NOT in_prompt
), spots AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, block, chosen, in_prompt ORDER BY turn, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM shown
), masks AS (
  SELECT *, CAST(place + head AS BIGINT) || ':' || CAST(place + length(rendered) - 1 AS BIGINT) AS mask FROM spots
)
SELECT pair_id, block,
       coalesce(string_agg(rendered, '' ORDER BY turn, rendered) FILTER (WHERE in_prompt), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY turn, rendered) FILTER (WHERE chosen AND NOT in_prompt), '') AS chosen,
       coalesce(string_agg(mask, ',' ORDER BY place) FILTER (WHERE trained AND chosen), '') AS chosen_mask,
       coalesce(string_agg(rendered, '' ORDER BY turn, rendered) FILTER (WHERE NOT chosen), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY place) FILTER (WHERE trained AND NOT chosen), '') AS rejected_mask
FROM masks GROUP BY pair_id, block
"""

#: Unsigned CRC-32 of a decimal number, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

OP12 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, conv_id - conv_id % 5 AS start, {CRC32.format("conv_id")} % 9 AS h FROM t WHERE place = 1
), spliced AS (
  SELECT own.conv_id, place AS depth, role, text FROM own JOIN t ON t.conv_id = own.start WHERE place <= h
  UNION ALL
  SELECT own.conv_id, place - h + least(h, (SELECT count(*) FROM t AS s WHERE s.conv_id = own.start)) AS depth, role, text FROM own JOIN t ON t.conv_id = own.conv_id WHERE place > h
), rows AS (
  SELECT conv_id, 0 AS depth, 0 AS n_bytes, sha256('') AS k FROM own
  UNION ALL
  SELECT conv_id, depth, strlen(text) AS n_bytes,
         sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS k
  FROM spliced
), lasts AS (
  SELECT conv_id, max(depth) AS depth FROM rows GROUP BY conv_id
), nodes AS (
  SELECT k, rows.depth AS depth, min(rows.conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
         coalesce(string_agg(CAST(rows.conv_id AS VARCHAR), ',' ORDER BY rows.conv_id) FILTER (WHERE rows.depth = lasts.depth), '') AS ends
  FROM rows JOIN lasts ON rows.conv_id = lasts.conv_id GROUP BY k, rows.depth
), placed AS (
  SELECT nodes.*, up.k AS parent, p.conv_id AS parent_conv_id
  FROM nodes LEFT JOIN rows AS up ON up.conv_id = nodes.conv_id AND up.depth = nodes.depth - 1 LEFT JOIN nodes AS p ON p.k = up.k AND p.depth = up.depth
), counted AS (
  SELECT placed.*, (SELECT count(*) FROM placed AS c WHERE c.parent = placed.k AND c.depth = placed.depth + 1) AS n_children FROM placed
), sums AS (
  SELECT up.k AS k, up.depth AS depth, count(*) FILTER (WHERE counted.n_children = 0) AS n_leaves, sum((counted.n_convs - 1) * counted.n_bytes) AS saved
  FROM counted JOIN rows AS up ON up.conv_id = counted.conv_id AND up.depth <= counted.depth GROUP BY up.k, up.depth
)
SELECT conv_id, CAST(counted.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted JOIN sums ON sums.k = counted.k AND sums.depth = counted.depth
"""

OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array({NORMALISED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array({NORMALISED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), size AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0
), tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY row, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, size GROUP BY term, n_docs
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term), size GROUP BY item_id, row, doc_id
), ranks AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op1_warc": OP1, "op2_preference_formatting": OP2, "op4_exact_dedup": OP4, "op6_benchmark_decontamination": OP6, "op12_conversation_trie": OP12, "op13_lexical_search": OP13}

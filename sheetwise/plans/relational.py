"""Keyed checks, diffs, set operations and aggregations on the driver's tables, as declarative SQL."""

from __future__ import annotations

from .registry import declare

# ---- coverage, uniqueness and ownership ----

declare(
    "coverage_bijection",
    """SELECT coalesce(o.o_orderkey, l.l_orderkey) AS orderkey,
              CASE WHEN l.l_orderkey IS NULL THEN 'order only' WHEN o.o_orderkey IS NULL THEN 'item only' ELSE 'repeated order' END AS problem
       FROM (SELECT o_orderkey, count(*) AS n FROM {orders} GROUP BY o_orderkey) o
       FULL OUTER JOIN (SELECT DISTINCT l_orderkey FROM {lineitem}) l ON o.o_orderkey = l.l_orderkey
       WHERE l.l_orderkey IS NULL OR o.o_orderkey IS NULL OR o.n > 1""",
)
declare(
    "unresolved_anti",
    """SELECT d.doc_id, 'unlabelled document' AS problem FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id
       UNION ALL SELECT l.doc_id, 'label without document' FROM {labels} l LEFT ANTI JOIN {documents} d ON d.doc_id = l.doc_id""",
    """SELECT doc_id, 'unlabelled document' AS problem FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
       UNION ALL SELECT doc_id, 'label without document' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""",
)
declare(
    "semi_exists",
    "SELECT o_orderkey, o_orderstatus FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
)
declare(
    "fk_exactly_one",
    """SELECT coalesce(p.n, 0) AS parts, coalesce(s.n, 0) AS suppliers, count(*) AS items
       FROM {lineitem} l LEFT JOIN (SELECT p_partkey, count(*) AS n FROM {part} GROUP BY p_partkey) p ON l.l_partkey = p.p_partkey
       LEFT JOIN (SELECT s_suppkey, count(*) AS n FROM {supplier} GROUP BY s_suppkey) s ON l.l_suppkey = s.s_suppkey
       GROUP BY 1, 2""",
)
declare("single_owner", "SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM {lineitem} GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
declare("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")

# ---- snapshot comparison ----

_SAVED = """SELECT o_orderkey + CASE WHEN o_orderkey % 97 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, o_custkey,
                   CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                   CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
            FROM {orders} WHERE o_orderkey % 89 <> 0"""
declare(
    "snapshot_diff",
    f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS orderkey,
               CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS change,
               a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS status_differs,
               a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS priority_differs
        FROM {{orders}} a FULL OUTER JOIN ({_SAVED}) b ON a.o_orderkey = b.o_orderkey
        WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority""",
)
_EDITS = """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'retain' ELSE 'drop' END AS action, concat('new ', c_name) AS target
            FROM {customer} WHERE c_custkey % 5 = 0"""
declare(
    "apply_edits",
    f"""SELECT c.c_custkey, coalesce(e.action, 'untouched') AS action, CASE WHEN e.action = 'replace' THEN e.target ELSE c.c_name END AS value
        FROM {{customer}} c LEFT JOIN ({_EDITS}) e ON c.c_custkey = e.k WHERE coalesce(e.action, '') <> 'drop'""",
)
declare(
    "action_check",
    f"""SELECT e.k AS c_custkey, e.action,
               CASE WHEN s.k IS NULL THEN e.action = 'drop' WHEN e.action = 'replace' THEN s.v = e.target WHEN e.action = 'retain' THEN s.v = c.c_name ELSE false END AS holds
        FROM ({_EDITS}) e JOIN {{customer}} c ON c.c_custkey = e.k
        LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 15 = 0 THEN concat('new ', c_name) WHEN c_custkey % 70 = 0 THEN 'lost' ELSE c_name END AS v
                   FROM {{customer}} WHERE c_custkey % 45 <> 5) s ON s.k = e.k""",
)
declare(
    "receipt_match",
    """SELECT coalesce(w.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'no receipt' WHEN w.k IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem
       FROM (SELECT DISTINCT o_custkey AS k FROM {orders} WHERE o_orderpriority = '1-URGENT') w
       FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) r ON w.k = r.k
       WHERE w.k IS NULL OR r.k IS NULL OR r.n > 1""",
)
declare(
    "listing_diff",
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'copy' WHEN a.path IS NULL THEN 'archive' ELSE 'replace' END AS action
       FROM (SELECT concat(c_mktsegment, '/', c_name) AS path, sha2(concat(c_name, c_nationkey), 256) AS digest FROM {customer} WHERE c_custkey % 7 <> 0) a
       FULL OUTER JOIN (SELECT concat(c_mktsegment, '/', c_name) AS path, sha2(concat(c_name, c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END), 256) AS digest
                        FROM {customer} WHERE c_custkey % 13 <> 0) b ON a.path = b.path
       WHERE a.path IS NULL OR b.path IS NULL OR a.digest <> b.digest""",
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'copy' WHEN a.path IS NULL THEN 'archive' ELSE 'replace' END AS action
       FROM (SELECT concat(c_mktsegment, '/', c_name) AS path, sha256(concat(c_name, c_nationkey)) AS digest FROM customer WHERE c_custkey % 7 <> 0) a
       FULL OUTER JOIN (SELECT concat(c_mktsegment, '/', c_name) AS path, sha256(concat(c_name, c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END)) AS digest
                        FROM customer WHERE c_custkey % 13 <> 0) b ON a.path = b.path
       WHERE a.path IS NULL OR b.path IS NULL OR a.digest <> b.digest""",
)
declare(
    "dictionary_encode",
    """SELECT n.n_nationkey, n.n_name, r.r_name, dense_rank() OVER (ORDER BY r.r_name) AS region_code
       FROM {nation} n LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
)

# ---- sets ----

_A, _B = "SELECT DISTINCT c_nationkey AS k FROM {customer} WHERE c_mktsegment = 'BUILDING'", "SELECT DISTINCT s_nationkey AS k FROM {supplier}"
declare(
    "set_equality",
    f"SELECT (SELECT count(*) FROM ({_A} EXCEPT {_B})) AS left_only, (SELECT count(*) FROM ({_B} EXCEPT {_A})) AS right_only",
)
declare("set_union", f"{_A} UNION {_B}")
declare("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'")
declare(
    "set_census",
    """SELECT k, side FROM (
         SELECT w.k, 'missing' AS side FROM (SELECT c_custkey AS k FROM {customer} WHERE c_custkey % 4 = 0 UNION SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P') w
           LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM {orders}) s ON w.k = s.k WHERE s.k IS NULL
         UNION ALL
         SELECT s.k, 'extra' FROM (SELECT DISTINCT o_custkey AS k FROM {orders}) s
           LEFT JOIN (SELECT c_custkey AS k FROM {customer} WHERE c_custkey % 4 = 0 UNION SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P') w ON w.k = s.k WHERE w.k IS NULL) x""",
)
declare(
    "tagged_union",
    """SELECT 0 AS class, c_custkey AS k, c_name AS name FROM {customer} WHERE c_acctbal < 0
       UNION ALL SELECT 1, CAST(s_suppkey AS BIGINT), s_name FROM {supplier} WHERE s_acctbal < 0
       UNION ALL SELECT 2, p_partkey, p_name FROM {part} WHERE p_size = 1""",
)

# ---- aggregations and ordered logic ----

declare(
    "action_counts",
    """SELECT o_orderpriority, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished,
              count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS opened, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pending
       FROM {orders} GROUP BY o_orderpriority""",
)
declare(
    "signed_delta_census",
    """SELECT c_nationkey, CAST(sum(d) AS BIGINT) AS delta, CAST(sum(n) AS BIGINT) AS rows_before, CAST(sum(n) + sum(d) AS BIGINT) AS rows_after FROM (
         SELECT c_nationkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS d, 0 AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey
         UNION ALL SELECT c_nationkey, 0, 1 FROM {customer}) x GROUP BY c_nationkey""",
)
declare(
    "guarded_extent",
    """SELECT user_id, CASE WHEN count(*) >= 40 AND bool_and(value > 0.0) AND max(value) - min(value) >= 1.0 THEN min(value) END AS lo,
              CASE WHEN count(*) >= 40 AND bool_and(value > 0.0) AND max(value) - min(value) >= 1.0 THEN max(value) END AS hi
       FROM {events} GROUP BY user_id""",
)
declare(
    "top1_argmin",
    """SELECT p_brand, min_by(p_partkey, struct(p_retailprice, p_partkey)) AS cheapest, min(p_retailprice) AS price FROM {part} GROUP BY p_brand""",
    """SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, min(p_retailprice) AS price FROM part GROUP BY p_brand""",
)
declare(
    "counterpart_self_join",
    """SELECT a.conv_id, a.turn, b.turn AS other_turn FROM {conversations} a JOIN {conversations} b
         ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant' AND a.text <> b.text AND trim(b.text) <> ''""",
)
declare(
    "lag_separator",
    """SELECT conv_id, turn, CASE WHEN before IS NULL THEN 'start' WHEN abs(length(text) - before) <= 0.45 * greatest(length(text), before) THEN 'join' ELSE 'break' END AS separator
       FROM (SELECT conv_id, turn, text, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) x""",
)
declare(
    "ordered_concat_bbox",
    """SELECT conv_id, sha2(array_join(transform(array_sort(collect_list(struct(turn, text))), t -> t.text), ''), 256) AS digest,
              min(length(text)) AS shortest, max(length(text)) AS longest, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id""",
    """SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest, min(length(text)) AS shortest, max(length(text)) AS longest, max(turn) AS last_turn
       FROM conversations GROUP BY conv_id""",
)
declare(
    "next_version",
    """SELECT c_nationkey, concat('N', lpad(CAST(max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) + 1 AS STRING), 9, '0')) AS next_name FROM {customer} GROUP BY c_nationkey""",
    """SELECT c_nationkey, concat('N', lpad((max(regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT) + 1)::VARCHAR, 9, '0')) AS next_name FROM customer GROUP BY c_nationkey""",
)
declare(
    "barrier_between",
    """SELECT a.o_orderkey, a.next_key, EXISTS (SELECT 1 FROM {orders} b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = '5-LOW'
              AND b.o_orderdate > a.o_orderdate AND b.o_orderdate < a.next_date) AS barred
       FROM (SELECT o_orderkey, o_custkey, o_orderdate, lead(o_orderkey) OVER w AS next_key, lead(o_orderdate) OVER w AS next_date
             FROM {orders} WHERE o_orderpriority <> '5-LOW' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) a WHERE a.next_key IS NOT NULL""",
)

# ---- scans and scalar expressions ----

declare(
    "scan_parse_props",
    "SELECT event_id, from_json(props, 'k BIGINT').k AS k, get_json_object(props, '$.k') AS k_text FROM {events}",
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k') AS k_text FROM events",
)
declare(
    "explode_embedding",
    "SELECT vec_id, e.pos, CAST(e.col AS DOUBLE) AS component FROM {embeddings} LATERAL VIEW OUTER posexplode(coalesce(embedding, array())) e",
    "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS component FROM embeddings",
)
declare(
    "prefix_length_filter",
    "SELECT page_id, length(html) AS n FROM {pages} WHERE startswith(html, '<!DOCTYPE') AND length(html) > 512",
    "SELECT page_id, length(html) AS n FROM pages WHERE starts_with(html, '<!DOCTYPE') AND length(html) > 512",
)
declare("content_digest", "SELECT doc_id, sha2(text, 256) AS digest FROM {documents}", "SELECT doc_id, sha256(text) AS digest FROM documents")
declare(
    "digest_join",
    """SELECT d.doc_id, f.first_doc FROM (SELECT doc_id, sha2(text, 256) AS h FROM {documents}) d
       JOIN (SELECT sha2(text, 256) AS h, min(doc_id) AS first_doc FROM {documents} GROUP BY 1) f ON d.h = f.h WHERE d.doc_id <> f.first_doc""",
    """SELECT d.doc_id, f.first_doc FROM documents d JOIN (SELECT text, min(doc_id) AS first_doc FROM documents GROUP BY text) f ON d.text = f.text WHERE d.doc_id <> f.first_doc""",
)
declare(
    "coalesce_text",
    """SELECT doc_id, length(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END, ''), nullif(lang, ''), '')) AS n FROM {documents}""",
)
declare(
    "split_eligible",
    """SELECT event_type, CASE WHEN event_type IN ('click', 'view') AND value IS NOT NULL AND abs(value) < 50.0 THEN 'free' ELSE 'atomic' END AS class, count(*) AS n
       FROM {events} GROUP BY 1, 2""",
)
declare(
    "conditional_baseline",
    """SELECT event_id, CASE WHEN event_type = 'click' AND value <= 0.35 * 100 THEN value ELSE value - value % 1 END AS baseline FROM {events}""",
)
declare(
    "slot_parse",
    """SELECT l_orderkey, l_linenumber, size(split(slot, ',')) AS parts,
              CAST(split(slot, ',')[0] AS BIGINT) = l_orderkey AND CAST(split(slot, ',')[1] AS INT) = l_linenumber AS matches
       FROM (SELECT l_orderkey, l_linenumber, concat(l_orderkey, ',', l_linenumber) AS slot FROM {lineitem}) x""",
    """SELECT l_orderkey, l_linenumber, len(string_split(slot, ',')) AS parts,
              string_split(slot, ',')[1]::BIGINT = l_orderkey AND string_split(slot, ',')[2]::INT = l_linenumber AS matches
       FROM (SELECT l_orderkey, l_linenumber, concat(l_orderkey, ',', l_linenumber) AS slot FROM lineitem) x""",
)
declare(
    "valid_interval",
    """SELECT p_partkey, p_size * 1.0D AS lo, p_retailprice / 20.0D AS hi FROM {part} WHERE p_retailprice / 20.0D > p_size AND NOT isnan(p_retailprice)""",
    """SELECT p_partkey, p_size * 1.0::DOUBLE AS lo, p_retailprice / 20.0::DOUBLE AS hi FROM part WHERE p_retailprice / 20.0::DOUBLE > p_size AND NOT isnan(p_retailprice)""",
)

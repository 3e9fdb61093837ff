"""Pieces of the check SQL (DuckDB): the same tables and tiers, written independently of the DataFrame code."""

from __future__ import annotations

#: entries of the tree, with depth and path.
TREE = r"""tree AS (
  SELECT r_regionkey::BIGINT + 1000 AS frn, 0::BIGINT AS parent_frn, r_name AS name, 1 AS flags FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 2000, n_regionkey::BIGINT + 1000, n_name, 1 FROM nation
  UNION ALL SELECT c_custkey + 1000000, n.n_nationkey::BIGINT + 2000, c_name, CASE WHEN c_acctbal < 0 THEN 3 ELSE 1 END FROM customer JOIN nation n ON n.n_nationkey = c_nationkey
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey + 1000000, 'Order-' || o_orderkey || '_' || o_orderpriority || '.doc', CASE WHEN left(o_orderpriority, 1) = '5' THEN 4 ELSE 0 END FROM orders),
walk(frn, depth, path, parent_path) AS (
  SELECT t.frn, 0, t.name, '' FROM tree t WHERE t.parent_frn NOT IN (SELECT frn FROM tree)
  UNION ALL SELECT t.frn, w.depth + 1, w.path || '\' || t.name, w.path FROM tree t JOIN walk w ON t.parent_frn = w.frn)"""

PARTS = r"""parts AS (
  SELECT p_partkey + 5000000000 AS frn, 0::BIGINT AS parent_frn,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') || '-' || p_brand || '.' || lower(regexp_replace(p_type, '[^A-Za-z]+', '', 'g')) AS name, 0 AS flags FROM part)"""

LANE = r"""left(array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '[-_. \x01]+'), lambda x: x <> ''), lambda x: lower(left(x, 1))), ''), 8)"""


def quoted(q: str) -> str:
    return "'" + q.replace("'", "''") + "'"


def tiers(q: str, folded: str = "lower(name)", lane: str = LANE) -> str:
    """The index tiers of a literal query."""
    forward = quoted("(?s)^.*?" + ".*?".join(f"\\Q{c}\\E" for c in q))
    backward = quoted("(?s)^" + ".*?".join(f"\\Q{c}\\E" for c in reversed(q)))
    s, marked = quoted(q), f"replace({folded}, {quoted(q)}, chr(1))"
    word = f"(regexp_matches({marked}, '[-_. ]\\x01') OR ({s} SIMILAR TO '.*[-_. ]' AND contains({marked}, chr(1) || chr(1))))"
    fuzzy = f"WHEN length(regexp_extract({folded}, {forward}, 0)) > 0 THEN 0.3::DOUBLE + 0.2::DOUBLE * {len(q)} / length(regexp_extract(reverse(regexp_extract({folded}, {forward}, 0)), {backward}, 0))" if len(q.encode()) >= 3 else ""
    initials = f"WHEN contains({lane}, {s}) THEN 0.7" if len(q.encode()) <= 8 else ""
    return f"""CASE WHEN {folded} = {s} THEN 1.0::DOUBLE WHEN left({folded}, {len(q)}) = {s} THEN 0.9 WHEN contains({folded}, {s}) AND {word} THEN 0.8
    {initials} WHEN contains({folded}, {s}) THEN 0.55 {fuzzy} END"""


def factor(depth: str = "depth", flags: str = "flags") -> str:
    return f"(CASE WHEN ({flags} & 6) <> 0 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END / (1 + 0.02 * least({depth}, 127)))"


def shell(q: str, name: str = "name") -> str:
    """The catalogs' tiers of a literal folded query."""
    s, n, f = quoted(q), len(q), f"lower({name})"
    sep = r"[-_. /\\()&+:,]"
    at = lambda i: f"substr({name}, {i}, 1)"
    starts = (
        f"list_filter(range(1, length({name}) + 1), lambda i: CASE WHEN i = 1 THEN NOT regexp_matches({at('i')}, '{sep}') ELSE "
        f"(regexp_matches({at('i - 1')}, '{sep}') AND NOT regexp_matches({at('i')}, '{sep}')) OR (regexp_matches({at('i - 1')}, '\\p{{Ll}}') AND regexp_matches({at('i')}, '\\p{{Lu}}')) END)"
    )
    head = f"array_to_string(list_transform({starts}, lambda i: substr({f}, i, 1)), '')"
    pattern = quoted("(?s)" + ".*?".join(f"\\Q{c}\\E" for c in q))
    initials = f"WHEN left({head}, {n}) = {s} THEN 0.7" if n >= 2 else ""
    fuzzy = f"WHEN length(regexp_extract({f}, {pattern}, 0)) > 0 THEN 0.3::DOUBLE + 0.2::DOUBLE * {n} / length(regexp_extract({f}, {pattern}, 0))" if n >= 3 else ""
    return (
        f"CASE WHEN {f} = {s} THEN 1.0::DOUBLE WHEN left({f}, {n}) = {s} THEN 0.9 WHEN len(list_filter({starts}, lambda i: substr({f}, i, {n}) = {s})) > 0 THEN 0.8 "
        f"{initials} WHEN contains({f}, {s}) THEN 0.55 {fuzzy} END"
    )

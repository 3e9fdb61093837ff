"""Registered queries: one for each operator, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import datetime as dt
import unicodedata
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankfield.functions import match, scalar, shellmatch
from rankfield.functions.calc import calculator
from rankfield.functions.ranges import ranges_column
from rankfield.functions.text import cut_to_bytes, fold_unicode, initials, mask_of, segments, utf16_length
from rankfield.operators import catalogs, clips, content, filters, latency, logs, merge, minor, rank, scopes, security, tree
from rankfield.plans import snapshot
from rankfield.plans import sqltext as S
from rankfield.session import materialized, shared_folder
from rankfield.sources import adapters as A
from rankfield.sources import journal, providers
from rankfield.streaming import changes, live, sessions, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: 2024-01-31 00:00:00 UTC.
NOW = 1706659200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str = "score"):
    return F.round(F.col(c), 6).alias(c)


_CATALOGS: dict[tuple[str, str, str], DataFrame] = {}


def _catalog(spark, sf_dir: str, name: str, rows) -> DataFrame:
    """A snapshot that is built when it is first asked for, and then searched: ingest is not part of a query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _CATALOGS:
        _CATALOGS[key] = snapshot.build(rows(spark, sf_dir), name)
    return _CATALOGS[key]


def tree_entries(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir, "tree", A.tree_rows)


def part_entries(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir, "parts", A.part_rows)


def parts_sql(q: str, order: str = "score DESC, frn LIMIT 20", more: str = "") -> str:
    return f"WITH {S.PARTS}, hit AS (SELECT frn, name, {S.tiers(q)} AS base FROM parts {more}) SELECT frn, name, round(base, 6) AS score FROM hit WHERE base IS NOT NULL ORDER BY {order}"


def part_search(spark, sf_dir, q: str, k: int = 20) -> DataFrame:
    return rank.search(part_entries(spark, sf_dir), q, k).select("frn", "name", r6())


# --- tiers and pages


def _tier_query(name: str, q: str) -> None:
    def run(spark, sf_dir, q=q):
        return part_search(spark, sf_dir, q)

    run.__name__ = name
    query(parts_sql(q))(run)


_tier_query("search_prefix", "red")
_tier_query("search_word_boundary", "brand#1")
_tier_query("search_substring", "olt-")
_tier_query("search_initials", "rwb")
_tier_query("search_fuzzy", "rdbr")
_tier_query("search_one_char", "s")


@query(f"WITH RECURSIVE {S.TREE}, hit AS (SELECT t.frn, t.name, depth, {S.tiers('customer#000000012')} * {S.factor()} AS score FROM tree t JOIN walk USING (frn)) SELECT frn, name, depth, round(score, 6) AS score FROM hit WHERE score IS NOT NULL ORDER BY score DESC, frn LIMIT 20")
def search_exact(spark, sf_dir):
    return rank.search(tree_entries(spark, sf_dir), "customer#000000012", 20).select("frn", "name", "depth", r6())


@query(f"WITH RECURSIVE {S.TREE}, hit AS (SELECT t.frn, t.name, depth, {S.tiers('0012')} AS base, {S.tiers('0012')} * {S.factor()} AS score FROM tree t JOIN walk USING (frn)) SELECT frn, name, round(base, 6) AS base, round(score, 6) AS score FROM hit WHERE base IS NOT NULL ORDER BY score DESC, frn LIMIT 20")
def topk_page(spark, sf_dir):
    return rank.search(tree_entries(spark, sf_dir), "0012", 20).select("frn", "name", r6("base"), r6())


@query(f"WITH {S.PARTS}, hit AS (SELECT {S.tiers('brt')} AS base FROM parts) SELECT CASE WHEN base >= 1 THEN 'exact' WHEN base >= 0.9 THEN 'prefix' WHEN base >= 0.8 THEN 'word' WHEN base >= 0.7 THEN 'initials' WHEN base >= 0.55 THEN 'substring' ELSE 'fuzzy' END AS tier, count(*) AS n, round(max(base), 6) AS best FROM hit WHERE base IS NOT NULL GROUP BY 1")
def search_all_tiers(spark, sf_dir):
    return rank.scored(part_entries(spark, sf_dir), "brt").groupBy("tier").agg(F.count("*").alias("n"), F.round(F.max("base"), 6).alias("best"))


@query(f"WITH {S.PARTS}, m AS (SELECT count(*) FILTER (WHERE len(list_filter(string_split('rdbr', ''), lambda c: NOT contains(lower(name), c))) = 0) AS survivors, count(*) FILTER (WHERE ({S.tiers('rdbr')}) < 0.55) AS verified FROM parts) SELECT survivors, verified, survivors > 20000 AS capped FROM m")
def fuzzy_survivors(spark, sf_dir):
    """Entries that hold all of the query's characters, of these the fuzzy matches, and whether a cap of 20,000 would have bitten."""
    e = part_entries(spark, sf_dir).withColumn("base", match.tier_score(F.col("folded"), F.col("lane"), "rdbr"))
    holds = F.forall(F.array(*(F.lit(c) for c in "rdbr")), lambda c: F.contains(F.col("folded"), c))
    return e.agg(F.count(F.when(holds, 1)).alias("survivors"), F.count(F.when(F.col("base") < 0.55, 1)).alias("verified")).withColumn("capped", F.col("survivors") > 20000)


@query(f"WITH {S.PARTS} SELECT sum((length(lower(name)) - length(replace(lower(name), 'e', ''))) / 1)::BIGINT AS hits FROM parts")
def arena_probe(spark, sf_dir):
    return part_entries(spark, sf_dir).agg(F.sum(match.occurrences(F.col("folded"), F.lit("e"))).cast("long").alias("hits"))


_BATCH = ["red", "bolt", "brand#2", "gw", "xqz", "smallrng"]


@query(f"WITH {S.PARTS}, hit AS (" + " UNION ALL ".join(f"SELECT {k} AS qid, frn, {S.tiers(q)} AS base FROM parts" for k, q in enumerate(_BATCH)) + "), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base DESC, frn) AS place FROM hit WHERE base IS NOT NULL) SELECT qid, frn, round(base, 6) AS score, place::INTEGER AS place FROM ranked WHERE place <= 10")
def batch_search(spark, sf_dir):
    queries = spark.createDataFrame(list(enumerate(_BATCH)), "qid int, q string")
    return rank.batch_search(part_entries(spark, sf_dir), queries, 10).select("qid", "frn", r6(), "place")


@query(f"WITH {S.PARTS}, hit AS (SELECT frn, {S.tiers('red')} AS base FROM parts), page AS (SELECT * FROM hit WHERE base IS NOT NULL ORDER BY base DESC, frn LIMIT 100) SELECT frn, CAST(floor((row_number() OVER (ORDER BY base DESC, frn) - 1) / 32) AS INTEGER) AS seq FROM page")
def batches_seq(spark, sf_dir):
    return content.batches(rank.search(part_entries(spark, sf_dir), "red", 100), 32, F.desc("score"), "frn").select("frn", "seq")


# --- text


@query(f"WITH {S.PARTS} SELECT frn, lower(name) AS folded, {S.LANE} AS lane, len(list_filter(regexp_split_to_array(regexp_replace(name, '(\\p{{Ll}})(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), '[-_. \\x01]+'), lambda x: x <> '')) AS n_segments FROM parts")
def names_normalised(spark, sf_dir):
    return A.part_rows(spark, sf_dir).select("frn", F.lower("name").alias("folded"), initials(F.col("name")).alias("lane"), F.size(segments(F.col("name"))).cast("long").alias("n_segments"))


_ACCENTS = "SELECT doc_id AS frn, regexp_extract(text, '^[^ \\t\\n]+ ?[^ \\t\\n]*', 0) AS name FROM documents WHERE lang <> 'en'"


@F.pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    return x.map(lambda v: unicodedata.normalize("NFD", v), na_action="ignore")


def _accented(spark, sf_dir) -> DataFrame:
    """First two words of texts in other languages, in decomposed form where the number is even."""
    docs = A.table(spark, sf_dir, "documents").where("lang <> 'en'")
    name = F.regexp_extract("text", "^[^ \\t\\n]+ ?[^ \\t\\n]*", 0)
    rows = docs.select(F.col("doc_id").alias("frn"), F.when(F.pmod("doc_id", F.lit(2)) == 0, _decomposed(name)).otherwise(name).alias("name"))
    return A.with_derived(rows.where("name <> ''")).withColumns({"depth": F.lit(0), "flags": F.lit(0)})


@query(f"WITH a AS ({_ACCENTS}), f AS (SELECT frn, lower(nfc_normalize(name)) AS folded, lower(nfc_normalize(name)) AS name FROM a WHERE name <> ''), hit AS (SELECT frn, {S.tiers('é', 'folded', chr(39) + chr(39))} AS base FROM f) SELECT frn, round(base, 6) AS score FROM hit WHERE base IN (1.0, 0.9, 0.8)")
def search_unicode(spark, sf_dir):
    """Names beyond ASCII, composed or not, found by a query in capitals and decomposed: whole, at the start, or at a word."""
    hit = rank.scored(_accented(spark, sf_dir), rank.fold_text("E\u0301"))
    return hit.where(F.col("base").isin(match.EXACT, match.PREFIX, match.WORD)).select("frn", r6())


def _mask_sql(text: str) -> str:
    return f"(SELECT bit_or(1::HUGEINT << (CASE WHEN c BETWEEN 97 AND 122 THEN c - 97 WHEN c BETWEEN 48 AND 57 THEN c - 22 WHEN c = 45 THEN 36 WHEN c = 95 THEN 37 WHEN c = 46 THEN 38 WHEN c = 32 THEN 39 ELSE 40 + c % 8 END)::INTEGER) FROM (SELECT unnest(list_transform(string_split(lower({text}), ''), lambda x: ascii(x))) AS c))"


@query(f"WITH {S.PARTS} SELECT frn, {_mask_sql('name')}::BIGINT AS mask FROM parts WHERE len(list_filter(string_split('gwz', ''), lambda c: NOT contains(lower(name), c))) = 0")
def class_prefilter(spark, sf_dir):
    """Names whose byte classes cover those of a query: what a match must at least be.  Letters and digits have a class each."""
    e = part_entries(spark, sf_dir)
    return e.where(match.may_match(F.col("mask"), F.lit(mask_of("gwz")))).select("frn", "mask")


@query("SELECT doc_id, lower(nfc_normalize(text)) AS folded FROM documents")
def fold_unicode_names(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", fold_unicode(F.col("text")).alias("folded"))


@query(f"WITH {S.PARTS}, hit AS (SELECT frn, name, {S.tiers('r-b')} AS base FROM parts), page AS (SELECT * FROM hit WHERE base IS NOT NULL ORDER BY base DESC, frn LIMIT 20) SELECT frn, name, CASE WHEN base = 0.55 THEN 'substring' ELSE 'fuzzy' END AS tier, CASE WHEN base = 0.55 THEN '[' || (strpos(lower(name), 'r-b') - 1) || ',' || (strpos(lower(name), 'r-b') + 2) || ')' ELSE '[' || (strpos(lower(name), 'r') - 1) || ',' || strpos(lower(name), 'r') || ')...' END AS ranges FROM page")
def match_ranges(spark, sf_dir):
    """Ranges of the page as text: the whole of a substring, the beginning of others."""
    page = rank.search(part_entries(spark, sf_dir), "R-B", 20)
    found = page.select("frn", "name", "tier", ranges_column("name", F.lit("r-b"), "tier").alias("r"))
    one = lambda x: F.concat(F.lit("["), x["s"].cast("string"), F.lit(","), x["e"].cast("string"), F.lit(")"))
    first = F.col("r")[0]
    lone = F.concat(F.lit("["), first["s"].cast("string"), F.lit(","), (first["s"] + 1).cast("string"), F.lit(")..."))
    return found.select("frn", "name", "tier", F.when(F.col("tier") == "substring", F.array_join(F.transform("r", one), "")).otherwise(lone).alias("ranges"))


@query(f"WITH {S.PARTS} SELECT left(lower(name), 1) AS first, count(*) AS n FROM parts GROUP BY 1 ORDER BY n DESC, first LIMIT 6")
def first_byte_histogram(spark, sf_dir):
    return A.part_rows(spark, sf_dir).groupBy(F.left(F.lower("name"), F.lit(1)).alias("first")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "first").limit(6)


@query(f"WITH {S.PARTS} SELECT round(avg(strlen(name)), 6) AS mean_bytes, count(*) AS n FROM parts")
def mean_name_bytes(spark, sf_dir):
    return A.part_rows(spark, sf_dir).agg(F.round(F.avg(F.octet_length("name")), 6).alias("mean_bytes"), F.count("*").alias("n"))


# --- tree


@query(f"WITH RECURSIVE {S.TREE} SELECT frn, depth FROM walk")
def depth_of(spark, sf_dir):
    return tree.resolve(A.tree_rows(spark, sf_dir)).select("frn", "depth")


@query(f"WITH RECURSIVE {S.TREE} SELECT frn, path, parent_path FROM walk")
def path_of(spark, sf_dir):
    return tree.resolve(A.tree_rows(spark, sf_dir)).select("frn", "path", "parent_path")


@query(f"WITH RECURSIVE {S.TREE} SELECT frn, round({S.factor()}, 6) AS factor FROM tree JOIN walk USING (frn)")
def depth_penalty(spark, sf_dir):
    return tree_entries(spark, sf_dir).select("frn", F.round(match.rank_factor(F.col("depth"), F.col("flags")), 6).alias("factor"))


@query(f"WITH RECURSIVE {S.TREE} SELECT frn, parent_frn, name FROM tree WHERE parent_frn NOT IN (SELECT frn FROM tree)")
def orphans_anchor(spark, sf_dir):
    return tree.orphans(A.tree_rows(spark, sf_dir))


@query(f"WITH RECURSIVE {S.TREE} SELECT depth, count(*) AS n FROM walk GROUP BY depth")
def depth_histogram(spark, sf_dir):
    return tree.resolve(A.tree_rows(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("n"))


# --- filters


@query(parts_sql("red", more="WHERE regexp_matches(lower(name), '\\.(small|economy)$')"))
def filter_ext(spark, sf_dir):
    e = part_entries(spark, sf_dir).where(filters.ext_filter(F.col("name"), ["Small", ".ECONOMY"]))
    return rank.search(e, "red", 20).select("frn", "name", r6())


def _kind_sql(exts: list[str]) -> str:
    return "(" + " OR ".join(f"lower(p) LIKE '%.{e}'" for e in exts) + ")"


@query(f"WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*', '') || CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.md' ELSE '' END AS p FROM pages) SELECT page_id, p FROM u WHERE {_kind_sql(filters.KIND_EXTS['document'])}")
def filter_kind(spark, sf_dir):
    return _named_pages(spark, sf_dir).where(filters.ext_filter(F.col("p"), filters.parse_file_query("x kind:document").exts)).select("page_id", "p")


def _named_pages(spark, sf_dir) -> DataFrame:
    ext = F.expr("CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.md' ELSE '' END")
    return A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*", ""), ext).alias("p"))


@query(f"WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*', '') || CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.md' ELSE '' END AS p FROM pages) SELECT page_id, p FROM u WHERE {_kind_sql(['gz'])}")
def filter_kind_and_ext(spark, sf_dir):
    return _named_pages(spark, sf_dir).where(filters.ext_filter(F.col("p"), filters.parse_file_query("x kind:archive ext:.GZ,rs").exts)).select("page_id", "p")


@query(f"WITH RECURSIVE {S.TREE}, hit AS (SELECT frn, {S.tiers('low')} * {S.factor()} AS score FROM tree t JOIN walk USING (frn) WHERE contains(lower(parent_path), 'nation_1')) SELECT frn, round(score, 6) AS score FROM hit WHERE score IS NOT NULL ORDER BY score DESC, frn LIMIT 25")
def filter_path(spark, sf_dir):
    e = tree_entries(spark, sf_dir).where(filters.path_filter(F.col("parent_path"), "NATION_1"))
    return rank.search(e, "low", 25).select("frn", r6())


@query(parts_sql("bolt", order="score DESC, frn LIMIT 32", more="WHERE lower(name) LIKE '%.large'"))
def filtered_page_fills(spark, sf_dir):
    """A filter before the page fills it; one after would leave it short."""
    e = part_entries(spark, sf_dir).where(filters.ext_filter(F.col("name"), ["large"]))
    return rank.search(e, "bolt", 32).select("frn", "name", r6())


@query("WITH q AS (SELECT item_id, text, CASE WHEN item_id % 7 = 0 THEN repeat('x', 1025) ELSE text END AS t FROM benchmark) SELECT item_id, t <> '' AND strlen(t) <= 1024 AS valid FROM q")
def request_guards(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark").withColumn("t", F.when(F.pmod("item_id", F.lit(7)) == 0, F.repeat(F.lit("x"), F.lit(1025))).otherwise(F.col("text")))
    return b.select("item_id", filters.valid_request(F.col("t"), F.array().cast("array<string>"), F.lit("")).alias("valid"))


# --- usage


_USAGE = f"used AS (SELECT user_id::VARCHAR AS id, count(*) AS n, max(epoch(ts)::BIGINT) AS last_ts FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type IN ('view', 'click')) GROUP BY 1), bonus AS (SELECT id, n, last_ts, 0.09 * (n * pow(0.5, greatest(0, {NOW} - last_ts) / 604800.0)) / (n * pow(0.5, greatest(0, {NOW} - last_ts) / 604800.0) + 2) AS bonus FROM used)"


@query(f"WITH {_USAGE} SELECT id, n AS count, last_ts FROM bonus")
def usage_counts(spark, sf_dir):
    return rank.usage(A.launches(spark, sf_dir)).select("id", "count", "last_ts")


@query(f"WITH {_USAGE} SELECT id, round(bonus, 6) AS bonus FROM bonus")
def frecency_bonus(spark, sf_dir):
    return rank.usage(A.launches(spark, sf_dir)).select("id", F.round(rank.usage_bonus(F.col("count"), F.col("last_ts"), NOW), 6).alias("bonus"))


_CUSTOMERS = "SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer"


def _customers(spark, sf_dir, q: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return rank.with_usage(c.withColumn("score", shellmatch.score(F.col("name"), q)).where("score is not null"), rank.usage(A.launches(spark, sf_dir)), NOW)


@query(f"WITH {_USAGE}, hit AS (SELECT id, name, {S.shell('0001')} AS score FROM ({_CUSTOMERS})) SELECT h.id, round(score + coalesce(bonus, 0), 6) AS total FROM hit h LEFT JOIN bonus b USING (id) WHERE score IS NOT NULL")
def frecency_rerank(spark, sf_dir):
    return _customers(spark, sf_dir, "0001").select("id", F.round(F.col("score") + F.col("bonus"), 6).alias("total"))


@query(f"WITH {_USAGE}, hit AS (SELECT id, name, {S.shell('00')} AS score FROM ({_CUSTOMERS})), pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS pos FROM hit WHERE score IS NOT NULL ORDER BY score DESC, name LIMIT 64) SELECT p.id, round(score + coalesce(bonus, 0), 6) AS total FROM pool p LEFT JOIN bonus b USING (id) ORDER BY score + coalesce(bonus, 0) DESC, pos LIMIT 8")
def frecency_topk_pool(spark, sf_dir):
    return rank.rerank(_customers(spark, sf_dir, "00"), rank.CATALOG_CAPS["app"], "name").select("id", F.round("total", 6).alias("total"))


# --- catalogs


@query(f"WITH {S.PARTS}, hit AS (SELECT frn, name, {S.shell('bra')} AS score FROM parts) SELECT frn, name, round(score, 6) AS score FROM hit WHERE score IS NOT NULL ORDER BY hit.score DESC, strlen(name), name, frn LIMIT 20")
def apps_match(spark, sf_dir):
    return catalogs.matched(A.part_rows(spark, sf_dir), "app", "bra").orderBy(*catalogs.catalog_order(), "frn").limit(20).select("frn", "name", r6())


def _settings(spark, sf_dir) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name"), F.array("p_brand", F.lower("p_type")).alias("synonyms"),
        F.col("p_size").alias("min_build"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, "battery").when(F.pmod("p_partkey", F.lit(3)) == 1, "pen").alias("requires"),
    )


_SETTINGS = "s AS (SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name, p_brand, lower(p_type) AS kind, p_size AS min_build, CASE p_partkey % 3 WHEN 0 THEN 'battery' WHEN 1 THEN 'pen' END AS requires FROM part)"


@query(f"WITH {_SETTINGS} SELECT id, name FROM s WHERE min_build <= 25 AND (requires IS NULL OR requires = 'battery')")
def settings_gate(spark, sf_dir):
    return catalogs.available(_settings(spark, sf_dir), 25, ["battery"]).select("id", "name")


@query(f"WITH {_SETTINGS}, hit AS (SELECT id, name, {S.shell('wid')} AS direct, greatest({S.shell('wid', 'p_brand')}, {S.shell('wid', 'kind')}) * 0.9 AS syn FROM s) SELECT id, round(CASE WHEN syn > coalesce(direct, -1) THEN syn ELSE direct END, 6) AS score FROM hit WHERE direct IS NOT NULL OR syn IS NOT NULL")
def settings_match(spark, sf_dir):
    return catalogs.matched(_settings(spark, sf_dir), "setting", " Wid ").select("id", r6())


@query(f"WITH {_SETTINGS}, hit AS (SELECT id, name, {S.shell('eco')} AS direct, greatest({S.shell('eco', 'p_brand')}, {S.shell('eco', 'kind')}) * 0.9 AS syn FROM s) SELECT id, round(CASE WHEN syn > coalesce(direct, -1) THEN syn ELSE direct END, 6) AS score FROM hit WHERE direct IS NOT NULL OR syn IS NOT NULL")
def settings_synonyms(spark, sf_dir):
    return catalogs.matched(_settings(spark, sf_dir), "setting", "eco").select("id", r6())


@query(f"WITH {_SETTINGS}, hit AS (SELECT id, id % 2 = 0 AS own, {S.shell('red')} AS direct, greatest({S.shell('red', 'p_brand')}, {S.shell('red', 'kind')}) * 0.9 AS syn FROM s) SELECT id, round(CASE WHEN syn > coalesce(direct, -1) THEN syn ELSE direct END + CASE WHEN coalesce(direct, 0) >= CASE WHEN own THEN 0.8 ELSE 0.9 END THEN 0.5 ELSE 0 END, 6) AS score FROM hit WHERE (direct IS NOT NULL OR syn IS NOT NULL) AND (own OR id % 4 = 1)")
def commands_band(spark, sf_dir):
    commands = _settings(spark, sf_dir).withColumn("requires_app", F.when(F.pmod("id", F.lit(2)) != 0, F.concat(F.lit("app"), F.pmod("id", F.lit(4)).cast("string"))))
    apps = spark.createDataFrame([("app1",)], "id string")
    return catalogs.banded(catalogs.matched(catalogs.backed(commands, apps), "command", "red")).select("id", r6())


_WINDOWS = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 13 = 0 THEN '  ' ELSE s_name END AS title, s_acctbal > 0 AS visible, s_suppkey % 5 <> 0 AS alt_tab, s_suppkey % 7 = 0 AS tool, s_suppkey % 11 = 0 AS cloaked FROM supplier"


def _windows(spark, sf_dir) -> DataFrame:
    k = lambda n: F.pmod("s_suppkey", F.lit(n))
    return A.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(k(13) == 0, "  ").otherwise(F.col("s_name")).alias("title"), (F.col("s_acctbal") > 0).alias("visible"), (k(5) != 0).alias("alt_tab"), (k(7) == 0).alias("tool"), (k(11) == 0).alias("cloaked")
    )


@query(f"WITH w AS ({_WINDOWS}) SELECT id, title FROM w WHERE visible AND alt_tab AND NOT tool AND NOT cloaked AND trim(title) <> ''")
def windows_listed(spark, sf_dir):
    return catalogs.listed_windows(_windows(spark, sf_dir)).select("id", "title")


@query(f"WITH w AS ({_WINDOWS}), hit AS (SELECT id, title AS name, {S.shell('r#0', 'title')} AS score FROM w WHERE visible AND alt_tab AND NOT tool AND NOT cloaked AND trim(title) <> '') SELECT id, round(score, 6) AS score FROM hit WHERE score IS NOT NULL")
def windows_match(spark, sf_dir):
    return catalogs.matched(catalogs.listed_windows(_windows(spark, sf_dir)).withColumnRenamed("title", "name"), "window", "R#0").select("id", r6())


@query("SELECT s_suppkey AS id FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey % 10 = 3)")
def apps_suppressed(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.col("s_suppkey").alias("key"))
    return catalogs.suppressed(s, s.where("key % 10 = 3").select(F.upper("id").alias("id"))).select(F.col("key").alias("id"))


@query("SELECT n_nationkey AS id, n_regionkey < 3 AND upper(CASE WHEN n_nationkey % 2 = 0 THEN 'ntfs' ELSE 'fat32' END) = 'NTFS' AS is_fixed_ntfs FROM nation")
def volume_discovery(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") < 3).alias("fixed"), F.when(F.pmod("n_nationkey", F.lit(2)) == 0, "ntfs").otherwise("fat32").alias("fs"))
    return catalogs.volumes(n).select("id", "is_fixed_ntfs")


# --- merge


def _sources(spark, sf_dir) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("app", "file", "command", "setting", "window", "calc"))), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    return part.select(kind.alias("kind"), F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("score"), F.when(kind == "command", F.pmod("p_partkey", F.lit(5)).cast("int")).alias("ord"))


_ROWS = "rows_ AS (SELECT ['app','file','command','setting','window','calc'][(p_partkey % 6 + 1)::INTEGER] AS kind, p_partkey::VARCHAR AS key, p_name AS name, p_retailprice AS score, CASE WHEN p_partkey % 6 = 2 THEN (p_partkey % 5)::INTEGER END AS ord FROM part)"
_ORDER = "score DESC, CASE WHEN kind = 'file' THEN 1 ELSE 0 END, coalesce(ord, 0), name, key"
_CAPS = "CASE kind WHEN 'calc' THEN 1 WHEN 'window' THEN 2 ELSE 3 END"


@query(f"WITH {_ROWS} SELECT kind, count(*) AS n, count(ord) AS with_ord FROM rows_ GROUP BY kind")
def merge_sources(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    parts = [rows.where(F.col("kind") == k).drop(*(["ord"] if k != "command" else [])) for k in ("app", "file", "command", "setting", "window", "calc")]
    return merge.union(*parts).groupBy("kind").agg(F.count("*").alias("n"), F.count("ord").alias("with_ord"))


@query(f"WITH {_ROWS}, c AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, key) AS p FROM rows_) SELECT name, key FROM c WHERE p = 1")
def collapse_same_name(spark, sf_dir):
    return merge.collapse_names(_sources(spark, sf_dir), "key").select("name", "key")


@query(f"WITH {_ROWS}, c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_ORDER}) AS p FROM rows_) SELECT kind, key FROM c WHERE p <= {_CAPS}")
def cap_by_kind(spark, sf_dir):
    return merge.cap_kinds(_sources(spark, sf_dir), merge.list_order()).select("kind", "key")


@query(f"WITH {_ROWS}, f AS (SELECT p_partkey::VARCHAR AS key, p_partkey AS frozen_pos FROM part WHERE p_partkey IN (1, 2, 8, 9)), j AS (SELECT rows_.*, frozen_pos FROM rows_ LEFT JOIN f USING (key)), c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY frozen_pos IS NULL, frozen_pos, {_ORDER}) AS p FROM j), k AS (SELECT * FROM c WHERE p <= {_CAPS} OR frozen_pos IS NOT NULL) SELECT key, row_number() OVER (ORDER BY frozen_pos IS NULL, frozen_pos, {_ORDER}) - 1 AS pos FROM k")
def merge_frozen(spark, sf_dir):
    frozen = spark.createDataFrame([(str(k), k) for k in (1, 2, 8, 9)], "key string, frozen_pos long")
    return merge.merge(_sources(spark, sf_dir), frozen).select("key", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_ROWS}, c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_ORDER}) AS p FROM rows_), k AS (SELECT key, row_number() OVER (ORDER BY {_ORDER}) - 1 AS pos FROM c WHERE p <= {_CAPS}) SELECT coalesce(max(CASE WHEN key = (SELECT max(key) FROM k) THEN pos END), 0) AS selected FROM k")
def selection_index(spark, sf_dir):
    merged = merge.merge(_sources(spark, sf_dir)).select("key", "pos")
    last = merged.agg(F.max("key").alias("k"))
    return merged.join(last, F.col("key") == F.col("k"), "left").agg(F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col("pos"))), F.lit(0)).cast("long").alias("selected"))


@query("WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C:\\Windows\\WinSxS\\' WHEN 1 THEN '/$Recycle.Bin/' WHEN 2 THEN 'C:\\Windows\\System32\\' ELSE 'relative ' END || url AS path FROM pages) SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM p")
def path_weight(spark, sf_dir):
    prefix = F.element_at(F.array(F.lit("C:\\Windows\\WinSxS\\"), F.lit("/$Recycle.Bin/"), F.lit("C:\\Windows\\System32\\"), F.lit("relative ")), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    return A.table(spark, sf_dir, "pages").select("page_id", rank.path_weight(F.concat(prefix, F.col("url"))).alias("weight"))


@query(f"WITH {_USAGE} SELECT c_custkey AS frn, round((0.5 + coalesce(bonus, 0)) * 1.0, 6) AS score FROM customer LEFT JOIN bonus ON id = c_custkey::VARCHAR ORDER BY 0.5 + coalesce(bonus, 0) DESC, c_custkey LIMIT 50")
def fallback_rank(spark, sf_dir):
    c = rank.fallback_rows(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frn"), F.col("c_custkey").cast("string").alias("path")))
    rows = rank.with_usage(c, rank.usage(A.launches(spark, sf_dir)), NOW).withColumn("score", F.col("score") + F.col("bonus"))
    return rank.page(rows, 50, "frn").select("frn", r6())


# --- change log


_CHANGES = "ch AS (SELECT event_id AS usn, CASE WHEN event_type IN ('signup', 'click') THEN 'C' WHEN event_type = 'purchase' THEN 'R' WHEN event_type = 'error' THEN 'D' ELSE 'S' END AS op, user_id AS frn, event_id % 7 AS parent_frn, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'Item_' || (event_id % 97) || '.txt' END AS name, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS flags FROM events), ok AS (SELECT * FROM ch WHERE op NOT IN ('C', 'R') OR name <> ''), last_ AS (SELECT frn, max(usn) FILTER (op IN ('C', 'D')) AS cd, max(usn) FILTER (op IN ('C', 'R')) AS cr, min(usn) FILTER (op = 'C') AS slot FROM ok GROUP BY frn)"
_LIVE = f"{_CHANGES}, live AS (SELECT l.frn, b.parent_frn, b.name, a.flags, l.slot FROM last_ l JOIN ch a ON a.usn = l.cd AND a.op = 'C' JOIN ch b ON b.usn = l.cr)"


@query(f"WITH {_LIVE} SELECT * FROM live")
def fold_changes(spark, sf_dir):
    return changes.fold(A.changes(spark, sf_dir))


@query(f"WITH {_LIVE}, hit AS (SELECT frn, {S.tiers('item_1')} * {S.factor('0')} AS score FROM live) SELECT frn, round(score, 6) AS score FROM hit WHERE score IS NOT NULL")
def fold_then_search(spark, sf_dir):
    e = A.with_derived(changes.fold(A.changes(spark, sf_dir))).withColumn("depth", F.lit(0))
    return rank.scored(e, "item_1").select("frn", r6())


@query(f"WITH {_CHANGES}, g AS (SELECT count(*) AS total, count(*) FILTER (a.op = 'D') AS dead FROM (SELECT DISTINCT frn FROM ok WHERE op IN ('C', 'D', 'R')) f JOIN last_ USING (frn) LEFT JOIN ch a ON a.usn = cd) SELECT total, dead, dead / total >= 0.25 AS due_idle, dead / total > 0.40 AS due_now FROM g")
def compaction_stats(spark, sf_dir):
    return changes.waste(A.changes(spark, sf_dir)).select("total", "dead", "due_idle", "due_now")


def _stream_of(spark, sf_dir: str, files: int = 1) -> DataFrame:
    """The event log as a stream of five files, so many to a micro-batch."""
    events = A.table(spark, sf_dir, "events")
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    events.repartitionByRange(5, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


class _Published:
    """What a stream's micro-batches publish, a folder a batch, so that one that is run again replaces its own."""

    def __init__(self, spark):
        self.spark, self.path, self.checkpoint = spark, f"{shared_folder(spark)}/states-{uuid.uuid4().hex}", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def states(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


@query(f"WITH {_LIVE} SELECT * FROM live")
def stream_fold(spark, sf_dir):
    """The event log as a stream of files, folded in five micro-batches, of which each publishes what it changed."""
    out = _Published(spark)
    changes.fold_stream(A.changes_from_events(_stream_of(spark, sf_dir)), out.checkpoint, out).awaitTermination()
    return changes.latest(out.states())


@query(f"WITH {_USAGE} SELECT id, n AS count, last_ts FROM bonus")
def stream_usage(spark, sf_dir):
    """Launches as a stream: counts and last times by id after all micro-batches."""
    out = _Published(spark)
    e = _stream_of(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    usage.usage_stream(e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts")), out.checkpoint, out).awaitTermination()
    return usage.newest_states(out.states(), "id").select("id", "count", "last_ts")


@query("WITH c AS (SELECT event_id AS ts, 'clip ' || (event_id % 700) AS text, event_id % 13 = 0 AS ex, CASE event_id % 17 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS inc FROM events) SELECT md5(text) AS hash, max(ts) AS ts, count(*) AS times FROM c WHERE NOT ex AND coalesce(inc, 1) <> 0 GROUP BY 1")
def stream_clips(spark, sf_dir):
    """Captures as a stream: those that ask not to be remembered are not, and a content seen again moves to the top."""
    out = _Published(spark)
    inc = F.when(F.pmod("event_id", F.lit(17)) == 0, 0).when(F.pmod("event_id", F.lit(17)) == 1, 1)
    formats = F.map_concat(
        F.when(F.pmod("event_id", F.lit(13)) == 0, F.create_map(F.lit(clips.EXCLUDING), F.lit(None).cast("int"))).otherwise(F.create_map().cast("map<string,int>")),
        F.when(inc.isNotNull(), F.create_map(F.lit(clips.CONSENTS[0]), inc)).otherwise(F.create_map().cast("map<string,int>")),
    )
    c = _stream_of(spark, sf_dir, 2).select(F.col("event_id").alias("ts"), F.concat(F.lit("clip "), F.pmod("event_id", F.lit(700)).cast("string")).alias("text"), F.lit("app").alias("source"), formats.alias("formats"))
    usage.clips_stream(c, out.checkpoint, out).awaitTermination()
    return usage.newest_states(out.states(), "hash").select("hash", "ts", "times")


def _requests(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 50).cast("long").alias("gen"), F.when(F.col("event_type") == "error", "cancel").otherwise("query").alias("kind"), F.col("event_id").alias("arrival"))


_REQ = "rq AS (SELECT user_id AS session, event_id // 50 AS gen, CASE WHEN event_type = 'error' THEN 'cancel' ELSE 'query' END AS kind, event_id AS arrival FROM events), wm AS (SELECT session, max(gen + CASE WHEN kind = 'cancel' THEN 1 ELSE 0 END) AS latest FROM rq GROUP BY session)"


@query(f"WITH {_REQ} SELECT * FROM wm")
def latest_gen(spark, sf_dir):
    return sessions.watermark(_requests(spark, sf_dir))


@query(f"WITH {_REQ}, c AS (SELECT rq.*, row_number() OVER (PARTITION BY session ORDER BY gen DESC, arrival DESC) AS p FROM rq JOIN wm USING (session) WHERE kind = 'query' AND gen >= latest) SELECT session, gen, arrival FROM c WHERE p = 1")
def newest_request(spark, sf_dir):
    return sessions.newest(_requests(spark, sf_dir)).select("session", "gen", "arrival")


@query(f"WITH {_REQ} SELECT session, gen, arrival FROM rq JOIN wm USING (session) WHERE gen >= latest")
def stale_dropped(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return sessions.drop_stale(r, sessions.watermark(r)).select("session", "gen", "arrival")


@query(f"WITH {_REQ}, a AS (SELECT session, count(*) AS asked FROM rq WHERE kind = 'query' GROUP BY 1), b AS (SELECT DISTINCT session FROM rq JOIN wm USING (session) WHERE kind = 'query' AND gen >= latest) SELECT a.session, asked, (CASE WHEN b.session IS NULL THEN 0 ELSE 1 END)::BIGINT AS answered, asked - CASE WHEN b.session IS NULL THEN 0 ELSE 1 END AS superseded FROM a LEFT JOIN b USING (session)")
def superseded_requests(spark, sf_dir):
    return sessions.superseded(_requests(spark, sf_dir))


# --- latency


@query("SELECT event_type AS class, count(*) AS n, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def nearest_rank_percentiles(spark, sf_dir):
    return latency.summary(A.samples(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS class, list_sort(list(value))[(round((count(*) - 1) * 0.95)::BIGINT + 1)] AS p95 FROM events GROUP BY 1")
def probe_percentile(spark, sf_dir):
    return latency.probe_percentile(A.samples(spark, sf_dir), 0.95)


@query("SELECT event_type AS class, quantile_disc(value, 0.95) AS p95, sum(CASE WHEN event_type = 'error' AND event_id % 100 = 3 THEN 1 ELSE 0 END)::BIGINT AS n_censored, CASE WHEN sum(CASE WHEN event_type = 'error' AND event_id % 100 = 3 THEN 1 ELSE 0 END) > 0 THEN 'CENSORED' WHEN quantile_disc(value, 0.95) <= 60 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events GROUP BY 1")
def censored_verdict(spark, sf_dir):
    s = A.samples(spark, sf_dir).withColumn("censored", (F.col("class") == "error") & (F.pmod("id", F.lit(100)) == 3))
    return latency.verdict(s, 60.0)


_MARK = "m AS (SELECT conv_id AS gen, CASE WHEN role = 'user' THEN 'results' ELSE 'applied' END AS name, turn % 2 = 0 AS final, turn AS ts FROM conversations), r AS (SELECT gen, min(ts) AS results_ts FROM m WHERE name = 'results' AND final GROUP BY gen), a AS (SELECT r.*, (SELECT min(ts) FROM m WHERE m.gen = r.gen AND name = 'applied' AND ts > results_ts) AS applied_ts FROM r)"


@query(f"WITH {_MARK} SELECT a.*, (SELECT min(ts) FROM m WHERE m.gen = a.gen AND name = 'results' AND ts > applied_ts) AS present_ts FROM a")
def marker_asof(spark, sf_dir):
    return latency.correlate(A.markers(spark, sf_dir))


@query("SELECT event_id AS id, round(avg(value) OVER w, 6) AS ring_mean, max(value) OVER w AS ring_most, count(*) OVER w AS ring_n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def latency_ring(spark, sf_dir):
    return latency.running(A.samples(spark, sf_dir), "class", "id", "value").select("id", F.round("ring_mean", 6).alias("ring_mean"), "ring_most", "ring_n")


@query("WITH k AS (SELECT event_id // 10 AS gen, min(event_id) AS key_ts FROM events WHERE event_type = 'click' GROUP BY 1), a AS (SELECT event_id // 10 AS gen, min(event_id + CASE WHEN event_id % 17 = 0 THEN 40 ELSE 0 END) AS applied_ts FROM events WHERE event_type = 'view' GROUP BY 1), l AS (SELECT *, min(applied_ts) OVER (ORDER BY gen DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a) SELECT gen, applied_ts - key_ts AS latency FROM k JOIN l USING (gen) WHERE b IS NULL OR b > applied_ts")
def keydown_applied(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("gen", F.floor(F.col("event_id") / 10).cast("long"))
    late = F.when(F.pmod("event_id", F.lit(17)) == 0, 40).otherwise(0)
    return latency.one_shot(e.where("event_type = 'click'").select("gen", F.col("event_id").alias("ts")), e.where("event_type = 'view'").select("gen", (F.col("event_id") + late).alias("ts")))


@query("""WITH e AS (SELECT user_id AS source, event_id AS ts, CASE event_type WHEN 'signup' THEN 'hide' WHEN 'error' THEN 'show' ELSE 'tick' END AS event FROM events),
m AS (SELECT *, sum(CASE WHEN event = 'hide' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts) AS i, max(CASE WHEN event = 'tick' THEN ts END) OVER (PARTITION BY source ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
x AS (SELECT source, i, min(ts) FILTER (event = 'hide') AS hid, min(ts) FILTER (event = 'show') AS shown FROM m WHERE i > 0 GROUP BY 1, 2)
SELECT x.source, x.i::BIGINT AS "interval", shown - hid AS duration, count(*) FILTER (event = 'tick' AND ts < shown) AS ticks,
  max(CASE WHEN event = 'tick' AND ts < shown THEN ts - before WHEN ts = shown THEN ts - coalesce(before, hid) END) AS max_gap, min(ts) FILTER (event = 'tick' AND ts > shown) - shown AS first_delay
FROM x JOIN m ON m.source = x.source AND m.i = x.i WHERE shown IS NOT NULL GROUP BY x.source, x.i, shown, hid""")
def frame_gaps(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "hide").when(F.col("event_type") == "error", "show").otherwise("tick")
    return latency.frame_gaps(e.select(F.col("user_id").alias("source"), F.col("event_id").alias("ts"), kind.alias("event")))


# --- clipboard and logs


@query("SELECT md5(text) AS hash, max(conv_id * 100 + turn) AS ts, count(*) AS times FROM conversations WHERE trim(text) <> '' AND strlen(text) <= 1048576 GROUP BY 1")
def clips_dedup(spark, sf_dir):
    return clips.deduplicated(A.clips(spark, sf_dir)).select("hash", "ts", "times")


@query("WITH d AS (SELECT md5(text) AS hash, max(conv_id * 100 + turn) AS ts FROM conversations WHERE trim(text) <> '' GROUP BY 1) SELECT hash, ts FROM d WHERE ts >= (SELECT max(ts) FROM d) - 30 * 100 ORDER BY ts DESC, hash LIMIT 10000")
def clips_retention(spark, sf_dir):
    kept = clips.deduplicated(A.clips(spark, sf_dir))
    newest = kept.agg(F.max("ts")).first()[0] or 0
    return clips.retained(kept, newest, day=100).select("hash", "ts")


@query(f"WITH d AS (SELECT md5(text) AS hash, max(conv_id * 100 + turn) AS ts, min(text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1 ORDER BY ts DESC, hash LIMIT 1000), h AS (SELECT hash, ts, {S.shell('the', 'left(text, 200)')} AS score FROM d) SELECT hash, round(score, 6) AS score FROM h WHERE score IS NOT NULL ORDER BY h.score DESC, ts DESC, hash LIMIT 50")
def clips_search(spark, sf_dir):
    return clips.search(clips.deduplicated(A.clips(spark, sf_dir)), "The ").select("hash", r6())


@query("WITH d AS (SELECT md5(text) AS hash, max(conv_id * 100 + turn) AS ts FROM conversations WHERE trim(text) <> '' GROUP BY 1) SELECT hash FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE ts % 2 = 0)")
def clips_unseen(spark, sf_dir):
    kept = clips.deduplicated(A.clips(spark, sf_dir))
    return clips.unseen(kept, kept.where("ts % 2 = 0")).select("hash")


def _lines(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    rows = e.select(
        "ts", F.pmod("event_id", F.lit(3)).cast("int").alias("file_idx"), F.col("event_id").alias("line_no"), F.upper("event_type").alias("level"), F.lit("indexer").alias("process"),
        F.concat(F.lit("app_core::"), F.col("event_type")).alias("component"), F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" seq="), F.col("event_id").cast("string")).alias("message"),
    )
    return logs.to_lines(rows).withColumn("raw", F.when(F.pmod("line_no", F.lit(41)) == 0, F.left("raw", F.lit(20))).otherwise(F.col("raw")))


_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('microsecond', ts)::BIGINT % 1000000 // 1000)::VARCHAR, 3, '0') || 'Z'"


@query(f"SELECT event_id AS line_no, {_TS} AS ts, 'user=' || user_id || ' seq=' || event_id AS message FROM events WHERE event_id % 41 <> 0 AND event_type IN ('error', 'purchase') AND regexp_matches('user=' || user_id || ' seq=' || event_id, 'user=1[0-9]* ')")
def logs_timeline(spark, sf_dir):
    return logs.timeline(logs.parsed(_lines(spark, sf_dir)), ["ERROR", "PURCHASE"], "user=1[0-9]* ").select("line_no", "ts", "message")


@query(f"WITH t AS (SELECT event_id AS line_no, (event_id % 3)::INTEGER AS file_idx, {_TS} AS ts FROM events WHERE event_id % 41 <> 0) SELECT line_no, file_idx, ts FROM t ORDER BY ts DESC, file_idx DESC, line_no DESC LIMIT 25")
def logs_tail(spark, sf_dir):
    return logs.tail(logs.timeline(logs.parsed(_lines(spark, sf_dir))), 25).select("line_no", "file_idx", "ts")


@query("SELECT (event_id % 3)::INTEGER AS file_idx, count(*) AS n, count(*) FILTER (event_id % 41 = 0) AS n_bad FROM events GROUP BY 1")
def logs_bad_lines(spark, sf_dir):
    return logs.parsed(_lines(spark, sf_dir)).groupBy("file_idx").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_bad"))


@query("SELECT event_id AS line_no, user_id AS n_user, event_id AS n_seq FROM events WHERE event_id % 41 <> 0")
def marker_fields(spark, sf_dir):
    good = logs.timeline(logs.parsed(_lines(spark, sf_dir)))
    return good.select("line_no", scalar.marker_field(F.col("message"), "user").alias("n_user"), scalar.marker_field(F.col("message"), "seq").alias("n_seq"))


# --- scalars


@query("SELECT p_partkey, (p_size || ' * (' || p_partkey || ' + 2^3) + 7 mod 4') AS text, regexp_replace(format('{:,}', p_size * (p_partkey + 8) + 3), '^-?$', '') AS display, format('{:,}', p_size * (p_partkey + 8) + 3) AS copy FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_name || ' 2', NULL, NULL FROM part WHERE p_partkey % 5 = 0")
def calc_eval(spark, sf_dir):
    """Sums made from parts, and what is no sum."""
    part = A.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    text = F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.concat("p_name", F.lit(" 2"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" * ("), key, F.lit(" + 2^3) + 7 mod 4")))
    return part.select("p_partkey", text.alias("text")).withColumn("r", calculator(dt.date(2024, 1, 31))("text")).select("p_partkey", "text", "r.display", "r.copy")


@query("SELECT p_partkey, round(p_size * 1609.344 / 1000, 6) AS km, round((p_retailprice - 32) * 5 / 9, 6) AS celsius, round(p_size * 1073741824.0 / 1048576, 6) AS mib FROM part")
def unit_convert(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    c = lambda x, a, b: F.round(scalar.convert(F.col(x).cast("double"), a, b), 6)
    return p.select("p_partkey", c("p_size", "mi", "km").alias("km"), c("p_retailprice", "f", "c").alias("celsius"), c("p_size", "gib", "mib").alias("mib"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2024-01-31') AS days FROM orders")
def days_between(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"))


@query("WITH p AS (SELECT p_partkey, p_size * 40 AS x, floor(p_retailprice)::INTEGER AS w FROM part) SELECT p_partkey, (x + round(w / 3.0::DOUBLE))::INTEGER AS x, greatest(round(w / 3.0::DOUBLE), 1)::INTEGER AS w, (x + round(w * 0.25::DOUBLE))::INTEGER AS cx, round(w * 0.5::DOUBLE)::INTEGER AS cw, 135 AS cy, 810 AS ch FROM p")
def tile_rects(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    place = lambda preset: scalar.tile(F.col("p_size") * 40, F.lit(0), F.floor("p_retailprice"), F.lit(1080), preset)
    return p.select("p_partkey", place("center_third").alias("t"), place("center").alias("c")).select("p_partkey", "t.x", "t.w", F.col("c.x").alias("cx"), F.col("c.w").alias("cw"), F.col("c.y").alias("cy"), F.col("c.h").alias("ch"))


@query("""WITH p AS (SELECT p_partkey, p_size * 30 AS l, 40 * (p_size % 7) AS t, p_size * 30 + 600 AS r, 40 * (p_size % 7) + 500 AS b FROM part),
s AS (SELECT *, greatest(round(2560 * least(1, greatest(0, (r - l) / 1920.0::DOUBLE))), 1) AS w, greatest(round(1400 * least(1, greatest(0, (b - t) / 1040.0::DOUBLE))), 1) AS h FROM p)
SELECT p_partkey, least(1920 + round(2560 * least(1, greatest(0, l / 1920.0::DOUBLE))), 4480 - w)::INTEGER AS x, least(round(1400 * least(1, greatest(0, t / 1040.0::DOUBLE))), 1400 - h)::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h FROM s""")
def remapped_rects(spark, sf_dir):
    """Windows carried from a display of 1920 by 1040 to one of 2560 by 1400 beside it."""
    p = A.table(spark, sf_dir, "part")
    left, top = F.col("p_size") * 30, 40 * F.pmod("p_size", F.lit(7))
    lit = lambda *x: [F.lit(v) for v in x]
    r = scalar.remap([left, top, left + 600, top + 500], lit(0, 0, 1920, 1040), lit(1920, 0, 4480, 1400))
    return p.select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query("WITH p AS (SELECT p_partkey, p_size * 40 AS right_, [96, 120, 144, 0][(p_partkey % 4 + 1)::INTEGER] AS dpi FROM part), q AS (SELECT *, least(680 * CASE dpi WHEN 0 THEN 96 ELSE dpi END // 96, right_ * 9 // 10) AS w, least(480 * CASE dpi WHEN 0 THEN 96 ELSE dpi END // 96, 600 - 120) AS h FROM p) SELECT p_partkey, ((right_ - w) // 2)::INTEGER AS x, 120 AS y, w::INTEGER AS w, h::INTEGER AS h FROM q")
def window_placement(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    dpi = F.element_at(F.array(*(F.lit(x) for x in (96, 120, 144, 0))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return p.select("p_partkey", scalar.placement(F.lit(0), F.lit(0), F.col("p_size") * 40, F.lit(600), dpi).alias("r")).select("p_partkey", "r.*")


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_extract(replace(url, '/', '\\'), '(?s)^(.*)\\\\[^\\\\]*$', 1) ELSE '' END AS parent FROM pages")
def parent_paths(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", scalar.parent_of(F.replace(F.col("url"), F.lit("/"), F.lit("\\"))).alias("parent"))


@query("""WITH RECURSIVE t AS (SELECT item_id, encode(text) AS b FROM benchmark UNION ALL SELECT -1, ''::BLOB UNION ALL SELECT -2, 'a'::BLOB UNION ALL SELECT -3, 'foobar'::BLOB),
h AS (SELECT item_id, b, 0 AS k, 14695981039346656037::HUGEINT AS h FROM t UNION ALL SELECT item_id, b, k + 1, (xor(h, ('0x' || substr(hex(b), 2 * k + 1, 2))::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM h WHERE k < octet_length(b))
SELECT item_id, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS hash FROM h WHERE k = octet_length(b)""")
def content_hash(spark, sf_dir):
    """Hashes of whole benchmark items and of three known inputs."""
    known = spark.createDataFrame([(-1, ""), (-2, "a"), (-3, "foobar")], "item_id long, text string")
    rows = A.table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(known)
    return rows.select("item_id", scalar.fnv1a_column("text").alias("hash"))


@query("""WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS c, p_size % 3 = 0 AS a, p_size % 5 = 0 AS s, p_size % 7 = 0 AS w, ['KeyA', 'F12', '', 'Space', 'AltLeft'][(p_partkey % 5 + 1)::INTEGER] AS code FROM part)
SELECT p_partkey, concat_ws('+', CASE WHEN c THEN 'Control' END, CASE WHEN a THEN 'Alt' END, CASE WHEN s THEN 'Shift' END, CASE WHEN w THEN 'Super' END, code) AS keys, code <> '' AND code <> 'F12' AND code <> 'AltLeft' AND (c OR a OR s OR w) AS usable, w AS warned,
  CASE WHEN code = 'Space' AND NOT c AND NOT s THEN CASE WHEN a AND w THEN 'PowerToys Command Palette' WHEN a THEN 'PowerToys Run, or Copilot on some Windows 11 builds' WHEN w THEN 'the Windows input-language switcher' END END AS owner FROM p""")
def hotkey_rules(spark, sf_dir):
    on = lambda n: F.pmod("p_size", F.lit(n)) == 0
    code = F.element_at(F.array(*(F.lit(x) for x in ("KeyA", "F12", "", "Space", "AltLeft"))), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    chord = (on(2), on(3), on(5), on(7), code)
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", scalar.accelerator(*chord).alias("keys"), scalar.hotkey_problem(*chord).isNull().alias("usable"), scalar.hotkey_warning(on(7)).isNotNull().alias("warned"), scalar.hotkey_owner(*chord).alias("owner")
    )


# --- contents


_TERMS = ["the", "and", "that", "with"]
_POST = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS words FROM documents), p AS (SELECT doc_id, len(words) AS size, unnest(list_filter(words, lambda x: list_contains(['the','and','that','with'], x))) AS term FROM w), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(words)) AS m FROM w)"


@query(f"WITH {_POST} SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id")
def content_bm25(spark, sf_dir):
    return content.bm25(A.table(spark, sf_dir, "documents"), _TERMS).select("doc_id", r6())


@query("SELECT doc_id, substr(text, greatest(instr(text, 'the') - 30, 1), 90) AS snippet FROM documents WHERE contains(text, 'the')")
def content_snippet(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", content.snippet(F.col("text"), "the").alias("snippet")).where("snippet is not null")


@query("SELECT page_id FROM pages WHERE page_id % 5 <> 1 AND NOT list_has_any(string_split(lower(url), '/'), ['appdata', 'node_modules', '.git', 'target', 'build', 'dist', 'venv', '.venv', '__pycache__'])")
def content_scope_filter(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    path = F.when(F.pmod("page_id", F.lit(5)) == 1, F.concat(F.lit("src/node_modules/"), F.col("url"))).otherwise(F.col("url"))
    return p.where(content.in_scope(path)).select("page_id")


@query("WITH r AS (SELECT doc_id, doc_id // 3 AS mtime, strlen(text) AS size FROM documents), s AS (SELECT *, sum(size) OVER (ORDER BY mtime DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM r) SELECT doc_id, running::BIGINT AS running FROM s WHERE running <= 500000")
def size_cap_evict(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("size"))
    return content.within_size(d, 500_000, "size", "mtime", "doc_id").select("doc_id", "running")


@query("SELECT event_type AS process, round(1 - count(*) FILTER (value > 50)::DOUBLE / count(*), 6) AS crash_free FROM events GROUP BY 1")
def crash_free_sessions(spark, sf_dir):
    return minor.crash_free(A.samples(spark, sf_dir).select(F.col("class").alias("process"), (F.col("value") > 50).alias("crashed")), "process").withColumn("crash_free", F.round("crash_free", 6))


@query("SELECT user_id AS volume, CASE WHEN max(value) > 100 THEN 'paused' WHEN count(*) FILTER (event_type = 'error') > 20 THEN 'rebuilding' ELSE 'ready' END AS status FROM events GROUP BY 1")
def volume_status(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("volume")).agg((F.max("value") > 100).alias("paused"), (F.count(F.when(F.col("event_type") == "error", 1)) > 20).alias("rebuilding"))
    return minor.volume_status(e).select("volume", "status")


@query("WITH r AS (SELECT page_id, row_number() OVER (ORDER BY page_id DESC) AS p FROM pages) SELECT page_id FROM r WHERE p > 10")
def rotation(spark, sf_dir):
    """All but the newest ten go."""
    return minor.rotated(A.table(spark, sf_dir, "pages").select("page_id"), "page_id", 10)


@query("SELECT item_id, 'https://example.org/?q=' || replace(url_encode(regexp_extract(text, '^[A-Za-z ]*', 0)), '+', '%20') AS url FROM benchmark")
def quicklinks(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark")
    return b.select("item_id", scalar.url_for(F.lit("https://example.org/?q={query}"), F.regexp_extract("text", "^[A-Za-z ]*", 0)).alias("url"))


# --- sources


@query("SELECT event_id AS usn, CASE event_type WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'R' WHEN 'view' THEN 'S' ELSE 'C' END AS op, user_id + 16 AS frn, 'n' || event_id AS name, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS flags FROM events")
def journal_records(spark, sf_dir):
    """Events written as binary journal records and parsed again."""
    from rankfield.sources.journal import RECORD, _parse, journal_changes, record

    def pack(frames):
        for f in frames:
            content = [record(*map(int, r[:5]), r[5]) for r in f.itertuples(index=False)]
            yield pd.DataFrame({"content": [b"".join(content)]})

    kind = F.col("event_type")
    reason = F.when(kind == "error", 0x200 | 0x100).when(kind == "purchase", 0x2000).when(kind == "view", 0x800).otherwise(0x100 | 0x2000)
    bit = lambda n, a: F.when(F.pmod("event_id", F.lit(n)) == 0, a).otherwise(0)
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("user_id") + 16, F.lit(5).cast("long"), reason, bit(2, 0x10) + bit(3, 0x2), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"))
    raw = e.mapInPandas(pack, "content binary").mapInPandas(_parse, RECORD)
    return journal_changes(raw).select("usn", "op", "frn", "name", "flags")


@query("SELECT r_name AS name, 1 AS flags FROM region UNION ALL SELECT n_name || '.txt', 0 FROM nation")
def directory_walk(spark, sf_dir):
    """A folder a region with a file a nation, made by the driver and listed again."""
    import os
    import tempfile

    from rankfield.sources.journal import walk

    region, nation = A.table(spark, sf_dir, "region"), A.table(spark, sf_dir, "nation")
    pairs = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()  # the two fixed tables
    with tempfile.TemporaryDirectory() as root:
        for r in region.collect():
            os.mkdir(os.path.join(root, r["r_name"]))
        for r in pairs:
            open(os.path.join(root, r["r_name"], r["n_name"] + ".txt"), "w").close()
        return walk(spark, root).select("name", "flags")


# --- around the list


@query("WITH d AS (SELECT s_nationkey AS grp, s_suppkey AS id, round(s_acctbal / 100) AS x, s_suppkey % 3 AS y FROM supplier) SELECT grp, id, coalesce(lead(id) OVER w, first(id) OVER w) AS next_id FROM d WINDOW w AS (PARTITION BY grp ORDER BY x, y, id)")
def next_display(spark, sf_dir):
    d = A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("id"), F.round(F.col("s_acctbal") / 100).alias("x"), F.pmod("s_suppkey", F.lit(3)).alias("y"))
    return minor.next_display(d, "grp").select("grp", "id", "next_id")


@query("WITH s AS (SELECT event_id % 20 AS volume, user_id AS session, CASE WHEN event_type IN ('click', 'view') THEN 'active' ELSE 'idle' END AS state, event_id AS ts FROM events), l AS (SELECT volume, session, max_by(state, ts) AS state FROM s GROUP BY 1, 2) SELECT volume, count(*) FILTER (state = 'active') = 0 AS idle FROM l GROUP BY 1")
def idle_vote(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return minor.idle(e.select(F.pmod("event_id", F.lit(20)).alias("volume"), F.col("user_id").alias("session"), F.when(F.col("event_type").isin("click", "view"), "active").otherwise("idle").alias("state"), F.col("event_id").alias("ts")), "volume")


@query("""WITH q AS (SELECT n_nationkey AS grp, CASE WHEN n_nationkey % 6 = 0 THEN '  ' ELSE n_name END AS text FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region),
r AS (SELECT c_nationkey AS grp, c_custkey AS pos, ['app', 'file', 'command', 'setting', 'window', 'calc'][(c_custkey % 6 + 1)::INTEGER] AS kind, c_name AS name, c_mktsegment AS subtitle FROM customer),
g AS (SELECT grp, count(*) AS n, arg_min(CASE kind WHEN 'calc' THEN 'Calculator result ' || name WHEN 'app' THEN name || ', application' WHEN 'setting' THEN name || ', ' || subtitle WHEN 'command' THEN name || ', command' WHEN 'window' THEN name || ', open window' ELSE name || ', file at ' || subtitle END, pos) AS top FROM r GROUP BY grp)
SELECT q.grp, CASE WHEN trim(text) = '' THEN '' WHEN n IS NULL THEN 'No results' WHEN n = 1 THEN '1 result. ' || top ELSE n || ' results. ' || top END AS said FROM q LEFT JOIN g USING (grp)""")
def announce_text(spark, sf_dir):
    nation = A.table(spark, sf_dir, "nation")
    queries = nation.select(F.col("n_nationkey").alias("grp"), F.when(F.pmod("n_nationkey", F.lit(6)) == 0, "  ").otherwise(F.col("n_name")).alias("text"))
    queries = queries.unionByName(A.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("grp"), F.col("r_name").alias("text")))  # nothing is found for these
    kind = F.element_at(F.array(*(F.lit(k) for k in ("app", "file", "command", "setting", "window", "calc"))), (F.pmod("c_custkey", F.lit(6)) + 1).cast("int"))
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("pos"), kind.alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("subtitle"))
    return minor.announcement(queries, rows, "grp")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed b')")
def action_filter(spark, sf_dir):
    return A.table(spark, sf_dir, "part").where(minor.action_matches(F.col("p_name"), "  ED B ")).select("p_partkey", "p_name")


@query("WITH e AS (SELECT event_id AS key, user_id, ts, CASE event_id % 4 WHEN 0 THEN 3076 WHEN 1 THEN 3077 ELSE 1 END AS event_id, event_type = 'error' AS here FROM events), n AS (SELECT * FROM e WHERE event_id IN (3076, 3077) ORDER BY ts DESC, key LIMIT 5000) SELECT user_id, count(*) FILTER (event_id = 3076) AS audited, count(*) FILTER (event_id = 3077) AS blocked, count(*) FILTER (here) AS here FROM n GROUP BY 1")
def policy_events(spark, sf_dir):
    kind = F.when(F.pmod("event_id", F.lit(4)) == 0, 3076).when(F.pmod("event_id", F.lit(4)) == 1, 3077).otherwise(1)
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "user_id", "ts", kind.alias("event_id"), (F.col("event_type") == "error").alias("here"))
    return minor.policy_summary(e, "user_id")


_CODES = ("KeyQ", "Digit7", "ArrowLeft", "F5", "F25", "Numpad3", "NumpadEnter", "CapsLock", "Backquote", "keyq")


@query(f"""WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS c, p_size % 3 = 0 AS a, {list(_CODES)}[(p_partkey % 10 + 1)::INTEGER] AS code FROM part), t AS (SELECT *, ['q', '7', 'left', 'f5', NULL, 'numpad3', 'enter', NULL, 'grave', NULL][(p_partkey % 10 + 1)::INTEGER] AS token FROM p)
SELECT p_partkey, token, CASE WHEN token IS NOT NULL THEN concat_ws('+', CASE WHEN c THEN 'ctrl' END, CASE WHEN a THEN 'alt' END, token) END AS chord FROM t""")
def key_tokens(spark, sf_dir):
    code = F.element_at(F.array(*(F.lit(x) for x in _CODES)), (F.pmod("p_partkey", F.lit(10)) + 1).cast("int"))
    on = lambda n: F.pmod("p_size", F.lit(n)) == 0
    return A.table(spark, sf_dir, "part").select("p_partkey", minor.key_token(code).alias("token"), minor.key_chord(on(2), on(3), F.lit(False), F.lit(False), code).alias("chord"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'hand_over' WHEN p_size % 3 = 0 THEN 'take_back' WHEN p_size % 2 <> p_size % 5 THEN 'replace' WHEN p_partkey % 2 = 0 THEN 'retry' ELSE 'nothing' END AS action FROM part")
def registrar_table(spark, sf_dir):
    source = lambda n: F.when(F.pmod("p_size", F.lit(n)) == 0, "other").otherwise("own")
    key = lambda n: F.pmod("p_size", F.lit(n)).cast("string")
    return A.table(spark, sf_dir, "part").select("p_partkey", minor.registrar_action(source(3), source(4), key(2), key(5), F.pmod("p_partkey", F.lit(2)) == 0).alias("action"))


@query("SELECT p_partkey, CASE kind WHEN 'file' THEN 6 WHEN 'window' THEN 21 WHEN 'app' THEN CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END ELSE 1 END AS n, CASE kind WHEN 'calc' THEN 'copy' ELSE 'open' END AS main, CASE kind WHEN 'file' THEN 'delete' WHEN 'window' THEN 'close' WHEN 'calc' THEN 'copy' WHEN 'app' THEN CASE WHEN p_size % 2 = 0 THEN 'runas' ELSE 'open' END ELSE 'open' END AS last FROM (SELECT p_partkey, p_size, ['app','file','window','calc','setting'][(p_partkey % 5 + 1)::INTEGER] AS kind FROM part)")
def available_actions(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("app", "file", "window", "calc", "setting"))), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    actions = catalogs.available_actions(kind, F.pmod("p_size", F.lit(2)) == 0)
    return A.table(spark, sf_dir, "part").select("p_partkey", F.size(actions).alias("n"), F.get(actions, F.lit(0)).alias("main"), F.element_at(actions, -1).alias("last"))


@query(f"SELECT user_id AS id, max(epoch(date_trunc('second', ts))::BIGINT) AS ts FROM events GROUP BY 1 HAVING max(epoch(date_trunc('second', ts))::BIGINT) > {NOW} - 86400")
def fresh_rows(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("ts"))
    return catalogs.fresh(e, NOW, 86400)


@query(f"WITH {_REQ} SELECT * FROM wm")
def stream_latest_gen(spark, sf_dir):
    """The generations' watermark as a stream over files of requests."""
    out = _Published(spark)
    requests = _stream_of(spark, sf_dir, 2).select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 50).cast("long").alias("gen"), F.when(F.col("event_type") == "error", "cancel").otherwise("query").alias("kind"))
    sessions.latest_stream(requests).writeStream.outputMode("update").foreachBatch(out).option("checkpointLocation", out.checkpoint).trigger(availableNow=True).start().awaitTermination()
    return usage.newest_states(out.states(), "session")


# --- the live catalog


def _buffers(spark, sf_dir: str) -> str:
    """The tree's entries as an enumeration's buffers, with some of the volume's own files among them."""

    def pack(frames):
        for f in frames:
            content = [journal.record(0, int(r[0]), int(r[1]), 0, int(r[3]), r[2]) for r in f.itertuples(index=False)]
            yield pd.DataFrame({"content": [b"\0" * journal.BUFFER_HEADER + b"".join(content)]})

    flags = F.col("flags")
    bits = F.when(flags.bitwiseAND(1) != 0, 0x10).otherwise(0) + F.when(flags.bitwiseAND(2) != 0, 0x2).otherwise(0) + F.when(flags.bitwiseAND(4) != 0, 0x4).otherwise(0)
    own = spark.createDataFrame([(k, 5, f"$own{k}", 0) for k in range(16)], "frn long, parent_frn long, name string, flags int")
    return A.tree_rows(spark, sf_dir).unionByName(own).select("frn", "parent_frn", "name", bits).mapInPandas(pack, "content binary")


@query(f"WITH RECURSIVE {S.TREE} SELECT frn, parent_frn, name, flags FROM tree")
def volume_enumeration(spark, sf_dir):
    """A volume's entries from the buffers that it is enumerated in; its own files are left out."""
    raw = _buffers(spark, sf_dir).mapInPandas(journal._parse_buffers, journal.RECORD)
    return raw.where(changes.ordinary(F.col("frn"))).select("frn", "parent_frn", "name", changes.flags_of(F.col("attributes")).alias("flags"))


_MOVES = "mv AS (SELECT n_nationkey + 2000 AS frn, (n_nationkey + 1) % 5 + 1000 AS parent_frn, n_name || '_moved' AS name FROM nation WHERE n_nationkey % 3 = 0), gone AS (SELECT c_custkey + 1000000 AS frn FROM customer WHERE c_custkey % 50 = 0), tree AS (SELECT t.frn, coalesce(mv.parent_frn, t.parent_frn) AS parent_frn, coalesce(mv.name, t.name) AS name, t.flags FROM tree0 t LEFT JOIN mv USING (frn) WHERE t.frn NOT IN (SELECT frn FROM gone))"
_MOVED_TREE = S.TREE.replace("tree AS (", "tree0 AS (", 1).replace("walk(frn, depth, path, parent_path) AS (", _MOVES + ",\nwalk(frn, depth, path, parent_path) AS (", 1)


def _moves(spark, sf_dir) -> DataFrame:
    nation, customer = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "customer")
    renamed = nation.where("n_nationkey % 3 = 0").select(
        F.col("n_nationkey").cast("long").alias("usn"), F.lit("R").alias("op"), (F.col("n_nationkey") + 2000).cast("long").alias("frn"), (F.pmod(F.col("n_nationkey") + 1, F.lit(5)) + 1000).cast("long").alias("parent_frn"),
        F.concat("n_name", F.lit("_moved")).alias("name"), F.lit(1).alias("flags"),
    )
    deleted = customer.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000).alias("usn"), F.lit("D").alias("op"), (F.col("c_custkey") + 1_000_000).alias("frn"), F.lit(0).cast("long").alias("parent_frn"), F.lit("").alias("name"), F.lit(0).alias("flags"))
    return renamed.unionByName(deleted)


@query(f"WITH RECURSIVE {_MOVED_TREE} SELECT frn, depth, path FROM walk")
def live_changes(spark, sf_dir):
    """A snapshot after folders moved and others went, with depths and paths repaired."""
    state = live.Live(spark, enumerate=lambda: (A.tree_rows(spark, sf_dir), journal.Cursor(1, 0)))
    state.rebuild("first")
    log = _moves(spark, sf_dir)
    state.moved.append(live.moved_folders(state.entries, log))
    state.entries = materialized(live.changed_entries(state.entries, log), "entries")
    state.repair()
    return state.entries.select("frn", "depth", "path")


@query(f"WITH RECURSIVE {S.TREE}, added AS (SELECT 9000000000 + o_orderkey AS frn, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2000 ELSE 1000000 + o_custkey END AS parent_frn FROM orders) SELECT a.frn, coalesce(w.depth + 1, 0)::INTEGER AS depth FROM added a LEFT JOIN walk w ON w.frn = a.parent_frn")
def depths_of_new(spark, sf_dir):
    """Depths of new entries from their parents' in the snapshot."""
    o = A.table(spark, sf_dir, "orders")
    parent = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, 1).when(F.pmod("o_orderkey", F.lit(3)) == 1, 2000).otherwise(F.col("o_custkey") + 1_000_000)
    added = o.select((F.col("o_orderkey") + 9_000_000_000).alias("frn"), parent.cast("long").alias("parent_frn"))
    return tree.depths_of_new(tree_entries(spark, sf_dir), added)


# --- pages of several sources


@query(f"WITH RECURSIVE {S.TREE}, hit AS (SELECT t.frn, t.parent_frn, {S.tiers('low')} * {S.factor()} AS score FROM tree t JOIN walk USING (frn)), page AS (SELECT * FROM hit WHERE score IS NOT NULL ORDER BY score DESC, frn LIMIT 100) SELECT frn, round(score, 6) AS score FROM page WHERE parent_frn % 3 = 0")
def security_trim(spark, sf_dir):
    """A page without rows of folders that are not granted to the user."""
    entries = tree_entries(spark, sf_dir)
    grants = entries.select(F.col("frn").alias("dir"), F.when(F.pmod("frn", F.lit(3)) == 0, "S-1").otherwise("S-2").alias("sid"))
    page = rank.search(entries, "low", 100)
    return security.trimmed(page, grants, "S-1").select("frn", r6())


@query(f"WITH RECURSIVE {S.TREE}, tops AS (SELECT path FROM walk WHERE frn IN (1001, 2003)) SELECT frn AS dir FROM walk w WHERE frn < 1000000000 AND NOT EXISTS (SELECT 1 FROM tops t WHERE w.path = t.path OR starts_with(w.path, t.path || '\\'))")
def security_changes(spark, sf_dir):
    """Grants that stand after the rights of two folders changed."""
    folders = tree_entries(spark, sf_dir).where("frn < 1000000000")
    changed = spark.createDataFrame([(1001,), (2003,)], "frn long")
    return security.still_granted(folders.select(F.col("frn").alias("dir"), F.lit("S-1").alias("sid")), folders, changed).select("dir")


@query("WITH v AS (SELECT n_nationkey AS volume_idx, n_regionkey < 3 AND n_nationkey % 2 = 0 AS fixed, n_nationkey % 5 <> 0 AS online, n_nationkey % 3 = 0 AS busy FROM nation), a AS (SELECT r_regionkey * 7 AS volume_idx FROM region), e AS (SELECT a.volume_idx, CASE WHEN online IS NULL OR NOT online THEN 101 WHEN NOT fixed THEN 107 WHEN busy THEN 102 END AS code FROM a LEFT JOIN v USING (volume_idx)) SELECT e.volume_idx, code, code <> 107 AS retry, count(c_custkey) AS n FROM e LEFT JOIN customer ON c_nationkey = e.volume_idx AND (code IS NULL OR code = 102) GROUP BY ALL")
def volume_scopes(spark, sf_dir):
    """What each asked volume answers, and how many entries of it."""
    n = A.table(spark, sf_dir, "nation")
    k = lambda m: F.pmod("n_nationkey", F.lit(m))
    volumes = n.select(F.col("n_nationkey").alias("volume_idx"), ((F.col("n_regionkey") < 3) & (k(2) == 0)).alias("is_fixed_ntfs"), (k(5) != 0).alias("online"), (k(3) == 0).alias("rebuilding"))
    asked = A.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).alias("volume_idx"))
    errors = scopes.scope_errors(asked, volumes)
    entries = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("volume_idx"), "c_custkey")
    found = scopes.in_scopes(entries, errors).groupBy("volume_idx").agg(F.count("*").alias("n"))
    return errors.join(found, "volume_idx", "left").select("volume_idx", "code", "retry", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_USAGE}, f AS (SELECT page_id, (page_id % 3)::INTEGER AS volume_idx, page_id % 150 AS frn, CASE WHEN page_id % 4 = 0 THEN 'C:\\Windows\\WinSxS\\' ELSE 'C:\\' END || url AS path, (page_id % 9) / 10.0::DOUBLE AS score FROM pages), u AS (SELECT (id::BIGINT % 3) || ':' || id AS key, bonus FROM bonus), b AS (SELECT page_id, score + coalesce(bonus, 0) AS score, path FROM f LEFT JOIN u ON key = volume_idx || ':' || frn) SELECT page_id, round(score, 6) AS score, round(score * CASE WHEN contains(path, 'WinSxS') THEN 0.6::DOUBLE ELSE 1 END, 6) AS display FROM b")
def file_batch(spark, sf_dir):
    """A page of files with usage added first, and the path's weight for the list."""
    pages = A.table(spark, sf_dir, "pages")
    path = F.concat(F.when(F.pmod("page_id", F.lit(4)) == 0, "C:\\Windows\\WinSxS\\").otherwise("C:\\"), F.col("url"))
    rows = pages.select("page_id", F.pmod("page_id", F.lit(3)).cast("int").alias("volume_idx"), F.pmod("page_id", F.lit(150)).alias("frn"), path.alias("path"), (F.pmod("page_id", F.lit(9)) / 10.0).alias("score"), F.col("page_id").alias("pos"))
    used = rank.usage(A.launches(spark, sf_dir)).withColumn("id", F.concat_ws(":", F.pmod(F.col("id").cast("long"), F.lit(3)).cast("string"), "id"))
    return rank.file_batch(rows, used, NOW).select("page_id", r6(), r6("display"))


@query(f"WITH {_ROWS}, c AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, key) AS p FROM rows_) SELECT key, name FROM c WHERE p = 1 AND kind = 'file' ORDER BY {_ORDER} LIMIT 5")
def inline_files(spark, sf_dir):
    """Files of the root list: the first five after names are collapsed."""
    return merge.inline_files(merge.collapse_names(_sources(spark, sf_dir), "key"), merge.list_order()).select("key", "name")


@query("WITH a AS (SELECT p_partkey, ['app','command','setting','window','file','calc'][(p_partkey % 6 + 1)::INTEGER] AS kind, ['open','runas','switch','reveal','copy','left_half'][(p_size % 6 + 1)::INTEGER] AS action FROM part) SELECT kind, count(*) AS n FROM a WHERE (action = 'open' AND kind <> 'calc') OR (action = 'runas' AND kind = 'app') OR (action = 'switch' AND kind = 'window') GROUP BY kind")
def launch_actions(spark, sf_dir):
    """Actions that count as a launch."""
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(n, F.lit(6)) + 1).cast("int"))
    kind, action = pick(("app", "command", "setting", "window", "file", "calc"), "p_partkey"), pick(("open", "runas", "switch", "reveal", "copy", "left_half"), "p_size")
    return A.table(spark, sf_dir, "part").select(kind.alias("kind"), action.alias("action")).where(rank.counts_as_launch(F.col("kind"), F.col("action"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size * 3 + 1 AS answer FROM part")
def calculator_rows(spark, sf_dir):
    """The calculator's answers as rows that stand above all others."""
    sums = A.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("*3 + 1")).alias("text"))
    rows = sums.withColumn("r", calculator(dt.date(2024, 1, 31))("text")).select("p_partkey", rank.calculator_row(F.col("r.display"), F.col("r.copy")).alias("row"))
    return rows.where(F.col("row.score") == rank.CALCULATOR_SCORE).select("p_partkey", F.col("row.name").cast("long").alias("answer"))


@query("WITH s AS (SELECT event_id // 1000 AS scan, max(epoch(date_trunc('second', ts))::BIGINT) AS ts, count(*) FILTER (event_type = 'error') % 3 <> 0 AS ok FROM events GROUP BY 1), best AS (SELECT scan, ts FROM s WHERE ok ORDER BY ts DESC LIMIT 1) SELECT p_partkey AS id, b.scan, " f"({NOW} - b.ts > 300) AS is_stale, ({NOW} - b.ts >= 1800) AS due FROM part JOIN best b ON p_partkey % 10 = b.scan % 10")
def app_catalog(spark, sf_dir):
    """Apps of the last scan that succeeded, and whether it is time for the next."""
    e = A.table(spark, sf_dir, "events")
    scans = e.groupBy(F.floor(F.col("event_id") / 1000).alias("scan")).agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("ts"), (F.pmod(F.count(F.when(F.col("event_type") == "error", 1)), F.lit(3)) != 0).alias("ok"))
    apps = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.pmod("p_partkey", F.lit(10)).alias("_m"))
    rows = scans.join(apps, F.pmod("scan", F.lit(10)) == F.col("_m"), "left").drop("_m")
    return catalogs.last_good(rows, NOW).select("id", "scan", "is_stale", "due")


@query(f"WITH {_SETTINGS}, f AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'uri:' ELSE 'panel:' END || id AS target FROM s) SELECT id::VARCHAR AS id, name, target FROM f WHERE min_build <= 25 AND (requires IS NULL OR requires = 'pen')")
def settings_file(spark, sf_dir):
    """A catalog of settings read from its JSON files, gates applied."""
    rows = _settings(spark, sf_dir).withColumn("id", F.col("id").cast("long"))
    gate = F.struct("min_build", "requires")
    target = lambda word: F.concat(F.lit(word), F.col("id").cast("string"))
    own = rows.select(F.coalesce(F.pmod("id", F.lit(2)) == 0, F.lit(False)).alias("own"), F.col("id").cast("string").alias("id"), "name", target("uri:").alias("uri"), target("panel:").alias("canonical"), "synonyms", gate.alias("gate"))
    path = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    catalogs.write_settings(own.where("own"), own.where("not own"), path)
    none = spark.createDataFrame([], "id string, name string, target string, synonyms array<string>, min_build int, requires string")
    return catalogs.read_settings(spark, path, none, 25, ["pen"]).select("id", "name", "target")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'bo') ORDER BY length(p_name), p_name, p_partkey LIMIT 20")
def provider_search(spark, sf_dir):
    """Another source's rows, asked with its own cap; a source that cannot be asked says so."""
    files = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).orderBy("id")
    asked = providers.ask_all(spark, {"files": _Ordered(files), "none": providers.LikeProvider(None)}, "BO Red", {"files": 20, "none": 5}, 600)
    assert asked["none"].status == "unavailable" and asked["files"].status == "ok"
    return spark.createDataFrame([(r["id"], r["name"]) for r in asked["files"].rows], "id long, name string")


class _Ordered(providers.LikeProvider):
    """Ties by id, so that a page is the same each time."""

    def search(self, q: str, most: int) -> DataFrame:
        return super().search(q, 1 << 30).orderBy(F.length("name"), "name", "id").limit(most)


@query(f"WITH {_POST} SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id")
def content_index(spark, sf_dir):
    """The same scores from an index on disk, of which only the folders of the asked terms are read; the terms from a query."""
    docs = A.table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/contents-{uuid.uuid4().hex}"
    content.build_index(docs, at)
    name, asked = content.parse_content("report " + " ".join(f"content:{t}" for t in _TERMS))
    assert name == "report"
    return content.search_index(spark, at, asked).select("doc_id", r6())


@query("SELECT DISTINCT 'logs/' || (event_id % 20) AS folder, 'app-' || (event_id % 60) || '.log' AS file FROM events")
def log_files(spark, sf_dir):
    """Each log file once, however many lines name it."""
    e = A.table(spark, sf_dir, "events")
    named = e.select(F.concat(F.lit("logs/"), F.pmod("event_id", F.lit(20)).cast("string")).alias("folder"), F.concat(F.lit("app-"), F.pmod("event_id", F.lit(60)).cast("string"), F.lit(".log")).alias("file"))
    return logs.files(named)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE left(lower(p_name), 3) = 'red'")
def named_entries(spark, sf_dir):
    """A catalog of plain entries: names that begin with what was typed."""
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return catalogs.named_entries(rows, " Red").where(F.col("score") >= match.PREFIX).select("id", "name")


# --- small columns


_PATHS = "p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'c:' WHEN 1 THEN 'D' WHEN 2 THEN 'e:\\' WHEN 3 THEN 'C:/' || url || '/' ELSE url END AS path FROM pages)"


@query(f"WITH {_PATHS} SELECT page_id, rtrim(replace(path, '/', '\\'), '\\') AS root, CASE page_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' END AS drive FROM p")
def root_paths(spark, sf_dir):
    k = F.pmod("page_id", F.lit(5))
    path = F.when(k == 0, "c:").when(k == 1, "D").when(k == 2, "e:\\").when(k == 3, F.concat(F.lit("C:/"), F.col("url"), F.lit("/"))).otherwise(F.col("url"))
    p = A.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", scalar.normalized_root(F.col("path")).alias("root"), scalar.drive_of(F.col("path")).alias("drive"))


@query("SELECT event_type AS component, count(*) AS n FROM events GROUP BY 1")
def log_components(spark, sf_dir):
    """Components as they are shown, without the program's own prefix."""
    shown = logs.shown_component(F.concat(F.lit("app_core::"), F.col("event_type")), "app")
    return A.table(spark, sf_dir, "events").groupBy(shown.alias("component")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE n_chars * 20000 <= 52428800")
def content_caps(spark, sf_dir):
    """Files that are read at all."""
    return content.readable(A.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 20000).alias("size"))).select("doc_id")


@query("WITH n AS (SELECT doc_id, text, least(length(text), 100) AS most FROM documents), c AS (SELECT doc_id, text, max(k) AS k FROM (SELECT doc_id, text, unnest(range(0, most + 1)) AS k FROM n) WHERE strlen(left(text, k)) <= 100 GROUP BY 1, 2) SELECT doc_id, left(text, k) AS name, length(left(text, k)) + length(regexp_replace(left(text, k), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM c")
def names_cut(spark, sf_dir):
    """Texts cut to a hundred bytes on a character's boundary, and how many UTF-16 units that is."""
    cut = A.table(spark, sf_dir, "documents").select("doc_id", cut_to_bytes(F.col("text"), 100).alias("name"))
    return cut.select("doc_id", "name", utf16_length("name").cast("long").alias("units"))


_TYPED = (
    ("report kind:document path:projects ext:.PDF,md", "report", "pdf,md", "projects", False), ("notes 12:30", "notes 12:30", "", "", False), ("x kind:image ext:png,rs", "x", "png", "", False), ("x kind:im ext:rs", "x", "rs", "", False),
    ("report path:", "report", "", "", False), ("c:\\users report", "c:\\users report", "", "", False), ("a path:x path:y path:", "a", "", "y", False), ("x kind:audio ext:m", "x", "mp3,flac,wav,m4a,aac,ogg,opus,wma", "", False),
    ("x kind:folder", "", "", "", True), ("x kind:banana kind:image", "", "", "", True), ("kind:image", "", "", "", True), ("ext:", "", "", "", True), ("x kind:image ext:rs", "", "", "", True), ("", "", "", "", False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({S.quoted(t)}, {S.quoted(n)}, {S.quoted(e)}, {S.quoted(p)}, {str(r).lower()})" for t, n, e, p, r in _TYPED) + ") v(typed, name, exts, path, refused)")
def file_queries(spark, sf_dir):
    """What is typed into the file search, word by word and filter by filter."""
    rows = []
    for typed, *_ in _TYPED:
        q = filters.parse_file_query(typed)
        rows.append((typed, *(("", "", "") if q.refused else (q.name, ",".join(q.exts), q.path)), bool(q.refused)))
    return spark.createDataFrame(rows, "typed string, name string, exts string, path string, refused boolean")


@query(f"SELECT user_id AS list, {NOW} - max(epoch(date_trunc('second', ts))::BIGINT) >= 5 AS due FROM events GROUP BY 1")
def windows_cache(spark, sf_dir):
    """Lists of windows that have to be read again."""
    e = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("list")).agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("ts"))
    return e.select("list", catalogs.windows_due(F.col("ts"), NOW).alias("due"))


@query(f"WITH RECURSIVE {S.TREE}, h AS (SELECT depth, count(*) AS n FROM tree JOIN walk USING (frn) WHERE len(list_filter(string_split('rd1', ''), lambda c: NOT contains(lower(tree.name), c))) = 0 GROUP BY depth) SELECT depth, n, sum(n) OVER (ORDER BY depth)::BIGINT AS up_to FROM h")
def survivors_by_depth(spark, sf_dir):
    """Entries that a query's classes let through, by depth."""
    return rank.survivors_by_depth(tree_entries(spark, sf_dir), "RD1")


@query("WITH e AS (SELECT event_type AS name, event_type = 'error' AS dead, event_id % 4 = 0 AS old FROM events), s AS (SELECT sum(CASE WHEN dead OR old THEN strlen(name) ELSE 0 END) AS db, sum(CASE WHEN dead OR old THEN 0 ELSE strlen(name) END) AS lb, count(*) FILTER (old) AS o, count(*) FILTER (dead) AS d, count(*) AS n FROM e) SELECT round(db / greatest(lb, 1), 6) AS bytes, round(o / n, 6) AS records, round(d / n, 6) AS slots FROM s")
def waste_fractions(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("dead"), (F.pmod("event_id", F.lit(4)) == 0).alias("superseded"))
    return changes.waste_fractions(e).select(*(F.round(c, 6).alias(c) for c in ("bytes", "records", "slots")))


@query(f"WITH RECURSIVE {S.TREE}, hit AS (SELECT t.frn, {S.tiers('0012')} * {S.factor()} AS score FROM tree t JOIN walk USING (frn)), page AS (SELECT * FROM hit WHERE score IS NOT NULL ORDER BY score DESC, frn LIMIT 50) SELECT frn, round(score, 6) AS score, o_totalprice AS size, o_orderdate AS mtime FROM page LEFT JOIN orders ON o_orderkey + 1000000000 = frn")
def page_metadata(spark, sf_dir):
    """A page with size and time of its files, looked up for the page alone."""
    files = A.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("frn"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"))
    return rank.with_metadata(rank.search(tree_entries(spark, sf_dir), "0012", 50).select("frn", r6()), files)


@query("WITH e AS (SELECT ['index.progress', 'index.state', 'config.changed', 'other'][(event_id % 4 + 1)::INTEGER] AS topic, event_type AS payload, event_id AS ts FROM events), s AS (SELECT n_nationkey AS client, ['index.progress', 'index.state', 'config.changed', 'other'][(n_regionkey % 4 + 1)::INTEGER] AS topic, n_nationkey * 100 AS since FROM nation) SELECT client, topic, payload, ts FROM e JOIN s USING (topic) WHERE topic <> 'other' AND ts >= since")
def subscriptions(spark, sf_dir):
    """Events as they go to each client that listens."""
    topics = F.array(*(F.lit(t) for t in (*rank.TOPICS, "other")))
    e = A.table(spark, sf_dir, "events").select(F.element_at(topics, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("topic"), F.col("event_type").alias("payload"), F.col("event_id").alias("ts"))
    n = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("client"), F.element_at(topics, F.pmod("n_regionkey", F.lit(4)) + 1).alias("topic"), (F.col("n_nationkey") * 100).alias("since"))
    return rank.delivered(e, n)


_ENGINES = [("one", "https://one.example/?q={query}"), ("two", "https://two.example/s/{query}")]


@query(f"WITH q AS (SELECT r_regionkey AS qid, ['red', 'zz top', '  ', 'small', 'c++ & more'][r_regionkey + 1] AS q FROM region), {S.PARTS}, best AS (SELECT qid, max(CASE WHEN contains(lower(name), q) THEN 0.55 END) AS top FROM q, parts GROUP BY qid) SELECT qid, q, e.engine, replace(e.t, '{{query}}', replace(url_encode(q), '+', '%20')) AS url, e.place FROM q JOIN best USING (qid), (VALUES ('one', '{_ENGINES[0][1]}', 0), ('two', '{_ENGINES[1][1]}', 1)) e(engine, t, place) WHERE trim(q) <> '' AND coalesce(top, 0) < 0.5")
def web_fallback(spark, sf_dir):
    """Offers to search the web for what nothing here is good enough for."""
    texts = F.array(*(F.lit(t) for t in ("red", "zz top", "  ", "small", "c++ & more")))
    queries = A.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("qid"), F.element_at(texts, F.col("r_regionkey") + 1).alias("q"))
    found = rank.batch_search(part_entries(spark, sf_dir), queries.where(F.trim("q") != ""), 1)
    return rank.web_rows(queries, found, _ENGINES, 0.5)


@query("WITH t AS (SELECT conv_id, turn, 'On {date:yyyy-MM-dd}: {clipboard}{cursor}!' AS t, text FROM conversations WHERE NOT contains(text, '{')) SELECT conv_id, turn, 'On 2024-01-31: ' || text || '!' AS text, (15 + length(text))::INTEGER AS cursor FROM t")
def snippets(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").where("not contains(text, '{')")
    filled, cursor = scalar.snippet(F.lit("On {date:yyyy-MM-dd}: {clipboard}{cursor}!"), F.col("text"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return c.select("conv_id", "turn", filled.alias("text"), cursor.alias("cursor"))


@query(f"WITH {_POST}, d AS (SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents)) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 6) AS score FROM tf JOIN df USING (term), st WHERE doc_id IN (SELECT doc_id FROM d) GROUP BY doc_id")
def content_owned(spark, sf_dir):
    """Contents found, as they are served to the owner of one scope."""
    docs = A.table(spark, sf_dir, "documents").withColumnRenamed("source", "sid")
    first = docs.agg(F.min("sid")).first()[0]
    return content.owned(content.bm25(docs, _TERMS), docs, first).select("doc_id", r6())

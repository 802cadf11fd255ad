"""Scalar-function, classifier, JSON, markup and composition queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import classify as C
from loomgraph.functions import markup as M
from loomgraph.functions import options as O
from loomgraph.functions import richtext as T
from loomgraph.functions import text as X
from loomgraph.sources.tables import table

_int = lambda c: c.cast("bigint")


def _pages(spark, d):
    return table(spark, d, "pages")


def canonical_url(spark, d):
    return _pages(spark, d).select("page_id", X.canonical_url("url").alias("canonical"))


def url_slug(spark, d):
    return _pages(spark, d).select("page_id", X.url_slug("url").alias("slug"), X.url_host("url").alias("host"))


def classify_url(spark, d):
    return _pages(spark, d).select("page_id", C.page_kind(X.url_path("url")).alias("kind"))


def crawlable(spark, d):
    return _pages(spark, d).select("page_id", C.crawlable(F.col("url"), "example.com").alias("ok"))


def page_links(spark, d):
    return _pages(spark, d).select("page_id", F.explode(M.links(F.col("html"))).alias("href")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("n_distinct"), F.min("href").alias("first_href"))


def page_slug_collisions(spark, d):
    """File keys: the slug, or the whole path where an earlier page of the kind took the slug."""
    p = _pages(spark, d).select("page_id", X.url_host("url").alias("kind"), X.url_slug("url").alias("slug"), X.url_path("url").alias("path"))
    rank = F.row_number().over(Window.partitionBy("kind", "slug").orderBy("page_id"))
    full = F.regexp_replace(F.regexp_replace("path", "^/+|/+$", ""), "/", "_")
    return p.select("page_id", F.concat("kind", F.lit("/"), F.when(rank == 1, F.col("slug")).otherwise(full), F.lit(".html")).alias("file"))


def slugify_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


def label_to_snake(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.initcap(F.lower("p_type")), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("label"))
    return p.select("p_partkey", "label", X.camel_to_snake("label").alias("snake"))


def stem_words(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(X.words("text")).alias("word")).distinct()
    return w.select("word", X.stem("word").alias("stem"))


def lucene_escape_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.lucene_escape(F.concat(F.lit("(Ld) a+b? "), "text")).alias("escaped"))


def strip_parenthetical(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.without_parenthetical(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") "))).alias("bare"))


def bracket_citations(spark, d):
    """Bracketed ids that are known, the text without them, and whether a known id is mentioned as a whole word outside brackets."""
    p = table(spark, d, "part").select("p_partkey", X.slugify("p_name").alias("slug"))
    said = p.select("p_partkey", F.concat(F.lit("see ["), "slug", F.lit("] and [other-"), F.col("p_partkey") % 3, F.lit("] or [other-9]"), F.when(F.col("p_partkey") % 4 == 0, " as OTHER-1 says").when(F.col("p_partkey") % 4 == 1, " as another-1 says").otherwise("")).alias("t"), F.array(F.col("slug"), F.lit("other-1")).alias("known"))
    found = F.array_intersect(F.regexp_extract_all("t", F.lit(r"\[([a-z0-9][a-z0-9-]*)\]"), 1), F.col("known"))
    cleared = F.aggregate("known", F.col("t"), lambda s, k: F.replace(s, F.concat(F.lit("["), k, F.lit("]")), F.lit("")))
    bare = F.regexp_replace("t", r"\[.*?\]", " ")
    mentioned = F.exists("known", lambda k: F.regexp_like(bare, F.concat(F.lit(r"(?i)\b\Q"), k, F.lit(r"\E\b"))))
    return said.select("p_partkey", F.array_join(found, ",").alias("cited"), cleared.alias("cleared"), mentioned.alias("mentioned"))


def unit_size_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.concat("p_size", F.lit("+"))).when(F.col("p_size") % 4 == 1, F.concat("p_size", F.lit("-"), F.col("p_size") + 20)).when(F.col("p_size") % 4 == 2, F.col("p_size").cast("string")).otherwise("any").alias("raw"))
    return p.select("p_partkey", _int(X.unit_size("raw")["min"]).alias("size_min"), _int(X.unit_size("raw")["max"]).alias("size_max"))


def base_size_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.concat("p_size", F.lit(" X "), F.col("p_size") * 2, F.lit("mm"))).alias("raw"))
    return p.select("p_partkey", _int(X.base_size("raw")["width"]).alias("width"), _int(X.base_size("raw")["depth"]).alias("depth"))


def stat_value_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "-").when(F.col("p_size") % 5 == 1, F.concat(F.lit("(+"), "p_size", F.lit(")"))).when(F.col("p_size") % 5 == 2, F.concat(F.lit(" "), "p_size", F.lit(" "))).otherwise(F.col("p_name")).alias("raw"))
    return p.select("p_partkey", _int(X.stat_value("raw")).alias("value"))


def _options(spark, d):
    """Option lines made of every part's columns."""
    words = F.array(*[F.lit(x) for x in ["upgrade one model to a Standard Bearer", "upgrade one model to a musician", "upgrade one model to a Champion", "magic items up to a total of 50 points", "be a Level 2 Wizard", "may ride a mount", "replace hand weapon", "Shield", "veteran rule"]])
    cost = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" (+"), "p_size", F.lit(" points per model)"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" (+"), "p_size", F.lit(" point per unit)"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(": "), F.element_at(words, (F.col("p_partkey") % 9 + 1).cast("int")), cost).alias("line"))


def cost_unit_parse(spark, d):
    return _options(spark, d).select("p_partkey", _int(X.points_cost("line")["points"]).alias("points"), X.points_cost("line")["unit"].alias("unit"))


def budget_parse(spark, d):
    return _options(spark, d).select("p_partkey", _int(X.points_budget("line")).alias("budget"))


def option_classifier(spark, d):
    none = F.array().cast("array<struct<slug:string,kind:string>>")
    return _options(spark, d).select("p_partkey", O.upgrade(F.col("line"), none, F.lit(False)).alias("u")).select("p_partkey", F.col("u.upgrade_type").alias("kind"), "u.cost_unit")


def percent_limits_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "Up to ").otherwise("At least "), "p_size", F.lit("% of the points")).alias("raw"))
    return p.select("p_partkey", _int(X.percent_limits("raw")["max"]).alias("max_pct"), _int(X.percent_limits("raw")["min"]).alias("min_pct"))


def per_points_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("0-"), "p_size", F.lit(" units per 1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" points")).alias("raw"))
    return p.select("p_partkey", _int(X.per_points_limit("raw")["max_count"]).alias("max_count"), _int(X.per_points_limit("raw")["per_points"]).alias("per_points"))


def version_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" - Version 1."), "p_size")).otherwise(F.col("p_name")).alias("raw"))
    return p.select("p_partkey", X.document_version("raw")["document"].alias("document"), X.document_version("raw")["version"].alias("version"))


def alliance_parse(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.alliance_type(F.when(F.col("c_custkey") % 3 == 0, "A pact (Uneasy)").when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")).otherwise("all of them ( SUSPICIOUS )")).alias("kind"))


def terrain_class(spark, d):
    return table(spark, d, "documents").select("doc_id", C.terrain_kind(F.concat_ws("-", F.lower("source"), F.when(F.col("doc_id") % 7 == 0, "hill").when(F.col("doc_id") % 7 == 1, "wood")), F.col("text")).alias("kind"))


def failure_taxonomy(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, 404).when(F.col("event_id") % 5 == 1, 503).alias("status"), F.when(F.col("event_id") % 5 == 2, "Timeout").when(F.col("event_id") % 5 == 3, F.col("event_type")).alias("message"), (F.col("event_id") % 6).alias("tries"))
    return e.groupBy(C.failure_kind(F.col("status"), F.col("message"), F.col("tries")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def json_path(spark, d):
    """A deep path that may be missing, by event."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.none.deep").alias("deep"))


def props_struct(spark, d):
    """Readable properties as compact JSON, nulls left out."""
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.to_json(F.struct(F.col("l_quantity").cast("bigint").alias("budget"), F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")).alias("alliance_type"))).alias("props"))


def array_flatten(spark, d):
    """Lines of every conversation turn with their place, blank ones dropped."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return t.where(X.strip("line") != "").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("lines"), _int(F.max("place")).alias("last_place"), _int(F.sum(F.length("line"))).alias("chars"))


def section_assignment(spark, d):
    """Each line belongs to the last heading above it; a line of one word counts as a heading."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    head = F.when(~F.contains("line", F.lit(" ")), F.col("line"))
    order = Window.partitionBy("conv_id").orderBy("turn", "place")
    t = t.withColumn("section", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("conv_id", "section").agg(F.count(F.lit(1)).alias("n"))


def mutex_counter(spark, d):
    """A running group number that rises at each marked line of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    line = table(spark, d, "lineitem").withColumn("g", F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(w))
    return line.groupBy("l_orderkey", "g").agg(F.count(F.lit(1)).alias("n"))


def html_title(spark, d):
    return _pages(spark, d).select("page_id", M.title("html").alias("title"))


def html_to_markdown(spark, d):
    return _pages(spark, d).select("page_id", M.markdown("html").alias("markdown"))


def html_document_title(spark, d):
    return _pages(spark, d).select("page_id", X.or_null(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"), M.next_data(F.col("html")).alias("data"))


def front_matter(spark, d):
    return _pages(spark, d).select("page_id", M.front_matter(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.col("url"), F.lit("page")).alias("front"))


def chat_text(spark, d):
    """User and assistant texts of every conversation in turn order."""
    t = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("chat"))


def sse_lines(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("text-start").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("id"))), F.lit("\n\n")).alias("line"))


def compose_node_text(spark, d):
    """Name and body of a part, empty pieces skipped."""
    p = table(spark, d, "part")
    return p.select("p_partkey", X.joined(". ", F.col("p_name"), F.when(F.col("p_size") > 10, F.concat(F.lit("Size "), "p_size")), F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand")), F.concat(F.lit("Type "), F.lower("p_type"))).alias("text"))


def compose_unit_text(spark, d):
    """A customer's text from four joined parts: itself, its nation, its orders by priority, its costliest order."""
    c = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("kinds"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top"), F.count(F.lit(1)).alias("n"))
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    cost = X.cost_suffix(F.col("n"), F.when(F.col("n") % 2 == 0, "per_model").otherwise("flat"))
    text = X.joined(". ", F.col("c_name"), F.col("n_name"), F.concat(F.lit("Orders: "), F.array_join("kinds", ", ")), F.concat(F.lit("Top "), F.col("top"), F.lit(" "), cost))
    return rows.select("c_custkey", text.alias("text"))


def roster_line(spark, d):
    p = table(spark, d, "part")
    size = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("unit size "), "p_size", F.lit("+"))).otherwise(F.concat(F.lit("unit size "), "p_size", F.lit("-"), F.col("p_size") + 10))
    return p.select("p_partkey", X.joined("; ", F.col("p_type"), F.when(F.col("p_brand") != F.col("p_type"), F.col("p_brand")), F.concat(F.col("p_retailprice").cast("bigint"), F.lit(" pts/model")), size).alias("line"))


def rich_text_nodes(spark, d):
    """Every turn as a tree of paragraphs, flattened again: nodes, text nodes and characters."""
    t = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), T.paragraphs(F.split("text", "\n")).alias("tree"))
    n = T.nodes(t, "key", "tree")
    return n.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node_type") == "text").alias("texts"), _int(F.max("depth")).alias("depth"), _int(F.sum(F.length("text"))).alias("chars"))


def rich_text_plain(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", T.paragraphs(F.split("text", "\n")).alias("tree"))
    return t.select("conv_id", "turn", T.text_of(F.col("tree")).alias("plain"))


def sql_search_function(spark, d):
    """A SQL table function over the catalogue: parts by prefix in any case."""
    table(spark, d, "part").createOrReplaceTempView("loomgraph_parts")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION parts_by_prefix(q STRING) RETURNS TABLE (p_partkey BIGINT, p_name STRING) RETURN SELECT p_partkey, p_name FROM loomgraph_parts WHERE startswith(lower(p_name), lower(parts_by_prefix.q))")
    return spark.sql("SELECT p_partkey, p_name FROM parts_by_prefix('RED')")


QUERIES = {f.__name__: f for f in (
    canonical_url, url_slug, classify_url, crawlable, page_links, page_slug_collisions, slugify_names, label_to_snake, stem_words, lucene_escape_text,
    strip_parenthetical, bracket_citations, unit_size_parse, base_size_parse, stat_value_parse, cost_unit_parse, budget_parse, option_classifier,
    percent_limits_parse, per_points_parse, version_parse, alliance_parse, terrain_class, failure_taxonomy, json_path, props_struct, array_flatten,
    section_assignment, mutex_counter, html_title, html_to_markdown, html_document_title, front_matter, chat_text, sse_lines, compose_node_text,
    compose_unit_text, roster_line, rich_text_nodes, rich_text_plain, sql_search_function,
)}

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_SLUG = f"coalesce(nullif(regexp_extract({_PATH}, '([^/]+)/*$', 1), ''), 'toc')"
_OPTION = """o AS (SELECT p_partkey, p_size, p_name || ': ' || (['upgrade one model to a Standard Bearer', 'upgrade one model to a musician', 'upgrade one model to a Champion', 'magic items up to a total of 50 points', 'be a Level 2 Wizard', 'may ride a mount', 'replace hand weapon', 'Shield', 'veteran rule'])[p_partkey % 9 + 1]
  || CASE p_size % 3 WHEN 0 THEN ' (+' || p_size || ' points per model)' WHEN 1 THEN ' (+' || p_size || ' point per unit)' ELSE '' END AS line FROM part)"""
_LINES = "l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM conversations)"
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_YAML = lambda v: f"""CASE WHEN regexp_matches({v}, '[:#"''\\[\\],]') OR regexp_matches({v}, '^\\s|\\s$') OR {v} = '' THEN '"' || replace(replace({v}, '\\', '\\\\'), '"', '\\"') || '"' ELSE {v} END"""
_STEM_WORD = """CASE WHEN word LIKE '%ies' AND length(word) >= 5 THEN left(word, length(word) - 3) || 'y' WHEN word LIKE '%ed' AND length(word) >= 5 THEN left(word, length(word) - 2)
  WHEN word LIKE '%ing' AND length(word) >= 6 THEN left(word, length(word) - 3) WHEN word LIKE '%es' AND length(word) >= 5 THEN left(word, length(word) - 2) WHEN word LIKE '%s' AND length(word) >= 4 THEN left(word, length(word) - 1) ELSE word END"""
ORACLES = {
    "canonical_url": f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1) AS canonical FROM pages""",
    "url_slug": f"SELECT page_id, {_SLUG} AS slug, {_HOST} AS host FROM pages",
    "classify_url": f"SELECT page_id, CASE WHEN {_PATH} IN ('', '/') THEN 'toc' WHEN regexp_matches({_PATH}, '^/[a-z]{{2}}/\\d+/?$') THEN 'article' WHEN regexp_matches({_PATH}, '^/[a-z]{{2}}(/|$)') THEN 'section' WHEN regexp_matches({_PATH}, '\\.(pdf|zip)$') THEN 'file' END AS kind FROM pages",
    "crawlable": f"SELECT page_id, regexp_matches(url, '^https?://') AND ({_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com') AND NOT starts_with({_PATH}, '/api') AND NOT starts_with({_PATH}, '/preview') AS ok FROM pages",
    "page_links": r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_distinct, min(href) AS first_href FROM l
        WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|javascript:)|\.pdf$') GROUP BY 1""",
    "page_slug_collisions": f"""WITH p AS (SELECT page_id, {_HOST} AS kind, {_SLUG} AS slug, {_PATH} AS path FROM pages)
        SELECT page_id, kind || '/' || CASE WHEN row_number() OVER (PARTITION BY kind, slug ORDER BY page_id) = 1 THEN slug ELSE replace(trim(path, '/'), '/', '_') END || '.html' AS file FROM p""",
    "slugify_names": "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
    "label_to_snake": """WITH l AS (SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') AS label FROM part)
        SELECT p_partkey, label, ltrim(lower(regexp_replace(label, '([A-Z])', '_\\1', 'g')), '_') AS snake FROM l""",
    "stem_words": f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', 1)) AS word FROM benchmark) SELECT word, {_STEM_WORD} AS stem FROM w",
    "lucene_escape_text": r"""SELECT item_id, regexp_replace('(Ld) a+b? ' || text, '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM benchmark""",
    "strip_parenthetical": "SELECT c_custkey, c_name AS bare FROM customer",
    "bracket_citations": r"""WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
        SELECT p_partkey, slug || CASE WHEN p_partkey % 3 = 1 THEN ',other-1' ELSE '' END AS cited, 'see  and ' || CASE WHEN p_partkey % 3 = 1 THEN '' ELSE '[other-' || p_partkey % 3 || ']' END || ' or [other-9]' || CASE p_partkey % 4 WHEN 0 THEN ' as OTHER-1 says' WHEN 1 THEN ' as another-1 says' ELSE '' END AS cleared, p_partkey % 4 = 0 AS mentioned FROM p""",
    "unit_size_parse": "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 1 ELSE p_size END::BIGINT AS size_min, CASE p_size % 4 WHEN 1 THEN p_size + 20 WHEN 2 THEN p_size END::BIGINT AS size_max FROM part",
    "base_size_parse": "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size END::BIGINT AS width, CASE WHEN p_size > 5 THEN p_size * 2 END::BIGINT AS depth FROM part",
    "stat_value_parse": "SELECT p_partkey, CASE WHEN p_size % 5 = 2 THEN p_size END::BIGINT AS value FROM part",
    "cost_unit_parse": "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size END::BIGINT AS points, CASE p_size % 3 WHEN 0 THEN 'per_model' WHEN 1 THEN 'per_unit' END AS unit FROM part",
    "budget_parse": f"WITH {_OPTION} SELECT p_partkey, nullif(regexp_extract(line, '(?i)up to (?:a total of )?(\\d+) (?:points|pts)', 1), '')::BIGINT AS budget FROM o",
    "option_classifier": """WITH k AS (SELECT p_partkey, p_size, (['command_standard', 'command_musician', CASE WHEN p_size % 3 < 2 THEN 'command_champion' ELSE 'rule_add' END, 'magic_item_budget', 'wizard_level', 'rule_add', 'rule_add', 'armour_add', 'rule_add'])[p_partkey % 9 + 1] AS kind FROM part)
        SELECT p_partkey, kind, CASE WHEN kind = 'magic_item_budget' THEN 'budget' WHEN p_size % 3 = 0 THEN 'per_model' WHEN p_size % 3 = 1 THEN 'per_unit' WHEN kind LIKE 'command%' THEN 'per_unit' WHEN kind = 'wizard_level' THEN 'flat' WHEN kind = 'armour_add' THEN 'per_model' END AS cost_unit FROM k""",
    "percent_limits_parse": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END::BIGINT AS max_pct, CASE WHEN p_size % 2 = 1 THEN p_size END::BIGINT AS min_pct FROM part",
    "per_points_parse": "SELECT p_partkey, p_size::BIGINT AS max_count, 1000 + p_size::BIGINT AS per_points FROM part",
    "version_parse": "SELECT p_partkey, p_name AS document, CASE WHEN p_size % 2 = 0 THEN '1.' || p_size END AS version FROM part",
    "alliance_parse": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'uneasy' WHEN 1 THEN 'trusted' ELSE 'suspicious' END AS kind FROM customer",
    "terrain_class": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'hill' WHEN doc_id % 7 = 1 THEN 'woods' WHEN contains(lower(left(text, 500)), 'water') THEN 'water' WHEN contains(lower(left(text, 500)), 'wall') THEN 'linear_obstacle' WHEN contains(lower(left(text, 500)), 'the') THEN 'open' ELSE 'special' END AS kind FROM documents",
    "failure_taxonomy": "SELECT CASE WHEN event_id % 5 = 0 THEN '404' WHEN event_id % 5 = 1 THEN 'http_error' WHEN event_id % 5 = 2 THEN 'network' WHEN event_id % 6 > 3 THEN 'isr_exhausted' WHEN event_id % 5 = 3 THEN 'unexpected' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "json_path": "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.none.deep' AS deep FROM events",
    "props_struct": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, '{\"budget\":' || l_quantity::BIGINT || CASE WHEN l_returnflag = 'R' THEN ',\"alliance_type\":\"R\"' ELSE '' END || '}' AS props FROM lineitem",
    "array_flatten": f"WITH {_LINES} SELECT conv_id, turn, count(*) AS lines, max(place)::BIGINT AS last_place, sum(length(line))::BIGINT AS chars FROM l WHERE trim(line) <> '' GROUP BY 1, 2",
    "section_assignment": f"""WITH {_LINES}, s AS (SELECT conv_id, last_value(CASE WHEN NOT contains(line, ' ') THEN line END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, place ROWS UNBOUNDED PRECEDING) AS section FROM l)
        SELECT conv_id, section, count(*) AS n FROM s GROUP BY 1, 2""",
    "mutex_counter": """WITH g AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM lineitem)
        SELECT l_orderkey, g, count(*) AS n FROM g GROUP BY 1, 2""",
    "html_title": r"""WITH h AS (SELECT page_id, regexp_replace(array_to_string(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), '(?s)<[^>]*>[^<]*</[^>]*>', '', 'g') AS t FROM pages)
        SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&(lt|LT);?', '<', 'g'), '&(gt|GT);?', '>', 'g'), '&(quot|QUOT);?', '"', 'g'), '&(amp|AMP);?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM h""",
    "html_document_title": f"SELECT page_id, nullif({_TITLE}, '') AS title, NULL::VARCHAR AS data FROM pages",
    "front_matter": f"SELECT page_id, '---' || chr(10) || 'title: ' || {_YAML(_TITLE)} || chr(10) || 'source: ' || {_YAML('url')} || chr(10) || 'kind: page' || chr(10) || '---' || chr(10) AS front FROM pages",
    "chat_text": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1",
    "sse_lines": "SELECT conv_id, turn, 'data: {\"type\":\"text-start\",\"id\":\"' || conv_id || '-' || turn || '\"}' || chr(10) || chr(10) AS line FROM conversations",
    "compose_node_text": "SELECT p_partkey, concat_ws('. ', p_name, CASE WHEN p_size > 10 THEN 'Size ' || p_size END, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END, 'Type ' || lower(p_type)) AS text FROM part",
    "compose_unit_text": """WITH o AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS kinds, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS top, count(*) AS n FROM orders GROUP BY 1)
        SELECT c_custkey, concat_ws('. ', c_name, n_name, 'Orders: ' || kinds, 'Top ' || top || ' (+' || n || CASE WHEN n % 2 = 0 THEN ' pt/model)' ELSE ' pts)' END) AS text FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey""",
    "roster_line": "SELECT p_partkey, concat_ws('; ', p_type, CASE WHEN p_brand <> p_type THEN p_brand END, trunc(p_retailprice)::BIGINT || ' pts/model', CASE WHEN p_size % 2 = 0 THEN 'unit size ' || p_size || '+' ELSE 'unit size ' || p_size || '-' || (p_size + 10) END) AS line FROM part",
    "rich_text_nodes": """SELECT conv_id || '-' || turn AS key, 1 + 2 * len(string_split(text, chr(10))) AS n, len(string_split(text, chr(10))) AS texts, 2::BIGINT AS depth, length(replace(text, chr(10), '')) AS chars FROM conversations""",
    "rich_text_plain": "SELECT conv_id, turn, replace(text, chr(10), '') AS plain FROM conversations",
    "sql_search_function": "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'red')",
}

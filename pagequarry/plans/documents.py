"""Queries over documents and events: text scalars, batches, caches, model verdicts, scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.operators import enrich, relevance

from .registry import Registry, likely, part, read

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, left(text, 100) || right(text, 100) || 'clean' || length(text) AS cache_key FROM documents")
def content_cache_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.content_cache_key("text", F.lit("clean")).alias("cache_key"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 20)::BIGINT AS batch_id FROM documents")
def batch_assign(spark, sf_dir):
    return relevance.batches(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20)


def _headings_sql(x: str) -> str:
    for k in range(6, 0, -1):
        x = f"regexp_replace({x}, '#{{{k}}}([^\\s#])', '{'#' * k} \\1', 'g')"
    return x


_MD = "regexp_replace(regexp_replace(chr(10) || '* ' || text || chr(10) || '```   py', '\\n{3,}', chr(10) || chr(10), 'g'), '```\\s+```', '```' || chr(10) || '```', 'g')"
_MD = _headings_sql(_MD)
_MD = f"regexp_replace(regexp_replace({_MD}, '```[ \\t]+([a-zA-Z0-9]+)', '```\\1', 'g'), '(\\n[*-] [^\\n]+)\\n([^\\n*-])', '\\1' || chr(10) || chr(10) || '\\2', 'g')"


@query(f"SELECT doc_id, {_MD} AS markdown FROM documents")
def markdown_postprocess(spark, sf_dir):
    raw = F.concat(F.lit("\n* "), F.col("text"), F.lit("\n```   py"))
    return read(spark, sf_dir, "documents").select("doc_id", text.markdown_postprocessed(raw).alias("markdown"))


def echo_model(contents: list[str], mode: str, content_type: str) -> list[str]:
    """A deterministic stand-in for a language model."""
    return [f"{mode}: {c}" for c in contents]


_CACHED = "WITH c AS (SELECT DISTINCT left(text, 100) || right(text, 100) || 'clean' || length(text) AS k FROM documents WHERE doc_id % 3 = 0), r AS (SELECT doc_id, text, left(text, 100) || right(text, 100) || 'clean' || length(text) AS k FROM documents)"


@query(f"{_CACHED} SELECT doc_id, k IN (SELECT k FROM c) AS cached, CASE WHEN k IN (SELECT k FROM c) THEN 'cached ' || length(text) ELSE 'clean: ' || text END AS result FROM r")
def enrich_with_cache(spark, sf_dir):
    """Contents whose key is cached aren't processed again; the rest goes through the model in batches."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    cache = docs.filter("doc_id % 3 = 0").select(text.content_cache_key("content", F.lit("clean")).alias("cache_key"), F.concat(F.lit("cached "), F.length("content")).alias("result"))
    return enrich.process(docs, echo_model, cache=cache).select("doc_id", "cached", "result")


@query(f"{_CACHED}, f AS (SELECT k, k IN (SELECT k FROM c) AS hit FROM r) SELECT count(DISTINCT k) AS cache_size, count_if(hit)::BIGINT AS hits, count_if(NOT hit)::BIGINT AS misses, round(count_if(hit) / greatest(1, count(*)) * 100, 6) AS hit_rate FROM f")
def cache_hit_rate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    cache = docs.filter("doc_id % 3 = 0").select(text.content_cache_key("content", F.lit("clean")).alias("cache_key"), F.lit("").alias("result"))
    stats = enrich.cache_stats(enrich.process(docs, cache=cache))
    return stats.withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new ' || text ELSE text END AS content, doc_id % 2 = 0 AS ai_processed FROM documents")
def batch_write_back(spark, sf_dir):
    """Results of a batch put back by URL where there are any."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.col("text").alias("content"))
    done = docs.filter("doc_id % 2 = 0").select("url", F.concat(F.lit("new "), F.col("content")).alias("result"), F.lit(True).alias("processed"))
    return enrich.written_back(docs, done).select("doc_id", "content", "ai_processed")


_REPLY = "CASE WHEN event_id % 4 = 0 THEN 'not json' WHEN event_id % 4 = 1 THEN '{\"is_relevant\": true, \"relevance_score\": 0.9}' WHEN event_id % 4 = 2 THEN '{\"reason\": \"r' || event_id || '\"}' ELSE '{\"is_relevant\": false, \"relevance_score\": 0.25, \"reason\": \"no\"}' END"
_EVENT_URL = "'https://h.example/' || event_type || '/' || CASE WHEN event_id % 3 = 0 THEN 'docs/x' ELSE '' END"


@query(
    f"WITH e AS (SELECT event_id, {_EVENT_URL} AS url FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN {likely('url')} WHEN 1 THEN true ELSE false END AS is_relevant, "
    "CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 WHEN 2 THEN 0.0 ELSE 0.25 END::DOUBLE AS relevance_score, "
    "CASE event_id % 4 WHEN 0 THEN 'Failed to parse AI response' WHEN 1 THEN 'No reason provided' WHEN 2 THEN 'r' || event_id ELSE 'no' END AS reason FROM e"
)
def model_verdicts(spark, sf_dir):
    """JSON replies of a model: whole, with missing fields, and broken ones."""
    i = F.col("event_id")
    reply = F.when(i % 4 == 0, "not json").when(i % 4 == 1, '{"is_relevant": true, "relevance_score": 0.9}').when(i % 4 == 2, F.concat(F.lit('{"reason": "r'), i, F.lit('"}'))).otherwise('{"is_relevant": false, "relevance_score": 0.25, "reason": "no"}')
    url = F.concat(F.lit("https://h.example/"), "event_type", F.lit("/"), F.when(i % 3 == 0, "docs/x").otherwise(""))
    rows = read(spark, sf_dir, "events").select("event_id", url.alias("url"), reply.alias("reply"))
    return rows.select("event_id", relevance.parsed_verdict().alias("v")).select("event_id", "v.*")


def length_model(frame: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a model: links with short texts are relevant."""
    short = frame["link_text"].str.len() < 40
    return pd.DataFrame({"is_relevant": short, "relevance_score": short.map({True: 0.95, False: 0.2}), "reason": "length"})


_DOC_LINK = "SELECT doc_id, 'https://' || source || '.example.org/' || CASE WHEN doc_id % 3 = 0 THEN 'docs/' ELSE '' END || lang || doc_id AS url, 'https://' || source || '.example.org/' AS page_url, split_part(text, chr(10), 1) AS link_text, CASE WHEN doc_id % 5 = 0 THEN 'near' ELSE '' END AS context FROM documents"


@query(
    f"WITH l AS ({_DOC_LINK}), v AS (SELECT doc_id, link_text, context, {likely('url')} AS likely FROM l) SELECT doc_id, CASE WHEN NOT likely AND context = '' THEN false ELSE length(link_text) < 40 END AS is_relevant, "
    "CASE WHEN NOT likely AND context = '' THEN 0.0 WHEN length(link_text) < 40 THEN 0.95 ELSE 0.2 END::DOUBLE AS relevance_score, CASE WHEN NOT likely AND context = '' THEN 'pattern_matching' ELSE 'ai' END AS method FROM v"
)
def model_relevance(spark, sf_dir):
    """Links judged by a model, but for those that the patterns reject and that have no context."""
    d = read(spark, sf_dir, "documents")
    site = F.concat(F.lit("https://"), "source", F.lit(".example.org/"))
    url = F.concat(site, F.when(F.col("doc_id") % 3 == 0, "docs/").otherwise(""), "lang", "doc_id")
    links = d.select("doc_id", url.alias("url"), site.alias("page_url"), F.substring_index("text", "\n", 1).alias("link_text"), F.when(F.col("doc_id") % 5 == 0, "near").otherwise("").alias("context"))
    return relevance.analyzed(links, length_model).select("doc_id", "is_relevant", "relevance_score", "method")


_NODES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"
_SCORE = "2 * (length(line) - length(replace(line, '.', ''))) + 3 * (length(line) - length(replace(line, ',', ''))) + least(length(line) / 100, 10)"


@query(
    f"WITH n AS ({_NODES}), s AS (SELECT doc_id, pos, round({_SCORE}, 6) AS score FROM n WHERE line <> '') SELECT doc_id, pos::INTEGER AS pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM s) WHERE k = 1"
)
def content_score_topk(spark, sf_dir):
    """The best-scored candidate of each document (its lines stand for nodes), the first of equals."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).filter("line <> ''")
    count = lambda ch: F.length("line") - F.length(F.replace("line", F.lit(ch), F.lit("")))
    score = F.round(2 * count(".") + 3 * count(",") + F.least(F.length("line") / 100, F.lit(10.0)), 6)
    scored = lines.select("doc_id", (F.col("at") + 1).alias("pos"), score.alias("score"))
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("m")).select("doc_id", (-F.col("m.p")).alias("pos"), F.col("m.score").alias("score"))


@query(
    "WITH l AS (SELECT doc_id, doc_id % 5 AS depth, doc_id % 7 = 0 AS active, doc_id % 3 = 0 AS heading, split_part(text, chr(10), 1) || CASE WHEN doc_id % 4 = 0 THEN ' Overview' WHEN doc_id % 4 = 1 THEN ' Legacy API' ELSE '' END AS t, '/' || CASE WHEN doc_id % 6 = 0 THEN 'Index' ELSE lang END AS h FROM documents) "
    "SELECT doc_id, (5 + CASE depth WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE -depth END + CASE WHEN active THEN 3 ELSE 0 END + CASE WHEN heading THEN 2 ELSE 0 END "
    "+ CASE WHEN regexp_matches(lower(t || chr(10) || h), 'index|overview|introduction|getting started') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(lower(t), 'deprecated|legacy|archive') THEN 3 ELSE 0 END)::BIGINT AS priority FROM l"
)
def wiki_link_priority(spark, sf_dir):
    i = F.col("doc_id")
    t = F.concat(F.substring_index("text", "\n", 1), F.when(i % 4 == 0, " Overview").when(i % 4 == 1, " Legacy API").otherwise(""))
    h = F.concat(F.lit("/"), F.when(i % 6 == 0, "Index").otherwise(F.col("lang")))
    rows = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"), h.alias("h"), (i % 5).alias("depth"), (i % 7 == 0).alias("active"), (i % 3 == 0).alias("heading"))
    return rows.select("doc_id", urls.wiki_link_priority("t", "h", "depth", "active", "heading").cast("long").alias("priority"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(source, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN source ELSE 'https://' || source END AS url, {part("'https://' || source", 2)} AS authority FROM documents")
def default_scheme(spark, sf_dir):
    url = urls.with_scheme("source")
    return read(spark, sf_dir, "documents").select("doc_id", url.alias("url"), urls.netloc(url).alias("authority"))

"""Relevance of links to documentation: patterns, an optional model call, a cache, a threshold.

Without a model everything is Catalyst expressions.  With one, links that the patterns reject and that
have no context never reach it; cached verdicts are joined in; the rest goes through
``mapInPandas`` in batches, and a failing batch falls back to the patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions import rules, text, urls

from .shared import cut

VERDICT = "is_relevant boolean, relevance_score double, reason string, method string"
#: A model takes a frame of (url, page_url, page_title, link_text, sample) and returns is_relevant, relevance_score, reason.
Model = Callable[[pd.DataFrame], pd.DataFrame]


def link_text(html, url) -> Column:
    """Text of the first anchor in the html whose href is, or ends with, the URL; '' if there is none."""
    quoted = F.regexp_replace(url if isinstance(url, Column) else F.col(url), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    pattern = F.concat(F.lit(r"(?s)<a[^>]*href=[\"'](?:[^\"']*)"), quoted, F.lit(r"[\"'][^>]*>(.*?)</a>"))
    found = F.call_function("regexp_extract", html if isinstance(html, Column) else F.col(html), pattern, F.lit(1))
    return text.stripped(F.regexp_replace(found, "<[^>]*>", ""))


def context_of(content, link) -> Column:
    """Up to 100 characters on either side of the link's text; null where it doesn't occur."""
    c, t = F.col(content), F.col(link)
    at = F.instr(c, t)
    return F.when((t != "") & (at > 0), F.substring(c, F.greatest(F.lit(1), at - 100), F.length(t) + 100 + F.least(F.lit(100), at - 1)))


def content_sample(content, n: int = 1000) -> Column:
    c = F.col(content)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def by_patterns(url: str = "url") -> list[Column]:
    """The verdict columns without a model."""
    likely = urls.likely_documentation(url)
    return [likely.alias("is_relevant"), F.when(likely, 1.0).otherwise(0.0).alias("relevance_score"), F.lit("URL patterns").alias("reason"), F.lit("pattern_matching").alias("method")]


def parsed_verdict(reply: str = "reply", url: str = "url") -> Column:
    """A model's JSON reply as a verdict; missing fields get defaults, invalid JSON the patterns' verdict."""
    got = F.from_json(F.col(reply), "is_relevant boolean, relevance_score double, reason string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = got.isNull() | got["_bad"].isNotNull()
    return F.when(
        bad, F.struct(urls.likely_documentation(url).alias("is_relevant"), F.lit(0.5).alias("relevance_score"), F.lit("Failed to parse AI response").alias("reason"))
    ).otherwise(
        F.struct(
            F.coalesce(got["is_relevant"], F.lit(False)).alias("is_relevant"), F.coalesce(got["relevance_score"], F.lit(0.0)).alias("relevance_score"), F.coalesce(got["reason"], F.lit("No reason provided")).alias("reason")
        )
    )


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """batch_id of rows in order.  The rows are numbered through range partitions, not in one task."""
    return numbered(rows, order).withColumn("batch_id", F.floor(F.col("row_ix") / size)).drop("row_ix")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """row_ix from 0 in the order of a column: counts by range, then ranks within each."""
    spread = cut(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))  # ranges are sampled, so once
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return spread.withColumn("_ix", within).join(F.broadcast(starts), "_part").withColumn("row_ix", F.col("_start") + F.col("_ix")).drop("_part", "_ix", "_start")


def analyzed(links: DataFrame, model: Model | None = None, cache: DataFrame | None = None) -> DataFrame:
    """links (url, page_url, ..., optional context) with the verdict columns.

    cache: rows of (cache_key, verdict columns); a hit needs no model.
    """
    if model is None:
        return links.select("*", *by_patterns())
    keyed = links.withColumn("cache_key", text.link_cache_key("url", "page_url"))
    known = None
    if cache is not None:
        known = keyed.join(cache, "cache_key")
        keyed = keyed.join(cache, "cache_key", "left_anti")
    likely = urls.likely_documentation("url")
    no_context = F.coalesce(F.col("context"), F.lit("")) == "" if "context" in links.columns else F.lit(True)
    plain = keyed.filter(~likely & no_context).select("*", F.lit(False).alias("is_relevant"), F.lit(0.0).alias("relevance_score"), F.lit("URL patterns").alias("reason"), F.lit("pattern_matching").alias("method"))
    asked = keyed.filter(likely | ~no_context).withColumn("likely", likely)
    columns = keyed.schema

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                got = model(frame)
                out = frame.assign(is_relevant=got["is_relevant"].to_numpy(), relevance_score=got["relevance_score"].to_numpy(), reason=got["reason"].to_numpy(), method="ai")
            except Exception as error:  # one batch's failure is its own
                out = frame.assign(is_relevant=frame["likely"], relevance_score=frame["likely"].astype(float), reason=f"model failed: {error}", method="pattern_matching_fallback")
            yield out.drop(columns="likely")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    answered = asked.mapInPandas(call, f"{fields}, {VERDICT}")
    out = plain.unionByName(answered)
    return out if known is None else out.unionByName(known.select(*out.columns))


def judged_links(links: DataFrame, base_url: str | Column, model: Model | None = None, cache: DataFrame | None = None) -> DataFrame:
    """``filter_links`` before its filter: the links of the site with their verdicts."""
    whole = links.withColumn("href", F.col("url")).withColumn("url", urls.join(F.lit(base_url), "url")).filter(F.col("url").isNotNull())
    near = whole.filter(urls.same_site("url", F.lit(base_url)))
    near = near.withColumn("link_text", F.coalesce(link_text("page_content", "href"), F.lit("")))
    near = near.withColumn("context", context_of("page_content", "link_text")).withColumn("sample", content_sample("page_content")).drop("page_content", "href")
    return analyzed(near, model, cache)


def passing(judged: DataFrame, threshold: float = rules.RELEVANCE_THRESHOLD) -> DataFrame:
    return judged.filter(F.col("is_relevant") & (F.col("relevance_score") >= threshold))


def filter_links(links: DataFrame, base_url: str | Column, threshold: float = rules.RELEVANCE_THRESHOLD, model: Model | None = None, cache: DataFrame | None = None) -> DataFrame:
    """The chain over links (url, page_url, page_title, page_content, ...): resolved against the base (a site's, or a column), of its site
    only, with the link's text in the page, the text around it and a sample of the page for the model; relevant with at least the threshold.

    The columns that the chain adds (link_text, context, sample) stay; page_content doesn't.
    """
    return passing(judged_links(links, base_url, model, cache), threshold)


def relevant(links: DataFrame, threshold: float = rules.RELEVANCE_THRESHOLD, model: Model | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Links of the page's own site whose verdict is relevant with at least the threshold."""
    near = links.filter(urls.same_site("url", "page_url"))
    return analyzed(near, model, cache).filter(F.col("is_relevant") & (F.col("relevance_score") >= threshold))

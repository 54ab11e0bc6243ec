"""Operations: run, run in the background, status, cancel; and the tool catalogue over them.

A run has one log of all its pages, fetched or failed, and its statistics, errors and status come from that.  Operations are rows of
an append-only table of events, where one is named in the settings: their latest state is a ``max_by``, so it outlives the driver that ran them, and a
stream may follow them.
"""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import rules, urls, validation

from pagequarry.sources import cache

from . import crawl, enrich, export, live, pages, relevance
from .shared import kept

EVENTS = "operation_id string, seq long, at timestamp, url string, mode string, status string, progress double, url_count long, processed long, failed long, cache_hits long, ended_at string, error string"


def operation_id_column() -> Column:
    return F.concat(F.lit("ex_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def new_operation_id() -> str:
    return "ex_" + uuid.uuid4().hex[:12]


@dataclass
class Settings:
    """What a run may be told beside its request."""

    max_pages: int | None = 500
    content_batch: int = 10
    link_batch: int = 20
    relevance_threshold: float = rules.RELEVANCE_THRESHOLD
    content_model: enrich.Model | None = None
    link_model: relevance.Model | None = None
    include: list[str] | None = None
    exclude: list[str] | None = None
    #: How pages are fetched, level by level; without it they are read from the table.
    fetch: live.FetchStage | None = None
    #: Folders of the caches of contents and of verdicts on links, which runs read and add to.
    content_cache: str | None = None
    link_cache: str | None = None
    #: Waves of a run's contents: after each its results are saved.  Batches of a task under way at a time; tries after a failure.
    waves: int = 4
    at_once: int = 4
    retries: int = 1
    #: Folder of the events of operations.
    events: str | None = None


@dataclass
class Operation:
    id: str
    url: str
    mode: str
    status: str = "pending"
    progress: float = 0.0
    started_at: str = field(default_factory=lambda: datetime.now().isoformat())
    ended_at: str | None = None
    url_count: int = 0
    error: str | None = None
    content_map: str | None = None
    exports: list[dict] = field(default_factory=list)
    #: Counts so far: discovered, processed and failed pages, seconds, contents that a model made and that a cache had.
    statistics: dict = field(default_factory=dict)
    errors: str | None = None


@dataclass
class Run:
    """What a run has found: its pages, the log of all fetches, and what the models made."""

    content: DataFrame
    log: DataFrame
    enriched: DataFrame | None = None

    def statistics(self) -> dict:
        """Counts of the log, with the contents that a model made (ai_processed) and that a cache had (cache_hits)."""
        counts = crawl.stats(self.log).first().asDict()
        done = {"ai_processed": 0, "cache_hits": 0}
        if self.enriched is not None:
            done = self.enriched.agg(F.count_if(F.col("processed") & ~F.col("cached")).alias("ai_processed"), F.count_if(F.col("cached")).alias("cache_hits")).first().asDict()
        return counts | done


class Events:
    """The events of operations in a folder: one row for each change, added, never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, op: Operation, seq: int) -> None:
        got = op.statistics
        row = (op.id, seq, datetime.now(), op.url, op.mode, op.status, float(op.progress), op.url_count, got.get("processed"), got.get("failed"), got.get("cache_hits"), op.ended_at, op.error)
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).option("ignoreMissingFiles", "true").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(EVENTS).parquet(self.path)

    def latest(self) -> DataFrame:
        return latest_states(self.table())


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each operation, with the number of its events."""
    columns = [c for c in events.columns if c != "operation_id"]
    last = events.groupBy("operation_id").agg(F.max_by(F.struct(*columns), "seq").alias("r"), F.count(F.lit(1)).alias("events"))
    return last.select("operation_id", "r.*", "events")


class Pipeline:
    """Crawl from a URL, over a pages table or by fetching, extract, enrich, export."""

    def __init__(self, spark: SparkSession, table: DataFrame | None, settings: Settings | None = None):
        self.spark, self.table, self.settings = spark, table, settings or Settings()
        self.operations: dict[str, Operation] = {}
        self.events = Events(spark, self.settings.events) if self.settings.events else None
        self._changes: dict[str, int] = {}
        self._lock = threading.Lock()

    def _start(self, url: str, mode: str) -> Operation:
        op = Operation(new_operation_id(), url, mode)
        self.operations[op.id] = op
        self._changed(op)
        return op

    def _changed(self, op: Operation, **values) -> None:
        """Set values of an operation and add an event of it; progress doesn't fall."""
        with self._lock:
            values["progress"] = max(op.progress, values.get("progress", op.progress))
            for name, value in values.items():
                if name != "status" or op.status != "canceled":
                    setattr(op, name, value)
            self._changes[op.id] = seq = self._changes.get(op.id, -1) + 1
        if self.events:
            self.events.add(op, seq)

    def run(self, url: str, mode: str = "auto", output_dir: str | None = None, max_depth: int = 5, use_ai: bool = False, export_format: str = "both") -> dict:
        return self._run(self._start(url, mode), output_dir, max_depth, use_ai, export_format)

    def run_async(self, url: str, mode: str = "auto", **options) -> dict:
        op = self._start(url, mode)
        options = {"output_dir": None, "max_depth": 5, "use_ai": False, "export_format": "both"} | options
        threading.Thread(target=self._run, args=(op, *(options[k] for k in ("output_dir", "max_depth", "use_ai", "export_format"))), daemon=True).start()
        return {"operation_id": op.id, "status": "running"}

    def _run(self, op: Operation, output_dir, max_depth, use_ai, export_format) -> dict:
        self._changed(op, status="running")
        self.spark.sparkContext.setJobGroup(op.id, f"extract {op.url}", True)
        try:
            export.select_exporters(export_format)
            found = self.collect(op.url, op.mode, max_depth, use_ai, lambda **values: self._changed(op, **values), lambda: op.status == "canceled")
            self._changed(op, statistics=found.statistics(), url_count=found.content.count(), progress=85.0)
            if output_dir:
                os.makedirs(output_dir, exist_ok=True)
                op.errors = os.path.join(output_dir, "errors")
                crawl.errors(found.log).write.mode("overwrite").json(op.errors)
                project = self.project(op.url)
                op.content_map = export.export_content_map(found.content, output_dir)["path"]
                op.exports = export.export_all(found.content, output_dir, project, export_format, {"base_url": op.url})
            self._changed(op, status="completed", progress=100.0, ended_at=datetime.now().isoformat())
            message = f"{op.url_count} pages"
        except Exception as error:  # the record says what happened
            message = str(error).split("\n")[0]
            self._changed(op, status="failed", error=message, ended_at=datetime.now().isoformat())
        if output_dir and os.path.isdir(output_dir):
            with open(os.path.join(output_dir, "operation_info.json"), "w", encoding="utf-8") as f:
                json.dump(asdict(op), f, indent=2, default=str)
        return {"operation_id": op.id, "status": op.status, "message": message, "url_count": op.url_count, "exports": op.exports, "statistics": op.statistics}

    def extract(self, url: str, mode: str, max_depth: int, use_ai: bool) -> DataFrame:
        """seq, url, title, content, depth, metadata, elements of the pages reached from url."""
        return self.collect(url, mode, max_depth, use_ai).content

    def collect(self, url: str, mode: str, max_depth: int, use_ai: bool, told: Callable[..., None] = lambda **values: None, canceled: Callable[[], bool] = lambda: False) -> Run:
        """The pages reached from url, and the log of all that were asked for.

        Each page is parsed once, for content and links together; both are written before anything reads
        them again, and so is the result with what the models made of it: crawl levels and exporters read tables.
        told is given statistics and progress as they change.
        """
        pages.select_strategy(mode)

        def chosen(links: DataFrame, found: DataFrame) -> DataFrame:
            if use_ai:
                near = links.join(found.select(F.col("page_id"), F.col("title").alias("page_title"), F.col("content").alias("page_content")), "page_id", "left")
                links = self._relevant(near, url)
            return links.filter(urls.glob_filter("url", self.settings.include, self.settings.exclude))

        seeds = self.spark.range(1).select(urls.with_scheme(F.lit(url)).alias("url"))
        columns = ("url", "title", "content", "depth", "metadata", "elements")
        if self.settings.fetch is not None:
            levels = lambda now: told(statistics={k: now[k] for k in ("processed", "failed", "queued")}, progress=0.7 * now["progress"])
            done = live.crawl_site(seeds, self.settings.fetch, mode, max_depth, self.settings.max_pages, chosen, levels, canceled)
            content, log = done.pages().select(F.struct("depth", "place", "page_id").alias("seq"), *columns), done.log()
        else:
            parsed = Observation()
            rows = pages.extract(self.table, mode).observe(parsed, F.count_if("success").alias("processed"), F.count_if(~F.col("success")).alias("failed"))
            found = kept(rows, "extracted")
            told(statistics=dict(parsed.get), progress=40.0)
            links = chosen(pages.links_of(pages.candidates(found), mode), found)
            edges = kept(links.select(F.col("page_url").alias("src"), F.col("url").alias("dst"), F.col("seq").alias("link_seq")), "links")
            reached = crawl.walk(seeds.withColumnRenamed("url", "node"), edges, max_depth, self.settings.max_pages)
            told(progress=60.0)
            now = F.current_timestamp()
            asked = reached.withColumnRenamed("node", "url").join(found.withColumn("there", F.lit(True)), "url", "left")
            ok = F.coalesce("success", F.lit(False))
            asked = kept(asked.withColumn("ok", ok).withColumn("error", F.when(~ok, F.coalesce("error", F.lit("no content")))).drop("success", "parent"), "outcome")
            log = asked.select("url", "ok", "error", "depth", now.alias("started"), now.alias("ended"))
            content = asked.filter("ok").select(F.struct("depth", "page_id").alias("seq"), *columns)
        if not use_ai or self.settings.content_model is None:
            return Run(kept(content, "content"), log)
        one = self.settings
        options = {"batch_size": one.content_batch, "at_once": one.at_once, "retries": one.retries}
        if one.content_cache:
            enriched = enrich.process_saving(kept(content, "content"), one.content_model, one.content_cache, lambda rows, wave: kept(rows, f"enriched-{wave}"), one.waves, **options)
        else:
            enriched = kept(enrich.process(content, one.content_model, **options), "enriched")
        # Each row is its own page: the results stand beside what they were made of, whatever URLs repeat.
        new = F.when(F.col("processed"), F.col("result")).otherwise(F.col("content"))
        return Run(kept(enriched.select("seq", "url", "title", new.alias("content"), "depth", "metadata", "elements"), "content"), log, enriched)

    def _relevant(self, links: DataFrame, url: str) -> DataFrame:
        """The links that are relevant, by the cache of verdicts where it has them; new verdicts of a model are saved."""
        one = self.settings
        if not one.link_cache or one.link_model is None:
            return relevance.filter_links(links, url, one.relevance_threshold, one.link_model)
        known = cache.load(self.spark, one.link_cache, cache.LINK_CACHE)
        judged = kept(relevance.judged_links(links, url, one.link_model, known), "verdicts")
        fresh = judged.filter("method = 'ai'").select("cache_key", "is_relevant", "relevance_score", "reason", "method").join(known.select("cache_key"), "cache_key", "left_anti")
        cache.append(fresh, one.link_cache)
        return relevance.passing(judged, one.relevance_threshold).drop("cache_key")

    @staticmethod
    def project(url: str) -> str:
        host = re.sub(r"^[a-z]+://", "", url).split("/")[0].split(".")
        return (host[1] if host[0] == "www" and len(host) > 1 else host[0]).capitalize()

    def status(self, operation_id: str) -> dict:
        """The operation as it is now: of this driver, or by the events that an earlier one has left."""
        if operation_id in self.operations:
            return asdict(self.operations[operation_id])
        found = self.events.latest().filter(F.col("operation_id") == operation_id).first() if self.events else None
        if found is None:
            raise KeyError(operation_id)
        return {"id": operation_id} | found.asDict()

    def cancel(self, operation_id: str) -> bool:
        op = self.operations[operation_id]
        if op.status not in ("pending", "running"):
            return False
        self._changed(op, status="canceled")
        self.spark.sparkContext.cancelJobGroup(operation_id)
        return True

    def operations_table(self) -> DataFrame:
        rows = [{k: v for k, v in asdict(op).items() if k not in ("exports", "content_map", "statistics", "errors")} for op in self.operations.values()]
        return self.spark.createDataFrame(rows, "id string, url string, mode string, status string, progress double, started_at string, ended_at string, url_count long, error string")


# -- tools


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    properties: dict
    required: tuple[str, ...] = ()

    def __post_init__(self):
        if not re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", self.name):
            raise validation.InvalidRequest("tool names are snake_case")
        if len(self.description) < 10:
            raise validation.InvalidRequest("a description has 10 characters at least")
        if not self.properties:
            raise validation.InvalidRequest("a tool has parameters")

    def reference(self) -> dict:
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": dict(self.properties), "required": list(self.required)}}


TOOLS = (
    Tool("extract_document", "Crawl a documentation site and extract its pages.", {"url": {"type": "string"}, "mode": {"type": "string"}, "max_depth": {"type": "integer"}}, ("url",)),
    Tool("process_content", "Clean, summarise or restructure a piece of content.", {"content": {"type": "string"}, "processing_mode": {"type": "string"}}, ("content",)),
    Tool("export_content", "Export extracted pages as JSON or Markdown.", {"operation_id": {"type": "string"}, "format": {"type": "string"}}, ()),
    Tool("check_status", "Tell how far an operation has come.", {"operation_id": {"type": "string"}}, ("operation_id",)),
    Tool("detect_framework", "Guess the framework that made a documentation page.", {"html": {"type": "string"}}, ("html",)),
)


class ToolSet:
    def __init__(self, tools: tuple[Tool, ...] = TOOLS, version: str = "1.0.0"):
        if not re.fullmatch(r"\d+\.\d+\.\d+", version):
            raise validation.InvalidRequest("versions are semantic")
        names = [t.name for t in tools]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise validation.InvalidRequest(f"tools named twice: {', '.join(twice)}")
        self.tools, self.version = {t.name: t for t in tools}, version

    def listing(self) -> dict:
        return {"version": self.version, "tools": [t.reference() for t in self.tools.values()]}

    def check(self, name: str, parameters: dict) -> str | None:
        """What is wrong with a call, or None."""
        if name not in self.tools:
            return f"unknown tool {name!r}"
        missing = [p for p in self.tools[name].required if p not in parameters]
        return f"missing parameters: {', '.join(missing)}" if missing else None


# What the pages of documentation frameworks contain (an extension; there is no reference behaviour).
FRAMEWORK_MARKS = (
    ("docusaurus", r"(?i)docusaurus"), ("mkdocs", r"(?i)mkdocs"), ("sphinx", r"(?i)sphinx"), ("gitbook", r"(?i)gitbook"),
    ("vuepress", r"(?i)vuepress"), ("readthedocs", r"(?i)readthedocs"), ("jekyll", r"(?i)jekyll"), ("hugo", r'(?i)content="hugo'),
)
# Further marks, by framework, what they are, and their weight in hundredths; a name's is 50.
FRAMEWORK_SIGNS = (
    *((name, mark, "name", 50) for name, mark in FRAMEWORK_MARKS),
    *((name, rf"(?i)<meta[^>]+generator[^>]+{name}", "generator", 40) for name in ("docusaurus", "mkdocs", "sphinx", "vuepress", "jekyll", "hugo")),
    ("docusaurus", r"theme-doc-", "classes", 30), ("mkdocs", r"md-(content|nav|header)", "classes", 30), ("sphinx", r"(sphinxsidebar|toctree-wrapper|headerlink)", "classes", 30),
    ("readthedocs", r"(wy-nav-side|rst-content)", "classes", 30), ("vuepress", r"theme-default-content", "classes", 30), ("gitbook", r"book-summary", "classes", 30),
)

#: Words in small letters of which a page holds one where it has the mark; else the framework's name.
SIGN_WORDS = {
    r"theme-doc-": ("theme-doc-",), r"md-(content|nav|header)": ("md-",), r"(sphinxsidebar|toctree-wrapper|headerlink)": ("sphinxsidebar", "toctree-wrapper", "headerlink"),
    r"(wy-nav-side|rst-content)": ("wy-nav-side", "rst-content"), r"theme-default-content": ("theme-default-content",), r"book-summary": ("book-summary",),
}


def framework_evidence(html: str = "html") -> Column:
    """framework, confidence (0 to 1) and indicators of the framework whose marks in the page weigh most, of equals the first in the
    table of marks; ``unknown`` with 0 and no indicators where the page has none (or is null).

    A mark's pattern is tried only where the page, in small letters, holds one of the mark's words.  Page and marks are bound to
    lambda variables, so each is worked out once.
    """
    def shown(page: Column, low: Column) -> Column:
        tried = []
        for name, mark, label, weight in FRAMEWORK_SIGNS:
            hint = reduce(lambda a, b: a | b, [F.contains(low, F.lit(word)) for word in SIGN_WORDS.get(mark, (name,))])
            row = F.struct(F.lit(-names.index(name)).alias("place"), F.lit(name).alias("name"), F.lit(f"{label}:{name}").alias("indicator"), F.lit(weight).alias("weight"))
            tried.append(F.when(hint, F.when(page.rlike(mark), row)))
        return F.array_compact(F.array(*tried))

    def weighed(signs: Column) -> Column:
        rows = []
        for k, name in enumerate(names):
            own = F.filter(signs, _placed(-k))
            weight = F.aggregate(own, F.lit(0), lambda a, m: a + m["weight"])
            rows.append(F.struct(weight.alias("weight"), F.lit(-k).alias("place"), F.lit(name).alias("name"), F.transform(own, lambda m: m["indicator"]).alias("indicators")))
        return F.array_max(F.array(*rows))

    names = [name for name, _ in FRAMEWORK_MARKS]
    signs = _bound(F.coalesce(F.col(html), F.lit("")), lambda page: _bound(F.lower(page), lambda low: shown(page, low)))
    none = F.struct(F.lit("unknown").alias("framework"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("indicators"))

    def named(best: Column) -> Column:
        return F.struct(best["name"].alias("framework"), (F.least(best["weight"], F.lit(100)) / 100.0).alias("confidence"), best["indicators"].alias("indicators"))

    return _bound(signs, lambda found: F.when(F.size(found) > 0, _bound(weighed(found), named)).otherwise(none))


def _placed(place: int) -> Callable[[Column], Column]:
    return lambda sign: sign["place"] == place


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def detect_framework(html: str = "html") -> Column:
    """The first framework whose mark the page shows; ``unknown`` else."""
    out = F.when(F.lit(False), F.lit(""))
    for name, mark in FRAMEWORK_MARKS:
        out = out.when(F.col(html).rlike(mark), F.lit(name))
    return out.otherwise("unknown")

"""One fused pass over pages: each is parsed once and gives its content and its link candidates.

Strategies are plain functions in a registry, so a caller can add one (a function from (tree, url) to
a content record and one to link records).  A page never fails a task: errors become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagequarry import schemas
from pagequarry.functions import text

from . import content, dom, links
from .markdown import to_markdown

ContentStrategy = Callable[[dom.Element | None, str], dict]
LinkStrategy = Callable[[dom.Element, str], list[dict]]

#: Content and link strategy by mode; ``auto`` is the generic one.
STRATEGIES: dict[str, tuple[ContentStrategy, LinkStrategy]] = {
    "generic": (lambda page, url: content.generic(page), links.generic),
    "auto": (lambda page, url: content.generic(page), links.generic),
    "wiki": (content.wiki, links.wiki),
}


def select_strategy(mode: str) -> tuple[ContentStrategy, LinkStrategy]:
    if mode not in STRATEGIES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[mode]


def extract_page(html: str | None, url: str, strategy: tuple[ContentStrategy, LinkStrategy], with_content: bool = True, with_links: bool = True) -> dict:
    of_content, of_links = strategy
    out: dict = {}
    try:
        tree = dom.parse(html) if html else None
        if with_links:
            out["links"] = [] if tree is None else of_links(tree, url)  # before the content strategy cleans the tree
        if with_content:
            out |= of_content(tree, url)
    except (ValueError, RecursionError, AssertionError) as error:
        out |= {"links": []} | (content.failed(f"{type(error).__name__}: {error}") if with_content else {})
    return out


#: Bytes for each core below which pages are dealt out anew: so small a table may lie in one row group, which is one task.
SMALL = 64 << 20


def spread(pages: DataFrame) -> DataFrame:
    """A small table over all cores; a large one as its files are split, without an exchange."""
    if pages.isStreaming:
        return pages
    cores = pages.sparkSession.sparkContext.defaultParallelism
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return pages.repartition(2 * cores) if size < SMALL * cores else pages


def extract(pages: DataFrame, mode: str = "generic", with_content: bool = True, with_links: bool = True, batch_rows: int = 256) -> DataFrame:
    """page_id, url and, as asked for, title, content, metadata, elements, api_sections, success,
    extraction_method, error; and links.  What isn't asked for is neither made nor sent.
    """
    strategy = select_strategy(mode)

    def row(page: dict) -> dict:
        found = extract_page(page["html"], page["url"] or "", strategy, with_content, with_links)
        if with_content:
            found["metadata"] = list(found["metadata"].items())
        return found | {"page_id": page["page_id"], "url": page["url"]}

    return _passed(pages, row, schemas.page_result(with_content, with_links), batch_rows)


def page_markdown(pages: DataFrame, mode: str = "generic", links: bool = True, images: bool = True, batch_rows: int = 256) -> DataFrame:
    """page_id, markdown: as ``markdown("content")`` over ``extract``, without sending contents from one Python worker to another."""
    strategy = select_strategy(mode)

    def row(page: dict) -> dict:
        content = extract_page(page["html"], page["url"] or "", strategy, with_links=False)["content"]
        return {"page_id": page["page_id"], "markdown": to_markdown(content, links, images)}

    return _passed(pages, row, "page_id bigint, markdown string", batch_rows).select("page_id", text.markdown_postprocessed("markdown").alias("markdown"))


def _passed(pages: DataFrame, row: Callable[[dict], dict], ddl: str, batch_rows: int) -> DataFrame:
    """row(page_id, url, html) of each page; ``batch_rows`` pages are held as Python objects."""
    arrow = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, batch_rows):
                yield pa.RecordBatch.from_pylist([row(page) for page in batch.slice(k, batch_rows).to_pylist()], schema=arrow)
            del batch
            pa.default_memory_pool().release_unused()  # what Arrow holds unused else stays with the worker

    return spread(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))).mapInArrow(run, ddl)


def candidates(extracted: DataFrame) -> DataFrame:
    """One row per link candidate, with page_id and page_url."""
    return extracted.select("page_id", F.col("url").alias("page_url"), F.inline("links"))


def page_links(pages: DataFrame, mode: str = "generic") -> DataFrame:
    """The links of each page as its strategy returns them."""
    return links_of(candidates(extract(pages, mode, with_content=False)), mode)


def links_of(found: DataFrame, mode: str = "generic") -> DataFrame:
    """What a strategy makes of its candidates: deduplicated, merged, filtered, ordered.

    Candidates carry their page's URL; pages that share an id without sharing a URL would be taken for one.
    """
    found = links.by_page(found)
    if mode == "wiki":
        return links.ordered_wiki(links.documentation_only(links.merge_wiki(found)))
    return links.dedupe_then_filter(found)

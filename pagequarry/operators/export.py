"""Exports: pages as JSON and Markdown files.

Rendering is a projection to (file_name, text) rows; the sink is a Python data source whose tasks
write their own rows into the (shared) folder under temporary names and whose commit puts them in
place.  So a retried or lost task leaves no half-written file.  The file that holds all pages in order is inherently one
writer's work: it is streamed, one partition of sorted rows at a time.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagequarry.functions import text as T

from .markdown import markdown
from .relevance import numbered
from .shared import cut, kept

#: More pages than this are exported as a file each.
SINGLE_FILE_PAGES = 10


def numbered_pages(pages: DataFrame) -> DataFrame:
    """pages (seq, url, title, content, ...) with page_number and file_stem in the order of seq."""
    rows = numbered(pages, "seq").withColumn("page_number", T.page_number(F.col("row_ix") + 1)).drop("row_ix")
    return rows.withColumn("file_stem", F.concat("page_number", F.lit("_"), T.sanitized_filename(F.coalesce("title", F.lit("")))))


def json_pages(pages: DataFrame, project: str, pretty: bool = True) -> DataFrame:
    """A JSON file for each page; a page without a title is named after its number."""
    body = F.struct(*[c for c in ("url", "title", "content", "depth", "metadata", "elements") if c in pages.columns])
    rows = numbered(pages, "seq").withColumn("page_number", T.page_number(F.col("row_ix") + 1)).drop("row_ix")
    stem = F.concat("page_number", F.lit("_"), T.sanitized_filename(F.coalesce("title", F.concat(F.lit("page_"), F.col("page_number")))))
    name = F.concat(F.lit(f"{project}_pages/"), stem, F.lit(".json"))
    return rows.select(name.alias("file_name"), F.to_json(body, {"pretty": "true"} if pretty else {}).alias("text"), "url", "page_number")


def markdown_body(pages: DataFrame) -> Column:
    depth = F.when(F.col("depth").isNotNull(), F.concat(F.lit("*Depth: "), F.col("depth"), F.lit("*\n\n"))).otherwise(F.lit("")) if "depth" in pages.columns else F.lit("")
    return F.concat(F.lit("*Source: ["), F.col("url"), F.lit("]("), F.col("url"), F.lit(")*\n\n"), depth, markdown("content"))


def markdown_pages(pages: DataFrame, project: str) -> DataFrame:
    """A Markdown file for each page, with a link back to the index."""
    rows = pages if "file_stem" in pages.columns else numbered_pages(pages)
    own = F.col("markdown_body") if "markdown_body" in rows.columns else markdown_body(rows)
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), own, F.lit("\n\n[Back to Index](README.md)\n"))
    return rows.select(F.concat(F.lit(f"{project}_pages/"), "file_stem", F.lit(".md")).alias("file_name"), body.alias("text"), "url", "page_number")


def scalar_metadata(metadata: dict | None) -> str:
    lines = [f"- **{k}:** {v}" for k, v in (metadata or {}).items() if isinstance(v, (str, int, float, bool))]
    return "\n".join(lines)


def manifest(rendered: DataFrame) -> DataFrame:
    """file_name, size in bytes, url of each file."""
    return rendered.select("file_name", F.octet_length("text").cast("long").alias("size"), "url")


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count(F.lit(1)).alias("file_count"), F.count_distinct("url").alias("url_count"))


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> _Written:
        done = []
        for row in iterator:
            final = os.path.join(self.folder, row["file_name"])
            os.makedirs(os.path.dirname(final), exist_ok=True)
            part = f"{final}.{uuid.uuid4().hex}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(row["text"] or "")
            done.append((part, final, os.path.getsize(part)))
        return _Written(done)

    def commit(self, messages) -> None:
        for m in messages:
            for part, final, _ in m.files if m else []:
                os.replace(part, final)

    def abort(self, messages) -> None:
        for m in messages:
            for part, _, _ in m.files if m else []:
                if os.path.exists(part):
                    os.remove(part)


class PageFiles(DataSource):
    """``df.write.format("page_files").mode("append").save(folder)`` with columns file_name and text."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "file_name string, text string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_files(rendered: DataFrame, folder: str) -> None:
    rendered.sparkSession.dataSource.register(PageFiles)
    rendered.select("file_name", "text").write.format("page_files").mode("append").save(folder)


def safe_name(project: str) -> str:
    r"""A project's name as part of a path: each of <>:"/\|?* becomes _; stripped, cut to 100 characters; empty becomes untitled."""
    return re.sub(r'[<>:"/\\|?*]', "_", project).strip()[:100] or "untitled"


class _PlaceWriter(DataSourceWriter):
    """Each task writes its rows one after the other from its place on; a task that runs again writes the same bytes to the same place."""

    def __init__(self, options):
        self.part, self.final, self.between = options["path"], options["final"], options["between"].encode()
        self.places = {int(k): tuple(v) for k, v in json.loads(options["places"]).items()}

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        place, leads = self.places.get(TaskContext.get().partitionId(), (None, False))
        if place is not None:
            with open(self.part, "r+b") as f:
                f.seek(place)
                for k, row in enumerate(iterator):
                    f.write((b"" if leads and not k else self.between) + (row["text"] or "").encode())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        os.replace(self.part, self.final)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class PlacedText(DataSource):
    """``df.write.format("placed_text")`` with a column text, where each partition's place in the file is known (see ``placed``)."""

    @classmethod
    def name(cls) -> str:
        return "placed_text"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _PlaceWriter(self.options)


def check_shared(spark, folder: str) -> None:
    """That tasks see what the driver writes to the folder."""
    os.makedirs(folder, exist_ok=True)
    probe = os.path.join(folder, f".probe-{uuid.uuid4().hex}")

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.path.exists(probe)] * batch.num_rows)], names=["seen"])

    with open(probe, "w"):
        pass
    try:
        n = spark.sparkContext.defaultParallelism
        if not spark.range(0, n, 1, n).mapInArrow(seen, "seen boolean").agg(F.bool_and("seen")).first()[0]:
            raise ValueError(f"tasks don't see {folder}: exports need a folder that all machines share")
    finally:
        os.remove(probe)


def placed(path: str, head: str, rows: DataFrame, between: str, tail: str) -> int:
    """A single file of all rows (text) in the order of seq, written by the tasks that hold them; its size in bytes."""
    spark = rows.sparkSession
    spark.dataSource.register(PlacedText)
    ordered = cut(rows.select("seq", "text").repartitionByRange("seq").sortWithinPartitions("seq")).select("text")
    sums = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    places, at, gap, first = {}, len(head.encode()), len(between.encode()), True
    for row in sorted(sums.collect(), key=lambda r: r["part"]):  # one for each range
        places[row["part"]] = (at, first)
        at += row["size"] + gap * (row["n"] - first)
        first = False
    part, end = f"{path}.{uuid.uuid4().hex}.part", tail.encode()
    with open(part, "wb") as f:
        f.write(head.encode())
        f.seek(at)
        f.write(end)
    if places:
        ordered.write.format("placed_text").mode("append").option("final", path).option("between", between).option("places", json.dumps(places)).save(part)
    else:
        os.replace(part, path)
    return at + len(end)


def _indented(text: str, by: str) -> str:
    return text.replace("\n", "\n" + by)


def export_json(pages: DataFrame, folder: str, project: str, metadata: dict | None = None, pretty: bool = True) -> dict:
    """One file with every page; above ``SINGLE_FILE_PAGES`` a file for each page as well."""
    n, name = pages.count(), safe_name(project)
    os.makedirs(folder, exist_ok=True)
    head = json.dumps({"project": project, "page_count": n} | (metadata or {}), ensure_ascii=False, indent=2 if pretty else None, default=str)
    item = F.struct(*[c for c in ("url", "title", "content", "depth", "metadata") if c in pages.columns])
    rows = pages.select("seq", F.to_json(item, {"ignoreNullFields": "false"}).alias("text"))
    path, gap = os.path.join(folder, f"{name}.json"), "\n  " if pretty else ""
    head = "{" + gap + '"metadata": ' + (_indented(head, "  ") if pretty else head) + "," + gap + '"content": ['
    size = placed(path, head + ("\n    " if pretty and n else ""), rows, ",\n    " if pretty else ", ", (gap if n else "") + "]" + ("\n}" if pretty else "}"))
    files = [{"path": path, "size": size, "url_count": n}]
    if n > SINGLE_FILE_PAGES:
        rendered = kept(json_pages(pages, name, pretty), "json-pages")
        write_files(rendered, folder)
        sums = totals(manifest(rendered)).first()
        files.append({"path": os.path.join(folder, f"{name}_pages"), "size": int(sums["total_size"]), "url_count": int(sums["url_count"])})
    return {"format": "json", "files": files, "total_size": sum(x["size"] for x in files), "file_count": 1 + (n if n > SINGLE_FILE_PAGES else 0), "success": True}


def export_markdown(pages: DataFrame, folder: str, project: str, metadata: dict | None = None, contents: bool = True) -> dict:
    """One file with every page; above ``SINGLE_FILE_PAGES`` a file for each page and an index as well."""
    n, name = pages.count(), safe_name(project)
    os.makedirs(folder, exist_ok=True)
    head = [f"# {project}", "", "## Metadata", "", f"- **Pages:** {n}"] + ([scalar_metadata(metadata)] if scalar_metadata(metadata) else []) + ["", ""]
    path, title = os.path.join(folder, f"{name}.md"), F.coalesce("title", F.lit("Untitled"))
    # Each page is converted once, for the one file and for its own.
    pages = kept(numbered_pages(pages).withColumn("markdown_body", markdown_body(pages)), "markdown")
    rows = pages.select("seq", "page_number", F.concat(F.lit("## "), title, F.lit("\n\n"), "markdown_body").alias("text"))
    if contents and n > 1:  # the table of contents is a row for each page as well, ahead of the pages
        entry = F.concat(F.when(F.col("page_number").cast("int") > 1, F.lit("\n")).otherwise(""), F.lit("- ["), title, F.lit("](#"), T.anchor(title), F.lit(")"))
        listed = pages.select(F.struct(F.lit(0).alias("kind"), "seq").alias("seq"), entry.alias("text"))
        whole = rows.select(F.struct(F.lit(1).alias("kind"), "seq").alias("seq"), F.concat(F.lit("\n\n---\n\n"), "text").alias("text"))
        size = placed(path, "\n".join([*head, "## Table of Contents", "", ""]), listed.unionByName(whole), "", "\n")
    else:
        size = placed(path, "\n".join(head), rows.select("seq", "text"), "\n\n---\n\n", "\n")
    files, file_count = [{"path": path, "size": size, "url_count": n}], 1
    if n > SINGLE_FILE_PAGES:
        rendered = markdown_pages(pages, name)
        write_files(rendered, folder)
        index = os.path.join(folder, f"{name}_pages", "README.md")
        listed = pages.select("seq", F.concat(F.col("page_number").cast("int"), F.lit(". ["), title, F.lit("]("), F.col("file_stem"), F.lit(".md)")).alias("text"))
        index_size = placed(index, "\n".join([*head, "## Pages", "", ""]), listed, "\n", "\n")
        sums = totals(manifest(rendered)).first()
        files += [{"path": index, "size": index_size, "url_count": n}, {"path": os.path.dirname(index), "size": int(sums["total_size"]), "url_count": int(sums["url_count"])}]
        file_count += n + 1
    return {"format": "markdown", "files": files, "total_size": sum(x["size"] for x in files), "file_count": file_count, "success": True}


def export_content_map(pages: DataFrame, folder: str) -> dict:
    """content_map.json: the extracted pages by URL, as they are before any exporter."""
    os.makedirs(folder, exist_ok=True)
    item = F.struct(*[c for c in ("title", "content", "depth", "metadata", "elements") if c in pages.columns])
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("url").alias("u"))), r'^\{"u":|\}$', "")
    rows = pages.filter("url IS NOT NULL").select("seq", F.concat(quoted, F.lit(": "), F.to_json(item, {"ignoreNullFields": "false"})).alias("text"))
    path = os.path.join(folder, "content_map.json")
    return {"path": path, "size": placed(path, "{\n  ", rows, ",\n  ", "\n}\n")}


EXPORTERS: dict[str, Callable[..., dict]] = {"json": export_json, "markdown": export_markdown}


def select_exporters(kind: str) -> list[str]:
    if kind == "both":
        return ["json", "markdown"]
    if kind not in EXPORTERS:
        raise ValueError(f"unknown export format {kind!r}")
    return [kind]


def export_all(pages: DataFrame, folder: str, project: str, kind: str = "both", metadata: dict | None = None) -> list[dict]:
    """Every exporter for itself: one that fails doesn't keep the others from running."""
    out, names = [], select_exporters(kind)
    check_shared(pages.sparkSession, folder)
    for name in names:
        try:
            out.append(EXPORTERS[name](pages, folder, project, metadata))
        except Exception as error:
            out.append({"format": name, "success": False, "error": str(error)})
    return out

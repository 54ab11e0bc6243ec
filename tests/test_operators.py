"""Relational operators: dedupe, merge, crawl, cache, batches, exports, control, sources, streams."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import validation
from pagequarry.operators import control, crawl, enrich, export, links, pages, relevance
from pagequarry.sources import cache as cache_source
from pagequarry.sources import pages as page_source
from pagequarry.streaming import frontier


def test_dedupe_comes_before_the_filter(spark):
    rows = [(1, "https://x.org/", "https://x.org/a", "login", 0), (1, "https://x.org/", "https://x.org/a", "fine", 1), (1, "https://x.org/", "https://x.org/b", "b", 2)]
    df = spark.createDataFrame(rows, "page_id long, page_url string, url string, text string, seq int")
    assert [r["url"] for r in links.dedupe_then_filter(df).collect()] == ["https://x.org/b"]


def test_walk_has_limits_and_survives_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert sorted((r["node"], r["depth"]) for r in crawl.walk(seeds, edges, 3).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert [r["node"] for r in crawl.walk(seeds, edges, 9, max_pages=2).collect()] == [0, 1]


def test_walk_without_a_depth_reaches_the_fixed_point(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(15, 0), (40, 41)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (40,)], "node long")
    found = {r["node"]: r["depth"] for r in crawl.walk(seeds, edges, None).collect()}
    assert found == {i: i for i in range(16)} | {40: 0, 41: 1}


def test_fetched_and_failed(spark):
    pages_ = spark.createDataFrame([("a", "<p>", 200), ("b", "x", 404), ("c", "", 200)], "url string, html string, status int")
    ok, failed = crawl.fetched(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string"), pages_)
    assert [r["url"] for r in ok.collect()] == ["a"]
    assert {r["url"]: r["error"] for r in failed.collect()} == {"b": "HTTP 404", "c": "no content", "d": "no content"}


def test_enrich_isolates_a_failing_batch(spark):
    def model(contents, mode, kind):
        if any("bad" in c for c in contents):
            raise RuntimeError("refused")
        return [c.upper() for c in contents]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "content string").coalesce(1)
    got = {r["content"]: (r["result"], r["processed"]) for r in enrich.process(df, model, batch_size=1).collect()}
    assert got == {"a": ("A", True), "bad": ("bad", False), "c": ("C", True)}


def test_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache_source.load(spark, path).count() == 0
    df = spark.createDataFrame([("a",), ("b",)], "content string")
    done = enrich.process(df, lambda c, m, k: [x.upper() for x in c])
    cache_source.append(enrich.new_cache_rows(done), path)
    again = enrich.process(df, lambda c, m, k: 1 / 0, cache=cache_source.load(spark, path))
    assert {(r["result"], r["cached"]) for r in again.collect()} == {("A", True), ("B", True)}
    assert enrich.cache_stats(again).first()["hit_rate"] == 100.0
    cache_source.clear(spark, path)
    assert cache_source.load(spark, path).count() == 0


def test_relevance_model_fallback_and_cache(spark):
    rows = [("https://x.org/docs/a", "https://x.org/", None), ("https://x.org/blog", "https://x.org/", None), ("https://x.org/blog/b", "https://x.org/", "near")]
    df = spark.createDataFrame(rows, "url string, page_url string, context string")

    def broken(frame: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("down")

    got = {r["url"]: (r["is_relevant"], r["method"]) for r in relevance.analyzed(df, broken).collect()}
    assert got["https://x.org/docs/a"] == (True, "pattern_matching_fallback")
    assert got["https://x.org/blog"] == (False, "pattern_matching")
    cached = spark.createDataFrame([("https://x.org/docs/a|https://x.org/", False, 0.1, "c", "ai")], cache_source.LINK_CACHE)
    got = {r["url"]: r["reason"] for r in relevance.analyzed(df, broken, cached).collect()}
    assert got["https://x.org/docs/a"] == "c"


def test_batches_are_contiguous(spark):
    got = [r["batch_id"] for r in relevance.batches(spark.range(25).repartition(5), "id", 20).orderBy("id").collect()]
    assert got == [0] * 20 + [1] * 5


def content_map(spark, n):
    rows = [(i, f"https://example.com/page{i}", f"Page {i}", f"<h1>Page {i}</h1><p>Text <b>{i}</b></p>", i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, url string, title string, content string, depth int")


def test_small_exports_are_single_files(spark, tmp_path):
    out = export.export_all(content_map(spark, 3), str(tmp_path), "demo", "both", {"version": "1", "nested": {"a": 1}})
    assert [x["success"] for x in out] == [True, True]
    data = json.loads((tmp_path / "demo.json").read_text())
    assert [p["url"] for p in data["content"]] == [f"https://example.com/page{i}" for i in range(3)] and data["metadata"]["nested"] == {"a": 1}
    text = (tmp_path / "demo.md").read_text()
    for piece in ("# demo", "## Metadata", "## Table of Contents", "[Page 1](#page-1)", "## Page 1", "*Depth: 1*", "**1**"):
        assert piece in text
    assert "nested" not in text


def test_large_exports_are_a_file_each(spark, tmp_path):
    out = export.export_all(content_map(spark, 20), str(tmp_path), "demo", "both")
    names = sorted(os.listdir(tmp_path / "demo_pages"))
    assert all(x["success"] for x in out), out
    assert len([n for n in names if n.endswith(".md")]) == 21 and len([n for n in names if n.endswith(".json")]) == 20
    assert names[0] == "001_Page 0.json" and "Back to Index" in (tmp_path / "demo_pages" / "001_Page 0.md").read_text()
    assert not [n for n in names if n.endswith(".part")] and sorted(os.listdir(tmp_path)) == ["demo.json", "demo.md", "demo_pages"]
    # The main files hold every page as well, in order.
    data = json.loads((tmp_path / "demo.json").read_text())
    assert [p["url"] for p in data["content"]] == [f"https://example.com/page{i}" for i in range(20)] and data["metadata"]["page_count"] == 20
    text = (tmp_path / "demo.md").read_text()
    assert [x for x in text.split("\n") if x.startswith("## Page ")] == [f"## Page {i}" for i in range(20)] and text.count("- [Page") == 20
    assert "\n1. [Page 0](001_Page 0.md)\n2. " in (tmp_path / "demo_pages" / "README.md").read_text()


def test_exports_of_odd_projects_titles_and_of_nothing(spark, tmp_path):
    rows = [(i, f"u{i}", None, None, None) for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, url string, title string, content string, depth int")
    out = export.export_all(df, str(tmp_path / "a"), "a/b: c?", "both")
    assert all(x["success"] for x in out), out
    assert sorted(os.listdir(tmp_path / "a")) == ["a_b_ c_.json", "a_b_ c_.md", "a_b_ c__pages"]
    assert "001_page_001.json" in os.listdir(tmp_path / "a" / "a_b_ c__pages")
    out = export.export_all(df.limit(0), str(tmp_path / "b"), "none", "both")
    assert all(x["success"] for x in out) and json.loads((tmp_path / "b" / "none.json").read_text())["content"] == []
    for pretty in (True, False):
        export.export_json(df.limit(2), str(tmp_path / "c"), "p", {"k": {"a": [1]}}, pretty)
        assert json.loads((tmp_path / "c" / "p.json").read_text())["metadata"]["k"] == {"a": [1]}


def test_content_map(spark, tmp_path):
    df = spark.createDataFrame([(0, 'https://x.org/"a"', "T", "<p>\n</p>", 0), (1, "u", None, None, 1)], "seq long, url string, title string, content string, depth int")
    export.export_content_map(df, str(tmp_path))
    assert json.loads((tmp_path / "content_map.json").read_text()) == {'https://x.org/"a"': {"title": "T", "content": "<p>\n</p>", "depth": 0}, "u": {"title": None, "content": None, "depth": 1}}


def test_exporters_are_isolated(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(export.EXPORTERS, "json", lambda *a: 1 / 0)
    out = export.export_all(content_map(spark, 2), str(tmp_path), "demo", "both")
    assert [x["success"] for x in out] == [False, True]
    with pytest.raises(ValueError):
        export.select_exporters("pdf")


PAGES = [
    (0, "https://example.com/docs/", "<nav><a href='/docs/a'>A</a><a href='/docs/b'>B</a></nav><article><h1>Docs</h1><p>x</p></article>"),
    (1, "https://example.com/docs/a", "<nav><a href='/docs/c'>C</a></nav><article><h1>A</h1></article>"),
    (2, "https://example.com/docs/b", "<article><h1>B</h1></article>"),
    (3, "https://example.com/docs/c", "<article><h1>C</h1></article>"),
]


def test_pipeline_runs_and_reports(spark, tmp_path):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    line = control.Pipeline(spark, table)
    out = line.run("https://example.com/docs/", output_dir=str(tmp_path), max_depth=1)
    assert out["status"] == "completed" and out["url_count"] == 3, out
    assert json.loads((tmp_path / "operation_info.json").read_text())["status"] == "completed"
    assert line.run("https://example.com/docs/", max_depth=2)["url_count"] == 4
    assert line.run("https://example.com/docs/", mode="nope")["status"] == "failed"
    assert line.status(out["operation_id"])["progress"] == 100.0
    with pytest.raises(KeyError):
        line.status("ex_none")
    assert line.operations_table().count() == 3


@pytest.mark.parametrize("bad", [{"url": "nope"}, {"url": "https://x.org", "max_depth": 0}, {"url": "https://x.org", "max_depth": 11}, {"url": "https://x.org", "concurrency": 11}, {"url": "https://x.org", "filters": {"x": []}}])
def test_extract_requests_are_checked(bad):
    with pytest.raises(validation.InvalidRequest):
        validation.ExtractRequest(**bad)


def test_requests():
    assert validation.ExtractRequest("https://x.org", concurrency=1).concurrency == 3
    assert validation.ExtractRequest("https://x.org", parallel=False).concurrency == 1
    assert validation.ProcessRequest("<p>a</p>").warnings == ["fragment"]
    for make in (lambda: validation.ProcessRequest(""), lambda: validation.ProcessRequest("a" * 100_001), validation.ExportRequest, lambda: validation.StatusRequest("abc123")):
        with pytest.raises(validation.InvalidRequest):
            make()


def test_tools():
    tools = control.ToolSet()
    assert len(tools.listing()["tools"]) == 5
    assert tools.check("extract_document", {}) == "missing parameters: url" and tools.check("extract_document", {"url": "u"}) is None
    assert "unknown" in tools.check("x", {})
    with pytest.raises(validation.InvalidRequest):
        control.Tool("BadName", "long enough text", {"a": {}})
    with pytest.raises(validation.InvalidRequest):
        control.ToolSet((control.TOOLS[0], control.TOOLS[0]))


def fake_fetch(url, timeout):
    return ("<p>ok</p>", 200) if "ok" in url else ("", 500)


def test_a_run_parses_each_page_and_asks_the_model_for_each_content_once(spark, tmp_path):
    counted = str(tmp_path / "counted")

    def content_of(tree, url):
        with open(counted, "a") as f:
            f.write("parse\n")
        return pages.content.generic(tree)

    def model(contents, mode, kind):
        with open(counted, "a") as f:
            f.write("model\n" * len(contents))
        return [c.upper() for c in contents]

    pages.STRATEGIES["counted"] = (content_of, pages.links.generic)
    try:
        table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
        line = control.Pipeline(spark, table, control.Settings(content_model=model, relevance_threshold=0.5))
        out = line.run("https://example.com/docs/", "counted", str(tmp_path / "out"), max_depth=3, use_ai=True)
    finally:
        del pages.STRATEGIES["counted"]
    assert out["status"] == "completed" and out["url_count"] == 4 and all(x["success"] for x in out["exports"]), out
    lines = open(counted).read().split()
    assert lines.count("parse") == len(PAGES) and lines.count("model") == 4
    found = json.loads((tmp_path / "out" / "content_map.json").read_text())
    assert len(found) == 4 and "<H1>DOCS</H1>" in found["https://example.com/docs/"]["content"]
    assert json.loads((tmp_path / "out" / "operation_info.json").read_text())["content_map"].endswith("content_map.json")


def test_links_are_filtered_as_a_chain(spark):
    page = "<p>" + "about " * 30 + "<a href='/docs/a'>The API</a> and more</p>"
    rows = [("/docs/a", "https://x.org/p", "P", page), ("https://api.x.org/b", "https://x.org/p", "P", page), ("https://y.org/docs/a", "https://x.org/p", "P", page), ("/blog/a", "https://x.org/p", "P", page)]
    df = spark.createDataFrame(rows, "url string, page_url string, page_title string, page_content string")

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        near = frame["context"].fillna("").str.contains("and more") & (frame["sample"].str.len() <= 1003)
        return pd.DataFrame({"is_relevant": near, "relevance_score": near.map({True: 0.9, False: 0.1}), "reason": frame["link_text"]})

    got = relevance.filter_links(df, "https://x.org/", 0.7, model).collect()
    assert [(r["url"], r["link_text"], r["reason"], r["method"]) for r in got] == [("https://x.org/docs/a", "The API", "The API", "ai")]
    assert [r["url"] for r in relevance.filter_links(df, "https://x.org/").collect()] == ["https://x.org/docs/a"]


def test_frontier_links_lead_one_level_down(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("x", "y", 0)], "src string, dst string, link_seq int")
    got = crawl.frontier_links(spark.createDataFrame([("a",)], "node string"), edges, 2).collect()
    assert sorted(tuple(r) for r in got) == [("b", 2, "a", 0), ("c", 2, "a", 1)]


def test_local_folders_serve_local_masters_only(spark, monkeypatch):
    from types import SimpleNamespace

    from pagequarry.operators import shared

    for master, fails in (("local[4]", False), ("spark://h:7077", True), ("local-cluster[2,1,1024]", True)):
        session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
        if fails:
            with pytest.raises(ValueError):
                shared.shared_folder(session)
        else:
            assert os.path.isdir(shared.shared_folder(session))


def test_live_source(spark):
    reader = page_source._Reader({"urls": "https://a.x/ok1\nhttps://a.x/ok2\nhttps://b.x/no", "batchSize": "1", "delay": "0"})
    assert [len(p.urls) for p in reader.partitions()] == [2, 1]  # all of a host's in one task
    reader.urls = ["http://127.0.0.1:9/none"]
    assert [x[2] for p in reader.partitions() for x in reader.read(p)] == [500]


def test_stream_of_links_visits_each_once(spark, tmp_path):
    rows = spark.createDataFrame([("https://x.org/a", 0), ("https://x.org/a", 0), ("https://x.org/b", 9)], "url string, depth long")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        run = frontier.first_visits(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert [(r["host"], r["url"], r["depth"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("x.org", "https://x.org/a", 0)]
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stream_gives_the_least_depths(spark, tmp_path):
    rows = spark.createDataFrame([("https://x.org/a", 1), ("https://x.org/a", 0), ("https://x.org/b", 9)], "url string, depth long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = frontier.least_depths(stream).writeStream.format("memory").queryName("depths").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["url"], r["depth"]) for r in spark.sql("SELECT * FROM depths").collect()) == [("https://x.org/a", 0), ("https://x.org/b", 9)]


def test_stats_of_a_run_with_models(spark):
    at = "2024-01-01 00:00:0"
    log = spark.createDataFrame([("a", True, at + "0", at + "2"), ("b", False, at + "1", at + "4")], "url string, ok boolean, started string, ended string")
    log = log.withColumn("started", F.to_timestamp("started")).withColumn("ended", F.to_timestamp("ended"))
    enriched = spark.createDataFrame([(True, False, 0), (True, False, 0), (True, False, 1), (True, True, None), (False, False, 2)], "processed boolean, cached boolean, batch_id int")
    got = crawl.run_stats(log, enriched).first().asDict()
    assert got == {"discovered": 2, "processed": 1, "failed": 1, "duration_s": 4.0, "pages_per_second": 0.25, "ai_processed": 3, "batches_processed": 2, "cache_hits": 1}


def test_parallel_progress_is_capped_until_all_are_done(spark):
    shown = lambda oks: crawl.parallel_progress(spark.createDataFrame([(o,) for o in oks], "ok boolean")).first()[0]
    assert shown([True, False, None, None]) == 50.0 and shown([True] * 1999 + [None]) == 99.9 and shown([True, False]) == 100.0


def test_pruned_urls_are_not_fetched(spark):
    rows = spark.createDataFrame([("https://x.org/a.png",), ("https://x.org/a.CSS?v=1",), ("https://x.org/a.html",)], "url string")
    assert [r["url"] for r in page_source.worth_fetching(rows).collect()] == ["https://x.org/a.html"]


def test_extract_stream_and_foreach_batch(spark, tmp_path):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    run = frontier.enrich_stream(frontier.extract_stream(stream).select("page_id", "title"), lambda b: b.withColumn("upper", F.upper("title")), str(tmp_path / "out"), str(tmp_path / "c"))
    run.awaitTermination()
    assert {r["upper"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"DOCS", "A", "B", "C"}


def test_pages_with_nulls_are_rows(spark):
    table = spark.createDataFrame([(1, None, None), (None, "https://x.org/a", "<article><h1>t</h1></article>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["success"], r["title"]) for r in pages.extract(table).collect()}
    assert got == {1: (False, ""), None: (True, "t")}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from pagequarry import cli

    monkeypatch.setenv("PAGEQUARRY_LOG_PATH", str(tmp_path / "log"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    code = cli.main(["https://example.com/docs/", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out"), "--max-depth", "1", "--format", "json"])
    assert code == 0 and json.loads(capsys.readouterr().out)["url_count"] == 3
    assert (tmp_path / "out" / "Example.json").exists()
    assert cli.main(["nope"]) == 2
    (name,) = os.listdir(tmp_path / "log")
    lines = [json.loads(x) for x in (tmp_path / "log" / name).read_text().splitlines()]
    assert [x["level"] for x in lines] == ["INFO", "ERROR"] and lines[0]["context"]["status"] == "completed"

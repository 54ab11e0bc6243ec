"""Single files written by tasks; runs with caches, failures, statistics, status and events; calls in flight; Markdown of odd markup."""

import json
import os
import time

import pytest

from pagequarry.operators import control, enrich, export, live
from pagequarry.operators.markdown import to_markdown
from pagequarry.sources import cache


@pytest.mark.parametrize("n", [0, 1, 2, 137])
def test_a_single_file_is_what_one_writer_would_write(spark, tmp_path, n):
    rows = [(k, f"row {k} é\n" * (k % 5)) for k in range(n)]
    df = spark.createDataFrame([(k, t if k % 7 else None) for k, t in rows], "seq long, text string").repartition(3)
    path = str(tmp_path / "out.txt")
    size = export.placed(path, "head é|", df, "<between>", "|tail")
    wanted = "head é|" + "<between>".join(t if k % 7 else "" for k, t in rows) + "|tail"
    assert open(path, encoding="utf-8").read() == wanted and size == len(wanted.encode()) == os.path.getsize(path)
    assert os.listdir(tmp_path) == ["out.txt"]


def test_exports_need_a_shared_folder(spark, tmp_path, monkeypatch):
    export.check_shared(spark, str(tmp_path))
    assert not os.listdir(tmp_path)


def test_each_page_is_converted_once(spark, tmp_path, monkeypatch):
    from pagequarry.operators import markdown

    counted = str(tmp_path / "n")

    def convert(html, links=True, images=True, real=to_markdown):
        with open(counted, "a") as f:
            f.write("x")
        return real(html, links, images)

    monkeypatch.setattr(markdown, "to_markdown", convert)
    rows = [(k, f"u{k}", f"P {k}", f"<p>text <b>{k}</b></p>", 0) for k in range(14)]
    df = spark.createDataFrame(rows, "seq long, url string, title string, content string, depth int")
    export.export_markdown(df, str(tmp_path / "out"), "demo")
    assert len(open(counted).read()) == 14
    text = (tmp_path / "out" / "demo.md").read_text()
    assert text.index("- [P 13](#p-13)") < text.index("\n\n---\n\n## P 0\n") and text.endswith("text **13**\n") and text.count("\n\n---\n\n") == 14


def test_markdown_loses_no_text():
    assert to_markdown("<ul><ul><li>x</li></ul></ul>") == "  * x"
    for words in ("loose", "**text**", "a", "b", "boxed"):
        assert words in to_markdown("<ul>loose <b>text</b><li>a<ol><li>b</ol></li><div>boxed</div></ul>")
    assert to_markdown("<div>" * 3000 + "deep <b>text</b>") == "deep **text**"
    assert "deep" in to_markdown("<span>" * 5000 + "deep")
    assert to_markdown("<ul><li>" * 800 + "deep").strip().endswith("* deep")


def test_calls_are_in_flight_together_and_keep_their_order(spark):
    def model(contents, mode, kind):
        time.sleep(0.3)
        if contents == ["bad"]:
            raise RuntimeError("refused")
        return [c.upper() for c in contents]

    began, batches = time.perf_counter(), [[x] for x in "ab"] + [["bad"]] + [[x] for x in "cdefg"]
    got = list(enrich.in_flight(iter(batches), lambda b: enrich._asked(model, b, "clean", "", 0, 0), 8))
    assert time.perf_counter() - began < 1.2  # eight calls of 0.3 s
    assert [b for b, _ in got] == batches and [r for _, (r, _) in got] == [["A"], ["B"], ["bad"], ["C"], ["D"], ["E"], ["F"], ["G"]]
    assert [e for _, (_, e) in got] == [None, None, "refused", *[None] * 5]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(["a", "b", "bad", "c"])], "k long, content string").coalesce(1)
    known = spark.createDataFrame([("nothing", "x")], cache.CONTENT_CACHE)
    for options in ({}, {"cache": known}):
        rows = {r["k"]: (r["result"], r["processed"], r["error"]) for r in enrich.process(df, model, batch_size=1, at_once=4, **options).collect()}
        assert rows == {0: ("A", True, None), 1: ("B", True, None), 2: ("bad", False, "refused"), 3: ("C", True, None)}


def test_a_call_is_tried_again():
    calls = []

    def model(contents, mode, kind):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("later")
        return contents

    assert enrich._asked(model, ["a"], "clean", "", 3, 0.001) == (["a"], None) and len(calls) == 3


def test_cache_takes_the_latest_sets_corrupt_files_aside_and_compacts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), cache.CONTENT_CACHE)
    cache.append(rows(("a", "1"), ("b", "1")), path)
    cache.append(rows(("a", "2"), ("a", "2")), path)
    read = lambda: sorted(map(tuple, cache.load(spark, path).collect()))
    assert read() == [("a", "2"), ("b", "1")] and cache.snapshots(spark, path) == [1, 2]
    cache.compact(spark, path)
    assert cache.snapshots(spark, path) == [3] and read() == [("a", "2"), ("b", "1")]
    cache.append(rows(("c", "3")), path)
    for name in os.listdir(tmp_path / "cache" / "snapshot=3"):
        if name.endswith(".parquet"):
            (tmp_path / "cache" / "snapshot=3" / name).write_bytes(b"not a table")
            (tmp_path / "cache" / "snapshot=3" / f".{name}.crc").unlink(missing_ok=True)
    assert read() == [("c", "3")]  # misses, not an error
    monkeypatch.setattr(cache, "SNAPSHOTS", 2)
    cache.append(rows(("d", "4")), path)
    assert read() == [("c", "3"), ("d", "4")] and len(cache.snapshots(spark, path)) == 1
    (tmp_path / "file").write_text("no folder")
    assert cache.load(spark, str(tmp_path / "file")).count() == 0 == cache.load(spark, str(tmp_path / "none")).count()


def test_pages_of_one_url_keep_their_own_contents(spark):
    rows = spark.createDataFrame([(1, "u", "first"), (2, "u", "second"), (3, "v", "third")], "seq long, url string, content string")
    done = enrich.process(rows, lambda c, m, k: [x.upper() for x in c])
    got = sorted((r["seq"], r["content"]) for r in enrich.written_back(rows, done, "seq").collect())
    assert got == [(1, "FIRST"), (2, "SECOND"), (3, "THIRD")]
    assert enrich.written_back(rows, done).count() == 3


def page(title, *links):
    anchors = "".join(f'<a href="{x}">to {x}</a>' for x in links)
    return f"<html><body><nav>{anchors}</nav><article><h1>{title}</h1><p>Words of {title}.</p></article></body></html>"


SITE = {"https://e.org/": page("Home", "/a", "/b", "/gone"), "https://e.org/a": page("A", "/b", "/c"), "https://e.org/b": page("B"), "https://e.org/c": page("C")}


def test_a_run_keeps_caches_failures_statistics_status_and_events(spark, tmp_path):
    counted, seen = str(tmp_path / "calls"), []

    def model(contents, mode, kind):
        with open(counted, "a") as f:
            f.write("x" * len(contents))
        return [c.upper() for c in contents]

    def settings():
        table = spark.createDataFrame(list(SITE.items()), "url string, html string")
        return control.Settings(fetch=live.reading(table), content_model=model, content_cache=str(tmp_path / "cache"), events=str(tmp_path / "events"), waves=2, relevance_threshold=0.0)

    line = control.Pipeline(spark, None, settings())
    changed = line._changed
    line._changed = lambda op, **values: (changed(op, **values), seen.append((op.status, op.progress)))
    out = line.run("https://e.org/", output_dir=str(tmp_path / "out"), use_ai=False)
    assert out["status"] == "completed" and out["url_count"] == 4, out
    info = json.loads((tmp_path / "out" / "operation_info.json").read_text())
    counts = {k: info["statistics"][k] for k in ("discovered", "processed", "failed", "ai_processed", "cache_hits")}
    assert counts == {"discovered": 5, "processed": 4, "failed": 1, "ai_processed": 0, "cache_hits": 0}
    errors = [json.loads(x) for name in os.listdir(tmp_path / "out" / "errors") if name.endswith(".json") for x in open(tmp_path / "out" / "errors" / name)]
    assert errors == [{"url": "https://e.org/gone", "error": "HTTP 404"}]
    assert any(s == "running" and 0 < p < 100 for s, p in seen) and seen[-1] == ("completed", 100.0)
    # The status outlives the pipeline that ran.
    later = control.Pipeline(spark, None, settings())
    assert {k: later.status(out["operation_id"])[k] for k in ("status", "progress", "url_count", "processed", "failed")} == {"status": "completed", "progress": 100.0, "url_count": 4, "processed": 4, "failed": 1}
    with pytest.raises(KeyError):
        later.status("ex_none")


def test_a_second_run_asks_for_nothing_again(spark, tmp_path):
    counted = str(tmp_path / "calls")

    def model(contents, mode, kind):
        with open(counted, "a") as f:
            f.write("x" * len(contents))
        return [c.upper() for c in contents]

    table = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(SITE.items())], "page_id long, url string, html string")
    settings = control.Settings(content_model=model, content_cache=str(tmp_path / "cache"), waves=2, relevance_threshold=0.0)
    found = [control.Pipeline(spark, table, settings).collect("https://e.org/", "generic", 5, True) for _ in range(2)]
    contents = [sorted(r["content"] for r in x.content.collect()) for x in found]
    assert contents[0] == contents[1] and len(contents[0]) > 0 and all(c == c.upper() for c in contents[0])
    assert len(open(counted).read()) == len(contents[0])
    assert found[1].statistics()["cache_hits"] == len(contents[0]) and found[1].statistics()["ai_processed"] == 0


def test_framework_evidence(spark):
    rows = ['<meta name="generator" content="MkDocs 1">', "built with mkdocs", '<div class="wy-nav-side">sphinx', "nothing", None]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(rows)], "k long, html string").select("k", control.framework_evidence().alias("e")).select("k", "e.*")
    got = {r["k"]: (r["framework"], r["confidence"], r["indicators"]) for r in df.collect()}
    assert got == {0: ("mkdocs", 0.9, ["name:mkdocs", "generator:mkdocs"]), 1: ("mkdocs", 0.5, ["name:mkdocs"]), 2: ("sphinx", 0.5, ["name:sphinx"]), 3: ("unknown", 0.0, []), 4: ("unknown", 0.0, [])}
    events = spark.createDataFrame([("a", 0, "pending"), ("a", 1, "running"), ("b", 0, "pending")], "operation_id string, seq long, status string")
    assert {(r["operation_id"], r["status"], r["events"]) for r in control.latest_states(events).collect()} == {("a", "running", 2), ("b", "pending", 1)}

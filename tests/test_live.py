"""The crawl that fetches as it goes, pacing over micro-batches, live status."""

import collections
import threading
import time

from pyspark.sql import functions as F

from pagequarry.operators import live
from pagequarry.streaming import frontier, pacing, status


def site(n=30, hosts=3):
    """Pages of a binary tree on each host, with links back, repeated ones, foreign ones, an asset and a dead link."""
    pages = {}
    for h in range(hosts):
        base = f"https://h{h}.org"
        for i in range(n // hosts):
            links = [f"/p{2 * i + 1}", f"/p{2 * i + 2}", f"/p{i // 3}", f"/p{2 * i + 1}", "/style.css", f"https://h{(h + 1) % hosts}.org/p0", "#"]
            if i == 2:
                links.append("/gone")
            anchors = "".join(f'<a href="{x}">to {x}</a>' for x in links)
            pages[f"{base}/p{i}"] = f"<html><head><title>{h} {i}</title></head><body><nav>{anchors}</nav><article><h1>Page {i}</h1><p>Text of page {i} at host {h}.</p></article></body></html>"
    return pages


def walked(pages, seeds, max_depth=None):
    depth, queue = {s: 0 for s in seeds}, collections.deque(seeds)
    while queue:
        url = queue.popleft()
        if url not in pages or max_depth is not None and depth[url] >= max_depth:
            continue
        host, i = url.rsplit("/p", 1)
        i = int(i)
        for to in [f"{host}/p{2 * i + 1}", f"{host}/p{2 * i + 2}", f"{host}/p{i // 3}"] + ([f"{host}/gone"] if i == 2 else []):
            if to not in depth:
                depth[to] = depth[url] + 1
                queue.append(to)
    return depth


def seeds_of(spark, hosts=3):
    return spark.createDataFrame([(f"h{h}.org/p0",) for h in range(hosts)], "url string")


def counting(pages, path):
    def fetch(url, timeout):
        with open(path, "a") as f:
            f.write(f"{time.time()} {url}\n")
        return (pages[url], 200) if url in pages else ("", 404)

    return fetch


def test_each_page_is_fetched_once_at_its_depth(spark, tmp_path):
    pages, log = site(), str(tmp_path / "log")
    told = []
    found = live.crawl_site(seeds_of(spark), live.fetching(counting(pages, log), live.Pace(delay=0)), max_depth=None, on_level=told.append)
    expected = walked(pages, [f"https://h{h}.org/p0" for h in range(3)])
    got = {r["url"]: r["depth"] for r in found.table().collect()}
    assert got == expected
    asked = [line.split()[1] for line in open(log)]
    assert sorted(asked) == sorted(expected)  # once each
    assert {r["url"]: r["error"] for r in found.log().filter("NOT ok").collect()} == {u: "HTTP 404" for u in expected if u not in pages}
    numbers = live.statistics(found).first()
    assert (numbers["processed"], numbers["failed"], numbers["discovered"]) == (30, len(expected) - 30, len(expected))
    assert told[-1]["progress"] == 100.0 and told[-1]["processed"] == 30 and 0 < told[0]["progress"] < 100
    assert [t["progress"] for t in told] == sorted(t["progress"] for t in told) or len(told) > 3
    titles = {r["url"]: r["title"] for r in found.pages().collect()}
    assert titles["https://h1.org/p4"] == "Page 4"


def test_limits_follow_the_queue(spark, tmp_path):
    pages = site()
    table = spark.createDataFrame(list(pages.items()), "url string, html string")
    found = live.crawl_site(seeds_of(spark), live.reading(table), max_depth=1)
    assert {r["url"]: r["depth"] for r in found.table().collect()} == walked(pages, [f"https://h{h}.org/p0" for h in range(3)], 1)
    found = live.crawl_site(seeds_of(spark, 1), live.reading(table), max_depth=None, max_pages=5)
    assert [r["url"].rsplit("/", 1)[1] for r in found.table().orderBy("place").collect()] == ["p0", "p1", "p2", "p3", "p4"]
    stopped = live.crawl_site(seeds_of(spark), live.reading(table), max_depth=None, canceled=lambda: True)
    assert stopped.levels == 0 and set(stopped.table().columns) == set(found.table().columns) and stopped.log().count() == stopped.pages().count() == 0
    assert live.crawl_site(seeds_of(spark).limit(0), live.reading(table)).table().count() == 0


def test_a_host_is_asked_at_its_pace_and_again_after_errors(spark, tmp_path):
    log = str(tmp_path / "log")
    calls = str(tmp_path / "calls")

    def fetch(url, timeout):
        with open(log, "a") as f:
            f.write(f"{time.time()} {url}\n")
        if url.endswith("bad"):
            with open(calls, "a") as f:
                f.write("x")
            if len(open(calls).read()) < 2:
                raise OSError("reset")
        return "<p>x", 200

    rows = spark.createDataFrame([(f"https://a.org/{k}",) for k in (1, 2, 3)] + [("https://b.org/bad",)], "url string")
    got = live.fetching(fetch, live.Pace(delay=0.2, jitter=0, retries=2))(rows).collect()
    assert {(r["url"], r["status"]) for r in got} == {(f"https://a.org/{k}", 200) for k in (1, 2, 3)} | {("https://b.org/bad", 200)}
    times = sorted(float(line.split()[0]) for line in open(log) if "a.org" in line)
    assert all(b - a >= 0.19 for a, b in zip(times, times[1:])) and len(open(calls).read()) == 2


def test_pacing_keeps_a_hosts_delay_over_micro_batches(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(f"https://a.org/{k}{j}",) for j in range(3)] + [(f"https://b{k}.org/x",)], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    query = pacing.paced(stream, delay=30.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    slots = spark.read.parquet(str(tmp_path / "out")).collect()
    a = sorted(r["not_before"].timestamp() for r in slots if r["host"] == "a.org")
    assert len(slots) == 8 and len(a) == 6 and all(y - x >= 29.999 for x, y in zip(a, a[1:]))
    assert all(r["wait_s"] < 1 for r in slots if r["host"] != "a.org")


def test_status_while_a_stream_runs(spark, tmp_path):
    html = "<article><h1>T</h1><p>words</p></article>"
    for k in range(3):
        spark.createDataFrame([(3 * k + j, f"u{k}{j}", html if j else None) for j in range(3)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, done = [], threading.Event()

    def told(now):
        seen.append(now)
        if now["state"] == "completed":
            done.set()

    listener = status.StreamStatus("extraction", expected=9, on_change=told)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        out = frontier.extract_stream(stream).select("page_id", "success")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert done.wait(30)
    finally:
        spark.streams.removeListener(listener)
    last = listener.status()
    assert last["state"] == "completed" and last["progress"] == 100.0 and (last["processed"], last["failed"]) == (6, 3)
    assert any(0 < s["progress"] < 100 for s in seen)
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("success")).count() == last["processed"]

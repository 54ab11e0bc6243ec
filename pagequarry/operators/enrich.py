"""Content enrichment by an injected model, with a cache table and batches.

The model is any callable from (list of contents, mode, content_type) to a list of texts.  Without one, contents
pass through.  Hits come from the cache by one left join; only misses reach the model, in batches of which a task has a bounded number under
way at a time; a failing batch is tried again, then keeps its contents and is marked.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions import rules, text
from pagequarry.sources import cache as cache_source

#: Rows whose results a task gives out together.
GROUP = 1024

Model = Callable[[list[str], str, str], list[str]]

#: What a model is asked to do, by mode; an unknown mode is cleaned.
INSTRUCTIONS = {
    "clean": "Remove navigation and boilerplate; keep all information and code.",
    "summarize": "Summarise the main points.",
    "restructure": "Arrange the content under clear headings.",
    "extract_code": "Keep the code examples with a short explanation of each.",
    "format": "Format the content as consistent Markdown.",
}


def prompt(mode: str, content_type: str = "documentation") -> str:
    return f"You work on {content_type}. {INSTRUCTIONS.get(mode, INSTRUCTIONS['clean'])} Return only the result."


def _asked(model: Model, contents: list[str], mode: str, content_type: str, retries: int, pause: float) -> tuple[list[str], str | None]:
    """What the model makes of a batch, or the contents as they are and the error of the last try."""
    for attempt in range(retries + 1):
        try:
            found = model(contents, mode, content_type)
            if len(found) != len(contents):
                raise ValueError(f"{len(found)} results for {len(contents)} contents")
            return list(found), None
        except Exception as error:  # one batch's failure is its own
            failed = str(error)
            if attempt < retries:
                time.sleep(pause * 2**attempt)
    return contents, failed


def in_flight(batches: Iterator, call: Callable, at_once: int) -> Iterator[tuple]:
    """(batch, call(batch)) in the order of the batches, with up to ``at_once`` calls under way; no more batches are held."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        waiting: deque = deque()
        for batch in batches:
            waiting.append((batch, pool.submit(call, batch)))
            if len(waiting) >= max(1, at_once):
                first, found = waiting.popleft()
                yield first, found.result()
        while waiting:
            first, found = waiting.popleft()
            yield first, found.result()


def process(
    rows: DataFrame,
    model: Model | None = None,
    mode: str = "clean",
    content_type: str = "documentation",
    batch_size: int = 5,
    cache: DataFrame | None = None,
    at_once: int = 1,
    retries: int = 0,
    pause: float = 0.5,
) -> DataFrame:
    """rows (content, ...) with cache_key, result, processed, cached, error.

    cache: (cache_key, result), of earlier calls; repeated keys count once.  A task has up to ``at_once`` batches under way; a batch
    that fails is tried again ``retries`` times, after a pause that doubles.
    """
    keyed = rows.withColumn("cache_key", text.content_cache_key("content", F.lit(mode if mode in rules.PROCESSING_MODES else "clean")))
    if cache is None:
        keyed = keyed.withColumn("_known", F.lit(None).cast("string"))
    else:  # one pass over the rows: hits are those that the join finds
        known = cache.filter("result IS NOT NULL").select("cache_key", F.col("result").alias("_known")).dropDuplicates(["cache_key"])
        keyed = keyed.join(known, "cache_key", "left").select(*keyed.columns, "_known")
    hit = F.col("_known").isNotNull()
    if model is None:
        return keyed.select("*", F.coalesce("_known", "content").alias("result"), hit.alias("processed"), hit.alias("cached"), F.lit(None).cast("string").alias("error")).drop("_known")
    schema = T.StructType(keyed.drop("_known").schema.fields + T.StructType.fromDDL("result string, processed boolean, cached boolean, error string").fields)

    at, with_cache = keyed.columns.index("content"), cache is not None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits pass; misses are gathered over frames of the task into whole batches, and given out by groups of up to ``GROUP`` rows."""
        ready: deque[pa.RecordBatch] = deque()

        def batches() -> Iterator[tuple[pa.RecordBatch, int, list]]:
            """A group, where in it a batch ends, and the batch's contents."""
            held = None
            for frame in frames:
                for k in range(0, frame.num_rows, GROUP):
                    rows = frame.slice(k, GROUP)
                    missed = rows
                    if with_cache:
                        known = rows.column(rows.num_columns - 1)
                        hits = rows.filter(known.is_valid())
                        if hits.num_rows:
                            ready.append(_finished(hits, hits.column(hits.num_columns - 1), [None] * hits.num_rows, True))
                            yield hits, 0, []  # lets them out
                        missed = rows.filter(known.is_null())
                    held = missed if held is None else pa.concat_batches([held, missed])
                    # Without a cache a frame's last batch may be short: no row waits for another frame.
                    whole = held.num_rows if not with_cache and k + GROUP >= frame.num_rows else held.num_rows // batch_size * batch_size
                    yield from cut(held.slice(0, whole))
                    held = held.slice(whole)
            if held is not None:
                yield from cut(held)

        def cut(group: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, list]]:
            contents = group.column(at).to_pylist()
            for low in range(0, len(contents), batch_size):
                yield group, min(low + batch_size, len(contents)), contents[low : low + batch_size]

        def asked(batch: tuple[pa.RecordBatch, int, list]) -> tuple[list, str | None]:
            return _asked(model, batch[2], mode, content_type, retries, pause) if batch[2] else ([], None)

        results, errors = [], []
        for (group, high, contents), (found, error) in in_flight(batches(), asked, at_once):
            while ready:
                yield ready.popleft()
            results += found
            errors += [error] * len(contents)
            if contents and high == group.num_rows:
                yield _finished(group, pa.array(results, pa.string()), errors, False)
                results, errors = [], []
        while ready:
            yield ready.popleft()

    return (keyed.drop("_known") if cache is None else keyed).mapInArrow(run, schema)


def _finished(rows: pa.RecordBatch, results: pa.Array, errors: list[str | None], cached: bool) -> pa.RecordBatch:
    """rows without what the cache knows, with result, processed, cached, error."""
    own = [n for n in rows.schema.names if n != "_known"]
    error = pa.array(errors, pa.string())
    more = [results, error.is_null() if not cached else pa.array([True] * len(errors)), pa.array([cached] * len(errors))]
    return pa.RecordBatch.from_arrays([*[rows.column(n) for n in own], *more, error], names=[*own, "result", "processed", "cached", "error"])


def process_saving(rows: DataFrame, model: Model, path: str, save: Callable[[DataFrame, int], DataFrame], waves: int = 1, **options) -> DataFrame:
    """``process`` with a cache at ``path``, in waves of rows by key: each wave's new results are in the cache before the next one begins, so
    a run that is lost has lost one wave's calls.  Equal keys are of one wave; within it each is asked for once.

    save: writes a wave and reads it back (it is used twice).
    """
    mode = options.get("mode", "clean")
    keyed = rows.withColumn("_key", text.content_cache_key("content", F.lit(mode if mode in rules.PROCESSING_MODES else "clean")))
    done = None
    for wave in range(waves):
        own = keyed.filter(F.pmod(F.xxhash64("_key"), F.lit(waves)) == wave).drop("_key")
        found = save(process(own, model, cache=cache_source.load(rows.sparkSession, path), **options), wave)
        cache_source.append(new_cache_rows(found), path)
        done = found if done is None else done.unionByName(found)
    return done


def new_cache_rows(processed: DataFrame) -> DataFrame:
    """What to append to the cache table."""
    return processed.filter("processed AND NOT cached").select("cache_key", "result").dropDuplicates(["cache_key"])


def written_back(pages: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    """pages (key, content, ...) with the new content where it was processed.

    Where pages may repeat a URL, the key is to be what tells them apart (seq, page_id).  A key with several results keeps
    its pages as they are in number: they get the least of the results.
    """
    new = processed.filter("processed").groupBy(key).agg(F.min("result").alias("_new"))
    return pages.join(new, key, "left").withColumn("content", F.coalesce("_new", "content")).withColumn("ai_processed", F.col("_new").isNotNull()).drop("_new")


def cache_stats(processed: DataFrame) -> DataFrame:
    """size, hits, misses, hit_rate in percent."""
    hits = F.count_if(F.col("cached"))
    return processed.agg(
        F.count_distinct("cache_key").alias("cache_size"), hits.alias("hits"), F.count_if(~F.col("cached")).alias("misses"), (hits / F.greatest(F.lit(1), F.count(F.lit(1))) * 100).alias("hit_rate")
    )

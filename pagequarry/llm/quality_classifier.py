"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (single words and pairs) are fitted: the
target model on texts labelled good, the raw model on all texts.  The log weight of a text is the sum over
its n-grams of log target - log raw.  Adding Gumbel noise and keeping the k largest draws k
texts without replacement in proportion to their tempered weights.

Counting is one scan that adds up at most ``BUCKETS`` rows; weighing is a second one.  Only the
two tables of bucket counts reach the driver.

*Draw.*  The score is the log weight over the number of n-grams to the power ``LENGTH_POWER`` (a half: the spread of a sum grows
so, and a long text is not drawn for its length alone) and over a temperature, which is 1, plus standard Gumbel noise.  The k-th largest score is found by
a few grouped counts over (id, score); nothing is sorted as a whole.  k is stated: a number, or a share of the texts that pass the guard (all of them, unless told otherwise).

*Guard.*  What is drawn from are the texts whose mean weight (log weight by n-gram, with ``PRIOR`` more of even odds) reaches a floor.  The floor is calibrated on labelled
texts that the target was not fitted on: half of the good ones and the bad ones, up to ``LABELLED``
of each label.  It is the cut that separates the two best (largest share of good kept less share of
bad kept) among those that lose ``LOSS`` of the good at most, halfway to the next labelled text below.  Where
no bad text is labelled, it is the outer fence of the good ones: their lower quartile less three times
the distance of the quartiles.  Neither rule has the number of texts in it.

Defined results: null and empty texts have no n-grams and weight 0; the noise is a function
of seed and id, so repeated rows get one verdict; each row is judged by its own text, also where ids
are null or repeated, and ``keep`` and ``resample`` keep the same rows; texts that tie with the k-th are all
kept; k below 1 draws nothing; a k above the number of texts that pass the guard draws all of these; an empty table gives no rows; without any good label everything weighs 0 and stays;
further columns are kept by ``keep`` and ignored by ``weigh``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, released, written
from .wordhash import mix, word_hashes

BUCKETS = 1 << 16
#: Texts of each label that the target model and the floor are fitted on, at most: those whose id hashes lowest.
LABELLED = 100_000
#: Share of held-out good texts that the floor may lose, at most.
LOSS = 0.02
#: Counts added to each bucket of both models.
SMOOTHING = 1.0
#: N-grams of even odds that temper the mean weights of short texts (the guard).
PRIOR = 100
#: Power of the number of n-grams that the log weight is divided by, and the temperature of the draw.
LENGTH_POWER, TEMPERATURE = 0.5, 1.0
LOT = 512


def _grams(words: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    if not len(words):
        return np.empty(0, np.int64)
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _lots(batches: Iterator[pa.RecordBatch]):
    for batch in released(batches):
        for k in range(0, batch.num_rows, LOT):
            part = batch.slice(k, LOT)
            yield part.column(0), list(word_hashes(part.column(1).cast(pa.binary()).to_pylist()))


def _member(ids: pa.Array, chosen: np.ndarray) -> np.ndarray:
    values = np.asarray(ids.fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(chosen):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)
    return (chosen[at] == values) & np.asarray(ids.is_valid())


def _count(good: np.ndarray):
    def run(batches):
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for ids, texts in _lots(batches):
            grams = [_grams(w) for w in texts]
            chosen = [g for g, is_good in zip(grams, _member(ids, good), strict=True) if is_good]
            raw += np.bincount(np.concatenate(grams), minlength=BUCKETS)
            if chosen:
                target += np.bincount(np.concatenate(chosen), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return run


def fit(docs: DataFrame, good_ids: np.ndarray) -> np.ndarray:
    """log target - log raw of each bucket."""
    counts = docs.mapInArrow(_count(good_ids), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():  # BUCKETS rows at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))


def _weigh(ratio: np.ndarray):
    def run(batches):
        for ids, texts in _lots(batches):
            grams = [_grams(w) for w in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(g) for g in grams], pa.int64()), pa.array([float(ratio[g].sum()) for g in grams], pa.float64())], names=["doc_id", "n_grams", "log_weight"]
            )

    return run


def labelled_ids(labels: DataFrame, at_most: int = LABELLED, quality: int = 1) -> np.ndarray:
    """Ids with that quality, ascending: all, or the at_most ones that hash lowest."""
    good = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = good.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(at_most)
    return np.sort(np.array([r["doc_id"] for r in rows.collect()], dtype=np.int64))


def halves(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids to fit on and those held out, by a hash."""
    odd = (mix(ids.view(np.uint64)) & np.uint64(1)).astype(bool)
    return ids[~odd], ids[odd]


def _mean(log_weight: Column, n_grams: Column) -> Column:
    return log_weight / (n_grams + PRIOR)


def _score(log_weight: Column, n_grams: Column, ids: Column, seed: int, temperature: float) -> Column:
    """The tempered log weight with Gumbel noise."""
    uniform = (F.shiftrightunsigned(F.xxhash64(ids.cast("long"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return log_weight / F.pow(F.greatest(n_grams, F.lit(1)), F.lit(LENGTH_POWER)) / F.lit(temperature) - F.log(-F.log(uniform))


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, n_grams, log_weight, mean_weight of every text; the log ratios; the good ids held out; the bad ids.

    An id with both labels counts as good.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    good = labelled_ids(labels)
    fitted, held_out = halves(good)
    bad = np.setdiff1d(labelled_ids(labels, quality=0), good)
    ratio = fit(texts, fitted)
    rows = texts.mapInArrow(_weigh(ratio), "doc_id long, n_grams long, log_weight double")
    return written(rows.withColumn("mean_weight", _mean(F.col("log_weight"), F.col("n_grams"))), "weights"), ratio, held_out, bad


def kth_largest(scores: DataFrame, k: int) -> float:
    """The k-th largest score (1 is the largest), by narrowing its range through counts.

    Each pass counts the scores in 4096 equal steps of the range that holds the k-th; it
    ends when a single value is left.
    """
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    above = 0
    while low < high:
        step = (high - low) / 4096
        if step <= 0 or low + step == low:
            break
        inside = scores.filter((F.col("score") >= low) & (F.col("score") <= high))
        cell = F.least(F.floor((F.col("score") - low) / F.lit(step)), F.lit(4095)).cast("int")
        rows = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
        for row in sorted(rows, key=lambda r: -r["cell"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return high


def held_out_weights(weights: DataFrame, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean weights of the good and the bad ids, ascending; one (the mean) for an id that is repeated."""
    found = weights.mapInArrow(_labelled(good, bad), "doc_id long, good boolean, mean_weight double").groupBy("doc_id", "good").agg(F.avg("mean_weight").alias("w"))
    rows = found.select("good", "w").toArrow()  # LABELLED rows of each label at most
    values, is_good = np.asarray(rows.column("w"), dtype=float), np.asarray(rows.column("good"), dtype=bool)
    return np.sort(values[is_good]), np.sort(values[~is_good])


def floor_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The least mean weight that is kept, by the ascending weights of held-out texts (see above)."""
    if not len(good):
        return -np.inf
    if not len(bad):
        low, high = np.quantile(good, [0.25, 0.75])
        return float(low - 3 * (high - low))
    cuts = good[: int(LOSS * len(good)) + 1]
    lost = np.searchsorted(good, cuts)
    kept_bad = len(bad) - np.searchsorted(bad, cuts)
    cut = cuts[np.argmax((len(good) - lost) / len(good) - kept_bad / len(bad))]
    below = [x[x < cut] for x in (good, bad)]
    below = max((x[-1] for x in below if len(x)), default=None)
    return float(cut) if below is None else float((cut + below) / 2)


def drawn(docs: DataFrame, labels: DataFrame, k: int | None, share: float, seed: int, temperature: float, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray, float, float]:
    """The weights with their scores; the log ratios; the floor of the guard; the least score that is drawn.

    k: None for a share of the texts that pass the guard.  The floor is fitted on bounded
    samples of both labels; the count covers all texts.
    """
    weights, ratio, *ids = weigh(docs, labels, id_col, text_col)
    floor = floor_of(*held_out_weights(weights, *ids))
    scored = weights.withColumn("score", _score(F.col("log_weight"), F.col("n_grams"), F.col("doc_id"), seed, temperature))
    passed = scored.filter(F.col("mean_weight") >= F.lit(floor))
    n = passed.count()
    k = math.ceil(share * n) if k is None else k
    if k >= n:
        return scored, ratio, floor, -math.inf
    return scored, ratio, floor, kth_largest(passed, k) if k > 0 else math.inf


def _labelled(good: np.ndarray, bad: np.ndarray):
    def run(batches):
        for batch in released(batches):
            ids, w = batch.column("doc_id"), batch.column("mean_weight")
            is_good, is_bad = _member(ids, good), _member(ids, bad)
            chosen = pa.array(is_good | is_bad)
            yield pa.RecordBatch.from_arrays([ids.filter(chosen), pa.array(is_good).filter(chosen), w.filter(chosen)], names=["doc_id", "good", "mean_weight"])

    return run


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, share: float = 1.0, seed: int = 17, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_grams, log_weight, mean_weight, score of the texts drawn: of those that pass the guard the k largest scores, with those that tie with the k-th."""
    scored, _, floor, least = drawn(docs, labels, k, share, seed, temperature, id_col, text_col)
    return scored.filter((F.col("mean_weight") >= F.lit(floor)) & (F.col("score") >= F.lit(least)))


def keep(
    docs: DataFrame, labels: DataFrame, k: int | None = None, share: float = 1.0, seed: int = 17, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs that are drawn, with the columns of docs.

    Texts are weighed once more in the scan that returns them, so no row is found again by its id.
    """
    _, ratio, floor, least = drawn(docs, labels, k, share, seed, temperature, id_col, text_col)

    @F.arrow_udf("log_weight double, n_grams long")
    def weight(texts: pa.Array) -> pa.Array:
        weights, sizes = [], []
        for at in range(0, len(texts), LOT):
            for words in word_hashes(texts.slice(at, LOT).cast(pa.binary()).to_pylist()):
                grams = _grams(words)
                weights.append(float(ratio[grams].sum()))
                sizes.append(len(grams))
        return pa.StructArray.from_arrays([pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())], names=["log_weight", "n_grams"])

    (name,) = fresh(docs, "weight")
    own = docs.withColumn(name, weight(F.coalesce(F.col(text_col), F.lit(""))))
    log_weight, n_grams = F.col(name)["log_weight"], F.col(name)["n_grams"]
    drawn_rows = (_mean(log_weight, n_grams) >= F.lit(floor)) & (_score(log_weight, n_grams, F.col(id_col), seed, temperature) >= F.lit(least))
    return own.filter(drawn_rows).drop(name)

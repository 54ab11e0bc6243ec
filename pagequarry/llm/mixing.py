"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``exponent``, normalised.  The exponent is
bisected between 1 (as the tokens lie) and 0 (all alike): the largest one that reaches the
target entropy, but no smaller than the repetition limit allows.  Without a budget, the
mixture is as long as it must be for no source to be cut: the source that is weighted down most is
read once, others again and again, up to the limit.

The weights are realised as block permutations.  The rows of a source are dealt by hash into
blocks; in every epoch the blocks are put in a new order and so are the rows in a block.
A source's last epoch ends where its budget of tokens is reached.  ``mix_key`` in [0, 1) orders all
rows of all sources; sorted by it, every stretch has the mixture's proportions.

Only DataFrame functions are used.  A block has ``block_rows`` rows, about, so neither a hot
source nor an epoch of one is ever ordered as a whole; blocks are ordered in ranges of about ``RANGE_BLOCKS``.
The bisection runs over one row that holds the sources' totals; with more sources than ``MAX_SOURCES`` it
runs over rows, with one aggregation for each halving, and weights are joined instead of broadcast.

Defined results: a null source counts as the source ''; a null or empty text has no tokens
(it is kept with its source's full epochs, at its place); repeated rows are mixed each for
itself; rows without an id are placed by their texts; an empty table gives no rows; the columns of the input are kept and those added are renamed with
underscores if they clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS_CLASS, fresh, written

#: Rows of a block, about.
BLOCK_ROWS = 1024
#: Blocks that a window orders, about.
RANGE_BLOCKS = 4096
#: Sources whose totals are held in one row and broadcast, at most.
MAX_SOURCES = 100_000
#: Halvings of the exponent's range.
HALVINGS = 50


def n_tokens(text: str) -> Column:
    """Words as tokens: runs without white space."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WS_CLASS, -1), "")).cast("long")


def _powers(totals: str, exponent: Column) -> Column:
    return F.transform(totals, lambda t: F.pow(t["tokens"] / F.col("largest"), exponent))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _entropy(totals: str, exponent: Column) -> Column:
    """In nats; log(sum p) - sum(p log p) / sum(p) for p before they are normalised."""
    parts = F.transform(totals, lambda t: exponent * F.log(t["tokens"] / F.col("largest")))
    both = F.aggregate(
        parts,
        F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("plogp")),
        lambda a, x: F.struct((a["p"] + F.exp(x)).alias("p"), (a["plogp"] + x * F.exp(x)).alias("plogp")),
        lambda a: F.log(a["p"]) - a["plogp"] / a["p"],
    )
    return both


def _repetition(totals: str, exponent: Column, budget: int | None) -> Column:
    """Epochs of the source that is repeated most."""
    if budget is None:
        return F.pow(F.col("largest") / F.col("smallest"), 1 - exponent)
    most = F.array_max(F.transform(totals, lambda t: F.pow(t["tokens"] / F.col("largest"), exponent - 1)))
    return most * F.lit(float(budget)) / (F.col("largest") * _sum(_powers(totals, exponent)))


def source_weights(sizes: DataFrame, entropy_share: float | None = 0.97, max_epochs: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """source, tokens, exponent, weight, epochs from (source, tokens) rows.

    ``entropy_share``: target entropy as a share of that of equal weights; None asks for none.
    """
    row = (
        sizes.filter("tokens > 0")
        .agg(F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("tokens")))).alias("totals"))
        .withColumn("largest", F.array_max(F.transform("totals", lambda t: t["tokens"])))
        .withColumn("smallest", F.array_min(F.transform("totals", lambda t: t["tokens"])))
        .filter("size(totals) > 0")
    )

    def bisected(holds) -> Column:
        """The largest exponent in [0, 1] for which holds is true, which it is from 0 up to some point."""
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(HALVINGS)),
            F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
            lambda a, _: F.when(holds((a["low"] + a["high"]) / 2), F.struct(((a["low"] + a["high"]) / 2).alias("low"), a["high"].alias("high"))).otherwise(
                F.struct(a["low"].alias("low"), ((a["low"] + a["high"]) / 2).alias("high"))
            ),
            lambda a: a["low"],
        )
        return F.when(holds(F.lit(1.0)), F.lit(1.0)).otherwise(end)

    wanted = F.lit(1.0) if entropy_share is None else bisected(lambda e: _entropy("totals", e) >= F.lit(entropy_share) * F.log(F.size("totals").cast("double")) - 1e-12)
    row = row.withColumn("by_entropy", wanted)
    if max_epochs is None:
        row = row.withColumn("exponent", F.col("by_entropy"))
    else:
        # Repetition falls as the exponent grows: the smallest one within the limit is 1 - the largest slack.
        slack = bisected(lambda s: _repetition("totals", 1 - s, budget) <= F.lit(float(max_epochs)))
        row = row.withColumn("exponent", F.greatest("by_entropy", 1 - slack))
    row = row.withColumn("powers", _powers("totals", F.col("exponent"))).withColumn("power_sum", _sum(F.col("powers")))
    each = row.select("exponent", "power_sum", "largest", F.inline(F.transform("totals", lambda t, i: F.struct(t["source"].alias("source"), t["tokens"].alias("tokens"), F.get("powers", i).alias("power")))))
    weight = F.col("power") / F.col("power_sum")
    if budget is None:
        epochs = F.round(F.pow(F.col("largest") / F.col("tokens"), 1 - F.col("exponent")), 9)
    else:
        epochs = F.round(weight * F.lit(float(budget)) / F.col("tokens"), 9)
    return each.select("source", F.col("tokens").cast("long").alias("tokens"), "exponent", weight.alias("weight"), epochs.alias("epochs"))


def source_weights_by_rows(sizes: DataFrame, entropy_share: float | None = 0.97, max_epochs: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """As ``source_weights``, for any number of sources: every halving is an aggregation over all rows."""
    sizes = sizes.filter("tokens > 0").select("source", F.col("tokens").cast("double").alias("tokens"))
    n, largest, smallest = sizes.agg(F.count(F.lit(1)), F.max("tokens"), F.min("tokens")).first()
    if not n:
        return sizes.select("source", F.col("tokens").cast("long").alias("tokens"), *[F.lit(0.0).alias(c) for c in ("exponent", "weight", "epochs")])
    logs = F.log(F.col("tokens") / F.lit(largest))

    def power_sum(e: float) -> float:
        return sizes.agg(F.sum(F.exp(e * logs))).first()[0]

    def entropy(e: float) -> float:
        p, plogp = sizes.agg(F.sum(F.exp(e * logs)), F.sum(e * logs * F.exp(e * logs))).first()
        return math.log(p) - plogp / p

    def repetition(e: float) -> float:
        if budget is None:
            return (largest / smallest) ** (1 - e)
        return (smallest / largest) ** (e - 1) * budget / (largest * power_sum(e))

    def bisected(holds) -> float:
        if holds(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(HALVINGS):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    exponent = 1.0 if entropy_share is None else bisected(lambda e: entropy(e) >= entropy_share * math.log(n) - 1e-12)
    if max_epochs is not None:
        exponent = max(exponent, 1 - bisected(lambda s: repetition(1 - s) <= max_epochs))
    weight = F.exp(F.lit(exponent) * logs) / F.lit(power_sum(exponent))
    epochs = F.pow(F.lit(largest) / F.col("tokens"), F.lit(1 - exponent)) if budget is None else weight * F.lit(float(budget)) / F.col("tokens")
    return sizes.select("source", F.col("tokens").cast("long").alias("tokens"), F.lit(exponent).alias("exponent"), weight.alias("weight"), F.round(epochs, 9).alias("epochs"))


def mix(
    docs: DataFrame,
    entropy_share: float | None = 0.97,
    max_epochs: float | None = 2.0,
    budget: int | None = None,
    seed: int = 5,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    carry: tuple[str, ...] | None = None,
    budget_share: float | None = None,
) -> DataFrame:
    """The rows of docs (columns ``carry``; None: all) as the mixture reads them; budget (in tokens) may be
    given as a share of all tokens instead (``budget_share``).  Each row has
    mix_source, n_tokens, epoch, block, mix_start (its first token's place in the source's
    stream), mix_key, weight, epochs and exponent.
    """
    carried = list(docs.columns) if carry is None else list(carry)
    n = dict(zip((*ADDED, *INNER), fresh(docs, *ADDED, *INNER), strict=True))
    rows = docs.withColumn(n["mix_source"], F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn(n["n_tokens"], n_tokens(text_col))
    rows = rows.withColumn(n["mix_hash"], F.xxhash64(id_col, F.when(F.col(id_col).isNull(), F.col(text_col)), F.lit(seed)))
    rows = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, id_col])], n["mix_source"], n["n_tokens"], n["mix_hash"])
    # Texts are read for their tokens once here, and once more only if they are carried along.
    slim = written(rows.select(id_col, *[c for c in carried if c != text_col and c != id_col and carry is not None], n["mix_source"], n["n_tokens"], n["mix_hash"]), "mix-rows")
    if set(carried) <= set(slim.columns):
        rows = slim
    totals = slim.groupBy(F.col(n["mix_source"]).alias("source")).agg(F.sum(n["n_tokens"]).alias("tokens"), F.count(F.lit(1)).alias("rows"))
    totals = written(totals, "mix-sources")
    few = totals.count() <= MAX_SOURCES
    if budget_share is not None:
        budget = round(budget_share * (totals.agg(F.sum("tokens")).first()[0] or 0))
    weights = (source_weights if few else source_weights_by_rows)(totals, entropy_share, max_epochs, budget)
    weighted = totals.select("source", "rows").join(weights, "source", "left")
    weighted = weighted.select(  # a source without tokens is read once
        F.col("source").alias(n["mix_source"]),
        F.coalesce("tokens", F.lit(0)).alias(n["mix_total"]),
        F.ceil(F.col("rows") / block_rows).alias(n["mix_blocks"]),
        F.coalesce("weight", F.lit(0.0)).alias(n["weight"]),
        F.coalesce("epochs", F.lit(1.0)).alias(n["epochs"]),
        F.coalesce("exponent", F.lit(1.0)).alias(n["exponent"]),
    )
    weighted = written(weighted, "mix-weights")
    weighted = F.broadcast(weighted) if few else weighted  # MAX_SOURCES rows at most
    key = F.shiftrightunsigned(n["mix_hash"], 12).cast("double") / F.lit(float(1 << 52))
    placed = rows.join(weighted, n["mix_source"]).withColumn(n["block"], F.least(F.floor(key * F.col(n["mix_blocks"])), F.col(n["mix_blocks"]) - 1))

    # Blocks in the order of each epoch, with the tokens before them.
    blocks = slim.select(n["mix_source"], n["mix_hash"], n["n_tokens"]).join(weighted, n["mix_source"]).withColumn(n["block"], F.least(F.floor(key * F.col(n["mix_blocks"])), F.col(n["mix_blocks"]) - 1))
    blocks = blocks.groupBy(n["mix_source"], n["block"]).agg(F.sum(n["n_tokens"]).alias("block_tokens"), F.first(n["mix_total"]).alias("T"), F.first(n["epochs"]).alias("e"), F.first(n["mix_blocks"]).alias("many"))
    blocks = blocks.withColumn(n["epoch"], F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("e"), F.lit(1)).cast("int") - 1)))
    turn = F.shiftrightunsigned(F.xxhash64(n["mix_source"], n["block"], n["epoch"], F.lit(seed + 1)), 12).cast("double") / F.lit(float(1 << 52))
    blocks = blocks.withColumn("turn", turn).withColumn("range", F.floor(F.col("turn") * F.ceil(F.col("many") / RANGE_BLOCKS)))
    blocks = written(blocks, "mix-turns")
    # In the order of turns: ranges of them first, then the blocks of each.
    before = lambda *keys: Window.partitionBy(n["mix_source"], n["epoch"], *keys).rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy(n["mix_source"], n["epoch"], "range").agg(F.sum("block_tokens").alias("range_tokens"))
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_tokens").over(before().orderBy("range")), F.lit(0))).drop("range_tokens")
    blocks = blocks.join(ranges, [n["mix_source"], n["epoch"], "range"])
    blocks = blocks.withColumn("block_start", F.col("range_start") + F.coalesce(F.sum("block_tokens").over(before("range").orderBy("turn", n["block"])), F.lit(0)))
    # The part of the last epoch that the budget leaves.
    blocks = blocks.withColumn("quota", F.when(F.col(n["epoch"]) + 1 <= F.col("e"), F.lit(None)).otherwise((F.col("e") - F.col(n["epoch"])) * F.col("T")))
    blocks = written(blocks.filter("quota IS NULL OR block_start < quota").select(n["mix_source"], n["block"], n["epoch"], F.col("block_start").alias(n["mix_block_start"]), F.col("quota").alias(n["mix_quota"])), "mix-blocks")

    spread = placed.join(blocks, [n["mix_source"], n["block"]])
    own = Window.partitionBy(n["mix_source"], n["block"], n["epoch"]).orderBy(F.xxhash64(n["mix_hash"], n["epoch"], F.lit(seed + 2)), id_col).rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn(n["mix_within"], F.col(n["mix_block_start"]) + F.coalesce(F.sum(n["n_tokens"]).over(own), F.lit(0)))
    spread = spread.filter(F.col(n["mix_quota"]).isNull() | (F.col(n["mix_within"]) < F.col(n["mix_quota"])))
    start = F.col(n["epoch"]) * F.col(n["mix_total"]) + F.col(n["mix_within"])
    return spread.select(
        *[F.col(f"`{c}`") for c in carried],
        n["mix_source"],
        n["n_tokens"],
        n["epoch"],
        n["block"],
        start.cast("long").alias(n["mix_start"]),
        F.least(F.coalesce(F.try_divide(start, F.col(n["epochs"]) * F.col(n["mix_total"])), F.lit(0.0)), F.lit(1.0)).alias(n["mix_key"]),
        n["weight"],
        n["epochs"],
        n["exponent"],
    )


INNER = ("mix_hash", "mix_total", "mix_blocks", "mix_block_start", "mix_quota", "mix_within")
ADDED = ("mix_source", "n_tokens", "epoch", "block", "mix_start", "mix_key", "weight", "epochs", "exponent")

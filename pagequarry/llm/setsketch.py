"""MinHash near-duplicates by SetSketch registers.

*Sketch.*  Each shingle sends points of a Poisson process to ``REGISTERS`` registers, so that the
least point of a register over a set is exponential with the set's size as its rate.  A register keeps
1 - log(point), rounded down, in base ``BASE`` and truncated to a byte: an exponentially spaced truncated minimum.  The
registers of a union are the maxima of the registers (``merge``).

*Bands.*  Sets that share a byte-for-byte equal band of ``ROWS`` registers are candidates.  Two sets of equal size with a
similarity of 0.85 agree in a register with probability 0.857, so they share none of the 40 bands in one of a million cases.

*Estimate.*  From the registers of a pair that are larger on one side, larger on the other, or equal, and from both set
sizes, the likelihood of every similarity follows; a candidate stays unless 0.85 is less likely by ``SLACK`` in
logarithm (five standard deviations) than the likeliest.

*Parities.*  Beside its registers a set has a string of ``PARITIES`` bits, each the parity of how many of its shingles fall there.
Bits in which two sets differ are at most as many as the shingles that only one of them has, so a pair with too many of them cannot link: this test gives up no link at all.

*Verification.*  What stays is compared on the full shingle sets.  Texts with one shingle set are one class.  In a band's
bucket each class is compared with one hub, the same for all; its likeliest hub is verified first, then, across components, the next
``HUBS`` - 1 likeliest.  Links are contracted
to components and only pairs across components are looked at further, so a group of near copies costs pairs in proportion to its size.
Pairs, many where a passage is common, never become rows: a task holds the sketches of a block of a bucket with its hub, or of two blocks, and gives out the pairs that may link.

Links are exact; that none is missed holds with the probability above for a lone pair, and
for more than that in a group, where one of several links is enough.

Defined results: null and empty texts, and texts without words, have no shingles and stand alone; fewer words than a shingle
has are one shingle; a null id is in no component (null) and is kept; each row has its row, also where ids repeat, and
a component's id is the least id in it; an empty table gives no rows; further columns are ignored.  Shingles are
compared by 64-bit and whole sets by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_lots, written
from .idfilter import id_filter, may_hold
from .jaccard_join import components
from .wordhash import mix, shingle_hashes, word_hashes

#: Registers of a sketch, registers of a band.
ROWS, BANDS = 8, 40
REGISTERS = ROWS * BANDS
#: Bits of the parities beside them, bytes of both together.
PARITIES = 2048
WIDTH = REGISTERS + PARITIES // 8
#: A byte spans sets from one shingle to 2**40 of them.
BASE, RATE = 2.0 ** (40 / 254), 20.0
#: Points up to this over the set's size are made at first: one set in forty needs more for its last registers.
REACH = np.log(REGISTERS) + 3.7
#: How much less likely (in logarithm) than the best the least linking similarity may be.
SLACK = 12.5
#: Share of equal registers below which a pair isn't looked at: eight standard deviations under what 0.85 gives.
LEAST_EQUAL = 0.7
#: Hubs of a class that are verified before all pairs across components are looked at.
HUBS = 3
#: Rows of a block of a bucket, about.
BLOCK = 512
#: Texts, and bytes of them, that are sketched together.
LOT, LOT_BYTES = 512, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set of hashes (distinct or not), as bytes; an empty set's are 0."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    least = np.full(len(sets) * REGISTERS, np.inf)
    reach = np.full(len(sets), REACH)
    todo = np.flatnonzero(sizes)
    while len(todo):
        owner = np.repeat(todo, sizes[todo])
        state = mix(np.concatenate([sets[k] for k in todo]) ^ np.uint64(0xA0761D6478BD642F))
        at, limit = np.zeros(len(owner)), (reach / np.maximum(sizes, 1))[owner]
        while len(owner):
            state = mix(state + _STEP)
            at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            near = at < limit
            owner, state, at, limit = owner[near], state[near], at[near], limit[near]
            register = (mix(state) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
            np.minimum.at(least, owner * REGISTERS + register.astype(np.int64), at)
        unfilled = np.isinf(least.reshape(-1, REGISTERS)[todo]).any(axis=1)
        todo = todo[unfilled]
        reach[todo] *= 3
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(level, 0, 255).astype(np.uint8).reshape(-1, REGISTERS)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Of a set of distinct hashes, as bytes."""
    at = (mix(shingles + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(PARITIES)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITIES) & 1).astype(np.uint8))


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(one, two)


def bands(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    own = np.ascontiguousarray(sketches).view(np.uint64).reshape(-1, BANDS)
    return mix(mix(own) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)


def _larger(x: np.ndarray) -> np.ndarray:
    """The probability that a register is larger on one side, whose own shingles are the share x of both sizes' sum."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of similarities (a column each) for pairs (a row each), by how many registers are larger in a and in b."""
    u = (na / (na + nb))[:, None]
    up, down = (_larger(np.maximum(x, 0)) for x in (u - (1 - u) * similarity, 1 - u - u * similarity))
    same = (REGISTERS - more - less)[:, None]
    log = lambda p: np.log(np.maximum(p, 1e-300))
    return more[:, None] * log(up) + less[:, None] * log(down) + same * log(1 - up - down)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair of sketches, and whether one of ``least`` or more may be."""
    return estimates_of((a > b).sum(axis=1), (a < b).sum(axis=1), na, nb, least)


def estimates_of(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same by the numbers of registers that are larger in a, and in b."""
    most = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    likely = log_likelihood(more, less, na, nb, grid)
    best = likely.argmax(axis=1)
    own = grid[np.arange(len(best)), best]
    at_least = log_likelihood(more, less, na, nb, np.minimum(least, most)[:, None])[:, 0]
    return own, (own >= least) | (likely.max(axis=1) - at_least <= SLACK)


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Of a set in ascending order."""
    again = mix(shingles + _STEP)
    keys = mix(np.array([shingles.sum(dtype=np.uint64) + np.uint64(len(shingles)), again.sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)
    return int(keys[0]), int(keys[1])


def _sketched(size: int):
    def run(batches):
        for ids, texts in text_lots(batches, LOT, LOT_BYTES):
            sets = [np.unique(shingle_hashes(w, size)) for w in word_hashes(texts)]
            one, two = zip(*map(_set_key, sets), strict=True)
            own = [row.tobytes() + parities(s).tobytes() if len(s) else None for row, s in zip(registers(sets), sets, strict=True)]
            columns = [ids, pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n", "sketch"])

    return run


def sketches(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, two halves of the shingle set's hash, its size n, its registers and parities (null without shingles)."""
    return docs.mapInArrow(_sketched(shingle), "doc_id long, k1 long, k2 long, n long, sketch binary")


def _banded(batches):
    for batch in released(batches):
        own = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)[:, :REGISTERS]
        keys = bands(own).view(np.int64).ravel()
        repeat = lambda k: pa.array(np.repeat(batch.column(k).to_numpy(), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys), repeat(0), repeat(1)], names=["band", "node", "n"])


def _sets(field: np.ndarray, size: int):
    def run(batches):
        for batch in released(batches):
            ids = np.asarray(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
            chosen = pa.array(may_hold(field, ids) & np.asarray(batch.column(0).is_valid()))
            for _, texts in text_lots(iter([batch.filter(chosen)]), LOT, LOT_BYTES):
                sets = [np.unique(shingle_hashes(w, size)) for w in word_hashes(texts)]
                one, two = zip(*map(_set_key, sets), strict=True)
                ends = np.cumsum([0, *map(len, sets)])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), tokens], names=["k1", "k2", "tokens"])

    return run


def _compared(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    node, n = (rows.column(c).to_numpy() for c in ("node", "n"))
    both = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
    return node, n, np.ascontiguousarray(both[:, :REGISTERS]), np.ascontiguousarray(both[:, REGISTERS:]).view(np.uint64)


def may_link(odd: np.ndarray, n: np.ndarray, k: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether each of the others is close enough to k by parities: sets of a and b shingles, d of them in one set alone, link
    when 100 * (a + b - d) >= percent * (a + b + d)."""
    alone = np.bitwise_count(odd[k] ^ odd[others]).sum(axis=1, dtype=np.int64)
    return (100 + percent) * alone <= (100 - percent) * (n[others] + n[k])


def _near(own: np.ndarray, odd: np.ndarray, n: np.ndarray, k: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the others those that may be near k by size, parities and equal registers, and how many of k's are larger and smaller."""
    others = others[100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k])]
    others = others[may_link(odd, n, k, others, percent)]
    more, less = (own[k] > own[others]).sum(axis=1), (own[k] < own[others]).sum(axis=1)
    near = REGISTERS - more - less >= LEAST_EQUAL * REGISTERS
    return others[near], more[near], less[near]


def _likely(node: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, more: np.ndarray, less: np.ndarray, percent: int) -> pa.RecordBatch:
    similarity, stays = estimates_of(more, less, n[i].astype(float), n[j].astype(float), percent / 100)
    a, b = node[i[stays]], node[j[stays]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(similarity[stays])], names=["a", "b", "similarity"])


def _pairs_of(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """The pairs across components that may link, of the rows of one bucket's two blocks (or one)."""
    node, n, own, odd = _compared(rows)
    component, block = (rows.column(c).to_numpy() for c in ("component", "block"))
    one_block, found = block.min() == block.max(), []
    for k in range(len(node) - 1):
        others = np.arange(k + 1, len(node))
        fits = component[others] != component[k]
        others, more, less = _near(own, odd, n, k, others[fits if one_block else fits & (block[others] != block[k])], percent)
        found.append((np.full(len(others), k), others, more, less))
    i, j, more, less = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 4
    return _likely(node, n, i, j, more, less, percent)


def _pairs_with_hub(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """node, hub, similarity of those that may link with it, of the rows of one block with the bucket's hub."""
    node, n, own, odd = _compared(rows)
    is_hub = rows.column("is_hub").to_numpy(zero_copy_only=False)
    k = int(np.flatnonzero(is_hub)[0])
    others, more, less = _near(own, odd, n, k, np.flatnonzero(~is_hub), percent)
    similarity, stays = estimates_of(more, less, np.full(len(others), n[k], dtype=float), n[others].astype(float), percent / 100)
    found = node[others[stays]]
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), node[k])), pa.array(similarity[stays])], names=["node", "hub", "similarity"])


def _by_key(key: tuple[str, ...], pairs: Callable[[pa.Table, int], pa.RecordBatch], percent: int):
    """``pairs`` of the rows of each key, over rows sorted by key; what is held is the rows of one key."""

    def run(batches):
        held = None
        for batch in released(batches):
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([rows.column(c).to_numpy() for c in key])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts[:-1]], cuts, strict=False):
                yield pairs(rows.slice(low, high - low), percent)
            held = rows.slice(cuts[-1]) if len(cuts) else rows
        if held is not None and held.num_rows:
            yield pairs(held, percent)

    return run


_PAIRS = "a long, b long, similarity double"


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("blocks", F.expr(f"1 + df div {BLOCK}")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")))


def with_hubs(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node, nth, a, b: each class with its likeliest hubs (nth from 0), of the hubs of its buckets (band, df, hub, node, n) that it may link with."""
    rows = _in_blocks(buckets).withColumn("is_hub", F.col("hub") == F.col("node"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("is_hub"), every).otherwise(F.array("block"))))
    rows = rows.join(nodes.select("node", "sketch"), "node").select("band", "block", "node", "n", "is_hub", "sketch")
    dealt = rows.repartition("band", "block").sortWithinPartitions("band", "block")
    found = dealt.mapInArrow(_by_key(("band", "block"), _pairs_with_hub, percent), "node long, hub long, similarity double")
    # A class has a hub for each of its bands at most.
    best = found.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct("similarity", "hub")), asc=False), 1, HUBS).alias("hubs"))
    best = best.select("node", F.posexplode("hubs").alias("nth", "h"))
    return best.select("node", "nth", F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b"))


def across_components(mixed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b that may link by their sketches: of mixed (band, df, node, n, component) those that share a band across components.

    A bucket is dealt into blocks of about ``BLOCK`` rows; each pair of its blocks is a task's work.
    """
    rows = _in_blocks(mixed).join(nodes.select("node", "sketch"), "node").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"), "block", "node", "n", "component", "sketch")
    dealt = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    return dealt.mapInArrow(_by_key(("band", "low", "high"), _pairs_of, percent), _PAIRS).select("a", "b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their full sets."""
    one, two = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    overlap = F.size(F.array_intersect("ta", "tb"))
    return both.filter(100 * overlap >= percent * (F.size("ta") + F.size("tb") - overlap)).select("a", "b")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in "ab":
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.filter("ca != cb").drop("ca", "cb")


def linked(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, component over the links among the nodes (node, k1, k2, class_id, n, sketch)."""
    shown = nodes.select("node", "n", "sketch").mapInArrow(_banded, "band long, node long, n long")
    hubs = shown.groupBy("band").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct(F.xxhash64("node", F.lit(5)).alias("h"), "node")).alias("hub")).filter("df > 1")
    buckets = written(shown.join(hubs.select("band", "df", F.col("hub.node").alias("hub")), "band"), "buckets")
    may = written(with_hubs(buckets, nodes, percent), "likely")
    first = may.filter("nth = 0").select("a", "b").distinct()

    def confirm(pairs: DataFrame) -> DataFrame:
        """Written links among the pairs; only the classes in them are hashed again."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        chosen = written(nodes.drop("sketch", "n").join(named, "node", "left_semi"), "chosen")
        found = docs.mapInArrow(_sets(id_filter(chosen.select("class_id")), shingle), "k1 long, k2 long, tokens array<long>")
        sets = written(found.join(chosen.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "tokens").dropDuplicates(["node"]), "sets")
        return written(confirmed(pairs, sets, percent), "links")

    links = confirm(written(first, "first"))
    labels = components(links)
    rest = written(_across(may.filter("nth > 0").select("a", "b").distinct(), labels).join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(confirm(rest))
        labels = components(links)
    # What is left: pairs across components that share a band but are no pair with a hub.
    marked = buckets.select("band", "df", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    marked = written(marked, "marked")
    mixed = marked.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    mixed = marked.filter("df > 2").join(mixed, "band")
    more = written(across_components(mixed, nodes, percent).join(may.select("a", "b").distinct(), ["a", "b"], "left_anti"), "more")
    if more.isEmpty():
        return labels
    return components(links.unionByName(confirm(more)))


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the row's id is its component's) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = written(sketches(docs, shingle), "sketches")
    own = every.filter("n > 0 AND doc_id IS NOT NULL")
    classes = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch"))
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = linked(docs, nodes, shingle, percent)
    named = nodes.select("node", "k1", "k2", "class_id").join(labels, "node")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    far = named.join(least, "component").select("k1", "k2", "component_id")
    ids = nodes.select("k1", "k2", "class_id").join(far, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("component_id", "class_id").alias("component_id"))
    out = every.drop("sketch").join(ids, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

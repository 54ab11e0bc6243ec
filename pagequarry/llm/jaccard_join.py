"""Near duplicates: exact Jaccard self-join of n-gram sets under several global token orders.

Two texts link when 5 * |A & B| >= 4 * |A | B| over their sets of five-word shingles.

*Classes.*  Texts with one word sequence are one class, whatever their ids; the work below is on classes, named by the sequence's hash,
of which the text with the least id is read again.  The rows follow through the class table.

*First order: by hash.*  A set of n shingles shows its first n - ceil(4n/5) + l under this
order, l = 1 + n // 20.  Linked sets share at least the smaller l of both prefixes, so a set
that shares fewer prefix shingles with all others together is out.  Nothing but prefixes
(a quarter of the shingles) is shuffled.

*Second order: rarest first.*  For the sets that are left, all shingles are counted exactly
(document frequency, ties by hash).  Shingles of one set alone come first and can't be
shared, so a set whose own shingles fill its prefix is out, and two sets link only if both
have enough shared ones (the bound on the overlap).  Candidate pairs share a prefix shingle under this order.

*Third order: unshared first, then by another hash.*  A candidate pair must share a prefix shingle under this
order as well, or it isn't verified: the candidates are the intersection of the orders' filters.

*Verification.*  A shingle that many sets show would give all pairs of them.  Instead the
set with the fewest unshared shingles is its hub: pairs with it and with one more set, the same for
all, are verified first, and linked sets contracted to components.  Then only pairs
across components are left, and of them those whose overlap can still be large enough from
the position of the common shingle on (a set that strays from its hub has its own shingles there);
each is verified exactly.  So no link between
different texts is lost as to reachability, and a group of near copies costs pairs in
proportion to its size.

Defined results: null and empty texts, and texts without words, have no shingles and stand
alone; fewer than five words are one shingle; a null id is in no component (null); repeated rows of one id and text are one document, an id's other texts
are documents of their own, and a component's id is the least id in it; an empty table gives no rows; further columns are
ignored.  Shingles and word sequences are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, released, written
from .idfilter import id_filter, may_hold, suspects
from .wordhash import mix, shingle_hashes, word_hashes

#: Texts hashed between two record batches.
LOT = 512
#: Prefix shingles that a task looks through for shared ones before it gives them out.
HELD = 200_000
#: Sequences that a task remembers to show a repeated text once.
SEEN = 100_000


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sequence_keys(words: np.ndarray) -> tuple[int, int]:
    ranks = np.arange(1, len(words) + 1, dtype=np.uint64)
    one = mix(words + ranks * np.uint64(0x9E3779B97F4A7C15))
    two = mix(one ^ (words * np.uint64(0xD6E8FEB86659FD93)))
    n = np.uint64(len(words))
    keys = mix(np.array([one.sum(dtype=np.uint64) ^ n, two.sum(dtype=np.uint64) + n], dtype=np.uint64)).view(np.int64)
    return int(keys[0]), int(keys[1])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Iterator[np.ndarray]]]:
    """Ids of a lot of rows and the word hashes of their texts."""
    for batch in released(batches):
        for k in range(0, batch.num_rows, LOT):
            part = batch.slice(k, LOT)
            texts = part.column(1).cast(pa.binary()).to_pylist()
            yield part.column(0), word_hashes(texts)


def _nodes(batches):
    for ids, hashes in _lots(batches):
        keys = [(*_sequence_keys(w), len(np.unique(shingle_hashes(w)))) for w in hashes]
        one, two, n = zip(*keys, strict=True)
        yield pa.RecordBatch.from_arrays([ids, pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "k1", "k2", "n"])


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, two halves of the sequence's hash, size of the shingle set."""
    return docs.mapInArrow(_nodes, "doc_id long, k1 long, k2 long, n long")


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 + n // 20


class _Prefixes:
    """Prefix shingles of some texts, in the form that is shuffled."""

    def __init__(self):
        self.tokens, self.docs, self.sizes, self.n = [], [], [], 0

    def add(self, doc: int, shown: np.ndarray, size: int) -> None:
        self.tokens.append(shown)
        self.docs.append(doc)
        self.sizes.append(size)
        self.n += len(shown)

    def rows(self) -> pa.RecordBatch:
        """A row for each shingle that one text alone shows; for the others one row without a
        text, and for their texts how many such shingles they have (``known``): these are shared already.
        So a shingle that a third of all texts show is a few rows of a task."""
        tokens, docs = np.concatenate(self.tokens), np.array(self.docs, dtype=np.int64)
        owner = np.repeat(np.arange(len(docs)), [len(t) for t in self.tokens])
        distinct, which, times = np.unique(tokens, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        known = np.bincount(owner[twice], minlength=len(docs))
        some = np.flatnonzero(known)
        single = owner[~twice]
        present = distinct[times > 1]
        sizes = np.array(self.sizes, dtype=np.int32)
        doc = pa.chunked_array([pa.array(docs[single]), pa.nulls(len(present), pa.int64()), pa.array(docs[some])]).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                _as_long(np.concatenate([tokens[~twice], present, mix(docs[some].view(np.uint64))])),
                doc,
                pa.array(np.concatenate([sizes[single], np.zeros(len(present), np.int32), sizes[some]])),
                pa.array(np.concatenate([np.zeros(len(single) + len(present), np.int32), known[some].astype(np.int32)])),
            ],
            names=["token", "doc", "n", "known"],
        )


def _hash_prefixes(batches):
    seen: set[tuple[int, int]] = set()
    held = _Prefixes()
    for ids, hashes in _lots(batches):
        for doc, words in zip(ids.to_pylist(), hashes, strict=True):
            if doc is None or not len(words):
                continue
            key = _sequence_keys(words)
            if key in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(key)
            shingles = np.unique(shingle_hashes(words))
            held.add(key[0], shingles[: prefix_length(len(shingles))], len(shingles))
            if held.n >= HELD:
                yield held.rows()
                held = _Prefixes()
    if held.n:
        yield held.rows()


def first_order(docs: DataFrame) -> DataFrame:
    """doc (a class): those that share enough of their prefix by hash."""
    # Dealt by token once: the count and the join find their rows in the same exchange.
    shown = docs.mapInArrow(_hash_prefixes, "token long, doc long, n int, known int").repartition("token")
    shared = shown.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token", F.lit(True).alias("again"))
    shared = shown.filter("doc IS NOT NULL").join(shared, "token", "left").filter("again OR known > 0")
    shared = shared.groupBy("doc").agg(F.sum(F.greatest("known", F.lit(1))).alias("shared"), F.max("n").alias("n"))
    return shared.filter("shared >= 1 + ((4 * n + 4) div 5) div 20").select("doc")


def _all_shingles(field: np.ndarray):
    def run(batches):
        for batch in released(batches):
            ids = np.asarray(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
            chosen = pa.array(may_hold(field, ids) & np.asarray(batch.column(0).is_valid()))
            for _, hashes in _lots([batch.filter(chosen)]):
                hashes = list(hashes)
                sets = [np.unique(shingle_hashes(w)) for w in hashes]
                sizes = [len(s) for s in sets]
                owner = np.repeat(np.array([_sequence_keys(w)[0] for w in hashes], dtype=np.int64), sizes)
                yield pa.RecordBatch.from_arrays([_as_long(np.concatenate(sets)), pa.array(owner), pa.array(np.repeat(np.array(sizes, dtype=np.int32), sizes))], names=["token", "doc", "n"])

    return run


def second_order(docs: DataFrame, chosen: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Of the texts whose id is chosen (doc), or of those of them that are of the given classes (doc): doc (the class), n, its shared shingles rarest first (tokens), how many of them its prefix has (m), and the
    prefix under the third order (other).

    Under both orders the shingles of one set alone come first, so both prefixes have m shared ones.
    """
    shingles = docs.mapInArrow(_all_shingles(id_filter(chosen)), "token long, doc long, n int")
    # Counted apart and joined, not in a window: counts are added up before they are shuffled, and a join's hot key is split.
    counts = shingles.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    counted = shingles.join(counts, "token")
    sets = counted.groupBy("doc").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("df", "token"))).alias("ranked"))
    sets = sets if classes is None else sets.join(classes, "doc", "left_semi")
    return (
        sets.withColumn("m", F.expr("n - (4 * n + 4) div 5 + 1 - (n - size(ranked))"))
        .filter("m > 0")
        .select("doc", "n", F.transform("ranked", lambda r: r["token"]).alias("tokens"), F.col("m").cast("int").alias("m"))
        .withColumn("other", F.transform(F.slice(F.array_sort(F.transform("tokens", third_order)), F.lit(1), F.col("m")), lambda r: r["token"]))
    )


def third_order(token: Column) -> Column:
    return F.struct(F.xxhash64(token, F.lit(31)).alias("rank"), token.alias("token"))


def may_link(na: str, ca: str, nb: str, cb: str) -> Column:
    """A link is possible by the sizes n and by c, the shared shingles from the common one on.

    The first common shingle in the second order leaves at most c others on either side, so the
    overlap that a link needs can't exceed c; a pair that links passes at that shingle.
    """
    return F.expr(f"5 * least({na}, {nb}) >= 4 * greatest({na}, {nb}) AND (4 * ({na} + {nb}) + 8) div 9 <= least({ca}, {cb})")


def candidates(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix shingle under the third order, too, with both sets (n, t)."""
    one, two = (sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"), F.col("other").alias(f"o{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    return both.filter(F.arrays_overlap("oa", "ob")).drop("oa", "ob")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, of those that pass the filter of the third order."""
    overlap = F.size(F.array_intersect("ta", "tb"))
    return candidates(pairs, sets).filter(5 * overlap >= 4 * (F.col("na") + F.col("nb") - overlap)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b).

    Each round hooks every node to its least smaller neighbour, follows the hooks to their
    roots by pointer jumping, and contracts the edges; all tables are written, so no lineage
    grows.  Rounds and jumps are logarithmic in the longest path.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hooks = written(edges.groupBy("b").agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("b").alias("root"), F.col("root").alias("higher"))
            jumped = written(hooks.join(up, "root", "left").select("b", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "hooks")
            moved, hooks = not jumped.filter("moved").isEmpty(), jumped.select("b", "root")
            if not moved:
                break
        to = hooks.select(F.col("b").alias("component"), F.col("root"))
        labels = written(labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        for end in "ab":
            edges = edges.join(hooks.select(F.col("b").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    return labels


def linked(sets: DataFrame) -> DataFrame:
    """node, component over the links among the sets."""
    shown = sets.select("doc", "n", F.size("tokens").alias("shared"), F.posexplode(F.slice("tokens", F.lit(1), F.col("m"))).alias("at", "token"))
    shown = shown.select("doc", "n", "token", "shared", (F.col("shared") - F.col("at")).alias("c"))
    least = F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), "n", "doc", "c"))
    some = F.min(F.struct(F.xxhash64("doc").alias("h"), "n", "doc", "c"))
    hubs = shown.groupBy("token").agg(F.count(F.lit(1)).alias("df"), least.alias("hub"), some.alias("other")).filter("df > 1")
    buckets = written(shown.join(hubs, "token"), "buckets")
    ends = F.array(*[F.struct(*[F.col(f"{h}.{c}") for c in ("doc", "n", "c")]) for h in ("hub", "other")])
    partners = buckets.select("doc", "n", "c", F.explode(ends).alias("o")).filter("o.doc != doc").filter(may_link("n", "c", "o.n", "o.c"))
    tried = written(partners.select(F.least("doc", "o.doc").alias("a"), F.greatest("doc", "o.doc").alias("b")).distinct(), "pairs")
    links = written(verified(tried, sets), "links")
    labels = components(links)
    # What is left: pairs across components that share a shown shingle.
    marked = buckets.select("token", "doc", "n", "c").join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
    marked = marked.withColumn("component", F.coalesce("component", "doc"))
    marked = written(marked.select("token", "doc", "n", "c", "component"), "marked")
    open_tokens = marked.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    mixed = written(marked.join(open_tokens, "token"), "mixed")
    one = mixed.toDF("token", "a", "na", "ca", "pa")
    two = mixed.toDF("token", "b", "nb", "cb", "pb")
    rest = one.join(two, "token").filter((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb"))).filter(may_link("na", "ca", "nb", "cb"))
    rest = rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = written(verified(rest, sets), "links")
    return labels if more.isEmpty() else components(links.unionByName(more))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2, n of every row of docs (doc_id, text); and k1, k2, class_id, component (a class of it), component_id of the classes.

    Both are written.  Several components may share their least id, where that id has several texts.
    """
    every = written(nodes(docs), "nodes")
    own = every.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(own.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id")), "classes")
    near = first_order(docs).withColumnRenamed("doc", "k1")
    chosen = written(classes.join(near, "k1", "left_semi").select(F.col("k1").alias("doc"), "class_id"), "chosen")
    sets = written(second_order(docs, chosen.select("class_id"), chosen.select("doc")), "sets")
    named = classes.join(linked(sets).withColumnRenamed("node", "k1"), "k1")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    far = named.join(least, "component").select("k1", "k2", "component", "component_id")
    labelled = classes.join(far, ["k1", "k2"], "left").select("k1", "k2", "class_id", F.coalesce("component", "k1").alias("component"), F.coalesce("component_id", "class_id").alias("component_id"))
    return every, written(labelled, "labelled")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least id with the same word sequence) of every id and text."""
    every, labelled = _components(_plain(docs, id_col, text_col))
    out = every.dropDuplicates(["doc_id", "k1", "k2"]).join(labelled, ["k1", "k2"], "left")
    own = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id"), own("class_id"))


@F.arrow_udf(T.LongType())
def _first_key(texts: pa.Array) -> pa.Array:
    out = []
    for k in range(0, len(texts), LOT):
        out += [_sequence_keys(w)[0] for w in word_hashes(texts.slice(k, LOT).cast(pa.binary()).to_pylist())]
    return pa.array(out, pa.int64())


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of docs for each component: of the rows with its least id one of the least sequence hash, once if it is repeated.

    Rows with a null id stay all.  Texts without words stand for themselves, once for an id that repeats them.
    A row goes by its id and its own text: other texts of a repeated id are judged for themselves.  Texts are
    read again only where the id has a row that goes.
    """
    every, labelled = _components(_plain(docs, id_col, text_col))
    rows = every.filter("doc_id IS NOT NULL").join(labelled, ["k1", "k2"], "left")
    best = rows.filter("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "k1")).alias("best"))
    judged = rows.join(best, "component", "left").withColumn("goes", F.col("n") > 0)
    judged = judged.withColumn("goes", F.col("goes") & (F.struct("doc_id", "k1") != F.col("best")))
    judged = judged.groupBy("doc_id", "k1").agg(F.max("goes").alias("goes"), F.count(F.lit(1)).alias("times")).filter("goes OR times > 1")
    judged = written(judged, "judged")
    key, listed, own, goes = fresh(docs, "sequence_key", "listed_id", "listed_key", "goes")
    clear, open_ = suspects(docs, judged.select("doc_id").distinct(), id_col)
    marked = judged.select(F.col("doc_id").alias(listed), F.col("k1").alias(own), F.col("goes").alias(goes))
    open_ = open_.withColumn(key, _first_key(F.coalesce(F.col(text_col), F.lit(""))))
    found = open_.join(marked, (open_[id_col].cast("long") == marked[listed]) & (open_[key] == marked[own]), "left")
    single = found.filter(F.col(goes).isNull())
    again = found.filter(~F.col(goes)).dropDuplicates([id_col, key])
    return clear.unionByName(single.unionByName(again).select(*docs.columns))

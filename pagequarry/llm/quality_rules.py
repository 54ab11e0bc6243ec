"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document.  The ledger keeps the measurements
and one integer whose bit b is set when rule b fails.  A policy is a version
and a mask of the rules it enforces, so verdicts of any policy, and ablations
of its rules, are bitwise operations on the ledger; no text is read again.

Only DataFrame functions are used.  No row leaves its partition: measuring is
a projection, ablation a partial aggregation with one row per policy and rule.

Defined results: a null or empty text has no words and every count 0 (and so
fails ``few_words``); repeated rows are measured each for itself; an empty
table gives an empty ledger; extra input columns are ignored by ``ledger`` and
kept untouched by ``apply_policy``.  Repeated windows are compared by a 64-bit
hash of the hashes of their five words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, fresh

#: Words in a window of the repetition measure.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_CHAR = r"[^\x20\x09-\x0D]"
#: Runs of characters that no rule counts; what is left of a text is short, so counting in it costs little.
NO_MARKS = r"[^A-Z!#*$%&|<>]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs")

#: (name, SQL condition under which the rule fails); the position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("capitals", "10 * n_capitals > 5 * word_chars"),
    ("exclamations", "4 * n_bangs > n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << b for b, (name, _) in enumerate(RULES)}
        return sum(bits[name] for name in set(self.rules))


#: ``base`` is the fixed floor; later versions only add rules to it.
BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", (*BASE.rules, "symbols"))
V2 = Policy("v2", tuple(name for name, _ in RULES))
POLICIES = (BASE, V1, V2)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements of each text, as long columns."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD_CHAR))
    first = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).select(
        "id",
        F.array_remove(F.split("text", WS_CLASS, -1), "").alias("words"),
        F.regexp_replace("text", NO_MARKS, F.lit("")).alias("marks"),
        lines.alias("lines"),
    )

    def marks(chars: str) -> Column:
        return F.length("marks") - F.length(F.translate("marks", chars, ""))

    hashed = first.select(
        "id",
        F.length(F.array_join("words", "")).alias("word_chars"),
        marks(SYMBOLS).alias("n_symbols"),
        marks(CAPITALS).alias("n_capitals"),
        marks("!").alias("n_bangs"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("words").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = [F.lit(k) for k in range(WINDOW)]
    windows = hashed.select(
        "*",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in at])),
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    ).drop("hashes")
    # Sorting is left to the few texts that repeat a window at all.
    paired = windows.select(
        "*",
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
    ).drop("windows")

    def twice(k: Column) -> Column:
        own = F.get("sorted", k)["h"]
        return own.eqNullSafe(F.get("sorted", k - 1)["h"]) | own.eqNullSafe(F.get("sorted", k + 1)["h"])

    places = paired.select(
        "*",
        F.when(
            F.col("sorted").isNotNull(),
            F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), twice), lambda k: F.get("sorted", k)["i"])),
        ).alias("places"),
    ).drop("sorted")
    steps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return places.withColumn("n_repeat_words", covered).select(F.col("id").alias(id_col), *[F.col(m).cast("long").alias(m) for m in MEASURES])


def failure_bits() -> Column:
    """One long whose bit b tells that rule b fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, (_, cond) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements and ``failed_bits``: everything a policy needs, without texts."""
    return measure(docs, id_col, text_col).withColumn("failed_bits", failure_bits())


def kept(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def verdicts(book: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """The ledger with a ``kept_<version>`` column for each policy."""
    return book.select("*", *[kept(p).alias(f"kept_{p.version}") for p in policies])


def ablations(book: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: how many documents the rule fails, how many it alone
    rejects (those a policy without it would keep), and how many are rejected at
    all; with the union and intersection of the failure bits of the rejected.
    """
    masks = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask")) for p in policies])
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, (name, _) in enumerate(RULES)])
    counted = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows from here on
    by_policy = counted.select("failed_bits", "n", F.inline(masks)).withColumn("hit", F.col("failed_bits").bitwiseAND(F.col("mask")))
    total = by_policy.select("*", F.inline(rules)).filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    fails = F.col("hit").bitwiseAND(F.col("bit")) != 0
    rejected = F.col("hit") != 0
    none = F.lit(0).cast("long")
    return total.groupBy("policy", "rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(none)).alias("n_fail"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(none)).alias("n_only"),
        F.sum(F.when(rejected, F.col("n")).otherwise(none)).alias("n_rejected"),
        F.coalesce(F.bit_or(F.when(rejected, F.col("hit"))), none).alias("any_bits"),
        F.coalesce(F.bit_and(F.when(rejected, F.col("hit"))), none).alias("all_bits"),
    )


def apply_policy(docs: DataFrame, policy: Policy = V2, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    (name,) = fresh(docs, "ledger_row")
    packed = docs.withColumn(name, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    book = ledger(packed, id_col=name, text_col=text_col)
    # A bit that is always 0 but not deterministic: else the filter is pushed below the projections
    # of the measurements, each of which would be written out again and again inside of it.
    never = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    book = book.withColumn("failed_bits", F.col("failed_bits").bitwiseOR(never))
    return book.filter(kept(policy)).select(f"{name}.*")

"""Mixing sources to target weights by temperature.

A source's share of all tokens, to the power ``alpha`` and normalised, is its
weight: 1 keeps the corpus' own mix, 0 makes all sources equal, more than 1
favours the largest.  ``alpha`` is found by bisection: for a target entropy, as
the entropy of the weights falls while ``alpha`` grows, the exponent that meets
it; for a repetition limit the smallest one with which no source is read more
often than the limit, which lies between 0 and 1, as at 1 all sources are read
equally often.  ``plan`` refuses a target that no exponent meets.

The weights are realised within a budget of tokens.  Each source's documents
fall into blocks (by a hash of their place, about ``BLOCK`` documents each); an
epoch is a permutation of the blocks and, within a block, of its documents.
Whole epochs are as many as the source's budget holds, and the rest is the
prefix of the next permutation that fits.  Running sums go over groups of about
``GROUP`` blocks, over the blocks of a group, and over the documents of a
block, so no window holds a source: a hot source is many blocks, a small table
row each.  ``mix`` writes the corpus in the order of the permutations, all
sources side by side by their place in their budgets; it needs no running sum
over texts, as per source two thresholds (the block and the document at which
the budget ends) tell what the last epoch reads.

The source table (one row per source, ``MOST_SOURCES`` at most, else an error) comes to the driver, where the bisection
runs.  Tokens are white-space words.

Results for odd input: a null or empty text has no tokens and is a member of
each epoch at no cost; sources of any type are told apart by their strings, and null sources are one source of their own; repeated rows
are each mixed, and those of one block that repeat as a whole enter the last epoch together or not at all; an empty table gives an empty result; columns that are added
replace equally named ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, text_or_empty

BLOCK = 512
GROUP = 4096
MOST_SOURCES = 1_000_000


@dataclass(frozen=True)
class Target:
    """Exactly one of ``entropy`` (nats) and ``repeats`` (times a source may be read).

    ``budget`` is a multiple of the corpus' tokens; None takes the least with
    which every source is read at least once, so that no document is left out.
    """

    entropy: float | None = None
    repeats: float | None = None
    budget: float | None = 1.0


def weights(tokens: dict, alpha: float) -> dict:
    """Normalised shares to the power ``alpha``; sources without tokens weigh nothing."""
    top = max(tokens.values(), default=0)
    raised = {k: (n / top) ** alpha if n else 0.0 for k, n in tokens.items()}
    total = sum(raised.values())
    return {k: x / total if total else 0.0 for k, x in raised.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def total_budget(tokens: dict, w: dict, target: Target) -> float:
    if target.budget is not None:
        return target.budget * sum(tokens.values())
    return max((tokens[k] / w[k] for k in w if w[k] > 0), default=0.0)


def repetition(tokens: dict, w: dict, target: Target) -> float:
    budget = total_budget(tokens, w, target)
    return max((budget * w[k] / n for k, n in tokens.items() if n), default=0.0)


def solve(tokens: dict, target: Target) -> float:
    """The exponent, 0 at least and for a repetition limit 1 at most; the nearer end where none meets the target."""
    if (target.entropy is None) == (target.repeats is None):
        raise ValueError("give an entropy or a repetition limit")

    def below(alpha: float) -> bool:  # is alpha too small?
        w = weights(tokens, alpha)
        return entropy(w) > target.entropy if target.entropy is not None else repetition(tokens, w, target) > target.repeats

    low, high = 0.0, 1.0
    if not below(low):
        return low
    while below(high):
        if target.entropy is None or high > 1e12:
            return high
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) else (low, mid)
    return high


def met(tokens: dict, w: dict, target: Target) -> bool:
    """Do the weights meet the target?  Without tokens there is nothing to meet."""
    if not any(tokens.values()):
        return True
    if target.entropy is not None:
        return abs(entropy(w) - target.entropy) <= 1e-6
    return repetition(tokens, w, target) <= target.repeats * (1 + 1e-9)


_ADDED = ("n_tokens", "copies", "mix_key")
_SID, _BLOCK = "__bq_sid", "__bq_block"


def _turns(seed: int, epoch: Column) -> dict[str, Column]:
    """What orders the blocks of an epoch, and the documents of a block."""
    return {"__bq_turn": F.xxhash64(F.lit(seed + 1), epoch, _SID, _BLOCK), "__bq_inner": F.xxhash64(F.lit(seed + 2), epoch, "__bq_key")}


def _uniform(turn: str) -> Column:
    """A hash as a number from 0 to 1, in its order."""
    return F.col(turn) / F.lit(2.0**64) + 0.5


class _Plan:
    """The sources' budgets and the places at which they end, from one pass over the texts."""

    def __init__(self, docs: DataFrame, target: Target, seed: int):
        self.seed = seed
        thin = checkpoint(docs.select(*[c.alias(n) for n, c in self.facts().items()]))
        counted = thin.groupBy("__bq_of").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
        if len(counted) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        tokens = {r["__bq_of"]: r["tokens"] for r in counted}
        found = weights(tokens, solve(tokens, target))
        if not met(tokens, found, target):
            raise ValueError(f"no exponent gives {target} for shares of these sources")
        budget = total_budget(tokens, found, target)
        table = []
        for number, r in enumerate(counted):
            share = budget * found[r["__bq_of"]]
            epochs = int(share / r["tokens"] * (1 + 1e-12)) if r["tokens"] else 0
            rest = share - epochs * r["tokens"]
            if epochs and rest < 0.5:  # less than a token: no further epoch
                rest = -1.0
            table.append((number, r["__bq_of"], max(1, math.ceil(r["docs"] / BLOCK)), epochs, rest * (1 + 1e-12), share, float(r["tokens"])))
        kinds = {_SID: pa.int32(), "__bq_source": pa.string(), "__bq_blocks": pa.int32(), "__bq_epochs": pa.int32(), "__bq_rest": pa.float64(), "__bq_budget": pa.float64(), "__bq_all": pa.float64()}
        # A local relation has a known size, by which Spark broadcasts it or not.
        self.sources = docs.sparkSession.createDataFrame(pa.table({c: pa.array([r[i] for r in table], k) for i, (c, k) in enumerate(kinds.items())}))

        self.dealt = self.deal(thin)
        per_block = [F.first(c).alias(c) for c in ("__bq_turn", "__bq_blocks", "__bq_rest")]
        blocks = self.dealt.groupBy(_SID, _BLOCK).agg(F.sum("n_tokens").alias("__bq_in"), *per_block)
        groups = F.ceil(F.col("__bq_blocks") / GROUP)
        blocks = blocks.withColumn("__bq_group", F.least(F.floor(_uniform("__bq_turn") * groups), groups - 1))
        over = Window.partitionBy(_SID).orderBy("__bq_group")
        sums = blocks.groupBy(_SID, "__bq_group").agg(F.sum("__bq_in").alias("__bq_sum"))
        sums = sums.select(_SID, "__bq_group", (F.sum("__bq_sum").over(over) - F.col("__bq_sum")).alias("__bq_past"))
        within = Window.partitionBy(_SID, "__bq_group").orderBy("__bq_turn", _BLOCK)
        before = F.col("__bq_past") + F.sum("__bq_in").over(within) - F.col("__bq_in")
        self.placed = checkpoint(blocks.join(sums, [_SID, "__bq_group"]).withColumn("__bq_before", before))

    def facts(self) -> dict[str, Column]:
        return {
            "n_tokens": F.regexp_count(text_or_empty(), F.lit(r"\S+")).cast("long"),
            "__bq_key": F.xxhash64(F.lit(self.seed), F.col("doc_id").cast("string"), "text"),
            "__bq_of": F.col("source").cast("string"),
        }

    def deal(self, rows: DataFrame) -> DataFrame:
        """Rows with their source's budget, their block, and their turns in the last epoch."""
        joined = rows.join(self.sources, F.col("__bq_of").eqNullSafe(F.col("__bq_source"))).withColumn(_BLOCK, F.pmod("__bq_key", F.col("__bq_blocks")))
        return joined.withColumns(_turns(self.seed, F.col("__bq_epochs")))

    def upto(self, dealt: DataFrame) -> DataFrame:
        """Add the tokens of the last epoch up to and with each row.  Blocks are of a bounded size, so the window is; it has the join's partitioning."""
        inner = Window.partitionBy(_SID, _BLOCK).orderBy("__bq_inner", "__bq_key")  # equal rows together
        placed = dealt.join(self.placed.select(_SID, _BLOCK, "__bq_before"), [_SID, _BLOCK])
        return placed.withColumn("__bq_upto", F.col("__bq_before") + F.sum("n_tokens").over(inner))

    def ends(self) -> DataFrame:
        """Per source the block, and in it the last document, of the last epoch that the budget still reads; at most a row per source."""
        stop = self.placed.filter(F.col("__bq_before") + F.col("__bq_in") > F.col("__bq_rest")).groupBy(_SID).agg(F.min(F.struct("__bq_turn", _BLOCK)).alias("s"))
        # Local relations of known size again, so that no source is the key of a shuffle.
        stop = self._local(stop.select(_SID, F.col("s.__bq_turn").alias("__bq_stop_turn"), F.col(f"s.{_BLOCK}").alias("__bq_stop_block")))
        last = self.dealt.join(stop, _SID).filter((F.col("__bq_turn") == F.col("__bq_stop_turn")) & (F.col(_BLOCK) == F.col("__bq_stop_block")))
        last = self.upto(last).filter("__bq_upto <= __bq_rest").groupBy(_SID).agg(F.max(F.struct("__bq_inner", "__bq_key")).alias("c"))
        last = last.select(_SID, F.col("c.__bq_inner").alias("__bq_cut_inner"), F.col("c.__bq_key").alias("__bq_cut_key"))
        return self._local(stop.join(last, _SID, "left"))

    def _local(self, table: DataFrame) -> DataFrame:
        return table.sparkSession.createDataFrame(table.toArrow())  # at most a row per source; from Arrow, so its size is known


def plan(docs: DataFrame, target: Target, seed: int = 0) -> DataFrame:
    """Add ``n_tokens``, ``copies`` (times the mix reads the row) and ``mix_key``.

    ``mix_key`` is the place of a row's last copy within its source's budget,
    from 0 to 1: in the order of ``mix_key`` every prefix has about the target
    weights.
    """
    p = _Plan(docs, target, seed)
    base = [c for c in docs.columns if c.lower() not in _ADDED]
    rows = p.upto(p.deal(docs.select(*base).withColumns(p.facts())))
    more = (F.col("__bq_upto") <= F.col("__bq_rest")).cast("int")
    place = F.when(F.col("__bq_budget") > 0, ((F.col("__bq_epochs") - 1 + more) * F.col("__bq_all") + F.col("__bq_upto")) / F.col("__bq_budget")).otherwise(0.0)
    return rows.select(*base, "n_tokens", (F.col("__bq_epochs") + more).alias("copies"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), place)).alias("mix_key"))


def mix(docs: DataFrame, target: Target, seed: int = 0) -> DataFrame:
    """The mixed corpus in the input's columns: each row as often as the plan reads it, in the order of the blocks' permutations.

    Rows are sorted by their place in their source's budget, block by block;
    files of the result, read in the order of their names, keep that order.
    """
    p = _Plan(docs, target, seed)
    names = {c: f"__bq_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.withColumns(p.facts() | {n: F.col(f"`{c}`") for c, n in names.items()})
    dealt = p.deal(rows).join(p.ends(), _SID, "left")
    here, stop = F.struct("__bq_turn", _BLOCK), F.struct(F.col("__bq_stop_turn").alias("__bq_turn"), F.col("__bq_stop_block").alias(_BLOCK))
    cut = F.struct(F.col("__bq_cut_inner").alias("__bq_inner"), F.col("__bq_cut_key").alias("__bq_key"))
    inside = F.col("__bq_cut_key").isNotNull() & (F.struct("__bq_inner", "__bq_key") <= cut)
    more = F.when(F.col("__bq_stop_turn").isNull() | (here < stop), 1).when(here == stop, F.coalesce(inside, F.lit(False)).cast("int")).otherwise(0)
    epochs = F.expr("sequence(0, __bq_copies - 1)")
    copies = dealt.withColumn("__bq_copies", F.col("__bq_epochs") + more).filter("__bq_copies > 0").withColumn("__bq_epoch", F.explode(epochs))
    copies = copies.withColumns(_turns(seed, F.col("__bq_epoch")))
    place = F.when(F.col("__bq_budget") > 0, (F.col("__bq_epoch") + _uniform("__bq_turn")) * F.col("__bq_all") / F.col("__bq_budget")).otherwise(_uniform("__bq_turn"))
    order = ["__bq_place", _SID, _BLOCK, "__bq_inner", "__bq_key"]
    placed = copies.withColumn("__bq_place", place).select(*names.values(), *order)
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(n).alias(c) for c, n in names.items()])

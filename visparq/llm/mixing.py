"""Mixing sources to target weights by hierarchical budgets.

Targets run down a tree of domain, language and source. A node's budget is shared among its children by weight; a child
that cannot take its share (its tokens times ``max_epochs``) is filled, and its shortage goes to its siblings, so it
reaches the node's own siblings only when the whole node is full. Each leaf then takes whole epochs and a token prefix of
one more, in an order seeded by epoch.

All integers, all DataFrame functions. A leaf that holds a third of the rows is never in one task: rows with one place in
the seeded order are counted first, then the prefix is found among ranges of the order (map-side sums), then within a
range. A leaf's prefix is named by its last place, so documents are taken or left where they are read: no text is shuffled.

Defined cases: a null text has no tokens; null ids order first, and are seeded by their number of tokens; null languages or
sources are leaves named ''; children without a weight have weight 1; repeated rows (one id and number of tokens in a leaf)
have one place in the order and are taken together or not at all; an empty table gives an empty result; extra columns are
not read, or returned untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visparq.llm._common import durable, spread_join, unwrapped, words_of

MODULUS, SLOT_BITS = 2**31 - 1, 21
LEVELS = ("domain", "lang", "source")
BOUND = 200_000  # leaves whose cuts (100 bytes each) may be broadcast; more are joined by shuffle, heavy ones spread


def seeded(place: Column, seed: Column) -> Column:
    """A number below 2**31 - 1 for a document in an epoch; two multiplicative rounds that any SQL engine can repeat."""
    x = (F.pmod(place, F.lit(MODULUS)) * 48271 + seed * 1_000_003) % MODULUS
    return ((x * x) % MODULUS * 69621 + x) % MODULUS


def leaves_of(docs: DataFrame, domain: Column) -> DataFrame:
    """doc (all columns), doc_id, domain, lang, source, n_tokens (words of the whole text)."""
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), domain.alias("domain"))
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    return named.select("doc", F.col("doc.doc_id").cast("long").alias("doc_id"), "domain", *(F.coalesce(F.col(f"doc.{c}").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.size(words_of(text)).cast("long").alias("n_tokens"))


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the budget shared by weight, with the shortage of full children moved to their siblings.

    Children in order of capacity for their weight: a child is full if its share of what is left exceeds its capacity, and
    the full ones come first, so one pass of running sums finds them all.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    marked = children.withColumns({"left": left, "open": F.sum("weight").over(after)}).withColumn("full", F.col("capacity") * F.col("open") <= F.col("left") * F.col("weight"))
    whole = Window.partitionBy(*parent)
    spent, open_weight = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(1))
    rest = F.expr("(budget - spent) * weight div open_weight")
    return marked.withColumns({"spent": spent, "open_weight": open_weight}).withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(rest)).drop("left", "open", "full", "spent", "open_weight")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """domain, lang, source, supply, given: tokens that each leaf may give; ``percent`` of all tokens is the whole budget."""
    own = leaves.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    own = own.withColumn("capacity", F.col("supply") * max_epochs).withColumn("root", F.lit(0))
    parent, given = ["root"], None
    for depth, level in enumerate(LEVELS):
        keys = ["root", *LEVELS[: depth + 1]]
        nodes = own.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights.get(level, {})))
        if given is None:
            children = nodes.withColumn("total", F.sum("supply").over(Window.partitionBy("root"))).withColumn("budget", F.expr(f"total * {percent} div 100")).drop("total")
        else:
            children = nodes.join(given.select(*parent, "budget"), parent)
        given = share(children, parent, level).select(*keys, "supply", F.col("given").alias("budget"))
        parent = keys
    return given.select(*LEVELS, "supply", F.col("budget").alias("given"))


def _place(seed: int) -> Column:
    """A document's place in its leaf's order for the epoch that is cut."""
    key = seeded(F.coalesce("doc_id", "n_tokens"), F.col("whole") + seed)
    return F.struct(key.alias("key"), F.col("doc_id").alias("doc_id"), F.col("n_tokens").alias("n_tokens"))


def cuts(leaves: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """leaf, whole (epochs that every document has), last (the place up to which one more epoch reaches; null: nobody)."""
    epochs = plan.select(F.struct(*LEVELS).alias("leaf"), F.expr("CASE WHEN supply > 0 THEN given div supply ELSE 0 END").alias("whole"), F.expr("CASE WHEN supply > 0 THEN given % supply ELSE 0 END").alias("part"))
    few = epochs.count() <= BOUND
    counted = leaves.groupBy(F.struct(*LEVELS).alias("leaf"), "doc_id", "n_tokens").agg((F.count("*") * F.col("n_tokens")).alias("tokens"))
    known = counted.join(F.broadcast(epochs), "leaf") if few else spread_join(counted, epochs, "leaf", F.struct("doc_id", "n_tokens"))
    keyed = known.withColumn("place", _place(seed)).withColumn("slot", F.shiftright("place.key", SLOT_BITS))
    leaf = Window.partitionBy("leaf").orderBy("slot")
    slots = keyed.groupBy("leaf", "slot").agg(F.sum("tokens").alias("sum")).select("leaf", "slot", (F.sum("sum").over(leaf) - F.col("sum")).alias("ahead"))
    inside = Window.partitionBy("leaf", "slot").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(slots, ["leaf", "slot"]).withColumn("upto", F.col("ahead") + F.sum("tokens").over(inside))
    last = placed.where("upto <= part").groupBy("leaf").agg(F.max("place").alias("last"))
    return durable(epochs.join(last, "leaf", "left").select("leaf", "whole", "last"), "cuts")


def _decided(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int, keep: list[str]) -> DataFrame:
    leaves = durable(leaves_of(docs, domain).select(*keep, "doc_id", *LEVELS, "n_tokens") if "doc" in keep else leaves_of(docs, domain).drop("doc"), "leaves")
    end = cuts(leaves, durable(budgets(leaves, weights, percent, max_epochs), "budgets"), seed)
    keyed = leaves.withColumn("leaf", F.struct(*LEVELS))
    joined = keyed.join(F.broadcast(end), "leaf") if end.count() <= BOUND else spread_join(keyed, end, "leaf", F.struct("doc_id", "n_tokens"))
    return joined.withColumn("n_copies", F.col("whole") + F.when(_place(seed) <= F.col("last"), 1).otherwise(0))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int = 100, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, n_copies (0: not taken) of every document."""
    return _decided(docs, domain, weights, percent, max_epochs, seed, []).select("doc_id", *LEVELS, "n_tokens", "n_copies")


def apply_mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int = 100, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """The documents of the mix, all columns, each as often as it was taken."""
    taken = _decided(docs, domain, weights, percent, max_epochs, seed, ["doc"]).where("n_copies > 0")
    return unwrapped(taken.select("doc", F.explode(F.expr("sequence(1L, n_copies)")).alias("copy")), docs.columns)

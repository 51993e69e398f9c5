"""Mixing sources to target weights by hierarchical budgets.

A total budget of tokens goes down a tree of levels (domain, language, source): children share
their parent's budget by weight, none gets more than it has (its tokens times the allowed epochs),
and what one cannot use goes to its siblings by their weights. As a child's room is known before
the budget is shared, shortages are made up among the nearest relatives first and reach an ancestor's
siblings only when a whole subtree is used up.

Each leaf then takes its budget from seeded epochs: every epoch has its own order of the leaf's
documents, whole epochs are taken whole, and of the last one the longest prefix that stays within
the rest. Documents with one place in the order (rows that repeat an id) stay or go together.

The prefix is found without sorting a leaf: sums by range of the order, 256 of them at a time, tell the
range where the budget ends, and only a range of few documents is ordered. What goes back to the documents is one row per leaf,
the first place left out, so that no text is shuffled.

A null level is a value of its own. A null or empty text has no tokens, and is taken when its place
in the order is. An empty table gives an empty result, a budget of nothing none but documents
without tokens. Other columns are carried; one that has the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import stage

DOCS_PER_RANGE = 5_000
DIGITS = 32  # of the digest that orders an epoch


def word_tokens(text: Column) -> Column:
    """Number of words between ASCII white space."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def _key(column: str) -> Column:
    """A level's value as a string that is never null."""
    value = F.col(f"`{column}`").cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))


def _weight(key: str, weights: Mapping[str | None, int]) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        if weight < 0:
            raise ValueError("weights are not negative")
        out = F.when(F.col(key) == ("" if value is None else f"={value}"), F.lit(weight)).otherwise(out)
    return out


def share(children: DataFrame, parent: Sequence[str], own: str) -> DataFrame:
    """``budget`` of each child (capacity, weight, parent_budget), filled up by weight.

    Children in the order of capacity per weight: while a child's fair part of what is left reaches
    its capacity it is filled; the others share the rest, with rounding carried along so that
    nothing is lost.
    """
    big = "decimal(38,0)"
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = by.orderBy(ratio.asc_nulls_last(), own)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = (
        children.withColumn("_place", F.row_number().over(order))
        .withColumn("_left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(after))
    )
    full = F.col("capacity").cast(big) * F.col("_weights") <= F.col("weight").cast(big) * F.greatest("_left", F.lit(0))
    marked = placed.withColumn("_open", F.min(F.when(~full, F.col("_place"))).over(by))
    at_open = lambda c: F.max(F.when(F.col("_place") == F.col("_open"), F.col(c))).over(by)
    known = marked.withColumn("_rest", at_open("_left").cast(big)).withColumn("_all", at_open("_weights"))
    # the open children's parts end at rounded places along the rest, so that they add up to it
    part = F.when(F.col("_all") > 0, F.expr(
        "(_rest * (_all - _weights + weight)) div _all - (_rest * (_all - _weights)) div _all"
    )).otherwise(F.lit(0))
    budget = F.when(F.col("_open").isNull() | (F.col("_place") < F.col("_open")), F.col("capacity")).otherwise(
        F.greatest(F.least(part, F.col("capacity")), F.lit(0))
    )
    return known.withColumn("budget", budget.cast("long")).drop(
        "_place", "_left", "_weights", "_open", "_rest", "_all"
    )


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str | None, int]], total: int, epochs: int
) -> DataFrame:
    """(levels, tokens, budget) of each leaf, from (levels as keys, tokens)."""
    roomy = leaves.withColumn("capacity", F.col("tokens") * epochs)
    above: DataFrame | None = None
    for depth, own in enumerate(levels):
        keys = list(levels[: depth + 1])
        nodes = roomy.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(own, weights.get(own, {})).cast("long"))
        if above is None:
            nodes = nodes.withColumn("parent_budget", F.lit(total).cast("long"))
        else:
            nodes = nodes.join(above.withColumnRenamed("budget", "parent_budget"), keys[:-1])
        above = share(nodes, keys[:-1], own).select(*keys, "budget")
    return leaves.join(above, list(levels))


def plan(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str | None, int]],
    total: float | int,
    epochs: int,
    seed: int,
    id_col: str,
    tokens: Column,
) -> DataFrame:
    """(levels as keys, tokens, budget, whole, cut) of each leaf, written to the shared folder.

    ``total`` is a number of tokens, or, below 1 or a float, a share of all there are. ``whole``
    epochs are taken whole; of the next one what comes before ``cut``, all if it is null.
    """
    keys = [f"_k{i}" for i in range(len(levels))]
    named = [_key(c).alias(k) for c, k in zip(levels, keys)]
    own_id = F.col(f"`{id_col}`").cast("string").alias("_id")
    narrow = stage(docs.select(*named, own_id, tokens.alias("_tokens")), "mix-tokens")
    leaves = stage(
        narrow.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("_docs")), "leaves"
    )
    all_tokens, all_docs = leaves.agg(F.sum("tokens"), F.sum("_docs")).first()
    amount = int(total * (all_tokens or 0)) if isinstance(total, float) else total
    by_key = {k: weights.get(c, {}) for c, k in zip(levels, keys)}
    given = budgets(leaves, keys, by_key, amount, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(epochs))
    rest = F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(0))
    given = stage(given.withColumn("whole", whole.cast("int")).withColumn("_rest", rest.cast("long")), "budgets")

    ordered = narrow.join(given.filter(F.col("whole") < epochs).select(*keys, "whole", "_rest"), keys).withColumn(
        "_order", place(F.col("_id"), F.col("whole"), seed)
    )
    cut_range = _ranges(ordered, keys)
    inside = ordered.join(cut_range, keys).filter(F.startswith(F.col("_order"), F.col("_range")))
    line = Window.partitionBy(*keys).orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    left_out = inside.withColumn("_end", F.col("_before") + F.sum("_tokens").over(line)).filter(
        F.col("_end") > F.col("_rest")
    )
    cuts = left_out.groupBy(*keys).agg(F.min("_order").alias("cut"))
    return stage(given.join(cuts, keys, "left").select(*keys, "tokens", "budget", "whole", "cut"), "mix")


def _ranges(ordered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _range, _before) of each leaf whose budget ends inside it: the beginning of the order that
    the documents around the cut share, and the tokens before them.

    Each step looks at two more digits: 256 sums for a leaf, whatever its size. It ends when no leaf has
    more than ``DOCS_PER_RANGE`` documents left, or the digest has no more digits.
    """
    state = None
    for depth in range(0, DIGITS, 2):
        if state is None:
            rows = ordered.withColumn("_range", F.lit("")).withColumn("_before", F.lit(0).cast("long"))
        else:
            rows = ordered.join(state.drop("_docs"), list(keys)).filter(F.startswith(F.col("_order"), F.col("_range")))
        next_digits = F.concat("_range", F.substring("_order", depth + 1, 2)).alias("_next")
        sums = rows.groupBy(*keys, "_before", next_digits).agg(
            F.sum("_tokens").alias("_sum"), F.count("*").alias("_docs"), F.max("_rest").alias("_rest")
        )
        end = F.col("_before") + F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_next"))
        # the first range that does not fit
        over = sums.withColumn("_end", end).filter(F.col("_end") > F.col("_rest"))
        first = F.min(F.struct("_next", (F.col("_end") - F.col("_sum")).alias("before"), "_docs")).alias("_cut")
        found = over.groupBy(*keys).agg(first)
        state = stage(
            found.select(*keys, F.col("_cut._next").alias("_range"), F.col("_cut.before").alias("_before"), F.col("_cut._docs").alias("_docs")),
            "ranges",
        )
        if (state.agg(F.max("_docs")).first()[0] or 0) <= DOCS_PER_RANGE:
            break
    return state.drop("_docs")


def place(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A document's place in the order of an epoch: the same everywhere, and different by epoch."""
    named = F.coalesce(doc_id, F.lit(""))
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), named)), F.lit(":"), named)


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str | None, int]],
    total: float | int,
    epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """Every row with its columns, its ``mix_tokens``, its leaf's ``mix_budget``, and ``mix_times``.

    ``mix_times`` is how often the row is in the mix; rows with none are not part of it.
    """
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    leaves = plan(docs, levels, weights, total, epochs, seed, id_col, tokens)
    keys = [f"_k{i}" for i in range(len(levels))]
    kept = [c for c in docs.columns if c.lower() not in ("mix_tokens", "mix_budget", "mix_times")]
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_row"), *[_key(c).alias(k) for c, k in zip(levels, keys)],
        tokens.alias("mix_tokens"), F.col(f"`{id_col}`").cast("string").alias("_id"),
    )
    joined = rows.join(leaves.drop("tokens"), keys)
    once = F.col("cut").isNull() | (place(F.col("_id"), F.col("whole"), seed) < F.col("cut"))
    times = F.col("whole") + ((F.col("whole") < epochs) & once).cast("int")
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in kept], "mix_tokens", F.col("budget").alias("mix_budget"),
        times.alias("mix_times"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is in it, without the columns of ``mix``."""
    kept = [c for c in mixed.columns if c.lower() not in ("mix_tokens", "mix_budget", "mix_times")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_row")
    copies = mixed.select(row, F.explode(F.array_repeat(F.lit(0), F.col("mix_times"))).alias("_copy"))
    return copies.select(*[F.col("_row").getField(c).alias(c) for c in kept])

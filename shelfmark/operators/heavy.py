"""The most frequent terms of a corpus without a shuffle of all distinct ones.

Every task keeps a bounded summary of its terms: when it has too many, those with the smallest counts go,
and the largest count that went is added to the summary's error. Summaries merge by addition: a term's
true count is at least the sum of its counts and at most that plus the sum of the errors. Terms that may
be among the most frequent by these bounds are counted again, exactly. The result is proved: a term
that was left out has fewer occurrences than the last one in it. Where the bounds cannot prove that, there is
no result, and the caller counts all terms.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from shelfmark.session import stage, unstage

HELD = 64  # terms that a task holds, times the wanted number
SENT = 8  # terms that a task sends
ROWS = 500  # documents whose terms are added together
MARGIN = 1.25  # candidates beyond the wanted number, as some may be in too few documents
MOST_CANDIDATES = 200_000


def summaries(counts: DataFrame, n: int) -> DataFrame:
    """(term, n) of each task's summary; its error stands in a row without a term."""
    held_most, sent_most, rows = HELD * n, SENT * n, ROWS

    def run(batches):
        def pruned(table, most):
            """The ``most`` largest counts, and the largest of the others."""
            if table.num_rows <= most:
                return table, 0
            order = pc.select_k_unstable(table, most + 1, sort_keys=[("n", "descending")])
            return table.take(order[:most]), table.column("n")[order[most].as_py()].as_py()

        def added(tables):
            both = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")])
            return pa.table({"term": both.column("term"), "n": both.column("n_sum")})

        total = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        error, waiting = 0, []
        pa.set_memory_pool(pa.system_memory_pool())  # workers are kept: what is freed goes back at once
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            entries = batch.column(0).flatten()
            new = pa.table({"term": entries.field(0).cast(pa.string()), "n": entries.field(1).cast(pa.int64())})
            waiting.append(new)
            if sum(t.num_rows for t in waiting) < held_most:
                continue
            total, waiting = added([total, *waiting]), []
            if total.num_rows > 2 * held_most:
                total, off = pruned(total, held_most)
                error += off
        total, off = pruned(added([total, *waiting]), sent_most)
        end = pa.table({"term": pa.array([None], pa.string()), "n": pa.array([error + off], pa.int64())})
        yield from pa.concat_tables([total, end]).combine_chunks().to_batches()

    return counts.select("counts").mapInArrow(run, "term string, n bigint")


def most_frequent(counts: DataFrame, n: int, min_df: int = 1, max_df: float = float("inf")) -> DataFrame | None:
    """(term, df, occurrences) of the ``n`` terms with the most occurrences in ``min_df`` to ``max_df`` documents.

    ``counts``: (counts array<struct<term, tf>>) with the distinct terms of each document. Ties go to the
    smaller term. None where the summaries do not prove the cut.
    """
    merged = stage(summaries(counts, n).groupBy("term").agg(F.sum("n").alias("n")), "summaries")
    error = merged.filter(F.col("term").isNull()).agg(F.sum("n")).first()[0] or 0
    known = merged.filter(F.col("term").isNotNull())
    wanted = int(n * MARGIN) + 1
    cut, rows = known.orderBy(F.desc("n")).limit(wanted).agg(F.min("n"), F.count("*")).first()
    if rows < wanted:  # all terms there are, if nothing was taken off
        cut = 1
    candidates = known.filter(F.col("n") + error >= cut).select("term")
    if error >= cut or candidates.count() > MOST_CANDIDATES:
        unstage(merged)
        return None
    # at most MOST_CANDIDATES terms
    inside = counts.select(F.inline("counts")).join(F.broadcast(candidates), "term")
    exact = inside.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    fit = exact.filter(F.col("df").between(min_df, F.lit(max_df))).orderBy(F.desc("occurrences"), "term").limit(n)
    found = stage(fit.coalesce(1), "most-frequent")
    least, rows = found.agg(F.min("occurrences"), F.count("*")).first()
    unstage(merged)
    # terms that are no candidates occur less often than ``cut``
    return found if cut == 1 or rows == n and least >= cut else None

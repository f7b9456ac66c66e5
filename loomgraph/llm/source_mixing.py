"""Mixing of sources by temperature, with DataFrame operations only.

Token shares of the sources are raised to an exponent between 0 (all sources alike) and 1 (as they are)
and normalised. The smallest exponent is sought by bisection under which no source is repeated more than
`max_epochs` times; or, with `target_entropy`, the largest whose weights reach that entropy (in nats; clipped to
what is possible). Both bounds may be given: the larger exponent wins, so the repetition limit always holds.

Weights become budgets of tokens: the total is the smallest that lets every source appear whole at least once
(`total_tokens` None), or the given total. Each source is dealt into blocks, about the square root of its
documents in number, and blocks and the documents in them are permuted by hash. An epoch goes through all of
them; the last, partial epoch takes documents in that order until the budget is met (the one that
meets it is taken). No window holds more than about a square root of a source: rows of one doc_id and size, which can't be
told apart in the mixture, are counted first and dealt out again at the end.

Defined results: a null source is a source of its own; null or empty texts have no tokens and come along once in every
full epoch of their source, at least once; rows that repeat a doc_id are documents of their own, with places of
their own one after the other; so are rows with a null doc_id; a source without tokens has weight 0 and comes once; an empty table gives an empty result; columns other than the
named ones are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stage

#: Exponents tried in one pass, and passes: the interval shrinks to (GRID + 1) ** -PASSES.
GRID, PASSES = 15, 8
#: Rows of one doc_id and size that are dealt out at once.
COPIES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id long, source string, tokens long) of each document; tokens are words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def _bisect(holds) -> float:
    """The smallest exponent in [0, 1] at which a condition holds, if it holds from there on; holds(grid) tells it for each
    exponent of a list."""
    lo, hi = 0.0, 1.0
    for step in range(PASSES + 1):
        grid = [lo + (hi - lo) * k / (GRID + 1) for k in range(1, GRID + 1)] if step else [0.0]
        good = holds(grid)
        if not step:
            if good[0]:
                return 0.0
            continue
        first = good.index(True) if True in good else len(grid)
        lo, hi = (grid[first - 1] if first else lo), (grid[first] if first < len(grid) else hi)
    return hi


def _entropies(shares: DataFrame, grid: list[float]) -> list[float]:
    """For each exponent the entropy of the shares raised to it."""
    power = lambda a: F.exp(F.lit(a) * F.ln("share"))
    row = shares.agg(*(x for i, a in enumerate(grid) for x in (F.sum(power(a)).alias(f"p{i}"), F.sum(power(a) * F.lit(a) * F.ln("share")).alias(f"e{i}")))).first()
    return [math.log(row[f"p{i}"]) - row[f"e{i}"] / row[f"p{i}"] for i in range(len(grid))]


def temperature(sizes: DataFrame, max_epochs: float | None = 4.0, target_entropy: float | None = None) -> float:
    """The exponent for sizes (source, tokens): see the module's text."""
    total, largest, n = sizes.agg(F.sum("tokens"), F.max("tokens"), F.count(F.when(F.col("tokens") > 0, 1))).first()
    if not total or n < 2:
        return 1.0
    shares = sizes.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("share"))
    alpha = 0.0
    if max_epochs is not None:
        # epochs relative to the largest source: (share / largest) ** (a - 1), the most for the least share
        limit, top, least = math.log(max(max_epochs, 1.0)), largest / total, shares.agg(F.min("share")).first()[0]
        alpha = _bisect(lambda grid: [(1 - a) * math.log(top / least) <= limit for a in grid])
    if target_entropy is not None:
        goal = min(target_entropy, math.log(n))
        # entropy falls as the exponent rises: the first exponent that is too low marks the bound
        alpha = max(alpha, _bisect(lambda grid: [x < goal for x in _entropies(shares, grid)]))
    return alpha


def mix_sources(docs: DataFrame, max_epochs: float | None = 4.0, target_entropy: float | None = None, total_tokens: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture: doc_id long, source string, tokens long, epoch int (from 0), block long, place long, one row
    for each time that a document is taken; (epoch, block, place) is its order in its source."""
    rows = stage(source_tokens(docs, id_col, text_col, source_col), "tokens")
    sizes = stage(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "sizes")
    budgets = source_budgets(sizes, max_epochs, target_entropy, total_tokens)
    plan = budgets.select(F.col("source").alias("_source"), "budget", "n_blocks", F.col("tokens").alias("_all"))
    # the table of sources may be of any size: Spark broadcasts it only where it has measured it to be small
    order = lambda *cols: F.md5(F.concat_ws("|", *(c.cast("string") for c in cols), F.lit(str(seed))))
    same = rows.groupBy("source", "doc_id", "tokens").agg(F.count("*").alias("copies"))
    dealt = same.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("block", F.pmod(F.conv(F.substring(order(F.lit("block"), F.coalesce("doc_id", F.lit(0))), 1, 12), 16, 10).cast("long"), F.col("n_blocks")))
    blocks = dealt.groupBy("source", "block").agg(F.sum(F.col("copies") * F.col("tokens")).alias("block_tokens"))
    shuffled = Window.partitionBy("source").orderBy(order(F.lit("order"), F.col("block")), "block")
    blocks = blocks.select("source", "block", F.row_number().over(shuffled).alias("block_rank"), (F.sum("block_tokens").over(shuffled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("before_block"))
    blocks = blocks.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "block_rank", "before_block")
    inside = Window.partitionBy("source", "block").orderBy(order(F.lit("doc"), F.col("doc_id")), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("copies") * F.col("tokens")
    dealt = dealt.withColumns({"place": F.sum("copies").over(inside) - F.col("copies") + 1, "before": F.sum(own).over(inside) - own})
    dealt = dealt.join(blocks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    # copies come back one after the other, in two steps, so that no array is long
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1)))
    dealt = dealt.withColumns({"place": F.col("place") + F.col("copy"), "before": F.col("before") + F.col("copy") * F.col("tokens")})
    # tokens of the source that come before this document in each epoch
    before = F.col("before") + F.col("before_block")
    full = F.when(F.col("_all") > 0, F.floor(F.col("budget") / F.col("_all"))).otherwise(F.lit(1))
    rest = F.col("budget") - full * F.col("_all")
    times = (full + F.when((F.col("tokens") > 0) & (before < rest), 1).otherwise(0)).cast("int")
    dealt = dealt.withColumn("times", times).where("times > 0")
    return dealt.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"), F.col("block_rank").cast("long").alias("block"), "place")


def source_budgets(sizes: DataFrame, max_epochs: float | None = 4.0, target_entropy: float | None = None, total_tokens: int | None = None) -> DataFrame:
    """For sizes (source, tokens, n_docs): weight double, budget long (tokens to take) and n_blocks long of each source."""
    alpha = temperature(sizes, max_epochs, target_entropy)
    total, largest = sizes.agg(F.sum("tokens"), F.max("tokens")).first()
    total = float(total or 1)
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(alpha) * F.ln(F.col("tokens") / F.lit(total)))).otherwise(F.lit(0.0))
    norm = sizes.agg(F.sum(power)).first()[0] or 1.0
    # the largest source has the fewest epochs; with no total given it comes exactly once
    budget_all = total * norm * math.exp((1 - alpha) * math.log(largest / total)) if total_tokens is None and largest else float(total_tokens or 0)
    weight = power / F.lit(norm)
    budget = F.round(weight * F.lit(budget_all)).cast("long")
    if total_tokens is None:
        budget = F.greatest(budget, F.col("tokens"))  # rounding takes no document away
    return sizes.select("source", "tokens", "n_docs", weight.alias("weight"), budget.alias("budget"), F.greatest(F.ceil(F.sqrt("n_docs")), F.lit(1)).cast("long").alias("n_blocks"))

"""Mixing sources to target weights, in DataFrame functions alone.

Token shares p are raised to an exponent in [0, 1] and normalised: 1 keeps the
shares, 0 makes sources equal.  The exponent is bisected on a grid of 1/1024 to
the largest that meets a target entropy, but never so low that a source is
repeated more often than the limit.  The weights are realised by epochs: whole
passes over a source, then the beginning of one more pass, whose order is a
permutation of blocks and of the documents in each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_parts, materialise, wrapped

GRID = 1024
#: Sources up to this number are broadcast (about 100 bytes each); more are joined by key.
MOST_BROADCAST = 100_000
#: Tokens in a partition of mixed documents, about 15 MB.
PART_TOKENS = 1 << 21


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _entropies(by_source: DataFrame, top: float, points: list[int], budget: int | None) -> dict[int, tuple[float, float]]:
    """For grid points k: (entropy of the weights at k / GRID, sum of the powers of shares to the largest).

    Sources are summed where they are; a row for each of ``points`` reaches the driver.
    """
    r, a = F.col("tokens") / F.lit(top), F.col("k") / float(GRID)
    each = by_source.where("tokens > 0").select(r.alias("r"), F.explode(F.array(*map(F.lit, points))).alias("k")).withColumn("w", F.pow("r", a))
    sums = each.groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.ln("r")).alias("zl"))
    # -sum w ln w = ln Z - a * sum w ln(p / top)
    return {x["k"]: (x["e"], x["z"]) for x in sums.select("k", "z", (F.ln("z") - a * F.col("zl") / F.col("z")).alias("e")).collect()}


def temperature_plan(by_source: DataFrame, target_entropy: float = 0.95, max_repeat: float = 2.0, budget: int | None = None) -> DataFrame:
    """(source, tokens, exponent, weight, repeats, quota) from (source, tokens).

    ``target_entropy`` is a share of the entropy of equal weights.  Without a
    ``budget`` the largest source is taken exactly once and none is cut; with one,
    quotas are the weights times ``budget`` tokens.  Sources without tokens have
    weight 0 and are taken once.  One source alone keeps the exponent 1.

    Each round of the bisection tries 31 points between the two that enclose the
    turn, so that the grid takes two rounds; ``by_source`` may have any number of
    rows and is read once a round.
    """
    n, top, low = by_source.where("tokens > 0").agg(F.count("*"), F.max("tokens"), F.min("tokens")).first()
    k, z = GRID, 1.0
    if n:
        known = _entropies(by_source, top, [0, GRID], budget)

        def turn(lo: int, hi: int, good) -> int:
            """Of two grid points, ``good`` at ``lo`` and not at ``hi`` (either way round), the last good one between them."""
            while abs(hi - lo) > 1:
                step = max(1, abs(hi - lo) // 32) * (1 if hi > lo else -1)
                known.update(_entropies(by_source, top, [p for p in range(lo + step, hi, step) if p not in known] or [lo], budget))
                for p in [*range(lo + step, hi, step), hi]:
                    if p == hi or not good(p):
                        hi = p
                        break
                    lo = p
            return lo

        def even(p: int) -> bool:
            return known[p][0] >= target_entropy * math.log(n)

        def rare(p: int) -> bool:
            if budget is None:
                return (low / top) ** (p / GRID - 1) <= max_repeat
            return (low / top) ** (p / GRID) / known[p][1] * budget / low <= max_repeat

        # entropy and repetition fall as the exponent rises
        flat = GRID if even(GRID) else turn(0, GRID, even)
        safe = 0 if rare(0) else turn(GRID, 0, rare)
        k = GRID if n < 2 else max(flat, safe)
        z = known[k][1] if k in known else _entropies(by_source, top, [k], budget)[k][1]
    exponent, share = k / GRID, F.col("tokens") / F.lit(float(top or 1))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    times = F.pow(share, F.lit(exponent - 1)) if budget is None else F.col("weight") * F.lit(float(budget)) / F.col("tokens")
    out = by_source.withColumn("exponent", F.lit(exponent)).withColumn("weight", weight).withColumn("repeats", F.when(F.col("tokens") > 0, F.round(times, 6)).otherwise(1.0))
    return out.select("source", "tokens", "exponent", F.round("weight", 9).alias("weight"), "repeats", F.ceil(F.col("repeats") * F.col("tokens")).cast("long").alias("quota"))


def _order(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = 0.95,
    max_repeat: float = 2.0,
    budget: int | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(plan, picks): the plan of temperature_plan, and a row for each copy taken.

    picks has id, row_key, source, n_tokens, epoch (from 1), block_rank and
    row_rank (the place of the copy in its epoch's block permutation).  A block
    holds about ``block_tokens`` tokens of a source, so that a source of any size
    is ranked in pieces; rows of text take no part.  In the last, partial epoch a
    copy is taken while the tokens up to and with it stay within the quota.

    Tokens are words; null and empty texts have none and are taken in each whole
    epoch.  A null source is the source ''.  Rows alike in id, text and source
    are taken or left together and come out once, with n_rows of them; null ids
    are ids of their own.  An empty table gives empty results.
    """
    _, plan, ranked, sums = _ranked(docs, id_col, text_col, source_col, target_entropy, max_repeat, budget, block_tokens, seed)
    taken = ranked.join(sums, ["source", "epoch", "block"]).where(TAKEN)
    return plan, taken.select("id", "row_key", "source", "n_tokens", "n_rows", F.col("epoch").cast("long"), F.col("block_rank").cast("long"), F.col("row_rank").cast("long"))


#: Whole epochs are taken, and of the last one what the quota holds.
TAKEN = "epoch <= floor(repeats) or (epoch - 1) * tokens + before + up_to <= quota"


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row_key"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")]


def _placed(rows: DataFrame, plan: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """``rows`` (id, row_key, source) with their source's plan, a row for each epoch, and the block and order in it."""
    named = plan.select("source", "tokens", "repeats", "quota")
    out = rows.join(F.broadcast(named) if plan.count() <= MOST_BROADCAST else named, "source")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long")
    block = F.pmod(F.conv(F.substring(_order(seed, "id", "row_key"), 1, 12), 16, 10).cast("long"), blocks)
    out = out.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil("repeats").cast("int")))))
    return out.withColumn("row_order", _order(seed, "epoch", "id", "row_key"))


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, target_entropy: float, max_repeat: float, budget: int | None, block_tokens: int, seed: int):
    rows = docs.select(*_keys(docs, id_col, text_col, source_col), count_words(F.col(text_col)).alias("n_tokens"))
    rows = materialise(rows.groupBy("id", "row_key", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")))
    by_source = materialise(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    plan = materialise(temperature_plan(by_source, target_entropy, max_repeat, budget))
    copies = _placed(rows, plan, block_tokens, seed)
    across = "partition by source, epoch order by block_order, block"
    sums = copies.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("tokens_in")).withColumn("block_order", _order(seed, "epoch", "source", "block"))
    sums = sums.selectExpr("source", "epoch", "block", "block_order", f"row_number() over ({across}) - 1 as block_rank", f"sum(tokens_in) over ({across} rows between unbounded preceding and current row) - tokens_in as before")
    inside = "partition by source, epoch, block order by row_order, id, row_key"
    ranked = copies.selectExpr("*", f"row_number() over ({inside}) - 1 as row_rank", f"sum(n_tokens) over ({inside} rows between unbounded preceding and current row) as up_to")
    return rows, plan, ranked, sums


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float = 0.95, max_repeat: float = 2.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17
) -> DataFrame:
    """The rows of ``docs``, each as often as mix() takes it and in the order of its permutations; all columns as they were.

    Epochs follow each other; in an epoch the blocks of all sources stand in the
    order of their hashes, and in a block its rows in theirs.  What an epoch
    takes is a beginning of that order, so that the last place taken tells of
    each row whether it goes, and a text is shuffled once, to its place.
    """
    _, plan, ranked, sums = _ranked(docs, id_col, text_col, source_col, target_entropy, max_repeat, budget, block_tokens, seed)
    # the last place that the quota holds in each source's last epoch; null where it holds none
    place = F.struct("block_order", "block", "row_order", F.col("id").isNotNull().alias("has_id"), "id", "row_key")
    last = ranked.where("epoch > floor(repeats)").join(sums, ["source", "epoch", "block"]).where(TAKEN).groupBy("source").agg(F.max(place).alias("last"))
    ends = materialise(plan.join(last, "source", "left").select("source", "tokens", "repeats", "quota", "last"))
    rows = wrapped(docs, id=id_col, text=text_col, source=source_col)
    keyed = rows.select("row", *_keys(rows, "id", "text", "source"))
    copies = _placed(keyed, ends, block_tokens, seed).withColumn("block_order", _order(seed, "epoch", "source", "block"))
    ends_at = ends.select(F.col("source").alias("_of"), "last")
    copies = copies.join(F.broadcast(ends_at) if ends.count() <= MOST_BROADCAST else ends_at, F.col("source") == F.col("_of"))
    taken = copies.where((F.col("epoch") <= F.floor("repeats")) | F.coalesce(place <= F.col("last"), F.lit(False)))
    order = ["epoch", "block_order", "block", "row_order"]
    tokens = ends.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    return taken.select("row", *order).repartitionByRange(dealt_parts(tokens, PART_TOKENS), *order).sortWithinPartitions(*order).select(*(F.col("row")[c].alias(c) for c in docs.columns))

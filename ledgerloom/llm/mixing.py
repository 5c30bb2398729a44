"""Mixing to target weights by iterative proportional fitting.

Documents are summed into cells of source, language and topic. The cells' token weights are raked to target shares of
each of the three marginals in turn until all hold. No document is drawn twice, so a cell can give all its tokens at most:
where the weights ask for more, the masses are raked again under that bound, and the other cells make up for it. Documents
are then sampled with their cell's calibrated probability. Only cells meet in the raking; documents are summed where they are read and joined to their cell again. There
are at most as many cells as sources times languages times topics, and only their running sums pass through one task.

Nulls in source or language are values of their own, a null text has no words, an empty table gives an empty result, and
repeated rows are sampled alike (the draw hashes doc_id and text). Targets name a value that no cell has: it is left out
and the others keep their proportions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import WORD, Scratch, row_keyed, rows_at, whole_text

MARGINS = ("source", "lang", "topic")
NONE = "(none)"


def default_topic(text: Column) -> Column:
    """A coarse genre from the text's form: table, symbols, figures, lines or prose."""
    size = F.greatest(F.length(text), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / size

    return (
        F.when(share(r"[|\t]") > 0.02, "table")
        .when(share(r"[#*$%&<>{}=]") > 0.05, "symbols")
        .when(share(r"[0-9]") > 0.05, "figures")
        .when(share(r"\n") > 0.02, "lines")
        .otherwise("prose")
    )


#: How much of what a value can give at most a default target asks for.
REACH = 0.95


def tempered(cells: DataFrame, margin: str, power: float, keep: float) -> DataFrame:
    """Target shares of one marginal that a sample of ``keep`` of all tokens can meet.

    Present token shares to a power below 1 even out large and small values. A value whose tokens are too few for that gets
    ``REACH`` of the share it could give, and the others share the rest as before: values in falling order of what is asked
    of them, the first scale that leaves its value and all behind it below their bound.
    """
    present = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("_t")).where("_t > 0")
    share = F.col("_t") / F.sum("_t").over(Window.partitionBy())
    # A sample of all tokens can have the present shares only.
    bound = F.greatest(share, share * F.lit(REACH) / max(keep, 1e-9))
    values = present.select(margin, F.pow(share, F.lit(power)).alias("_free"), bound.alias("_cap"))
    order = Window.orderBy(F.desc(F.col("_free") / F.col("_cap")), margin)
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("_free").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scale = (1 - capped) / free
    fits = F.when((scale >= 0) & (scale * F.col("_free") <= F.col("_cap") * (1 + 1e-12)), scale)
    tried = values.withColumn("_fits", fits)
    first = F.first("_fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tried.withColumn("_scale", first).select(margin, F.least("_cap", F.coalesce(F.col("_scale") * F.col("_free"), F.col("_cap"))).alias("target"))


def _one(cells: DataFrame, margin: str) -> Column:
    """Scale of a row that brings its value of ``margin`` to the target share."""
    have = F.sum("mass").over(Window.partitionBy(margin))
    return F.when(have > 0, F.col("mass") * F.col(f"target_{margin}") / have).otherwise(0.0)


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    scratch: Scratch,
    tolerance: float = 1e-6,
    sweeps: int = 60,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``mass``, whose marginal shares meet ``targets``.

    A sweep scales the masses to each marginal in turn. It ends when no share is off by more than ``tolerance``; targets
    that contradict each other (a value whose cells are all empty elsewhere) end it after ``sweeps`` with the best
    compromise, and the caller sees the gap in ``marginal_report``.
    """
    table = cells.withColumn("mass", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        known = cells.select(margin).distinct().join(target, margin)
        whole = known.agg(F.sum("target")).first()[0] or 1.0
        shares = known.select(margin, (F.col("target") / whole).alias(f"target_{margin}"))
        table = table.join(shares, margin, "left").fillna(0.0, [f"target_{margin}"])
    table = scratch.write(table)
    for _ in range(-(-sweeps // 3)):
        fitted = table
        for _ in range(3):
            for margin in targets:
                fitted = fitted.withColumn("mass", _one(fitted, margin))
        fitted = scratch.write(fitted)
        scratch.drop(table)
        table = fitted
        gap = 0.0
        for margin in targets:
            sums = table.groupBy(margin).agg(F.sum("mass").alias("_m"), F.first(f"target_{margin}").alias("_t"))
            gap = max(gap, sums.agg(F.coalesce(F.max(F.abs(F.col("_m") - F.col("_t"))), F.lit(0.0))).first()[0])
        if gap <= tolerance:
            break
    return table


def _bounded(cells: DataFrame, margin: str) -> DataFrame:
    """``_free`` scaled so that the masses, which end at ``_cap``, bring the value of ``margin`` to its target, or to all it has."""
    own = Window.partitionBy(margin)
    order = own.orderBy(F.desc(F.col("_free") / F.col("_cap")), *MARGINS)
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("_free").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scale = F.when(free > 0, (F.col(f"target_{margin}") - capped) / free)
    fits = F.when((scale >= 0) & (scale * F.col("_free") <= F.col("_cap") * (1 + 1e-12)), scale)
    first = F.first("_fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tried = cells.withColumn("_fits", fits).withColumn("_first", first)
    return tried.withColumn("_free", F.coalesce(F.col("_free") * F.col("_first"), F.col("_cap"))).drop("_fits", "_first")


def bounded(raked: DataFrame, margins: list[str], keep: float, scratch: Scratch, tolerance: float = 1e-6, sweeps: int = 30) -> DataFrame:
    """``raked`` with masses of which ``keep`` of all tokens can be drawn, no cell giving more tokens than it has.

    Masses that fit stay as they are. Else each sweep scales the masses to each marginal in turn, up to the cells' bounds.
    It ends when the shares hold or no longer come closer: a value whose cells together hold less than its target gives all
    it has. ``marginal_report`` shows what is missing.
    """
    whole = raked.agg(F.sum("tokens")).first()[0] or 0
    table = raked.withColumns({"_cap": F.col("tokens") / F.lit(max(keep, 1e-9) * max(whole, 1)), "_free": F.col("mass")})
    if not table.where("_free > _cap * (1 + 1e-9)").limit(1).count():
        return raked
    empty, table = table.where("_cap = 0"), table.where("_cap > 0")
    last = float("inf")
    for _ in range(-(-sweeps // 3)):
        for _ in range(3):
            for margin in margins:
                table = _bounded(table, margin)
        fitted = scratch.write(table)
        if hasattr(table, "_scratch"):
            scratch.drop(table)
        table = fitted
        gap = 0.0
        for margin in margins:
            sums = table.groupBy(margin).agg(F.sum(F.least("_free", "_cap")).alias("_m"), F.first(f"target_{margin}").alias("_t"))
            gap = max(gap, sums.agg(F.coalesce(F.max(F.abs(F.col("_m") - F.col("_t"))), F.lit(0.0))).first()[0])
        if gap <= tolerance or abs(last - gap) <= tolerance:
            break
        last = gap
    return table.unionByName(empty)


def calibrated(raked: DataFrame, keep: float) -> DataFrame:
    """``raked`` with ``weight`` (raked over present token share) and ``probability`` = min(1, scale * bounded weight).

    The bounded weight is the same of the masses that ``bounded`` found, or the weight where there are none. The scale is the one at which the expected tokens are ``keep`` of all. Cells in falling order of weight: those before a
    cell are kept whole, and the scale that spends the rest of the budget on it and its followers must leave it at 1 or
    below. The first such scale is the answer.
    """
    whole = Window.partitionBy()
    share = F.col("tokens") / F.sum("tokens").over(whole)
    cells = raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("mass") / share).otherwise(F.lit(1.0)))
    given = F.col("_free" if "_free" in raked.columns else "mass")
    cells = cells.withColumn("_drawn", F.when(F.col("tokens") > 0, given / share).otherwise(F.lit(1.0)))
    order = Window.orderBy(F.desc("_drawn"), *MARGINS)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spent = F.col("tokens") * F.col("_drawn")
    scale = (keep * F.sum("tokens").over(whole) - F.coalesce(F.sum("tokens").over(earlier), F.lit(0))) / F.sum(spent).over(later)
    tried = cells.withColumn("_scale", F.when(F.sum(spent).over(later) > 0, scale))
    fits = F.when((F.col("_scale") >= 0) & (F.col("_scale") * F.col("_drawn") <= 1 + 1e-12), F.col("_scale"))
    chosen = tried.withColumn("_chosen", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    probability = F.least(F.lit(1.0), F.coalesce(F.col("_chosen") * F.col("_drawn"), F.lit(1.0)))
    return chosen.withColumn("probability", probability).drop("_scale", "_chosen", "_drawn")


def marginal_report(mixed: DataFrame) -> DataFrame:
    """margin, value, and its shares of tokens in a result of ``mix``: present, raked, in the expected and in the drawn sample."""
    kinds = {"present": F.col("n_tokens"), "raked": F.col("n_tokens") * F.col("weight")}
    kinds |= {"expected": F.col("n_tokens") * F.col("probability"), "drawn": F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)}
    cells = mixed.groupBy(*MARGINS).agg(*[F.sum(c).cast("double").alias(k) for k, c in kinds.items()])
    values = cells.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS])).alias("of"), *kinds)
    sums = values.groupBy("of").agg(*[F.sum(k).alias(k) for k in kinds])
    whole = Window.partitionBy("of.margin")
    return sums.select("of.*", *[(F.col(k) / F.sum(k).over(whole)).alias(k) for k in kinds])


def mix(
    docs: DataFrame,
    keep: float = 0.9,
    power: float = 0.9,
    targets: Mapping[str, DataFrame] | None = None,
    topic: Column | None = None,
    seed: int = 20240229,
    doc_id: str = "doc_id",
    text: str = "text",
    row: Column | None = None,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled, and ``_row``, for every row of ``docs``.

    ``targets`` maps source, lang and topic to tables (value, target); by default each is the present marginal to the
    ``power``, as far as the tokens there are can meet it. ``keep`` is the share of all tokens that the sample should hold.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    body = whole_text(text)
    draw = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed), body), 11) / F.lit(float(1 << 53))
    slim = scratch.write(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce("source", F.lit(NONE)).alias("source"),
            F.coalesce("lang", F.lit(NONE)).alias("lang"),
            (default_topic(body) if topic is None else F.coalesce(topic, F.lit(NONE))).alias("topic"),
            F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_tokens"),
            draw.alias("_draw"),
            (F.monotonically_increasing_id() if row is None else row).alias("_row"),
        )
    )
    cells = scratch.write(slim.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    goals = {m: (targets or {}).get(m, tempered(cells, m, power, keep)) for m in MARGINS}
    fitted = calibrated(bounded(rake(cells, goals, scratch), list(goals), keep, scratch), keep)
    rates = scratch.write(fitted.select(*MARGINS, "weight", "probability"))
    return slim.join(rates, list(MARGINS)).select(
        "doc_id", *MARGINS, "n_tokens", "weight", "probability", (F.col("_draw") < F.col("probability")).alias("sampled"), "_row"
    )


def sampled_rows(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    docs, key = row_keyed(docs, Scratch(docs.sparkSession, "mixing-rows"))
    return rows_at(docs, key, mix(docs, row=key, **options).where("sampled").select("_row"))

"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Law ``rows``: shard sizes differ by one row at most. Row numbers follow (doc_id, size, checksum); rows equal in all three
get consecutive numbers in an order that no output column shows. A row with number r and permuted number p sits in shard
p mod n at slot p div n, so both directions are arithmetic: ``permuted`` goes from row number to place and ``row_at``
back. Nulls in ``doc_id`` sort first, a null text counts as empty, an empty table gives an empty result, and columns
other than the two named are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import Scratch, whole_text

ROUNDS = 6


def _halves(n: int) -> tuple[int, int]:
    """Side lengths a, b of the smallest near-square grid that holds n rows; a * b exceeds n by less than a."""
    b = max(isqrt(max(n, 1)), 1)
    return -(-max(n, 1) // b), b


def _pass(number: Column, n: int, seed: int, back: bool = False) -> Column:
    """One trip through the network on the grid a x b: each round shifts one half by a keyed hash of the other."""
    a, b = _halves(n)
    sign = -1 if back else 1

    def turn(s: Column, i: Column) -> Column:
        by_right = sign * F.pmod(F.xxhash64(s["r"], F.lit(seed), i), F.lit(a))
        by_left = sign * F.pmod(F.xxhash64(s["l"], F.lit(seed), i), F.lit(b))
        return F.struct(
            F.when(i % 2 == 1, F.pmod(s["l"] + by_right, F.lit(a))).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, F.pmod(s["r"] + by_left, F.lit(b))).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(F.floor(number / b).cast("long").alias("l"), F.pmod(number, F.lit(b)).cast("long").alias("r"))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, n: int, seed: int, back: bool = False) -> Column:
    """Place of row ``number`` among ``n``, by walking the cycle until it is back inside 0..n-1.

    The grid has fewer than sqrt(n) + 1 places outside, and a cycle visits each once, so the walk has a proven bound. Few
    rows, about one in sqrt(n), leave the range at all; only these evaluate the walk.
    """
    a, b = _halves(n)
    outside = a * b - n
    if outside == 0:
        return _pass(number, n, seed, back)

    # Sixteen steps serve nearly every walk; the full bound is there for the rest.
    steps = F.sequence(F.lit(1), F.lit(min(outside, 16)))
    first = _pass(number, n, seed, back)
    again = F.aggregate(steps, first, lambda x, _: F.when(x < n, x).otherwise(_pass(x, n, seed, back)))
    all_steps = F.sequence(F.lit(1), F.lit(outside + 1))
    whole = F.aggregate(all_steps, first, lambda x, _: F.when(x < n, x).otherwise(_pass(x, n, seed, back)))
    return F.when(first < n, first).when(again < n, again).otherwise(whole)


def row_numbers(rows: DataFrame, order: list[str], scratch: Scratch, parts: int) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_no`` from 0 in the given order, without a single-task sort.

    Rows are range partitioned with a written tie-breaker as the last key, so equal keys do not pile up in one task. Only
    one count per partition meets in one place.
    """
    keyed = scratch.write(rows.withColumn("_tie", F.monotonically_increasing_id()))
    at = F.monotonically_increasing_id()
    sorted_rows = keyed.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    placed = scratch.write(
        sorted_rows.select(*rows.columns, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(starts, "_part").select(*rows.columns, (F.col("_start") + F.col("_at")).alias("row_no"))
    scratch.drop(keyed)
    return numbered, placed.count()


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240229, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no of every row, duplicates and nulls included."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    body = whole_text(text)
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered, n = row_numbers(slim, ["doc_id", "size", "text_crc32"], scratch, parts)
    placed = numbered.withColumn("_p", permuted(F.col("row_no"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )


def row_at(shard_no: Column, slot: Column, n: int, shards: int = 8, seed: int = 20240229) -> Column:
    """Row number of the row at a place: the inverse of ``shard`` for a table of ``n`` rows."""
    return permuted(slot * shards + shard_no, n, seed, back=True)

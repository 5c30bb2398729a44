"""Merkle manifest of a dataset, its upper proofs found by butterfly exchange between blocks.

Every row is a leaf; the leaves of one tree value (a language) ascend by id and are hashed ``fanout`` at a time, level by
level, until one node, the subroot, is left; the subroots, ordered by tree value, give the root in the same way. A digest is
lower-case hex, and a parent is the hash of its children's digests as text.

Leaves are cut into aligned blocks of ``fanout ** levels`` rows. A block hashes its own leaves and then takes part in rounds:
in round r the blocks of one parent that have the same place inside their subtrees of fanout ** r blocks swap the roots of
these subtrees. Every member hashes the parent itself, so all blocks hold the ancestors on their own path and the siblings
beside them when the last round is over; nothing is handed down. In the last, incomplete subtree a few blocks stand in for
the places that are missing. A round is one shuffle of one small row per block and of ``fanout`` rows per group.

A row's order among rows with the same id is that of their leaves; equal leaves of one id may stand in any order, which
changes none of the results but which of the equal rows has which. Null ids come first, a null tree value is a tree of its
own and comes first; every null value is hashed as ``-``. An empty table gives an empty result. Columns other than those
named are ignored. Blocks are bounded, so a tree with a third of all rows or a tree per row makes no difference.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ledgerloom.llm.shared import Scratch, ascii_lower

FANOUT = 8
LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: the digests left and right of one's own, concatenated.
STEP = StructType([StructField("left", StringType()), StructField("right", StringType())])
PATH = ArrayType(STEP)


def leaf(values: list[Column]) -> Column:
    """Hash of the values in order: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value as text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(path: Column, start: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


def heights(count: Column, fanout: int) -> Column:
    """Levels above ``count`` leaves: how often ``fanout`` nodes become one until one is left."""
    powers = [fanout**k for k in range(1, 64) if fanout**k < 2**62]
    out = F.lit(len(powers) + 1)
    for k in range(len(powers), 0, -1):
        out = F.when(count <= powers[k - 1], k).otherwise(out)
    return F.when(count <= 1, 0).otherwise(out)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _level(nodes: list[str], fanout: int) -> list[str]:
    return [_sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def positions(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``leaves`` (tree, …) with ``pos`` from 0 and ``n`` within their tree, in the given order, no tree in one task.

    Rows are range partitioned and sorted; what meets in one place is one count per tree and partition.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = scratch.write(leaves.withColumn("_tie", F.monotonically_increasing_id()))
    at = F.monotonically_increasing_id()
    sorted_rows = keyed.repartitionByRange(parts, "tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie")
    placed = scratch.write(
        sorted_rows.select(*leaves.columns, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    )
    runs = placed.groupBy("tree", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n")
    )
    out = placed.join(starts, ["tree", "_part"]).select(*leaves.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")
    scratch.drop(keyed)
    return out


def _block_roots(placed: DataFrame, fanout: int, levels: int) -> DataFrame:
    """tree, block, n, height, node: the topmost node of every block."""
    arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("height", pa.int32()), ("node", pa.string())])

    def root(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes = table["digest"].to_pylist()
        n, height = table["n"][0].as_py(), table["height"][0].as_py()
        for _ in range(min(levels, height)):
            nodes = _level(nodes, fanout)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [n], [height], nodes], schema=arrow)

    return placed.groupBy("tree", "block").applyInArrow(root, "tree string, block long, n long, height int, node string")


def _butterfly(blocks: DataFrame, fanout: int, levels: int, rounds: int) -> DataFrame:
    """``blocks`` (tree, block, n, height, node) with the root of their tree as ``node`` and the ``path`` up to it."""
    size = fanout**levels
    state = blocks.withColumn("path", F.array().cast(PATH))
    for r in range(rounds):
        subtree = fanout**r
        # Blocks in this block's own subtree: all are full but the last of its tree.
        last = F.expr(f"(n - 1) div {size}")
        mine, low = F.expr(f"block div {subtree}"), F.expr(f"block % {subtree}")
        there = F.least(F.lit(subtree), last + 1 - mine * subtree)
        # Whoever holds the place ``low`` swaps there; a subtree that is short of blocks sends one of them to several places.
        places = F.when(F.col("height") <= levels + r, F.array(low)).when(there == subtree, F.array(low)).otherwise(
            F.sequence(low, F.lit(subtree - 1), F.greatest(there, F.lit(1)))
        )
        sent = state.select("*", low.alias("_low"), mine.alias("_mine"), F.explode(places).alias("_place"))
        going_on = F.col("height") > levels + r
        message = F.struct(
            F.col("_mine").alias("at"), "node", (F.col("_place") == F.col("_low")).alias("own"), "block", "n", "height", "path"
        )
        met = sent.withColumn("_parent", F.when(going_on, F.expr(f"_mine div {fanout}")).otherwise(F.col("_mine")))
        groups = met.groupBy("tree", "_parent", "_place").agg(F.array_sort(F.collect_list(message)).alias("members"))
        joined = lambda members: F.concat_ws("", F.transform(members, lambda m: m["node"]))
        whole = F.sha2(joined(F.col("members")).cast("binary"), 256)
        own = groups.select("tree", "members", whole.alias("_whole"), F.explode(F.filter("members", lambda m: m["own"])).alias("me"))
        step = F.struct(
            joined(F.filter("members", lambda m: m["at"] < F.col("me.at"))).alias("left"),
            joined(F.filter("members", lambda m: m["at"] > F.col("me.at"))).alias("right"),
        )
        on = F.col("me.height") > levels + r
        state = own.select(
            "tree", "me.block", "me.n", "me.height",
            F.when(on, F.col("_whole")).otherwise(F.col("me.node")).alias("node"),
            F.when(on, F.concat("me.path", F.array(step.cast(STEP)))).otherwise(F.col("me.path")).alias("path"),
        )
    return state


def _local_paths(placed: DataFrame, upper: DataFrame, carried: list[str], fanout: int, levels: int) -> DataFrame:
    """The rows of ``placed`` with the whole proof of each: the steps inside its block and the block's path above."""
    schema = StructType([*(placed.schema[c] for c in carried), StructField("path", PATH), StructField("subroot", StringType()), StructField("root", StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def paths(rows: pa.Table, top: pa.Table) -> pa.Table:
        if not len(rows):
            return arrow.empty_table()
        rows = rows.sort_by("pos")
        nodes = rows["digest"].to_pylist()
        steps: list[list[dict]] = [[] for _ in nodes]
        span = 1
        for _ in range(min(levels, rows["height"][0].as_py())):
            for run in range(0, len(nodes), fanout):
                run_nodes = nodes[run : run + fanout]
                for k in range(len(run_nodes)):
                    step = {"left": "".join(run_nodes[:k]), "right": "".join(run_nodes[k + 1 :])}
                    for i in range((run + k) * span, min((run + k + 1) * span, len(steps))):
                        steps[i].append(step)
            nodes = _level(nodes, fanout)
            span *= fanout
        above = top["path"][0].as_py()
        same = [[top[c][0].as_py()] * len(rows) for c in ("subroot", "root")]
        columns = [rows[c].cast(arrow.field(c).type) for c in carried]
        return pa.table([*columns, pa.array([s + above for s in steps], arrow.field("path").type), *same], schema=arrow)

    return placed.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(paths, schema)


def _tree(leaves: DataFrame, order: list[str], scratch: Scratch, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The leaves (tree, digest, …) with place and block, and the blocks with path and subroot (``node``)."""
    placed = positions(leaves, order, scratch).withColumn("block", F.expr(f"pos div {fanout**levels}")).withColumn("height", heights(F.col("n"), fanout))
    placed = scratch.write(placed)
    blocks = scratch.write(_block_roots(placed, fanout, levels))
    tallest = blocks.agg(F.max("height")).first()[0] or 0
    return placed, scratch.write(_butterfly(blocks, fanout, levels, max(0, tallest - levels)))


def manifest(
    docs: DataFrame, digests: dict[str, Column] | None = None, tree: str = "lang", doc_id: str = "doc_id",
    columns: tuple[str, ...] = COLUMNS, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """doc_id, leaf, path, subroot, root of every row, and the columns of ``digests`` beside them.

    ``path`` is the proof: for each level from the leaf to the root the siblings left and right.
    """
    digests = digests or {}
    scratch = Scratch(docs.sparkSession, "merkle")
    value = F.col(tree).cast("string")
    rows = docs.select(
        # A mark before the value keeps a null apart from an empty one, and first.
        F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value)).alias("tree"),
        F.col(doc_id).alias("doc_id"), leaf([F.col(c) for c in columns]).alias("digest"), *[c.alias(k) for k, c in digests.items()],
    )
    placed, blocks = _tree(rows, ["doc_id", "digest"], scratch, fanout, levels)
    # The subroots are the leaves of the tree above.
    subroots = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("value"), F.col("node").alias("digest"))
    top, top_blocks = _tree(subroots, ["value"], scratch, fanout, levels)
    top_upper = top_blocks.select("tree", "block", "path", F.lit("").alias("subroot"), F.col("node").alias("root"))
    tops = scratch.write(_local_paths(top, top_upper, ["value", "digest"], fanout, levels))
    upper = blocks.withColumnRenamed("path", "_below").join(tops.select(F.col("value").alias("tree"), F.col("path").alias("_above"), "root"), "tree").select(
        "tree", "block", F.concat("_below", "_above").alias("path"), F.col("node").alias("subroot"), "root"
    )
    out = _local_paths(placed, upper, ["doc_id", "digest", *digests], fanout, levels)
    return out.withColumnRenamed("digest", "leaf")


def tampered_leaf(doc_id: str = "doc_id", text: str = "text", columns: tuple[str, ...] = COLUMNS) -> Column:
    """The leaf of a row after tampering: where 3 divides the checksum of the id, the text's A-Z are lowered."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf([ascii_lower(F.col(c)) if c == text else F.col(c) for c in columns]))


def verified(rows: DataFrame, found: str = "found") -> DataFrame:
    """``rows`` of a manifest with ``folded_root`` from the leaf in ``found`` (null: the row's own) and ``verified``."""
    folded = fold(F.col("path"), F.coalesce(F.col(found), F.col("leaf")))
    return rows.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))

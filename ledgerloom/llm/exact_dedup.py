"""Exact de-duplication by block naming.

Each normalised text is cut into blocks of fixed size. Equal blocks get one integer name and different blocks get
different ones, by comparing contents, never a hash. Adjacent names are then paired and the pairs named, level by level,
until a document is one name; with its block count that name is its identity, free of collisions.

Texts are equal when identical after lowering A-Z. A null text counts as empty (and equals an empty one). The row with the
largest doc_id stays (nulls are smallest); among repeated rows with that same doc_id exactly one stays. Other columns are
carried through untouched only by ``kept_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import Scratch, ascii_lower, row_keyed, rows_at, whole_text

BLOCK = 16_384
#: A block that makes up more than this share of all blocks is hot and is named in salted steps. At most 1 / HOT_SHARE
#: blocks can be hot, which bounds the broadcast list.
HOT_SHARE = 0.002
SALTS = 64


def _blocks(docs: DataFrame, block: int, doc_id: str, text: str) -> DataFrame:
    body = docs.select(F.col("_row"), F.col(doc_id).alias("doc_id"), ascii_lower(whole_text(text)).alias("body"))
    sized = body.select(
        "_row",
        "doc_id",
        F.unhex(F.sha2("body", 256)).alias("sha"),
        F.encode("body", "UTF-8").alias("bytes"),
        F.greatest(F.ceil(F.octet_length("body") / block), F.lit(1)).cast("int").alias("n_blocks"),
    )
    cuts = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    return sized.select("_row", "doc_id", "sha", "n_blocks", "bytes", F.explode(cuts).alias("idx")).select(
        "_row", "doc_id", "sha", "n_blocks", "idx", F.substring("bytes", F.col("idx") * block + 1, F.lit(block)).alias("block")
    )


def _named_blocks(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks with a name instead of their content: the smallest block id among equal blocks."""
    counts = scratch.write(blocks.groupBy(F.xxhash64("block").alias("_h")).agg(F.count("*").alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_n") > max(total * HOT_SHARE, 64)).select("_h", F.lit(True).alias("_hot"))
    tagged = blocks.withColumn("_id", F.monotonically_increasing_id()).withColumn("_h", F.xxhash64("block"))
    tagged = tagged.join(F.broadcast(hot), "_h", "left")
    salt = F.when(F.col("_hot"), F.pmod("_id", F.lit(SALTS))).otherwise(F.lit(0))
    local = tagged.withColumn("_salt", salt).withColumn(
        "name", F.min("_id").over(Window.partitionBy("block", "_salt"))
    )
    # Of a hot block one row per salt keeps its content for the second step.
    named = scratch.write(
        local.select(
            "_row", "doc_id", "sha", "n_blocks", "idx", "name",
            F.when(F.col("_hot") & (F.col("_id") == F.col("name")), F.col("block")).alias("hot_block"),
        )
    )
    heads = named.where(F.col("hot_block").isNotNull()).select("name", "hot_block")
    top = Window.partitionBy("hot_block")
    renamed = heads.select("name", F.min("name").over(top).alias("_top"))
    scratch.drop(counts)
    return named.drop("hot_block").join(F.broadcast(renamed), "name", "left").withColumn(
        "name", F.coalesce("_top", "name")
    ).drop("_top")


def identities(docs: DataFrame, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Scratch]:
    """_row, doc_id, sha, n_blocks, name for each row of ``docs``, which carries a unique ``_row``."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    level = scratch.write(_named_blocks(_blocks(docs, block, doc_id, text), scratch))
    longest = level.agg(F.coalesce(F.max("n_blocks"), F.lit(1))).first()[0]
    done = level.where("n_blocks = 1").select("_row", "doc_id", "sha", "n_blocks", "name")
    rest = level.where("n_blocks > 1").select("_row", "idx", "name")
    heads = level.where("n_blocks > 1 AND idx = 0").select("_row", "doc_id", "sha", "n_blocks")
    width = longest
    while width > 1:
        half = F.floor(F.col("idx") / 2).cast("int")
        pairs = rest.groupBy("_row", half.alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = scratch.write(pairs.withColumn("_id", F.monotonically_increasing_id()))
        names = pairs.groupBy("l", "r").agg(F.min("_id").alias("name"))
        rest = scratch.write(pairs.join(names, ["l", "r"]).select("_row", "idx", "name"))
        width = -(-width // 2)
    if longest > 1:
        done = done.unionByName(heads.join(rest.select("_row", "name"), "_row"))
    return done, scratch


def groups(
    docs: DataFrame, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", row: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and ``_row``, its key.

    Groups are reduced to their largest (doc_id, row) before anything meets, so a group of any size is two numbers.
    """
    key = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(doc_id, text, key.alias("_row"))
    named, _ = identities(rows, block, doc_id, text)
    keep: Column = F.max(F.struct("doc_id", "_row"))
    best = named.groupBy("n_blocks", "name").agg(keep.alias("keep"), F.count("*").alias("group_size"))
    return named.join(best, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_row") == F.col("keep._row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "_row",
    )


def kept_rows(docs: DataFrame, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs, key = row_keyed(docs, Scratch(docs.sparkSession, "exact-dedup-rows"))
    return rows_at(docs, key, groups(docs, block, doc_id, text, key).where("kept").select("_row"))

"""SimHash fingerprints and their links, through a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most ``max_bits`` = 4 bits differ in at most four of their eight bytes, so they
share at least four (position, byte) postings. Posting lists of single bytes are far too long to tally, so the index
stores conjunctions: of any four shared positions at least three lie among the first seven, hence every pair worth
tallying meets in one of the 35 lists of three positions. Inside a list the shared positional bytes of each pair are
tallied, pairs below the guaranteed minimum are dropped, and the rest are verified by counting differing bits. A list of
any length is cut into blocks that meet pairwise, each in a task of bounded size; what leaves a task is a spanning forest
of the links found, never the pairs.

Equal fingerprints are one node from the start, so groups of copies cost one row. A null or empty text, and one without
words, has fingerprint zero and links like any other. Rows may repeat; a component's id is its smallest doc_id, nulls
left out. An empty table gives an empty result, columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import Scratch, row_keyed, rows_at, slices

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BYTES = 8
#: Fingerprints of one list that meet in a task: two blocks of this size at most.
BLOCK = 4096


def fingerprint(text: str) -> int:
    """SimHash of the word shingles of one text."""
    words = text.encode().lower().split()  # bytes are lowered and split by the ASCII rules
    if not words:
        return 0
    flat = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(len(words) - SHINGLE + 1, 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts, last, strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, one row per row of ``docs``."""
    key_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch):
                found = np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([keys, pa.array(found)], names=["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {key_type}, fp bigint")


def _postings(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(list, fp): each fingerprint in the lists of its conjunctions of positional bytes.

    At least BYTES - max_bits bytes are shared by linked fingerprints. Leaving out the last position leaves one less.
    """
    shared = max(BYTES - max_bits, 1)
    width = max(shared - 1, 1)
    first = BYTES - 1 if shared > 1 else BYTES
    lists = []
    for number, positions in enumerate(combinations(range(first), width)):
        mask = sum(0xFF << (8 * (BYTES - 1 - p)) for p in positions)
        mask -= (mask >> 63) << 64
        # The number of the conjunction takes the place of a byte that the mask has cleared.
        free = max(set(range(BYTES)) - set(positions))
        tag = number << (8 * (BYTES - 1 - free))
        lists.append(F.col("fp").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(tag)))
    return nodes.select("fp", F.explode(F.array(*lists)).alias("list"))


def _meetings(postings: DataFrame, block: int) -> DataFrame:
    """(list, i, j, side, fp): the members of a list, cut into blocks; blocks i and j meet in one group.

    Lists with one member are dropped here, which are nearly all.
    """
    by_list = Window.partitionBy("list")
    ranked = postings.select(
        "list", "fp", F.count("*").over(by_list).alias("n"), (F.row_number().over(by_list.orderBy("fp")) - 1).alias("at")
    ).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = ranked.select("list", "fp", F.floor(F.col("at") / block).cast("int").alias("b"), blocks.alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    return placed.select("list", "fp", "b", other).select(
        "list", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fp"
    )


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether fingerprints link: tally of equal positional bytes first, then the differing bits."""
    differing = a ^ b
    equal = (np.ascontiguousarray(differing).view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    return (equal >= BYTES - max_bits) & (np.bitwise_count(differing) <= max_bits)


def forest(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Edges (n, 2) that connect the fingerprints of one meeting as far as their links connect them.

    Breadth first from each fingerprint not yet reached: its links among those left over are edges of a tree.
    """
    left = np.ones(len(fps), bool)
    edges = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            found = rest[linked(fps[rest], fps[at], max_bits)]
            left[found] = False
            front.extend(found.tolist())
            edges.extend((fps[at], fps[f]) for f in found.tolist())
    return np.array(edges, np.uint64).reshape(-1, 2)


def _edges_of(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, max_bits: int):
    """Edges of many meetings at once: small ones pair by pair, in step; large ones as forests."""
    out = []
    small = sizes <= 8
    for s, n in zip(starts[~small], sizes[~small], strict=True):
        out.append(forest(fps[s : s + n], max_bits))
    group = np.repeat(np.arange(len(starts)), sizes)
    for gap in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((group[gap:] == group[:-gap]) & small[group[gap:]])
        hit = i[linked(fps[i], fps[i + gap], max_bits)]
        out.append(np.stack([fps[hit], fps[hit + gap]], 1))
    edges = np.concatenate(out) if out else np.empty((0, 2), np.uint64)
    return np.unique(edges, axis=0)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all that link, and none that do not."""
    meetings = _meetings(_postings(nodes, max_bits), block)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = meetings.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for frame in frames:
            # The last meeting of a batch may go on in the next one; its size is bounded by two blocks.
            rows = pd.concat([held, frame]) if len(held) else frame
            cells = rows[["list", "i", "j"]].to_numpy()
            open_cell = (cells == cells[-1]).all(1)
            held, rows = rows[open_cell], rows[~open_cell]
            if len(rows):
                yield edges_of(rows)
        if len(held):
            yield edges_of(held)

    def edges_of(rows: pd.DataFrame) -> pd.DataFrame:
        cells = rows[["list", "i", "j"]].to_numpy()
        new = np.r_[True, (cells[1:] != cells[:-1]).any(1)]
        starts = np.flatnonzero(new)
        fps = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        edges = _edges_of(fps, starts, np.diff(np.r_[starts, len(rows)]), max_bits)
        return pd.DataFrame(edges.view(np.int64), columns=["u", "v"])

    return sorted_rows.mapInPandas(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links, of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    printed = scratch.write(fingerprints(docs, doc_id, text))
    nodes = scratch.write(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.write(links(nodes.select("fp"), max_bits))
    roots = scratch.write(components(edges, scratch).select(F.col("node").alias("fp"), "root"))
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return printed.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(name: str = "fp"):
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def representative_rows(docs: DataFrame, max_bits: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with its smallest doc_id, with all columns.

    A row without doc_id stays only where its component has no other; of rows that repeat the smallest doc_id one stays.
    """
    docs, place = row_keyed(docs, Scratch(docs.sparkSession, "simhash-rows"))
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), place.alias("row"))
    found = near_duplicates(docs.select(key.alias("key"), text), max_bits, "key", text)
    return rows_at(docs, place, found.select(F.col("component_id.row").alias("_row")).distinct())

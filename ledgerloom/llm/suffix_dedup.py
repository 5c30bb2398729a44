"""Removal of passages that an earlier document holds, by longest-previous-factor arrays over distributed suffixes.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. Whether one
does is a property of the suffix at each position: in suffix order, the nearest suffixes before and after it that come
from an earlier document have the longest common prefix with it among all earlier ones. Its longest previous factor is the
longer of the two, and the position is a match if that reaches ``LENGTH``.

The suffixes of a corpus do not fit one sort, so they are dealt out by what they must share to match. Every window of
LENGTH bytes picks its gram with the smallest hash (the leftmost of equals), which depends on the window alone: equal
windows pick equal grams. Neighbouring windows mostly pick the same one, so a document becomes a few runs of windows, and
only suffixes of runs with one gram can match. Then

1. runs whose gram occurs in one document only, nearly all of new text, cannot match and end here, as hashes;
2. if all runs of a gram are one string, every later document loses that run (an equal run has equal windows);
3. what is left, runs that overlap in part at the edges of shared passages, is fetched as strings, once per different
   string, sorted into suffix order gram by gram, and its longest previous factors are computed.

Grams with very many different strings are not sorted in one place: their windows are dealt out again by content, where
equal windows meet and the smallest doc_id decides. Texts are shuffled once, compressed, to meet the runs to be cut from
them and later the spans that go. Later copies of a text that one task sees, and runs that an earlier document at hand has too, are settled there. Everything spills; nothing
is collected. Runs travel as four longs (48 bits of the gram's hash, 43 and 64 of two hashes of the run, start and length,
document); runs are taken as equal when all of these 155 bits are.

Texts are whole UTF-8 byte strings, at most 2^30 bytes each; null counts as empty. Rows that repeat a doc_id are not
earlier than one another: they are numbered within it first. Rows without doc_id neither lose anything nor make others
lose. An empty table gives an empty result; columns other than doc_id and text are ignored. Ids may be of any type that can
be ordered: whole numbers go as they are, all others, and repeated ones too large to be numbered within, by their rank. The
number of different ids times that of the rows of the commonest one must be below 2^63; beyond that the job fails with a
message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ledgerloom.llm.merkle import positions
from ledgerloom.llm.sharding import row_numbers
from ledgerloom.llm.shared import Scratch, row_keyed, whole_text

LENGTH = 50
GRAM = 16
#: Different strings of one gram that are sorted together; grams with more are dealt out by window.
TOGETHER = 20_000
SLICE = 4_000_000
#: Bits of the packed run: gram and run hashes, number of windows, start (low and high); one more says settled.
GRAM_BITS, RUN_BITS, COUNT_BITS, LOW_BITS, HIGH_BITS = 48, 43, 6, 16, 14
C1, C2, C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * C3
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    return _mix(eight[: len(eight) - 8] * C1 ^ _mix(eight[8:]) * C2)


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows of texts of at least LENGTH bytes: gram, two hashes of the run's bytes, text number, start, windows."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    grams = _gram_hashes(data)
    wide = LENGTH - GRAM + 1
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(chosen)]
    whole = np.arange(len(chosen)) + LENGTH <= (first + sizes)[owner]  # windows that stay within their text
    at = np.flatnonzero(whole)
    new = np.r_[True, (chosen[at[1:]] != chosen[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])]
    heads = np.flatnonzero(new)
    start = at[heads]
    count = np.diff(np.r_[heads, len(at)])
    end = start + count + LENGTH - 1
    named, again = count.astype(np.uint64), count.astype(np.uint64)
    for place in (start, start + GRAM, start + 2 * GRAM, end - 3 * GRAM, end - 2 * GRAM, end - GRAM):
        named = _mix(named * C1 ^ grams[place])
        again = _mix(again * C2 + grams[place] * C1)
    owner = owner[start]
    return grams[chosen[start]].view(np.int64), named.view(np.int64), again.view(np.int64), owner, start - first[owner], count


def longest_previous_factors(lcp: np.ndarray, position: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, the longest prefix shared with a suffix of a smaller position.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i. The nearest smaller positions before and after a suffix are
    found with a stack; the shared prefix is the smallest lcp on the way.
    """
    out = np.zeros(len(position), np.int64)
    for values, links, back in (
        (position.tolist(), lcp.tolist(), False),
        (position[::-1].tolist(), np.r_[0, lcp[:0:-1]].tolist(), True),
    ):
        stack: list[tuple[int, int]] = []  # position, common prefix with what lies below it on the stack
        found = []
        for here, link in zip(values, links, strict=True):
            while stack and stack[-1][0] >= here:
                link = min(link, stack.pop()[1])
            found.append(link if stack else 0)
            stack.append((here, link))
        out = np.maximum(out, found[::-1] if back else found)
    return out


def matches(groups: np.ndarray, strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each string, which of its windows also start in a string of its group with a smaller doc.

    The windows of all strings are sorted by group and content, which is suffix order to a depth of LENGTH.
    """
    counts = np.array([len(s) - LENGTH + 1 for s in strings])
    owner = np.repeat(np.arange(len(strings)), counts)
    data = np.frombuffer(b"".join(strings), np.uint8)
    first = np.cumsum([0, *(len(s) for s in strings[:-1])])
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
    # Only windows whose hash occurs twice in their group can match; the others are not sorted.
    grams = _gram_hashes(data)
    hashed = _mix(groups[owner])
    for offset in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
        hashed = _mix(hashed * C1 ^ grams[place + offset])
    ranks = np.argsort(hashed)
    same = np.r_[False, hashed[ranks[1:]] == hashed[ranks[:-1]]]
    twice = np.zeros(len(hashed), bool)
    twice[ranks] = same | np.r_[same[1:], False]
    hit = np.zeros(len(hashed), bool)
    hit[twice] = _in_earlier(groups[owner[twice]], np.lib.stride_tricks.sliding_window_view(data, LENGTH)[place[twice]], docs[owner[twice]])
    return np.split(hit, np.cumsum(counts)[:-1])


def _in_earlier(groups: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows (rows of bytes) are also in their group with a smaller doc, by longest previous factors."""
    if not len(rows):
        return np.zeros(0, bool)
    tagged = np.concatenate([groups.astype(">u8").view(np.uint8).reshape(-1, 8), rows], 1)
    order = np.argsort(np.ascontiguousarray(tagged).view(f"V{LENGTH + 8}").ravel(), kind="stable")
    ranked = tagged[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.where(same.all(1), LENGTH + 8, same.argmin(1))
    lcp = np.r_[0, np.maximum(shared - 8, 0)]
    factor = np.empty(len(order), np.int64)
    factor[order] = longest_previous_factors(lcp, docs[order])
    return factor >= LENGTH


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    last = np.r_[new[1:], True]
    return starts[new], ends[last]


def _numbered(docs: DataFrame, scratch: Scratch, doc_id: str, text: str) -> tuple[DataFrame, int, DataFrame | None]:
    """(d, text) with a different d for every row that has a doc_id, the number that d is to be divided by to get it, and,
    where that gives a rank instead, the ids by rank."""
    whole = isinstance(docs.schema[doc_id].dataType, (ByteType, ShortType, IntegerType, LongType))
    ids = docs.select(F.col(doc_id).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))
    if whole:
        most = ids.agg(F.max("n").alias("ties"), F.min("id").cast("string").alias("least"), F.max("id").cast("string").alias("largest")).first()
        ties = most.ties or 1
        base = docs.select(F.col(doc_id).cast("long").alias("d"), whole_text(text).alias("text"))
        if ties == 1:
            return base, 1, None
        if max(abs(int(most.least)), abs(int(most.largest))) * ties < 2**62:
            number = F.row_number().over(Window.partitionBy("d").orderBy("text")) - 1
            return scratch.write(base.withColumn("d", F.when(F.col("d").isNotNull(), F.col("d") * ties + number))), ties, None
    return _ranked(docs, ids, scratch, doc_id, text)


def _ranked(docs: DataFrame, ids: DataFrame, scratch: Scratch, doc_id: str, text: str) -> tuple[DataFrame, int, DataFrame]:
    """The same by the rank of an id among all. Ranks and places within an id are given without one task that sorts either."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks, different = row_numbers(ids, ["id"], scratch, parts)
    ranks = scratch.write(ranks.withColumnRenamed("row_no", "rank"))
    ties = ranks.agg(F.max("n")).first()[0] or 1
    if different * ties >= 2**63:
        raise ValueError(f"{different} ids of up to {ties} rows each are too many to be numbered")
    docs, key = row_keyed(docs, scratch)
    slim = docs.select(F.col(doc_id).alias("id"), key.alias("_row"), F.xxhash64(whole_text(text)).alias("h")).where("id IS NOT NULL")
    placed = positions(slim.join(ranks.select("id", "rank"), "id").select(F.col("rank").alias("tree"), "h", "_row"), ["h", "_row"], scratch)
    numbers = scratch.write(placed.select("_row", (F.col("tree") * ties + F.col("pos")).alias("d")))
    texts = docs.select(key.alias("_row"), whole_text(text).alias("text")).join(numbers, "_row", "left").select("d", "text")
    return scratch.write(texts), ties, ranks.select("rank", "id")


def _id_of(ties: int) -> Column:
    """The doc_id behind ``d``."""
    return F.col("d") if ties == 1 else F.expr(f"(d - pmod(d, {ties}L)) DIV {ties}L")


class _Copies:
    """The smallest id of each text that a task has seen."""

    def __init__(self, ties: int):
        self.ties = ties
        self.seen: dict[bytes, int] = {}

    def later(self, d: int, text: bytes) -> bool:
        key, own = xxhash.xxh3_128_digest(text), d // self.ties
        first = self.seen.get(key)
        if first is not None and first < own:
            return True
        self.seen[key] = own
        return False


def _settled_here(gram: np.ndarray, named: np.ndarray, again: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of these runs an earlier document among the same ones has too."""
    key = gram ^ _mix(named.view(np.uint64)).view(np.int64)
    order = np.lexsort((again, key))
    ranked, second = key[order], again[order]
    heads = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]) | (second[1:] != second[:-1])])
    first = np.minimum.reduceat(ids[order], heads)
    out = np.empty(len(key), bool)
    out[order] = ids[order] > np.repeat(first, np.diff(np.r_[heads, len(key)]))
    return out


def _runs(texts: DataFrame, ties: int) -> DataFrame:
    """Packed runs (a, b, c, d) of all texts that are long enough.

    a: gram hash and low bits of the start; b: run hash, whether an earlier document at hand has the run, number of windows,
    high bits of the start; c: second run hash. A later copy sends its first run only, with 0 windows, which stands for the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = _Copies(ties)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: list[bytes] = []
            whose: list[int] = []
            copied: list[bool] = []
            size = 0
            for i, text in enumerate(batch.column(1)):
                held.append(bytes(text.as_buffer()))
                whose.append(ids[i])
                copied.append(copies.later(ids[i], held[-1]))
                size += len(held[-1])
                if size >= SLICE or i + 1 == batch.num_rows:
                    yield packed(held, np.array(whose), np.array(copied))
                    held, whose, copied, size = [], [], [], 0

    def packed(held: list[bytes], whose: np.ndarray, copied: np.ndarray) -> pa.RecordBatch:
        gram, named, again, owner, start, n = runs_of(held)
        of_copy = copied[owner]
        use = ~of_copy | (start == 0)
        gram, named, again, owner, start = gram[use], named[use], again[use], owner[use], start[use]
        n = np.where(of_copy[use], 0, n[use])
        d = whose[owner]
        settled = _settled_here(gram, named, again, d // ties)
        # Settled runs need no gram to meet at; a hash of their own spreads them, however frequent their gram is.
        gram = np.where(settled, _mix((d * 64 + 1).view(np.uint64) ^ _mix(start.view(np.uint64))).view(np.int64), gram)
        low, high = start & ((1 << LOW_BITS) - 1), start >> LOW_BITS
        a = gram >> (64 - GRAM_BITS) << LOW_BITS | low
        b = ((named >> (64 - RUN_BITS) << 1 | settled) << COUNT_BITS | n) << HIGH_BITS | high
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(again), pa.array(d)], names=["a", "b", "c", "d"])

    long = texts.where(F.col("d").isNotNull() & (F.octet_length("text") >= LENGTH))
    return long.select("d", "text").mapInArrow(run, "a long, b long, c long, d long")


def _shared_runs(runs: DataFrame, ties: int, parts: int) -> DataFrame:
    """Runs whose gram occurs in two documents or more: d, start, n, and gram and run where the strings are wanted.

    An equal run of an earlier document settles a run. Of the others those are wanted whose gram has different strings.
    """
    dealt = runs.repartition(parts, F.shiftright("a", LOW_BITS))
    plain = dealt.select(
        F.shiftright("a", LOW_BITS).alias("gram"),
        F.shiftright("b", 64 - RUN_BITS).alias("run"),
        "c",
        "d",
        (F.shiftleft(F.col("b").bitwiseAND(F.lit((1 << HIGH_BITS) - 1)), LOW_BITS) + F.col("a").bitwiseAND(F.lit((1 << LOW_BITS) - 1))).alias("start"),
        F.shiftright("b", HIGH_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int").alias("n"),
        _id_of(ties).alias("id"),
        (F.shiftright("b", HIGH_BITS + COUNT_BITS).bitwiseAND(F.lit(1)) == 1).alias("done"),
    )
    by_gram, by_run = Window.partitionBy("gram"), Window.partitionBy("gram", "run", "c")
    known = plain.withColumns(
        {
            "first": F.min("id").over(by_gram),
            "last": F.max("id").over(by_gram),
            "open": (F.min("run").over(by_gram) != F.max("run").over(by_gram)) | (F.min("c").over(by_gram) != F.max("c").over(by_gram)),
        }
    ).where("first < last OR done")
    settled = F.col("done") | (F.col("id") > F.min("id").over(by_run))
    judged = known.withColumn("settled", settled).where("settled OR open")
    wanted = lambda name: F.when(~F.col("settled"), F.col(name)).alias(name)
    return judged.select("d", "start", "n", "settled", wanted("gram"), wanted("run"))


def _packed(texts: DataFrame, ties: int, parts: int) -> DataFrame:
    """(d, z) dealt out by d: the text's length, and its compressed bytes unless it is a later copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, copies = zstandard.ZstdCompressor(level=5), _Copies(ties)
        for batch in batches:
            z = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = bytes(text.as_buffer())
                later = len(text) >= LENGTH and copies.later(d, text)
                z.append(len(text).to_bytes(4, "little") + (b"" if later else packer.compress(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["d", "z"])

    sent = texts.where("d IS NOT NULL").select("d", "text").mapInArrow(run, "d long, z binary")
    # The joins on d would add this filter on one side only, and the two shuffles of the texts would not be one.
    return sent.where("d IS NOT NULL").repartition(parts, "d")


def _cut(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, d, start, s: the bytes of the wanted runs, cut from their texts."""
    asked = wanted.groupBy("d").agg(F.collect_list(F.struct("gram", "start", "n")).alias("asked"))  # runs of one text
    both = packed.join(asked, "d").select("d", "z", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = []
                for d, z, asked in zip(*(c.to_pylist() for c in batch.slice(part, 256).columns), strict=True):
                    text = unpacker.decompress(z[4:])
                    for a in asked:
                        rows.append((a["gram"], d, a["start"], text[a["start"] : a["start"] + a["n"] + LENGTH - 1]))
                yield _batch(rows, {"gram": pa.int64(), "d": pa.int64(), "start": pa.int64(), "s": pa.binary()})

    return both.mapInArrow(run, "gram long, d long, start long, s binary")


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _sorted_matches(strings: DataFrame, ties: int) -> DataFrame:
    """d, start, end of the matching windows of grams with few strings, by longest previous factors.

    The strings of a gram follow one another in a partition, as the window that counted them has left them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            # The last gram of a batch may go on in the next; it has at most TOGETHER strings.
            ends = frame["gram"].to_numpy() == frame["gram"].iloc[-1]
            if held and held[-1]["gram"].iloc[-1] != frame["gram"].iloc[0]:
                yield found(pd.concat(held))
                held = []
            if ends.all():
                held.append(frame)
                continue
            yield found(pd.concat([*held, frame[~ends]]))
            held = [frame[ends]]
        if held:
            yield found(pd.concat(held))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        d, start = rows["d"].to_numpy(), rows["start"].to_numpy()
        grams = rows["gram"].to_numpy().astype(np.int64).view(np.uint64)
        out = []
        for i, hit in enumerate(matches(grams, [bytes(s) for s in rows["s"]], d // ties)):
            if hit.any():
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                out.extend((d[i], start[i] + a, start[i] + b - 1 + LENGTH) for a, b in edge.reshape(-1, 2))
        return pd.DataFrame(out, columns=["d", "start", "end"])

    return strings.select("gram", "d", "start", "s").mapInPandas(run, "d long, start long, end long")


def _dealt_matches(strings: DataFrame, ties: int) -> DataFrame:
    """The same for grams with very many strings: windows meet by content and the smallest doc_id is the first."""
    places = F.sequence(F.lit(0), F.octet_length("s") - LENGTH)
    windows = strings.select("d", "start", "s", F.explode(places).alias("i")).select(
        "d", _id_of(ties).alias("id"), (F.col("start") + F.col("i")).alias("start"), F.substring("s", F.col("i") + 1, F.lit(LENGTH)).alias("w")
    )
    least = windows.groupBy("w").agg(F.min("id").alias("first"))
    return windows.join(least, "w").where("id > first").select("d", "start", (F.col("start") + LENGTH).alias("end"))


def _spans_of(packed: DataFrame, shared: DataFrame, ties: int) -> DataFrame:
    """d, start, end: intervals, possibly overlapping, that cover what goes. An end of null is the end of the text."""
    whole = shared.where("settled").select("d", "start", F.expr(f"IF(n = 0, NULL, start + n + {LENGTH - 1})").alias("end"))
    strings = _cut(packed, shared.where("NOT settled").select("d", "start", "n", "gram"))
    counted = strings.withColumn("_n", F.count("*").over(Window.partitionBy("gram")))
    few = _sorted_matches(counted.where(F.col("_n") <= TOGETHER), ties)
    return whole.unionByName(few).unionByName(_dealt_matches(counted.where(F.col("_n") > TOGETHER), ties))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; ``kept`` too, the remaining bytes, if asked for."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts, ties, ranked = _numbered(docs, scratch, doc_id, text)
    shared = scratch.write(_shared_runs(_runs(texts, ties), ties, parts))
    packed = _packed(texts, ties, parts)
    spans = _spans_of(packed, shared, ties).groupBy("d").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = packed.join(spans, "d", "left").select("d", "z", "spans")
    types = {"d": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "sha": pa.binary(), "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                few = batch.slice(part, 256)
                spans = few.column(2)
                flat = spans.flatten()
                starts = flat.field("start").to_numpy(zero_copy_only=False)
                ends = flat.field("end").fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = pc.fill_null(pc.list_value_length(spans), 0).to_pylist()
                rows, at = [], 0
                for d, z, size in zip(few.column(0).to_pylist(), few.column(1), sizes, strict=True):
                    z = z.as_buffer()
                    n, kept, removed, pieces = int.from_bytes(z[:4], "little"), b"", 0, 0
                    a, b = starts[at : at + size], ends[at : at + size]
                    at += size
                    if z.size > 4:
                        kept = unpacker.decompress(z[4:])
                    else:  # a later copy
                        a, b = np.zeros(1, np.int64), np.array([-1])
                    if len(a):
                        a, b = _spans(a, np.where(b < 0, n, b))
                        edges = np.r_[0, np.stack([a, b], 1).ravel(), n].tolist()
                        kept = b"".join(kept[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                        removed, pieces = int((b - a).sum()), len(a)
                    rows.append((d, n, removed, pieces, hashlib.sha256(kept).digest(), kept if with_text else None))
                yield _batch(rows, types)

    done = both.mapInArrow(run, "d long, n_bytes long, n_removed long, n_spans long, sha binary, kept binary")
    nameless = texts.where("d IS NULL").select(
        F.lit(None).cast("long").alias("d"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.encode("text", "UTF-8").alias("kept"),
    )
    found = done.unionByName(nameless).select(
        _id_of(ties).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("sha")).alias("kept_sha256"), *(["kept"] if with_text else [])
    )
    if ranked is None:
        return found
    columns = found.columns[1:]
    return found.withColumnRenamed("doc_id", "rank").join(ranked, "rank", "left").select(F.col("id").alias("doc_id"), *columns)

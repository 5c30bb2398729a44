"""Bounded-space online packing of tokenized documents into windows of a fixed number of tokens.

Every partition keeps at most ``OPEN`` windows. A document goes to the open window it leaves least room in; where none has
room, a new window is opened, and with ``OPEN`` of them open the fullest is emitted first. A document of a window or more
fills whole windows of its own, and only its rest is placed. What is open when a partition ends is left over: the leftovers
of ``FAN`` partitions meet in one task, are packed again best fit, longest first, and leave ``OPEN`` windows at most, round by
round, until one group is left. That group fills its windows to the last token by cutting pieces; what is less than a window
then is cut into sequences whose lengths are powers of two, which need no padding.

A task holds ``OPEN`` windows while it reads and ``FAN`` x ``OPEN`` windows while it merges, however many documents there are.
With the default tokenizer texts are worked word by word: it drops white space and joins nothing over it, so the ids are
those of the whole text. ``STRETCH`` bytes of text are worked together, short texts by the run and long ones by the stretch;
Arrow cuts them into words and finds the different ones, and only those are looked up and encoded. Other tokenizers get
whole texts.

A null text counts as empty; an empty text is its end id alone. Repeated rows and equal or null ids are documents of their
own. An empty table gives an empty result. Columns other than the two named are ignored. Sequence numbers follow the
partitions of the scan and are unique, not gapless.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ledgerloom.llm.shared import Scratch

WINDOW = 4096
OPEN = 64
FAN = 16
END_ID = 2
#: Bytes of text that are worked together.
STRETCH = 4_000_000
#: Parts of words whose ids a task remembers, and the bytes they have at most.
CACHE, CACHE_BYTES = 500_000, 16_000_000
#: Bytes of ids that leave a task as one batch.
BATCH_BYTES = 4_000_000
#: A sequence number is the round, the partition or group in it, and the place among what that one emitted.
ROUND_BITS, PART_BITS = 56, 32


@dataclass
class Piece:
    """A stretch of a document's ids: ``start`` ids come before it, ``ids`` are little-endian unsigned 32-bit numbers."""

    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """The first ``at`` ids and the others."""
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens),
            Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens),
        )


@dataclass
class Packer:
    """Open windows by the room they have left. ``limit`` of them at most; None for as many as it takes."""

    window: int
    limit: int | None
    room: list[tuple[int, int]] = field(default_factory=list)
    held: dict[int, list[Piece]] = field(default_factory=dict)
    opened: int = 0

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece no longer than a window; windows that are emitted meanwhile come out."""
        at = bisect_left(self.room, (len(piece), -1))
        if at < len(self.room):
            left, number = self.room.pop(at)
        else:
            if self.limit and len(self.room) == self.limit:
                yield self.held.pop(self.room.pop(0)[1])
            left, number = self.window, self.opened
            self.opened += 1
            self.held[number] = []
        self.held[number].append(piece)
        if left > len(piece):
            insort(self.room, (left - len(piece), number))
        else:
            yield self.held.pop(number)

    def rest(self) -> list[list[Piece]]:
        """The open windows, fullest first."""
        return [self.held[number] for _, number in self.room]


def tokens_of(piece_list: list[Piece]) -> int:
    return sum(map(len, piece_list))


def filled_up(windows: list[list[Piece]], window: int) -> list[list[Piece]]:
    """The same ids without a gap: the fullest windows are filled from the emptiest one, pieces being cut where needed.

    What is left of the last window comes out in sequences whose lengths are powers of two, longest first.
    """
    todo = [list(w) for w in sorted(windows, key=tokens_of, reverse=True)]
    done, spare = [], []
    while todo:
        target = todo.pop(0)
        while (gap := window - tokens_of(target)) and (spare or todo):
            if not spare:
                spare = todo.pop()
            piece = spare.pop()
            if len(piece) > gap:
                piece, other = piece.cut(gap)
                spare.append(other)
            target.append(piece)
        done.append(target)
    if spare:
        done.append(spare)
    if not done:
        return done
    last, out = done.pop(), []
    left = tokens_of(last)
    while left:
        out.append([])
        gap = 1 << (left.bit_length() - 1)
        left -= gap
        while gap:
            piece = last.pop(0)
            if len(piece) > gap:
                piece, other = piece.cut(gap)
                last.insert(0, other)
            out[-1].append(piece)
            gap -= len(piece)
    return done + out


def _schema(id_field: StructField) -> StructType:
    long = lambda name: StructField(name, LongType())
    return StructType(
        [
            StructField("doc_id", id_field.dataType), long("start"), long("length"), StructField("ids", BinaryType()), long("doc_tokens"),
            long("sequence_id"), long("offset"), StructField("used", IntegerType()), StructField("padded", IntegerType()),
            StructField("closed", BooleanType()), long("part"),
        ]
    )


class _Rows:
    """Collects pieces as rows of Arrow batches of a bounded size."""

    def __init__(self, arrow: pa.Schema, window: int, level: int, part: int):
        self.arrow, self.window, self.part = arrow, window, part
        self.base, self.emitted = level << ROUND_BITS | part << PART_BITS, 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, pieces: list[Piece], closed: bool = True) -> None:
        used = tokens_of(pieces)
        padded = used if used & (used - 1) == 0 else self.window
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p), p.ids, p.doc_tokens, self.base + self.emitted, offset, used, padded, closed, self.part))
            offset += len(p)
            self.bytes += len(p.ids) + 100
        self.emitted += 1

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in self.arrow]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.arrow, strict=True)], schema=self.arrow)
        self.rows, self.bytes = [], 0
        return out

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.bytes >= BATCH_BYTES:
            yield self.batch()


def stretches(text: bytes, longest: int = STRETCH) -> Iterator[bytes]:
    """``text`` in parts of about ``longest`` bytes, each but the first beginning with a space or a line feed."""
    at = 0
    while len(text) - at > longest:
        found = (text.find(b" ", at + longest), text.find(b"\n", at + longest))
        cut = min((x for x in found if x >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def runs(batch: pa.RecordBatch, longest: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, texts of ``longest`` bytes at a time; a longer text goes by itself."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if held + size > longest and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that begin at ``starts``, one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    place = np.repeat((starts - ends + sizes).astype(kind), sizes)
    place += np.arange(total, dtype=kind)
    return flat[place], ends


class Remembered:
    """The ids of words, as arrays: ``young`` has the words, each with a place and a number of ids in ``ids``.

    When there would be more than ``limit`` of them, or more bytes of them than ``most``, those stay that were just asked for.
    """

    def __init__(self, limit: int, most: int = CACHE_BYTES):
        self.limit, self.most, self.young, self.ids = limit, most, pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.starts = self.sizes = np.zeros(0, np.int64)

    def __call__(self, words: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """Start and size in ``ids`` of different words. ``learn`` gives ids, starts and sizes of those at the places it is told."""
        at = pc.fill_null(pc.index_in(words, value_set=self.young), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.young) + len(new) > self.limit or self.young.nbytes + words.nbytes > self.most:
                old = np.flatnonzero(at >= 0)
                self.young, self.sizes = self.young.take(pa.array(at[old])), self.sizes[at[old]]
                self.ids, ends = gathered(self.ids, self.starts[at[old]], self.sizes)
                self.starts = ends - self.sizes
                at[old] = np.arange(len(old))
            at[new] = len(self.young) + np.arange(len(new))
            ids, starts, sizes = learn(new)
            self.young = pa.concat_arrays([self.young, words.take(pa.array(new))])
            self.starts, self.sizes = np.concatenate([self.starts, len(self.ids) + starts]), np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        return self.starts[at], self.sizes[at]


@dataclass
class Vocabulary:
    """A tokenizer file, whether its words can be cut beforehand, and which of its tokens end a word."""

    config: str
    cut: bool
    ends_word: np.ndarray

    #: The pattern of the tokenizer whose words can be cut.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            config = f.read()
        made = json.loads(config)
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = [c["pattern"]["Regex"] for c in (made["pre_tokenizer"] or {}).get("pretokenizers", []) if c["type"] == "Split"]
        suffix = made["model"].get("end_of_word_suffix")
        if steps != ["NFC", "Replace", "Lowercase"] or cuts != [cls.PATTERN] or not suffix:
            return cls(config, False, np.zeros(0, bool))
        ids = made["model"]["vocab"]
        ends = np.zeros(max(ids.values()) + 1, bool)
        ends[[i for token, i in ids.items() if token.endswith(suffix)]] = True
        return cls(config, True, ends)


#: Bytes of plain words: 0 of letters (those of two bytes are the small letters of Latin-1), 1 digits, 2 signs.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
KIND[0x30:0x3A] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Controls and the space; what may follow the byte C3 (the signs for times and by are no letters).
CONTROL = np.isin(np.arange(256), [*range(0x21), 0x7F])
AFTER_C3 = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])


def cut_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words that stand between white space, lowered and cut where the tokenizer's own pattern cuts them.

    Gives the parts, which of them are odd, and the number of parts before each word and at the end. Only plain words are cut
    and lowered: of letters of Latin-1, digits and signs. Other characters may be composed, lowered or classed in ways of their
    own, and ``<|`` may begin a special token; such a word is one odd part.
    """
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    n = int(bounds[-1] - bounds[0])
    data = np.zeros(n + 2, np.uint8)  # two bytes more, so that every byte has two others behind it
    if n:
        data[:n] = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    first = np.zeros(n + 2, bool)
    first[bounds] = first[n:] = True
    kind, joined = KIND[data], ~first[1:]
    cut = first.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 1)
    low, bad = LOWER[data], CONTROL[data]
    bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|")) & joined
    if (data >= 0x80).any():
        pair = (data[:-1] == 0xC3) & AFTER_C3[data[1:]] & joined
        low[1:][pair & (data[1:] < 0x9F)] += 0x20
        bad |= data >= 0x80
        bad[:-1][pair] = bad[1:][pair] = False
    odd = np.zeros(len(words), bool)
    odd[np.searchsorted(bounds, np.flatnonzero(bad[:n]), "right") - 1] = True
    whole = np.repeat(odd, np.diff(bounds))
    cut[:n][whole] = first[:n][whole]
    low[:n][whole] = data[:n][whole]
    # 's 't 'm 'd 're 've 'll where a part begins
    quotes = np.flatnonzero(cut[:n] & (data[:n] == ord("'")) & ~whole)
    one, two = low[quotes + 1], low[quotes + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((two == ord("e")) & np.isin(one, list(b"rv"))) | ((two == ord("l")) & (one == ord("l")))
    size = np.where(first[quotes + 1], 0, np.where(short, 1, np.where(long & ~first[quotes + 2], 2, 0)))
    quotes, size = quotes[size > 0], size[size > 0]
    cut[quotes + 1] = False
    cut[quotes + 1 + size] = True
    starts = np.flatnonzero(cut[:n])
    before = np.searchsorted(starts, bounds)
    offsets = np.append(starts, n).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
    return parts, np.repeat(odd, np.diff(before)), before


class WordEncoder:
    """Ids of whole texts, from a bounded cache of the ids of their words.

    The tokenizer drops white space and joins nothing over it, so a text's ids are those of its words one after the other.
    Of many texts the different words are taken, and of those the different parts that the tokenizer's own pattern cuts. New
    parts are encoded together; each gives one run of tokens, the last of which ends a word. Odd ones are left to the
    tokenizer one by one. A tokenizer made otherwise gets every text whole.
    """

    TOGETHER = 1000

    def __init__(self, vocabulary: Vocabulary, end_id: int, limit: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_str(vocabulary.config), np.array([end_id], "<u4").tobytes()
        self.cut, self.ends_word = vocabulary.cut, vocabulary.ends_word
        self.words = Remembered(limit)
        self.bare = Tokenizer(self.tokenizer.model)
        levels = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(levels)

    def _one_by_one(self, words: list[bytes | None]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([(w or b"").decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _learn(self, parts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different parts, and where those of each part begin and how many they are."""
        got, sizes, order = [np.zeros(0, "<u4")], [], np.argsort(odd, kind="stable")
        plain = len(parts) - int(odd.sum())
        for at in range(0, len(parts), self.TOGETHER):
            some = parts.take(pa.array(order[at : at + self.TOGETHER]))
            if at + len(some) <= plain:
                text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), b" ")[0].as_py().decode()
                ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(some):
                    got.append(ids)
                    sizes.append(np.diff(ends, prepend=0))
                    continue
            each = self._one_by_one(some.to_pylist())
            got += each
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        by_part = np.empty((2, len(parts)), np.int64)
        sizes = np.concatenate(sizes)
        by_part[:, order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate(got), *by_part

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after the other, and where those of each text end."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
        words = lists.flatten().dictionary_encode()
        parts, odd, before = cut_words(words.dictionary.view(pa.binary()))
        parts = parts.dictionary_encode()
        part_of = parts.indices.to_numpy()
        odd_ones = np.zeros(len(parts.dictionary), bool)
        odd_ones[part_of[odd]] = True
        starts, sizes = self.words(parts.dictionary, lambda new: self._learn(parts.dictionary.take(pa.array(new)), odd_ones[new]))
        # First the ids of every different word from those of its parts, then those of the texts from those of their words.
        ids, ends = gathered(self.words.ids, starts[part_of], sizes[part_of])
        bounds = np.append(0, ends)[before]
        word_of = words.indices.to_numpy()
        ids, ends = gathered(ids, bounds[:-1][word_of], np.diff(bounds)[word_of])
        return ids, np.append(0, ends)[np.cumsum(pc.list_value_length(lists).to_numpy())]

    def all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text and the end id. A text of more than ``STRETCH`` bytes comes by itself."""
        if pa.types.is_large_binary(texts.type):
            texts = pa.array(texts.to_pylist(), pa.binary())
        if not self.cut:
            yield from (self._one_by_one([text])[0].tobytes() + self.end for text in texts.to_pylist())
        elif len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > STRETCH:
            parts = stretches(texts[0].as_py(), STRETCH)
            yield b"".join(self._joined(pa.array([part], pa.binary()))[0].tobytes() for part in parts) + self.end
        else:
            ids, ends = self._joined(texts)
            start = 0
            for end in ends.tolist():
                yield ids[start:end].tobytes() + self.end
                start = end

    def __call__(self, text: bytes | None) -> bytes:
        """The ids of a text and the end id."""
        return next(self.all(pa.array([text], pa.binary())))


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, fan: int = FAN,
    end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset, used, padded of every piece.

    ``used`` is the number of ids in the piece's sequence, ``padded`` the length it is padded to: ``window``, or ``used``
    itself where that is a power of two. ``tokenizer_path`` is read by the driver and sent to the tasks.
    """
    from pyspark import TaskContext

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(tokenizer_path))
    scratch = Scratch(spark, "packing")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = _schema(slim.schema["doc_id"])
    empty = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = WordEncoder(vocabulary.value, end_id)
        rows = _Rows(arrow, window, 0, TaskContext.get().partitionId())
        packer = Packer(window, open_windows)
        for batch in batches:
            for run in runs(batch, STRETCH):
                for key, ids in zip(run.column(0).to_pylist(), encode.all(run.column(1)), strict=True):
                    total, at = len(ids) // 4, 0
                    while total - at >= window:
                        rows.add([Piece(key, at, ids[4 * at : 4 * (at + window)], total)])
                        at += window
                        yield from rows.full()
                    left = Piece(key, at, ids[4 * at :], total)
                    if len(left):
                        for emitted in packer.put(left):
                            rows.add(emitted)
                        yield from rows.full()
        for held in packer.rest():
            rows.add(held, closed=False)
        del encode  # an idle worker keeps what its last task held
        yield rows.batch()

    def merge(level: int, last: bool):
        def merged(key: tuple, table: pa.Table) -> pa.Table:
            rows = _Rows(arrow, window, level, key[0].as_py())
            got = table.select(["doc_id", "start", "ids", "doc_tokens", "length", "sequence_id", "offset"]).to_pylist()
            got.sort(key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
            packer = Packer(window, None)
            for r in got:
                for full in packer.put(Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])):
                    rows.add(full)
            rest = packer.rest()
            keep = 0 if last else open_windows
            for held in filled_up(rest, window) if last else rest[: max(0, len(rest) - keep)]:
                rows.add(held)
            for held in rest[max(0, len(rest) - keep) :] if keep else ():
                rows.add(held, closed=False)
            return pa.Table.from_batches([rows.batch()])

        return merged

    # Token ids are below 2^16 in most vocabularies, so half of their bytes are zero.
    placed = scratch.write(slim.mapInArrow(windows, schema), compression="zstd")
    done = [placed.where("closed")]
    groups = (placed.agg(F.max("part")).first()[0] or 0) + 1
    left, level = placed.where("NOT closed"), 0
    while True:
        groups, level = -(-groups // fan), level + 1
        grouped = left.withColumn("part", F.expr(f"part div {fan}")).groupBy("part")
        merged = scratch.write(grouped.applyInArrow(merge(level, groups == 1), schema), compression="zstd")
        done.append(merged.where("closed"))
        if groups == 1:
            break
        left = merged.where("NOT closed")
    out = empty
    for pieces in done:
        out = out.unionByName(pieces)
    return out.drop("closed", "part")

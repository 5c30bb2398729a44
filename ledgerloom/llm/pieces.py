"""Sub-word encoding with seeded merge-dropout, and lossless decoding.

A text is encoded by merging adjacent pieces from single characters upwards, best piece first, ties from the left. Each
candidate merge taken from the agenda is skipped when a hash of its place and length, keyed by seed, document and the unit's
place in the document, falls below the dropout rate. So one text has many segmentations, each reproducible from its seed,
and all decode to the text itself. With dropout 0 the result is the usual encoding.

A unit is a run of spaces with the word behind it, or the start of a line; no piece spans two units, so units are merged on
their own. A bounded cache holds what a unit becomes without dropout and the candidates taken on the way. A unit none of
whose candidates is skipped at its place takes that result; every other one is merged anew with its own key.
Characters outside the vocabulary become bytes. So do characters equal to the vocabulary's own mark for a space, which would
otherwise come back as spaces.

A null text gives null ids; an empty text gives no ids and decodes to an empty text. Rows are independent: repeated rows
with one doc_id get one segmentation, an empty table an empty result, and columns other than doc_id and text are ignored.
Texts are encoded whole, in slices of few rows, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ledgerloom.llm.shared import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 400_000
#: Longer units (texts without spaces, long rows of spaces) are not kept in the cache.
CACHED_LENGTH = 64
#: Odd constants of the multiplicative hash that decides on dropout.
SPREAD, MULTIPLIER, MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 2**64 - 1
#: Stands for the places of a unit that only the heap can merge; no real place is that large a number.
NO_PLACE = np.uint64(MASK)
ODD = NO_PLACE.tobytes()


@dataclass
class Vocabulary:
    """Pieces of a merge-type model: ids and ranks (best lowest) of the mergeable pieces, and the bytes of every id."""

    ids: dict[str, int]
    ranks: dict[str, float]
    byte_ids: list[int]
    surface: list[bytes] = field(repr=False)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, ranks, surface, byte_ids = {}, {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                surface.append(b"")
            else:
                ids[piece] = i
                ranks[piece] = -model.get_score(i)
                surface.append(piece.replace(MARK, " ").encode())
        return cls(ids, ranks, byte_ids, surface)


class PairTable:
    """Which piece two adjacent symbols merge into, as an open-addressing table that whole arrays are looked up in."""

    SLOTS = 20

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        symbols = dict(ids)
        for piece in ids:
            for c in piece:
                symbols.setdefault(c, len(vocabulary.surface) + len(symbols))
        self.by_char = np.full(0x110000, -1, np.int32)
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.by_char[ord(piece)] = i
        made = [
            (symbols[piece[:cut]] << 20 | symbols[piece[cut:]], i)
            for piece, i in ids.items()
            for cut in range(1, len(piece))
            if piece[:cut] in symbols and piece[cut:] in symbols
        ]
        keys, values = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.values = np.full(1 << self.SLOTS, -1, np.int32)
        slots = self._slot(keys)
        while len(keys):
            # Of the keys that want one free slot the first gets it; the others try the next slot.
            _, pick = np.unique(slots, return_index=True)
            pick = pick[self.keys[slots[pick]] < 0]
            self.keys[slots[pick]], self.values[slots[pick]] = keys[pick], values[pick]
            rest = np.ones(len(keys), bool)
            rest[pick] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.SLOTS) - 1)
        # Ranks by id, best lowest; the entry that -1 finds is the last.
        self.rank = np.full(len(vocabulary.surface) + 1, np.iinfo(np.int32).max, np.int32)
        scores = np.unique(list(vocabulary.ranks.values()))
        for piece, i in ids.items():
            self.rank[i] = np.searchsorted(scores, vocabulary.ranks[piece])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(SPREAD)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pieces, -1 where there is none. A symbol below 0 merges with nothing."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        out = np.full(keys.shape, -1, np.int32)
        live = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys, flat = keys.ravel()[live], out.ravel()
        slots = self._slot(keys)
        while len(live):
            there = self.keys[slots]
            hit = there == keys
            flat[live[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            live, keys, slots = live[on], keys[on], (slots[on] + 1) & ((1 << self.SLOTS) - 1)
        return flat.reshape(out.shape)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_keys(salts: np.ndarray, places: np.ndarray, seed: int = 0) -> np.ndarray:
    """The dropout keys of units from the seed, the salt of their document and their place in it."""
    start = salts.astype(np.uint64) + np.uint64(seed * MULTIPLIER & MASK)
    return _mixed(start + places.astype(np.uint64) * np.uint64(SPREAD))


class Encoder:
    """Encodes texts with one vocabulary, dropout rate and seed."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.1, seed: int = 0):
        self.v = vocabulary
        self.pairs = PairTable(vocabulary)
        self.limit = int(dropout * 2**64)
        self.seed = seed
        #: Ids of a unit without dropout, the hashed places of the merges that lead to them, and the unit's text.
        self.cache: dict[str, tuple[bytes, bytes, str]] = {}
        self.mark_bytes = self._bytes(MARK)
        # Where no piece holds a line break, nothing merges across one.
        self.line_break = b"" if any("\n" in piece for piece in vocabulary.ids) else self._bytes("\n")

    def _bytes(self, text: str) -> bytes:
        return array("i", [self.v.byte_ids[b] for b in text.encode()]).tobytes()

    def merged(self, unit: str, key: int = 0, dropout: bool = True) -> bytes:
        """Ids of one unit as 32-bit integers. The agenda is a heap; entries whose pair has changed meanwhile are passed over."""
        rank, limit = self.v.ranks.get, self.limit if dropout else 0
        parts: list[str | None] = list(unit)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        agenda: list[tuple[float, int, int]] = []

        def propose(left: int, right: int) -> None:
            piece = parts[left] + parts[right]
            found = rank(piece)
            if found is not None:
                heapq.heappush(agenda, (found, left, len(piece)))

        for i in range(len(parts) - 1):
            propose(i, i + 1)
        while agenda:
            _, left, length = heapq.heappop(agenda)
            right = after[left]
            if parts[left] is None or right >= len(parts) or len(parts[left]) + len(parts[right]) != length:
                continue
            if limit and (key ^ (left * SPREAD + length)) * MULTIPLIER & MASK < limit:
                continue
            parts[left] += parts[right]
            parts[right] = None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                propose(left, after[left])
            if before[left] >= 0:
                propose(before[left], left)
        out: list[int] = []
        for part in parts:
            if part is not None:
                found = self.v.ids.get(part)
                out.extend([found] if found is not None else [self.v.byte_ids[b] for b in part.encode()])
        return array("i", out).tobytes()

    def _alike(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Places of units of one length with the matrix of their symbols; None where only the heap can merge them."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.pairs.by_char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        first = np.cumsum(sizes) - sizes
        # Units with characters that no piece knows, and long ones, take the heap.
        plain = sizes <= CACHED_LENGTH
        plain[np.repeat(np.arange(len(units)), sizes)[(symbols < 0) | (symbols >= len(self.v.surface))]] = False
        if not plain.all():
            yield np.flatnonzero(~plain), None
        order = np.flatnonzero(plain)[np.argsort(sizes[plain], kind="stable")]
        ends = np.flatnonzero(np.diff(sizes[order], append=-1)) + 1
        for at in np.split(order, ends[:-1]) if len(order) else ():
            yield at, symbols[first[at][:, None] + np.arange(sizes[at[0]])]

    def merged_many(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of many units without dropout, and the hashed places of their merges in order."""
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(units)
        for at, symbols in self._alike(units):
            if symbols is None:
                for i in at.tolist():
                    out[i] = (self.merged(units[i], dropout=False), ODD)
                continue
            ids, places = self._matrix(symbols, None)
            left = ids >= 0
            counts, flat = left.sum(1), ids[left].tobytes()
            ends, stops = np.cumsum(4 * counts).tolist(), np.cumsum(8 * (symbols.shape[1] - counts)).tolist()
            for i, a, b, c, d in zip(at.tolist(), [0, *ends], ends, [0, *stops], stops, strict=False):
                out[i] = (flat[a:b], places[c:d])
        return out

    def merged_by(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of many units, each with its own key for dropout."""
        out = [b""] * len(units)
        for at, symbols in self._alike(units):
            if symbols is None:
                for i in at.tolist():
                    out[i] = self.merged(units[i], int(keys[i]))
                continue
            ids, _ = self._matrix(symbols, keys[at])
            left = ids >= 0
            flat, ends = ids[left].tobytes(), np.cumsum(4 * left.sum(1)).tolist()
            for i, a, b in zip(at.tolist(), [0, *ends], ends, strict=False):
                out[i] = flat[a:b]
        return out

    def _matrix(self, symbols: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, bytes]:
        """Final symbols of units of one length, -1 where a symbol has gone into the one before it.

        The agendas of all units are rows of a matrix. Symbols stay where they began and know their neighbours, so a step
        touches a few cells of each row. Without keys nothing is skipped, and the hashed places of all merges come too.
        """
        n, size = symbols.shape
        limit = self.limit if keys is not None else 0
        if size == 1:
            return symbols, b""
        never = self.pairs.rank[-1]
        pairs = np.full((n, size), -1, np.int32)
        pairs[:, :-1] = self.pairs(symbols[:, :-1], symbols[:, 1:])
        ranks = self.pairs.rank[pairs]
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (n, 1))
        rows = np.arange(n)
        whose, taken = [], []
        while len(rows):
            now = ranks[rows]
            left = now.argmin(1)
            on = now[np.arange(len(rows)), left] < never
            rows, left = rows[on], left[on]
            if not len(rows):
                break
            at, right = rows, after[rows, left]
            end = after[at, right]
            place = left.astype(np.uint64) * np.uint64(SPREAD) + (end - left).astype(np.uint64)
            if limit:
                missed = (keys[at] ^ place) * np.uint64(MULTIPLIER) < np.uint64(min(limit, MASK))
                ranks[at[missed], left[missed]] = never
                at, left, right, end = at[~missed], left[~missed], right[~missed], end[~missed]
            else:
                whose.append(at)
                taken.append(place)
            joined = pairs[at, left]
            symbols[at, left], symbols[at, right] = joined, -1
            ranks[at, right] = never
            after[at, left] = end
            inner, ahead = end < size, before[at, left]
            before[at[inner], end[inner]] = left[inner]
            first = ahead >= 0
            # The pairs with the neighbours on either side, looked up together.
            follower = np.where(inner, symbols[at, np.minimum(end, size - 1)], -1)
            leader = symbols[at[first], ahead[first]]
            made = self.pairs(np.concatenate([joined, leader]), np.concatenate([follower, joined[first]]))
            new, old = made[: len(at)], made[len(at) :]
            pairs[at, left], ranks[at, left] = new, self.pairs.rank[new]
            pairs[at[first], ahead[first]], ranks[at[first], ahead[first]] = old, self.pairs.rank[old]
        if limit or not whose:
            return symbols, b""
        order = np.argsort(np.concatenate(whose), kind="stable")
        return symbols, np.concatenate(taken)[order].tobytes()

    def encode(self, text: str, salt: int = 0) -> np.ndarray:
        return self.encode_all([text], [salt])[0]

    def encode_all(self, texts: list[str], salts: list[int]) -> list[np.ndarray]:
        """Ids of each text; a salt stands for a document."""
        out: list[bytes | None] = []
        names: list[str] = []
        slots: list[range] = []
        ends, units_of = [], []
        for text in texts:
            before = len(names)
            for k, stretch in enumerate((" " + text).split(MARK) if text else ()):
                if k:
                    out.append(self.mark_bytes)
                for n, line in enumerate(stretch.split("\n") if self.line_break else (stretch,)):
                    if n:
                        out.append(self.line_break)
                    words = self._units(line)
                    slots.append(range(len(out), len(out) + len(words)))
                    out.extend([None] * len(words))
                    names += words
            ends.append(len(out))
            units_of.append(len(names) - before)
        filled = self._encoded(names, np.array(salts, np.uint64), np.array(units_of, np.int64))
        at = 0
        for some in slots:
            out[some.start : some.stop] = filled[at : at + len(some)]
            at += len(some)
        return [np.frombuffer(b"".join(out[a:b]), np.int32) for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _units(line: str) -> list[str]:
        """The names of the units of a stretch in which only spaces part them: a word behind one space goes by itself, one
        behind several with its spaces, the start of the line with a line break before it."""
        head, *words = line.split(" ")
        if "" in words:  # a run of spaces belongs to the word behind it
            words = [u[1:] if u.count(" ") == 1 else u for u in re.findall(" +[^ ]*", line)]
        return ["\n" + head, *words] if head else words

    @staticmethod
    def _text_of(name: str) -> str:
        return name[1:] if name.startswith("\n") else (name if name.startswith(" ") else " " + name).replace(" ", MARK)

    def _encoded(self, names: list[str], salts: np.ndarray, units_of: np.ndarray) -> list[bytes]:
        """The ids of all units of some documents, which follow one another."""
        fresh = list(set(names).difference(self.cache))
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = list(set(names))
        units = [self._text_of(n) for n in fresh]
        self.cache.update((n, (*got, u)) for n, got, u in zip(fresh, self.merged_many(units), units, strict=True))
        found = list(map(self.cache.__getitem__, names))
        ids = [f[0] for f in found]
        if self.limit:
            place_in_doc = np.arange(len(names)) - np.repeat(np.cumsum(units_of) - units_of, units_of)
            keys = unit_keys(np.repeat(salts, units_of), place_in_doc, self.seed)
            places = [f[1] for f in found]
            sizes = np.fromiter(map(len, places), np.int64, len(places)) // 8
            hashed = np.frombuffer(b"".join(places), np.uint64)
            missed = (np.repeat(keys, sizes) ^ hashed) * np.uint64(MULTIPLIER) < np.uint64(min(self.limit, MASK))
            # Units that only the heap merges have no places; they are always merged anew.
            touched = np.zeros(len(names), bool)
            touched[np.repeat(np.arange(len(names)), sizes)[missed | (hashed == NO_PLACE)]] = True
            again = np.flatnonzero(touched)
            for i, got in zip(again.tolist(), self.merged_by([found[i][2] for i in again.tolist()], keys[again]), strict=True):
                ids[i] = got
        for name in fresh:
            if len(name) > CACHED_LENGTH:
                del self.cache[name]
        return ids


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of ``ids``: pieces and bytes joined, less the space that encoding puts before the first word."""
    joined = b"".join(map(vocabulary.surface.__getitem__, ids.tolist())).decode()
    return joined[1:] if joined.startswith(" ") else joined


def encoded(
    docs: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 20240229, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, ids, n_tokens, lossless: the segmentation of each text, and whether decoding it gives the text."""
    vocabulary = Vocabulary.load(model)
    key_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, dropout, seed)
        for batch in batches:
            for keys, texts in slices(batch):
                salts = [xxhash.xxh64_intdigest(str(k), seed) for k in keys.to_pylist()]
                got = encoder.encode_all([t or "" for t in texts], salts)
                ids = [None if t is None else i for t, i in zip(texts, got, strict=True)]
                same = [None if t is None else decode(vocabulary, i) == t for t, i in zip(texts, ids, strict=True)]
                sizes = [0 if i is None else len(i) for i in ids]
                flat = np.concatenate([i for i in ids if i is not None] or [np.empty(0, np.int32)])
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()), mask=pa.array([t is None for t in texts]))
                count = pa.array([None if i is None else len(i) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys, lists, count, pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "lossless"]
                )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {key_type}, ids array<int>, n_tokens bigint, lossless boolean")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded rows."""
    vocabulary = Vocabulary.load(model)
    key_type = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            texts = [decode(vocabulary, np.asarray(x.values)) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {key_type}, text string")

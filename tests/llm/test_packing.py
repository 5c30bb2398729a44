"""Packing against the tokenizer itself: every id once, windows without gaps, little padding, leftovers merged."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, ids string, part string, closed string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, tokenizer, window):
    """``rows`` hold every id of every text once and no sequence has a gap; the share of padding comes back."""
    want = sorted((str(d), tuple(plain_ids(tokenizer, t))) for d, t in texts)
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length, r.used, r.padded))
        by_doc[str(r.doc_id)].append((r.start, r.doc_tokens, ids))
    got = []
    for d, pieces in by_doc.items():
        # Rows with one id are told apart by continuing a document where it stops.
        open_docs = []
        for start, total, ids in sorted(pieces):
            if start == 0:
                open_docs.append((total, ids))
                continue
            fits = [i for i, (t, have) in enumerate(open_docs) if t == total and len(have) == start]
            assert fits
            t, have = open_docs[fits[0]]
            open_docs[fits[0]] = (t, have + ids)
        assert all(t == len(have) for t, have in open_docs)
        got += [(d, have) for _, have in open_docs]
    assert sorted(got) == want
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
        assert {p[2] for p in parts} == {at} and at <= window
        assert {p[3] for p in parts} == {at if at & (at - 1) == 0 else window}
        padding += parts[0][3] - at
    return padding / max(1, sum(len(i) for _, i in want))


def test_awkward_rows(spark, tokenizer):
    texts = [
        (1, "Hello World, it's 2024!"), (1, "Hello World, it's 2024!"), (2, None), (3, ""), (None, "no id"), (None, None),
        (4, "word " * 9_000), (5, "x" * 30_000), (6, " \t\n  "), (7, "ÉÀ ß́ Σας <|endoftext|>   日本語のテキスト"), (8, "a\n\nb  c " * 3_000),
    ]
    docs = spark.createDataFrame([(*t, "i", "p", "c") for t in texts], SCHEMA).repartition(3)
    for window, fan in ((4096, 16), (64, 2)):
        rows = packing.pack(docs, window=window, open_windows=2, fan=fan).collect()
        check(rows, texts, tokenizer, window)
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "used", "padded"]


def test_text_ids_and_only_the_last_window_is_cut(spark, tokenizer):
    texts = [(f"d{i}", "tok " * (i % 50)) for i in range(300)]
    docs = spark.createDataFrame(texts, "name string, body string").repartition(5)
    rows = packing.pack(docs, window=256, doc_id="name", text="body").collect()
    # All windows are leftovers here, and the group they meet in leaves no padding at all.
    assert check(rows, texts, tokenizer, 256) == 0
    assert len({r.sequence_id for r in rows if r.used < 256}) == bin(sum(r.length for r in rows) % 256).count("1")


def test_rounds_of_merging(spark, tokenizer):
    rng = random.Random(5)
    texts = [(i, "and " * int(rng.paretovariate(0.7) * 6 % 900)) for i in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(9)
    rows = packing.pack(docs, window=512, open_windows=4, fan=2).collect()
    assert {r.sequence_id >> packing.ROUND_BITS for r in rows} >= {0, 1, 4}
    assert check(rows, texts, tokenizer, 512) < 0.05
    assert sorted(map(str, packing.pack(docs, window=512, open_windows=4, fan=2).collect())) == sorted(map(str, rows))


ALPHABET = "ab cdEÉ1é́ \n\t\x0b\x0c\x85\xa0\u3000\x1c 'sßÖ'×÷µªǰŒJ̌İΣ,.<|日 한ᄒ"


@pytest.mark.parametrize("limit", [5, 400_000])
def test_words_give_the_ids_of_the_whole_text(tokenizer, limit, monkeypatch):
    rng = random.Random(3)
    encode = packing.WordEncoder(packing.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")), 2, limit)
    assert encode.cut
    monkeypatch.setattr(packing, "STRETCH", 40)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 300))) for _ in range(300)]
    texts += ["".join(rng.choices("abcde fghi'stm .,!#12ÀéßÿÖ", k=300)) for _ in range(200)]
    texts += ["a<|endoftext|>B <|ENDOFTEXT|> <|startoftext|>", "we're THEY'LL 'S's ''s", "x" * 5000]
    for text in texts:
        assert b"".join(packing.stretches(text.encode(), 7)) == text.encode()
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == plain_ids(tokenizer, text)
    assert encode(None) == encode.end and len(encode.words.young) <= max(limit, 300)


class Counted:
    """A tokenizer that counts how often it is called."""

    def __init__(self, made):
        self.made, self.calls = made, 0

    def encode_batch_fast(self, *args, **kwargs):
        self.calls += 1
        return self.made.encode_batch_fast(*args, **kwargs)


def test_words_of_many_texts_are_encoded_together(tokenizer):
    encode = packing.WordEncoder(packing.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")), 2)
    encode.bare, encode.tokenizer = Counted(encode.bare), Counted(encode.tokenizer)
    texts = [None if i % 50 == 7 else f"Word{i}x and, {'ab' * (i % 9)} d'{i}" for i in range(2_000)]
    got = encode.all(pa.array([t and t.encode() for t in texts], pa.binary()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain_ids(tokenizer, t) for t in texts]
    # A call for every text with new words took most of the time.
    assert encode.bare.calls + encode.tokenizer.calls <= 3
    again = list(encode.all(pa.array([b"and, ababab"] * 9, pa.large_binary()).slice(2, 3)))
    assert again == [encode(b"and, ababab")] * 3 and encode.bare.calls <= 3


def test_long_words_are_not_all_remembered(tokenizer):
    encode = packing.WordEncoder(packing.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")), 2)
    encode.words.most = 20_000
    for i in range(40):
        text = f"日{i}" * 300 + " and " + "xy" * 900 + f" {i} and"
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == plain_ids(tokenizer, text)
        assert encode.words.young.nbytes < 20_000 and len(encode.words.ids) < 20_000


def test_runs_of_texts():
    sizes = [3, None, 4, 30, 0, 5, 5, 1]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sizes))), pa.array([n if n is None else b"x" * n for n in sizes], pa.binary())], names=["k", "t"]
    )
    assert [r.column(0).to_pylist() for r in packing.runs(batch, 10)] == [[0, 1, 2], [3], [4, 5, 6], [7]]
    assert [r.num_rows for r in packing.runs(batch.slice(2), 10)] == [1, 1, 3, 1]
    assert not list(packing.runs(batch.slice(0, 0), 10))


def test_invalid_bytes_and_long_texts(tokenizer, monkeypatch):
    encode = packing.WordEncoder(packing.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")), 2)
    for text in (b"a\xc3 b\xa9c \xc3", b"\xff\xc3\x97 \xc3\xc3\xa9 \xe2\x82", b"\xc3\x89'\xc3\x89 A\x00B"):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain_ids(tokenizer, text.decode("utf-8", "replace"))
    long = "We'll see 12 words, " * 400
    want = encode(long.encode())
    assert np.frombuffer(want, "<u4").tolist() == plain_ids(tokenizer, long)
    monkeypatch.setattr(packing, "STRETCH", 50)
    assert encode(long.encode()) == want


PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
NOT_PLAIN = re.compile(r"[^!-~À-ÖØ-öø-ÿ]|<\|")
CHARACTERS = "aZlLrRvVeEsStTmMdD'''09.,<|\x1c×÷ÀÞßöøÿéµŒ日"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(st.sampled_from(CHARACTERS), max_size=12), max_size=8), st.integers(0, 2))
def test_words_are_cut_as_the_pattern_cuts_them(words, skip):
    parts, odd, before = packing.cut_words(pa.array([w.encode() for w in words], pa.binary()).slice(skip))
    got = [p.decode() for p in parts.to_pylist()]
    assert len(got) == len(odd) == before[-1] and len(before) == len(words[skip:]) + 1
    for word, a, b in zip(words[skip:], before[:-1], before[1:], strict=True):
        plain = not NOT_PLAIN.search(word)
        assert got[a:b] == (PARTS.findall(word.lower()) if plain else [word])
        assert all(odd[a:b] != plain)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    encode = packing.WordEncoder(packing.Vocabulary.load(path), 50256)
    for text in ("two  words\n and more ", "", "É"):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == [*other.encode(text, add_special_tokens=False).ids, 50256]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80), st.integers(1, 6))
def test_packer_is_bounded_and_best_fit(sizes, limit):
    packer = packing.Packer(32, limit)
    emitted = []
    for i, n in enumerate(sizes):
        room = [left for left, _ in packer.room]
        fitting = [left for left in room if left >= n]
        out = list(packer.put(packing.Piece(i, 0, bytes(4 * n), n)))
        emitted += out
        assert len(packer.room) <= limit
        if not fitting and len(room) == limit:
            assert 32 - packing.tokens_of(out[0]) == min(room)  # the fullest went
        after = [left for left, _ in packer.room]
        if fitting and min(fitting) > n:
            assert after.count(min(fitting) - n) >= 1
    windows = packing.filled_up(packer.rest(), 32)
    assert sum(map(packing.tokens_of, windows + emitted)) == sum(sizes)
    lengths = [packing.tokens_of(w) for w in windows]
    assert all(n == 32 or n & (n - 1) == 0 for n in lengths) and sum(n < 32 for n in lengths) <= 5


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op11_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        ids = plain_ids(tokenizer, texts[r.doc_id])
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(len(plain_ids(tokenizer, t)) for t in texts.values())

"""Sub-word encoding against the reference encoder without dropout, and exact round trips with it."""

import itertools
import os
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the tokenizer files are absent")
TEXTS = [
    None, "", " ", "  lead", "trail  ", "a\nb\tc", "Hello  world", "▁x ▁▁ y", "é 日本 ﬁ ① 😀", "\x00 <s> </s> <0x0A> <unk>",
    "x" * 30_000, "word " * 20_000, "    " * 500, "the theory of the thing",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60), key=st.integers(0, 99))
def test_round_trip(vocabulary, encoders, text, key):
    for rate in (0.0, 0.3, 1.0):
        assert pieces.decode(vocabulary, encoders[rate].encode(text, key)) == text


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("the aonirs\n.,é日😀"), max_size=80))
def test_no_dropout_is_the_usual_encoding(encoders, text):
    import sentencepiece

    usual = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert encoders[0.0].encode(text).tolist() == usual


def test_documents(spark):
    rows = [(i, t, "clash", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "", 1), (13, TEXTS[13], "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = pieces.encoded(docs, dropout=0.2)
    texts = {(r.doc_id, r.text) for r in pieces.decoded(got).collect()}
    assert texts == {(d, t) for d, t, *_ in rows}
    rows_out = got.collect()
    assert len(rows_out) == len(rows) and all(r.lossless for r in rows_out if r.ids is not None)
    assert [r.ids for r in rows_out if r.doc_id == 0] == [None] and [r.ids for r in rows_out if r.doc_id == 1] == [[]]
    assert len({tuple(r.ids) for r in rows_out if r.doc_id == 13}) == 1
    again = {(r.doc_id, tuple(r.ids or ())) for r in pieces.encoded(docs.repartition(3), dropout=0.2).collect()}
    assert again == {(r.doc_id, tuple(r.ids or ())) for r in rows_out}
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_dropout_varies(vocabulary):
    plain = pieces.Encoder(vocabulary, 0.0).encode("the theory of the thing " * 40).tolist()
    dropped = [pieces.Encoder(vocabulary, 0.2, seed).encode("the theory of the thing " * 40).tolist() for seed in range(3)]
    assert all(len(d) > len(plain) for d in dropped) and len({tuple(d) for d in dropped}) == 3


def test_corpus_without_dropout(vocabulary):
    import pyarrow.parquet as pq
    import sentencepiece

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    texts = pq.read_table(path).column("text").to_pylist()
    usual = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(vocabulary, 0.0)
    for text in texts:
        assert encoder.encode(text).tolist() == usual.encode(text)


@settings(max_examples=150, deadline=None)
@given(units=st.lists(st.text(alphabet=st.sampled_from("▁the aonirsé日😀q"), min_size=1, max_size=70), min_size=1, max_size=12), rate=st.sampled_from([0.0, 0.25, 1.0]))
def test_many_units_are_merged_as_one_by_one(encoders, units, rate):
    encoder = encoders[rate]
    keys = pieces.unit_keys(np.full(len(units), 7), np.arange(len(units)))
    assert encoder.merged_by(units, keys) == [encoder.merged(u, int(k)) for u, k in zip(units, keys, strict=True)]
    assert [ids for ids, _ in encoder.merged_many(units)] == [encoder.merged(u, dropout=False) for u in units]


def plainly_encoded(vocabulary, text, salt, limit):
    """A second implementation: every unit by looking at all its pairs again for each merge, keyed by document and place."""
    out, place = [], 0
    stretches = (" " + text).split(pieces.MARK) if text else []
    for k, stretch in enumerate(stretches):
        out += [vocabulary.byte_ids[b] for b in pieces.MARK.encode()] if k else []
        for n, line in enumerate(stretch.split("\n")):
            out += [vocabulary.byte_ids[10]] if n else []
            for unit in re.findall("^[^ ]+| +[^ ]*", line):
                z = (salt + place * pieces.SPREAD) & pieces.MASK
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & pieces.MASK
                z = (z ^ z >> 27) * 0x94D049BB133111EB & pieces.MASK
                key, place = z ^ z >> 31, place + 1
                parts, skipped = list(unit.replace(" ", pieces.MARK)), set()
                while True:
                    at = list(itertools.accumulate(map(len, parts), initial=0))
                    pairs = [(vocabulary.ranks[a + b], at[i], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in vocabulary.ranks and (at[i], len(a), len(b)) not in skipped]
                    if not pairs:
                        break
                    _, left, i = min(pairs)
                    both = parts[i] + parts[i + 1]
                    if limit and (key ^ (left * pieces.SPREAD + len(both)) & pieces.MASK) * pieces.MULTIPLIER & pieces.MASK < limit:
                        skipped.add((left, len(parts[i]), len(parts[i + 1])))
                    else:
                        parts[i : i + 2] = [both]
                for part in parts:
                    out += [vocabulary.ids[part]] if part in vocabulary.ids else [vocabulary.byte_ids[b] for b in part.encode()]
    return out


def test_a_second_implementation_gives_the_same_ids(vocabulary):
    rng = random.Random(8)
    texts = [t for t in TEXTS if t is not None and len(t) < 1000] + ["y" * 90, "a" * 70 + " b  c\n▁"]
    texts += [" ".join("".join(rng.choices("theanoirsdlu", k=rng.randint(1, 12))) for _ in range(60)) for _ in range(20)]
    for rate in (0.1, 0.5):
        encoder = pieces.Encoder(vocabulary, rate)
        got = encoder.encode_all(texts, list(range(len(texts))))
        for salt, (text, ids) in enumerate(zip(texts, got, strict=True)):
            assert ids.tolist() == plainly_encoded(vocabulary, text, salt, int(rate * 2**64)), text
            assert pieces.decode(vocabulary, ids) == text


def test_words_vary_as_often_as_they_occur(vocabulary):
    """No word is left out, the share of skipped candidates is the one asked for, and more places give more segmentations."""
    words = ["the", "theory", "interesting", "of", "as", "documents", "on"]
    encoder = pieces.Encoder(vocabulary, 0.1)
    salts = [xxhash.xxh64_intdigest(str(d), 1) for d in range(1000)]
    plain = {w: pieces.Encoder(vocabulary, 0.0).encode(w).tolist() for w in words}
    for w in words:
        counts = []
        for places in (1, 10, 100):
            seen = set()
            for ids in encoder.encode_all([" ".join([w] * places)] * 100, salts[:100]):
                pieces_of = [[]]
                for i in ids.tolist():
                    if vocabulary.surface[i].startswith(b" ") and pieces_of[-1]:
                        pieces_of.append([])
                    pieces_of[-1].append(i)
                seen |= {tuple(p) for p in pieces_of}
            counts.append(len(seen))
        assert counts[0] <= counts[1] <= counts[2] and counts[2] > 1, (w, counts)
    assert any(len(plain[w]) == 1 for w in words)
    # One candidate, "o" + "n" behind the mark, stands for all: its rate over many places.
    name = "on"
    hashed = np.frombuffer(encoder.cache[name][1], np.uint64)
    assert len(hashed)
    keys = np.concatenate([pieces.unit_keys(np.full(1000, s, np.uint64), np.arange(1000)) for s in salts])
    for place in hashed:
        share = ((keys ^ place) * np.uint64(pieces.MULTIPLIER) < np.uint64(encoder.limit)).mean()
        assert abs(share - 0.1) < 0.001


@pytest.fixture(scope="module")
def encoders(vocabulary):
    return {rate: pieces.Encoder(vocabulary, rate, 9) for rate in (0.0, 0.25, 1.0, 0.3)}

"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so token labels are derived from them: a word or stem is a marker if it occurs in labelled toxic
documents far more often than chance allows, counted over different contexts (copies of one passage count once). Markers
in toxic documents are tagged toxic, all other tokens clean. The field has two states; emissions are sums of hashed word, prefix and
suffix weights, transitions are free, and a sentence is a chain. Forward-backward runs on odds, over all sentences of a
slice at once. A document's score is a logistic function of its largest marginal and its expected number of toxic tokens,
fitted on the same documents.

Fitting takes a bounded sample: at most ``sample`` labelled documents of each class, drawn by a hash of doc_id, of those
outside the held-out fold. Scoring reads every text whole. A null or empty text has no tokens and gets the score of a
text without toxic tokens; repeated rows score alike; an empty table gives an empty result; without labels of both
classes every score is 0. Labels, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import slices, whole_text

SAMPLE = 1500
FOLDS = 5
SPACE_BITS = 18
STEMS = (4, 5, 6)
TOKEN = re.compile(r"\w+|[.!?\n]+")
BREAKS = ".!?\n"
CACHE = 500_000
FLOOR = 1e-9
#: Odd constants that mix the three words of a context.
C1, C2, C3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold 0 of the checksum of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def features(word: str) -> list[int]:
    """Hashed features of a token: one shared by all, the word, its beginnings and its end."""
    low = word.lower()
    named = ["w" + low, "s" + low[-3:], *(f"{k}{low[:k]}" for k in (3, *STEMS))]
    return [0] + [zlib.crc32(f.encode()) % ((1 << SPACE_BITS) - 1) + 1 for f in named]


def _walk(gain: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 at every token.

    ``gain`` is exp(emission) of all chains one after another, ``sizes`` their lengths. Chains are walked side by side,
    longest first, so each step handles only those that still have a token.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    a = np.exp(trans)
    forward, backward = np.empty_like(gain), np.ones_like(gain)
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than each step
    for t in range(steps):
        at = starts[: alive[t]] + t
        if t == 0:
            forward[at] = gain[at]
        else:
            r = forward[at - 1]
            forward[at] = np.clip(gain[at] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), 1e-30, 1e30)
    for t in range(steps - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        ahead = gain[at + 1] * backward[at + 1]
        backward[at] = np.clip((a[1, 0] + a[1, 1] * ahead) / (a[0, 0] + a[0, 1] * ahead), 1e-30, 1e30)
    return forward, backward


def marginals(emission: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of state 1 at every token."""
    forward, backward = _walk(np.exp(np.clip(emission, -30, 30)), sizes, trans)
    odds = forward * backward
    return odds / (1 + odds)


def _expectations(emission: np.ndarray, sizes: np.ndarray, trans: np.ndarray):
    """Marginals, expected counts of the four transitions, and the tokens that start a pair."""
    gain = np.exp(np.clip(emission, -30, 30))
    forward, backward = _walk(gain, sizes, trans)
    odds = forward * backward
    inner = np.ones(len(gain), bool)
    inner[np.cumsum(sizes) - 1] = False  # last tokens start no pair
    i = np.flatnonzero(inner)
    left, ahead = (1 / (1 + forward[i]), forward[i] / (1 + forward[i])), (1.0, gain[i + 1] * backward[i + 1])
    a = np.exp(trans)
    joint = [[left[x] * a[x, y] * ahead[y] for y in (0, 1)] for x in (0, 1)]
    total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
    pairs = np.array([[(joint[x][y] / total).sum() for y in (0, 1)] for x in (0, 1)])
    return odds / (1 + odds), pairs, i


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    document: np.ndarray  # bias and weights of the document score

    def emission(self, word: str) -> float:
        return float(self.weights[features(word)].sum())

    def score(self, top: float, expected: float) -> float:
        z = float(self.document @ _document_features(top, expected))
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def _document_features(top: float, expected: float) -> np.ndarray:
    top = min(max(top, 1e-6), 1 - 1e-6)
    return np.array([1.0, np.log(top / (1 - top)), np.log1p(expected)])


def indexed(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Different lower-case words, then word number by token, tokens by sentence, and text number by sentence."""
    words: dict[str, int] = {}
    ids, sizes, owner = array("i"), array("i"), array("i")
    for k, text in enumerate(texts):
        n = 0
        for token in [*TOKEN.findall(text), BREAKS]:
            if token[0] not in BREAKS:
                ids.append(words.setdefault(token.lower(), len(words)))
                n += 1
            elif n:
                sizes.append(n)
                owner.append(k)
                n = 0
    return list(words), *(np.frombuffer(x, np.int32).astype(np.int64) for x in (ids, sizes, owner))


def _stems(low: str) -> list[str]:
    """What may mark a word: the word itself and its longer prefixes."""
    return ["=" + low] + [low[:k] for k in STEMS if len(low) >= k]


def markers(words: list[str], ids: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> set[str]:
    """Words and stems that tell tokens of toxic documents from those of clean ones, far beyond chance.

    What is counted are different (word before, word, word after), so copies of a passage count once. Chance is the toxic
    share of all that is counted; the bound on its tail, times the number of stems tried, must stay below one in a hundred.
    """
    before, after = np.r_[-1, ids[:-1]], np.r_[ids[1:], -1]
    ends = np.cumsum(sizes)
    before[ends - sizes], after[ends - 1] = -1, -1
    mixed = [x.astype(np.uint64) * np.uint64(m) for x, m in zip((before, ids, after), (C1, C2, C3), strict=True)]
    context = (mixed[0] ^ (mixed[1] >> np.uint64(7)) ^ mixed[1]) * np.uint64(C2) ^ mixed[2] ^ (mixed[2] >> np.uint64(11))
    counts = []
    for of_class in (~toxic, toxic):
        at = np.flatnonzero(of_class)
        once = at[np.unique(context[at], return_index=True)[1]]
        counts.append(np.bincount(ids[once], minlength=len(words)))
    in_clean, in_toxic = Counter(), Counter()
    for word, c, t in zip(words, *(n.tolist() for n in counts), strict=True):
        for stem in _stems(word):
            in_clean[stem] += c
            in_toxic[stem] += t
    n_clean, n_toxic = (max(int(n.sum()), 1) for n in counts)
    base = n_toxic / (n_toxic + n_clean)
    needed = log(100 * max(len(in_toxic), 1))
    out = set()
    for stem, n in in_toxic.items():
        if not n or n / n_toxic < 12 * in_clean[stem] / n_clean:
            continue
        share = n / (n + in_clean[stem])
        if share > base:
            rest = (1 - share) * log((1 - share) / (1 - base)) if share < 1 else 0.0
            if (n + in_clean[stem]) * (share * log(share / base) + rest) > needed:
                out.add(stem)
    return out


def train(texts: list[str], toxic: list[int], steps: int = 50, l2: float = 0.02) -> Model | None:
    """The field and the document score from labelled texts; None unless both classes occur."""
    docs = dict(zip(texts, toxic, strict=True))  # copies count once
    labels = np.array(list(docs.values()), bool)
    if labels.all() or not labels.any():
        return None
    words, ids, sizes, owner = indexed(list(docs))
    of_toxic = np.repeat(labels[owner], sizes)
    marks = markers(words, ids, sizes, of_toxic)
    marked = np.array([any(stem in marks for stem in _stems(w)) for w in words], bool)
    tags = (of_toxic & marked[ids]).astype(np.float64)
    table = np.array([features(w) for w in words], np.int64)
    weights, trans = np.zeros(1 << SPACE_BITS), np.zeros((2, 2))
    weights[0] = -2.0
    slow_w, fast_w, slow_t, fast_t = np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))
    pairs_seen = None
    for step in range(1, steps + 1):
        emission = weights[table].sum(1)[ids]
        p, pairs, inner = _expectations(emission, sizes, trans)
        if pairs_seen is None:
            code = (2 * tags[inner] + tags[inner + 1]).astype(int)
            pairs_seen = np.bincount(code, minlength=4).reshape(2, 2)
        by_word = np.bincount(ids, tags - p, minlength=len(words))
        grad = np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), minlength=len(weights)) - l2 * weights
        grad_t = (pairs_seen - pairs) - l2 * trans
        for value, g, slow, fast in ((weights, grad, slow_w, fast_w), (trans, grad_t, slow_t, fast_t)):
            slow += 0.1 * (g - slow)
            fast += 0.01 * (g * g - fast)
            value += 0.25 * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
    p = marginals(weights[table].sum(1)[ids], sizes, trans)
    return Model(weights.astype(np.float32), trans, _fit_document(p, sizes, owner, labels))


def _fit_document(p: np.ndarray, sizes: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the document's marginals, by Newton steps, both classes weighing the same."""
    n, by_doc = len(labels), np.repeat(owner, sizes)
    top = np.zeros(n)
    np.maximum.at(top, by_doc, p)
    expected = np.bincount(by_doc, np.where(p > FLOOR, p, 0), minlength=n)
    x = np.stack([_document_features(t, e) for t, e in zip(top, expected, strict=True)])
    y = labels.astype(float)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (share * (y - q)) - 1e-2 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """The model of at most ``sample`` labelled documents per class outside the held-out fold.

    The sample is drawn from the labels first, so at most twice ``sample`` ids are sent to where the documents are read.
    """
    usable = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])
    texts = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sorted((r.doc_id, r.text, r.toxic) for r in texts.select("doc_id", "text", "toxic").toLocalIterator())
    return train([t for _, t, _ in rows], [y for *_, y in rows])


class Scorer:
    """Applies a model to slices of texts; emissions of words are kept in a bounded cache."""

    def __init__(self, model: Model | None):
        self.model = model
        self.cache: dict[str, float] = {}

    def _emissions(self, tokens: list[str]) -> list[float]:
        found = list(map(self.cache.get, tokens))
        if None in found:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            for i, e in enumerate(found):
                if e is None:
                    token = tokens[i]
                    e = self.cache.get(token)
                    if e is None:
                        e = self.cache[token] = np.nan if token[0] in BREAKS else self.model.emission(token)
                    found[i] = e
        return found

    def __call__(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Score and offending (start, end, probability) of each text."""
        if self.model is None:
            return [(0.0, [])] * len(texts)
        values, counts = [], []
        for text in texts:
            got = self._emissions(TOKEN.findall(text))
            values.append(np.array(got, np.float64))
            counts.append(len(got))
        emission = np.concatenate(values) if values else np.empty(0)
        edges = np.cumsum(counts)
        # A chain ends at a break token and at the end of its text.
        is_break = np.isnan(emission)
        ends = np.unique(np.concatenate([np.flatnonzero(is_break), edges]))
        words_before = np.concatenate([[0], np.cumsum(~is_break)])
        sizes = np.diff(words_before[np.concatenate([[0], ends])])
        p = np.zeros(len(emission))
        p[~is_break] = marginals(emission[~is_break], sizes[sizes > 0], self.model.trans)
        out, at = [], 0
        for text, n in zip(texts, counts, strict=True):
            own = p[at : at + n]
            at += n
            top = float(own.max()) if n else 0.0
            spans = []
            if top > 0.5:
                for m, q in zip(TOKEN.finditer(text), own.tolist(), strict=True):
                    if q > 0.5:
                        spans.append((m.start(), m.end(), q))
            out.append((self.model.score(top, float(own[own > FLOOR].sum())), spans))
        return out


def scored(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and spans (start, end, p) in code points, one row per row of ``docs``."""
    key_type = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for keys, texts in slices(batch):
                got = scorer([t or "" for t in texts])
                spans = [[{"start": a, "end": b, "p": q} for a, b, q in s] for _, s in got]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([s for s, _ in got], pa.float64()), pa.array(spans, pa.list_(span))],
                    names=["doc_id", "score", "spans"],
                )

    schema = f"doc_id {key_type}, score double, spans array<struct<start: int, end: int, p: double>>"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def clean_rows(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            start = 0
            for _, texts in slices(batch, place, place):
                keep = [s < 0.5 for s, _ in scorer([t or "" for t in texts])]
                yield batch.slice(start, len(texts)).filter(pa.array(keep, pa.bool_()))
                start += len(texts)

    return docs.mapInArrow(run, docs.schema)

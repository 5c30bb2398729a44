"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read as one sequence of tags and stretches of text. Words score by where they stand (nearest block element,
inside a link or not), tags score negatively, and one linear scan finds the contiguous stretch with the largest sum. The
weights are log odds from labelled pages: pages that mark their article with exactly one ``article`` or ``main`` element
say which words and tags are content. The marking element itself is no feature, so pages without one are read the same
way. Elements that never hold article text (menus, forms, asides, adverts, comments and the like, by name or by the words
of their class and id) are skipped inside the stretch too. A form, or an element that only its class or id tells, is a
wrapper and not skipped if it holds the page's one marked article, or every mark and heading and most of the page's words.

Counting weights reads every page; what is counted is bounded by a fixed list of element names. Character references are
decoded, white space within a block becomes one space, blocks are joined by one space; nothing else is dropped or cut. A
null or empty page gives an empty text, repeated rows give equal texts, an empty table an empty result, and columns other
than the id, url and html are ignored. Pages are parsed one at a time, in linear time.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import slices

# Fixed values of the HTML vocabulary.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
KNOWN = set(
    "address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html iframe input legend li link main menu meta nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
) | INLINE
SKIPPED = set("nav aside footer form button select option menu dialog head fieldset object audio video canvas".split()) | RAW
#: Words of a class or id that name what is not the article.
NOT_ARTICLE = set(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget footer masthead topbar toolbar cookie cookies consent notice notices alert popup modal "
    "overlay comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe "
    "subscription signup login search pagination pager copyright hidden".split()
)
#: Forms of a class or id that say what a page has or lacks, not what the element is.
STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:open|closed)")
#: Elements that are skipped unless they wrap the article.
WRAPPING = {"form", "fieldset"}
MARKED = ("article", "main")
CLOSED_BY_OPENING = {"p": set("p div ul ol dl table section article aside header footer nav form blockquote pre h1 h2 h3 h4 h5 h6".split()), "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?A-Za-z][^<>]*(?:>|\Z)|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = {"class", "id", "role"}
WORDS = re.compile(r"[a-z]+")
LIMIT, TAG_LIMIT = 3.0, 1.0
#: Weight of words, per element, where no page was counted, and the most that one skipped element can count against a stretch.
UNSEEN_WORD, UNSEEN_LINK, SKIP_COST = 1.0, -0.5, 6.0


class Page:
    """The sequence of a page: items (feature, words, text or None, block, skipped, marked)."""

    def __init__(self, source: str):
        self.items: list[tuple[str, int, str | None, int, bool, bool]] = []
        self.marks = 0
        self._named: list[tuple[int, int]] = []  # first and last item, exclusive, of elements that are skipped unless they wrap the article
        self._read(source)
        if self._named:
            self._skip_named()

    def _read(self, source: str) -> None:
        items = self.items
        stack: list[tuple[str, str, bool, bool, bool]] = []  # name, block element, in a link, skipped, marked
        named: list[tuple[int, int]] = []  # depth of the stack and first item of open elements for _named
        open_names: Counter = Counter()
        block, at, end = 0, 0, len(source)
        now = ("", "body", False, False, False)
        match = PIECE.match
        while at < end:
            m = match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    if now[0] in RAW:
                        continue
                    text = entities.unescape(text) if "&" in text else text
                    words = len(text.split())
                    items.append((f"{now[1]}{'+a' if now[2] else ''}", words, text, block, now[3], now[4]))
                continue
            name = name.lower()
            tag = name if name in KNOWN or name in SKIPPED else "other"
            if name not in INLINE:
                block += 1
            if m[1]:
                if open_names[name]:
                    while stack:
                        gone = stack.pop()[0]
                        open_names[gone] -= 1
                        if gone == name:
                            break
                    while named and named[-1][0] > len(stack):
                        self._named.append((named.pop()[1], len(items)))
                    now = stack[-1] if stack else ("", "body", False, False, False)
                items.append(("<" + tag, 0, None, block, now[3], now[4]))
                continue
            while stack and name in CLOSED_BY_OPENING.get(stack[-1][0], ()):
                open_names[stack.pop()[0]] -= 1
                now = stack[-1] if stack else ("", "body", False, False, False)
            while named and named[-1][0] > len(stack):
                self._named.append((named.pop()[1], len(items)))
            items.append(("<" + tag, 0, None, block, now[3], now[4]))
            if name in VOID or m[3].endswith("/") and name not in INLINE and name not in KNOWN:
                continue
            mark = name in MARKED
            self.marks += mark and not now[4]
            skipped = now[3] or self._is_skipped(name, now[4])
            inside = name if name not in INLINE else now[1]
            now = (name, inside if inside not in MARKED else "body", now[2] or name == "a", skipped, now[4] or mark)
            stack.append(now)
            open_names[name] += 1
            if not skipped and (name in WRAPPING or self._is_named(name, m[3])):
                named.append((len(stack), len(items)))
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
                at = close.start() if close else end

        self._named += [(first, len(items)) for _, first in named]

    @staticmethod
    def _is_skipped(name: str, marked: bool) -> bool:
        return not marked if name == "header" else name in SKIPPED and name not in WRAPPING

    @staticmethod
    def _is_named(name: str, attributes: str) -> bool:
        if not attributes or name in ("body", "html", *MARKED):
            return False
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() in NAMING:
                for token in (m[2] or m[3] or m[4] or "").lower().split():
                    if NOT_ARTICLE.intersection(WORDS.findall(token)) and not STATE.fullmatch(token):
                        return True
        return False

    def _skip_named(self) -> None:
        """Skips the named elements that do not wrap the article."""
        sums = [(0, 0, 0)]  # words, marks and headings so far, outside skipped elements
        inside = False
        for feature, words, text, _, skipped, marked in self.items:
            w, marks, heads = sums[-1]
            if not skipped:
                w, marks, heads = w + (words if text is not None else 0), marks + (marked and not inside), heads + (feature == "<h1")
            inside = marked
            sums.append((w, marks, heads))
        total = sums[-1]
        cover = [0] * (len(self.items) + 1)
        for first, last in self._named:
            words, marks, heads = (b - a for a, b in zip(sums[first], sums[last], strict=True))
            if marks == total[1] and (marks == 1 or heads == total[2] and 2 * words > total[0]):
                continue
            cover[first] += 1
            cover[last] -= 1
        depth = 0
        for i, item in enumerate(self.items):
            depth += cover[i]
            if depth and not item[4]:
                self.items[i] = (*item[:4], True, item[5])


def counts_of(source: str) -> Counter:
    """(feature, inside) to words or tags of one page; nothing unless it marks exactly one article."""
    page = Page(source)
    out: Counter = Counter()
    if page.marks == 1:
        for feature, words, _, _, skipped, marked in page.items:
            # What stands in a skipped element is a feature of its own: it says nothing about the same element elsewhere.
            out[feature + "!" * skipped, marked and not skipped] += words if feature[0] != "<" else 1
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each feature, within plus and minus LIMIT; tags stay between -TAG_LIMIT and -0.1."""
    kinds = [{k: v for k, v in counts.items() if (k[0][0] == "<") == tag} for tag in (False, True)]
    out = {}
    for tag, kind in zip((False, True), kinds, strict=True):
        inside = sum(v for (_, m), v in kind.items() if m)
        outside = sum(v for (_, m), v in kind.items() if not m)
        for feature in {f for f, _ in kind}:
            rate_in = (kind.get((feature, True), 0) + 1) / (inside + 2)
            rate_out = (kind.get((feature, False), 0) + 1) / (outside + 2)
            score = max(-LIMIT, min(LIMIT, log(rate_in / rate_out)))
            out[feature] = max(min(score, -0.1), -TAG_LIMIT) if tag else score
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the largest positive sum, the first of equals; (0, 0) if none."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(source: str | None, weights: dict[str, float]) -> str:
    if not source:
        return ""
    items = Page(source).items
    scores = []
    budget = 0.0
    before = False
    for feature, words, text, _, skipped, _ in items:
        if skipped:
            # One run of skipped items counts against a stretch with a bounded cost, so an aside does not cut an article in two.
            if not before:
                budget = SKIP_COST
            weight = min(weights.get(feature + "!", -0.1 if text is None else -LIMIT), 0.0)
            cost = min(budget, -weight * (1 if text is None else words))
            budget -= cost
            scores.append(-cost)
        elif text is None:
            scores.append(weights.get(feature, -0.1))
        else:
            unseen = UNSEEN_LINK if feature.endswith("+a") and not feature.startswith("p+") else UNSEEN_WORD
            scores.append(words * weights.get(feature, unseen))
        before = skipped
    start, end = best_stretch(scores)
    blocks: list[list[str]] = []
    last = None
    for _, _, text, block, skipped, _ in items[start:end]:
        if text is not None and not skipped:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def fit(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Weights from all labelled pages. Each task sums its own counts; two rows per feature and task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for _, sources in slices(batch, 0, 0):
                for source in sources:
                    if source:
                        total.update(counts_of(source))
        rows = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in rows], pa.string()), pa.array([m for _, m in rows], pa.bool_()), pa.array([total[r] for r in rows], pa.int64())],
            names=["feature", "inside", "n"],
        )

    counted = pages.select(html).mapInArrow(run, "feature string, inside boolean, n bigint")
    summed = counted.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()  # bounded by the element names
    return weights_of({(r.feature, r.inside): r.n for r in summed})


def extracted(
    pages: DataFrame, weights: dict[str, float] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``; ``weights`` are counted from the same pages by default."""
    known = fit(pages, html) if weights is None else weights
    types = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, sources in slices(batch, 0, 2):
                texts = [main_text(s, known) for s in sources]
                yield pa.RecordBatch.from_arrays(
                    [keys, batch.column(1).slice(at, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )
                at += len(texts)

    return pages.select(page_id, url, html).mapInArrow(
        run, f"page_id {types[page_id]}, url {types[url]}, text string, n_chars bigint"
    )

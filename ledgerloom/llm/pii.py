"""Personal data: base rules, plus candidates that gradient-boosted trees accept.

Two generators per kind propose spans. The base one is strict and final: its valid matches are always redacted. The wide
one also proposes what the base rule's greedy match swallows or misses (a phone number followed by an address, two card
numbers side by side, "name (at) host (dot) org"). A candidate must pass its kind's checks (check digit, octets, digits) to
count at all. It gets format features (digits, separators, clean edges; a phone's without its country code) and a context
feature (a telling word shortly before). What labels it is none of these: a base rule that finds the same span speaks for
it; a word that says otherwise speaks against it (an order or version number, "us at example.com"). Trees learn to tell
the two apart on counts of distinct feature vectors over all documents; the count table is bounded by the ranges of the
features. A wide candidate that nothing speaks against is redacted too if its score reaches its kind's threshold, which
keeps the precision on held-out documents, and if it overlaps no base span of its kind. A kind with labels only against it
adds no spans; one without any labels has the threshold of all kinds together.

A null text counts as empty, repeated rows are judged alike, an empty table gives an empty result, columns other than
doc_id and text are ignored. Texts are scanned whole; nothing is shuffled but feature counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import boosting
from ledgerloom.llm.shared import Scratch, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Base rules. They find what the plain patterns find: possessive quantifiers and look-behinds only spare retries, and the
#: matcher's stack on very long matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?[\[(] ?(?:at|AT) ?[\])] ?| (?:at|AT) )[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?| (?:dot|DOT) )[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a kind's patterns to be worth a scan; every match of both patterns holds it.
HINT = {
    "email": r"@|(?:at|AT)[\]) ]",
    "ip": r"[0-9]+\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]",
    "card": r"[0-9](?:[ -]?[0-9]){14}",
    "phone": r"[0-9][ .-][0-9]{3}|\+[0-9]",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write to|courriel|correo|@)\W*\S*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr)\W*\S*$",
    "card": r"(?i)(?:card|visa|credit|account|konto|carte|tarjeta)\W*\S*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|handy|mobil)\W*\S*$",
}
#: Words before a candidate that name another thing of the same form.
OTHERWISE = {
    "ip": r"(?i)(?:\b(?:version|release|firmware|build|section|chapter|clause|v)|§)[ .:]*$",
    "card": r"(?i)(?:\b(?:order|serial|invoice|isbn|issn|ean|imei|part|item|ticket|tracking|reference|ref|version)(?: (?:no|number|id))?|#)[ .:]*$",
    "phone": r"(?i)(?:\b(?:order|serial|invoice|isbn|issn|ean|part|item|ticket|tracking|reference|ref|version)(?: (?:no|number|id))?|#|[$€£])[ .:]*$",
}
#: An address spelled with a bare "at" before a plain host name, after a word that ends a phrase of prose.
PROSE = (
    r"(?i)^(?:us|me|him|her|it|them|you|we|here|there|now|live|online|available|more|look|looks|looked|looking|found|find|is|are|was|"
    r"were|be|been|visit|website|site|page|pages|blog|read|see|seen|out|up|back|only|free|order|buy|store|shop|located) at [A-Za-z0-9-]+\."
)
REACH = 24
#: Feature ranges, for the record: kind 0-3, digits 0-20, separators 0-4, edges 0-2, context 0-1.
FEATURES = ("kind", "digits", "seps", "edges", "context")
PRECISION = 0.98


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def worth(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _small_octet(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)


def _valid(kind: str, found: Column) -> Column:
    """The checks that a kind's matches must pass."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.contains(":") | F.forall(F.split(found, r"\."), _small_octet)
    if kind == "card":
        return F.length(digits).between(15, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _starts(found: Column, between: Column) -> Column:
    """Start of each match, from the lengths of the matches and of the pieces between them."""
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(m).alias("m"), F.length(b).alias("b")))
    empty = F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("at"))
    return F.aggregate(
        steps,
        empty,
        lambda a, x: F.struct(F.array_append(a["s"], a["at"] + x["b"]).alias("s"), (a["at"] + x["b"] + x["m"]).alias("at")),
        lambda a: a["s"],
    )


def _matches(docs: DataFrame, patterns: dict[str, str], tag: str) -> DataFrame:
    """Adds ``{tag}_{kind}``: array of (start, end, found) of each pattern, in code points."""
    none = F.array().cast("array<string>")
    for kind, pattern in patterns.items():
        worth = F.col(f"hint_{kind}")
        docs = docs.withColumns(
            {
                "_found": F.when(worth, F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).otherwise(none),
                "_between": F.when(worth, F.split("body", pattern, -1)).otherwise(none),
            }
        )
        docs = docs.withColumn("_starts", _starts(F.col("_found"), F.col("_between")))
        spans = F.zip_with(
            "_starts", "_found", lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found"))
        )
        docs = docs.withColumn(f"{tag}_{kind}", spans).drop("_found", "_between", "_starts")
    return docs


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fold, ``base`` (kind, start, end) and ``wide`` (kind, start, end, features, label) of each row.

    label, of those that pass the checks: 0 a word speaks against it, else 1 a base rule found the same span, null neither.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("body"))
    body = body.withColumns({f"hint_{k}": F.col("body").rlike(p) for k, p in HINT.items()})
    found = _matches(_matches(body, BASE, "base"), WIDE, "wide")
    base, wide = [], []
    for number, kind in enumerate(KINDS):
        base.append(_kept(kind))
        wide.append(_described(kind, number))
    checked = found.withColumns({f"base_{k}": b for k, b in zip(KINDS, base, strict=True)})
    return checked.select(
        "doc_id",
        F.pmod(F.xxhash64("body"), F.lit(5)).cast("int").alias("fold"),
        F.concat(*[_tagged(f"base_{k}", k) for k in KINDS]).alias("base"),
        F.concat(*wide).alias("wide"),
    )


def _kept(kind: str) -> Column:
    return F.filter(f"base_{kind}", lambda x: _valid(kind, x["found"]))


def _tagged(column: str, kind: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _described(kind: str, number: int) -> Column:
    base = F.transform(f"base_{kind}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    def describe(x: Column) -> Column:
        found, start, end = x["found"], x["start"], x["end"]
        before = F.substring("body", F.greatest(start - REACH + 1, F.lit(1)), F.least(start, F.lit(REACH)))
        after = F.substring("body", end + 1, F.lit(1))
        valid = _valid(kind, found)
        edges = (~before.rlike(r"[\p{L}\p{Nd}]$")).cast("int") + (~after.rlike(r"^[\p{L}\p{Nd}]")).cast("int")
        against = found.rlike(PROSE) if kind == "email" else before.rlike(OTHERWISE[kind])
        same = F.array_contains(base, F.struct(start.alias("start"), end.alias("end")))
        label = F.when(~valid, None).when(against, 0).when(same, 1)
        # The country code is what base rules know a phone by, so it is no feature.
        form = F.regexp_replace(found, r"^\+[0-9]{1,3}[ .-]?", "") if kind == "phone" else found
        return F.struct(
            F.lit(kind).alias("name"),
            start.alias("start"),
            end.alias("end"),
            F.lit(number).alias("kind"),
            F.least(F.length(F.regexp_replace(form, "[^0-9]", "")), F.lit(20)).alias("digits"),
            valid.cast("int").alias("valid"),
            F.least(F.regexp_count(form, F.lit(r"[ ().-]")), F.lit(4)).alias("seps"),
            edges.alias("edges"),
            before.rlike(CONTEXT[kind]).cast("int").alias("context"),
            label.cast("int").alias("label"),
        )

    return F.transform(f"wide_{kind}", describe)


def feature_counts(spans: DataFrame) -> DataFrame:
    """Positive and negative candidates by fold and distinct feature vector."""
    rows = spans.select("fold", F.explode("wide").alias("c")).where("c.label IS NOT NULL")
    return rows.groupBy(F.expr("fold = 0").alias("held_out"), *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(
        F.sum("c.label").alias("pos"), F.sum(1 - F.col("c.label")).alias("neg")
    )


def fit(spans: DataFrame, precision: float = PRECISION) -> tuple[tuple[float, list], dict[str, float]]:
    """Trees, and score threshold of each kind. The counts that reach the driver are bounded by the feature ranges (2,520 rows)."""
    rows = feature_counts(spans).collect()
    split: dict[bool, list] = {True: [], False: []}
    for r in sorted(rows, key=lambda r: tuple(r)):
        split[r.held_out].append((tuple(r[f] for f in FEATURES), float(r.pos), float(r.neg)))
    model = boosting.fit(split[False])
    least = {}
    for number, kind in enumerate(KINDS):
        held, fitted = ([r for r in split[side] if r[0][0] == number] for side in (True, False))
        judged = held if any(p for _, p, _ in held) else held + fitted
        least[kind] = boosting.threshold(model, judged or split[True] or split[False], precision)
    return model, least


def redactions(docs: DataFrame, precision: float = PRECISION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (kind, start, end), ordered by kind as listed and start."""
    scratch = Scratch(docs.sparkSession, "pii")
    spans = scratch.write(candidates(docs, doc_id, text))
    model, least = fit(spans, precision)
    floors = F.array(*[F.lit(least[k]) for k in KINDS])
    accepted = lambda c: boosting.as_column(model, [c[f] for f in FEATURES]) >= F.get(floors, c["kind"]) - 1e-9
    clear = lambda c: ~F.exists(
        "base", lambda b: (b["kind"] == c["name"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])
    )
    open_ = lambda c: (c["valid"] == 1) & (F.coalesce(c["label"], F.lit(1)) == 1)
    added = F.filter("wide", lambda c: open_(c) & clear(c) & accepted(c))
    extra = F.transform(added, lambda c: F.struct(c["name"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    both = spans.select("doc_id", "base", F.concat("base", extra).alias("all"))
    return both.select("doc_id", "base", _ordered().alias("spans"))


def _ordered() -> Column:
    def of(kind: str) -> Column:
        return F.sort_array(F.filter("all", lambda x: x["kind"] == kind))

    return F.concat(*[of(k) for k in KINDS])


def digest(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    ends = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    done = F.aggregate(
        by_start,
        ends,
        lambda a, x: F.when(
            x["start"] >= a["at"],
            F.struct(
                F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"),
                x["end"].alias("at"),
            ),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))

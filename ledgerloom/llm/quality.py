"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document into a ledger row: the measurements and one integer whose bit k says that rule
k failed. Policies are versioned sets of rules; applying one is a bitwise AND, and ablations (what each rule alone costs,
what dropping it would bring back) are sums over the distinct masks, never a second look at the texts.

All measurements stay in the document's own row: no shuffle, any length of text. A null text has no words, an empty table
gives an empty ledger, repeated rows get equal ledger rows, and columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import SPACE, whole_text

WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more, first occurrences included."""
    last = F.size(words) - WINDOW
    gram = F.transform(
        F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(WINDOW)])
    )

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.arrays_zip(grams.alias("g"), F.sequence(F.lit(0), F.size(grams) - 1).alias("p")))
        repeats = _let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)),
            ),
        )
        places = F.sort_array(F.transform(repeats, lambda x: x["p"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    counted = _let(gram, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(last >= 1, counted).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_alpha."""
    body = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("body"))
    words = F.array_remove(F.split("body", SPACE), "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = body.select("doc_id", "body", words.alias("words"), lines.alias("lines"))
    joined = F.array_join("words", "")
    return cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("body", F.lit(r"\p{L}+")).cast("long").alias("n_letter_runs"),
    )


def _share(top: str, bottom: str, limit: float) -> Column:
    return F.col(top) > limit * F.col(bottom)


def rules() -> list[tuple[str, Column]]:
    """Name and failure condition of each rule in bit order. New rules are appended; a bit keeps its meaning for good."""
    return [
        ("few_words", F.col("n_words") < 10),
        ("repeated_words", 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        ("symbols", _share("n_symbols", "n_words", 0.1)),
        ("duplicate_lines", (F.col("n_dup_lines") > 3) & _share("n_dup_lines", "n_lines", 0.5)),
        ("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        ("long_words", F.col("word_chars") > 25 * F.col("n_words")),
        ("no_letters", F.col("n_letter_runs") < 0.5 * F.col("n_words")),
    ]


#: Policy versions: the rules each one applies.
POLICIES = {
    "2024-01-base": ("few_words", "repeated_words"),
    "2024-06": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "no_letters"),
}
BASE, CURRENT = "2024-01-base", "2024-06"


def mask_of(policy: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``failures``, the bitmask of failed rules, one row per row of ``docs``."""
    bits = None
    for k, (_, failed) in enumerate(rules()):
        bit = F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, doc_id, text).withColumn("failures", bits)


def failed_under(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask_of(policy))) != 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, those only it fails (kept again if it were dropped), and words of these.

    The ledger is first reduced to one row per distinct mask, at most two to the number of rules.
    """
    mask = mask_of(policy)
    masks = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("m")).agg(
        F.count("*").alias("docs"), F.sum("n_words").alias("words")
    )
    total = masks.groupBy().agg(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.sum(F.when(F.col("m").bitwiseAND(F.lit(1 << k)) != 0, F.col("docs")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(F.col("m") == (1 << k), F.col("docs")).otherwise(0)).alias("n_only"),
                F.sum(F.when(F.col("m") == (1 << k), F.col("words")).otherwise(0)).alias("words_only"),
            ).alias(name)
            for k, (name, _) in enumerate(rules())
            if mask >> k & 1
        ]
    )
    names = [name for k, (name, _) in enumerate(rules()) if mask >> k & 1]
    return total.select(F.explode(F.array(*names)).alias("r")).select("r.*")


def verdicts(docs: DataFrame, policy: str = CURRENT, base: str = BASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``; a document that fails the base policy is never kept."""
    book = ledger(docs, doc_id, text)
    return book.withColumn("base_failed", failed_under(base)).withColumn("kept", ~(failed_under(base) | failed_under(policy)))

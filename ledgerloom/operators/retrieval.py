"""Batch question answering preparation: floors, access gate, token budgets, citations and notices.

Hits: (question_id, collection, chunk_id, score, rn). A refused question is a row with a status, never an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.functions import text as X
from ledgerloom.operators.vectors import top_k

HEADER_TOKENS = 30
FOLLOWUP_TURNS = 2
FOLLOWUP_TOKENS = 25
HISTORY_MESSAGES = 30


# ------------------------------------------------------------------ conversations

def prior_user_turns(messages: DataFrame, width: int = 100_000) -> DataFrame:
    """User messages with the up to two user turns before them, nearest first.

    A conversation is cut into stretches of ``width`` turns so that a giant one is spread over tasks; each
    stretch takes over the last two user turns of the stretches before it.
    """
    users = messages.where("role = 'user' AND content <> ''").withColumn("block", F.expr(f"turn div {width}"))
    turn = F.struct("turn", "content")
    inner = Window.partitionBy("conversation_id", "block").orderBy("turn")
    latest = Window.partitionBy("conversation_id", "block").orderBy(F.desc("turn"))
    tails = (
        users.withColumn("r", F.row_number().over(latest))
        .where("r <= 2")
        .groupBy("conversation_id", "block")
        .agg(F.expr("sort_array(collect_list(struct(turn, content)), false) AS tail"))
    )
    blocks = Window.partitionBy("conversation_id").orderBy("block")
    carried = tails.select(
        "conversation_id", "block",
        F.lag("tail", 1).over(blocks).alias("t1"), F.lag("tail", 2).over(blocks).alias("t2"),
    ).selectExpr(
        "conversation_id", "block", "slice(concat(coalesce(t1, array()), coalesce(t2, array())), 1, 2) AS carried"
    )
    local = users.withColumn("p1", F.lag(turn, 1).over(inner)).withColumn("p2", F.lag(turn, 2).over(inner))
    return local.join(carried, ["conversation_id", "block"], "left").select(
        "conversation_id", "turn", "content",
        F.expr("slice(concat(filter(array(p1, p2), p -> p IS NOT NULL), coalesce(carried, array())), 1, 2) AS prior"),
    )


def followup_query(messages: DataFrame) -> DataFrame:
    """The text to embed for each user message: short follow-ups carry the last two user turns with them."""
    earlier = f"transform(reverse(prior), p -> {X.strip('''regexp_replace(p.content, '(?U)\\\\[[0-9]+\\\\]', '')''')})"
    short = f"{X.token_estimate('content')} <= {FOLLOWUP_TOKENS} AND size(prior) > 0"
    return prior_user_turns(messages).selectExpr(
        "conversation_id", "turn", f"if({short}, concat(array_join({earlier}, '\\n'), '\\n', content), content) AS query"
    )


def history_window(messages: DataFrame, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """The last ``limit`` messages of each conversation from its first user message on."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    recent = messages.where("content <> ''").withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    first = recent.where("role = 'user'").groupBy("conversation_id").agg(F.min("turn").alias("first_user"))
    return recent.join(first, "conversation_id").where("turn >= first_user").select("conversation_id", "turn", "role", "content")


def conversation_titles(messages: DataFrame) -> DataFrame:
    """Each conversation titled by its first user message."""
    title = f"left(replace({X.strip('content')}, '\\n', ' '), 60)"
    return messages.groupBy("conversation_id").agg(
        F.expr(f"coalesce(min_by({title}, turn) FILTER (WHERE role = 'user' AND {title} <> ''), 'New conversation') AS title"),
        F.max("turn").alias("last_turn"),
    )


def prompt_history(messages: DataFrame) -> DataFrame:
    """Role-tagged lines of earlier turns, kept one row per turn and in order by ``turn``."""
    body = X.strip("content")
    return messages.where(f"{body} <> ''").selectExpr(
        "conversation_id", "turn", f"concat(if(role = 'user', 'User: ', 'Assistant: '), {body}) AS line"
    )


# ------------------------------------------------------------------ floors and gate

def soft_floor(hits: DataFrame, floor: float, soft: float) -> DataFrame:
    """Hits at the hard floor; where a question has none at all, its hits at the soft floor, flagged.

    ``hits`` are scored once at the soft floor, which holds every hit of the hard floor; they number at most k
    per question and collection.
    """
    best = F.max("score").over(Window.partitionBy("question_id"))
    kept = hits.where(F.col("score") >= min(soft, floor)).withColumn("best", best)
    return kept.where(f"score >= {floor}D OR best < {floor}D").select(
        *hits.columns, F.expr(f"best < {floor}D AS low_confidence")
    )


def gate(hits: DataFrame, levels: DataFrame) -> DataFrame:
    """Access level per question over the collections that returned hits: any 'off' blocks, else the strictest.

    ``levels`` (collection, assist_level). Also names the collections responsible.
    """
    seen = hits.select("question_id", "collection").distinct().join(levels, "collection", "left")
    names = lambda lv: f"array_sort(collect_set(collection) FILTER (WHERE assist_level = '{lv}'))"
    sets = seen.groupBy("question_id").agg(F.expr(f"{names('off')} AS off"), F.expr(f"{names('explain_only')} AS limited"))
    return sets.selectExpr(
        "question_id",
        "CASE WHEN size(off) > 0 THEN 'blocked' WHEN size(limited) > 0 THEN 'explain_only' ELSE 'full' END AS level",
        "if(size(off) > 0, off, limited) AS responsible",
    )


# ------------------------------------------------------------------ budgets

def block_cost(text: str) -> str:
    """Token cost of one excerpt with its header line."""
    return f"{X.token_estimate(text)} + {HEADER_TOKENS}"


def budget_prefix(hits: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """One collection: keep the best hits while their running cost fits; the top hit always stays.

    Costs are positive, so the running total only grows and stopping at the first overflow is a plain filter.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    run = hits.withColumn("pos", F.row_number().over(w)).withColumn(
        "used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return run.where(f"pos = 1 OR used <= {budget}").drop("used")


class RoundRobin:
    """Spends a budget hit by hit, in the order the hits come; a hit that does not fit is skipped, the first always fits.

    With ``stop`` the first hit that does not fit ends it.
    """

    def __init__(self, budget: int):
        self.budget, self.used, self.open, self.kept = budget, 0, True, []

    def offer(self, cost: int, item: dict, stop: bool = False) -> None:
        if self.open and (not self.kept or self.used + cost <= self.budget):
            self.used += cost
            self.kept.append(item)
        elif stop:
            self.open = False


def _folded(hits: DataFrame, keys: list[str], order: list[str], start: Callable, schema: StructType) -> DataFrame:
    """One row for each key: ``start()`` gives an object that takes the key's rows in order and at last gives the row.

    Rows are sorted by Spark and streamed through; a key holds what its object holds, not its rows.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                here = tuple(row[k] for k in keys)
                if held is None or here != key:
                    if held is not None:
                        out.append(dict(zip(keys, key, strict=True)) | held.result())
                    held, key = start(), here
                held.take(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | held.result()], schema=arrow)

    return hits.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class _Spent:
    """How many hits a question was offered and which it keeps."""

    def __init__(self, budget: int):
        self.spending, self.offered = RoundRobin(budget), 0

    def take(self, row: dict) -> None:
        self.offered += 1
        self.spending.offer(row["cost"], {c: row[c] for c in ("collection", "chunk_id", "score")})

    def result(self) -> dict:
        return {"offered": self.offered, "kept": self.spending.kept}


KEPT = "array<struct<collection:string,chunk_id:bigint,score:double>>"


def budget_round_robin(hits: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """All collections: spend the budget round by round, best hit of each first; a hit that does not fit is skipped.

    (keys, offered, kept). The hits of a question are streamed in order, however many collections it has.
    """
    best = Window.partitionBy(*keys, "collection").orderBy(F.desc("score"), "chunk_id")
    ranked = hits.withColumn("depth", F.row_number().over(best)).withColumn("lead", -F.max("score").over(Window.partitionBy(*keys, "collection")))
    schema = StructType([*(hits.schema[k] for k in keys), StructField("offered", IntegerType()), StructField("kept", StructType.fromDDL(f"x {KEPT}")["x"].dataType)])
    stream = ranked.select(*keys, "depth", "lead", "collection", "chunk_id", "score", "cost")
    return _folded(stream, keys, ["depth", "lead", "collection", "chunk_id"], lambda: _Spent(budget), schema)


def citations(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Number the kept hits of each question by score."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return kept.withColumn("n", F.row_number().over(w))


def render_context(cited: DataFrame, keys: list[str]) -> DataFrame:
    """The excerpt block of each question. Rows need n, collection, source_path, locator, text."""
    block = (
        f"concat('[', n, '] (collection: ', collection, ' | source: ', {X.short_source('source_path')}, ' | ', locator, ')\\n', text)"
    )
    return cited.groupBy(*keys).agg(F.expr(f"listagg({block}, '\\n\\n') WITHIN GROUP (ORDER BY n) AS context"))


def notices(prepared: DataFrame) -> DataFrame:
    """What a reader must be told about the scope of each answer."""
    parts = [
        "if(level = 'explain_only' AND size(restricting) > 0, concat('Explain-only: restricted by ', array_join(restricting, ', '),"
        " ' (assist_level = explain_only). Concepts and practice only.'), null)",
        "if(level = 'explain_only' AND size(restricting) = 0, 'Explain-only: concepts and practice only; graded-work help is refused.', null)",
        "if(dropped > 0, concat('Context truncated: dropped ', dropped, ' lowest-scoring chunk(s) to fit the token budget.'), null)",
        "if(size(empty) > 0, concat('Not searched (nothing indexed): ', array_join(empty, ', ')), null)",
        "if(low_confidence, 'Weak match: no source scored above the usual relevance floor, so this answer draws on loosely-related"
        " excerpts and may be incomplete.', null)",
    ]
    return prepared.withColumn("notices", F.expr(f"filter(array({', '.join(parts)}), x -> x IS NOT NULL)"))


def policy_block(hits: DataFrame, floor: float = 0.55, top: int = 2) -> DataFrame:
    """Per collection, the first of its ``top`` hits that states at least two percentages.

    hits (collection, chunk_id, score, locator, text).
    """
    w = Window.partitionBy("collection").orderBy(F.desc("score"), "chunk_id")
    best = hits.withColumn("rn", F.row_number().over(w)).where(f"rn <= {top} AND score >= {floor}D")
    return best.where(f"{X.percent_count('text')} >= 2").groupBy("collection").agg(
        F.expr(f"min_by(concat('[', collection, '] ', locator, '\\n', {X.strip('text')}), rn) AS block")
    )


def _deadline_lines(events: DataFrame, today: str, days: int) -> DataFrame:
    rows = events.where("kind <> 'recurring'").where(
        f"starts_at >= timestamp_ntz'{today} 00:00:00' AND cast(starts_at AS date) <= date_add(date'{today}', {days})"
    )
    stamp = "if(date_format(starts_at, 'HH:mm') = '00:00', date_format(starts_at, 'yyyy-MM-dd'), date_format(starts_at, 'yyyy-MM-dd HH:mm'))"
    return rows.withColumn("line", F.expr(f"concat('- ', {stamp}, '  ', course, ': ', title, if(kind = 'admin', ' [admin]', ''))"))


def _digest(order: str, today: str) -> str:
    return f"concat('(today is {today})\n', listagg(line, '\n') WITHIN GROUP (ORDER BY {order})) AS digest"


def calendar_digest(events: DataFrame, today: str, days: int = 14, limit: int = 60) -> DataFrame:
    """Per course the next deadlines as text lines, the first ``limit`` of them."""
    w = Window.partitionBy("course").orderBy("starts_at", "id")
    first = _deadline_lines(events, today, days).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    return first.groupBy("course").agg(F.expr(_digest("rn", today)))


def calendar_digest_all(events: DataFrame, today: str, days: int = 14, limit: int = 60) -> DataFrame:
    """The next deadlines of all courses in one text, the first ``limit`` of them all."""
    first = _deadline_lines(events, today, days).orderBy("starts_at", "id").limit(limit)
    return first.agg(F.expr(_digest("struct(starts_at, id)", today))).where("digest IS NOT NULL")


# ------------------------------------------------------------------ material beside the excerpts

# Fixed value: the heading of the policy block.
POLICY_HEADING = (
    "THE SYLLABUS GRADING POLICY (authoritative for how the course is weighted; combine with the gradebook above to compute a current"
    " or projected grade):"
)


def question_material(
    questions: DataFrame, calendars: DataFrame, calendar_all: DataFrame, grades: DataFrame, grades_all: DataFrame, policies: DataFrame
) -> DataFrame:
    """(question_id, material): what the wording of a question calls for, whatever the search finds.

    questions (question_id, scope, text); calendars (course, digest) and grades (course, text) by course, calendar_all
    (digest) and grades_all (text) one row each at most; policies (collection, block). A schedule question gets its course's
    deadlines, or all of them where its scope is no course; a grade question gets standings and the stated grading policy.
    Questions without material give no row.
    """
    asked = questions.selectExpr("question_id", "scope", f"{X.asks_schedule('text')} AS s", f"{X.asks_grades('text')} AS g").where("s OR g")
    every_policy = policies.agg(F.expr("listagg(block, '\n\n') WITHIN GROUP (ORDER BY collection) AS b"))
    joined = (
        asked.join(calendars.selectExpr("course AS scope", "digest"), "scope", "left")
        .join(grades.selectExpr("course AS scope", "text AS standing"), "scope", "left")
        .join(policies.selectExpr("collection AS scope", "block AS policy"), "scope", "left")
        .withColumns({"calendar_all": calendar_all.select("digest").scalar(), "grades_all": grades_all.select("text").scalar(), "policy_all": every_policy.scalar()})
    )
    policy = "nullif(if(scope = 'all', policy_all, policy), '')"
    parts = f"if(s, coalesce(digest, calendar_all), null), if(g, if(scope = 'all', grades_all, standing), null), if(g, concat('{POLICY_HEADING}\n\n', {policy}), null)"
    return joined.selectExpr("question_id", f"concat_ws('\n\n', {parts}) AS material").where("material <> ''")


# ------------------------------------------------------------------ the whole preparation

CITED = "array<struct<score:double,chunk_id:bigint,collection:string>>"


class _Prepared:
    """What the hits of a question say: the best score, closed and limited collections, and what its budget keeps."""

    def __init__(self, budget: int):
        self.spending, self.offered, self.best, self.off, self.limited = RoundRobin(budget), 0, None, False, set()

    def take(self, row: dict) -> None:
        self.offered += 1
        self.best = row["best"]
        self.off |= row["level"] == "off"
        if row["level"] == "explain_only":
            self.limited.add(row["collection"])
        self.spending.offer(row["cost"], {c: row[c] for c in ("score", "chunk_id", "collection")}, stop=row["scope"] != "all")

    def result(self) -> dict:
        kept = sorted(self.spending.kept, key=lambda c: (-c["score"], c["chunk_id"], c["collection"]))
        return {"best": self.best, "off": self.off, "limited": sorted(self.limited, key=lambda c: (c is None, c)), "offered": self.offered, "kept": kept}


def prepare_batch(
    questions: DataFrame, vectors: DataFrame, costs: DataFrame, levels: DataFrame,
    k: int = 6, floor: float = 0.6, soft: float = 0.5, budget: int = 8000, material: DataFrame | None = None,
) -> DataFrame:
    """Prepare a table of questions.

    questions (question_id, scope, qvec) with scope 'all' or one collection; vectors (chunk_id, collection,
    embedding); costs (chunk_id, cost) in tokens; levels (collection, assist_level). One row per question with
    status answerable, blocked, no_results or empty_index, its level, citations and notices. The hits of a question, at
    most k per collection, are streamed in order; what is held of them is what it cites. A question that finds nothing but has
    ``material`` (question_id, material) is answered from that: its status is context_only.
    """
    if material is None:
        material = questions.select("question_id", F.lit(None).cast("string").alias("material")).limit(0)
    indexed = vectors.select("collection").distinct()
    # A closed collection refuses a question that names it before any search.
    routed = (
        questions.join(levels.withColumnRenamed("collection", "scope"), "scope", "left")
        .join(indexed.selectExpr("collection AS scope", "true AS has_chunks"), "scope", "left")
        .selectExpr(
            "question_id", "scope", "qvec", "if(scope <> 'all' AND assist_level = 'explain_only', 'explain_only', 'full') AS own_level",
            "CASE WHEN scope = 'all' THEN 'search' WHEN assist_level = 'off' THEN 'blocked'"
            " WHEN has_chunks IS NULL THEN 'empty_index' ELSE 'search' END AS route",
        )
    )
    found = top_k(routed.where("route = 'search'"), vectors, k, min(soft, floor))
    lead = -F.max("score").over(Window.partitionBy("question_id", "collection"))
    best = F.max("score").over(Window.partitionBy("question_id"))
    # Only ids, scores and costs here; texts are fetched later for the cited chunks alone.
    hits = (
        found.withColumn("lead", lead).join(costs, "chunk_id").join(levels, "collection", "left").withColumn("best", best)
        .where(f"score >= {floor}D OR best < {floor}D").join(routed.select("question_id", "scope"), "question_id")
        .selectExpr("question_id", "rn AS depth", "lead", "collection", "chunk_id", "score", "cost", "coalesce(assist_level, 'full') AS level", "best", "scope")
    )
    folded = StructType([hits.schema["question_id"], *StructType.fromDDL(f"best double, off boolean, limited array<string>, offered int, kept {CITED}")])
    facts = (
        routed.select("question_id", "scope", "route", "own_level")
        .join(_folded(hits, ["question_id"], ["depth", "lead", "collection", "chunk_id"], lambda: _Prepared(budget), folded), "question_id", "left")
        .join(material.select("question_id", "material"), "question_id", "left")
        .selectExpr(
            "question_id", "scope", "route", "own_level", "material", "coalesce(offered, 0) AS offered", f"best < {floor}D AS low",
            "coalesce(off, false) AS off", "coalesce(limited, array()) AS limited", f"coalesce(kept, cast(array() AS {CITED})) AS kept",
        )
    )
    status = (
        "CASE WHEN route = 'blocked' THEN route WHEN offered = 0 AND material IS NOT NULL THEN 'context_only'"
        " WHEN route <> 'search' THEN route WHEN offered = 0 THEN 'no_results' WHEN off THEN 'blocked'"
        " ELSE 'answerable' END"
    )
    empty = levels.join(indexed, "collection", "left_anti").agg(F.expr("array_sort(collect_list(collection)) AS empty"))
    rows = facts.selectExpr("*", f"{status} AS status").selectExpr(
        "question_id",
        "scope",
        "status",
        "CASE status WHEN 'answerable' THEN if(size(limited) > 0, 'explain_only', 'full') WHEN 'context_only' THEN own_level END AS level",
        "if(status = 'answerable', limited, cast(array() AS array<string>)) AS restricting",
        f"if(status = 'answerable', kept, cast(array() AS {CITED})) AS kept",
        "offered",
        "status = 'answerable' AND low AS low_confidence",
        "if(status IN ('answerable', 'context_only'), material, null) AS material",
    ).selectExpr(
        "question_id", "scope", "status", "level", "restricting", "material",
        "transform(kept, (c, i) -> struct(i + 1 AS n, c.collection AS collection, c.chunk_id AS chunk_id, c.score AS score)) AS cited",
        "if(status = 'answerable', offered - size(kept), 0) AS dropped",
        "low_confidence",
    )
    return notices(
        rows.withColumn("empty", F.when(F.expr("scope = 'all' AND status IN ('answerable', 'context_only')"), empty.scalar()).otherwise(F.expr("cast(array() AS array<string>)")))
    )


def contexts(prepared: DataFrame, chunk_texts: DataFrame) -> DataFrame:
    """The excerpt block of every answerable question."""
    cited = prepared.where("status = 'answerable'").select("question_id", F.explode("cited").alias("c")).select("question_id", "c.*")
    return render_context(cited.join(chunk_texts, "chunk_id"), ["question_id"])

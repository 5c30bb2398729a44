"""Repair of conversation structure by a rank-convergence parallel Viterbi.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Every row is kept, given another role or
deleted, and empty rows may be inserted, at least cost; blank rows and rows that repeat an earlier one must go, and keeping a
truncated row costs one more. Of the cheapest repairs the one whose letters (D, I, K, R in order) come first is taken.

The cheapest repair is a shortest path over four states, found backwards: a vector holds the cost to the end from each state.
A conversation may be longer than a task should hold, so its rows are cut into chunks. All chunks are run at once from the
vector that holds at the end of a conversation; then chunks whose successor arrived at another vector are run again, pass by
pass, until every chunk was run from its successor's vector up to a constant. Costs that differ by a constant lead to the same
decisions, so vectors are kept with their least entry at 0. After ``PASSES`` passes what has not settled is composed: there
are 16 vectors in all, a chunk maps them among each other, and maps are composed by doubling. With the settled vectors every
chunk is traced forward from each state, its exits are composed in the same way, and the trace from the right entry stays.

A row is one letter while paths are found: its role's initial (``o``: none of the three), upper case if truncated, ``b`` if
blank, ``d`` if it repeats a row. A chunk holds ``2 ** CHUNK_BITS`` rows at most. Texts are read once to sort them and once, in
order and a row at a time, to replay the repair; the hash of a conversation is a chain over its rows and has no parallel form.

Rows are ordered by turn (nulls first), then role and text hash. Nulls in role and text count as one space; rows with a null
``conv_id`` are one conversation. An empty table gives an empty result, as does a conversation without rows. Columns other
than the four named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerloom.llm.shared import Scratch

CHUNK_BITS = 16
PASSES = 6
SPACES = r" \u0009\u000a\u000b\u000c\u000d"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant. An inserted or reroled row leads to ``NEXT``.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 20
Vector = tuple[int, int, int, int]


# ------------------------------------------------------------------ the path through one chunk

def with_inserts(costs: list[int]) -> list[int]:
    """Costs where rows may be inserted first. Two inserts reach every state that inserts can reach."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


#: Costs at the end of a conversation: it may end as it began or after an assistant.
END: Vector = tuple(with_inserts([0, NEVER, NEVER, 0]))


class Paths:
    """Steps over one row, remembered: there are few vectors and nine letters."""

    def __init__(self):
        self.steps: dict[tuple[Vector, str], Vector] = {}
        self.moves: dict[tuple[Vector, str, int], tuple[str, int]] = {}

    @staticmethod
    def _edits(after: Vector, letter: str, state: int) -> list[tuple[str, int, int]]:
        """(edit, cost with what follows, next state) of a row, edits in the order of their letters."""
        gone = [("D", DELETE + after[state], state)]
        if letter in "bd":
            return gone
        kept, extra = KEPT[letter.lower()].get(state), TRUNCATED * letter.isupper()
        keep = [] if kept is None else [("K", extra + after[kept], kept)]
        return [*gone, *keep, ("R", REROLE + extra + after[NEXT[state]], NEXT[state])]

    def before(self, after: Vector, letter: str) -> Vector:
        """The vector before a row from the one behind it, least entry 0."""
        found = self.steps.get((after, letter))
        if found is None:
            costs = with_inserts([min(c for _, c, _ in self._edits(after, letter, s)) for s in range(4)])
            found = self.steps[after, letter] = tuple(c - min(costs) for c in costs)
        return found

    def move(self, after: Vector, letter: str, state: int) -> tuple[str, int]:
        """The letters for a row, inserts before it included, and the state behind it: the first of the cheapest."""
        found = self.moves.get((after, letter, state))
        if found is None:
            costs = with_inserts([min(c for _, c, _ in self._edits(after, letter, s)) for s in range(4)])
            letters, at = "", state
            while True:
                options = [(e, c, s) for e, c, s in self._edits(after, letter, at) if c == costs[at]]
                if costs[at] == INSERT + costs[NEXT[at]]:
                    options.append(("I", costs[at], NEXT[at]))
                edit, _, at = min(options)
                letters += edit
                if edit != "I":
                    break
            found = self.moves[after, letter, state] = (letters, at)
        return found

    def back(self, letters: str, behind: Vector) -> Vector:
        for letter in reversed(letters):
            behind = self.before(behind, letter)
        return behind

    def trace(self, letters: str, behind: Vector, entry: int, last: bool) -> tuple[str, int]:
        """The audit of a chunk from a state, and the state it ends in; the last chunk closes the conversation."""
        vectors = [behind]
        for letter in reversed(letters):
            vectors.append(self.before(vectors[-1], letter))
        out, state = [], entry
        for i, letter in enumerate(letters):
            edits, state = self.move(vectors[len(letters) - 1 - i], letter, state)
            out.append(edits)
        while last and state not in (START, ASSISTANT):
            out.append("I")
            state = NEXT[state]
        return "".join(out), state


def vectors() -> list[Vector]:
    """All vectors that any rows can lead to."""
    paths, found, todo = Paths(), {END}, [END]
    while todo:
        v = todo.pop()
        new = {paths.before(v, letter) for letter in "suaoSUAO"} - found
        found |= new
        todo += new
    return sorted(found)


# ------------------------------------------------------------------ rows and their letters

def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text after damage that the checksum of ``conv_id:turn`` decides on; nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word(conv_id), F.lit(":"), word(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), word(role).alias("role"), word(text).alias("text"), fate.alias("_fate"))
    return rows.where("_fate <> 0").select(
        "conv_id", "turn",
        F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def _conv_key(conv_id: Column) -> Column:
    """A null conversation id as a key that equals itself."""
    value = conv_id.cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))


def ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows written in order: ``id`` ascends by conversation, turn, role and text hash; no conversation is in one task."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    trimmed = F.expr(f"trim(TRAILING '{SPACES}' FROM text)")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(trimmed == "", "b").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    keyed = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text")).select(
        _conv_key(F.col("conv_id")).alias("conv"), "*", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), letter.alias("letter")
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = keyed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_tie")
    return scratch.write(dealt.sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("id", F.monotonically_increasing_id()))


def chunked(placed: DataFrame, scratch: Scratch, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """conv, chunk, first, letters, k, m: the letters of each chunk, its number in the conversation and how many there are."""
    # Only first rows are looked up, each by its own number, so a row repeated without end is one row here.
    firsts = placed.where("letter <> 'b'").groupBy("conv", "role", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    flagged = placed.select("conv", "id", "letter").join(firsts, "id", "left").select(
        "conv", "id", F.expr(f"shiftright(id, {chunk_bits})").alias("chunk"), F.expr("if(letter = 'b' OR first, letter, 'd')").alias("letter")
    )
    chunks = flagged.groupBy("conv", "chunk").agg(F.min("id").alias("first"), F.array_sort(F.collect_list(F.struct("id", "letter"))).alias("rows"))
    place = Window.partitionBy("conv").orderBy("chunk")
    return scratch.write(
        chunks.select("conv", "chunk", "first", F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("letters")).withColumn(
            "k", F.row_number().over(place)
        ).withColumn("m", F.count("*").over(Window.partitionBy("conv")))
    )


# ------------------------------------------------------------------ vectors and states across chunks

VECTOR = "array<int>"


def _per_row(df: DataFrame, fn: Callable, inputs: list[str], kept: list[str], out: dict[str, str]) -> DataFrame:
    """``kept`` and the columns ``fn(paths, *inputs)`` gives, row by row inside Arrow batches."""
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(n, df.sparkSession.createDataFrame([], f"x {t}").schema["x"].dataType) for n, t in out.items())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for batch in batches:
            got = [fn(paths, *r) for r in zip(*(batch[c].to_pylist() for c in inputs), strict=True)]
            made = [pa.array([g[i] for g in got], arrow.field(n).type) for i, n in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *made], schema=arrow)

    return df.select(*dict.fromkeys([*kept, *inputs])).mapInArrow(run, schema)


def composed(maps: DataFrame, longest: int, from_end: bool, scratch: Scratch) -> DataFrame:
    """conv, k, map: the maps of all chunks up to k one after the other, or ``from_end`` down to k, by doubling."""
    reach = 1
    current = scratch.write(maps.select("conv", "k", "map"))
    while reach < longest:
        other = current.select("conv", (F.col("k") + (-reach if from_end else reach)).alias("k"), F.col("map").alias("far"))
        # Both ways the map that is ``reach`` away comes first: the costs go back from the end, the states from the start.
        joined = F.when(F.col("far").isNull(), F.col("map")).otherwise(F.expr("transform(far, x -> map[x])"))
        current, done = scratch.write(current.join(other, ["conv", "k"], "left").select("conv", "k", joined.alias("map"))), current
        scratch.drop(done)
        reach *= 2
    return current


def settled(chunks: DataFrame, scratch: Scratch, passes: int = PASSES) -> DataFrame:
    """conv, k, behind of the chunks of conversations with several: the vector behind each chunk."""
    end = F.array(*map(F.lit, END)).cast(VECTOR)
    many = scratch.write(chunks.where("m > 1").select("conv", "k", "m", "letters"))
    ahead = lambda paths, letters, behind: (list(paths.back(letters, tuple(behind))),)
    run = lambda rows: _per_row(rows, ahead, ["letters", "behind"], ["conv", "k", "m", "behind"], {"ahead": VECTOR})
    state = scratch.write(run(many.withColumn("behind", end)))
    for _ in range(passes):
        follower = state.select("conv", (F.col("k") - 1).alias("k"), F.col("ahead").alias("wanted"))
        wanted = state.join(follower, ["conv", "k"], "left").withColumn("wanted", F.coalesce("wanted", end))
        again = scratch.write(wanted.where("behind <> wanted").select("conv", "k", F.col("wanted").alias("behind")))
        if again.isEmpty():
            return state.select("conv", "k", "behind")
        rerun = run(many.join(again, ["conv", "k"]))
        state, done = scratch.write(state.join(again.select("conv", "k"), ["conv", "k"], "left_anti").unionByName(rerun)), state
        scratch.drop(done, again)
    # What still moves after so many passes is settled by composing what chunks do to every vector there is.
    every = vectors()
    index = {v: i for i, v in enumerate(every)}
    as_map = lambda paths, letters: ([index[paths.back(letters, v)] for v in every],)
    maps = _per_row(many, as_map, ["letters"], ["conv", "k"], {"map": VECTOR})
    suffix = composed(maps, _longest(many), True, scratch)
    table = F.array(*(F.array(*map(F.lit, v)) for v in every)).cast(f"array<{VECTOR}>")
    behind = suffix.select("conv", (F.col("k") - 1).alias("k"), F.get(table, F.col("map")[index[END]]).alias("behind"))
    return many.select("conv", "k").join(behind, ["conv", "k"], "left").withColumn("behind", F.coalesce("behind", end))


def _longest(chunks: DataFrame) -> int:
    return chunks.agg(F.max("m")).first()[0] or 0


def traced(chunks: DataFrame, scratch: Scratch, passes: int = PASSES) -> DataFrame:
    """conv, k, first, letters, entry, audit of every chunk."""
    end = F.array(*map(F.lit, END)).cast(VECTOR)
    rows = chunks.withColumn("behind", end).withColumn("entry", F.lit(START))
    longest = _longest(chunks)
    if longest > 1:
        vectors_behind = settled(chunks, scratch, passes)
        known = scratch.write(chunks.where("m > 1").join(vectors_behind, ["conv", "k"]))
        exits = lambda paths, letters, behind: ([paths.trace(letters, tuple(behind), s, False)[1] for s in range(4)],)
        maps = _per_row(known, exits, ["letters", "behind"], ["conv", "k"], {"map": VECTOR})
        prefix = composed(maps, longest, False, scratch)
        entry = prefix.select("conv", (F.col("k") + 1).alias("k"), F.col("map")[START].alias("entry"))
        many = known.join(entry, ["conv", "k"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
        rows = rows.where("m = 1").unionByName(many)
    audit = lambda paths, letters, behind, entry, k, m: (paths.trace(letters, tuple(behind), entry, k == m)[0],)
    return _per_row(rows, audit, ["letters", "behind", "entry", "k", "m"], ["conv", "k", "first", "letters", "entry"], {"audit": "string"})


# ------------------------------------------------------------------ replay

class _Replay:
    """One conversation, its rows coming in order with the audit of every chunk before the chunk's rows."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.state, self.audits, self.edits, self.letters = START, [], iter(()), iter(())
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "rows"), 0)
        self.low = self.high = self.last_turn = self.initial = None
        self.turns, self.hash = 0, hashlib.sha256()

    def chunk(self, letters: str, audit: str, entry: int) -> list[tuple[str, str, str]]:
        out = self.finish()
        self.letters, self.edits, self.state = iter(letters), iter(audit), entry
        self.audits.append(audit)
        return out

    def _put(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.hash.update(("\n" * bool(self.counts["rows"]) + f"{role}:{text}").encode())
        self.counts["rows"] += 1
        return edit, role, text

    def _inserted(self) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        self.counts["cost"] += INSERT
        return self._put("I", ROLE[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> list[tuple[str, str, str]]:
        """The rows that take this one's place, inserted ones before it included."""
        counts, letter, out = self.counts, next(self.letters), []
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        counts["illegal"] += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        counts["blank"] += letter == "b"
        counts["duplicate"] += letter == "d"
        counts["truncated"] += letter.isupper()
        edit = next(self.edits)
        while edit == "I":
            out.append(self._inserted())
            edit = next(self.edits)
        if edit == "D":
            counts["cost"] += DELETE
            return out
        counts["cost"] += TRUNCATED * letter.isupper()
        if edit == "K":
            self.state = KEPT[letter.lower()][self.state]
        else:
            counts["cost"] += REROLE
            self.state = NEXT[self.state]
            role = ROLE[self.state]
        return [*out, self._put(edit, role, text)]

    def finish(self) -> list[tuple[str, str, str]]:
        """Rows inserted behind the last one."""
        return [self._inserted() for _ in self.edits]

    def report(self) -> tuple:
        c = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], "".join(self.audits), self.hash.hexdigest())


@dataclass
class Repair:
    """The rows in order and the audits of their chunks; both results replay one over the other."""

    placed: DataFrame
    chunks: DataFrame

    def _replayed(self, schema: StructType, on_rows: Callable, on_end: Callable) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        null = lambda t: F.lit(None).cast(t)
        id_type, turn_type = self.placed.schema["conv_id"].dataType, self.placed.schema["turn"].dataType
        head = self.chunks.select("conv", F.col("first").alias("id"), F.lit(0).alias("kind"), null(id_type).alias("conv_id"), null(turn_type).alias("turn"), F.col("letters").alias("role"), F.col("audit").alias("text"), "entry")
        body = self.placed.select("conv", "id", F.lit(1).alias("kind"), "conv_id", "turn", "role", "text", F.lit(0).alias("entry"))
        stream = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "id", "kind")
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, conv, out = None, None, []

            def batch() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(arrow), arrow, strict=True)], schema=arrow)
                out.clear()
                return made

            for records in batches:
                for key, _, kind, conv_id, turn, role, text, entry in zip(*(c.to_pylist() for c in records.columns), strict=True):
                    if key != conv:
                        if held:
                            out += on_rows(held, None, held.finish())
                            out += on_end(held)
                        held, conv = _Replay(None), key
                    if kind == 0:
                        out += on_rows(held, None, held.chunk(role, text, entry))
                    else:
                        held.conv_id = conv_id
                        out += on_rows(held, turn, held.row(turn, role, text))
                if out:
                    yield batch()
            if held:
                out += on_rows(held, None, held.finish())
                out += on_end(held)
            yield batch()

        return stream.mapInArrow(run, schema)

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation with rows."""
        counts = [StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        texts = [StructField(c, StringType()) for c in ("audit", "repaired_sha256")]
        return self._replayed(StructType([self.placed.schema["conv_id"], *counts, *texts]), lambda *_: [], lambda held: [held.report()])

    def rows(self) -> DataFrame:
        """conv_id, place, edit, turn, role, text of the repaired conversations; an inserted row has no turn."""
        numbers = [StructField("place", LongType()), StructField("edit", StringType()), self.placed.schema["turn"]]

        def on_rows(held: _Replay, turn: int | None, made: list[tuple[str, str, str]]) -> list[tuple]:
            first = held.counts["rows"] - len(made)
            return [(held.conv_id, first + i, e, None if e == "I" else turn, role, text) for i, (e, role, text) in enumerate(made)]

        schema = StructType([self.placed.schema["conv_id"], *numbers, StructField("role", StringType()), StructField("text", StringType())])
        return self._replayed(schema, on_rows, lambda _: [])


def repair(rows: DataFrame, chunk_bits: int = CHUNK_BITS, passes: int = PASSES) -> Repair:
    """The cheapest repair of every conversation in ``rows`` (conv_id, turn, role, text)."""
    scratch = Scratch(rows.sparkSession, "repair")
    placed = ordered(rows, scratch)
    chunks = chunked(placed, scratch, chunk_bits)
    return Repair(placed, scratch.write(traced(chunks, scratch, passes)))


def with_empty(report: DataFrame, conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """The report of all ids in ``conversations``: those without rows have counts of zero and the hash of an empty text."""
    ids = conversations.select(F.col(conv_id).alias("_id")).distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    found = ids.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return found.select(
        F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )

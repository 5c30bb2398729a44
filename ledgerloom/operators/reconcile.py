"""Pulled items against stored events: new, moved, retimed or present.

stored (id, course, title, date, start_time, source), pulled (pos, course, title, date, start_time, site,
known_times). ``pos`` is the order the sources served items in; it decides which of several items for one slot
is reported. Items are first reduced to distinct variants, so a title that repeats a billion times is one row
per date and time, and every "is there a match" is an equi-join against a distinct or aggregated side. Results
that several later steps read are written to the shared folder once instead of being computed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import titles as H
from ledgerloom.functions.patterns import PLATFORM_WORDS
from ledgerloom.session import materialize


def signed(df: DataFrame) -> DataFrame:
    """Add what titles are compared by: key, upper-case course, content words, numbers.

    A stored table may carry these columns; then nothing is computed.
    """
    return H.with_title_parts(df)


def distinctive(df: DataFrame) -> DataFrame:
    """(…, word): rows that can match across wordings, one per content word.

    Numbers are needed and must not merely restate the course; the department word does not count.
    """
    return df.where(f"nums <> '' AND nums <> {H.course_number('course')}").withColumn(
        "word", F.explode("words")
    ).where(f"word <> {H.dept_word('course')}")


SIGNED = ("key", "up", "words", "nums")


def signed_once(df: DataFrame, *cols: str) -> DataFrame:
    """The columns that are named and those titles are compared by, written once; a table that carries these stays where it is."""
    table = signed(df).select(*dict.fromkeys([*cols, *SIGNED]))
    return table if set(SIGNED) <= set(df.columns) else materialize(table, "signed")


MARK = "xxhash64(up, if(nums <> '', nums, key))"
MARK_BITS = 1 << 27


def met_by(stored: DataFrame, pulled: DataFrame, bits: int = MARK_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that an item may name, all other rows) of a stored table; both carry what titles are compared by.

    Whatever compares titles asks for one key, or for one course and the same numbers, so only rows with the course and
    numbers (where there are none, the key) of an item can matter. The items' hashes are set in a bitmap of ``bits`` bits at
    most (16 MB) that travels to the rows; hashes that meet by chance only keep a row among the first, of which a large batch
    over a small bitmap makes more.
    """
    known, rows = materialize(signed(pulled).where("date IS NOT NULL").select(F.expr(f"{MARK} AS mark")), "marks"), signed(stored)
    size = min(bits, max(1 << 15, 1 << (16 * known.count()).bit_length()))
    block, at = f"pmod(mark, {size}) div 32768", f"cast(pmod(mark, {size}) % 32768 AS int)"
    maps = known.selectExpr(f"{block} AS block", f"{at} AS at").groupBy("block").agg(F.bitmap_construct_agg("at").alias("map"))
    maps = F.broadcast(materialize(maps, "mark-bits"))
    told = rows.withColumn("mark", F.expr(MARK)).withColumns({"block": F.expr(block), "at": F.expr(at)}).join(maps, "block", "left")
    is_set = "map IS NOT NULL AND getbit(cast(conv(hex(substring(map, at div 8 + 1, 1)), 16, 10) AS int), at % 8) = 1"
    return materialize(told.where(is_set).select(*rows.columns), "rows-met"), told.where(f"NOT ({is_set})").select(*rows.columns)


def _on_slots(rows: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered rows that lie on one of the slots: sought before their words are exploded, so only rows that can match are."""
    return rows.where("nums <> ''").join(slots.where("nums <> ''").select(*keys).distinct(), keys, "left_semi")


def cross_worded(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left (id, course, title) the first right id that names the same work under other words."""
    by_word = distinctive(signed(right)).groupBy("up", "nums", "word").agg(F.min("id").alias("match"))
    return (
        distinctive(signed(left)).join(by_word, ["up", "nums", "word"]).groupBy("id").agg(F.min("match").alias("match"))
    )


def platform_slots(stored: DataFrame) -> DataFrame:
    """Distinct (site, up, date) on which a stored title carries a word of the site's platform."""
    pairs = ", ".join(f"struct('{site}' AS site, '{w}' AS word)" for site, ws in PLATFORM_WORDS.items() for w in ws)
    return (
        signed(stored)
        .select("up", "date", F.expr(f"explode(filter(array({pairs}), p -> array_contains(words, p.word))) AS p"))
        .select("p.site", "up", "date")
        .distinct()
    )


def platform_bucket(pulled: DataFrame, stored: DataFrame) -> DataFrame:
    """Pulled items whose daily platform bucket is on the calendar already."""
    rows = pulled.where("date IS NOT NULL").withColumn("up", F.expr("upper(course)"))
    return rows.join(platform_slots(stored), ["site", "up", "date"], "left_semi").drop("up")


def reconcile(pulled: DataFrame, stored: DataFrame, today: str, platforms: DataFrame | None = None) -> DataFrame:
    """Verdicts: one row per change (n = 1) and one per variant that is present (n items).

    Columns kind, key, course, title, date, start_time, end_time, all_day, site, pos, old_date, old_times, n. ``platforms`` are
    the platform slots where ``stored`` holds only the rows that items may name.
    """
    have = signed_once(stored, "course", "date", "start_time", "source")
    dated = signed(pulled.where("date IS NOT NULL")).drop("up", "words", "nums")
    dated = dated if set(SIGNED) <= set(pulled.columns) else materialize(dated, "pulled-signed")
    # Every known time of a slot with who states it, then one row of facts per slot.
    stated = have.selectExpr(
        "key", "date", "nullif(start_time, '') AS time", "source = 'csv' AND start_time <> '' AS in_csv", "true AS is_stored", "false AS is_served"
    ).unionByName(
        dated.selectExpr(
            "key", "date", "explode_outer(filter(array_append(known_times, start_time), x -> x <> '')) AS time",
            "false AS in_csv", "false AS is_stored", "true AS is_served",
        )
    )
    facts = stated.groupBy("key", "date").agg(
        F.expr("bool_or(is_stored) AS same_date"),
        F.expr("bool_or(is_served) AS served"),
        F.expr("array_sort(collect_set(time) FILTER (WHERE in_csv)) AS old_times"),
        F.expr("array_sort(collect_set(time) FILTER (WHERE is_served)) AS source_times"),
    )
    facts = materialize(facts, "slot-facts")
    keys = facts.where("same_date").groupBy("key").agg(
        F.min("date").alias("only"),
        F.expr("min(date) = max(date) AS single"),
        F.expr("min_by(served, date) AS only_served"),
        F.expr("min_by(old_times, date) AS only_times"),
    )
    buckets = (platform_slots(have) if platforms is None else platforms).withColumn("bucket", F.lit(True))
    variants = dated.groupBy("key", "course", "title", "date", "start_time", "end_time", "all_day", "site").agg(
        F.min("pos").alias("pos"), F.count("*").alias("n")
    ).withColumn("up", F.expr("upper(course)"))
    known = (
        variants.join(keys, "key", "left")
        .join(facts.drop("served"), ["key", "date"], "left")
        .join(buckets, ["site", "up", "date"], "left")
    )
    known = materialize(known, "pulled-variants")
    # Other wordings of the same deadline, only for items whose key is unknown.
    no_key = "only IS NULL AND bucket IS NULL"
    unkeyed = signed_once(known.where(no_key).select("course", "title", "date").distinct(), "course", "title", "date")
    by_word = (
        distinctive(_on_slots(have, unkeyed, ["up", "nums", "date"]))
        .select("up", "nums", "date", "word", F.expr("if(source = 'csv' AND start_time <> '', start_time, null) AS time"))
        .distinct()
    )
    cross = (
        distinctive(unkeyed).join(by_word, ["up", "nums", "date", "word"])
        .groupBy("course", "title", "date")
        .agg(F.expr("array_sort(collect_set(time)) AS cross_times"))
    )
    late = "date < date'" + today + "'"
    retimed = "start_time <> '' AND size({t}) > 0 AND NOT arrays_overlap({t}, source_times) AND NOT " + late
    other = known.where(no_key).join(cross, ["course", "title", "date"], "left")
    verdict = [
        "key", "course", "title", "date", "start_time", "end_time", "all_day", "site", "pos", "n", "only", "only_times", "old_times", "cross_times",
        "CASE WHEN bucket THEN 'present'"
        " WHEN only IS NULL AND cross_times IS NULL THEN 'new'"
        f" WHEN only IS NULL THEN if({retimed.format(t='cross_times')}, 'retimed', 'present')"
        f" WHEN same_date THEN if(single AND {retimed.format(t='old_times')}, 'retimed', 'present')"
        " WHEN single AND NOT only_served THEN 'moved' ELSE 'new' END AS verdict",
    ]
    # Items with a key have no other wordings and need no join.
    keyed = known.where(f"NOT ({no_key})").withColumn("cross_times", F.expr("cast(null AS array<string>)"))
    judged = materialize(keyed.unionByName(other.select(*keyed.columns)).selectExpr(*verdict), "verdicts")
    # One report per slot: the earliest item. The rest are present (retimes), fall back to new (moves) or vanish (new).
    moved_first = judged.where("verdict = 'moved'").groupBy("key").agg(F.min("pos").alias("moved_pos"))
    staged = judged.where("verdict = 'moved'").join(moved_first, "key").withColumn("is_move", F.expr("pos = moved_pos"))
    # A moved variant served several times: its later copies count as new on their own date.
    spare = judged.where("verdict = 'new'").unionByName(staged.where("NOT is_move").select(*judged.columns)).withColumnRenamed("pos", "new_pos")
    later = dated.join(
        staged.where("is_move AND n > 1").select("key", "title", "course", "date", "start_time", "end_time", "all_day", "site", "moved_pos"),
        ["key", "title", "course", "date", "start_time", "end_time", "all_day", "site"],
    ).where("pos > moved_pos").groupBy("key", "title", "course", "date", "start_time", "end_time", "all_day", "site").agg(F.min("pos").alias("new_pos"))
    cols = ["key", "course", "title", "date", "start_time", "end_time", "all_day", "site"]
    news = (
        spare.select(*cols, "new_pos").unionByName(later.select(*cols, "new_pos"))
        .groupBy("key", "date")
        .agg(F.expr("min(struct(new_pos AS pos, course, title, start_time, end_time, all_day, site)) AS i"))
        .selectExpr("'new' AS kind", "key", "i.course", "i.title", "date", "i.start_time", "i.end_time", "i.all_day", "i.site", "i.pos",
                    "cast(null AS date) AS old_date", "cast(array() AS array<string>) AS old_times", "cast(1 AS bigint) AS n")
    )
    moves = staged.where("is_move").selectExpr(
        "'moved' AS kind", *cols, "pos", "only AS old_date", "only_times AS old_times", "cast(1 AS bigint) AS n"
    )
    first_retime = judged.where("verdict = 'retimed'").groupBy("key", "date").agg(F.min("pos").alias("first_pos"))
    again = judged.where("verdict = 'retimed'").join(first_retime, ["key", "date"])
    retimes = again.where("pos = first_pos").selectExpr(
        "'moved' AS kind", *cols, "pos", "date AS old_date", "coalesce(cross_times, old_times) AS old_times", "cast(1 AS bigint) AS n"
    )
    blank = ["cast(null AS date) AS old_date", "cast(array() AS array<string>) AS old_times"]
    present = judged.where("verdict = 'present'").selectExpr("'present' AS kind", *cols, "pos", *blank, "n")
    leftover = again.selectExpr("'present' AS kind", *cols, "pos", *blank, "if(pos = first_pos, n - 1, n) AS n").where("n > 0")
    return news.unionByName(moves).unionByName(retimes).unionByName(present).unionByName(leftover)


def ignore_listed(changes: DataFrame, ignored: DataFrame) -> DataFrame:
    """Changes without those whose key is on the ignore list, new and moved alike."""
    return changes.join(ignored.select("key").distinct(), "key", "left_anti")


# ------------------------------------------------------------------ applying changes

def apply_moves(stored: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewrite the one stored row each move names; returns (rows, actions).

    A row of the same key outranks a row matched across wordings. Two candidates in the deciding tier leave the
    table untouched. ``actions`` says rewritten, ambiguous, left or append per move.
    """
    pad = "if(start_time = '', '', lpad(start_time, 5, '0'))"
    moves = materialize(signed(moves), "moves")
    rows = signed_once(stored, "id", "course", "date", "start_time").withColumn("time", F.expr(pad))
    want = moves.withColumnRenamed("date", "new_date").withColumnRenamed("old_date", "date").withColumn(
        "time", F.expr("explode(if(size(old_times) = 0, array(cast(null AS string)), old_times))")
    )
    # Rows of one slot are counted before the join, so a slot with many copies costs one row.
    slot = rows.groupBy("course", "date", "key", "time").agg(F.count("*").alias("hits"), F.min("id").alias("id"))
    exact = _hits(want, slot, ["course", "date", "key"], "exact")
    # Rows that other wordings can meet, on the old or the new date of a move.
    days = moves.select("course", "nums", F.expr("explode(array(old_date, date)) AS date"))
    near = materialize(_on_slots(rows, days, ["course", "nums", "date"]), "rows-near-moves")
    words = distinctive(near).select("course", "date", "nums", "word", "time", "id")
    loose_want = distinctive(want).select("pos", "course", "date", "nums", "word", "time").join(exact.select("pos"), "pos", "left_anti")
    loose = _loose(loose_want, words)
    chosen = materialize(exact.unionByName(loose), "move-candidates")
    single = chosen.where("hits = 1").groupBy("id").agg(F.min("pos").alias("pos"))
    taken = moves.join(single, "pos").selectExpr("id", "pos", "date AS m_date", "start_time AS m_start", "end_time AS m_end", "all_day AS m_all_day")
    end = "if(end_time = '', '', lpad(end_time, 5, '0'))"
    kept_end = f"if(m_start <> '' AND {end} > lpad(m_start, 5, '0'), {end}, '')"
    new = stored.join(taken, "id", "left").selectExpr(
        "id", "course", "title",
        "coalesce(m_date, date) AS date",
        "CASE WHEN pos IS NULL THEN start_time WHEN m_all_day THEN '' ELSE m_start END AS start_time",
        f"CASE WHEN pos IS NULL THEN end_time WHEN m_all_day THEN '' WHEN m_end <> '' THEN m_end ELSE {kept_end} END AS end_time",
        "coalesce(m_all_day, all_day) AS all_day", "source", "pos IS NOT NULL AS rewritten",
        *(c for c in stored.columns if c in SIGNED),
    )
    same_day = _same_deadline(moves, rows, near)
    actions = (
        moves.select("pos", "date", "old_date")
        .join(chosen.select("pos", "hits"), "pos", "left")
        .join(single.select("pos", F.lit(True).alias("won")), "pos", "left")
        .join(same_day.withColumn("already", F.lit(True)), "pos", "left")
        .selectExpr(
            "pos",
            "CASE WHEN hits > 1 THEN 'ambiguous' WHEN won THEN 'rewritten' WHEN date = old_date OR already THEN 'left' ELSE 'append' END AS action",
        )
    )
    return new, actions


def _hits(want: DataFrame, slot: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """Rows per move in its slot; a move without known times accepts any time."""
    cols = [*keys, F.col("time").alias("row_time"), "hits", "id"]
    return (
        want.select("pos", *keys, "time")
        .join(slot.select(*cols), keys)
        .where("time IS NULL OR time = row_time")
        .groupBy("pos")
        .agg(F.sum("hits").alias("hits"), F.min("id").alias("id"))
    )


def _loose(want: DataFrame, words: DataFrame) -> DataFrame:
    """Rows that share a distinctive word: the lowest and highest id tell one match from several."""
    by_word = words.groupBy("course", "date", "nums", "word", F.col("time").alias("row_time")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return (
        want.join(by_word, ["course", "date", "nums", "word"])
        .where("time IS NULL OR time = row_time")
        .groupBy("pos")
        .agg(F.min("lo").alias("id"), F.max("hi").alias("hi"))
        .selectExpr("pos", "if(id = hi, 1, 2) AS hits", "id")
    )


def _same_deadline(moves: DataFrame, rows: DataFrame, near: DataFrame) -> DataFrame:
    """Moves whose new date already holds the same work, by key among all rows or across wordings among the near ones."""
    by_key = moves.join(rows.select("course", "date", "key").distinct(), ["course", "date", "key"], "left_semi").select("pos")
    by_word = distinctive(moves).join(
        distinctive(near).select("course", "date", "nums", "word").distinct(), ["course", "date", "nums", "word"], "left_semi"
    ).select("pos")
    return by_key.unionByName(by_word).distinct()


def append_new(stored: DataFrame, items: DataFrame) -> DataFrame:
    """Dated items not held yet, one per (course, title, date): the one served first."""
    first = items.where("date IS NOT NULL").groupBy("course", "title", "date").agg(
        F.expr("min(struct(pos, start_time, end_time, all_day)) AS i")
    )
    return first.join(stored.select("course", "title", "date"), ["course", "title", "date"], "left_anti").selectExpr(
        "course", "title", "date", "i.start_time", "i.end_time", "i.all_day", "i.pos"
    )


def apply_changes(stored: DataFrame, changes: DataFrame, new_id: str) -> tuple[DataFrame, DataFrame]:
    """The calendar after a poll: moves rewritten, new work appended; returns (rows, actions).

    Only rows of source ``csv`` are edited; others stay as they are. New rows, and moves that found no row of theirs, are
    appended unless their course, title and date are held already. ``new_id`` is SQL text over a change and gives the id of
    the row made of it. A stored table that carries what titles are compared by keeps it up for new rows.
    """
    own = stored.where("source = 'csv'")
    rows, actions = apply_moves(own, changes.where("kind = 'moved'"))
    rows, actions = materialize(rows, "rows-after-moves"), materialize(actions, "actions")
    spare = changes.where("kind = 'new'").unionByName(changes.join(actions.where("action = 'append'").select("pos"), "pos", "left_semi").select(*changes.columns))
    added = append_new(rows, spare).withColumn("id", F.expr(new_id)).withColumn("source", F.lit("csv"))
    cols = stored.columns
    added = signed(added) if set(SIGNED) <= set(cols) else added
    after = rows.select(*cols).unionByName(added.select(*cols)).unionByName(stored.where("source <> 'csv' OR source IS NULL").select(*cols))
    return after, actions


def authority_merge(events: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Fold calendar events into the quiz records they repeat.

    events (pos, course, title, date, start_time), quizzes (pos, course, title, date, start_time, known_times,
    known_dates). An event on a date of a quiz of the same key only adds its time to that quiz. Other events of
    one key and date become one, at the latest time.
    """
    q = signed(quizzes)
    owners = (
        q.select("key", "pos", F.expr("explode(array_distinct(array_append(known_dates, date))) AS date"))
        .groupBy("key", "date")
        .agg(F.min("pos").alias("owner"))
    )
    e = signed(events).join(owners, ["key", "date"], "left")
    added = e.where("owner IS NOT NULL AND start_time <> ''").groupBy("owner").agg(F.collect_set("start_time").alias("times"))
    merged = q.join(added.withColumnRenamed("owner", "pos"), "pos", "left").selectExpr(
        "'quiz' AS record", "pos", "course", "key", "date", "start_time",
        "if(times IS NULL, known_times, array_sort(array_union(known_times, times))) AS known_times",
    )
    rest = e.where("owner IS NULL").groupBy("course", "key", "date").agg(
        F.max("start_time").alias("latest"), F.collect_set(F.expr("nullif(start_time, '')")).alias("times"), F.count("*").alias("n"),
    )
    last = e.where("owner IS NULL").groupBy("course", "key", "date", "start_time").agg(F.min("pos").alias("pos"))
    kept = rest.join(last.withColumnRenamed("start_time", "latest"), ["course", "key", "date", "latest"]).selectExpr(
        "'event' AS record", "pos", "course", "key", "date", "latest AS start_time",
        "if(n = 1, cast(array() AS array<string>), array_sort(times)) AS known_times",
    )
    return merged.unionByName(kept)


# ------------------------------------------------------------------ completions

def completion_state(log: DataFrame) -> DataFrame:
    """Current state per (course, key, date): the last line wins. log (line_no, course, key, date, title, done)."""
    return log.groupBy(F.expr("upper(course) AS up"), "key", "date").agg(
        F.expr("max(struct(line_no, title, done)) AS last")
    ).select("up", "key", "date", "last.title", "last.done")


def is_done(events: DataFrame, state: DataFrame) -> DataFrame:
    """Whether each event (id, course, title, date) is finished.

    An exact slot decides, also when it says no. Otherwise a finished item of the same course and day counts
    when it names the same deadline in other words, or shares the platform's word.
    """
    ev = signed(events)
    exact = state.select("up", "key", "date", F.col("done").alias("exact"))
    tagged = materialize(ev.join(exact, ["up", "key", "date"], "left"), "tagged-events")
    open_ = tagged.where("exact IS NULL")
    finished = signed(state.where("done AND title <> ''").select(F.col("up").alias("course"), "title", "date"))
    twin_words = distinctive(finished).select("up", "date", "nums", "word").distinct()
    twins = distinctive(open_).join(twin_words, ["up", "date", "nums", "word"], "left_semi").select("id")
    plat = sorted({w for ws in PLATFORM_WORDS.values() for w in ws})
    shared = f"explode(filter(words, w -> array_contains(array({', '.join(repr(w) for w in plat)}), w))) AS word"
    plat_words = finished.select("up", "date", F.expr(shared)).distinct()
    buckets = open_.select("id", "up", "date", F.expr(shared)).join(plat_words, ["up", "date", "word"], "left_semi").select("id")
    loose = twins.unionByName(buckets).distinct().withColumn("loose", F.lit(True))
    return tagged.join(loose, "id", "left").selectExpr("id", "coalesce(exact, loose, false) AS done")


def completion_stats(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("total"), F.expr("count_if(done) AS done"))

"""Gradebook operators over item rows.

Items: (course, name, max_points, out_of, score, graded, bonus, excluded, weight, weighted_num, weighted_den);
amounts are decimals so sums do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.titles import fold_words_text, run_numbers_of, run_words_of
from ledgerloom.session import materialize

# Letter floors (inclusive) and grade points.
LETTERS = [
    (93, "A", "4.0"), (90, "A-", "3.7"), (87, "B+", "3.3"), (83, "B", "3.0"), (80, "B-", "2.7"), (77, "C+", "2.3"),
    (73, "C", "2.0"), (70, "C-", "1.7"), (67, "D+", "1.3"), (63, "D", "1.0"), (61, "D-", "0.7"),
]
DEFAULT_CREDITS = 3
STAKE_MIN = 5
DIGEST_ITEMS = 14
DIGEST_CHARS = 3500


def letter(pct: str) -> str:
    cases = " ".join(f"WHEN {pct} >= {floor} THEN '{name}'" for floor, name, _ in LETTERS)
    return f"CASE WHEN {pct} IS NULL THEN null {cases} ELSE 'F' END"


def grade_points(pct: str) -> str:
    cases = " ".join(f"WHEN {pct} >= {floor} THEN {points}BD" for floor, _, points in LETTERS)
    return f"cast(CASE WHEN {pct} IS NULL THEN null {cases} ELSE 0.0BD END AS decimal(3,1))"


def percent(num: str, den: str) -> str:
    return f"bround(100D * cast({num} AS double) / cast({den} AS double), 1)"


def grade_summary(items: DataFrame) -> DataFrame:
    """Standing per course. Weighted when the weighted pairs add up to something, else points, else nothing.

    Bonus items raise the numerator only; excluded items count nowhere.
    """
    paired = "graded AND weighted_num IS NOT NULL AND (bonus OR weighted_den IS NOT NULL)"
    sums = items.groupBy("course").agg(
        F.expr("count_if(NOT excluded) AS total_count"),
        F.expr("count_if(NOT excluded AND graded) AS graded_count"),
        F.expr("count_if(NOT excluded AND graded AND bonus) AS bonus_count"),
        F.expr("coalesce(sum(score) FILTER (WHERE NOT excluded AND graded), 0) AS earned"),
        F.expr("coalesce(sum(out_of) FILTER (WHERE NOT excluded AND graded AND NOT bonus), 0) AS possible"),
        F.expr(f"coalesce(sum(weighted_num) FILTER (WHERE NOT excluded AND {paired}), 0) AS w_num"),
        F.expr(
            "coalesce(sum(weighted_den) FILTER (WHERE NOT excluded AND graded AND NOT bonus"
            " AND weighted_num IS NOT NULL), 0) AS w_den"
        ),
    )
    return sums.selectExpr(
        "course",
        "graded_count",
        "bonus_count",
        "total_count",
        "total_count - graded_count AS ungraded_count",
        "cast(earned AS double) AS points_earned",
        "cast(possible AS double) AS points_possible",
        f"CASE WHEN w_den <> 0 THEN {percent('w_num', 'w_den')} WHEN possible <> 0 THEN {percent('earned', 'possible')}"
        " END AS current_pct",
        "CASE WHEN w_den <> 0 THEN 'weighted' WHEN possible <> 0 THEN 'points' ELSE 'nothing graded yet' END AS basis",
    )


def letter_grades(summary: DataFrame) -> DataFrame:
    return summary.select(
        "course", "current_pct", F.expr(f"{letter('current_pct')} AS letter"), F.expr(f"{grade_points('current_pct')} AS points")
    )


def gpa(summary: DataFrame, credits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Credit-weighted grade point average over courses that have a grade.

    ``credits`` (course, credits); a course not listed counts ``DEFAULT_CREDITS``.
    """
    rows = letter_grades(summary).join(credits, "course", "left").withColumn(
        "cr", F.expr(f"coalesce(credits, {DEFAULT_CREDITS})")
    )
    sums = rows.groupBy(*(keys or [])).agg(
        F.expr("sum(points * cr) AS quality"),
        F.expr("coalesce(sum(cr) FILTER (WHERE points IS NOT NULL), 0) AS credits_counted"),
        F.count("points").alias("courses_counted"),
        F.count("*").alias("courses_total"),
    )
    return sums.selectExpr(
        *(keys or []),
        "bround(cast(quality AS double) / nullif(credits_counted, 0), 2) AS gpa",
        "cast(coalesce(quality, 0) AS double) AS quality_points",
        "credits_counted",
        "courses_counted",
        "courses_total",
    )


def grade_distribution(items: DataFrame) -> DataFrame:
    """Median score percent and the points banked, lost and still open per course."""
    counted = items.where("NOT excluded")
    pct = (
        counted.where("graded AND out_of <> 0")
        .selectExpr("course", "100D * cast(score AS double) / cast(out_of AS double) AS pct")
        .groupBy("course", "pct")
        .agg(F.count("*").alias("n"))
    )
    # The two middle places, counted from 0, lie in the rows whose running count passes them.
    by_course = Window.partitionBy("course")
    placed = pct.withColumn("upto", F.sum("n").over(by_course.orderBy("pct"))).withColumn("total", F.sum("n").over(by_course))
    middle = lambda k: f"sum(if(upto - n <= {k} AND {k} < upto, pct, 0D))"
    pct = placed.groupBy("course").agg(F.expr(f"({middle('(total - 1) div 2')} + {middle('total div 2')}) / 2 AS median"))
    points = counted.groupBy("course").agg(
        F.expr("coalesce(sum(score) FILTER (WHERE graded), 0) AS banked"),
        F.expr("coalesce(sum(greatest(out_of - score, 0)) FILTER (WHERE graded AND NOT bonus), 0) AS lost"),
        F.expr("coalesce(sum(max_points) FILTER (WHERE NOT graded), 0) AS open"),
    )
    return points.join(pct, "course", "left").selectExpr(
        "course", "round(median, 4) AS median", "cast(banked AS double) AS banked", "cast(lost AS double) AS lost", "cast(open AS double) AS open"
    )


def priced_books(items: DataFrame) -> DataFrame:
    """Courses whose weights are a share of the grade: weighted basis and live weights adding up to 100."""
    live = items.where("NOT excluded AND NOT bonus").groupBy("course").agg(F.sum("weight").alias("weight_sum"))
    weighted = grade_summary(items).where("basis = 'weighted'").select("course")
    return live.where("abs(weight_sum - 100) <= 1").join(weighted, "course", "left_semi")


# ------------------------------------------------------------------ strict matching

def strict_pairs(items: DataFrame, events: DataFrame) -> DataFrame:
    """(course, name, title) of gradebook items and calendar rows that name the same work.

    Numerals must agree both ways and one side's words must cover the other's by prefix. A cover needs every
    word of one side to meet a word of the other that shares its first two letters (or equals it), so candidates
    come from an equi-join on course, numerals and that short prefix of one word. Any word will do; the one whose
    prefix is rarest on the other side is taken, its lead, and a name with a prefix the other side lacks has none.
    Names and titles are made distinct first, so repeats of a series cost nothing. Leads are chosen by windows behind one
    shuffle by course and numerals, and only rows whose prefix is the lead of either side go into the join.
    """

    def signed(df: DataFrame, col: str, side: int) -> DataFrame:
        return (
            df.select("course", F.col(col).alias("text"))
            .distinct()
            .withColumn("folded", F.expr(fold_words_text("text")))
            .selectExpr("course", f"array_join({run_numbers_of('folded', 'course')}, '-') AS nums", f"{side} AS side", "text", f"array_join({run_words_of('folded')}, ' ') AS words")
            .where("words <> ''")
        )

    blocks = ["course", "nums", "tok"]
    texts = signed(items, "name", 0).unionByName(signed(events, "title", 1)).repartition("course", "nums")
    rows = _led(texts.withColumn("tok", F.expr("explode(array_distinct(transform(split(words, ' '), w -> left(w, 2))))")), blocks)
    rows = materialize(rows, "title-words")
    side = lambda k, *names: rows.where(f"side = {k}").select(*blocks, *(F.col(c).alias(n) for c, n in zip(("text", "words", "leads"), names)))
    meet = "x = y OR (length(x) >= 2 AND startswith(y, x)) OR (length(y) >= 2 AND startswith(x, y))"
    covered = "forall(split({a}, ' '), x -> exists(split({b}, ' '), y -> " + meet + "))"
    either = f"item_leads AND {covered.format(a='iw', b='ew')} OR event_leads AND {covered.format(a='ew', b='iw')}"
    pairs = side(0, "name", "iw", "item_leads").join(side(1, "title", "ew", "event_leads"), blocks).where(either)
    return pairs.select("course", "name", "title").distinct()


def _led(rows: DataFrame, blocks: list[str]) -> DataFrame:
    """Rows (…, side, text, words, tok) that lead their text, or share a block with one that leads a text of the other side."""
    among, text = Window.partitionBy(*blocks), Window.partitionBy("course", "nums", "side", "text")
    counted = rows.withColumns({"items": F.count_if(F.expr("side = 0")).over(among), "events": F.count_if(F.expr("side = 1")).over(among)})
    led = counted.withColumn("lead", F.min(F.expr("struct(if(side = 0, events, items) AS n, tok)")).over(text)).withColumn(
        "leads", F.expr("lead.n > 0 AND lead.tok = tok")
    )
    by_side = {f"led_{k}": F.expr(f"bool_or(side = {k} AND leads)").over(among) for k in (0, 1)}
    return led.withColumns(by_side).where("leads OR if(side = 0, led_1, led_0)").select(*blocks, "side", "text", "words", "leads")


def _priced_items(items: DataFrame) -> DataFrame:
    return items.where("NOT excluded").join(priced_books(items).select("course"), "course", "left_semi").select(
        "course", "name", "weight", "graded", "bonus"
    )


def stake_match(items: DataFrame, events: DataFrame) -> DataFrame:
    """Weight of the one priced item each calendar row names; a row that names two prints nothing."""
    priced = materialize(_priced_items(items), "priced-items")
    per_name = priced.groupBy("course", "name").agg(F.count("*").alias("copies"), F.max("weight").alias("weight"))
    unique = (
        strict_pairs(priced, events)
        .join(per_name, ["course", "name"])
        .groupBy("course", "title")
        .agg(F.sum("copies").alias("hits"), F.max("name").alias("item"), F.max("weight").alias("weight"))
        .where("hits = 1 AND weight > 0")
    )
    return events.join(unique, ["course", "title"]).selectExpr(
        "id", "course", "title", "date", "item", "cast(bround(weight, 1) AS double) AS stake"
    )


def first_stake(stakes: DataFrame) -> DataFrame:
    """Flag every calendar row after the first that carries the same priced item."""
    first = F.min(F.struct("date", "id")).over(Window.partitionBy("course", "item"))
    return stakes.withColumn("f", first).selectExpr("id", "course", "item", "date", "stake", "NOT (date = f.date AND id = f.id) AS again")


def undated_stakes(items: DataFrame, events: DataFrame) -> DataFrame:
    """Priced, ungraded work of real weight that no calendar row names."""
    wanted = materialize(_priced_items(items).where(f"NOT graded AND NOT bonus AND weight >= {STAKE_MIN}"), "open-stakes")
    return wanted.join(strict_pairs(wanted, events), ["course", "name"], "left_anti").selectExpr(
        "course", "name", "cast(bround(weight, 1) AS double) AS stake"
    )


def double_dated(items: DataFrame, events: DataFrame) -> DataFrame:
    """Items that calendar rows put on two or more dates."""
    names = items.where("NOT excluded")
    dates = events.select("course", "title", "date").distinct()
    return (
        strict_pairs(names, events)
        .join(dates, ["course", "title"])
        .groupBy("course", "name")
        .agg(F.countDistinct("date").alias("dates"))
        .where("dates >= 2")
    )


def weight_tercile(items: DataFrame) -> DataFrame:
    """Dot size by the rank of an item's points among the distinct points of its course."""
    dots = items.where("graded AND NOT excluded AND out_of <> 0").selectExpr(
        "course", "name", "coalesce(nullif(max_points, 0), out_of) AS weight_key"
    )
    keys = dots.select("course", "weight_key").distinct()
    rank = F.dense_rank().over(Window.partitionBy("course").orderBy("weight_key"))
    sized = keys.withColumn("r", rank).withColumn("n", F.count("*").over(Window.partitionBy("course")))
    pos = "(r - 1) / (n - 1)"
    size = f"CASE WHEN n <= 1 THEN 5.5D WHEN {pos} < 1D / 3 THEN 4D WHEN {pos} < 2D / 3 THEN 5.5D ELSE 7D END"
    return dots.join(sized.selectExpr("course", "weight_key", f"{size} AS size"), ["course", "weight_key"]).select(
        "course", "name", "size"
    )


def digest_rows(items: DataFrame, cap: int = DIGEST_ITEMS, *more_columns: str) -> DataFrame:
    """The first ``cap`` graded items per course and how many more there are."""
    graded = items.where("graded")
    w = Window.partitionBy("course").orderBy("pos", "name")
    first = graded.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    more = graded.groupBy("course").agg(F.expr(f"greatest(count(*) - {cap}, 0) AS more"))
    return first.join(more, "course").select("course", "rn", "name", "score", "out_of", "more", *more_columns)


def short_number(x: str) -> str:
    """A number without the zeros behind its point."""
    return f"coalesce(regexp_replace(cast({x} AS string), '(?:[.]0*|([.][0-9]*?)0+)$', '$1'), '?')"


def _digest_texts(items: DataFrame, cap: int) -> DataFrame:
    """(course, text): a course's standing, its first graded items, and a count of the rest."""
    shown = "if(coalesce(displayed, '') = '', '', concat(' (', displayed, ')'))"
    line = f"concat('    graded: ', left(name, 46), ' = ', {short_number('score')}, '/', {short_number('out_of')}, {shown})"
    items = items if "displayed" in items.columns else items.withColumn("displayed", F.lit(""))
    lines = digest_rows(items, cap, "displayed").groupBy("course").agg(
        F.expr(f"listagg({line}, '\n') WITHIN GROUP (ORDER BY rn) AS body"), F.max("more").alias("more")
    )
    head = (
        "concat('- ', course, ': ', if(current_pct IS NULL, concat('nothing graded yet (', total_count, ' items in the gradebook)'),"
        " concat('current ', current_pct, '% (', basis, '; ', graded_count, ' of ', total_count, ' items graded)')))"
    )
    more = "if(more > 0, concat('\n    (+', more, ' more graded items)'), '')"
    return grade_summary(items).join(lines, "course", "left").selectExpr(
        "course", f"concat({head}, coalesce(concat('\n', body, {more}), '')) AS text"
    )


def _cut(text: str, max_chars: int) -> str:
    return f"if(char_length({text}) > {max_chars}, concat(left({text}, {max_chars}), '\n    (truncated)'), {text})"


def grades_digest(items: DataFrame, cap: int = DIGEST_ITEMS, max_chars: int = DIGEST_CHARS) -> DataFrame:
    """The digest of each course, for a question about one course."""
    return _digest_texts(items, cap).selectExpr("course", f"{_cut('text', max_chars)} AS text")


def grades_digest_all(items: DataFrame, cap: int = DIGEST_ITEMS, max_chars: int = DIGEST_CHARS) -> DataFrame:
    """One digest of all courses, cut once. No course takes less than one character, so the first ones fill it."""
    first = _digest_texts(items, cap).orderBy("course").limit(max_chars + 1)
    return first.agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY course) AS text")).selectExpr(f"{_cut('text', max_chars)} AS text")

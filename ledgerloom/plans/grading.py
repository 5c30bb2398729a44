"""Query keys of the gradebook operators."""

from ledgerloom.operators import grading as G
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_plans import RUN_STOP
from ledgerloom.plans.views import GRADES, with_
from ledgerloom.session import materialize
from ledgerloom.sources.tables import EVENT_NAMES, ITEM_NAMES, book_events, books, grade_items, sql_list

SUMS = """sums AS (SELECT course, count(*) FILTER (NOT excluded) AS total_count, count(*) FILTER (NOT excluded AND graded) AS graded_count,
    count(*) FILTER (NOT excluded AND graded AND bonus) AS bonus_count,
    coalesce(sum(score) FILTER (NOT excluded AND graded), 0) AS earned,
    coalesce(sum(out_of) FILTER (NOT excluded AND graded AND NOT bonus), 0) AS possible,
    coalesce(sum(weighted_num) FILTER (NOT excluded AND graded AND weighted_num IS NOT NULL AND (bonus OR weighted_den IS NOT NULL)), 0) AS w_num,
    coalesce(sum(weighted_den) FILTER (NOT excluded AND graded AND NOT bonus AND weighted_num IS NOT NULL), 0) AS w_den
  FROM {src} GROUP BY course),
summary AS (SELECT course, graded_count, bonus_count, total_count, total_count - graded_count AS ungraded_count,
    earned::DOUBLE AS points_earned, possible::DOUBLE AS points_possible,
    CASE WHEN w_den <> 0 THEN round_even(100::DOUBLE * w_num::DOUBLE / w_den::DOUBLE, 1)
      WHEN possible <> 0 THEN round_even(100::DOUBLE * earned::DOUBLE / possible::DOUBLE, 1) END AS current_pct,
    CASE WHEN w_den <> 0 THEN 'weighted' WHEN possible <> 0 THEN 'points' ELSE 'nothing graded yet' END AS basis FROM sums)"""
SUMMARY = with_(GRADES, SUMS.format(src="grades_items"))
LETTER_SQL = "CASE WHEN current_pct IS NULL THEN NULL " + " ".join(f"WHEN current_pct >= {f} THEN '{n}'" for f, n, _ in G.LETTERS) + " ELSE 'F' END"
POINTS_SQL = "(CASE WHEN current_pct IS NULL THEN NULL " + " ".join(f"WHEN current_pct >= {f} THEN {p}" for f, _, p in G.LETTERS) + " ELSE 0.0 END)::DECIMAL(3,1)"


@query("grade_summary", SUMMARY + "SELECT * FROM summary")
def grade_summary(t):
    return G.grade_summary(grade_items(t.lineitem))


@query(
    "letter_grade",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, round_even(60 + l_extendedprice % 4000 / 100, 1) AS current_pct FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, current_pct, {LETTER_SQL} AS letter, {POINTS_SQL}::DOUBLE AS points FROM s""",
)
def letter_grade(t):
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "bround(60 + l_extendedprice % 4000 / 100, 1) AS current_pct")
    return rows.selectExpr("*", f"{G.letter('current_pct')} AS letter", f"cast({G.grade_points('current_pct')} AS double) AS points")


@query(
    "gpa",
    SUMMARY + f""", g AS (SELECT s.course, {POINTS_SQL} AS points, coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN 1 + s_suppkey % 4 END, 3) AS cr
  FROM summary s LEFT JOIN supplier ON s.course = 'S' || s_suppkey)
SELECT round_even(sum(points * cr)::DOUBLE / sum(cr) FILTER (points IS NOT NULL), 2) AS gpa, sum(points * cr)::DOUBLE AS quality_points,
(sum(cr) FILTER (points IS NOT NULL))::BIGINT AS credits_counted, count(points) AS courses_counted, count(*) AS courses_total FROM g""",
)
def gpa(t):
    credits = t.supplier.selectExpr("concat('S', s_suppkey) AS course", "if(s_suppkey % 5 = 0, null, 1 + s_suppkey % 4) AS credits")
    return G.gpa(G.grade_summary(grade_items(t.lineitem)), credits)


@query(
    "grade_distribution",
    with_(GRADES) + """SELECT course, round(median(CASE WHEN graded AND out_of <> 0 THEN 100::DOUBLE * score::DOUBLE / out_of::DOUBLE END), 4) AS median,
coalesce(sum(score) FILTER (graded), 0)::DOUBLE AS banked, coalesce(sum(greatest(out_of - score, 0)) FILTER (graded AND NOT bonus), 0)::DOUBLE AS lost,
coalesce(sum(max_points) FILTER (NOT graded), 0)::DOUBLE AS open FROM grades_items WHERE NOT excluded GROUP BY course""",
)
def grade_distribution(t):
    return G.grade_distribution(grade_items(t.lineitem))


BOOKS = f"""live AS (SELECT l_orderkey, count(*) FILTER (NOT (l_linenumber = 7 OR (l_returnflag = 'R' AND l_linenumber = 1))) AS live FROM lineitem GROUP BY 1),
books AS (SELECT 'BK' || l_orderkey AS course, ([{sql_list(ITEM_NAMES)}])[l_partkey % {len(ITEM_NAMES)} + 1] || ' ' || l_linenumber AS name,
    l_quantity::DECIMAL(12,2) AS max_points, l_quantity::DECIMAL(12,2) AS out_of, round(l_quantity * (1 - l_discount), 2)::DECIMAL(12,2) AS score,
    l_linestatus = 'F' AS graded, l_returnflag = 'R' AND l_linenumber = 1 AS bonus, l_linenumber = 7 AS excluded,
    (CASE WHEN l_orderkey % 3 = 0 THEN l_tax * 100 ELSE round(100::DOUBLE / greatest(live, 1), 2) END)::DECIMAL(12,2) AS weight,
    round(l_quantity * (1 - l_discount), 2)::DECIMAL(12,2) AS weighted_num, l_quantity::DECIMAL(12,2) AS weighted_den
  FROM lineitem JOIN live USING (l_orderkey)),
book_events AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'BK' || l_orderkey AS course,
    ([{sql_list(EVENT_NAMES)}])[(l_partkey + l_suppkey % 2) % {len(EVENT_NAMES)} + 1] || ' ' || l_linenumber AS title, l_shipdate::DATE AS date FROM lineitem)"""
PRICED = """priced AS (SELECT course, weight_sum FROM (SELECT course, sum(weight) AS weight_sum FROM books WHERE NOT excluded AND NOT bonus GROUP BY course)
  WHERE abs(weight_sum - 100) <= 1 AND course IN (SELECT course FROM summary WHERE basis = 'weighted'))"""


def fold(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'),"
        f" '\\b[0-9]{{1,2}}:[0-9]{{2}}\\s*(?:am|pm)?\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    )


def words(x: str) -> str:
    return (
        f"list_filter(string_split({fold(x)}, ' '), lambda w: w <> '' AND NOT list_contains([{RUN_STOP}], w)"
        f" AND (length(w) > 1 OR regexp_matches(w, '[0-9]')))"
    )


def nums(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({fold(x)}, '[0-9]+'), lambda n: n <> regexp_replace(course, '[^0-9]', '', 'g'))))"


# Cover tested by unnesting instead of nested lambdas: count the words of one side that meet none of the other.
PAIRS = f"""bi AS (SELECT *, {words('name')} AS iw, {nums('name')} AS n FROM (SELECT DISTINCT course, name FROM books WHERE NOT excluded)),
be AS (SELECT *, {words('title')} AS ew, {nums('title')} AS n FROM (SELECT DISTINCT course, title FROM book_events)),
cand AS (SELECT bi.course, name, title, iw, ew FROM bi JOIN be ON bi.course = be.course AND bi.n = be.n),
met AS (SELECT course, name, title, x, y, (x = y OR (length(x) >= 2 AND starts_with(y, x)) OR (length(y) >= 2 AND starts_with(x, y))) AS m
  FROM (SELECT course, name, title, x, unnest(ew) AS y FROM (SELECT course, name, title, ew, unnest(iw) AS x FROM cand))),
pairs AS (SELECT course, name, title FROM (SELECT course, name, title, x, bool_or(m) AS ok FROM met GROUP BY ALL) GROUP BY ALL HAVING bool_and(ok)
  UNION SELECT course, name, title FROM (SELECT course, name, title, y, bool_or(m) AS ok FROM met GROUP BY ALL) GROUP BY ALL HAVING bool_and(ok))"""
STAKES = """stakes AS (SELECT e.id, e.course, e.title, e.date, u.item, round_even(u.weight, 1)::DOUBLE AS stake FROM book_events e JOIN (
    SELECT p.course, p.title, count(*) AS hits, max(b.name) AS item, max(b.weight) AS weight FROM pairs p
    JOIN books b ON b.course = p.course AND b.name = p.name AND NOT b.excluded WHERE p.course IN (SELECT course FROM priced)
    GROUP BY p.course, p.title HAVING count(*) = 1 AND max(b.weight) > 0) u ON u.course = e.course AND u.title = e.title)"""
BK = with_(BOOKS, SUMS.format(src="books"), PRICED, PAIRS, STAKES)


def book_items(t):
    """The books as a written table: the view joins, and the operators read items several times."""
    return materialize(books(t.lineitem), "books")


@query("priced_books", BK + "SELECT course, weight_sum::DOUBLE AS weight_sum FROM priced")
def priced_books(t):
    return G.priced_books(book_items(t)).selectExpr("course", "cast(weight_sum AS double) AS weight_sum")


@query("stake_match", BK + "SELECT * FROM stakes")
def stake_match(t):
    return G.stake_match(book_items(t), book_events(t.lineitem))


@query(
    "first_stake",
    BK + "SELECT id, course, item, date, stake, row_number() OVER (PARTITION BY course, item ORDER BY date, id) > 1 AS again FROM stakes",
)
def first_stake(t):
    return G.first_stake(G.stake_match(book_items(t), book_events(t.lineitem)))


@query(
    "undated_stakes",
    BK + """SELECT course, name, round_even(weight, 1)::DOUBLE AS stake FROM books b WHERE NOT excluded AND NOT graded AND NOT bonus AND weight >= 5
AND course IN (SELECT course FROM priced) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.course = b.course AND p.name = b.name)""",
)
def undated_stakes(t):
    return G.undated_stakes(book_items(t), book_events(t.lineitem))


@query(
    "double_dated",
    BK + """SELECT p.course, p.name, count(DISTINCT e.date) AS dates FROM pairs p JOIN book_events e ON e.course = p.course AND e.title = p.title
GROUP BY p.course, p.name HAVING count(DISTINCT e.date) >= 2""",
)
def double_dated(t):
    return G.double_dated(book_items(t), book_events(t.lineitem))


@query(
    "weight_tercile",
    with_(GRADES) + """, d AS (SELECT course, name, coalesce(nullif(max_points, 0), out_of) AS k FROM grades_items WHERE graded AND NOT excluded AND out_of <> 0),
r AS (SELECT course, name, dense_rank() OVER (PARTITION BY course ORDER BY k) AS r, k FROM d),
m AS (SELECT course, max(r) AS n FROM r GROUP BY course)
SELECT course, name, CASE WHEN n <= 1 THEN 5.5 WHEN (r - 1) / (n - 1) < 1 / 3 THEN 4 WHEN (r - 1) / (n - 1) < 2 / 3 THEN 5.5 ELSE 7 END::DOUBLE AS size
FROM r JOIN m USING (course)""",
)
def weight_tercile(t):
    return G.weight_tercile(grade_items(t.lineitem))


DIGEST = """dig AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY pos, name) AS rn, greatest(count(*) OVER (PARTITION BY course) - 14, 0) AS more
  FROM grades_items WHERE graded)"""


@query(
    "digest_capped",
    with_(GRADES, DIGEST) + "SELECT course, rn::INT AS rn, name, score::DOUBLE AS score, out_of::DOUBLE AS out_of, more FROM dig WHERE rn <= 14",
)
def digest_capped(t):
    return G.digest_rows(grade_items(t.lineitem)).selectExpr(
        "course", "rn", "name", "cast(score AS double) AS score", "cast(out_of AS double) AS out_of", "more"
    )


SHORT = "CASE WHEN {0}::VARCHAR LIKE '%.%' THEN rtrim(rtrim({0}::VARCHAR, '0'), '.') ELSE {0}::VARCHAR END"


DIGEST_TEXT = with_(GRADES, SUMS.format(src="grades_items"), DIGEST) + f""", b AS (SELECT course, max(more) AS more,
  string_agg('    graded: ' || left(name, 46) || ' = ' || {SHORT.format('score')} || '/' || {SHORT.format('out_of')}, chr(10) ORDER BY rn) AS body
  FROM dig WHERE rn <= 14 GROUP BY course)
SELECT course, '- ' || course || ': ' || CASE WHEN current_pct IS NULL THEN 'nothing graded yet (' || total_count || ' items in the gradebook)'
  ELSE 'current ' || current_pct || '% (' || basis || '; ' || graded_count || ' of ' || total_count || ' items graded)' END
  || coalesce(chr(10) || body || CASE WHEN more > 0 THEN chr(10) || '    (+' || more || ' more graded items)' ELSE '' END, '') AS text
FROM summary LEFT JOIN b USING (course)"""


@query("grades_digest", DIGEST_TEXT)
def grades_digest(t):
    return G.grades_digest(grade_items(t.lineitem))


@query(
    "grades_digest_all",
    "SELECT CASE WHEN length(x) > 3500 THEN left(x, 3500) || chr(10) || '    (truncated)' ELSE x END AS text FROM (SELECT string_agg(text, chr(10) ORDER BY course) AS x FROM ("
    + DIGEST_TEXT + "))",
)
def grades_digest_all(t):
    return G.grades_digest_all(grade_items(t.lineitem))

"""The SQL twins of the table views, as DuckDB common table expressions."""

from ledgerloom.sources.tables import VOCABULARY, sql_list

DEADLINES = """deadlines0 AS (
  SELECT event_id AS id, 'C' || (user_id % 12) AS course, CAST(props->>'$.k' AS INT) AS k, event_type,
         event_id % 10 = 0 AS all_day,
         CASE WHEN event_id % 10 = 0 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('minute', ts) END AS starts_at
  FROM events),
deadlines AS (
  SELECT id, course, CASE event_type WHEN 'purchase' THEN 'Exam' WHEN 'signup' THEN 'Project'
           WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'Reading' ELSE 'Quiz' END WHEN 'view' THEN 'Class' ELSE 'Signup' END
         || ' ' || (k % 20) || CASE WHEN k % 7 = 0 THEN ', est 1h 10m' WHEN k % 11 = 0 THEN ' (25m)' ELSE '' END AS title, starts_at,
         CASE WHEN id % 3 = 0 THEN starts_at + to_hours(k % 50) END AS ends_at, all_day,
         CASE event_type WHEN 'purchase' THEN 'exam' WHEN 'signup' THEN 'project' WHEN 'click' THEN 'quiz'
              WHEN 'view' THEN 'recurring' ELSE 'admin' END AS kind,
         CASE id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'ics' ELSE 'recurring' END AS source
  FROM deadlines0)"""

TITLES = f"""titles AS (
  SELECT p_partkey AS id, 'FINC' || (300 + p_partkey % 7) AS course,
         ([{sql_list(VOCABULARY)}])[p_partkey % {len(VOCABULARY)} + 1] || ' ' || p_size
         || CASE p_partkey % 5 WHEN 0 THEN ' [self-paced target]' WHEN 1 THEN ', est 1h 10m' WHEN 2 THEN ' (25m)' ELSE '' END
         AS title
  FROM part)"""

GRADES = """grades_items AS (
  SELECT 'S' || l_suppkey AS course, 'Item ' || l_partkey || '-' || l_orderkey || '-' || l_linenumber AS name,
         l_orderkey AS pos,
         l_quantity::DECIMAL(12,2) AS max_points, l_quantity::DECIMAL(12,2) AS out_of,
         round(l_quantity * (1 - l_discount), 2)::DECIMAL(12,2) AS score,
         l_linestatus = 'F' AS graded, l_returnflag = 'R' AND l_linenumber = 1 AS bonus, l_linenumber = 7 AS excluded,
         round(l_tax * 100, 2)::DECIMAL(12,2) AS weight,
         CASE WHEN l_orderkey % 2 <> 0 THEN round(l_quantity * (1 - l_discount), 2)::DECIMAL(12,2) END AS weighted_num,
         CASE WHEN l_orderkey % 2 <> 0 THEN l_quantity::DECIMAL(12,2) END AS weighted_den
  FROM lineitem)"""

CORPUS = """corpus AS (
  SELECT doc_id, source AS collection,
         source || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.html' ELSE '' END AS path,
         TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS mtime, n_chars AS size, text
  FROM documents)"""

VECTORS = """vectors AS (SELECT vec_id AS chunk_id, 'L' || label AS collection, embedding::DOUBLE[] AS e FROM embeddings)"""

PROBES = """dims AS (SELECT label, unnest(generate_series(1, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, dim, avg(x) AS x FROM dims GROUP BY label, dim),
probes0 AS (SELECT label::BIGINT AS question_id, list(x ORDER BY dim) AS v FROM means GROUP BY label),
probes AS (SELECT question_id, list_transform(v, lambda y: y / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12)) AS q
  FROM probes0)"""

MESSAGES = """messages AS (SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

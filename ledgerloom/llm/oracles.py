"""DuckDB twins of the training-data queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op9_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWERED} AS t FROM documents)
WINDOW same AS (PARTITION BY t)"""

ORACLES["op5_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 4)) AS s(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(generate_series(0, 4)) AS s(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(t, '\p{L}+'))::BIGINT AS n_letter_runs
      FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        | CASE WHEN n_symbols > 0.1::DOUBLE * n_words THEN 4 ELSE 0 END
        | CASE WHEN n_dup_lines > 3 AND n_dup_lines > 0.5::DOUBLE * n_lines THEN 8 ELSE 0 END
        | CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END | CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
        | CASE WHEN n_letter_runs < 0.5::DOUBLE * n_words THEN 64 ELSE 0 END AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
       failures = 0 AS kept, failures::BIGINT AS failures FROM f"""

CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of FROM (SELECT 1))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, by the table ``crc_of``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _part(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = " || ".join(map(_part, ("doc_id", "source", "lang", "n_chars")))
_UP = """SELECT {key}, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY {key}, lvl, pos // 8, n"""
_STEPS = """SELECT a.{key}, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.{key} = b.{key} AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.{key}, a.lvl, a.pos"""

ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE c AS MATERIALIZED {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD} || {_part('text')}) AS leaf,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({_HEAD} || {_part(_LOW)}) END AS tampered FROM documents, c),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes(tree, lvl, pos, h, n) AS (SELECT tree, 0::BIGINT, pos, leaf, n FROM p UNION ALL {_UP.format(key='tree', name='nodes')}),
tops AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n_trees FROM nodes WHERE n = 1),
upper(one, lvl, pos, h, n) AS (SELECT 1, 0::BIGINT, place, subroot, n_trees FROM tops UNION ALL {_UP.format(key='one', name='upper')}),
below AS MATERIALIZED ({_STEPS.format(key='tree', name='nodes')}), above AS MATERIALIZED ({_STEPS.format(key='one', name='upper')}),
ladder AS MATERIALIZED (
  SELECT p.tree, p.pos, 0 AS part, b.lvl, b.l, b.r FROM p JOIN below b ON b.tree = p.tree AND b.pos = p.pos // (8 ** b.lvl)::BIGINT
  UNION ALL SELECT p.tree, p.pos, 1, a.lvl, a.l, a.r FROM p JOIN tops t USING (tree) JOIN above a ON a.pos = t.place // (8 ** a.lvl)::BIGINT),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY part, lvl) AS k, count(*) OVER (PARTITION BY tree, pos) AS m FROM ladder),
folds(tree, pos, k, h) AS (SELECT tree, pos, 0::BIGINT, coalesce(tampered, leaf) FROM p
  UNION ALL SELECT f.tree, f.pos, s.k, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1),
proofs AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY k)) AS proof, max(m) AS m FROM steps GROUP BY tree, pos),
root AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT p.doc_id, p.leaf, t.subroot, root.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM p JOIN tops t USING (tree) CROSS JOIN root LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.k = coalesce(q.m, 0)"""

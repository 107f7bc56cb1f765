"""Queries on positions within texts: sentences and entities, clauses and moves, heading paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import extract
from strataloom.operators import positions as P
from strataloom.plans.registry import registry
from strataloom.session import spread, table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)


def pieces_sql(col: str, pattern: str, skipped: str) -> str:
    """Pieces (doc_id, idx, start_pos, end_pos) of a column, with offsets."""
    return f"""SELECT doc_id, i - 1 AS idx, start_pos, start_pos + length(part) AS end_pos, part FROM (SELECT doc_id, i, part,
    (first + coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start_pos
    FROM (SELECT doc_id, i, parts[i] AS part, length(t) - length(ltrim(t, '{skipped}')) AS first
    FROM (SELECT doc_id, coalesce({col}, '') AS t, regexp_extract_all(coalesce({col}, ''), '{pattern}') AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i)))"""


@query(
    f"{extract._SPANS}, s AS ({pieces_sql('abstract_text', P.SENTENCE, '.!?。！？')}) SELECT s.doc_id, s.idx, s.start_pos, s.end_pos, count(*)::INT AS entities, string_agg(e.entity, '|' ORDER BY e.entity) AS names "
    "FROM s JOIN spans e ON s.doc_id = e.doc_id AND s.start_pos <= e.start_pos AND e.start_pos < s.end_pos GROUP BY ALL"
)
def evidence_interval_join(spark, d):
    """JOIN-14: entities of every sentence by position, with the sentence's bounds."""
    return P.entities_by_sentence(spread(table(spark, d, "documents")), "abstract_text")


_MOVES = (("background", 0, 4), ("method", 4, 9), ("result", 12, 16))  # sixteenths of the text; a part is left unclaimed
_MOVE_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS move, {i} AS ord, length(abstract_text) * {a} // 16 AS a, length(abstract_text) * {b} // 16 AS b FROM documents WHERE abstract_text IS NOT NULL" for i, (m, a, b) in enumerate(_MOVES))


@query(
    f"""WITH c AS ({pieces_sql('abstract_text', P.CLAUSE, ',;，；.。!?！？')}), m AS ({_MOVE_ROWS}),
    o AS (SELECT c.doc_id, c.idx, arg_max(move, {{'n': least(b, end_pos) - greatest(a, start_pos), 'o': -ord}}) AS own FROM c JOIN m ON c.doc_id = m.doc_id AND least(b, end_pos) > greatest(a, start_pos) GROUP BY ALL)
    SELECT c.doc_id, c.idx, c.start_pos, c.end_pos, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY c.doc_id ORDER BY c.idx ROWS UNBOUNDED PRECEDING), 'background') AS move, own IS NOT NULL AS claimed
    FROM c LEFT JOIN o ON c.doc_id = o.doc_id AND c.idx = o.idx"""
)
def clause_assignment(spark, d):
    """JOIN-15: clauses of every abstract with the move that overlaps them most (moves by place, for want of a model's)."""
    docs = spread(table(spark, d, "documents").where("abstract_text IS NOT NULL"))
    n = F.char_length("abstract_text")
    at = lambda k: F.floor(n * k / 16).cast("int")
    moves = F.array(*(F.struct(at(a).alias("start_pos"), at(b).alias("end_pos"), F.lit(m).alias("move")) for m, a, b in _MOVES))
    return P.clause_moves(docs, "abstract_text", moves)


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p.replace('(?i)', '(?i)')}') THEN {n}" for n, p in P.LEVELS) + " ELSE 4 END"
_STRIP = "trim({}, chr(32) || chr(9) || chr(13) || chr(10))"
_BEHIND = {1: "-1", 2: "coalesce(p1, -1)", 3: "coalesce(p2, p1, -1)", 4: "coalesce(p3, p2, p1, -1)"}


def _steps() -> str:
    out, last = [], "l"
    for n, behind in _BEHIND.items():
        out.append(f"x{n} AS (SELECT *, (SELECT max(h.start_pos) FROM h WHERE h.doc_id = {last}.doc_id AND h.level = {n} AND h.start_pos <= {last}.start_pos AND h.start_pos > {behind}) AS p{n} FROM {last})")
        last = f"x{n}"
    return ", ".join(out)


@query(
    f"""WITH r AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(content_text, chr(10)) AS lines FROM documents WHERE content_text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS u(i)),
    a AS (SELECT doc_id, {_STRIP.format('line')} AS line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_pos FROM r),
    t AS (SELECT doc_id, start_pos, line, regexp_replace(line, '^#{{1,6}}\\s+', '') AS title FROM a WHERE regexp_matches(line, '{P.HEADING}')),
    h AS (SELECT doc_id, start_pos, title, {_LEVEL} AS level FROM t WHERE NOT (regexp_matches(line, '^#\\s') AND {_LEVEL} = 4 AND NOT regexp_matches(title, '{P.CHAPTER}'))),
    l AS (SELECT doc_id, start_pos FROM a WHERE line <> '' AND doc_id IN (SELECT doc_id FROM h)), {_steps()}
    SELECT x.doc_id, x.start_pos, concat_ws(' / ', h1.title, h2.title, h3.title, h4.title) AS path FROM x4 x
    LEFT JOIN h h1 ON x.doc_id = h1.doc_id AND p1 = h1.start_pos LEFT JOIN h h2 ON x.doc_id = h2.doc_id AND p2 = h2.start_pos
    LEFT JOIN h h3 ON x.doc_id = h3.doc_id AND p3 = h3.start_pos LEFT JOIN h h4 ON x.doc_id = h4.doc_id AND p4 = h4.start_pos WHERE coalesce(p1, p2, p3, p4) IS NOT NULL"""
)
def heading_paths(spark, d):
    """EXT-07, RES-36: the heading path of every line of every content."""
    return P.line_paths(spread(table(spark, d, "documents")), "content_text")

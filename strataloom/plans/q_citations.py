"""Queries on citation forms and evidence rules."""

from __future__ import annotations

from strataloom.operators import citations as C
from strataloom.operators import extract
from strataloom.plans.q_text import sentence_arrays, sents
from strataloom.plans.registry import registry
from strataloom.session import spread, table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

q = lambda p: p.replace("'", "''")
_FLAT = "regexp_replace(t, '\\s+', '', 'g')"
_RESIDUE = (
    f"len(regexp_extract_all({_FLAT}, '\\d{{1,3}}\\.\\d{{3,}}')) >= 2 OR len(regexp_extract_all({_FLAT}, '[\\]］]\\d')) >= 2 OR regexp_matches(t, '\\\\mathrm|\\\\left\\s*\\[|\\\\right\\s*\\]|\\$\\{{') OR (contains({_FLAT}, '一一') AND regexp_matches({_FLAT}, '[\\[［]\\d')) "
    f"OR (len(regexp_extract_all(t, '[\\[［]\\s*\\d+(?:\\s*[-–,，]\\s*\\d+)*\\s*[\\]］]')) >= 5 AND length(t) >= 250) OR regexp_matches({_FLAT}, '(Model|Method|Dataset|Approach|Framework)(Description|Features|Data|Used)')"
)
_NUMBERS = extract._NUM.replace("{m}", "translate(x, '，－–—、', ',---,')")


@query(
    f"""WITH s AS ({sents('text')}), r AS (SELECT doc_id, idx, translate(sentence, '［］０１２３４５６７８９', '[]0123456789') AS t, coalesce(lag(sentence) OVER w, '') AS prev, coalesce(lead(sentence) OVER w, '') AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    m AS (SELECT *, regexp_extract_all(t, '{C.BRACKET}') AS marks, nullif(regexp_extract(t, '{q(C.AUTHOR_YEAR)}'), '') AS ay, nullif(regexp_extract(t, '{q(C.PAREN_AUTHOR_YEAR)}'), '') AS pay, nullif(regexp_extract(t, '{C.ZH_AUTHOR_YEAR}'), '') AS zay, nullif(regexp_extract(t, '{C.PAREN_NUMBER}', 1), '') AS pn FROM r WHERE NOT ({_RESIDUE})),
    f AS (SELECT *, CASE WHEN len(marks) > 0 THEN 'bracket' WHEN ay IS NOT NULL THEN 'author_year' WHEN pay IS NOT NULL THEN 'paren_author_year' WHEN zay IS NOT NULL THEN 'zh_author_year' WHEN pn IS NOT NULL THEN 'paren_number' END AS form FROM m)
    SELECT doc_id, idx, form, CASE form WHEN 'bracket' THEN marks[1] WHEN 'author_year' THEN ay WHEN 'paren_author_year' THEN pay WHEN 'zh_author_year' THEN zay ELSE pn END AS marker, list_sort(list_distinct(flatten(list_transform(marks, lambda x: flatten({_NUMBERS}))))) AS numbers, form <> 'paren_number' AS certain, prev, next FROM f WHERE form IS NOT NULL"""
)
def citation_contexts(spark, d):
    """EXT-01: citation sentences by marker form, with their neighbours."""
    return C.citation_contexts(sentence_arrays(table(spark, d, "documents"), "text"))


_RULES = {
    "rules": [
        {"id": "T1", "axis": "technical", "aliases": ["graph sampler"], "conditional_aliases": [{"term": "sampler", "requires_any": ["graph", "hybrid"]}], "exclude_any": ["survey"], "weight": 1.0},
        {"id": "T2", "axis": "technical", "aliases": ["drift filter", "图采样方法"], "weight": 0.9},
        {"id": "A1", "axis": "application", "aliases": ["sea ice", "glacier melt", "海冰厚度"], "exclude_any": ["noise"], "weight": 0.8},
        {"id": "A2", "axis": "application", "conditional_aliases": [{"term": "yield", "requires_any": ["crop"]}], "weight": 0.7},
    ]
}
_FIELDS = {"title": 0.9, "abstract_text": 0.7, "content_text": 0.6}


def _hits_sql() -> str:
    parts = []
    for r in C.rules_of(_RULES):
        tries = [(a, (), "explicit") for a in r.aliases] + [(t, n, "contextual") for t, n in r.conditional]
        for i, (alias, needs, how) in enumerate(tries):
            for j, (f, w) in enumerate(_FIELDS.items()):
                conf = round(min(0.99, w + (0.06 if needs else 0) + (0.08 if f == "title" else 0)), 6)
                cond = [f"regexp_matches(c, '{C.alias_pattern(alias)}')", f"NOT regexp_matches(c, '{C.NEGATION}')"]
                cond += ["(" + " OR ".join(f"contains(c, '{n}')" for n in needs) + ")"] if needs else []
                cond += [f"NOT contains(c, '{x}')" for x in r.excludes]
                cond += [f"NOT regexp_matches(c, '{C.RELATED_WORK}')", f"regexp_matches(c, '{C.ADOPTION}')"] if r.axis == "technical" and f != "title" else []
                parts.append(f"SELECT doc_id, '{r.id}' AS rule, {i * 10 + j} AS prio, i, '{f}' AS field, '{alias}' AS alias, trim(c) AS clause, {conf}::DOUBLE AS confidence, {r.weight}::DOUBLE AS weight, '{how}' AS derivation FROM cl WHERE f = '{f}' AND {' AND '.join(cond)}")
    return " UNION ALL ".join(parts)


_CL = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS f, i, cs[i] AS c FROM (SELECT doc_id, regexp_extract_all(lower(coalesce({f}, '')), '{C.CLAUSE}') AS cs FROM documents), unnest(range(1, len(cs) + 1)) AS r(i)" for f in _FIELDS)


@query(f"WITH cl AS ({_CL}), h AS ({_hits_sql()}) SELECT doc_id, rule, field, alias, clause, confidence, weight, derivation FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, rule ORDER BY prio, i) = 1")
def evidence_hits(spark, d):
    """RUL-01, RUL-10: evidence by rules: aliases, conditional aliases, clauses, negation, adoption."""
    return C.evidence_hits(spread(table(spark, d, "documents")), C.rules_of(_RULES), _FIELDS)

"""Declarative rule engine on sentences: features, conditions, scores, conflicts, confidence, statistics.

A rule is data; it is compiled to one boolean expression (for Spark and, for the oracle, for SQL), so
that all rules of a library run as columns of a single projection without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOVES = ("background", "purpose", "method", "result", "conclusion")
BASE, LEAST_SUPPORT, LEAST_SOURCES = 0.70, 0.12, 2
# Cue words of the six sentence dimensions, in the languages of the corpus.
CUES = {
    "purpose": "aim|to this end|propose|describe|beschreiben|bewerten|proponemos|presentamos|本文|我们|提案",
    "method": "trained|with a|using|method|method|entrainée|entrenada|mit der reihe|基于|采集|使用|применяется",
    "result": "improves|raises|lowers|halves|reached|reduces|verbessert|senkt|erhöht|mejora|modifie|提高|改善|降低|結果|結果|变化",
    "conclusion": "supports|confirm|bestätigt|conclu|支持了|重复验证|確認した|подтверждает",
}
FEATURE_SQL = {
    **{f"f_{k}": f"CASE WHEN regexp_matches(lower(sentence), '{v}') THEN 1 ELSE 0 END" for k, v in CUES.items()},
    "f_number": "CASE WHEN regexp_matches(sentence, '[0-9]') THEN 1 ELSE 0 END",
    "f_person": "CASE WHEN regexp_matches(lower(sentence), '(^| )(we|our|wir|nous|nuestro) |我们|本研究') THEN 1 ELSE 0 END",
}


@dataclass(frozen=True)
class Rule:
    """Conditions are (kind, argument): any_of, all_of (substrings), pattern, feature, after, before, rel."""

    id: str
    move: str
    action: str  # +score or -score
    weight: float
    needs: tuple[tuple[str, object], ...]
    excludes: tuple[tuple[str, object], ...] = field(default=())

    @property
    def sources(self) -> frozenset[str]:
        return frozenset(k if k != "feature" else f"feature:{a}" for k, a in self.needs)


RULES = (
    Rule("R1", "purpose", "+score", 0.15, (("feature", "f_purpose"), ("rel", (0.0, 0.5)))),
    Rule("R2", "method", "+score", 0.14, (("feature", "f_method"), ("pattern", "[0-9]"))),
    Rule("R3", "result", "+score", 0.18, (("feature", "f_result"), ("feature", "f_number"))),
    Rule("R4", "conclusion", "+score", 0.20, (("feature", "f_conclusion"), ("rel", (0.5, 1.0))), (("before", "method"),)),
    Rule("R5", "background", "-score", 0.16, (("feature", "f_number"), ("any_of", ("%", "percent", "Prozent")))),
    Rule("R6", "result", "+score", 0.10, (("all_of", ("from", "to")), ("after", "method"))),
    Rule("R7", "purpose", "-score", 0.13, (("after", "result"), ("feature", "f_number"))),
)


def rules_of(data: dict) -> tuple[Rule, ...]:
    """RUL-01: typed rules of a parsed rule file (YAML or JSON): a list under ``pattern_rules`` or ``rules``,
    each with id, target_move, action, weight, necessary_conditions and exclusion_conditions. A condition
    has one of any_of, all_of, pattern, dim (a cue dimension), after_move, before_move, or rel_min and
    rel_max. Rules that only ask for a review score nothing and are left out; unknown moves, actions and
    conditions are errors."""

    def condition(c: dict) -> tuple[str, object]:
        if c.get("any_of"):
            return "any_of", tuple(map(str, c["any_of"]))
        if c.get("all_of"):
            return "all_of", tuple(map(str, c["all_of"]))
        if c.get("pattern"):
            return "pattern", str(c["pattern"])
        if f"f_{c.get('dim')}" in FEATURE_SQL:
            return "feature", f"f_{c['dim']}"
        for kind in ("after", "before"):
            if c.get(f"{kind}_move") in MOVES:
                return kind, c[f"{kind}_move"]
        if "rel_min" in c or "rel_max" in c:
            return "rel", (float(c.get("rel_min", 0.0)), float(c.get("rel_max", 1.0)))
        raise ValueError(f"unknown condition {c}")

    out = []
    for r in data.get("pattern_rules") or data.get("rules") or []:
        if r.get("action", "review") == "review":
            continue
        if r["action"] not in ("+score", "-score") or r.get("target_move") not in MOVES:
            raise ValueError(f"unknown action or move in rule {r.get('id')}")
        needs, excludes = (tuple(condition(c) for c in r.get(f"{k}_conditions") or ()) for k in ("necessary", "exclusion"))
        out.append(Rule(str(r["id"]), r["target_move"], r["action"], float(r.get("weight", 0.5)), needs, excludes))
    return tuple(out)


def cue_columns(sentence: Column) -> dict[str, Column]:
    """The six dimensions of a sentence as 0 or 1."""
    low = F.lower(sentence)
    cols = {f"f_{k}": low.rlike(v).cast("int") for k, v in CUES.items()}
    cols["f_number"] = sentence.rlike("[0-9]").cast("int")
    cols["f_person"] = low.rlike("(^| )(we|our|wir|nous|nuestro) |我们|本研究").cast("int")
    return cols


def features(sentences: DataFrame) -> DataFrame:
    """The six dimensions of every sentence as columns."""
    return sentences.withColumns(cue_columns(F.col("sentence")))


def default_label(f: dict[str, Column]) -> Column:
    """Label where no model gives one: the first dimension with a cue."""
    return F.when(f["f_conclusion"] == 1, "conclusion").when(f["f_result"] == 1, "result").when(f["f_method"] == 1, "method").when(f["f_purpose"] == 1, "purpose").otherwise("background")


_LABEL_SQL = "CASE WHEN f_conclusion = 1 THEN 'conclusion' WHEN f_result = 1 THEN 'result' WHEN f_method = 1 THEN 'method' WHEN f_purpose = 1 THEN 'purpose' ELSE 'background' END"


def _condition(kind: str, arg) -> tuple[Column, str]:
    """One condition as a column and as SQL."""
    if kind == "feature":
        return F.col(arg) == 1, f"{arg} = 1"
    if kind == "pattern":
        return F.col("sentence").rlike(arg), f"regexp_matches(sentence, '{arg}')"
    if kind == "rel":
        low, high = arg
        return (F.col("rel") >= low) & (F.col("rel") <= high), f"(rel >= {low} AND rel <= {high})"
    if kind in ("any_of", "all_of"):
        parts = [F.col("sentence").contains(x) for x in arg]
        sql = [f"contains(sentence, '{x}')" for x in arg]
        column = parts[0]
        for p in parts[1:]:
            column = column | p if kind == "any_of" else column & p
        return column, "(" + (" OR " if kind == "any_of" else " AND ").join(sql) + ")"
    if kind == "after":
        return F.col(f"seen_{arg}") == 1, f"seen_{arg} = 1"
    if kind == "before":
        return F.col(f"seen_{arg}") == 0, f"seen_{arg} = 0"
    raise ValueError(f"unknown condition {kind}")


def fires(rule: Rule) -> tuple[Column, str]:
    """All needed conditions hold and no excluding one does."""
    column, sql = F.lit(True), []
    for kind, arg in rule.needs:
        c, s = _condition(kind, arg)
        column, _ = column & c, sql.append(s)
    for kind, arg in rule.excludes:
        c, s = _condition(kind, arg)
        column, _ = column & ~c, sql.append(f"NOT ({s})")
    return column, "(" + " AND ".join(sql) + ")"


def seen_before(docs: DataFrame) -> DataFrame:
    """One row for each sentence of (doc_id, s), an array of sentences: features, label, relative position
    and which moves occurred before. Made within the document's array: nothing is shuffled."""
    labels = docs.withColumn("labels", F.transform("s", lambda x: default_label(cue_columns(x))))
    firsts = labels.select("doc_id", "s", "labels", *(F.array_position("labels", F.lit(m)).alias(f"first_{m}") for m in MOVES))
    rows = firsts.select("doc_id", "labels", F.size("s").alias("n"), *(f"first_{m}" for m in MOVES), F.posexplode("s").alias("idx", "sentence"))
    seen = {f"seen_{m}": ((F.col(f"first_{m}") > 0) & (F.col(f"first_{m}") <= F.col("idx"))).cast("int") for m in MOVES}
    return features(rows).withColumns({"label": F.get("labels", "idx"), "rel": F.col("idx") / F.col("n"), **seen}).drop("labels", *(f"first_{m}" for m in MOVES))


_CONTEXT_SQL = (
    "SELECT *, idx / n::DOUBLE AS rel, " + ", ".join(f"coalesce(max(CASE WHEN label = '{m}' THEN 1 ELSE 0 END) OVER w, 0) AS seen_{m}" for m in MOVES)
    + f" FROM (SELECT *, {_LABEL_SQL} AS label FROM (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in FEATURE_SQL.items())
    + " FROM ({sents}) s0) s1) s2 WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)


def _sum(terms: list[Column], start: float = 0.0) -> Column:
    out = F.lit(start)
    for t in terms:
        out = out + t
    return out


def score(sentences: DataFrame, rules: tuple[Rule, ...], *keep: str) -> DataFrame:
    """One row for each sentence of ``seen_before`` (``keep`` names columns to go with it; ``fired``, an
    array<struct<rule, move, plus>> of the rules that fire, can be one): its label, the moves' scores, suggestion, consensus and conflict.

    A sentence without any firing rule keeps its label's base score; ties go to the earlier move.
    """
    s = sentences.withColumns({f"r_{r.id}": fires(r)[0].cast("int") for r in rules})
    if "fired" in keep:
        s = s.withColumn("fired", F.filter(F.array(*(F.when(F.col(f"r_{r.id}") == 1, F.struct(F.lit(r.id).alias("rule"), F.lit(r.move).alias("move"), F.lit(1 if r.action == "+score" else 0).alias("plus"))) for r in rules)), lambda x: x.isNotNull()))
    totals = {}
    for m in MOVES:
        base = F.when(F.col("label") == m, BASE).otherwise(0.0)
        totals[f"s_{m}"] = F.round(base + _sum([F.col(f"r_{r.id}") * (r.weight if r.action == "+score" else -r.weight) for r in rules if r.move == m]), 3)
        for sign, name in (("+score", "src"), ("-score", "pen")):
            kinds = sorted({k for r in rules if r.move == m and r.action == sign for k in r.sources})
            each = [F.greatest(F.lit(0), *(F.col(f"r_{r.id}") for r in rules if r.move == m and r.action == sign and k in r.sources)) for k in kinds]
            totals[f"{name}_{m}"] = sum(each, F.lit(0)) if each else F.lit(0)
        totals[f"loss_{m}"] = _sum([F.col(f"r_{r.id}") * r.weight for r in rules if r.move == m and r.action == "-score"])
    s = s.withColumns(totals)
    order = lambda skip: F.array(*(F.struct(F.when(F.col("label") == m, -9.0).otherwise(F.col(f"s_{m}")).alias("v") if skip else F.col(f"s_{m}").alias("v"), F.lit(-i).alias("o"), F.lit(m).alias("m"), F.col(f"src_{m}").alias("c")) for i, m in enumerate(MOVES)))
    own = lambda p: F.coalesce(*(F.when(F.col("label") == m, F.col(f"{p}_{m}")) for m in MOVES))
    s = s.withColumns({"top": F.array_max(order(False)), "alt": F.array_max(order(True)), "pen": own("pen"), "loss": own("loss")})
    agreed, against = F.col("alt.c") >= LEAST_SOURCES, F.col("pen") >= LEAST_SOURCES
    conflict = (agreed & (F.col("alt.v") >= LEAST_SUPPORT)) | (against & (F.col("loss") >= LEAST_SUPPORT))
    return s.select("doc_id", "idx", "label", *(f"s_{m}" for m in MOVES), F.when(conflict, F.col("alt.m")).otherwise(F.col("top.m")).alias("suggestion"), (agreed | against).alias("consensus"), conflict.alias("conflict"), *keep)


def scoring_sql(sents: str, rules: tuple[Rule, ...] = RULES) -> str:
    fired = ", ".join(f"CASE WHEN {fires_sql(r)} THEN 1 ELSE 0 END AS r_{r.id}" for r in rules)
    totals = []
    for m in MOVES:
        terms = [f"{'+' if r.action == '+score' else '-'} r_{r.id} * {r.weight}::DOUBLE" for r in rules if r.move == m]
        totals.append(f"round(CASE WHEN label = '{m}' THEN {BASE}::DOUBLE ELSE 0 END {' '.join(terms)}, 3) AS s_{m}")
        for sign, name in (("+score", "src"), ("-score", "pen")):
            kinds = sorted({k for r in rules if r.move == m and r.action == sign for k in r.sources})
            each = ["greatest(0, " + ", ".join(f"r_{r.id}" for r in rules if r.move == m and r.action == sign and k in r.sources) + ")" for k in kinds]
            totals.append(f"{' + '.join(each) or '0'} AS {name}_{m}")
        loss = [f"r_{r.id} * {r.weight}::DOUBLE" for r in rules if r.move == m and r.action == "-score"]
        totals.append(f"{' + '.join(loss) or '0.0::DOUBLE'} AS loss_{m}")
    first = lambda skip: "CASE " + " ".join(
        f"WHEN {'label <> ' + repr(m) + ' AND ' if skip else ''}" + " AND ".join(f"(s_{m} >= s_{x}{' OR label = ' + repr(x) if skip else ''})" for x in MOVES) + f" THEN '{m}'" for m in MOVES
    ) + " END"
    pick = lambda p, on: "CASE " + " ".join(f"WHEN {on} = '{m}' THEN {p}_{m}" for m in MOVES) + " END"
    return (
        f"WITH c AS ({_CONTEXT_SQL.replace('{sents}', sents)}), f AS (SELECT *, {fired} FROM c), t AS (SELECT *, {', '.join(totals)} FROM f), "
        f"a AS (SELECT *, {first(False)} AS topm, {first(True)} AS altm FROM t), "
        f"b AS (SELECT *, {pick('src', 'altm')} >= {LEAST_SOURCES} AS agreed, {pick('pen', 'label')} >= {LEAST_SOURCES} AS against, {pick('s', 'altm')} AS altv, {pick('loss', 'label')} AS loss FROM a), "
        f"e AS (SELECT *, (agreed AND altv >= {LEAST_SUPPORT}) OR (against AND loss >= {LEAST_SUPPORT}) AS conflict FROM b) "
        f"SELECT doc_id, idx, label, {', '.join(f's_{m}' for m in MOVES)}, CASE WHEN conflict THEN altm ELSE topm END AS suggestion, agreed OR against AS consensus, conflict FROM e"
    )


def fires_sql(rule: Rule) -> str:
    def one(kind: str, arg) -> str:
        if kind == "feature":
            return f"{arg} = 1"
        if kind == "pattern":
            return f"regexp_matches(sentence, '{arg}')"
        if kind == "rel":
            return f"(rel >= {arg[0]} AND rel <= {arg[1]})"
        if kind in ("any_of", "all_of"):
            return "(" + (" OR " if kind == "any_of" else " AND ").join(f"contains(sentence, '{x}')" for x in arg) + ")"
        return f"seen_{arg} = {1 if kind == 'after' else 0}"

    return "(" + " AND ".join([one(*c) for c in rule.needs] + [f"NOT ({one(*c)})" for c in rule.excludes]) + ")"


def move_confidence(scored: DataFrame) -> DataFrame:
    """Mean of the clamped score of every suggested move of a document, three decimals."""
    value = F.coalesce(*(F.when(F.col("suggestion") == m, F.col(f"s_{m}")) for m in MOVES))
    return scored.groupBy("doc_id", F.col("suggestion").alias("move")).agg(F.round(F.avg(F.least(F.greatest(value, F.lit(0.05)), F.lit(0.99))), 3).alias("confidence"), F.count("*").alias("sentences"))


def confidence_sql(scoring: str) -> str:
    value = "CASE " + " ".join(f"WHEN suggestion = '{m}' THEN s_{m}" for m in MOVES) + " END"
    return f"SELECT doc_id, suggestion AS move, round(avg(least(greatest({value}, 0.05), 0.99)), 3) AS confidence, count(*) AS sentences FROM ({scoring}) x GROUP BY doc_id, suggestion"


def relabel_tail(scored: DataFrame) -> DataFrame:
    """In the last unbroken run of result sentences, those that sum up become the conclusion."""
    back = Window.partitionBy("doc_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.min((F.col("label") == "result").cast("int")).over(back) == 1
    sums_up = F.lower("sentence").rlike(CUES["conclusion"] + "|overall|although|insgesamt|同时")
    return scored.select("doc_id", "idx", "label", F.when(run & sums_up, "conclusion").otherwise(F.col("label")).alias("final_label"))


def tail_sql(scoring: str) -> str:
    sents = scoring[scoring.index("FROM (SELECT doc_id") + 6 : scoring.index(") s0)")]
    return (
        f"SELECT x.doc_id, x.idx, x.label, CASE WHEN min(CASE WHEN x.label = 'result' THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.idx DESC ROWS UNBOUNDED PRECEDING) = 1 "
        f"AND regexp_matches(lower(s.sentence), '{CUES['conclusion']}|overall|although|insgesamt|同时') THEN 'conclusion' ELSE x.label END AS final_label FROM ({scoring}) x JOIN ({sents}) s ON x.doc_id = s.doc_id AND x.idx = s.idx"
    )


def statistics(scored: DataFrame) -> DataFrame:
    """Firings of every rule, how many agree with the suggestion, net gain and Laplace reliability.
    ``scored``: result of ``score`` that keeps ``fired``."""
    rows = scored.select("suggestion", F.inline("fired"))
    right = ((F.col("suggestion") == F.col("move")) == (F.col("plus") == 1)).cast("long")
    return rows.groupBy("rule").agg(F.count("*").alias("matched"), F.sum(right).alias("correct"), F.sum(1 - right).alias("incorrect"), F.sum(2 * right - 1).alias("net_gain"), F.round((F.sum(right) + 1) / (F.count("*") + 2), 6).alias("reliability"))


def stats_sql(scoring: str, sents: str, rules: tuple[Rule, ...] = RULES) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, idx, '{r.id}' AS rule, '{r.move}' AS move, {1 if r.action == '+score' else 0} AS plus FROM c WHERE {fires_sql(r)}" for r in rules)
    return (
        f"SELECT rule, count(*) AS matched, sum(ok)::BIGINT AS correct, sum(1 - ok)::BIGINT AS incorrect, sum(2 * ok - 1)::BIGINT AS net_gain, round((sum(ok) + 1) / (count(*) + 2)::DOUBLE, 6) AS reliability FROM "
        f"(SELECT f.rule, CASE WHEN (x.suggestion = f.move) = (f.plus = 1) THEN 1 ELSE 0 END AS ok FROM (WITH c AS ({_CONTEXT_SQL.replace('{sents}', sents)}) {parts}) f JOIN ({scoring}) x ON f.doc_id = x.doc_id AND f.idx = x.idx) y GROUP BY rule"
    )


def effective_weight(weight: Column, matched: Column, correct: Column, coverage: Column, stability: Column, cap: float = 0.2) -> Column:
    """RUL-07: the weight up to a cap, times Laplace reliability, coverage and stability."""
    return F.round(F.least(weight, F.lit(cap)) * (correct + 1) / (matched + 2) * F.least(F.lit(1.0), 0.5 + coverage) * stability, 6)

"""Citation sentences of five marker forms, and evidence rules with their clauses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators.checks import residue_line

# Forms of citation markers.
BRACKET = r"\[\s*\d+(?:\s*[-–,，]\s*\d+)*\s*\]"
AUTHOR_YEAR = r"\b[A-Z][a-z]+(?:[-'’][A-Z][a-z]+)?(?:\s+(?:and|&)\s+[A-Z][a-z]+|\s+et\s+al\.?)?\s*\(\s*(?:19|20)\d{2}[a-z]?\s*,?\s*\)"
PAREN_AUTHOR_YEAR = r"\(\s*[A-Z][A-Za-z'’\-]+[^()]{0,80}?\b(?:19|20)\d{2}[a-z]?\s*\)"
ZH_AUTHOR_YEAR = r"[\x{4e00}-\x{9fff}]{2,6}等?\s*[\(（]\s*(?:19|20)\d{2}\s*[\)）]"
PAREN_NUMBER = r"(?s)^.{25,}?(\(\s*\d{1,3}(?:\s*[,;，]\s*\d{1,3})*\s*\))"
# Negation, reports of others' work, and adoption of a technique in a clause.
NEGATION = r"未采用|没有采用|不采用|并未使用|未使用|不是使用|无需|排除|not\s+(?:use|using|employ|adopt)|without\s+(?:using|employing)|was\s+not\s+used"
RELATED_WORK = r"相关工作|已有研究|既往研究|文献\s*\[|他人提出|related\s+work|previous\s+(?:studies|work)|prior\s+work|has\s+been\s+(?:widely\s+)?used"
ADOPTION = r"本文|本研究|我们|提出|采用|使用|利用|构建|建立|设计|训练|开发|实施|we\s+(?:propose|use|employ|adopt|develop|design|train|construct)|this\s+(?:study|paper|work)\s+(?:proposes|uses|employs|adopts|develops)|was\s+(?:used|employed|adopted|developed)"
CLAUSE = "[^。！？!?;；\n]+"


def citation_contexts(docs: DataFrame) -> DataFrame:
    """EXT-01: citation sentences of (doc_id, s), an array of sentences, by the first form that applies:
    bracketed numbers, author and year (three ways of writing), a bracketed number behind the first 25
    characters. The last form is uncertain. Residues of tables are left out; neighbours are blank at the ends."""
    rows = docs.select("doc_id", F.posexplode(T.with_neighbours("s")).alias("idx", "c"))
    s = F.translate("c.item", "［］０１２３４５６７８９", "[]0123456789")
    rows = rows.select("doc_id", "idx", s.alias("t"), F.col("c.before").alias("prev"), F.col("c.after").alias("next")).where(~residue_line(F.col("t")))
    t = F.col("t")
    marks = F.regexp_extract_all(t, F.lit(BRACKET), 0)
    first = lambda p, g=0: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    years = (("author_year", AUTHOR_YEAR), ("paren_author_year", PAREN_AUTHOR_YEAR), ("zh_author_year", ZH_AUTHOR_YEAR))
    found = F.coalesce(
        F.when(F.size(marks) > 0, F.struct(F.lit("bracket").alias("form"), F.element_at(marks, 1).alias("marker"))),
        *(F.when(first(p).isNotNull(), F.struct(F.lit(name).alias("form"), first(p).alias("marker"))) for name, p in years),
        F.when(first(PAREN_NUMBER, 1).isNotNull(), F.struct(F.lit("paren_number").alias("form"), first(PAREN_NUMBER, 1).alias("marker"))),
    )
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(marks, T.expand_markers))))
    out = rows.select("doc_id", "idx", found.alias("f"), numbers.alias("numbers"), "prev", "next").where("f IS NOT NULL")
    return out.select("doc_id", "idx", "f.form", "f.marker", "numbers", (F.col("f.form") != "paren_number").alias("certain"), "prev", "next")


@dataclass(frozen=True)
class EvidenceRule:
    """``aliases`` count by themselves, ``conditional`` ones (term, words of which the clause needs one)
    only where no alias does; a technical rule needs a clause of adoption outside title and keywords."""

    id: str
    axis: str
    name: str
    aliases: tuple[str, ...]
    conditional: tuple[tuple[str, tuple[str, ...]], ...] = ()
    excludes: tuple[str, ...] = ()
    weight: float = 1.0


def rules_of(data: dict) -> tuple[EvidenceRule, ...]:
    """RUL-01: typed rules of a parsed rule file (YAML or JSON): a list under ``rules``; unknown keys are
    passed over, a rule without id or aliases is an error."""
    out = []
    for r in data.get("rules") or []:
        aliases = tuple(map(str, r.get("aliases") or ()))
        conditional = tuple((str(c["term"]), tuple(map(str, c.get("requires_any") or ()))) for c in r.get("conditional_aliases") or () if str(c.get("term") or "").strip())
        if not r.get("id") or not (aliases or conditional):
            raise ValueError(f"a rule needs an id and an alias: {r}")
        out.append(EvidenceRule(str(r["id"]), str(r.get("axis") or "application"), str(r.get("canonical_en") or r["id"]), aliases, conditional, tuple(map(str, r.get("exclude_any") or ())), float(r.get("weight", 1.0))))
    return tuple(out)


def load_rules(path: str) -> tuple[EvidenceRule, ...]:
    """RUL-01: the rules of a file; JSON always, YAML where a parser is installed."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return rules_of(json.loads(text))
    import yaml

    return rules_of(yaml.safe_load(text) or {})


def alias_pattern(alias: str) -> str:
    """A Latin alias as whole words, others anywhere; the mark before it is part of the match."""
    return rf"(^|[^a-z0-9]){alias.lower()}([^a-z0-9]|$)" if alias.isascii() else alias


def _any(clause: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(clause, w)) if words else F.lit(False)


def _good_clause(rule: EvidenceRule, alias: str, requires: tuple[str, ...], field: str, head: bool):
    def good(c: Column) -> Column:
        ok = c.rlike(alias_pattern(alias)) & ~c.rlike(NEGATION)
        if requires:
            ok &= _any(c, requires)
        if rule.excludes:
            ok &= ~_any(c, rule.excludes)
        if rule.axis == "technical" and not head:
            ok &= ~c.rlike(RELATED_WORK) & c.rlike(ADOPTION)
        return ok

    return good


def evidence_hits(docs: DataFrame, rules: tuple[EvidenceRule, ...], fields: dict[str, float], heads: tuple[str, ...] = ("title",)) -> DataFrame:
    """RUL-10: the first hit of every rule in a document: (doc_id, rule, field, alias, clause, confidence,
    weight, derivation). Aliases come in their order, each in the fields' order; a clause with a negation or
    an excluded word is no evidence, one that reports others' work or adopts nothing is none for techniques.
    Confidence is the field's weight, .06 more with a required word, .08 more in a head field, up to .99.

    A field is cut into clauses once; the plan grows with the number of rules and aliases."""
    cut = {f: F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(CLAUSE), 0).alias(f"c_{f}") for f in fields}
    rows = docs.select("doc_id", *cut.values())
    hits = []
    for r in rules:
        tries = [(a, (), "explicit") for a in r.aliases] + [(t, q, "contextual") for t, q in r.conditional]
        found = []
        for alias, requires, how in tries:
            for f, weight in fields.items():
                good = F.filter(f"c_{f}", _good_clause(r, alias, requires, f, f in heads))
                confidence = min(0.99, weight + (0.06 if requires else 0.0) + (0.08 if f in heads else 0.0))
                found.append(F.when(F.size(good) > 0, F.struct(F.lit(r.id).alias("rule"), F.lit(f).alias("field"), F.lit(alias).alias("alias"), F.trim(F.element_at(good, 1)).alias("clause"), F.lit(round(confidence, 6)).alias("confidence"), F.lit(r.weight).alias("weight"), F.lit(how).alias("derivation"))))
        hits.append(F.coalesce(*found) if len(found) > 1 else found[0])
    return rows.select("doc_id", F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))

"""Positions within a text: its pieces with their offsets, clauses and moves, headings and their paths.

Everything here happens within one row: pieces, spans and headings of a text are arrays of that row, so
no text is shuffled and a long text costs no one but itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.extract import LEXICON, lexicon_spans

SENTENCE = "[^.!?。！？]+[.!?。！？]*"
BLANKS = " \t\r\n"
CLAUSE = "[^,;，；.。!?！？]+[,;，；.。!?！？]*"
# Headings that stand outside the numbered order, and the forms of section numbers.
OUTSIDE = "references|bibliography|acknowledg|abstract|keywords|参考文献|致谢|摘要|关键词"
LEVELS = ((1, rf"(?i)^(?:{OUTSIDE})|^（[一二三四五六七八九十]+）"), (2, r"^\d+[．.](?:\D|$)"), (3, r"^\d+\.\d+"))
HEADING, CHAPTER = r"^(?:#{1,6}\s+\S|（[一二三四五六七八九十]+）)", r"^第[一二三四五六七八九十百千\d]+[章节部分条篇]"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once within ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column, pattern: str, skipped: str) -> Column:
    """Pieces of a text that a pattern cuts without gaps: array<struct<start_pos, end_pos, part>>.
    ``skipped``: a pattern of what may stand before the first piece. Null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    first = F.char_length(t) - F.char_length(F.regexp_replace(t, f"^{skipped}", ""))
    start = F.struct(first.alias("at"), F.array().cast("array<struct<start_pos:int,end_pos:int,part:string>>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.char_length(p)
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start_pos"), end.alias("end_pos"), p.alias("part"))).alias("out"))

    return F.aggregate(F.regexp_extract_all(t, F.lit(pattern), 0), start, add, lambda acc: acc["out"])


def entities_by_sentence(docs: DataFrame, col: str, lexicon=LEXICON) -> DataFrame:
    """JOIN-14: for every sentence the entities whose first character lies within its bounds."""
    rows = lexicon_spans(docs, col, lexicon).select("doc_id", "spans", F.posexplode(pieces(F.col(col), SENTENCE, "[.!?。！？]+")).alias("idx", "s"))
    within = F.filter("spans", lambda x: (x["start_pos"] >= F.col("s.start_pos")) & (x["start_pos"] < F.col("s.end_pos")))
    found = rows.select("doc_id", "idx", "s.start_pos", "s.end_pos", within.alias("found")).where(F.size("found") > 0)
    return found.select("doc_id", "idx", "start_pos", "end_pos", F.size("found").alias("entities"), F.array_join(F.array_sort(F.transform("found", lambda x: x["entity"])), "|").alias("names"))


def clause_moves(docs: DataFrame, col: str, moves: Column) -> DataFrame:
    """JOIN-15: every clause with the move that overlaps it most (ties to the earlier move). A clause no
    move claims continues the clause before it, one before all others the first move.

    ``moves``: array<struct<start_pos, end_pos, move>> in order; a text without moves gives no rows.
    """

    def owner(c: Column, ms: Column) -> Column:
        shared = lambda m: F.least(m["end_pos"], c["end_pos"]) - F.greatest(m["start_pos"], c["start_pos"])
        claims = F.filter(F.transform(ms, lambda m, i: F.struct(shared(m).alias("n"), (-i).alias("o"), m["move"].alias("move"))), lambda x: x["n"] > 0)
        return F.array_max(claims)["move"]

    rows = docs.select("doc_id", pieces(F.col(col), CLAUSE, "[,;，；.。!?！？]+").alias("cs"), moves.alias("ms")).where(F.size("ms") > 0)
    rows = rows.withColumn("own", F.transform("cs", lambda c: owner(c, F.col("ms"))))
    before = lambda i: F.try_element_at(F.filter(F.slice("own", F.lit(1), i + 1), lambda x: x.isNotNull()), F.lit(-1))
    filled = F.transform("cs", lambda c, i: F.struct(i.alias("idx"), c["start_pos"].alias("start_pos"), c["end_pos"].alias("end_pos"), F.coalesce(before(i), F.element_at("ms", 1)["move"]).alias("move"), F.get("own", i).isNotNull().alias("claimed")))
    return rows.select("doc_id", F.inline(filled))


def headings(text: Column) -> Column:
    """Headings of a text: array<struct<start_pos, level, title>>, level 1 to 3 by number, 4 for others.

    Lines that begin with number signs or a bracketed Chinese number; a single number sign before
    anything but a section is the title of the document and no heading.
    """
    strip = lambda p: F.btrim(p, F.lit(BLANKS))
    title = lambda p: F.regexp_replace(strip(p), r"^#{1,6}\s+", "")
    level = lambda t: F.coalesce(*(F.when(t.rlike(p), n) for n, p in LEVELS), F.lit(4))
    lines = pieces(text, r"[^\n]*\n|[^\n]+$", "(?!)")
    is_heading = lambda p: strip(p).rlike(HEADING)
    own_title = lambda p: strip(p).rlike(r"^#\s") & (level(title(p)) == 4) & ~title(p).rlike(CHAPTER)
    kept = F.filter(lines, lambda x: is_heading(x["part"]) & ~own_title(x["part"]))
    return F.transform(kept, lambda x: F.struct(x["start_pos"].alias("start_pos"), level(title(x["part"])).alias("level"), title(x["part"]).alias("title")))


def path_at(heads: Column, at: Column) -> Column:
    """EXT-07, RES-36: path of the headings in force at an offset; empty before the first one.

    The last heading of each level counts unless one of a higher level came after it.
    """
    seen = F.filter(heads, lambda h: h["start_pos"] <= at)

    def last(s: Column, n: int, behind: Column) -> Column:
        return F.try_element_at(F.filter(s, lambda h: (h["level"] == n) & (h["start_pos"] > behind)), F.lit(-1))

    def path(s: Column) -> Column:
        parts, behind = [], F.lit(-1)
        for n in (1, 2, 3, 4):
            h = last(s, n, behind)
            parts.append(h["title"])
            behind = F.coalesce(h["start_pos"], behind)
        return F.concat_ws(" / ", *parts)

    return _let(seen, path)


def line_paths(docs: DataFrame, col: str) -> DataFrame:
    """Every line of text that stands below a heading, with its offset and heading path."""
    rows = docs.select("doc_id", pieces(F.col(col), r"[^\n]*\n|[^\n]+$", "(?!)").alias("lines"), headings(F.col(col)).alias("heads")).where(F.size("heads") > 0)
    at = rows.select("doc_id", "heads", F.explode("lines").alias("l")).where(F.btrim(F.col("l.part"), F.lit(BLANKS)) != "")
    return at.select("doc_id", F.col("l.start_pos").alias("start_pos"), path_at(F.col("heads"), F.col("l.start_pos")).alias("path")).where("path <> ''")

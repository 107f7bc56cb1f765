"""Problem 5: cut oversized items into pieces under a limit, at natural boundaries, with overlap.

A recursive hierarchy of separators (section, paragraph, sentence, word, character) breaks a text
into atoms that fit beside the overlap; atoms are packed greedily. Every piece is within the limit
and, after the first, begins exactly ``overlap`` before the cut (in bytes: at most that, never
inside a character), so the text is rebuilt by dropping each piece's first ``shared`` characters.

A piece that had to end inside a run (of anything but blanks and end marks) carries the size of that run.

Results: null gives no pieces, a text within the limit (also the empty one) gives a single piece;
limits in characters or UTF-8 bytes; a limit must exceed the overlap (ValueError otherwise), and a
character larger than the room beside the overlap still makes a piece of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Where pieces may end. The marks and blanks of RUN are those of the test data's statement.
LEVELS = ("section", "paragraph", "sentence", "word", "char")
ENDS = [
    re.compile(r"\n(?=#{1,6}[ \t]|\d+(?:\.\d+)*\.?[ \t]+\S)"),
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"[.!?。！？;；]+[\"'”’»」』)\]】）]*[ \t\r\n 　]*"),
    re.compile(r"[ \t\n\r 　]+|[.!?。！？;；]"),
]
RUN = re.compile(r"[^ \t\n\r 　.!?。！？;；]+")
PIECES = "array<struct<seq:int,start_pos:int,end_pos:int,shared:int,cut:string,run:int>>"
#: Size profiles sent along with one plan; more of them are cut in several passes.
PROFILES_AT_ONCE = 1000


class Sizes:
    """Sizes of spans of a text in its unit: differences of prefix sums, or of positions where a character counts one."""

    def __init__(self, text: str, unit: str) -> None:
        self.sums = None
        if unit == "bytes" and not text.isascii():
            self.sums = [0, *accumulate(1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in text)]

    def of(self, a: int, b: int) -> int:
        return b - a if self.sums is None else self.sums[b] - self.sums[a]

    def back(self, end: int, size: int) -> int:
        """The least start from which a span to ``end`` is within ``size``."""
        if self.sums is None:
            return max(0, end - size)
        at = bisect_right(self.sums, self.sums[end] - size - 1)
        return min(at, end)

    def ahead(self, start: int, size: int) -> int:
        """The largest end to which a span from ``start`` is within ``size``, at least one character."""
        if self.sums is None:
            return start + max(size, 1)
        return max(start + 1, bisect_right(self.sums, self.sums[start] + size) - 1)


def atoms(text: str, sizes: Sizes, room: int) -> Iterator[tuple[int, int, int]]:
    """Ends of the atoms, their levels and the size of the run they are cut from (0 if none), in order. Each fits into ``room``."""
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if sizes.of(a, b) <= room:
            yield b, max(level - 1, 0), 0
        elif level == len(ENDS):
            first = a
            while first and RUN.match(text, first - 1):  # closing quotes that went with the sentence before
                first -= 1
            run = RUN.match(text, first, b)
            size = sizes.of(*run.span()) if run else 0
            while a < b:
                e = min(b, sizes.ahead(a, room))
                yield e, level if e < b else level - 1, size
                a = e
        else:
            cuts = [m.end() for m in ENDS[level].finditer(text, a, b) if a < m.end() < b]
            bounds = [a, *cuts, b]
            todo.extend((x, y, level + 1) for x, y in zip(bounds[-2::-1], bounds[:0:-1]))


def split_text(text: str, max_size: int, overlap: int, unit: str = "chars") -> list[tuple[int, int, int, int, str, int]]:
    """Pieces (seq, start, end, characters shared with the piece before, kind of cut at the end, size of
    the largest run that is parted within the piece or at its end)."""
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    sizes = Sizes(text, unit)
    if sizes.of(0, len(text)) <= max_size:
        return [(0, 0, len(text), 0, "end", 0)]
    out: list[tuple[int, int, int, int, str, int]] = []
    start = shared = end = 0
    level = run = 0
    for e, lv, r in atoms(text, sizes, max_size - overlap):
        if end > start + shared and sizes.of(start, e) > max_size:
            out.append((len(out), start, end, shared, LEVELS[level], run))
            start = max(sizes.back(end, overlap), start + 1) if overlap else end
            shared = end - start
            run = 0
        end, level, run = e, lv, max(run, r)
    out.append((len(out), start, end, shared, "end", run))
    return out


def _split(texts: pd.Series, limit: pd.Series, overlap: pd.Series, unit: pd.Series) -> pd.Series:
    return pd.Series([split_text(t, int(m), int(o), u) for t, m, o, u in zip(texts, limit, overlap, unit)])


def split_items(df: DataFrame, profiles: list[Row], id_col: str = "doc_id", text_col: str = "content_text", oversized_only: bool = True) -> DataFrame:
    """One row for each item and profile (by default where the item is above the limit): its size and
    its pieces."""
    if len(profiles) > PROFILES_AT_ONCE:
        parts = [profiles[i : i + PROFILES_AT_ONCE] for i in range(0, len(profiles), PROFILES_AT_ONCE)]
        return reduce(DataFrame.unionByName, (split_items(df, p, id_col, text_col, oversized_only) for p in parts))
    each = F.explode(F.array(*(F.struct(*(F.lit(p[c]).alias(c) for c in ("profile_id", "size_unit", "max_size", "overlap_size"))) for p in profiles)))
    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("item"), each.alias("p")).where("item is not null")
    size = F.when(F.col("p.size_unit") == "bytes", F.octet_length("item")).otherwise(F.char_length("item"))
    rows = rows.withColumn("size", size)
    if oversized_only:
        rows = rows.where(F.col("size") > F.col("p.max_size"))
    cut = F.pandas_udf(_split, PIECES)(F.col("item"), F.col("p.max_size"), F.col("p.overlap_size"), F.col("p.size_unit"))
    return rows.select(id_col, "p.profile_id", "p.max_size", "size", cut.alias("pieces"))


def pieces(df: DataFrame, profiles: list[Row], id_col: str = "doc_id", text_col: str = "content_text") -> DataFrame:
    """One row for each piece of each oversized item."""
    return split_items(df, profiles, id_col, text_col).select(id_col, "profile_id", F.inline("pieces"))


def forced_cut() -> Column:
    """Whether an item of ``split_items`` had to be parted inside a run that is itself above the limit."""
    return F.exists("pieces", lambda p: p["run"] > F.col("max_size"))

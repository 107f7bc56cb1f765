"""Problem 1: sentence units of texts in many languages and scripts.

Candidates are closing marks, line ends and, in Thai, spaces. Marks inside a quotation or bracket,
before a lower-case word or within numbers are ruled out by structure; what remains ambiguous (a dot
before a capital, a digit or another script) is classified by a maximum-entropy model with features
of the neighbouring tokens, their case, length, digits and script.

The model is trained on reliable boundaries: dots that end a paragraph, paired with the first token of
the next one. Dots within paragraphs are unlabelled, so the model estimates the chance of a reliable
label, and a dot is a boundary where that chance is above a stated share of the reliable dots' mean.
Other marks, Thai spaces and headings are decided by structure; lines that recur as headings are counted
over all documents.

Results: null and blank texts have no units; a text without any mark is one unit for each paragraph;
positions count code points from 0; texts of any length are cut whole.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm import corpus
from strataloom.llm.confusables import skeleton

#: Largest number of rows the model is fitted on; number of texts that make a line a known heading.
SAMPLE, HEADINGS = 3000, 3
#: A dot is a boundary where its chance of a reliable label is above this share of the reliable dots' mean.
FRACTION = 0.045
#: Occurrences from which a token counts as known.
OFTEN = 12
WIDTH = 1 << 14
UNITS = "array<struct<start_pos:int,end_pos:int>>"
# Closing and opening marks.
OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›"}
CLOSERS = "\"'”’»«“」』)\\]）】›"
HARD = "。！？"
_SIGNS = re.compile("[\"(（)）\\[\\]【】“”„«»「」『』‹›]")
_CANDIDATE = re.compile(rf"[.．!?。！？…]+(?:[   ]?[»])?[{CLOSERS}]*(?:\[\d+(?:\s?[-–,，]\s?\d+)*\]|［\d+］)*")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*|\r\r\s*")
_TOKEN_BACK = re.compile(r"[^\s\"'“”„«»()\[\]（）]+$")
_TOKEN = re.compile(r"[\"'“„«(\[¿¡（「]*(\d[\d.,]*|[^\W\d_]+|[^\s\w])")
_HEADING = re.compile(r"^(?:#{1,6}\s*)?(?:\d{1,2}(?:\.\d{1,2})*[.、]?\s*|[IVX]{1,5}\.\s+|第?[一二三四五六七八九十]{1,3}[章节、.]\s*)?(\S.{0,58})$")
# The same for built-in functions: a paragraph's first line, without its number.
HEADING_LINE = r"(?:^|\n[^\S\n]*\n\s*|\r\n\s*\r\n\s*|\r\r\s*)(?:#{1,6}\s*)?(?:\d{1,2}(?:\.\d{1,2})*[.、]?\s*|[IVX]{1,5}\.\s+|第?[一二三四五六七八九十]{1,3}[章节、.]\s*)?([^\s\r\n][^\r\n]{0,58})(?=\r|\n|$)"
_NUMBERED = re.compile(r"^(?:#{1,6}\s|\d{1,2}(?:\.\d{1,2})*[.、]?\s\s*\D|[IVX]{1,5}\.\s)")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[ \t \n\r]+(?=[฀-๿])")
_ENDS = re.compile(rf"[.．!?。！？…:：;；,，、][{CLOSERS}]*(?:\[\d+\])*$")


def _kind(ch: str) -> str:
    o = ord(ch)
    if ch.isdigit():
        return "9"
    if o < 0x250:
        return "A" if ch.isupper() else "a" if ch.isalpha() else ch
    if 0x400 <= o < 0x530:
        return "R" if ch.isupper() else "r"
    if 0xAC00 <= o < 0xD7B0:
        return "K"
    if 0xE00 <= o < 0xE80:
        return "T"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "C"
    return "A" if ch.isupper() else "a" if ch.isalpha() else "."


def _features(prev: str, nxt: str, known: frozenset[str]) -> list[int]:
    """Places of a candidate's features in the weight vector. Tokens that are not ``known`` (frequent
    in the fitted sample) are represented by their shape only."""
    low = prev.lower()
    n = len(prev)
    shape = "".join(dict.fromkeys(_kind(c) for c in prev[-6:])) + ("." if "." in prev[:-1] else "")
    to = _kind(nxt[0]) if nxt else "$"
    size = str(min(n, 6))
    word = low if low in known else "?"
    names = ("b", "p=" + word, "s=" + shape + size, "n=" + (nxt if nxt in known else "?" + to), "t=" + to, "st=" + shape + to, "pt=" + word + to, f"len={size}{prev[:1].isupper()}{to}", f"1={n == 1 and prev.isalpha()}{to}")
    return [crc32(x.encode()) % WIDTH for x in names]


def _context(text: str, start: int, end: int, nxt_at: int) -> tuple[str, str]:
    reach = 24
    while (back := _TOKEN_BACK.search(text, max(0, start - reach), start)) and 0 < back.start() == start - reach:
        reach *= 2  # a longer token
    ahead = _TOKEN.match(text, nxt_at)
    return _plain(back.group() if back else ""), _plain(ahead.group(1) if ahead else "", True)


def _plain(token: str, ahead: bool = False) -> str:
    """A token without invisible characters and look-alikes; numbers and capitals in one form."""
    if not token.isascii():
        token = skeleton(token)
    if ahead:
        return "0" if token[:1].isdigit() else token.capitalize() if token.isupper() else token
    return "00" if token.isdigit() and len(token) > 1 else token


class Model:
    """The fitted weights, the threshold and the lines known to be headings; small and sent with the plan."""

    def __init__(self, weights: np.ndarray, threshold: float, headings: frozenset[str], known: frozenset[str]) -> None:
        self.weights, self.threshold, self.headings, self.known = weights, threshold, headings, known
        self.seen: dict[tuple[str, str], bool] = {}

    def is_boundary(self, prev: str, nxt: str) -> bool:
        key = (prev, nxt)
        known = self.seen.get(key)
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[key] = float(self.weights[_features(prev, nxt, self.known)].sum()) > self.threshold
        return known

    def __getstate__(self):
        return self.weights, self.threshold, self.headings, self.known

    def __setstate__(self, state) -> None:
        self.__init__(*state)


def heading_lines(text: Column) -> Column:
    """First lines of a text's paragraphs that can be headings: short, without an end mark and a number."""
    first = F.regexp_extract_all(text, F.lit(HEADING_LINE), 1)
    return F.transform(F.filter(first, lambda x: ~x.rlike(r"[.．!?。！？…:：;；,，、][\"'”’»“」』)\]）】]*(?:\[\d+\])*\s*$")), lambda x: F.lower(F.trim(x)))


def fit(texts: list[str], headings: frozenset[str] = frozenset(), rounds: int = 100) -> Model:
    """Maximum-entropy weights from reliable (paragraph-ending) and unlabelled dots of ``texts``."""
    pairs: list[tuple[str, str]] = []
    labels: list[int] = []
    for text in texts:
        paragraphs = [p.strip() for p in _BLANK_LINE.split(text) if p and p.strip()]
        for i, p in enumerate(paragraphs):
            for m in re.finditer(rf"[.．][{CLOSERS}]*(?:\[\d+\])*", p):
                at = re.compile(r"\s*").match(p, m.end()).end()
                last = at >= len(p)
                if last and i + 1 == len(paragraphs):
                    continue
                follow = paragraphs[i + 1] if last else p
                at = 0 if last else at
                if last and _HEADING.match(follow.splitlines()[0]) and not _ENDS.search(follow.splitlines()[0]):
                    continue
                prev, (_, nxt) = _context(p, m.start(), m.end(), 0)[0], _context(follow, 0, 0, at)
                if not prev or not nxt or nxt[0] in ",;:" or (_kind(nxt[0]) in "ar" and nxt.islower()):
                    continue
                if not last and at == m.end():  # a missing space is learnt from no reliable dot
                    continue
                pairs.append((prev, nxt))
                labels.append(int(last))
    weights = np.zeros(WIDTH)
    often = Counter(t for prev, nxt in pairs for t in (prev.lower(), nxt))
    known = frozenset(t for t, n in often.items() if n >= OFTEN)
    if not labels or sum(labels) == 0:
        return Model(weights, -1.0, headings, known)  # nothing to learn from: every remaining candidate ends a unit
    x, y = np.array([_features(*p, known) for p in pairs]), np.array(labels, float)
    grad2 = np.full(WIDTH, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-weights[x].sum(1)))
        g = np.bincount(x.ravel(), np.repeat(p - y, x.shape[1]), WIDTH) / len(y) + 1e-6 * weights
        grad2 += g * g
        weights -= 0.5 * g / np.sqrt(grad2)
    p = 1 / (1 + np.exp(-weights[x].sum(1)))
    half = float(p[y == 1].mean()) * FRACTION
    return Model(weights, float(np.log(half / (1 - half))), headings, known)


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a paragraph, as (opening, behind closing).

    A stack over the whole paragraph: a closing sign ends the last opening one it fits, and those opened
    in between and never closed are dropped. Straight quotes, and guillemets that stand the other way
    round, open where a blank precedes them.
    """
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []  # closing signs awaited, and where they were opened
    for m in _SIGNS.finditer(text, a, b):
        ch, i = m.group(), m.start()
        fits = next((k for k in range(len(stack) - 1, -1, -1) if ch in stack[k][0]), -1)
        before = text[i - 1] if i > a else " "
        after = text[i + 1] if i + 1 < b else " "
        if ch == '"' and fits >= 0 and before.isspace() and not after.isspace():
            del stack[fits:]  # opens anew: the earlier one was never closed
            fits = -1
        if fits >= 0:
            start = stack[fits][1]
            del stack[fits:]
            while out and out[-1][0] > start:
                out.pop()
            out.append((start, i + 1))
        elif ch == "»" and before.isspace() and not after.isspace():
            stack.append(("«", i))
        elif ch in OPEN:
            stack.append((OPEN[ch], i))
        elif ch == '"':
            stack.append((ch, i))
    return out


def _goes_on(text: str, mark: str, end: int, b: int, model: Model, start: int) -> bool:
    """Whether the sentence goes on behind a closing mark (with its closers) that ends at ``end``."""
    at = end
    while at < b and text[at].isspace():
        at += 1
    if at >= b:
        return False
    gap = at > end
    ch = text[at]
    kind = _kind(ch)
    closed = mark[-1] in CLOSERS.replace("\\", "") and mark[-1] not in "])）"
    body = mark.rstrip(CLOSERS.replace("\\", "")) or mark
    if ch in ",;:，；：、)）]】%/@" or (ch in "-–" and not gap):
        return True
    if "…" in body or "..." in body:
        return kind in "arTKC9" or (not gap and kind != "A")
    if kind in "ar" and (not gap or _context(text, end, end, at)[1].islower()):  # not so pH or mRNA
        return True
    if any(c in HARD for c in body):
        if not closed:
            return False
        return ch in "とという的" or ("。" not in body and not gap and kind in "CKaT")
    if "!" in body or "?" in body:
        return bool(closed and not gap and kind in "KC")
    prev, nxt = _context(text, start, end, at)
    if not gap and (kind == "9" or (prev and kind in "Aa" and prev[-1].isdigit() and len(prev) < 4)):
        return True
    if not prev:
        return False
    if "://" in prev or prev.startswith("www.") and not gap:
        return not gap
    return not model.is_boundary(prev, nxt)


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """Positions (start, end) of the sentence units of a text, in order."""
    cuts: list[int] = []
    a = 0
    ends = [m.span() for m in _BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for e, nxt in ends:
        _paragraph(text, a, e, model, cuts)
        cuts.append(nxt)
        a = nxt
    out = []
    a = 0
    for c in cuts:
        s, e = a, c
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
        a = c
    return out


def _heading(line: str, model: Model, before: str, after: str) -> bool:
    """Whether a line stands for itself: short, without an end mark, numbered or known as a heading."""
    if not line.isascii():
        line = skeleton(line)
    m = _HEADING.match(line)
    if not m or _ENDS.search(line) or not after:
        return False
    known = m.group(1).strip().lower() in model.headings
    if before and not re.search(rf"[.．!?。！？…][{CLOSERS}]*(?:\[\d+\])*$", before):
        return known and bool(_NUMBERED.match(line))
    return known or (bool(_NUMBERED.match(line)) and len(line) <= 40 and _kind(after[0]) not in "ar")


def _paragraph(text: str, a: int, b: int, model: Model, cuts: list[int]) -> None:
    if "\n" in text[a:b] or "\r" in text[a:b]:
        lines = [(m.start(), m.end()) for m in re.compile(r"[^\r\n]+").finditer(text, a, b)]
        start = a
        for n, (s, e) in enumerate(lines):
            line = text[s:e].strip()
            before = text[lines[n - 1][0] : lines[n - 1][1]].strip() if n else ""
            after = text[lines[n + 1][0] : lines[n + 1][1]].strip() if n + 1 < len(lines) else ""
            if line and _heading(line, model, before, after):
                if s > start:
                    _sentences(text, start, s, model, cuts)
                    cuts.append(s)
                cuts.append(e)
                start = e
        _sentences(text, start, b, model, cuts)
    else:
        _sentences(text, a, b, model, cuts)


def _sentences(text: str, a: int, b: int, model: Model, cuts: list[int]) -> None:
    spans = _spans(text, a, b)
    found: list[int] = []
    k = 0
    at = a
    while m := _CANDIDATE.search(text, at, b):
        at = m.end()
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.start():
            # Inside a quotation or bracket: only a mark right before its closing sign can end a unit.
            s, e = spans[k]
            if m.end() < e:
                continue
            if text[e - 1] in ")]）】" and text[a:s].strip() and not re.search(rf"[.．!?。！？…][{CLOSERS}]*(?:\[\d+\])*\s*$", text[a:s]):
                continue  # a bracket within a sentence
        if not _goes_on(text, m.group(), m.end(), b, model, m.start()):
            found.append(m.end())
    if any("฀" <= c <= "๿" for c in text[a:b]):
        k = 0
        for m in _THAI_GAP.finditer(text, a, b):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k == len(spans) or spans[k][0] > m.start():
                found.append(m.end())
        found.sort()
    cuts.extend(found)


def fit_on(df: DataFrame, *columns: str, limit: int = SAMPLE) -> Model:
    """The model fitted on the texts of at most ``limit`` rows; headings are counted over all rows."""
    known = corpus.recurring(df, list(columns), heading_lines(F.col("text")), HEADINGS)
    rows = corpus.sampled(df, limit, *columns)
    return fit([v for r in rows for v in r if v], frozenset(map(skeleton, known)))


def cut(text: Column, model: Model) -> Column:
    """Array of the units' positions of a text."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: units(v, model) if v else [])

    return F.pandas_udf(run, UNITS)(text)


def sentence_units(df: DataFrame, fields: list[str], model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row for each unit: id, field_name, start_pos, end_pos."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)))
    rows = df.select(id_col, each.alias("v")).select(id_col, "v.*").where("value is not null and value <> ''")
    return rows.select(id_col, "field_name", F.explode(cut(F.col("value"), model)).alias("u")).select(id_col, "field_name", "u.*")

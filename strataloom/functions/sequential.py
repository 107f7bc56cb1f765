"""Functions that need a scan with state, in plain Python, and the column functions made of them.

Each is an Arrow-batched UDF; null gives null or an empty list.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations before which no English sentence ends, and Chinese marks.
ABBREVIATIONS = frozenset("al etc e.g i.e fig figs eq eqs ref refs vs dr mr mrs prof no vol pp sec ch approx cf st inc ltd".split())
ZH_END, ZH_OPEN, ZH_CLOSE = "。！？；", "“「『（《", "”」』）》"


def split_chinese(text: str) -> list[str]:
    """STR-04: cut after closing marks outside quotations; marks that follow each other stay together."""
    out, start, depth, i = [], 0, 0, 0
    while i < len(text):
        ch = text[i]
        if ch in ZH_OPEN:
            depth += 1
        elif ch in ZH_CLOSE:
            depth = max(0, depth - 1)
        elif ch in ZH_END and not depth:
            while i + 1 < len(text) and text[i + 1] in ZH_END + ZH_CLOSE:
                i += 1
            out.append(text[start : i + 1])
            start = i + 1
        i += 1
    out.append(text[start:])
    return [s.strip() for s in out if s.strip()]


def split_english(text: str) -> list[str]:
    """STR-05: cut at . ! ? before a blank, but not after abbreviations or single letters, within
    decimals, or before a lower-case word."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s)", text):
        word = re.search(r"([A-Za-z][A-Za-z.]*)$", text[start : m.start()])
        after = text[m.end() :].lstrip()
        if m.group()[0] == "." and word and (word.group(1).lower() in ABBREVIATIONS or len(word.group(1)) == 1):
            continue
        if after[:1].islower():
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    out.append(text[start:].strip())
    return [s for s in out if s]


def lcs_length(a: str, b: str) -> int:
    """STR-09: length of the longest common subsequence of characters."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def find_fuzzy(needle: str, text: str, least: float = 0.86) -> int:
    """STR-10, STR-11: place of a quotation: exact, blanks ignored, or the best window of enough similarity; -1 without one."""
    if not needle or not text:
        return -1
    at = text.find(needle)
    if at >= 0:
        return at
    kept = [(i, c) for i, c in enumerate(text) if not c.isspace()]
    at = "".join(c for _, c in kept).find(re.sub(r"\s+", "", needle))
    if at >= 0:
        return kept[at][0]
    n, best, where = len(needle), least, -1
    for i in _likely_starts(needle, text):
        m = SequenceMatcher(None, needle, text[i : i + n], autojunk=False)
        if m.quick_ratio() >= best and (r := m.ratio()) >= best and (r > best or where < 0):
            best, where = r, i
    return where


def _likely_starts(needle: str, text: str) -> list[int]:
    """Starts of windows that share letter sequences with the needle: a near copy shares most of them, at
    offsets that differ by no more than its insertions and deletions. Each such start is tried."""
    size = max(1, min(4, len(needle) // 8))
    starts: Counter = Counter()
    for j in range(len(needle) - size + 1):
        at = text.find(needle[j : j + size])
        while at >= 0:
            starts[max(0, min(at - j, len(text) - 1))] += 1
            at = text.find(needle[j : j + size], at + 1)
    near: Counter = Counter()  # sequences shared by starts close together
    width = max(1, len(needle) // 8)
    for s, c in starts.items():
        near[s // width] += c
    enough = 0.3 * (len(needle) - size + 1)
    return sorted(s for s in starts if near[s // width] + near[s // width - 1] + near[s // width + 1] >= enough)


def clip(text: str, size: int) -> str:
    """STR-22: at most ``size`` characters, cut at a word end, with brackets closed or their opening dropped."""
    if len(text) > size:
        cut = text[:size]
        at = cut.rfind(" ")
        text = cut[:at] if at > size // 2 else cut
    for a, b in ("()", "[]", "（）"):
        if text.count(a) > text.count(b):
            text = text[: text.rfind(a)]
    return text.rstrip(" ,;:，；：")


def repair_json(text: str) -> str | None:
    """JSON-02, JSON-03: fence stripped, trailing commas and single quotes mended, open strings and
    brackets closed; null where nothing helps."""
    t = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    for candidate in (t, re.sub(r",\s*([}\]])", r"\1", t), re.sub(r",\s*([}\]])", r"\1", t.replace("'", '"'))):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False, sort_keys=True)
        except ValueError:
            pass
    stack, quoted, escaped = [], False, False
    for ch in t:
        if quoted:
            escaped, quoted = ch == "\\" and not escaped, not (ch == '"' and not escaped)
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    closed = (t.rstrip("\\") + '"' if quoted else t).rstrip().rstrip(",")
    tail = "".join(reversed(stack))
    for c in (closed + tail, closed + ": null" + tail, re.sub(r',?\s*"[^"]*"?\s*:?\s*$', "", closed) + tail):
        try:
            return json.dumps(json.loads(c), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def chunk_paragraphs(text: str, size: int) -> list[str]:
    """PRJ-04: paragraphs packed greedily up to a size; a longer one stands alone."""
    out: list[str] = []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if out and len(out[-1]) + 2 + len(p) <= size:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def sections(text: str) -> list[tuple[str, int, str]]:
    """SRC-09: sections (heading, level, body) of a paper by numbered, Markdown or named headings."""
    head = re.compile(r"^(?:(#{1,4})\s+(.{1,80})|(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+([^\s\d].{0,78})|(abstract|introduction|methods?|results|discussion|conclusions?|references|摘要|引言|方法|材料与方法|结果|讨论|结论|参考文献))\s*$", re.I)
    out: list[list] = [["", 0, []]]
    for line in text.splitlines():
        m = head.match(line.strip())
        if m and not re.search(r"[.!?。！？,，]$", line.strip()):
            level = len(m.group(1)) if m.group(1) else m.group(3).count(".") + 1 if m.group(3) else 1
            out.append([(m.group(2) or m.group(4) or m.group(5)).strip(), level, []])
        else:
            out[-1][2].append(line)
    return [(h, lv, "\n".join(b).strip()) for h, lv, b in out if h or any(x.strip() for x in b)]


def docx_text(content: bytes) -> str | None:
    """SRC-05: paragraphs of a DOCX file; null where it is none."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))


def xlsx_text(content: bytes) -> str | None:
    """SRC-04: cells of an XLSX file, tab-joined rows under a heading for each sheet; null where it is none."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
            out = []
            for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                out.append(f"# {name[14:-4]}")
                for row in ElementTree.fromstring(z.read(name)).iter(f"{ns}row"):
                    cells = []
                    for c in row.iter(f"{ns}c"):
                        v = c.find(f"{ns}v")
                        text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if v is None else v.text or ""
                        cells.append(shared[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text)
                    out.append("\t".join(cells))
            return "\n".join(out)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def drop_substrings(items: list[str]) -> list[str]:
    """SET-06: of items that contain each other the shorter one is kept, in order of first place."""
    kept: list[str] = []
    for x in items:
        if any(k in x for k in kept):
            continue
        kept = [k for k in kept if x not in k] + [x]
    return kept


def longest_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """SET-17: spans without overlap, by start and then the longest."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def udf(f: Callable, kind: str, *columns: Column) -> Column:
    """A function of scalars as an Arrow-batched column function; a null argument gives null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*series)], dtype=object)

    def of_one(a: pd.Series) -> pd.Series:
        return run(a)

    def of_two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(of_one if len(columns) == 1 else of_two, kind)(*columns)

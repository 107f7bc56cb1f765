"""Sequential functions on the text of papers: references, abstracts, citation spans, definitions, JSON."""

from __future__ import annotations

import json
import re

REFERENCES = re.compile(r"(?im)^\s*(?:\d+\.?\s*)?(?:references|bibliography|literature cited|参考文献|literatur(?:verzeichnis)?|références|referencias|referências)\s*[:：]?\s*$")
MARKER = re.compile(r"\[\d+(?:\s*[-–,，]\s*\d+)*\]")


def join_wrapped(text: str) -> str:
    """STR-08, RES-18: hard-wrapped lines joined, metadata lines (addresses, identifiers, dates) dropped."""
    out: list[str] = []
    for line in (x.strip() for x in text.splitlines()):
        if re.match(r"(?i)^(?:doi|issn|received|accepted|e-?mail|https?://|copyright|©)\b", line):
            continue
        if line and out and out[-1] and not re.search(r"[.!?。！？:：]$", out[-1]):
            wide = re.search(r"[㐀-鿿]$", out[-1]) and re.match(r"[㐀-鿿]", line)
            out[-1] = out[-1][:-1] + line if out[-1].endswith("-") and line[0].islower() else out[-1] + ("" if wide else " ") + line
        else:
            out.append(line)
    return "\n".join(x for x in out if x)


def reference_entries(text: str) -> list[str]:
    """EXT-03: entries of the section of references, split at their numbers, else at line ends."""
    m = REFERENCES.search(text)
    if not m:
        return []
    body = text[m.end() :].strip()
    parts = re.split(r"(?m)^\s*(?:\[\d+\]|\d+\.)\s+", body)
    if len(parts) > 2:
        return [re.sub(r"\s+", " ", p).strip() for p in parts if p.strip()]
    return [p.strip() for p in body.splitlines() if p.strip()]


def valid_markers(text: str) -> list[int]:
    """EXT-02: numbers cited in the body that the list of references holds, in order of mention. A range
    is cut to the list's numbers before it is expanded, so that its width costs nothing."""
    entries = len(reference_entries(text))
    body = REFERENCES.split(text, 1)[0]
    out: dict[int, None] = {}
    for m in MARKER.finditer(body):
        for a, b in re.findall(r"(\d+)(?:\s*[-–]\s*(\d+))?", m.group()):
            out.update(dict.fromkeys(range(max(1, int(a)), min(int(b or a), entries) + 1)))
    return list(out)


def find_abstract(text: str) -> str:
    """EXT-04: the abstract under its heading, else the best early paragraph by length and cues."""
    m = re.search(r"(?is)(?:^|\n)\s*(?:abstract|summary|摘\s*要|zusammenfassung|résumé|resumen|resumo)\s*[:：.\n—-]\s*(.+?)(?=\n\s*\n|\n\s*(?:key ?words|index terms|关键词|1\.?\s+introduction|introduction|引言)|$)", text)
    if m:
        return m.group(1).strip()
    best, score = "", 0.0
    for i, p in enumerate(p.strip() for p in re.split(r"\n\s*\n", text)):
        s = min(len(p), 1500) / 1500 + 0.2 * len(re.findall(r"(?i)\b(?:we|this paper|study|results?)\b|本文|结果", p)) - 0.05 * i
        if len(p) >= 80 and s > score:
            best, score = p, s
    return best


def locate_definition(needle: str, text: str) -> int:
    """RES-15: offset of a definition: exact, without line ends, without punctuation (six or more
    characters), or by its first half; -1 without one."""
    for drop in ("", r"[\r\n]", r"[\W_]"):
        kept = [(i, c) for i, c in enumerate(text) if not drop or not re.match(drop, c)]
        flat = "".join(c for _, c in kept)
        part = re.sub(drop, "", needle) if drop else needle
        if part and (len(part) >= 6 or not drop):
            at = flat.find(part)
            if at < 0 and drop == r"[\W_]" and len(part) >= 12:
                at = flat.find(part[: len(part) // 2])
            if at >= 0:
                return kept[at][0]
    return -1


def excerpts(text: str, cues: list[str], head: int = 2600, before: int = 420, after: int = 980, cap: int = 12000) -> list[tuple[int, int]]:
    """RES-25: the beginning and windows around cues, one for each 300 characters, up to a total size."""
    out, used, size = [(0, min(head, len(text)))], {0}, min(head, len(text))
    for at in sorted(m.start() for c in cues for m in re.finditer(re.escape(c), text, re.I)):
        a, b = max(0, at - before), min(len(text), at + after)
        if at >= head and at // 300 not in used and size + b - a <= cap:
            used.add(at // 300)
            out.append((a, b))
            size += b - a
    return out


def flatten_json(raw: str) -> list[tuple[str, str]]:
    """JSON-04: paths and values of a JSON text; nothing for text that is none."""
    try:
        todo = [("$", json.loads(raw))]
    except ValueError:
        return []
    out = []
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{path}.{k}", x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            todo.extend((f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v))))
        else:
            out.append((path, "" if v is None else str(v)))
    return out


def fused_label(a: str, b: str, longest: int = 24) -> str | None:
    """LAB-02, RES-41: two labels as one: overlap merged, containment kept, shared wording factored;
    null where they are forms of one word or the result is too long."""
    if a in b or b in a:
        return max(a, b, key=len)
    same = next((n for n in range(min(len(a), len(b)), 0, -1) if a[:n] == b[:n]), 0)
    if same >= 0.6 * min(len(a), len(b)):
        return None
    over = next((n for n in range(min(len(a), len(b)), 1, -1) if a.endswith(b[:n])), 0)
    if over:
        out = a + b[over:]
    else:
        x, y = a.split(" "), b.split(" ")
        out = f"{' '.join(x[:-1])} and {b}" if len(x) > 1 and len(y) > 1 and x[-1] == y[-1] else f"{a} and {b}"
    return out if len(out) <= longest * 2 else None


def heading_chunks(text: str, size: int) -> list[str]:
    """EXT-13: chunks that begin at headings and stay within a size; longer sections are packed by paragraph."""
    from strataloom.functions.sequential import chunk_paragraphs, sections

    out: list[str] = []
    for heading, _, body in sections(text):
        part = f"{heading}\n{body}".strip()
        for piece in [part] if len(part) <= size else chunk_paragraphs(part, size):
            if out and len(out[-1]) + 1 + len(piece) <= size // 2:
                out[-1] += "\n" + piece
            else:
                out.append(piece)
    return out


# Sections that a fund proposal needs, and how their headings begin.
FUND_SECTIONS = {"basis": r"立项依据|研究背景|background|rationale", "aims": r"研究目标|研究内容|aims|objectives", "plan": r"研究方案|技术路线|work ?plan|methods", "novelty": r"创新|innovation|novelty", "foundation": r"研究基础|工作条件|foundation|preliminary", "budget": r"经费|budget"}


def fund_sections(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """SRC-10: sections of a fund proposal (kind, body) by their headings, and the kinds that are missing."""
    found: list[list] = []
    for line in text.splitlines():
        head = re.sub(r"^[\s#（(]*(?:[一二三四五六七八九十\d]+[.、)）．\s]*)*", "", line).strip()
        kind = next((k for k, p in FUND_SECTIONS.items() if len(head) <= 40 and re.match(rf"(?i)(?:{p})", head)), None)
        if kind:
            found.append([kind, []])
        elif found:
            found[-1][1].append(line)
    return [(k, "\n".join(b).strip()) for k, b in found], [k for k in FUND_SECTIONS if k not in {x[0] for x in found}]

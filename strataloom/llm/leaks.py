"""Problem 7: corpus documents that contain passages of held-out evaluation items.

Both sides are reduced to letters and digits in one form (look-alikes as in ``confusables``, case
ignored). A passage is an item-sized window: a stated number of letters of the item. Documents are
looked at in shorter windows at content-defined anchors (the least hash among every run of starts that
a passage must contain), items at every start, so that a shared passage always has a shared window.
A window is embedded by CGK random walks, which map edit distance to Hamming distance, and keyed by
sampled positions of each walk (bit-sampling LSH), repeated as often as the target recall needs. Equal
windows collide in every repetition, so unchanged passages are always found. Every candidate is verified
on the text itself: first for an unchanged run, then by banded edit distance of the item-sized window.

The items are the query set: they are sent to the workers in blocks of at most ``BLOCK`` characters,
each block being run against all documents; documents are never shuffled.

Results: documents or items that are null, empty or shorter than the passage match nothing;
repeated rows give one result row; texts of any length are searched whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.confusables import LOOK_ALIKES, skeleton

#: Characters of items sent to the workers at once, and characters of documents searched at once.
BLOCK, STRIDE = 2_000_000, 500_000
#: A passage may hold one edit in so many letters; share of edited passages' windows to be found; sampled positions.
PER_EDIT, RECALL, SAMPLED = 20, 0.9, 12
#: A passage's length for most languages and for those written without spaces.
LENGTHS = {"": 60, "zh": 30, "ja": 30}
_OTHER = re.compile(r"[\W_]+")
_CASE = {ord(k.lower()): v.lower() for k, v in LOOK_ALIKES.items() if k.isupper() and k.lower() not in LOOK_ALIKES}


def reduce_text(text: str) -> str:
    """Letters and digits only, in one form and one case."""
    if text.isascii():
        return _OTHER.sub("", text).lower()
    text = unicodedata.normalize("NFC", skeleton(text)).casefold().translate(_CASE)
    return _OTHER.sub("", text)


class Scheme:
    """Windows and keys for passages of one length with at most ``max_edits`` edits."""

    def __init__(self, length: int, max_edits: int | None = None, recall: float = RECALL, seed: int = 7) -> None:
        self.length, self.window = length, max(4, length * 2 // 3)
        self.max_edits = length // PER_EDIT if max_edits is None else max_edits
        self.starts = length - self.window + 1
        self.steps = 2 * self.window
        # Edits move the walks of two windows apart for about their square in steps (CGK).
        near = -(-self.max_edits * self.window // length)
        hit = (1 - min(0.5, near**2 / self.steps)) ** SAMPLED
        self.reps = 1 if hit >= 1 else ceil(log(1 - recall) / log(1 - hit))
        rng = np.random.default_rng(seed + length)
        self.a = rng.integers(1, 1 << 32, (self.reps, self.steps), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (self.reps, self.steps), dtype=np.uint64).astype(np.uint32)
        self.samples = [sorted(rng.choice(self.steps, min(SAMPLED, self.steps), replace=False).tolist()) for _ in range(self.reps)]

    def anchors(self, codes: np.ndarray) -> np.ndarray:
        """Starts that hold the least hash of some run of ``starts`` successive starts."""
        n = len(codes) - self.window + 1
        if n <= 0:
            return np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(min(8, self.window)):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[j : j + n]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.arange(n, dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | (at & low)
        size = min(self.starts, n)
        span = 1
        while span * 2 <= size:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if size > span:
            key = np.minimum(key[: -(size - span)], key[size - span :])
        first = np.arange(len(key), dtype=np.uint64)
        return np.unique((first + (((key & low) - first) & low)).astype(np.int64))

    def keys(self, codes: np.ndarray, at: np.ndarray, r: int) -> np.ndarray:
        """The key of the window at each start in repetition ``r``."""
        out = np.zeros(len(at), np.uint64)
        chosen = set(self.samples[r])
        for c in range(0, len(at), 8192):  # stays in cache
            base = at[c : c + 8192]
            k = out[c : c + 8192]
            i = np.zeros(len(base), np.int64)
            for j in range(self.samples[r][-1] + 1):
                x = np.where(i < self.window, codes[np.minimum(base + i, len(codes) - 1)], np.uint32(0))
                if j in chosen:
                    k *= np.uint64(0x100000001B3)
                    k += x
                    k ^= k >> np.uint64(31)
                i += (x * self.a[r, j] + self.b[r, j]) >> np.uint32(31)
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """The windows of a block of items: for each repetition sorted keys with their items and starts."""

    def __init__(self, items: list[tuple[int, str, str]], max_edits: int | None = None) -> None:
        by_length: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for item, lang, text in items:
            length = LENGTHS.get((lang or "")[:2].lower(), LENGTHS[""])
            if len(text := reduce_text(text or "")) >= length:
                by_length[length].append((item, text))
        self.parts = []
        for length, own in by_length.items():
            s = Scheme(length, max_edits)
            codes = [_codes(text) for _, text in own]
            starts = [np.arange(len(c) - s.window + 1) for c in codes]
            number = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in starts])
            start = np.concatenate(starts).astype(np.int32)
            tables = []
            for r in range(s.reps):
                keys = np.concatenate([s.keys(c, x, r) for c, x in zip(codes, starts)])
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], number[order], start[order]))
            self.parts.append((s, own, tables))

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, bool]]:
        """(number of the text, item, whether a whole passage is unchanged) of those that share a passage."""
        joined = "\0".join(texts)
        codes = _codes(joined)
        ends = np.cumsum([len(t) + 1 for t in texts])
        for s, own, tables in self.parts:
            at = s.anchors(codes)
            found: dict[tuple[int, int], bool] = {}
            tried: set[tuple[int, int, int]] = set()
            for r, (known, number, start) in enumerate(tables):
                keys = s.keys(codes, at, r)
                first, last = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
                hits = np.flatnonzero(last > first)
                docs = np.searchsorted(ends, at[hits], side="right")
                for h, d in zip(hits.tolist(), docs.tolist()):
                    i = int(at[h])
                    for n, p in zip(number[first[h] : last[h]].tolist(), start[first[h] : last[h]].tolist()):
                        if found.get((d, n)) or (i, n, p) in tried:
                            continue
                        tried.add((i, n, p))
                        if _run(joined, i, own[n][1], p, s.length) >= s.length:
                            found[d, n] = True
                        elif s.max_edits and (d, n) not in found and near_window(joined, i, own[n][1], p, s):
                            found[d, n] = False
            for (d, n), exact in found.items():
                yield d, own[n][0], exact


def _run(a: str, i: int, b: str, j: int, enough: int) -> int:
    """Length of the common run of two texts through two positions, as far as ``enough``."""
    left = 0
    while left < enough and left < i and left < j and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right, most = 0, min(len(a) - i, len(b) - j, enough - left)
    while right < most and a[i + right] == b[j + right]:
        right += 1
    return left + right


def _edits(a: str, b: str, most: int) -> list[int]:
    """For each length of a beginning of ``b``, its least edit distance from a beginning of ``a`` (a
    banded alignment: beyond ``most`` edits the value is ``most`` + 1)."""
    far = most + 1
    row = [min(y, far) for y in range(2 * most + 1)][: most + 1]  # row[y - x + most] for offsets of a against b
    row = [far] * most + row
    out = [0]
    for x in range(1, len(b) + 1):
        new = [far] * (2 * most + 1)
        c = b[x - 1]
        for o in range(2 * most + 1):
            y = x + o - most
            if y < 0 or y > len(a):
                continue
            best = row[o] + (a[y - 1] != c) if y else far  # both go on
            if o < 2 * most:
                best = min(best, row[o + 1] + 1)  # a letter of b alone
            if o and y:
                best = min(best, new[o - 1] + 1)  # a letter of a alone
            new[o] = min(best, far)
        row = new
        out.append(min(row))
        if out[-1] == far:
            out.extend([far] * (len(b) - x))
            break
    return out


def near_window(text: str, i: int, item: str, p: int, s: Scheme) -> bool:
    """Whether an item-sized window of ``item`` over position ``p`` lies within the edit budget of the
    text around position ``i``: edits to the left and to the right of the two positions are added."""
    most, spare = s.max_edits, s.length - s.window
    right = _edits(text[i : i + s.length + most], item[p : p + s.length], most)
    if right[min(s.window, len(right) - 1)] > most:
        return False
    left = _edits(text[max(0, i - spare - most) : i][::-1], item[max(0, p - spare) : p][::-1], most)
    return any(left[a] + right[s.length - a] <= most for a in range(len(left)) if s.length - a < len(right))


def _searcher(index: Index):
    longest = max((s.length + s.max_edits for s, *_ in index.parts), default=0)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple[int, int], bool] = {}
            ids: list[int] = []
            texts: list[str] = []
            size = 0

            def flush() -> None:
                for d, item, exact in index.search(texts):
                    out[ids[d], item] = exact or out.get((ids[d], item), False)
                ids.clear()
                texts.clear()

            for doc, text in zip(batch["doc"].tolist(), batch["text"].tolist()):
                if not text:
                    continue
                text = reduce_text(text)
                for a in range(0, max(1, len(text) - longest + 1), STRIDE):  # parts share a passage's length
                    part = text[a : a + STRIDE + longest]
                    ids.append(doc)
                    texts.append(part)
                    size += len(part)
                    if size >= STRIDE:
                        flush()
                        size = 0
            if texts:
                flush()
                size = 0
            yield pd.DataFrame({"doc_id": [d for d, _ in out], "item_id": [i for _, i in out], "exact": list(out.values())}).astype({"doc_id": "int64", "item_id": "int64", "exact": bool})

    return search


def _blocks(items: DataFrame, id_col: str, lang_col: str, text_col: str) -> Iterator[list[tuple[int, str, str]]]:
    block: list[tuple[int, str, str]] = []
    size = 0
    for r in items.select(id_col, lang_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((r[0], r[1], r[2]))
        size += len(r[2])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", lang_col: str = "lang", item_text: str = "text", max_edits: int | None = None) -> DataFrame:
    """Rows (doc_id, item_id, exact): the document holds a passage of the item with at most
    ``max_edits`` edits (by default one in ``PER_EDIT`` letters); ``exact`` if one is unchanged."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(items, item_col, lang_col, item_text):
        found = docs.mapInPandas(_searcher(Index(block, max_edits)), "doc_id long, item_id long, exact boolean")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, exact boolean")
    return out.groupBy("doc_id", "item_id").agg(F.bool_or("exact").alias("exact"))

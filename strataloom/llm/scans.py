"""Problem 3: repair of text read from scanned pages.

Lines are labelled by a hidden Markov model (states: body, heading, header, page, table, blank) whose
observations are layout features; it is fitted on the lines of all documents, starting from reliable
lines and re-estimated on its own Viterbi labels; lines that recur as running headers and the letters of
words and names are counted over all documents. Header and page lines are dropped, the rest is joined
into paragraphs. Words parted at line ends are joined, misread letters and Chinese or Japanese characters
are corrected: each suspect form and its possible readings are looked up, by a join, in a lexicon of
the words of all documents, and the reading with the best evidence wins.

Results: null and empty fields have no traces and stay as they are; fields without any trace of
scanning come out unchanged in wording; equal traces of one field give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import corpus
from strataloom.session import checkpoint_dir

#: Log evidence that a correction must have over the form as it stands; log likelihood of its letters that
#: a reading which no text holds may lose against the form as it stands.
BAR, LIKELY = 2.0, 0.5
#: Rows to which counts over all rows are brought down (never up), so that the weight of what was not seen
#: and of a common word is the same in a corpus of any size.
UNIT = 3000
#: Log evidence that a capitalised word's reading has at least where a text holds it (names are alike by chance).
HELD = -3.5
#: Texts that make a line a known running header; letters of the shortest word that is examined.
HEADERS, LETTERS = 2, 2
STATES = ("body", "heading", "header", "page", "table", "blank")
KINDS = ("blank", "page", "bare", "row", "tab", "cell", "other")
#: Most lines whose states are found at once; the character that stands for the first of all observations.
AT_ONCE, FIRST = 1 << 17, 0x4E00
# How letters are misread (right, wrong) and look-alike characters of Chinese and Japanese.
MISREAD = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("w", "vv"), ("l", "1"), ("o", "0"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("u", "ii"), ("in", "m"), ("и", "н"), ("н", "и"), ("s", "5"), ("b", "8"), ("i", "l"), ("l", "i"), ("é", "6"), ("t", "l"), ("п", "л"), ("б", "6"), ("ы", "ьl"), ("ы", "ь1"), ("ü", "ii"))
CHARACTERS = ("间问", "土士", "天夭", "大犬", "日曰", "未末", "没设", "已己", "侵浸", "微徽", "入人", "干千", "力刀", "贝见", "ロ口", "カ力", "エ工", "ニ二", "タ夕", "ー一", "ソン", "シツ")
_SUSPECT = re.compile("|".join(sorted({re.escape(wrong) for _, wrong in MISREAD}, key=len)))
_PARTNER: dict[str, str] = {}
for _pair in CHARACTERS:
    _PARTNER.setdefault(_pair[0], "")
    _PARTNER.setdefault(_pair[1], "")
    _PARTNER[_pair[0]] += _pair[1]
    _PARTNER[_pair[1]] += _pair[0]
# Characters within words that no reader sees (a soft hyphen only where it parts nothing).
INVISIBLE = r"[\u200b-\u200d\u2060\ufeff]|\u00ad(?!\s|$)"
_INVISIBLE = re.compile(INVISIBLE)
_MARKS = re.compile(f"[{''.join(_PARTNER)}]")
_MARK = f"[\\u3000-\\u9fff&&[{''.join(_PARTNER)}]]"  # the same in Java; the range first: it is left by one comparison
HYPHENS = "-‐‑­¬"
_LATIN = "A-Za-z0-9À-ÖØ-öø-ɏ"
WORD = rf"[{_LATIN}]+(?:[-'’][{_LATIN}]+)*|[Ѐ-ԯ0-9l]+"
_WORD = re.compile(WORD)
LOWER_WORD = r"[a-z0-9ß-öø-ɏ]++(?:[-'’][a-z0-9ß-öø-ɏ]++)*+|[Ѐ-ԯ0-9l]++"  # the same in lower case, for built-in functions
_NAME = re.compile(r"^[A-ZÀ-Ö\d]?[a-zà-öø-ɏ\d'’-]*(?:[A-Z\d]{1,2}|[A-Z\d][a-z\d]+)?$|^[A-ZÀ-Ö\d]+$|^[Ѐ-ԯ\dl]+$")
# A capitalised word in lower letters, as Python's \b bounds it (Java looks back only where a capital stands).
NAME_WORD = r"[A-Z](?<![\p{L}\p{N}_].)[a-z]{3,}+(?![\p{L}\p{N}_])"
_CODE = frozenset("/+=@_#&")  # beside parts of addresses and encoded data, which are no words
_WIDE = "[\\u3040-\\u30ff\\u3400-\\u9fff]"
_PIECE = rf"[{_LATIN}]+"
_PAGE = re.compile(r"^(?:[-–—]\s*\d{1,4}\s*[-–—]|[\[(]\s*\d{1,4}\s*[\])]|\d{1,4}\s*/\s*\d{1,4}|(?:page|seite|p[áa]gina|стр\.?|p\.|s\.|pag\.)\s*\d{1,4}(?:\s*(?:of|/|de|von|sur|из)\s*\d{1,4})?|第\s*\d{1,4}\s*[页頁](?:\s*[,，/]?\s*共\s*\d+\s*[页頁])?|\d{1,4}\s*(?:ページ|頁|页|쪽)|หน้า\s*\d{1,4})$", re.I)
_BARE = re.compile(r"^\d{1,4}$")
_ROW = re.compile(r"^[-+]?\d[\d.,%]*(?:\s+[-+]?\d[\d.,%]*)+$|^\d+[.,]\d+$")
_TABLE = re.compile(r"^(?:Tab(?:le|elle|leau|la)?\.?|表|Табл(?:ица|\.)|표|ตาราง)\s*\d+\.?$", re.I)
VOLUME = r"vol\.? ?\d+|\d+ ?\(\d+\)"
_VOLUME = re.compile(rf"(?:{VOLUME})(?:\s+\d{{1,4}})?$|^\d{{1,4}}\s{{2,}}\D|\D\s{{2,}}\d{{1,4}}$", re.I)
_PAGED = re.compile(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$")
_AUTHORS = re.compile(r"^[^\W\d_][\w'’-]+ (?i:et al\.?|и др\.|et coll\.|u\. a\.|y col\.|e col\.)$|^[A-Z][A-Z'’-]+ (?:AND|ET|UND|Y|E) [A-Z][A-Z'’-]+$|^[A-Z][\w'’-]+ (?:and|et|und|y|e) [A-Z][\w'’-]+$|^\S{1,12}(?:课题组|等|ほか)$")
_END = re.compile(r"[.!?。！？…:：;；][\"'”’»“」』)\]）】]*(?:\[\d+\])*$")
_LAST = frozenset(".!?。！？…:：;；\"'”’»“」』)]）】")  # what a line with an end mark ends in
_DIGIT, _OTHER = re.compile(r"\d"), re.compile(r"\W+")
_NUMBERED = re.compile(r"^(?:#{1,6}\s|\d{1,2}(?:\.\d{1,2})*[.、]?\s(?=[^\s\d]))")
_MISREAD = re.compile(r"(?<![\w+/=.:@&?#-])(?:[^\W\d_]?[a-zà-öø-ÿ]+[0158][a-zà-öø-ÿ]{2,}|[^\W\d_]?[a-zà-öø-ÿ]*vv[a-zà-öø-ÿ]{2,}|[а-яА-Я]?[а-я]*(?:ь[l1]|[06])[а-я]{2,})(?![\w+/=@-])")
# What any scanned text holds: a parted word, a line of a number, a digit or a doubled letter in place of
# a letter, or a wrapped line (25 characters, 10 of a wide script).
_TRACE = re.compile(rf"[^\W\d_][{HYPHENS}][ \t]*\r?\n|^[^\n]{{0,16}}\d[^\n]{{0,12}}$(?<![.!?。！？])|{_MISREAD.pattern}", re.M)
_WRAPS = re.compile(r"^[^\n]*(?:[^\n]{24}|[^\x00-\u2fff\n]{9})[^\s.!?。！？…:：;；\"'”’»“」』)\]）】]\r?\n(?=\S)", re.M)
FEATURES = ("kind", "end", "short", "volume", "known", "mine", "open", "goes_on", "numbered", "near", "indent")
TRACES = "traces:array<struct<damage:string,base:string>>"
REPAIRED = "text:string,spots:array<struct<at:int,till:int,base:string>>"
OPTIONS = "array<struct<reading:string,option:string,prior:double,must:boolean,own:boolean>>"


# How a running header is reduced to its name: numbers, page number, volume (Java and Python alike).
NAME_RULES = ((r"\d+", "9"), (r"\s+", " "), (r"^9 ", ""), (r" ?(?:vol\.? ?9|9 ?\(9\))?(?: 9)?$", ""))


def _name(line: str) -> str:
    line = line.strip().lower()
    for pattern, to in NAME_RULES:
        line = re.sub(pattern, to, line)
    return line


def header_names(text: Column) -> Column:
    """Names of the lines of a text that end in a volume, with or without page numbers, and no end mark."""
    lines = F.regexp_extract_all(text, F.lit(rf"(?mi)^[ \t]*(\S[^\n]*?(?:{VOLUME})(?:\s+\d{{1,4}})?)[ \t\r]*$"), 1)

    def name(x: Column) -> Column:
        x = F.lower(F.trim(x))
        for pattern, to in NAME_RULES:
            x = F.regexp_replace(x, pattern, to)
        return x

    return F.filter(F.transform(lines, name), lambda x: (F.char_length(x) > 3) & ~x.rlike(_NUMBERED.pattern))


def observe(lines: list[str], title: str, known: frozenset[str]) -> list[tuple]:
    """Layout features of every line of a text."""
    bare = [x.strip() for x in lines]
    kinds = []
    for x in bare:
        kinds.append("blank" if not x else "other" if not _DIGIT.search(x) else "page" if _PAGE.match(x) else "bare" if _BARE.match(x) else "row" if _ROW.match(x) else "tab" if _TABLE.match(x) else "other")
    long = sorted(len(x) for x, k in zip(bare, kinds) if k == "other")
    width = long[len(long) * 3 // 4] if long else 1
    head = _OTHER.sub("", title or "").casefold()
    ends = [x[-1:] in _LAST and bool(_END.search(x)) for x in bare]
    ends = [end and not (x[-1:] == "." and _AUTHORS.match(_PAGED.sub("", x))) for x, end in zip(bare, ends)]  # a name's dot ends nothing
    signs = [_signs(x, head, known) if k == "other" else (False, False, _paged(x) and bool(_VOLUME.search(x))) for x, k in zip(bare, kinds)]
    out = []
    n = len(lines)
    other = [k == "other" and not (mine or is_known or (volume and not end)) for k, (mine, is_known, volume), end in zip(kinds, signs, ends)]
    follow = [""] * n
    ahead = ""
    for i in range(n - 1, -1, -1):
        follow[i] = ahead
        if other[i]:
            ahead = bare[i]
    pages = {i for i, k in enumerate(kinds) if k in ("page", "bare")}
    opened = False  # whether the last line of text has no end mark
    for i, (x, k, end, (mine, is_known, volume)) in enumerate(zip(bare, kinds, ends, signs)):
        if k == "bare" and any(kinds[j] in ("row", "tab") for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < n):
            k = "cell"
        near = bool(pages) and not pages.isdisjoint((i - 3, i - 2, i - 1, i + 1, i + 2, i + 3))
        goes_on = bool(follow[i]) and (follow[i][0].islower() or (opened and not _NUMBERED.match(follow[i])))
        out.append((k, end, len(x) < 0.75 * width, volume, is_known, mine, opened, goes_on, bool(_NUMBERED.match(x)), near, lines[i][:4] == "    "))
        if other[i]:
            opened = not end
    return out


def _paged(line: str) -> bool:
    """Whether a line begins or ends as one with a page number or a volume does."""
    return line[:1].isdigit() or line[-1:].isdigit() or line[-1:] == ")"


def _signs(line: str, head: str, known: frozenset[str]) -> tuple[bool, bool, bool]:
    """Whether a line repeats the beginning of the title or names authors, is a known running header, and has a volume."""
    paged = _paged(line)
    core = _PAGED.sub("", line) if paged else line
    mine = bool(_AUTHORS.match(core))
    if not mine and head and (not core[:1].isalnum() or core[0].casefold() == head[0]):
        flat = _OTHER.sub("", core).casefold()
        mine = len(flat) >= 8 and head.startswith(flat[:-1])
    return mine, (_name(line) if paged else line.lower()) in known, paged and bool(_VOLUME.search(line))


def _seed(o: tuple) -> int:
    """State of a line as far as its features make it reliable; used to start the estimation."""
    k, end, short, volume, known, mine, opened, goes_on, numbered, near, _ = o
    if k == "blank":
        return 5
    if k == "page" or (k == "bare" and (opened or near)):
        return 3
    if k in ("row", "tab", "cell", "bare"):
        return 4
    if not end and (mine or volume or known) and (near or opened) and not numbered:
        return 2
    if numbered and short and not end:
        return 1
    return 0


def encoded(obs: list[tuple]) -> str:
    """Observations as a text of one character each."""
    return "".join([_CODES.get(o) or _CODES.setdefault(o, chr(FIRST + sum(x << j for j, x in enumerate(o[1:])) + (KINDS.index(o[0]) << 10))) for o in obs])


_CODES: dict[tuple, str] = {}


def _decoded(code: int) -> tuple:
    return (KINDS[code >> 10], *(bool(code >> j & 1) for j in range(len(FEATURES) - 1)))


def _codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("utf-32-le"), np.uint32).astype(np.int64) - FIRST


class LineModel:
    """Log probabilities of the hidden Markov model, and the running headers known from all documents."""

    def __init__(self, emit: list[list[dict]], move: np.ndarray, known: frozenset[str]) -> None:
        self.emit, self.move, self.known = emit, move, known
        self.rows = np.full((len(KINDS) << 10, len(STATES)), np.nan)  # by observation, of which there are few

    def __reduce__(self):
        return LineModel, (self.emit, self.move, self.known)

    def labels(self, seqs: list[str]) -> list[np.ndarray]:
        """The likeliest states of the lines of texts (Viterbi); texts of like length are run through at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(seqs)
        order = sorted((i for i, x in enumerate(seqs) if x), key=lambda i: -len(seqs[i]))
        while order:
            some = order[: max(1, AT_ONCE // len(seqs[order[0]]))]
            order = order[len(some) :]
            for i, path in zip(some, self._paths([_codes(seqs[i]) for i in some])):
                out[i] = path
        return out

    def _paths(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """As ``labels``, for sequences from the longest to the shortest."""
        size = np.array([len(x) for x in seqs])
        obs = np.zeros((size[0], len(seqs)), np.int64)
        for i, x in enumerate(seqs):
            obs[: len(x), i] = x
        for o in np.unique(obs):
            if np.isnan(self.rows[o, 0]):
                self.rows[o] = [sum(f.get(v, -9.0) for f, v in zip(self.emit[s], _decoded(int(o)))) for s in range(len(STATES))]
        running = [int(np.searchsorted(-size, -t, "left")) for t in range(size[0])]  # sequences longer than t
        best = self.rows[obs[0]]
        back = np.zeros((size[0], len(seqs), len(STATES)), np.int8)
        for t in range(1, size[0]):
            k = running[t]
            step = best[:k, :, None] + self.move
            back[t, :k] = step.argmax(1)
            best[:k] = step.max(1) + self.rows[obs[t, :k]]
        state = best.argmax(1)
        path = np.zeros(obs.shape, np.int8)
        for t in range(size[0] - 1, -1, -1):
            k = running[t]
            path[t, :k] = state[:k]
            state[:k] = back[t, np.arange(k), state[:k]]
        return [path[:n, i] for i, n in enumerate(size)]


def tallied(seqs: list[str], times: list[int], model: LineModel | None) -> tuple[np.ndarray, np.ndarray]:
    """How often each observation comes in each state, and each state after another, in sequences that
    occur so many times: in the states that ``model`` finds, or without one where lines are reliable."""
    seen = np.zeros((len(STATES), len(KINDS) << 10), np.int64)
    moves = np.zeros((len(STATES), len(STATES)), np.int64)
    found = model.labels(seqs) if model else None
    for i, (seq, n) in enumerate(zip(seqs, times)):
        codes = _codes(seq)
        states = found[i] if model else _SEEDS[codes]
        np.add.at(seen, (states, codes), n)
        np.add.at(moves, (states[:-1], states[1:]), n)
    return seen, moves


_SEEDS = np.array([_seed(_decoded(c)) for c in range(len(KINDS) << 10)], np.int8)


def _estimate(seen: np.ndarray, moves: np.ndarray, known: frozenset[str], scale: float = 1.0) -> LineModel:
    counts = [[Counter() for _ in FEATURES] for _ in STATES]
    for s, o in zip(*seen.nonzero()):
        for c, v in zip(counts[s], _decoded(int(o))):
            c[v] += int(seen[s, o])
    emit = [[{v: math.log((c[v] / scale + 0.1) / (sum(c.values()) / scale + 1)) for v in (KINDS if j == 0 else (True, False))} for j, c in enumerate(state)] for state in counts]
    move = moves / scale + 0.5
    return LineModel(emit, np.log(move / move.sum(1, keepdims=True)), known)


def sequences(df: DataFrame, fields: list[str], title_col: str, known: frozenset[str]) -> DataFrame:
    """Distinct sequences of observations (seq) of the texts of several lines, and in how many fields each occurs (n)."""

    def run(title: pd.Series, *columns: pd.Series) -> pd.Series:
        return pd.Series([[encoded(observe(v.splitlines(), t or "", known)) for v in values if v] for t, *values in zip(title, *columns)])

    several = [F.when(F.instr(f, "\n") > 0, F.col(f)) for f in fields]
    found = df.where(F.coalesce(*several).isNotNull()).select(F.explode(F.pandas_udf(run, "array<string>")(F.col(title_col), *several)).alias("seq"))
    return found.groupBy("seq").agg(F.count("*").alias("n"))


def fit_lines(seqs: DataFrame, known: frozenset[str] = frozenset(), scale: float = 1.0, rounds: int = 2) -> LineModel:
    """The line model of all sequences (seq, n): seeds, then re-estimation on Viterbi labels. What comes to
    the driver is one count for each state and observation or following state, whatever the corpus."""
    model = None
    for _ in range(rounds + 1):

        def run(batches: Iterator[pd.DataFrame], model: LineModel | None = model) -> Iterator[pd.DataFrame]:
            for b in batches:
                for move, counts in enumerate(tallied(list(b["seq"]), list(b["n"]), model)):
                    state, other = counts.nonzero()
                    yield pd.DataFrame({"move": move == 1, "state": state, "other": other, "n": counts[state, other]})

        total = (np.zeros((len(STATES), len(KINDS) << 10), np.int64), np.zeros((len(STATES), len(STATES)), np.int64))
        for r in seqs.mapInPandas(run, "move boolean, state int, other int, n long").groupBy("move", "state", "other").agg(F.sum("n").alias("n")).collect():
            total[r.move][r.state, r.other] = r.n
        model = _estimate(*total, known, scale)
    return model


class LetterModel:
    """Trigrams of the letters of names, which no lexicon holds, and of words."""

    def __init__(self, names: tuple[dict, dict], words: tuple[dict, dict]) -> None:
        self.names, self.words = names, words
        self.cache: dict[str, list] = {}
        self.logs: tuple[dict[str, float], dict[str, float]] = ({}, {})  # by three letters

    def __reduce__(self):
        return LetterModel, (self.names, self.words)

    def readings(self, word: str) -> list[tuple[str, str, float, bool]]:
        """As ``readings``, kept for words that come again."""
        if (known := self.cache.get(word)) is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            known = self.cache[word] = readings(word, self)
        return known

    def score(self, word: str, name: bool) -> float:
        """Log probability of a lower-case word's letters among names or among all words."""
        counts, pairs = self.names if name else self.words
        logs = self.logs[name]
        w = f"^^{word}$"
        total = 0.0
        for i in range(len(w) - 2):
            t = w[i : i + 3]
            if (x := logs.get(t)) is None:
                x = logs[t] = math.log((counts.get(t, 0) + 0.02) / (pairs.get(t[:2], 0) + 0.6))
            total += x
        return total


def _trigrams(forms: DataFrame, most: int, scale: float) -> tuple[dict, dict]:
    """Counts, divided by ``scale``, of three letters and of the first two of them in all forms (option,
    fields), a form counting ``most`` times at the most. No more of them than an alphabet has."""
    w = F.concat(F.lit("^^"), F.col("option"), F.lit("$"))
    three = F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, 3))
    times = F.least("fields", F.lit(round(most * scale)))  # whole numbers: a sum that no order changes
    rows = forms.select(times.alias("n"), F.explode(three).alias("three")).groupBy("three").agg(F.sum("n").alias("n")).collect()
    pairs: Counter = Counter()
    for r in rows:
        pairs[r.three[:2]] += r.n
    return {r.three: r.n / scale for r in rows}, {k: n / scale for k, n in pairs.items()}


def fit_letters(counted: DataFrame, scale: float = 1.0) -> LetterModel:
    """The letter model of all words and names of a lexicon."""
    name = F.col("option").startswith("^")
    names = counted.where(name).select(F.substring("option", 2, 1 << 30).alias("option"), "fields")
    return LetterModel(_trigrams(names, 3, scale), _trigrams(counted.where(~name & ~F.col("option").rlike(_MARK)), 30, scale))


def _as_read(word: str, wrong: str, at: int, right: str) -> str:
    """The right letters in the case and alphabet of the word."""
    if "а" <= word[-1:].lower() <= "я" or "а" <= word[:1].lower() <= "я":
        right = {"o": "о", "b": "в"}.get(right, right)
    upper = (at == 0 and wrong in "580") or (word[max(at - 1, 0) : at].isupper() and not word[at + 1 : at + 2].islower()) or (word.isupper() and len(word) > 1)
    return right.upper() if wrong.isdigit() and upper and right != "l" else right.upper() if word.isupper() and len(word) > 1 else right


def readings(word: str, letters: LetterModel, bar: float = BAR) -> list[tuple[str, str, float, bool]]:
    """Possible right forms of a word, without itself: (reading, lexicon key, log prior, whether a text must hold it)."""
    out: dict[str, float] = {}
    low = word.lower()
    if not _SUSPECT.search(low):
        return []
    plain = low.isalpha()
    name = word[:1].isupper() and word.isascii() and len(word) > 3
    own, own_all = letters.score(low, True) if name and plain else 0.0, letters.score(low, False)
    unlikely, held = set(), set()
    cyrillic = any("а" <= c <= "я" for c in low)
    for right, wrong in MISREAD:
        if wrong not in low or ((right > "А") != cyrillic and not (wrong == "0" and cyrillic)):
            continue
        at = low.find(wrong)
        spots = []
        while at >= 0:
            spots.append(at)
            at = low.find(wrong, at + 1)
        for k in spots:
            if wrong.isdigit():
                before, after = low[k - 1 : k], low[k + 1 : k + 2]
                inside = (before.isalpha() and (after.isalpha() or k == len(low) - 1 and k > 2 and low[:k].isalpha())) or (k == 0 and low[1:5].isalpha() and len(low) > 4)
                if not inside or not _NAME.match(word):
                    continue
            form = word[:k] + _as_read(word, wrong, k, right) + word[k + len(wrong) :]
            prior = -bar
            if wrong.isdigit():
                prior = 2.5
            elif name and plain:
                prior = max(-6.0, min(3.0, (letters.score(form.lower(), True) - own) * 0.6 - 4.5))
            out[form] = max(prior, out.get(form, -99))
            if name and plain and not wrong.isdigit() and prior < HELD:
                held.add(form)
            if not wrong.isdigit() and letters.score(form.lower(), False) <= own_all - LIKELY:
                unlikely.add(form)
        if wrong.isdigit() and len(spots) > 1 and _NAME.match(word):
            form = re.sub(rf"(?<=[^\W\d]){wrong}(?=[^\W\d])", right, word)
            out[form] = 3.0
    found = [(f, f.lower(), p, f in unlikely) for f, p in out.items() if f != word]
    return found + [(f, f.lower(), HELD, True) for f in held if f != word]


def _surely(left: str, right: str) -> str | None:
    """The reading of a word parted at a line end where it needs no lexicon."""
    if right[:1].isdigit():
        return f"{left}-{right}"
    if right[:1].isupper() and left[-1:].islower():
        return left + right if re.match(r"[A-Z]+[a-z]*$", right) and left[:1].isupper() else f"{left}-{right}"
    return None


def _join(left: str, right: str, letters: LetterModel) -> list[tuple[str, str, float, bool]]:
    """Readings of a word parted at a line end."""
    if sure := _surely(left, right):
        return [(sure, "", 100.0, False)]
    whole, kept = left + right, f"{left}-{right}"
    out = [(whole, whole.lower(), 0.0, False), (kept, kept.lower(), -0.5, False)]
    return out + [(f, k, p - 0.5, u) for f, k, p, u in letters.readings(whole) if p > -5] + [(f, k, p - 1, u) for f, k, p, u in letters.readings(kept) if p > -5]


def options(damage: str, base: str, letters: LetterModel) -> list[tuple[str, str, float, bool, bool]]:
    """Readings of a form: (reading, lexicon key, log prior, whether a text must hold it, whether it is the form as it stands)."""
    if damage == "break":
        left, right = base.split("\n")
        return [(*o, False) for o in _join(left[:-1], right, letters)]
    if _is_wide(base):
        a, c, b = base
        return [(c, base, 0.0, False, True)] + [(d, f"{a}{d}{b}", -BAR, False, False) for d in _PARTNER[c]]
    found = letters.readings(base)
    return [(base, base.lower(), 0.0, False, True)] + [(*o, False) for o in found] if found else []


def _is_wide(base: str) -> bool:
    return len(base) == 3 and base[1] in _PARTNER


def _flat(text: str) -> list[tuple[int, str]]:
    """Look-alike characters with their neighbours, blanks skipped, and their positions."""
    if not _MARKS.search(text):
        return []
    kept = [i for i, c in enumerate(text) if not c.isspace()]
    return [(i, f"{text[h]}{text[i]}{text[j]}") for h, i, j in zip(kept, kept[1:], kept[2:]) if text[i] in _PARTNER]


def _words(text: str, spots: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """Words outside the joined ones, and their positions."""
    out = []
    k = 0
    for m in _WORD.finditer(text):
        while k < len(spots) and spots[k][1] <= m.start():
            k += 1
        if (k == len(spots) or spots[k][0] >= m.end()) and not (text[m.start() - 1 : m.start()] in _CODE or text[m.end() : m.end() + 1] in _CODE):
            out.append((m.start(), m.group()))
    return out


def examined(text: str) -> bool:
    """Whether a text shows what any scanned text holds."""
    return bool(_TRACE.search(text) or _WRAPS.search(text))


def traces(text: str, labels: np.ndarray) -> tuple[list[tuple[str, str]], str, list[tuple[int, int, str]]]:
    """Traces of scanning (damage, base) of a text whose lines have these states, the text in whole paragraphs, and there (start, end, base) of
    the parted words, which stand joined as far as that is known without a lexicon."""
    out: list[tuple[str, str]] = []
    hidden = bool(_INVISIBLE.search(text))
    lines = text.splitlines()
    kept: list[str] = []
    wrapped = 0
    body: list[str] = []  # body lines of the running paragraph
    gap = False  # blank lines since the last body line
    furniture = False
    last_end = True
    for line, s in zip(lines, labels):
        x = line.strip()
        state = STATES[s]
        if state in ("header", "page"):
            out.append((state, x))
            furniture = True
            continue
        if state == "blank":
            gap = True
            continue
        alone = state in ("heading", "table")
        if body and (alone or (gap and not (furniture and not last_end))):
            kept.append("\n".join(body))
            body = []
        if body and not last_end:
            wrapped += 1
        if alone:
            kept.append(_INVISIBLE.sub("", x) if hidden else x)
            last_end = True
        else:
            body.append(_INVISIBLE.sub("", x) if hidden else x)
            last_end = bool(_END.search(x))
        gap = furniture = False
    if body:
        kept.append("\n".join(body))
    paragraphs = []
    spots: list[tuple[int, int, str]] = []
    start = 0  # of the paragraph
    for p in kept:
        whole = ""
        wide = len(re.findall(_WIDE, p)) > len(p) / 3
        for n, line in enumerate(p.split("\n")):
            m = re.search(rf"({WORD})([{HYPHENS}])$", whole[-80:]) if whole[-1:] and whole[-1:] in HYPHENS else None
            r = re.match(WORD, line) if m else None
            if m and r and m.group(1)[-1].isalpha():
                base = f"{m.group()}\n{r.group()}"
                out.append(("break", base))
                whole = whole[: -len(m.group())]
                joined = _surely(m.group(1), r.group()) or m.group(1) + r.group()
                while spots and spots[-1][1] > start + len(whole):  # parted twice
                    spots.pop()
                spots.append((start + len(whole), start + len(whole) + len(joined), base))
                whole += joined + line[r.end() :]
            elif n and re.match(f"{_WIDE}|[，。、；：）」]", whole[-1:]) and re.match(f"{_WIDE}|[，。、；：（「]", line):
                whole += line
            elif n and wide and (m := re.search(rf"{_PIECE}$", whole)) and (r := re.match(_PIECE, line)):
                spots.append((start + m.start(), start + len(whole) + r.end(), ""))  # no hyphen parts a word there
                whole += line
            else:
                whole += " " + line if n else line
        paragraphs.append(whole)
        start += len(whole) + 2
    repaired = "\n\n".join(paragraphs)
    if not (spots or wrapped >= 2 or out or (wrapped and _WRAPS.search(text))):
        if not _MISREAD.search(text):
            return out, text, []
        repaired = _INVISIBLE.sub("", text)  # its lines are no scanned ones
    for w in {w for _, w in _words(repaired, spots)}:
        if len(w) >= LETTERS and (w.isalpha() or 3 * sum(c.isdigit() for c in w) <= len(w)):
            out.append(("glyph", w))
    out.extend(("glyph", base) for _, base in _flat(repaired))
    return list(dict.fromkeys(out)), repaired, spots


def written(text: str, spots: list[tuple[int, int, str]], found: dict[tuple[str, str], str]) -> str:
    """A text of ``traces`` with the readings found for (damage, base)."""
    edits = [(a, b, found[("break", base)]) for a, b, base in spots if ("break", base) in found]
    edits += [(i, i + len(w), found[("glyph", w)]) for i, w in _words(text, spots) if ("glyph", w) in found]
    edits += [(i, i + 1, found[("glyph", base)]) for i, base in _flat(text) if ("glyph", base) in found]
    out, at = [], 0
    for a, b, reading in sorted(edits):
        out += [text[at:a], reading]
        at = b
    return "".join(out) + text[at:]


def fitted(df: DataFrame, fields: list[str], title_col: str) -> tuple[LineModel, LetterModel, DataFrame]:
    """The line model, the letter model and the lexicon of all rows."""
    checkpoint_dir(df.sparkSession)
    known = corpus.recurring(df, fields, header_names(F.col("text")), HEADERS)
    counted = lexicon(df, fields).checkpoint()
    scale = max(1.0, df.count() / UNIT)
    return fit_lines(sequences(df, fields, title_col, known).checkpoint(), known, scale), fit_letters(counted, scale), counted


def _read(df: DataFrame, fields: list[str], id_col: str, title_col: str, model: LineModel, whole: bool) -> DataFrame:
    """Rows (doc, read): for each field its traces, if ``whole`` also the repaired text; read once, then kept."""

    def run(title: pd.Series, *columns: pd.Series) -> pd.Series:
        asked = {(i, f): v for f, values in zip(fields, columns) for i, v in enumerate(values) if v and examined(v)}
        titles = list(title)
        states = model.labels([encoded(observe(v.splitlines(), titles[i] or "", model.known)) for (i, _), v in asked.items()])
        found = {at: traces(v, s) for (at, v), s in zip(asked.items(), states)}
        out = []
        for i, values in enumerate(zip(*columns)):
            each = [(f, *found.get((i, f), ([], v, []))) for f, v in zip(fields, values)]
            out.append(each if whole else [x[:2] for x in each if x[1]])
        return pd.Series(out)

    kind = f"array<struct<field_name:string,{TRACES}{',' + REPAIRED if whole else ''}>>"
    return df.select(F.col(id_col).alias("doc"), F.pandas_udf(run, kind)(F.col(title_col), *(F.col(f) for f in fields)).alias("read")).checkpoint()


def _decided(read: DataFrame, lexicon: DataFrame, letters: LetterModel) -> DataFrame:
    """Distinct rows (doc, field_name, damage, base, reading); each form is looked up once for all texts."""

    def run(damage: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([options(d, b, letters) for d, b in zip(damage, base)])

    each = read.select("doc", F.inline("read")).select("doc", "field_name", F.inline("traces")).distinct()
    sure = each.where(F.col("damage").isin("header", "page")).withColumn("reading", F.col("base"))
    asked = each.where(F.col("damage").isin("break", "glyph"))
    forms = asked.select("damage", "base").distinct().select("damage", "base", F.inline(F.pandas_udf(run, OPTIONS)("damage", "base"))).checkpoint()
    counted = forms.select("option").distinct().join(lexicon, "option")  # only forms that are asked for
    scored = forms.join(counted, "option", "left").fillna(0, ["n", "fields"]).where("n > 0 or not must")
    for by in ("n", "fields"):
        scored = scored.withColumn(f"by_{by}", F.log(F.col(by) + 0.5) + F.col("prior"))
    # Distinct texts decide; where they leave a form as it stands, copies may speak for a reading of no fewer texts.
    own = F.max(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy("damage", "base"))
    scored = scored.withColumn("rival", F.col("own") | (F.col("n") >= own))
    choice = F.struct("reading", "own")
    best = scored.groupBy("damage", "base").agg(
        F.max_by(choice, F.struct("by_n", "prior", "reading")).alias("b"),
        F.max_by(choice, F.when(F.col("rival"), F.struct("by_fields", "prior", "reading"))).alias("c"),
    )
    b = F.when(F.col("b.own"), F.col("c")).otherwise(F.col("b"))
    changed = best.select("damage", "base", b.alias("b")).where("not b.own").select("damage", "base", F.col("b.reading").alias("reading"))
    return sure.unionByName(asked.join(changed, ["damage", "base"]))


def lexicon(df: DataFrame, fields: list[str]) -> DataFrame:
    """Number of distinct texts (n) and of fields (fields) in which each word, name (after ^), or look-alike
    character with its neighbours, occurs. A misread page that is copied must not speak for its own misreadings."""
    def forms(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(LOWER_WORD), 0)
        names = F.transform(F.regexp_extract_all(text, F.lit(NAME_WORD), 0), lambda x: F.concat(F.lit("^"), F.lower(x)))
        wide = F.when(text.rlike(_MARK), F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(f"(?=(.{_MARK}.))"), 1)).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(words, names, wide))

    text = F.col("text")
    plain = F.when(text.rlike("[\u00ad\u200b-\u200d\u2060\ufeff]"), F.regexp_replace(text, INVISIBLE, "")).otherwise(text)
    texts = df.select(F.explode(F.array(*fields)).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    each = texts.select("copies", plain.alias("text")).select("copies", F.explode(forms(text)).alias("option"))
    return each.groupBy("option").agg(F.count("*").alias("n"), F.sum("copies").alias("fields"))


def scan_traces(df: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("abstract_text", "content_text"), title_col: str = "title") -> DataFrame:
    """Distinct rows (id, field_name, damage, reading) of the traces of scanning."""
    fields = list(fields)
    lines, letters, counted = fitted(df, fields, title_col)
    found = _decided(_read(df, fields, id_col, title_col, lines, False), counted, letters)
    return found.select(F.col("doc").alias(id_col), "field_name", "damage", "reading").distinct()


def paragraphs(df: DataFrame, *fields: str, id_col: str = "doc_id", title_col: str = "title") -> DataFrame:
    """Each text in continuous paragraphs of whole, correctly read words, without headers and page
    numbers. Only texts with traces are joined with their readings."""
    lines, letters, counted = fitted(df, list(fields), title_col)
    read = _read(df, list(fields), id_col, title_col, lines, True)
    found = _decided(read, counted, letters).where(F.col("damage").isin("break", "glyph"))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("field_name", "damage", "base", "reading")).alias("found"))

    @F.udf("array<string>")
    def write(read, found):
        return [r.text and written(r.text, r.spots, {(x.damage, x.base): x.reading for x in found or [] if x.field_name == r.field_name}) for r in read]

    traced = F.exists("read", lambda r: F.size(r["traces"]) > 0)
    whole = read.where(traced).join(found, "doc", "left").select("doc", write("read", "found").alias("texts"))
    plain = read.where(~traced).select("doc", F.transform("read", lambda r: r["text"]).alias("texts"))
    return whole.unionByName(plain).select(F.col("doc").alias(id_col), *(F.col("texts")[i].alias(f) for i, f in enumerate(fields)))

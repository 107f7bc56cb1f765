"""Column functions on text: language gates, keys, tokens, markers, dates, paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
# Common words that tell English from other Latin-script languages.
ENGLISH = "the of and in to is are was for with that this by on we from as at be an".split()
OTHER_LATIN = "der die das und ist nicht mit von el los las una por para con les des est une dans pour avec não uma dos".split()
TRUNCATE_AT = r"(?im)^\s*(?:references|bibliography|参考文献|literatur|références|referencias|referências)\s*[:：]?\s*$"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def cjk_count(text: Column) -> Column:
    return count(text, HAN)


def latin_count(text: Column) -> Column:
    return count(text, "[A-Za-z]")


def words(text: Column, pattern: str = "[a-z]+") -> Column:
    """Lower-case words of the pattern."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)


def hits(tokens: Column, terms: list[str]) -> Column:
    """Number of tokens that are among ``terms``."""
    return F.size(F.filter(tokens, lambda w: w.isin(*terms)))


def looks_english(text: Column) -> Column:
    """False where accented letters exceed 0.5 % of the letters, or no English function word stands
    beside two or more of other languages; null text counts as English."""
    t = F.coalesce(text, F.lit(""))
    accented = count(t, r"[\x{c0}-\x{24f}]")
    letters = latin_count(t) + accented
    w = words(t, r"[a-z\x{df}-\x{24f}]+")
    return ~((accented > 0.005 * letters) | ((hits(w, ENGLISH) == 0) & (hits(w, OTHER_LATIN) >= 2)))


def language_gate(text: Column) -> Column:
    """Texts of fewer than 30 letters pass; zh above 20 Chinese characters; otherwise English or other Latin text."""
    han, effective = cjk_count(text), count(text, r"[A-Za-z\x{c0}-\x{24f}\x{4e00}-\x{9fff}]")
    return F.when(effective < 30, "pass").when(han > 20, "zh").when(looks_english(text), "en").otherwise("non_english")


def detect_by_ratio(text: Column) -> Column:
    return F.when(cjk_count(text) > 0.2 * latin_count(text), "zh").otherwise("en")


def detect_by_share(text: Column) -> Column:
    n = F.greatest(F.char_length(F.coalesce(text, F.lit(""))), F.lit(1))
    return F.when(cjk_count(text) / n > 0.08, "zh").otherwise("en")


def detect_by_count(text: Column) -> Column:
    return F.when(cjk_count(text) >= F.greatest(F.lit(2), latin_count(text)), "zh").otherwise("en")


def collapse(text: Column) -> Column:
    """Runs of blanks to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def key(text: Column) -> Column:
    """Lower-case letters, digits and Chinese characters only."""
    return F.regexp_replace(F.lower(text), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")


def singular(word: Column) -> Column:
    return (
        F.when(word.rlike("^.{2,}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("^.+(ss|x|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("^.{2,}[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def label_length(text: Column) -> Column:
    """Chinese characters plus Latin tokens."""
    return cjk_count(text) + count(text, "[A-Za-z0-9]+")


def latin_terms(text: Column) -> Column:
    return F.array_distinct(words(text, "[a-z][a-z0-9-]{2,}"))


def han_ngrams(text: Column, n: int) -> Column:
    """Chinese character n-grams within runs of Chinese characters."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{HAN}{{{n},}}"), 0)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))))


def sentences(text: Column) -> Column:
    """Plain split after closing marks; the multilingual cutter is a separate operator."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^.!?。！？]+[.!?。！？]*"), 0)
    return F.filter(F.transform(parts, collapse), lambda s: F.char_length(s) > 0)


def split_keywords(text: Column) -> Column:
    """Keywords split at the usual separators, trimmed, first of equal ones (ignoring case) kept."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[;,；，、|/\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return distinct_ignoring_case(parts)


def distinct_ignoring_case(items: Column) -> Column:
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def year(text: Column) -> Column:
    """First year from 1900 to 2099 in a text."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit("9999")).cast("int")


def expand_markers(marker: Column) -> Column:
    """Numbers of a citation marker: '[2, 4-6]' gives 2, 4, 5, 6. A reversed range keeps its ends,
    and so does one of more than a hundred thousand numbers, which cites nothing."""
    parts = F.regexp_extract_all(F.translate(marker, "，－–—、", ",---,"), F.lit(r"\d+(?:\s*-\s*\d+)?"), 0)

    def numbers(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
        b = F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")
        return F.when((b >= a) & (b - a <= 100_000), F.sequence(a, b)).otherwise(F.array(a, b))

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def strip_markup(text: Column) -> Column:
    """Tags, images and links removed; a link keeps its words."""
    t = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(t, r"<[^>]+>", "")


def strip_artifacts(text: Column) -> Column:
    """Web addresses and e-mail addresses removed."""
    t = F.regexp_replace(text, r"https?://[A-Za-z0-9./_%?=&#-]+", "")
    return F.regexp_replace(t, r"[A-Za-z0-9._%-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")


def before_references(text: Column) -> Column:
    """The text up to a line that is only the heading of the references."""
    return F.element_at(F.split(text, TRUNCATE_AT, 2), 1)


def context(text: Column, term: Column, radius: int) -> Column:
    """Window of ``radius`` characters around the first occurrence; null without one."""
    at = F.locate(term, text) if isinstance(term, str) else F.call_function("locate", term, text)
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.char_length(term) + radius))


def discipline(code: Column) -> Column:
    """Technical classes are told apart by two letters, others by one."""
    return F.when(F.left(code, F.lit(1)) == "T", F.left(code, F.lit(2))).otherwise(F.left(code, F.lit(1)))


def surface(text: Column) -> Column:
    """STR-02: surface form: compatibility forms in one (NFKC), case folded, punctuation to blanks, blanks collapsed."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")

    return collapse(F.regexp_replace(F.pandas_udf(run, "string")(text), r"[^\p{L}\p{N}\s]+", " "))


def table_line(line: Column) -> Column:
    """Whether a line is a table row or formula: digits, operators and bars prevail."""
    n = F.greatest(F.char_length(line), F.lit(1))
    return (count(line, r"[0-9]") / n > 0.4) | (count(line, r"[|\t]") >= 2) | (count(line, r"[=+*/^<>]") >= 3)


def clauses(text: Column) -> Column:
    """STR-07: clauses at commas, semicolons and means phrases."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([,;，；])\s*", "$1\x01"), r"\s+(by (?:employing|using|means of)\b)", "\x01$1")
    return F.filter(F.transform(F.split(cut, "\x01"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def with_neighbours(items: str, blank=None) -> Column:
    """Every item of an array column with the one before and after it (empty at the ends and where
    ``blank`` holds of the neighbour): array<struct<item, before, after>>, made within the row."""

    def side(i: Column) -> Column:
        x = F.coalesce(F.get(items, i), F.lit(""))
        return x if blank is None else F.when(blank(x), "").otherwise(x)

    return F.transform(items, lambda x, i: F.struct(x.alias("item"), side(i - 1).alias("before"), side(i + 1).alias("after")))


def all_terms(text: Column) -> Column:
    """STR-14: distinct Latin tokens and Chinese n-grams of two to six characters."""
    return F.array_distinct(F.concat(latin_terms(text), *(han_ngrams(text, n) for n in range(2, 7))))


def label_words(text: Column, stop: list[str]) -> Column:
    """STR-13: English words in the singular without stop words, then Chinese character bigrams."""
    own = F.filter(words(text, "[a-z]+"), lambda w: ~w.isin(*stop))
    return F.concat(F.transform(own, singular), han_ngrams(text, 2))

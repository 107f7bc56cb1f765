"""Problem 4: one form for text that looks the same but is stored as different characters.

The form is a confusables skeleton: decompose, replace every character by its prototype from the
look-alike table, decompose again. Values whose skeletons are equal look the same.

What the table holds: compatibility decompositions that keep the look (full- and half-width forms,
ligatures, letters of other blocks, radicals), kinds of space (one space), line ends (one newline),
invisible characters (nothing) and look-alike letters of other alphabets (the Latin letter). Case,
accents, raised or lowered characters and all other marks stay different.

Results: null stays null, empty stays empty; a value of invisible characters only becomes empty.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import checkpoint_dir

# Look-alike letters of other alphabets and the Latin letters they are read as.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "ү": "y", "Ӏ": "I", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j", "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B", "Օ": "O", "Ս": "U", "յ": "j",
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "𐊡": "A", "𐊢": "B", "𐊤": "E", "𐊫": "O", "𐊱": "M", "𐊲": "T", "𐌀": "A", "𐌁": "B", "𐌂": "C", "𐌑": "M", "𐌕": "T", "𐌗": "X",
}
# Kinds of compatibility decomposition that change the look, and single characters that a decomposition would change.
CHANGES_LOOK = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>")
KEPT = "…‥´¨¯¸˘˙˚˛˜˝"


def _prototype(ch: str) -> str:
    """What one character is replaced by; may be several characters or none."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs" or ch == "\t":
        return " "
    if ch in "\n\r\x0b\x0c\x85  ":
        return "\n"
    if kind == "Cc":
        return ""
    if ch in KEPT:
        return ch
    parts = unicodedata.decomposition(ch)
    if parts.startswith(CHANGES_LOOK):
        return ch
    if 0xAC00 <= ord(ch) <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    if parts:
        codes = parts.split()[1:] if parts[0] == "<" else parts.split()
        return "".join(_prototype(chr(int(x, 16))) for x in codes)
    return LOOK_ALIKES.get(ch, ch)


class _Table(dict):
    """Fills itself with the characters that occur."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _prototype(chr(code))
        return out


_TABLE = _Table()


def skeleton(text: str) -> str:
    """The form in which equal-looking texts are equal."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFD", text.translate(_TABLE))


def _skeletons(values: pd.Series) -> pd.Series:
    return values.map(skeleton, na_action="ignore")


def skeleton_of(text: Column) -> Column:
    return F.pandas_udf(_skeletons, "string")(text)


def _keys(values: pd.Series) -> pd.DataFrame:
    """128-bit keys of a value's skeleton and of the value; null for null and empty ones."""
    key = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    rows = [(None, None) if not v else (key(skeleton(v)), key(v)) for v in values]
    return pd.DataFrame(rows, columns=["skeleton", "value"])


def normalise(df: DataFrame, *fields: str) -> DataFrame:
    """``df`` with each field in its one form, in place."""
    return df.withColumns({f: skeleton_of(F.col(f)) for f in fields})


def keyed(df: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """Rows (field_name, id, skeleton key, value key) of every value that is neither null nor empty."""
    key_udf = F.pandas_udf(_keys, "skeleton binary, value binary")
    keys = df.select(F.col(id_col).alias("doc"), *(key_udf(F.col(f)).alias(f"k{i}") for i, f in enumerate(fields)))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"k{i}.skeleton").alias("skeleton"), F.col(f"k{i}.value").alias("value")) for i, f in enumerate(fields))))
    out = keys.select("doc", rows.alias("r")).select("doc", "r.*").where("skeleton is not null")
    checkpoint_dir(df.sparkSession)
    return out.checkpoint()  # read several times; 40 bytes a value


def classes(df: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row for each document and field: the class of equal-looking values, by its least id, and
    the class's numbers of documents and of different values."""
    k = keyed(df, fields, id_col)
    stats = k.groupBy("field_name", "skeleton", "value").agg(F.min("doc").alias("m"), F.count("*").alias("n")).groupBy("field_name", "skeleton").agg(F.min("m").alias("class_id"), F.sum("n").alias("documents"), F.count("*").alias("forms"))
    return k.join(stats, ["field_name", "skeleton"]).select("field_name", F.col("doc").alias(id_col), "class_id", "documents", "forms")


def look_alike_pairs(df: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """Pairs of documents whose values differ as strings but look the same, doc_a < doc_b.

    The pairs are formed between different values of a class, never within the copies of one value:
    classes with a single form are dropped by an aggregate before the join, so a page copied a
    million times joins with nothing.
    """
    k = keyed(df, fields, id_col)
    mixed = k.groupBy("field_name", "skeleton").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("field_name", "skeleton")
    k = k.join(mixed, ["field_name", "skeleton"], "left_semi")
    a, b = k.alias("a"), k.alias("b")
    pair = (F.col("a.field_name") == F.col("b.field_name")) & (F.col("a.skeleton") == F.col("b.skeleton")) & (F.col("a.value") != F.col("b.value")) & (F.col("a.doc") < F.col("b.doc"))
    return a.join(b, pair).select("a.field_name", F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b")).distinct()

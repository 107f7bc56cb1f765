"""Problem 6: encode every text with a public byte-level BPE vocabulary, on the JVM.

Each text is cut into words by the tokenizer's pattern, the words into units at byte boundaries no
vocabulary entry spans, and the distinct units of a slice of the text are encoded once each: a
higher-order fold repeats "find the lowest-ranked adjacent pair, merge all its occurrences" over
the unit's bytes. Bytes are held as ISO-8859-1 characters, one for each byte. The rank map is a
literal hash table (array of small maps, indexed by CRC-32), so a lookup costs O(1).
There is no shuffle and no Python worker: the plan is scan -> project.

Results: null and empty text give an empty list; blank text is encoded as it stands; ids never
contain special tokens. A word of any length is encoded whole.
"""

from __future__ import annotations

import base64
import json
import random
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm import corpus
from strataloom.session import spread

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
BUCKETS = 1 << 14
#: Units encoded together; distinct units are looked up within a slice, so cost is linear in the text.
SLICE = 512
#: The tokenizer's pattern (fixed value), possessive where that changes nothing but speed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: White space as the tokenizer sees it: Unicode White_Space (fixed value).
SPACE = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}".replace(r"\x{1c}-\x{1f}", "")
#: Rows whose units are encoded ahead, their length at most, and the largest number of units remembered.
SAMPLE, SHORT, REMEMBERED = 5000, 8000, 12000
#: Units above so many bytes merge all occurrences of a pair in one step.
LONG = 2048
SEP = "Ā"
#: The literal merge table has two probes: slots of the first and second hash (primes), and the sign of no merge.
SLOTS_A, SLOTS_B, NONE = 99991, 88883, 1 << 30


@lru_cache(maxsize=4)
def ranks(path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    with open(f"{path}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _rank_json(path: str, name: str) -> str:
    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks(path, name).items():
        key = piece.decode("latin-1")
        table[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return json.dumps(table, ensure_ascii=False, separators=(",", ":"))


@lru_cache(maxsize=4)
def _byte_ids(path: str, name: str) -> list[int]:
    known = ranks(path, name)
    return [known[bytes([b])] for b in range(256)]


def _merge_of(known: dict[bytes, int], piece: bytes) -> tuple[int, int] | None:
    """The two entries that the fold joins last to make ``piece``; None if it never makes it."""
    parts, top = [piece[i : i + 1] for i in range(len(piece))], known[piece]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := known.get(parts[i] + parts[i + 1], top)) < top]
        if not found:
            return None
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return known[parts[0]], known[parts[1]]


@lru_cache(maxsize=4)
def _merge_json(path: str, name: str) -> str:
    """All merges as a table of two halves in which each lies at one of two places (cuckoo hashing)."""
    known = ranks(path, name)
    table, rng = [0] * (SLOTS_A + SLOTS_B), random.Random(1)
    for piece, rank in known.items():
        if len(piece) < 2 or not (pair := _merge_of(known, piece)):
            continue
        entry = ((pair[0] * 65536 + pair[1]) << 16) | rank
        at = (entry >> 16) % SLOTS_A
        for _ in range(2000):
            entry, table[at] = table[at], entry
            if not entry:
                break
            places = ((entry >> 16) % SLOTS_A, SLOTS_A + (entry >> 16) % SLOTS_B)
            at = places[0] if at == places[1] else places[1] if at == places[0] else places[rng.randrange(2)]
        else:
            raise ValueError("the merge table is too full; use larger SLOTS_A and SLOTS_B")
    return json.dumps(table, separators=(",", ":"))


@lru_cache(maxsize=4)
def _unit_cut(path: str, name: str) -> str:
    """A pattern of byte positions within a word that no vocabulary entry spans."""
    before: dict[int, set[int]] = {}
    for piece in ranks(path, name):
        for x, y in zip(piece, piece[1:]):
            before.setdefault(y, set()).add(x)
    groups: dict[str, list[int]] = {}
    for y in range(0xC2, 0xF5):
        free = [x for x in range(0x80, 0xC0) if x not in before.get(y, ())]
        if free:
            groups.setdefault("".join(f"\\x{x:02x}" for x in free), []).append(y)
    return "|".join(f"(?<=[{k}])(?=[{''.join(f'\\x{y:02x}' for y in v)}])" for k, v in groups.items())


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times within ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank(table: Column, piece: Column) -> Column:
    bucket = F.element_at(table, (F.crc32(piece.cast("binary")) % BUCKETS + 1).cast("int"))
    return F.try_element_at(bucket, piece)


def _pieces(state: Column) -> Column:
    return F.filter(F.split(state, SEP), lambda x: x != "")


def _fold_long(table: Column, unit: Column) -> Column:
    """Fold for very long units: each step merges all occurrences of the lowest pair, so that the
    number of steps follows the number of different merges rather than the length."""

    def step(state: Column, _: Column) -> Column:
        def merged(p: Column) -> Column:
            pairs = F.transform(
                F.sequence(F.lit(1), F.size(p) - 1),
                lambda i: F.struct(_rank(table, F.concat(F.element_at(p, i), F.element_at(p, i + 1))).alias("r"), i.alias("i")),
            )

            def put(b: Column) -> Column:
                left, right = F.element_at(p, b["i"]), F.element_at(p, b["i"] + 1)
                old = F.concat(F.lit(SEP), left, F.lit(SEP + SEP), right, F.lit(SEP))
                return F.struct(F.replace(state["s"], old, F.concat(F.lit(SEP), left, right, F.lit(SEP))).alias("s"), F.lit(False).alias("done"))

            best = F.array_min(F.filter(pairs, lambda x: x["r"].isNotNull()))
            return _let(best, lambda b: F.when(b.isNull(), F.struct(state["s"].alias("s"), F.lit(True).alias("done"))).otherwise(put(b)))

        return F.when(state["done"], state).otherwise(
            _let(_pieces(state["s"]), lambda p: F.when(F.size(p) < 2, F.struct(state["s"].alias("s"), F.lit(True).alias("done"))).otherwise(merged(p)))
        )

    start = F.struct(F.regexp_replace(unit, "(?s)(.)", f"{SEP}$1{SEP}").alias("s"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(unit)), start, step, lambda s: F.transform(_pieces(s["s"]), lambda x: _rank(table, x)))


def _pair(table: Column, left: Column, right: Column) -> Column:
    """Id of the entry that the merge of two ids gives, NONE without such a merge: two probes."""

    def second(k: Column) -> Column:
        return _let(F.element_at(table, (k % SLOTS_B + (SLOTS_A + 1)).cast("int")), lambda e: F.when(F.shiftright(e, 16) == k, e.bitwiseAND(65535)).otherwise(F.lit(NONE).cast("long")))

    def first(k: Column) -> Column:
        return _let(F.element_at(table, (k % SLOTS_A + 1).cast("int")), lambda e: F.when(F.shiftright(e, 16) == k, e.bitwiseAND(65535)).otherwise(second(k)))

    return _let(left * 65536 + right, first)


def _fold_short(tables: Column, unit: Column) -> Column:
    """Fold for ordinary units. An element holds a piece's id and, in the bits above, the id its
    merge with the next piece gives (NONE without one); the least element is the next merge, and a
    step looks up only the two pairs it changes."""
    table, byte_ids = tables["merges"], tables["bytes"]
    none = F.array().cast("array<bigint>")

    def put(q: Column, low: Column, i: Column) -> Column:
        m = F.shiftright(low, 16)
        left = lambda x: F.array(F.shiftleft(_pair(table, x, m), 16).bitwiseOR(x))
        right = lambda x: F.shiftleft(_pair(table, m, x), 16)
        return F.concat(
            F.slice(q, F.lit(1), F.greatest(i - 2, F.lit(0))),
            F.when(i > 1, _let(F.element_at(q, i - 1).bitwiseAND(65535), left)).otherwise(none),
            F.array(F.when(i + 1 < F.size(q), right(F.element_at(q, i + 2).bitwiseAND(65535))).otherwise(F.lit(NONE << 16)).bitwiseOR(m)),
            F.slice(q, i + 2, F.size(q)),
        )

    def step(q: Column, _: Column) -> Column:
        return _let(F.array_min(q), lambda low: F.when(low >= NONE << 16, q).otherwise(put(q, low, F.array_position(q, low).cast("int"))))

    pieces = F.transform(F.split(unit, ""), lambda c: F.element_at(byte_ids, F.ascii(c) + 1))
    start = _let(
        pieces,
        lambda p: F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.shiftleft(_pair(table, x, F.element_at(p, i + 2)), 16)).otherwise(F.lit(NONE << 16)).bitwiseOR(x)),
    )
    return F.aggregate(F.sequence(F.lit(2), F.char_length(unit)), start, step, lambda q: F.transform(q, lambda x: x.bitwiseAND(65535)))


def _fold(tables: Column, unit: Column) -> Column:
    """Ids of a unit that is no entry, by the fold of ranked merges."""
    return F.when(F.char_length(unit) <= LONG, _fold_short(tables, unit)).otherwise(_fold_long(tables["ranks"], unit))


def units(text: Column, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Column:
    """Units of a text in order, bytes as ISO-8859-1 characters; they are encoded one by one."""
    pattern = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s+", f"[{SPACE}]+")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    cut = _unit_cut(path, name)
    latin = lambda w: F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")
    return F.flatten(F.transform(words, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.array(w)).otherwise(F.split(F.regexp_replace(latin(w), cut, SEP), SEP))))


def _tables(path: str, name: str, memo: dict[str, list[int]]) -> Column:
    """The literal tables: ranks by bucket (remembered units have negative places), memo, merges, byte ids."""
    ranked = _rank_json(path, name)
    if memo:
        table = json.loads(ranked)
        for place, unit in enumerate(memo, 1):
            table[zlib.crc32(unit.encode()) % BUCKETS][unit] = -place
        ranked = json.dumps(table, ensure_ascii=False, separators=(",", ":"))
    return F.struct(
        F.from_json(F.lit(ranked), "array<map<string,bigint>>").alias("ranks"),
        F.from_json(F.lit(json.dumps(list(memo.values()) or [[0]], separators=(",", ":"))), "array<array<bigint>>").alias("memo"),
        F.from_json(F.lit(_merge_json(path, name)), "array<bigint>").alias("merges"),
        F.array(*(F.lit(i).cast("long") for i in _byte_ids(path, name))).alias("bytes"),
    )


def remembered(df: DataFrame, text_col: str = "text", path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[str, list[int]]:
    """Ids of the distinct units that occur at least twice among at most ``SAMPLE`` short texts and are
    no entries. They only save work: other units are folded where they occur.

    The sample comes to the driver (at most ``SAMPLE`` texts of ``SHORT`` characters), as a limit
    within a plan would move rows of every partition into one task.
    """
    rows = corpus.sampled(df, SAMPLE, text_col, where=F.char_length(text_col) <= SHORT)
    if not rows:
        return {}
    sample = df.sparkSession.createDataFrame([(r[0],) for r in rows], "t string")
    u = spread(sample).select(F.explode(F.array_distinct(units(F.col("t"), path, name))).alias("u"))
    often = u.where(F.char_length("u") <= 64).groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    t = _tables(path, name, {})
    coded = often.select("u", "n", _let(t, lambda t: F.when(_rank(t["ranks"], F.col("u")).isNull(), _fold(t, F.col("u")))).alias("ids")).where(F.size("ids") > 1)
    return {r.u: r.ids for r in coded.orderBy(F.desc("n"), "u").limit(REMEMBERED).collect()}


def encode(text: Column, path: str = TOKENIZERS, name: str = "byte_bpe_50k", memo: dict[str, list[int]] | None = None) -> Column:
    """Token ids (array<int>) of ``text`` by the named byte-level BPE vocabulary.

    Units that are entries or remembered cost one lookup each; the distinct others of a slice are folded once.
    """
    none = F.array().cast("array<bigint>")

    def encode_slice(tables: Column, part: Column) -> Column:
        def put_together(looked: Column) -> Column:
            other = F.array_distinct(F.filter(part, lambda u, i: F.get(looked, i).isNull()))

            def one(other: Column, folded: Column, r: Column, i: Column) -> Column:
                own = F.element_at(folded, F.array_position(other, F.get(part, i)).cast("int"))
                return F.when(r.isNull(), own).when(r >= 0, F.array(r)).otherwise(F.element_at(tables["memo"], (-r).cast("int")))

            return _let(other, lambda o: _let(F.transform(o, lambda u: _fold(tables, u)), lambda f: F.flatten(F.transform(looked, lambda r, i: one(o, f, r, i)))))

        return _let(F.transform(part, lambda u: _rank(tables["ranks"], u)), put_together)

    def encode_all(tables: Column, u: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(u), F.lit(SLICE))
        return F.when(F.size(u) == 0, none).otherwise(F.flatten(F.transform(starts, lambda s: _let(F.slice(u, s, F.lit(SLICE)), lambda part: encode_slice(tables, part)))))

    return _let(_tables(path, name, memo or {}), lambda t: _let(units(text, path, name), lambda u: encode_all(t, u))).cast("array<int>")


def decode(ids: Column, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Column:
    """Text of ``ids``: concatenates the binary pieces. Ids outside the vocabulary give null."""
    known = ranks(path, name)
    by_id: list[str] = [""] * (max(known.values()) + 1)
    for piece, rank in known.items():
        by_id[rank] = piece.decode("latin-1")
    pieces = F.from_json(F.lit(json.dumps(by_id, ensure_ascii=False, separators=(",", ":"))), "array<string>")
    return _let(pieces, lambda p: F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.try_element_at(p, i + 1)), ""), "ISO-8859-1"), "UTF-8"))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """One row for each document: its id and ``ids``."""
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", 20_000)  # else every description of the plan holds the tables
    memo = remembered(df, text_col, path, name)
    return df.select(F.col(id_col), encode(F.col(text_col), path, name, memo).alias("ids"))

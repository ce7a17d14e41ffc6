"""Byte-level BPE in Spark's own functions.

A text is cut into words by the vocabulary's pattern. The corpus' words are counted once; the commonest (at most
``DICTIONARY`` of them) are encoded once each and become a literal table, and every other word is encoded where it
stands. So each word is folded once or is rare, and no word, and no text, is shuffled to be looked up.

The fold takes the pair of the lowest rank, merges it, and looks up the ranks of the two new pairs beside it. A word over
``SHORT`` bytes is first cut where no token can lie across, which leaves short pieces in nearly all cases. A piece that
stays long is held as a string of one character per token, and each step replaces its lowest pair wherever it stands,
from the left. A pair that arises from a merge always ranks after it, so replacing all at once gives what one merge at a
time gives, in at most as many steps as there are different merges, whatever the length.

The rank table has two slots per pair (a cuckoo table), so a lookup costs two array reads however many ranks there are.

Edge cases: null and empty text give an empty list; texts of any length are encoded whole; an unpaired surrogate cannot
occur in a Spark string; repeated texts are encoded as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.runtime import materialize, scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bound of the table of common words that the driver gathers and every task holds; with words of at most SHORT bytes, and so
#: at most SHORT ids, it holds under 50 MB.
DICTIONARY = 1 << 17
PLACES = 1 << 20  # of the table of common words
SHORT = 64  # bytes of a word that is merged pair by pair
SLOTS = 1 << 17
HALF = 1 << 16
MIX, MIX2 = 1640531527, 1013904223  # a key is below 2**32, so the products fit a long
CONSTANT = "__constant"
OFFSET = 256  # token t is the character of code point t + OFFSET: under the surrogates for vocabularies up to 55,000

# --- fixed values: the vocabulary's word pattern, its white space spelled out, alternatives that exclude each other reordered
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = rf" ?+\p{{L}}++|'(?:[stmd]|re|ve|ll)| ?+\p{{N}}++| ?+[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]++"
# --------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[bytes, ...]  # by id
    pairs: tuple[tuple[int, int, int], ...]  # left, right, id of their merge

    @property
    def byte_ids(self) -> list[int]:
        at = {p: i for i, p in enumerate(self.pieces)}
        return [at[bytes([b])] for b in range(256)]


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces, and the pair each longer piece is merged from: what its bytes are just before its own merge."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pairs = []
    for piece, rank in ranks.items():
        parts = [bytes([b]) for b in piece]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs.append((ranks[parts[0]], ranks[parts[1]], rank))
    return Vocabulary(tuple(p for p, _ in sorted(ranks.items(), key=lambda x: x[1])), tuple(pairs))


def constant(spark: SparkSession, **arrays: pa.Array) -> Column:
    """A struct of arrays as a scalar subquery: computed once, carried by the tasks as bytes, and no part of the plan's text.

    Put it in a column of its own (CONSTANT) and use that once: the optimizer then inlines it where it is used."""
    row = pa.table({k: pa.array([v.to_pylist()], type=pa.list_(v.type)) for k, v in arrays.items()})
    return spark.createDataFrame(row).select(F.struct(*arrays).alias("c")).scalar()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slots(pairs: tuple[tuple[int, int, int], ...]) -> list[int]:
    """Cuckoo table: the entry of a pair is in one slot of the first half or one of the second, by two hashes of its key."""
    table = [0] * SLOTS
    for a, b, c in pairs:
        entry, first = ((a << 16 | b) << 16) | c, True
        for _ in range(500):
            key = entry >> 16
            at = (key * MIX >> 24) % HALF if first else HALF + (key * MIX2 >> 20) % HALF
            table[at], entry = entry, table[at]
            if not entry:
                break
            first = at >= HALF  # the evicted entry moves to its other half
        else:
            raise ValueError("the pairs don't fit the table")
    return table


def _bits(pieces: set[bytes], width: int) -> np.ndarray:
    """A bit for every text of so many bits, set for the given ones, in longs."""
    bits = np.zeros(1 << width, dtype=np.uint8)
    bits[[int.from_bytes(p, "big") for p in pieces]] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


class Encoder:
    """Columns that encode and decode with one vocabulary."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY):
        v = vocabulary(path)
        if len(v.pieces) + OFFSET >= 0xD800:
            raise ValueError("the vocabulary is too large for one character a token")
        left_right = {c: chr(a + OFFSET) + chr(b + OFFSET) for a, b, c in v.pairs}
        self.arrays = {
            "ranks": pa.array(_slots(v.pairs), pa.int64()),
            "pair_of": pa.array([left_right.get(i, "") for i in range(len(v.pieces))]),
            "char_of": pa.array([chr(i + OFFSET) for i in range(len(v.pieces))]),
            "byte_id": pa.array(v.byte_ids, pa.int64()),
            "twos": pa.array(_bits({p for p in v.pieces if len(p) == 2}, 16)),
            "threes": pa.array(_bits({p[i : i + 3] for p in v.pieces for i in range(len(p) - 2)}, 24)),
        }
        self.spark, self.pieces = spark, v.pieces

    @staticmethod
    def _rank(ranks: Column, a: Column, b: Column) -> Column:
        key = a * 65536 + b
        one, two = F.get(ranks, (F.shiftright(key * MIX, 24) % HALF).cast("int")), F.get(ranks, (F.shiftright(key * MIX2, 20) % HALF + HALF).cast("int"))
        return F.when(F.shiftright(one, 16) == key, one % 65536).when(F.shiftright(two, 16) == key, two % 65536).cast("int")

    @classmethod
    def _step(cls, t: Column, state: Column) -> Column:
        def merged(ids: Column) -> Column:
            lowest = F.array_min(F.transform(ids, lambda x, i: cls._rank(t["ranks"], x, F.get(ids, i + 1))))
            done = F.struct(state["s"].alias("s"), F.lit(False).alias("on"))
            return let(lowest, lambda r: F.when(r.isNull(), done).otherwise(F.struct(F.replace(state["s"], F.get(t["pair_of"], r), F.get(t["char_of"], r)).alias("s"), F.lit(True).alias("on"))))

        codes = F.transform(F.split(state["s"], ""), lambda c: (F.ascii(c) - OFFSET).cast("bigint"))
        return F.when(~state["on"], state).otherwise(let(codes, merged))

    @classmethod
    def _short_step(cls, t: Column, state: Column) -> Column:
        """One merge: the leftmost pair of the lowest rank; only the ranks beside it are looked up again."""
        ids, ranks, n = state["ids"], state["ranks"], F.size(state["ids"])

        def merge(r: Column, p: Column) -> Column:
            left = F.when(p > 1, F.array(cls._rank(t["ranks"], F.get(ids, p - 2), r))).otherwise(F.array().cast("array<int>"))
            right = F.array(cls._rank(t["ranks"], r, F.get(ids, p + 1)))
            new_ids = F.concat(F.slice(ids, F.lit(1), p - 1), F.array(r), F.slice(ids, p + 2, n))
            new_ranks = F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, n))
            return F.struct(new_ids.alias("ids"), new_ranks.alias("ranks"), F.array_min(new_ranks).cast("bigint").alias("low"))

        place = lambda r: F.array_position(ranks, r.cast("int")).cast("int")
        return F.when(state["low"].isNull(), state).otherwise(let(state["low"], lambda r: let(place(r), lambda p: merge(r, p))))

    @classmethod
    def _short(cls, t: Column, latin: Column) -> Column:
        """Ids of a piece of few bytes, merged pair by pair."""

        def fold(ids: Column) -> Column:
            ranks = F.transform(ids, lambda x, i: cls._rank(t["ranks"], x, F.get(ids, i + 1)))
            first = let(ranks, lambda r: F.struct(ids.alias("ids"), r.alias("ranks"), F.array_min(r).cast("bigint").alias("low")))
            steps = F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1)))
            return F.aggregate(steps, first, lambda state, _: cls._short_step(t, state), lambda state: state["ids"].cast("array<int>"))

        return let(F.transform(F.split(latin, ""), lambda c: F.get(t["byte_id"], F.ascii(c))), fold)

    @classmethod
    def _long(cls, t: Column, latin: Column) -> Column:
        """Ids of a piece of many bytes: every occurrence of the lowest pair is merged at once."""
        start = F.array_join(F.transform(F.split(latin, ""), lambda c: F.get(t["char_of"], F.get(t["byte_id"], F.ascii(c)).cast("int"))), "")
        steps = F.sequence(F.lit(1), F.greatest(F.length(latin) - 1, F.lit(1)))
        folded = F.aggregate(steps, F.struct(start.alias("s"), F.lit(True).alias("on")), lambda state, _: cls._step(t, state), lambda state: state["s"])
        return F.transform(F.split(folded, ""), lambda c: F.ascii(c) - OFFSET)

    @classmethod
    def _pieces(cls, t: Column, latin: Column) -> Column:
        """The word cut wherever no token of the vocabulary can lie across: none is the two bytes there, and none holds
        them with the byte before or the byte after. No merge crosses such a place, so the pieces are encoded alone."""

        def cut(codes: Column) -> Column:
            held = lambda bits, at: F.getbit(F.get(bits, F.shiftright(at, 6)), at % 64) == 1
            at = lambda i: F.get(codes, i)

            def joined(x: Column, i: Column) -> Column:
                two = at(i - 1) * 256 + x
                before = F.coalesce(held(t["threes"], at(i - 2) * 65536 + two), F.lit(False))
                return held(t["twos"], two) | before | F.coalesce(held(t["threes"], two * 256 + at(i + 1)), F.lit(False))

            starts = F.filter(F.transform(codes, lambda x, i: F.when((i == 0) | ~joined(x, i), i)), lambda i: i.isNotNull())
            return let(starts, lambda ss: F.transform(ss, lambda s, k: F.substring(latin, s + 1, F.coalesce(F.get(ss, k + 1), F.length(latin)) - s)))

        return let(F.transform(F.split(latin, ""), lambda c: F.ascii(c)), cut)

    @classmethod
    def encode_word(cls, t: Column, word: Column) -> Column:
        """Ids of one word of the pattern; t is the struct of the encoder's arrays.

        A long word is cut into pieces no merge can cross, of which each different one is folded once."""
        one = lambda p: F.when(F.length(p) <= SHORT, cls._short(t, p)).otherwise(cls._long(t, p))

        def many(pieces: Column) -> Column:
            different = F.array_distinct(pieces)
            return let(different, lambda d: let(F.transform(d, one), lambda ids: F.flatten(F.transform(pieces, lambda p: F.get(ids, F.array_position(d, p).cast("int") - 1)))))

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return let(latin, lambda w: F.when(F.length(w) <= SHORT, cls._short(t, w)).otherwise(let(cls._pieces(t, w), many)))

    def with_words(self, df: DataFrame, word: str, ids: str) -> DataFrame:
        """df with the ids of a column of words."""
        return df.withColumn(CONSTANT, constant(self.spark, **self.arrays)).select(*df.columns, let(F.col(CONSTANT), lambda t: self.encode_word(t, F.col(word))).alias(ids))

    def with_bytes(self, df: DataFrame, ids: str, out: str) -> DataFrame:
        """df with the bytes of a column of lists of ids."""
        pieces = constant(self.spark, hexes=pa.array([p.hex() for p in self.pieces]))
        decoded = lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t["hexes"], i)), ""))
        return df.withColumn(CONSTANT, pieces).select(*df.columns, let(F.col(CONSTANT), decoded).alias(out))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def common_words(texts: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """word, n of the words of at most SHORT bytes whose count is at least the lowest that no more than `most` words reach."""
    counts = materialize(texts.filter("text <> ''").select(F.explode(words(F.col("text"))).alias("word")).filter(F.octet_length("word") <= SHORT).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    # Counts in classes: exact up to 1024, then 64 to each doubling, so the table of classes is bounded.
    size = F.when(F.col("n") <= 1024, F.col("n").cast("double")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * 64) / 64 + 1e9)
    classes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()
    total, least = 0, None
    for c in classes:
        total += c["words"]
        if total > most:
            break
        least = c["least"]
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


class Lookup:
    """The table of common words with their ids: a word is in one of two places, and the commoner words choose first."""

    def __init__(self, encoder: Encoder, common: DataFrame):
        self.encoder = encoder
        spark = encoder.spark
        parts = max(1, spark.sparkContext.defaultParallelism)
        rows = encoder.with_words(common.repartition(parts).select(*(p(F.col("word")).alias(f"at{i}") for i, p in enumerate(self.PLACE)), "word", "n"), "word", "ids").collect()
        table: list = [None] * PLACES
        for r in sorted(rows, key=lambda r: (-r["n"], r["word"])):
            at = r["at0"] if table[r["at0"]] is None else r["at1"]
            if table[at] is None:
                table[at] = {"w": r["word"], "i": r["ids"]}
        self.table = pa.array(table, pa.struct([("w", pa.string()), ("i", pa.list_(pa.int32()))]))

    PLACE = tuple(lambda word, h=h: F.pmod(h(word), F.lit(PLACES)).cast("int") for h in (F.xxhash64, F.hash))

    def with_ids(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with a column ids: those of its texts."""
        encoder = self.encoder

        def of(t: Column) -> Column:
            # every word's entry first, then a comparison: two light passes cost less than one that looks up twice
            entries = lambda ws: let(t["table"], lambda at: F.transform(ws, lambda w: F.get(at, self.PLACE[0](w))))
            second = lambda w: let(F.get(t["table"], self.PLACE[1](w)), lambda e: F.when(e["w"] == w, e["i"]).otherwise(encoder.encode_word(t, w)))
            chosen = lambda ws, es: F.zip_with(ws, es, lambda w, e: F.when(e["w"] == w, e["i"]).otherwise(second(w)))
            return let(words(F.col(text)), lambda ws: F.flatten(chosen(ws, entries(ws))))

        ids = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<int>")).otherwise(let(F.col(CONSTANT), of))
        return df.withColumn(CONSTANT, constant(encoder.spark, **encoder.arrays, table=self.table)).select(*df.columns, ids.alias("ids"))


def encode(documents: DataFrame, path: str = VOCABULARY, most: int = DICTIONARY) -> DataFrame:
    """documents with the column ids: array<int> of its column text."""
    encoder = Encoder(documents.sparkSession, path)
    with scratch(documents.sparkSession):
        lookup = Lookup(encoder, common_words(documents, most))
    return lookup.with_ids(documents)

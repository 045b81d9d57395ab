"""Phrase collocation mining over Rabin-Karp fingerprints.

A text is cut into pieces and these into words; a phrase is a run of words within a
piece. Tasks hash whole chunks of texts at once: prefix sums of a polynomial in the word
hashes give the fingerprint of every run by one subtraction and one product. What is
shuffled is a chunk's distinct fingerprints, each with its count, a pointer to an
occurrence (hash of the text, number of the word) and a second, shorter check hash.

Only a phrase whose parts are frequent can be frequent, so runs of three and four words
are counted where all their word pairs may be frequent, by a bitmap of those pairs.
It only saves work: all fingerprints that get through are counted exactly.

Frequent fingerprints are verified and read from the text that their pointer names. A
fingerprint that several phrases have (unequal checks, or words at the pointer with
another fingerprint) is counted anew by the words themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import flagged, membership, saved

LONGEST = 4
#: Bytes of text that a task gathers before it counts their words, and words whose hash it remembers.
CHUNK, REMEMBERED = 5 * 2**20, 250_000
#: Fingerprints of a bucket, about.
BUCKET = 2**20
#: Bits of the bitmap of frequent pairs per pair, and the most bits.
BITS_PER_PAIR, MOST_BITS = 16, 2**27

BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
FOLD, SPIN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(10 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece of a text, A-Z in lower case."""
    return [p.split() for p in text.translate(LOWER).split(b"\n")]


class Vocabulary(dict):
    """Numbers the words it meets and keeps 128 bits of hash of each."""

    def __init__(self) -> None:
        self.digests: list[bytes] = []
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.digests.append(xxhash.xxh3_128_digest(word))
        self.words.append(word)
        return number

    def reset(self) -> None:
        self.clear()
        self.digests.clear()
        self.words.clear()


class Powers:
    """Powers of an odd base modulo 2^64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            out = np.full(n, self.base, np.uint64)
            out[0] = 1
            self.known = np.multiply.accumulate(out)
        return self.known[:n]


class Polynomial:
    """Hashes of runs: sums of the members' hashes times falling powers of a base, by prefix sums."""

    def __init__(self, base: int) -> None:
        self.up, self.down = Powers(base), Powers(pow(base, -1, 2**64))
        self.prefix = np.zeros(1, np.uint64)

    def over(self, h: np.ndarray) -> None:
        self.prefix = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.down(len(h)), dtype=np.uint64, out=self.prefix[1:])

    def __call__(self, n: int, at: np.ndarray) -> np.ndarray:
        """The hash of the n members from each place on."""
        return (self.prefix[at + n] - self.prefix[at]) * self.up(len(self.prefix))[at + (n - 1)]


def finished(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * FOLD
    h = (h ^ (h >> np.uint64(32))) * SPIN
    return h ^ (h >> np.uint64(29))


class Chunk:
    """Texts of one language: their words in a row, and the fingerprints of runs of words."""

    def __init__(self, lang: str, texts: list[tuple[int, bytes]], vocabulary: Vocabulary, bits: int) -> None:
        texts = sorted(texts)  # by hash: the first occurrence is the one with the least pointer
        ids, lengths, sizes = [], [], []
        for _, text in texts:
            words = pieces(text)
            lengths.append(np.fromiter(map(len, words), np.int32, len(words)))
            sizes.append(int(lengths[-1].sum()))
            ids.append(np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(words)), np.int32, sizes[-1]))
        self.ids = np.concatenate(ids)
        counts = np.concatenate(lengths)
        self.piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.texts = np.array([h for h, _ in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        both = np.frombuffer(b"".join(vocabulary.digests), np.uint64).reshape(-1, 2)
        self.seed, self.bits = xxhash.xxh3_64_intdigest(lang.encode()), bits
        self.run, self.second = Polynomial(BASE), Polynomial(CHECK_BASE)
        self.run.over(both[:, 0][self.ids])
        self.second.over(both[:, 1][self.ids])

    def at(self, n: int) -> np.ndarray:
        """Where runs of n words begin that lie within a piece."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def fingerprints(self, n: int, at: np.ndarray) -> np.ndarray:
        return finished(self.run(n, at), self.seed + n & 2**64 - 1) >> np.uint64(64 - self.bits)

    def check(self, n: int, at: np.ndarray) -> np.ndarray:
        return (finished(self.second(n, at), n) >> np.uint64(32)).astype(np.uint32)

    def pointers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the text and number of the word in it."""
        text = np.searchsorted(self.starts, at, side="right") - 1
        return self.texts[text], (at - self.starts[text]).astype(np.int32)


def chunks(batches: Iterator[pa.RecordBatch], bits: int, vocabulary: Vocabulary) -> Iterator[tuple[str, Chunk]]:
    """(lang, th, text) -> chunks of about CHUNK bytes, or of one longer text."""
    held: dict[str, list] = {}
    size: Counter = Counter()

    def made(lang: str) -> tuple[str, Chunk]:
        del size[lang]
        return lang, Chunk(lang, held.pop(lang), vocabulary, bits)

    for batch in batches:
        for lang, th, text in zip(*(batch.column(c) for c in ("lang", "th", "text")), strict=True):
            lang, text = lang.as_py(), text.as_py()
            held.setdefault(lang, []).append((th.as_py(), text))
            size[lang] += len(text)
            # What is held of all languages together is bounded.
            if sum(size.values()) > CHUNK:
                yield made(size.most_common(1)[0][0])
                if len(vocabulary) > REMEMBERED:
                    vocabulary.reset()
    for lang in list(held):
        yield made(lang)


PACKED = "lang string, n int, bucket int, keys binary, counts binary, checks binary, unequal binary, hashes binary, places binary"
TYPES = {"keys": np.uint64, "counts": np.int64, "checks": np.uint32, "unequal": np.bool_, "hashes": np.int64, "places": np.int32}


def counted(chunk: Chunk, n: int, at: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct fingerprints of the runs at some places: count, check, whether checks differ, the least pointer."""
    keys = chunk.fingerprints(n, at)
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[first, len(keys)])
    check = chunk.check(n, at)
    low, high = np.minimum.reduceat(check, first), np.maximum.reduceat(check, first)
    back = np.argsort(at[first])  # in the order of the text, pointers are alike and cost little
    hashes, places = chunk.pointers(at[first][back])
    return {
        "keys": keys[first][back], "counts": counts[back], "checks": low[back], "unequal": (low != high)[back],
        "hashes": hashes, "places": places,
    }


FREQUENT = "lang string, n int, key long, f long, th long, place int, unequal boolean"


def frequent(docs: DataFrame, lengths: list[int], least: int, buckets: int, bits: int, filter_: tuple | None) -> DataFrame:
    """Fingerprints that occur ``least`` times or more; with n = 0, key 0: partial counts of all words of a language."""
    passes = docs.sparkSession.sparkContext.broadcast(filter_)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=list(NAMES)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in chunks(batches, bits, Vocabulary()):
            if 1 in lengths:
                words = np.int64([len(chunk.ids)]).tobytes()
                yield packed([(lang, 0, int(chunk.texts[0]) % buckets, b"", words, *[b""] * 4)])
            able = maybe(passes.value, chunk, 2) if passes.value is not None else None
            for n in lengths:
                at = chunk.at(n)
                for k in range(n - 1 if able is not None else 0):
                    at = at[able[at + k]]
                if not len(at):
                    continue
                found = counted(chunk, n, at)
                bucket = (found["keys"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                found = {c: found[c][order].astype(t) for c, t in TYPES.items()}
                yield packed([
                    (lang, n, b, *[found[c][lo:hi].tobytes() for c in TYPES])
                    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi
                ])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        lang, n = group["lang"].iloc[0], int(group["n"].iloc[0])
        got = {c: np.frombuffer(b"".join(group[c]), t) for c, t in TYPES.items()}
        if n == 0:
            one = {"key": [0], "f": [int(got["counts"].sum())], "th": [0], "place": [0], "unequal": [False]}
            return pd.DataFrame({"lang": [lang], "n": [0], **one})
        order = np.lexsort((got["places"], got["hashes"], got["keys"]))
        got = {c: v[order] for c, v in got.items()}
        first = np.flatnonzero(np.r_[True, got["keys"][1:] != got["keys"][:-1]])
        f = np.add.reduceat(got["counts"], first)
        differ = np.minimum.reduceat(got["checks"], first) != np.maximum.reduceat(got["checks"], first)
        differ |= np.logical_or.reduceat(got["unequal"], first)
        often = f >= least
        at = first[often]
        return pd.DataFrame({
            "lang": lang, "n": n, "key": got["keys"][at].view(np.int64), "f": f[often], "th": got["hashes"][at],
            "place": got["places"][at], "unequal": differ[often],
        })

    return saved(docs.mapInArrow(run, PACKED).groupBy("lang", "n", "bucket").applyInPandas(merge, FREQUENT), "frequent")


NAMES = tuple(c.split()[0] for c in PACKED.split(", "))
ARROW = (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 6)


def bitmap(keys: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """(bits, words) of a membership filter of the column ``key``; its size follows the number of keys up to MOST_BITS."""
    bits = min(MOST_BITS, max(2**12, 1 << (BITS_PER_PAIR * count).bit_length()))
    at = keys.select(F.pmod("key", F.lit(bits)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("set"))
    got = words.toArrow()  # at most MOST_BITS / 64 rows of two numbers
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["set"].to_numpy().view(np.uint64)
    return bits, out


def maybe(filter_: tuple[int, np.ndarray], chunk: Chunk, n: int) -> np.ndarray:
    """Of each place whether the fingerprint of the n words there may be in the filter (False beyond a piece)."""
    bits, words = filter_
    at = chunk.at(n)
    key = chunk.fingerprints(n, at) & np.uint64(bits - 1)  # bits is a power of two
    out = np.zeros(len(chunk.ids), bool)
    out[at] = (words[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1) == 1
    return out


def pointed(docs: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """found with the phrase at the pointer; NULL if the words there have another fingerprint."""
    wanted = saved(found.groupBy("th").agg(F.collect_list(F.struct("lang", "n", "key", "place", "f")).alias("here")), "wanted")
    # Few texts hold all least pointers: the others stay where they are.
    texts = flagged(docs, F.col("th"), membership(wanted.select("th")), "maybe").where("maybe")
    texts = texts.groupBy("th").agg(F.min("text").alias("text")).join(wanted, "th")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, here in zip(batch.column("text"), batch.column("here"), strict=True):
                words = list(chain.from_iterable(pieces(text.as_py())))
                for one in here.as_py():
                    run = words[one["place"] : one["place"] + one["n"]]
                    chunk = Chunk(one["lang"], [(0, b" ".join(run))], Vocabulary(), bits)
                    same = len(run) == one["n"] and chunk.fingerprints(one["n"], np.zeros(1, np.int64)).view(np.int64)[0] == one["key"]
                    out.append((one["lang"], one["n"], one["key"], one["f"], b" ".join(run) if same else None))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["lang", "n", "key", "f", "phrase"],
                )

    return texts.select("text", "here").mapInArrow(read, "lang string, n int, key long, f long, phrase binary")


def recounted(docs: DataFrame, keys: DataFrame, count: int, least: int, bits: int) -> DataFrame:
    """(lang, n, phrase, f) of the phrases whose fingerprint is in ``keys`` (lang, n, key), counted by their words."""
    passes = docs.sparkSession.sparkContext.broadcast(bitmap(keys, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for lang, chunk in chunks(batches, bits, vocabulary):
            counts: Counter = Counter()
            for n in range(1, LONGEST + 1):
                at = np.flatnonzero(maybe(passes.value, chunk, n))
                for start, key in zip(at.tolist(), chunk.fingerprints(n, at).view(np.int64).tolist(), strict=True):
                    counts[n, key, b" ".join([vocabulary.words[i] for i in chunk.ids[start : start + n].tolist()])] += 1
            if counts:
                n, key, phrase = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(phrase, pa.binary()),
                     pa.array(counts.values(), pa.int64())], names=["lang", "n", "key", "phrase", "f"],
                )

    rows = docs.mapInArrow(run, "lang string, n int, key long, phrase binary, f long")
    rows = rows.groupBy("lang", "n", "key", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return rows.join(keys.select("lang", "n", "key"), ["lang", "n", "key"], "left_semi").select("lang", "n", "phrase", "f")


def phrase_counts(docs: DataFrame, least: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of all phrases of up to LONGEST words that occur ``least`` times, and (lang, words).

    NULL languages count as ``und``, a NULL text as empty. ``bits`` cuts fingerprints short, for tests.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.xxhash64("text").alias("th"),
        F.col("text").cast("binary").alias("text"),
    ).where("length(text) > 0")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(12, size // 6 // BUCKET)
    short = frequent(rows, [1, 2], least, buckets, bits, None)
    pairs = short.where("n = 2").select("key")
    long = frequent(rows, [3, 4], least, buckets, bits, bitmap(pairs, pairs.count()))
    found = short.where("n > 0").union(long)
    read = saved(pointed(rows, found.where("not unequal"), bits), "phrases")
    phrases = read.where("phrase is not null").select("lang", "n", "phrase", "f")
    doubtful = saved(
        found.where("unequal").select("lang", "n", "key").union(read.where("phrase is null").select("lang", "n", "key")), "doubtful"
    )
    if count := doubtful.count():
        phrases = phrases.union(saved(recounted(rows, doubtful, count, least, bits), "recounted"))
    words = short.where("n = 0").groupBy("lang").agg(F.sum("f").alias("words"))
    return phrases.withColumn("phrase", F.col("phrase").cast("string")), words


def collocations(docs: DataFrame, least: int = 30, cover: int = 80, top: int | None = 2000, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of phrases of two to four words that occur ``least`` times or more.

    A phrase is scored at the cut of its words that scores least (ties: the first cut): 2 000 000 times its count a,
    by the sum of the counts l and r of both parts, rounded down. A phrase whose words stand in a longer one that
    occurs at least ``cover`` percent as often goes. ``rank`` orders a language by score and count, highest first,
    and by phrase in the order of its bytes; ``top`` limits it. Texts may be NULL, empty or of any length; equal
    rows count each. An empty table gives an empty table. Only lang and text are read.
    """
    phrases, words = phrase_counts(docs, least, bits)
    phrases = saved(phrases, "counts")
    candidates = phrases.where("n > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")
    cuts = candidates.select(
        "lang", "phrase", "n", "a", F.explode(F.expr("sequence(1, n - 1)")).alias("k"), split.alias("w")
    ).select(
        "lang", "phrase", "n", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest"),
    )
    part = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(
        "(cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    )
    least_cut = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "n", "a").agg(least_cut)
    inner = candidates.where("n > 2").select(
        "lang", F.col("a").alias("longer"), F.col("n").alias("of"), F.split("phrase", " ").alias("w")
    ).select("lang", "longer", "of", "w", F.explode(F.expr("sequence(2, of - 1)")).alias("size")).select(
        "lang", "longer", "w", "size", F.explode(F.expr("sequence(1, of - size + 1)")).alias("start")
    ).select("lang", "longer", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.expr(f"100 * cast(longer as decimal(19,0)) >= {cover} * cast(a as decimal(19,0))")
    kept = scored.join(held, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("words").alias("n"), F.col("cut.score").alias("score"),
    )

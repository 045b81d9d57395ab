"""Near duplicates by b-bit MinHash.

A document's set is that of its word shingles. Of each of its minima over 160 hash
functions the low two bits are kept, packed into five numbers; bands of five whole
minima make the candidates. Two signatures that agree in a share m of their bit pairs
have an estimated similarity of (m - 1/4) / (1 - 1/4), as unequal minima agree by
chance one time in four. Candidates whose estimate is far below the threshold are
dropped; the others are confirmed on their full sets.

A pair at similarity 0.8 shares none of the 32 bands with a chance of 3 in a million.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.llm.common import components, flagged, mapped, membership, numbered_rows, saved
from harvestlens.llm.linking import linked, shared_keys

BANDS, BAND_ROWS, BITS = 32, 5, 2
MINIMA = BANDS * BAND_ROWS
LONGS = MINIMA * BITS // 64
#: The estimate may fall short of the threshold by this much: over six standard deviations at 0.8.
MARGIN = 0.25
#: Words whose hash is remembered in a task; then the memory is emptied.
REMEMBERED = 100_000

MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SEEDS = np.random.default_rng(20).integers(0, 2**63, (2, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX2
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a lower-cased (A-Z) text; of all its words as one, if they are fewer."""
    split = (text or b"").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    width = min(words, len(h))
    joined = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        joined = joined * MIX + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(joined))


def minima(h: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(h), 2048):
        part = h[start : start + 2048, None] * SEEDS[0] + SEEDS[1]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 32 pairs to a number."""
    pairs = (least & np.uint64(3)).reshape(LONGS, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(pairs, axis=1).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mixed(key * MIX + rows[:, k])
    return key.view(np.int64)


SIGNATURES = "doc_id long, n_shingles long, hi long, lo long, signature array<long>, bands array<long>"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row: set size, a 128-bit hash of the set, packed low bits and band keys (empty without words)."""
    state: list[WordHashes] = []

    def rows(batch: dict) -> dict:
        hashes = state[0] if state else state.append(WordHashes()) or state[0]
        out: dict[str, list] = {c.split()[0]: [] for c in SIGNATURES.split(", ")}
        out["doc_id"] = batch["doc_id"]
        for text in batch["text"]:
            h = shingles(text.as_py(), words, hashes)
            hi, lo = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            least = minima(h) if len(h) else None
            for name, value in (
                ("n_shingles", len(h)), ("hi", hi), ("lo", lo),
                ("signature", packed(least) if len(h) else []), ("bands", bands(least) if len(h) else []),
            ):
                out[name].append(value)
        return out

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text"), rows, SIGNATURES)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, hash of the set and the full set."""
    state: list[WordHashes] = []

    def rows(batch: dict) -> dict:
        hashes = state[0] if state else state.append(WordHashes()) or state[0]
        out: dict[str, list] = {"hi": [], "lo": [], "shingles": []}
        for text in batch["text"]:
            h = shingles(text.as_py(), words, hashes)
            hi, lo = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            out["hi"].append(hi)
            out["lo"].append(lo)
            out["shingles"].append(h.view(np.int64))
        return out | {"doc_id": batch["doc_id"]}

    return mapped(
        docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text"), rows,
        "doc_id long, hi long, lo long, shingles array<long>",
    )


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from packed low bits, corrected for chance agreement."""
    unequal = F.lit(0)
    for k in range(LONGS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        unequal = unequal + F.bit_count(either)
    chance = 1 / 2**BITS
    return (1 - unequal / MINIMA - chance) / (1 - chance)


def full_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """id and full set of the class representatives that share a band with another."""
    numbers = needed.select(F.col("id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Texts that surely are not needed stay where they are.
    bitmap = membership(numbers.select(F.xxhash64("doc_id")))
    texts = flagged(texts, F.xxhash64("doc_id"), bitmap, "_maybe").where("_maybe").drop("_maybe").join(numbers, "doc_id")
    found = shingle_sets(texts, words).join(needed.withColumnRenamed("id", "doc_id"), ["doc_id", "hi", "lo"])
    return saved(found.select(F.col("doc_id").alias("id"), "shingles"), "sets")


#: Members of a family that are compared with as many others in one task step.
FAMILY_BLOCK = 1024


def compare_family(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different roots, by exact intersections of bit sets; of two roots one link is enough."""
    sizes = np.array([len(s) for s in sets])
    vocabulary, places = np.unique(np.concatenate(sets), return_inverse=True)
    # Shingles that one member alone has add nothing to an intersection.
    counts = np.bincount(places)
    column = np.cumsum(counts > 1) - 1
    flags = np.zeros((len(sets), ((counts > 1).sum() + 64) // 64 * 64), bool)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = counts[places] > 1
    flags[owner[often], column[places[often]]] = True
    bits = np.packbits(flags, axis=1).view(np.uint64)

    order = np.unique(roots)
    joined = np.arange(len(order))  # the current root of each root
    at = np.searchsorted(order, roots)
    links = []
    # Members of small roots are compared with all; those of the largest root not with each other.
    largest = np.bincount(at).argmax()
    for k in np.flatnonzero(at != largest):
        both = np.bitwise_count(bits & bits[k]).sum(axis=1, dtype=np.int64)
        near = 100 * both >= percent * (sizes + sizes[k] - both)
        for other in np.unique(at[near]):
            if joined[other] != joined[at[k]]:
                links.append((int(ids[k]), int(ids[np.flatnonzero(near & (at == other))[0]])))
                joined[joined == joined[other]] = joined[at[k]]
    return links


def family_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(center, id, root) -> links (a, b) between roots. Large families are compared block by block."""
    sizes = families.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        families.join(saved(sizes, "sizes"), "center")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("center", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "id", "root")
        .join(sets, "id")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("id")
        found = compare_family(group["id"].to_numpy(), group["root"].to_numpy(), group["shingles"].tolist(), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("center", "one", "two").applyInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked when 100 * intersection >= percent * union of their sets.
    ``component_id`` is the smallest doc_id reachable; ``kept`` says whether it is the
    row's own. Rows that share a doc_id are one document. Documents without words are
    linked with nothing; a row without doc_id is linked with nothing, has no
    component_id and is kept. Columns other than doc_id and text are not read.
    """
    rows = saved(signatures(docs, words), "signatures")
    able = rows.where("n_shingles > 0 and doc_id is not null")
    # Equal sets are one class, named by its smallest doc_id; only classes are compared.
    classes = saved(
        able.groupBy("hi", "lo").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    shared = shared_keys(classes.select("id", F.explode("bands").alias("key")))
    needed = saved(shared.select("id").distinct().join(classes.select("id", "hi", "lo"), "id"), "needed")
    sets = full_sets(docs, needed, words)

    def close(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        fits = 100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))
        return fits & (estimate(a("signature"), b("signature")) >= percent / 100 - MARGIN)

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(a, "a").join(b, "b").where(
            100 * both >= percent * (F.size("sa") + F.size("sb") - both)
        ).select("a", "b")

    edges = linked(
        classes.select("id", "n", "signature"), shared, close, verify, lambda many: family_links(many, sets, percent)
    )
    # A doc_id with several texts links their classes.
    own = able.select("doc_id", "hi", "lo").distinct()
    several = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    named = own.join(several, "doc_id").join(classes.select("hi", "lo", "id"), ["hi", "lo"])
    edges = edges.union(named.where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    roots = saved(components(edges), "roots")
    groups = saved(
        classes.join(roots, classes.id == roots.node, "left").select("hi", "lo", F.coalesce("root", "id").alias("root")),
        "groups",
    )
    found = rows.select("doc_id", "n_shingles", "hi", "lo").join(groups, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows but for all of a group of near copies other than one, that with the smallest doc_id (rows without one last).

    Each row is judged by its own text: a doc_id may have several texts, and of equal rows one stays. Rows without
    words stay. Columns may have any names.
    """
    rows, restored = numbered_rows(docs)
    found = near_groups(rows.select(F.col("number").alias("doc_id"), F.col("row")["text"].alias("text")), words, percent)
    found = saved(found.select(F.col("doc_id").alias("number"), "component_id"), "components")
    owned = found.join(rows.select("number", F.col("row")["doc_id"].cast("long").alias("doc_id")), "number")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "number")
    first = owned.groupBy("component_id").agg(F.min(order).alias("first")).select("first.number")
    gone = saved(found.select("number").join(saved(first, "first"), "number", "left_anti"), "gone")
    # Texts that certainly stay are not moved.
    rows = flagged(rows, F.xxhash64("number"), membership(gone.select(F.xxhash64("number"))), "_maybe")
    stay = rows.where("not _maybe").select("row")
    return restored(stay.union(rows.where("_maybe").join(gone, "number", "left_anti").select("row")))

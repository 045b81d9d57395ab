"""Fuzzy line deduplication.

Lines are compared in normalised form: A-Z in lower case, no ASCII punctuation, single
blanks. Equal forms are one line from the start. Forms whose edit distance, in words, is
at most a fifth of the longer form are linked, and of each connected group the first
occurrence (smallest doc_id, then text hash, then place) stays.

At that similarity the SimHashes of two whole lines differ in a fifth of their bits, too
many for blocks of bits that tell lines apart. So a line's signature is made of blocks that
are SimHashes themselves, one for every run of two to four neighbouring words (longer runs
for longer lines). By the pigeonhole principle, edits can touch only so many of them: lines
that are similar have equal blocks, on which they are joined. Of a line with more than BLOCKS
blocks those with the least hashes are taken, the same ones in similar lines. Every form has a
bag as well: the parity of its words' numbers in 256 parts of their hashes, which an edit
changes in two bits at most. Candidates are dropped where the bags differ in more than the
edits allow (lines of more than LONG words are told apart by their SimHashes at once), then where the SimHashes of the whole lines, 256 bits, differ in more than
MOST_DIFFERENT, and the others are verified by their edit distance. Only lines with a
candidate by their bags are fetched.

Up to 26 words no line at the similarity is without a common block. Beyond, two lines at the
very threshold share a quarter of their blocks: that no one of 24 agrees has a chance of one
in a thousand. Two lines at the threshold differ in more than MOST_DIFFERENT bits as rarely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import accumulate, islice
from operator import add, ne

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.llm.common import components, flagged, mapped, membership, saved, text_key
from harvestlens.llm.neardup import MIX, mixed
from harvestlens.llm.sketches import NO_ID

SIMILARITY = 0.8
#: Blocks by which a line is joined, at most.
BLOCKS = 24
#: Words of 64 bits of a whole line's SimHash, and bits in which those of similar lines may differ.
SIGNATURE, MOST_DIFFERENT = 4, 84
#: Numbers of 64 bits of a line's bag, which is as large as its SimHash, and words beyond which a line has that instead.
BAG, LONG = SIGNATURE, 256
#: Words of a block by the words of the line (least, most). Ranges overlap by what similar lines may differ in length.
RUNS = ((3, 8, 24), (4, 20, 2**31))
#: Lines up to this length have blocks of two words, told apart by the length of the shorter line.
SHORT = 7
#: Blocks of a bucket, about, and those that a task gathers before it passes them on.
BUCKET, GATHERED = 2**20, 2**18
#: Bits of a block's key, and lines whose blocks are sorted at once: both share a number of 64 bits.
KEY_BITS, AT_ONCE = 50, 2**14
#: Bytes of lines whose bags or SimHashes are made at once, and those that a line counts for at least.
BYTES_AT_ONCE, LEAST_BYTES = 2**18, 128
#: Lengths travel as powers of this.
STEP = 1.05
#: Members of a block up to which its pairs are made one by one, by the SimHashes alone; pairs made at once.
FEW, PAIRS = 64, 2**20
#: Members of a family that are compared with as many others in one task step.
FAMILY_BLOCK = 4096
#: Lines that lines are compared with at once, which keeps the numbers within a processor's cache.
WIDE = 2048
#: Parts of a large family, for every FAMILY_BLOCK of its members.
PARTS = 4
#: Words that are ranked by their frequency, which one of RANKED_OF lines tells.
COMMON, RANKED_OF = 2**14, 64
KEEP = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in "-/_|\t\v\f\r" else c for c in range(256))
#: The bits of a byte as eight counters.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
#: Hash values of bytes, and the base of the polynomials that make words of them.
BYTES = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "-/_|")


def forms_in(text: bytes) -> list[bytes]:
    """Each line of a text in normal form; empty for lines without a letter or digit."""
    text = text.translate(KEEP, DROP)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return [line.strip(b" ") for line in text.split(b"\n")]


def normalised(text: bytes) -> list[list[bytes]]:
    """The words of each line of a text in normal form; none for lines without a letter or digit."""
    return [form.split() for form in forms_in(text)]


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, a column of differences at a time as the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for k, item in enumerate(a):
        places[item] = places.get(item, 0) | 1 << k
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = whole, 0, len(a)
    for item in b:
        same = places.get(item, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(diagonal | up) & whole, up & diagonal
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | ~(diagonal | more) & whole, more & diagonal
    return distance


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether the edit distance in words is at most 1 - similarity of the longer."""
    one, two = a.split(), b.split()
    most = int((1 - similarity) * max(len(one), len(two)) + 1e-9)
    if abs(len(one) - len(two)) > most:
        return False
    # Edits suffice that change words in place, up to some place counted from the start and then from the end.
    starts, ends = list(map(ne, one, two)), list(map(ne, reversed(one), reversed(two)))
    in_place = map(add, accumulate(starts, initial=0), reversed(list(accumulate(ends, initial=0))))
    if min(in_place) + abs(len(one) - len(two)) <= most:
        return True
    # Words that both begin or end with take none.
    start, end = starts.index(True), ends.index(True)
    one, two = one[start : len(one) - end], two[start : len(two) - end]
    # Words that the lines do not have in common take an edit each, whatever their order.
    common = sum((Counter(one) & Counter(two)).values())
    return max(len(one), len(two)) - common <= most and edit_distance(one, two) <= most


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse."""
    if len(POWERS) == 0 or len(POWERS[0]) < n:
        both = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            steps = np.full(max(n, 2**20), base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        POWERS[:] = both
    return POWERS[0][:n], POWERS[1][:n]


POWERS: list[np.ndarray] = []


def word_hashes(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of non-empty forms, one form after the other, and the number of words of each."""
    joined = np.frombuffer(b"\n".join(forms) + b"\n", np.uint8)
    ends = np.flatnonzero((joined == 32) | (joined == 10))
    starts = np.r_[0, ends[:-1] + 1]
    up, down = powers(len(joined))
    sums = np.cumsum(BYTES[joined] * up, dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    flat = mixed(mixed((sums[ends - 1] - before) * down[starts]) * MIX + (ends - starts).astype(np.uint64))
    last = np.flatnonzero(joined[ends] == 10)
    return flat, np.diff(np.r_[-1, last])


def simhashes(forms: list[bytes]) -> np.ndarray:
    """SimHash of each non-empty form, SIGNATURE numbers: the majority of the bits of its words' hashes."""
    flat, counts = word_hashes(forms)
    # Counters of a byte hold up to 255 words: longer lines are counted in parts.
    parts = -(-counts // 255)
    first = parts.cumsum() - parts
    inside = np.arange(parts.sum()) - np.repeat(first, parts)
    at = np.repeat(counts.cumsum() - counts, parts) + 255 * inside
    found = np.empty((len(forms), SIGNATURE), np.int64)
    for k in range(SIGNATURE):
        places = mixed(flat * MIX + np.uint64(k)).view(np.uint8).reshape(-1, 8)
        lanes = np.stack([np.add.reduceat(LANES[places[:, b]], at) for b in range(8)], axis=1).view(np.uint8).reshape(-1, 64)
        ones = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        found[:, k] = np.packbits(ones * 2 > counts[:, None], axis=1).view(np.int64).ravel()
    return found


def bags(forms: list[bytes]) -> np.ndarray:
    """The bag of each non-empty form, BAG numbers: whether an odd number of its words falls in each of the parts.

    A line of more than LONG words, whose bag would be full, has its SimHash instead.
    """
    flat, counts = word_hashes(forms)
    part = np.repeat(np.arange(len(forms)), counts) * (64 * BAG) + (flat >> np.uint64(56)).astype(np.int64)
    odd = np.bincount(part, minlength=len(forms) * 64 * BAG).astype(np.uint8) & 1
    found = np.packbits(odd.reshape(len(forms), -1), axis=1).view(np.int64)
    if len(long := np.flatnonzero(counts > LONG)):
        found[long] = simhashes([forms[k] for k in long])
    return found


def by_parts(made: Callable[[list[bytes]], np.ndarray], forms: list[bytes]) -> np.ndarray:
    """The numbers that ``made`` finds for each form, for BYTES_AT_ONCE of forms at a time: its arrays, and the powers kept, stay small."""
    found, part, size = [np.zeros((0, SIGNATURE), np.int64)], [], 0
    for form in forms:
        part.append(form)
        size += max(len(form), LEAST_BYTES)
        if size > BYTES_AT_ONCE:
            found.append(made(part))
            part, size = [], 0
    return np.concatenate([*found, made(part)] if part else found)


def bags_fit(one: np.ndarray, two: np.ndarray, bag: np.ndarray, length: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the lines at places ``one`` and ``two`` may be similar by their lengths and bags."""
    longer, shorter = np.maximum(length[one], length[two]), np.minimum(length[one], length[two])
    # An edit changes two bits; those that make up for the lengths change one.
    edits = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    most = np.where(shorter > LONG, MOST_DIFFERENT, np.where(longer > LONG, 64 * BAG, 2 * edits - (longer - shorter)))
    differ = np.bitwise_count(bag[one, 0] ^ bag[two, 0]).astype(np.int64)
    for k in range(1, BAG):
        differ += np.bitwise_count(bag[one, k] ^ bag[two, k])
    return (differ <= most) & (longer - shorter <= edits)


@cache
def blocks_needed(n: int, similarity: float) -> np.ndarray:
    """By the words of a line: of its blocks of n words, how many of the least hashes one of a similar line is among, BLOCKS at most.

    Before the least block that both have stand only blocks that the edits touch: n for each edit, but one
    less where the longer line has a word more.
    """
    needed = np.full(256, BLOCKS)
    for words in range(len(needed) - 1):
        longer, most = words, 0
        while longer - words <= (edits := int((1 - similarity) * longer + 1e-9)) and most < BLOCKS:
            most, longer = max(most, n * edits - (longer - words) + 1), longer + 1
        needed[words] = min(most, BLOCKS)
    return needed


def run_simhashes(flat: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every n neighbouring words: the bits that most of their hashes have."""
    w = [flat[k : len(flat) - n + 1 + k] for k in range(n)]
    if n == 2:
        return w[0] & w[1]
    if n == 3:
        return w[0] & w[1] | w[2] & (w[0] | w[1])
    return w[0] & w[1] & (w[2] | w[3]) | w[2] & w[3] & (w[0] | w[1])


def block_keys(forms: list[bytes], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the line and the key of the blocks of each form, and the words of each form."""
    flat, counts = word_hashes(forms)
    line = np.repeat(np.arange(len(forms), dtype=np.uint64), counts)
    length = counts[line]
    found = [np.zeros(0, np.uint64)]

    def add(n: int, wanted: np.ndarray, tag: np.ndarray | None = None) -> None:
        at = np.flatnonzero((line[n - 1 :] == line[: len(line) - n + 1]) & wanted[: len(line) - n + 1])
        if not len(at):
            return
        sim = run_simhashes(flat, n)[at] * MIX + np.uint64(n)
        key = mixed(mixed(sim) * MIX + (0 if tag is None else tag[at].astype(np.uint64)))
        both = np.sort(line[at] << np.uint64(KEY_BITS) | key >> np.uint64(64 - KEY_BITS))
        both = both[np.r_[True, both[1:] != both[:-1]]]
        owner, place = both >> np.uint64(KEY_BITS), np.arange(len(both))
        new = np.r_[True, owner[1:] != owner[:-1]]
        needed = blocks_needed(n, similarity)[np.minimum(counts, 255)][owner.astype(np.int64)]
        found.append(both[place - np.maximum.accumulate(np.where(new, place, 0)) < needed])

    for shorter in (0, 1):
        add(2, (length - shorter >= 4) & (length - shorter <= SHORT), length - shorter)
    for n, least, most in RUNS:
        add(n, (length >= least) & (length <= most))
    both = np.concatenate(found)
    return (both >> np.uint64(KEY_BITS)).astype(np.int64), both & np.uint64(2**KEY_BITS - 1), counts


def shared_blocks(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, id, center, n): the forms (id: the low half of their hash) that have a block in common with another of fitting length.

    Of two forms alone there is one row, that of the other than the center. Keys travel packed, in buckets,
    with their length rounded. A bucket is a bounded part of all keys.
    """
    buckets = buckets_of(words)
    gap = int(np.log(1 / similarity) / np.log(STEP)) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def passed() -> pa.RecordBatch:
            key, one, length = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = key % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            parts = [(b, order[lo:hi]) for b, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if lo < hi]
            # Of a key, the bits that the bucket does not tell: 32 keep those of one bucket apart but for a few.
            rest = (key // np.uint64(buckets)).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in parts], pa.int32()), *[pa.array([c[at].tobytes() for _, at in parts], pa.binary()) for c in (rest, one, length)]],
                names=["bucket", "keys", "ids", "lengths"],
            )

        def blocks(forms: dict[bytes, bytes]) -> int:
            line, key, counts = block_keys(list(forms.values()), similarity)
            ids = np.frombuffer(b"".join(forms), np.int64).reshape(-1, 2)[:, 1]
            rounded = np.minimum(np.log(counts) / np.log(STEP), 255).astype(np.uint8)
            held.append((key, ids[line], rounded[line]))
            return len(key)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                forms: dict[bytes, bytes] = {}
                for text in batch.column(0).slice(start, 256):
                    for form in forms_in(text.as_py() or b""):
                        if form.count(b" ") > 2 and (d := xxhash.xxh3_128_digest(form)) not in seen:
                            forms[d] = form
                            seen.add(d)
                    if len(forms) > AT_ONCE // 2:
                        size += sum(blocks(dict(islice(forms.items(), k, k + AT_ONCE))) for k in range(0, len(forms), AT_ONCE))
                        forms = {}
                    if size > GATHERED:
                        yield passed()
                        held, size = [], 0
                if forms:
                    size += blocks(forms)
                if len(seen) > 2**17:
                    seen.clear()
        if size:
            yield passed()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        key, one, length = (np.frombuffer(b"".join(group[c]), t) for c, t in (("keys", np.uint32), ("ids", np.int64), ("lengths", np.uint8)))
        # Keys that one form has are most.
        order = np.argsort(key, kind="stable")
        key, one, length = key[order], one[order], length[order].astype(np.int64)
        same = key[1:] == key[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        key, one, length = key[several], one[several], length[several]
        order = np.lexsort((one, length, key))
        key, one, length = key[order], one[order], length[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (one[1:] != one[:-1])][: len(key)]
        key, one, length = key[new], one[new], length[new]
        if not len(key):
            return pd.DataFrame({"key": one, "id": one, "center": one, "n": one})
        # No form beyond a gap in the lengths is similar to one before it.
        starts = np.r_[True, (key[1:] != key[:-1]) | (length[1:] - length[:-1] >= gap)]
        number = starts.cumsum() - 1
        at = np.flatnonzero(starts)
        center, n = np.minimum.reduceat(one, at)[number], np.bincount(number)[number]
        bucket = np.uint64(group["bucket"].iloc[0])
        named = mixed((key.astype(np.uint64) << np.uint64(8) | length[at][number].astype(np.uint64)) * MIX + bucket).view(np.int64)
        more = (n > 2) | (n == 2) & (one != center)
        return pd.DataFrame({"key": named[more], "id": one[more], "center": center[more], "n": n[more]})

    packed = docs.selectExpr("cast(text as binary) text").mapInArrow(run, "bucket int, keys binary, ids binary, lengths binary")
    return saved(packed.groupBy("bucket").applyInPandas(meet, "key long, id long, center long, n long"), "shared")


def buckets_of(words: int) -> int:
    return max(12, words // 2 // BUCKET)


SIMS = [f"s{k}" for k in range(SIGNATURE)]
BAGS = [f"b{k}" for k in range(BAG)]


def close(a: Callable[[str], Column], b: Callable[[str], Column], similarity: float) -> Column:
    """Whether two lines may be similar by their lengths and SimHashes."""
    lengths = F.least(a("length"), b("length")) >= similarity * F.greatest(a("length"), b("length")) - 1e-9
    return lengths & (reduce(Column.__add__, [F.bit_count(a(s).bitwiseXOR(b(s))) for s in SIMS]) <= MOST_DIFFERENT)


def close_pairs(members: DataFrame, buckets: int, similarity: float) -> DataFrame:
    """(key, id, length, bags) -> the pairs (a, b) within keys of at most FEW members that may be similar."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "id"])
        key, one, length = (group[c].to_numpy() for c in ("key", "id", "length"))
        bag = bag_of(group)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        found = [(one[:0], one[:0])]
        for n in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(n, 1)
            of, step = starts[sizes == n], max(1, PAIRS // len(i))
            for k in range(0, len(of), step):
                a, b = ((of[k : k + step, None] + x).ravel() for x in (i, j))
                near = bags_fit(a, b, bag, length, similarity)
                found.append((one[a[near]], one[b[near]]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        return pd.DataFrame({"a": a[new], "b": b[new]})

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    return members.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "a long, b long")


def bags_close(a: Callable[[str], Column], b: Callable[[str], Column], similarity: float) -> Column:
    """As bags_fit(), of columns."""
    longer, apart = F.greatest(a("length"), b("length")), F.abs(a("length") - b("length"))
    edits = F.floor((1 - similarity) * longer + 1e-9)
    most = F.when(longer - apart > LONG, MOST_DIFFERENT).when(longer > LONG, 64 * BAG).otherwise(2 * edits - apart)
    return (apart <= edits) & (reduce(Column.__add__, [F.bit_count(a(c).bitwiseXOR(b(c))) for c in BAGS]) <= most)


def bag_of(group: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(group[BAGS].to_numpy()).view(np.uint64)


def with_partner(root: np.ndarray, length: np.ndarray, bag: np.ndarray, similarity: float) -> np.ndarray:
    """Of each line, whether one of another root may be similar to it by its length and bag."""
    order = np.argsort(length, kind="stable")
    root, length, bag = root[order], length[order].astype(np.int64), bag[order]
    words = np.ascontiguousarray(bag.T)
    # What bags_fit() allows: a share of the longer line and one of the shorter.
    edits = ((1 - similarity) * length + 1e-9).astype(np.int64)
    longer = np.where(length > LONG, 64 * BAG, 2 * edits - length).astype(np.int16)
    shorter = np.minimum(length, LONG).astype(np.int16)
    found = np.zeros(len(root), bool)
    for at in range(0, len(root), 64):
        # Partners are sought among lines that are as long or longer, but not too long.
        end = min(at + 64, len(root))
        to = int(np.searchsorted(length, length[end - 1] / similarity + 1, "right"))
        for start in range(at, to, WIDE):
            others = slice(start, min(start + WIDE, to))
            differ = np.zeros((end - at, others.stop - start), np.int16)
            most = shorter[at:end, None] + longer[others]
            if length[end - 1] > LONG:
                most[length[at:end] > LONG] = MOST_DIFFERENT
            for w in words:
                differ += np.bitwise_count(w[at:end, None] ^ w[others])
                near = differ <= most
                # Once few are left, they are tested one by one.
                if np.count_nonzero(near) * 32 < near.size:
                    break
            one, two = np.nonzero(near)
            one, two = one + at, two + start
            other = root[one] != root[two]
            one, two = one[other], two[other]
            near = bags_fit(one, two, bag, length, similarity)
            found[one[near]] = found[two[near]] = True
    back = np.empty(len(order), bool)
    back[order] = found
    return back


def open_families(families: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The rows of (center, id, root) that may have a link: of families up to FAMILY_BLOCK, those with a partner by their bags."""
    sizes = families.groupBy("center").agg(F.count(F.lit(1)).alias("n"))
    sized = saved(families.join(sizes, "center"), "sized")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = with_partner(group["root"].to_numpy(), group["length"].to_numpy(), bag_of(group), similarity)
        return group.loc[found, ["center", "id", "root"]]

    few = sized.where(F.col("n") <= FAMILY_BLOCK).drop("n")
    able = flagged(sketches, F.col("id"), membership(few.select("id")), "_maybe").where("_maybe").drop("_maybe")
    few = few.join(able, "id")
    met = few.groupBy("center").applyInPandas(run, "center long, id long, root long")
    return saved(met.union(sized.where(F.col("n") > FAMILY_BLOCK).drop("n")), "open")


OCCURRENCES = "id0 long, th long, line int, hi long, lo long, length int, " + ", ".join(f"{c} long" for c in BAGS)


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line with a word: its place, a 128-bit hash of the normal form, its number of words and its bag."""

    def rows(batch: dict) -> dict:
        found, digests, lengths, made = [], [], [], [np.zeros((0, BAG), np.int64)]
        waiting, size = [], 0
        for k, text in enumerate(batch["text"]):
            forms = forms_in(text.as_py() or b"")
            found += [(k, line) for line, form in enumerate(forms) if form]
            waiting += filter(None, forms)
            size += sum(max(len(f), LEAST_BYTES) for f in forms if f)
            if size > BYTES_AT_ONCE or k == len(batch["text"]) - 1:
                digests += map(xxhash.xxh3_128_digest, waiting)
                lengths += [f.count(b" ") + 1 for f in waiting]
                made.append(by_parts(bags, waiting))
                waiting, size = [], 0
        text, line = np.array(found, np.int64).reshape(-1, 2).T
        hi, lo = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        ids = [batch[c].to_numpy(zero_copy_only=False)[text] for c in ("id0", "th")]
        columns = [*ids, line.astype(np.int32), hi, lo, np.array(lengths, np.int32), *np.concatenate(made).T]
        return dict(zip([c.split()[0] for c in OCCURRENCES.split(", ")], columns, strict=True))

    return mapped(keyed(docs).selectExpr("id0", "th", "cast(text as binary) text"), rows, OCCURRENCES)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("id0", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("th", text_key(F.col("text")))


def forms_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, length, SimHashes, form) of the wanted (id, id0, th, line): only lines that may be wanted are moved or reach Python."""
    places = saved(wanted, "wanted")
    place = F.xxhash64("id0", "th", "line")
    split = F.posexplode(F.split("text", "\n")).alias("line", "raw")
    # Only texts that may have a wanted line are split.
    text = F.xxhash64("id0", "th")
    texts = flagged(keyed(docs.select("doc_id", "text")), text, membership(places.select(text)), "_maybe").where("_maybe")
    lines = flagged(texts.select("id0", "th", split), place, membership(places.select(place)), "_maybe")
    # Rows equal in doc_id and text have the same places.
    found = lines.where("_maybe").join(places, ["id0", "th", "line"]).dropDuplicates(["id0", "th", "line"])

    def rows(batch: dict) -> dict:
        forms = [forms_in(raw.as_py())[0] for raw in batch["raw"]]
        made = by_parts(simhashes, forms).T
        return {"id": batch["id"], "length": [f.count(b" ") + 1 for f in forms], **dict(zip(SIMS, made, strict=True)), "form": forms}

    schema = "id long, length int, " + ", ".join(f"{s} long" for s in SIMS) + ", form binary"
    return mapped(found.selectExpr("id", "cast(raw as binary) raw"), rows, schema)


def each_time(form: bytes) -> list[tuple[bytes, int]]:
    """Every word with the number of the same words before it."""
    seen: dict[bytes, int] = {}
    words = form.split()
    for k, w in enumerate(words):
        seen[w] = n = seen.get(w, -1) + 1
        words[k] = (w, n)
    return words


def first_words(form: bytes, similarity: float, commonness: dict[bytes, int]) -> list[int]:
    """Hashes of a line's rarest words (the k-th time of a word is a word of its own), one more than edits can touch.

    Of two similar lines, the rarest word in common is among these of both, whatever the order that makes
    words rare: before it stand only words that the other line lacks.
    """
    placed = sorted((commonness.get(w, 0), w, k) for w, k in each_time(form))
    most = int((1 - similarity) * len(placed) + 1e-9)
    return [xxhash.xxh3_64_intdigest(w, k) - 2**63 for _, w, k in placed[: most + 1]]


def common_words(texts: DataFrame) -> dict[bytes, int]:
    """A rank for the COMMON most frequent words, the commonest last. It only orders words, so a part of the lines tells enough."""
    word = F.explode(F.split(F.col("form").cast("string"), " ")).alias("word")
    counted = texts.where(F.pmod(F.col("id"), F.lit(RANKED_OF)) == 0).select(word).groupBy("word").count()
    rows = counted.orderBy(F.desc("count"), "word").limit(COMMON).collect()
    return {r.word.encode(): len(rows) - k for k, r in enumerate(rows)}


def pairs_within(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each run of places, at most about PAIRS at once."""
    # Each place meets those behind it in its run; long rows of partners are handed out in parts.
    behind = np.repeat(sizes, sizes) - 1 - (np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes))
    place = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes) + np.repeat(starts, sizes)
    place, behind = place[behind > 0], behind[behind > 0]
    ends = behind.cumsum()
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = behind[at:to]
        a = np.repeat(place[at:to], n)
        yield a, a + 1 + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        at = to


def members_of(tokens: list, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all tokens, those of a token in a row by length, and where the tokens of several lines start and how many they have."""
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    token = np.concatenate([np.asarray(t, np.int64) for t in tokens])
    by = np.lexsort((owner, lengths[owner], token))
    token, owner = token[by], owner[by]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    return owner, starts[sizes > 1], sizes[sizes > 1]


def with_partner_by_word(root: np.ndarray, length: np.ndarray, bag: np.ndarray, tokens: list, similarity: float) -> np.ndarray:
    """As with_partner(), among lines with a token in common."""
    owner, starts, sizes = members_of(tokens, length)
    found, few = np.zeros(len(root), bool), sizes <= FEW
    for a, b in pairs_within(sizes[few], starts[few]):
        one, two = owner[a], owner[b]
        other = root[one] != root[two]
        one, two = one[other], two[other]
        near = bags_fit(one, two, bag, length, similarity)
        found[one[near]] = found[two[near]] = True
    for start, size in zip(starts[~few], sizes[~few], strict=True):
        lines = owner[start : start + size]
        found[lines[with_partner(root[lines], length[lines], bag[lines], similarity)]] = True
    return found


def compare_family(
    ids: list, roots: list, forms: list[bytes], sims: np.ndarray, similarity: float, tokens: list | None = None
) -> list[tuple[int, int]]:
    """Links that join different roots, of lines with a token (else one of their first words) in common; of two roots one link is enough."""
    if tokens is None:
        tokens = [first_words(f, similarity, {}) for f in forms]
    lengths = np.array([f.count(b" ") + 1 for f in forms])
    most = ((1 - similarity) * lengths + 1e-9).astype(np.int64)
    sims = np.ascontiguousarray(sims, np.int64).view(np.uint64)  # of signed numbers, bits are counted without the sign
    order, at = np.unique(np.array(roots), return_inverse=True)
    joined = np.arange(len(order))  # the current root of each root
    owner, starts, sizes = members_of(tokens, lengths)
    links, bags = [], {}

    def in_common(x: int, y: int) -> int:
        for k in (x, y):
            if k not in bags:
                bags[k] = frozenset(each_time(forms[k]))
        return len(bags[x] & bags[y])

    for a, b in pairs_within(sizes, starts):
        one, two = owner[a], owner[b]
        fits = (joined[at[one]] != joined[at[two]]) & (lengths[two] - lengths[one] <= most[two])
        one, two = one[fits], two[fits]
        differ = np.zeros(len(one), np.int64)
        for k in range(sims.shape[1]):
            differ += np.bitwise_count(sims[one, k] ^ sims[two, k])
        near = differ <= MOST_DIFFERENT
        pairs = np.unique(one[near] * len(ids) + two[near])
        for x, y in zip((pairs // len(ids)).tolist(), (pairs % len(ids)).tolist(), strict=True):
            # Words that two lines do not have in common take an edit each. The second line is the longer.
            if joined[at[x]] == joined[at[y]] or lengths[y] - in_common(x, y) > most[y]:
                continue
            if similar(forms[x], forms[y], similarity):
                links.append((int(ids[x]), int(ids[y])))
                joined[joined == joined[at[y]]] = joined[at[x]]
    return links


def family_squares(families: DataFrame, forms: DataFrame, similarity: float) -> DataFrame:
    """(center, id, root) and (id, form, SimHashes) -> the rows that are compared within (center, part, one, two).

    Only lines that share one of their rarest words are compared; those without such a partner there, by
    their bags, are left out before any text is moved. A large family is dealt out by these words: a line goes to at most as many parts as it has such words, however large the family.
    A part that one word makes large all the same is compared block by block.
    """
    ranks = common_words(forms)

    @F.arrow_udf("array<long>")
    def rarest(batch: pa.Array) -> pa.Array:
        return pa.array([first_words(f, similarity, ranks) for f in batch.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("array<long>")
    def bag(batch: pa.Array) -> pa.Array:
        found = by_parts(bags, batch.to_pylist())
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), BAG).cast(pa.list_(pa.int64()))

    def partners(group: pd.DataFrame) -> pd.DataFrame:
        found = with_partner_by_word(group["root"].to_numpy(), group["length"].to_numpy(), bag_of(group), group["tokens"].tolist(), similarity)
        return group.loc[found, ["center", "part", "one", "two", "id", "root", "tokens"]]

    # Most lines belong to no family: they stay where they are.
    wanted = flagged(forms, F.col("id"), membership(families.select("id")), "_maybe").where("_maybe").drop("_maybe")
    tokens = wanted.select("id", rarest("form").alias("rarest"), F.size(F.split(F.col("form").cast("string"), " ")).alias("length"), bag("form").alias("bag"))
    tokens = saved(tokens.select("id", "rarest", "length", *[F.col("bag")[k].alias(b) for k, b in enumerate(BAGS)]), "tokens")
    n = F.count(F.lit(1))
    parts = families.groupBy("center").agg(
        F.when(n <= FAMILY_BLOCK, 1).otherwise(F.ceil(n * PARTS / FAMILY_BLOCK)).cast("long").alias("parts")
    )
    dealt = saved(
        families.join(saved(parts, "sizes"), "center").join(tokens, "id")
        .withColumn("part", F.explode(F.array_distinct(F.transform("rarest", lambda t: F.pmod(t, F.col("parts"))))))
        .withColumn("tokens", F.filter("rarest", lambda t: F.pmod(t, F.col("parts")) == F.col("part")))
        .select("center", "part", "id", "root", "tokens", "length", *BAGS),
        "dealt",
    )
    sizes = dealt.groupBy("center", "part").agg(
        F.ceil(n / FAMILY_BLOCK).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    squares = (
        dealt.join(saved(sizes.where("low < high").drop("low", "high"), "sizes"), ["center", "part"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
        .select("center", "part", "one", "two", "id", "root", "tokens", "length", *BAGS)
    )
    met = squares.groupBy("center", "part", "one", "two").applyInPandas(
        partners, "center long, part long, one int, two int, id long, root long, tokens array<long>"
    )
    return saved(met, "met").join(wanted, "id")


def family_links(families: DataFrame, forms: DataFrame, similarity: float) -> DataFrame:
    """(center, id, root) and (id, form, SimHashes) -> links (a, b) between roots."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("id").sort_values("id")
        found = compare_family(
            group["id"].tolist(), group["root"].tolist(), [bytes(f) for f in group["form"]], group[SIMS].to_numpy(),
            similarity, group["tokens"].tolist(),
        )
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    squares = family_squares(families, forms, similarity)
    return squares.groupBy("center", "part", "one", "two").applyInPandas(run, "a long, b long")


def links(docs: DataFrame, forms: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all similar forms with a block in common.

    Blocks of few members are paired; of others each member is first compared with the
    smallest one. Members of those that are not connected by then are compared as families.
    """
    shared = shared_blocks(docs, words, similarity)
    sketches = forms.select("id", "length", *BAGS)

    def texts(ids: DataFrame) -> DataFrame:
        """(id, length, SimHashes, form) of the ids."""
        numbers = saved(ids.distinct(), "ids")
        few = flagged(forms, F.col("id"), membership(numbers), "_maybe").where("_maybe")
        wanted = few.join(numbers, "id").select("id", "first.id0", "first.th", "first.line")
        return saved(forms_of(docs, wanted), "texts")

    def side(table: DataFrame, letter: str) -> DataFrame:
        return table.select(*[F.col(c).alias(letter if c == "id" else f"{letter}_{c}") for c in table.columns])

    def of(letter: str) -> Callable[[str], Column]:
        return lambda name: F.col(f"{letter}_{name}")

    small = shared.where((F.col("n") > 2) & (F.col("n") <= FEW)).select("key", "id").join(sketches, "id")
    stars = shared.where(((F.col("n") > FEW) | (F.col("n") == 2)) & (F.col("id") != F.col("center")))
    stars = stars.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b")
    stars = stars.where(bags_close(of("a"), of("b"), similarity)).select("a", "b")
    near = saved(close_pairs(small, buckets_of(words), similarity).union(stars).distinct(), "near")

    @F.arrow_udf("boolean")
    def same(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array([similar(a.as_py(), b.as_py(), similarity) for a, b in zip(one, two, strict=True)], pa.bool_())

    paired = texts(near.select(F.col("a").alias("id")).union(near.select("b")))
    pairs = near.join(side(paired, "a"), "a").join(side(paired, "b"), "b").where(close(of("a"), of("b"), similarity))
    found = saved(pairs.where(same("a_form", "b_form")).select("a", "b"), "links")

    roots = saved(components(found), "roots")
    members = shared.where(F.col("n") > FEW).select("key", "id", "center")
    members = saved(
        members.join(roots, members.id == roots.node, "left").select("key", "id", "center", F.coalesce("root", "id").alias("root")),
        "members",
    )
    still = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    many = saved(members.join(still, "key").select("center", "id", "root").distinct(), "families")
    many = open_families(many, sketches, similarity)
    more = saved(family_links(many, texts(many.select("id")).drop("length"), similarity), "links")
    return roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id0, th, line) of all lines but the first of each group."""
    seen = saved(occurrences(docs), "lines")
    place = F.struct("id0", "th", "line")
    # Half of the hash names a form from here on.
    forms = saved(
        seen.groupBy("hi", "lo").agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("length", *BAGS)]
        ).withColumn("id", F.col("lo")),
        "forms",
    )
    words = seen.agg(F.sum("length")).first()[0] or 0
    roots = saved(components(links(docs, forms, words, similarity)), "roots")
    # Most forms have no copy: they and their lines stay where they are.
    copied = flagged(forms, F.col("id"), membership(roots.select("node")), "_maybe").where("_maybe or n > 1")
    grouped = copied.join(roots, copied.id == roots.node, "left").where("root is not null or n > 1")
    grouped = saved(grouped.select("hi", "lo", "first", "root"), "grouped")
    firsts = grouped.where("root is not null").groupBy("root").agg(F.min("first").alias("group_first"))
    keepers = grouped.join(firsts, "root", "left").select("hi", "lo", F.coalesce("group_first", "first").alias("keeper"))
    copies = flagged(seen, F.col("lo"), membership(grouped.select("lo")), "_maybe").where("_maybe")
    return copies.join(keepers, ["hi", "lo"]).where(place != F.col("keeper")).select("id0", "th", "line")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All rows and columns, the text without its removed lines; n_removed is added or replaced.

    Lines end at line feeds. Lines without a letter or digit are no one's copy and stay;
    so does a NULL text. A text may be left empty. Rows equal in doc_id and text are one
    document: their lines stay in each of them or go from each. Rows without doc_id come
    first in the order of occurrences.
    """
    columns = [c for c in docs.columns if c != "n_removed"]
    gone = saved(
        removed_lines(docs, similarity).repartition("id0", "th").distinct().groupBy("id0", "th").agg(F.collect_list("line").alias("gone")),
        "gone",
    )
    # The caller's columns wait in one struct: no name of theirs can clash.
    whole = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(columns)]).alias("row")
    rows = docs.select(whole, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id0"), text_key(docs["text"]).alias("th"))
    rows = flagged(rows, F.xxhash64("id0", "th"), membership(gone.select(F.xxhash64("id0", "th"))), "maybe")
    same = rows.where("not maybe").select("row", F.lit(None).cast("array<int>").alias("gone"))
    cut = rows.where("maybe").join(gone, ["id0", "th"], "left").select("row", "gone")
    old = F.col("row")[f"c{columns.index('text')}"]
    split = F.split(old, "\n")

    def joined(parts: Column) -> Column:
        stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    # As an argument the lines are split once for a text; within the inner function they would be for each line.
    text = F.when(F.col("gone").isNull(), old).otherwise(F.get(F.transform(F.array(split), joined), F.lit(0)))
    return same.union(cut).select(
        *[(text if c == "text" else F.col("row")[f"c{k}"]).alias(c) for k, c in enumerate(columns)],
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )

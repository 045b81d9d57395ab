"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and an end mark; only a document longer than a sequence is
cut. Pieces shorter than a sequence are dealt to shards of bounded size. On each shard
several islands evolve packings of their own. A child takes well-filled bins of one
parent whole; bins of the other parent that hold one of their documents are removed, and
the documents that so lost their place, with those of the emptiest bins, are put by best
fit, longest first. Between epochs the best packing of each island moves to the next
island. Of all islands the best packing stands.

What a shard could not fill well is dealt anew with that of the other shards, level by
level, as long as the levels shrink; so shards cost no half-empty sequences each.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm.common import mapped, saved

SEQUENCE = 2048
END_ID = 0
#: Pieces of a shard, about.
SHARD_PIECES = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 10, 4
#: Bins with more free room than this are packed anew on the next level.
LOOSE = SEQUENCE // 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """Encoder of a rank file: the ids of the tokenizers library for the JSON file of the same name beside it.

    Texts without one of the JSON's added tokens are encoded from the ranks, which is
    several times faster; the others by the library itself.
    """
    import tiktoken
    import tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = tokenizers.Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")
    added = [token.content for token in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, path: str, most: int = SEQUENCE) -> DataFrame:
    """Pieces of every row's ids: one, or if longer than ``most`` several, of which only the first may be shorter.

    ``path`` names a rank file that every executor can read, with the JSON file beside it. NULL text counts as empty
    and has its end mark only.
    """
    ready: list = []

    def rows(batch: dict) -> dict:
        if not ready:
            ready.append(encoder(path))
        out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids = np.array([*ready[0](text.as_py() or ""), END_ID], "<u4")
            first = len(ids) % most or most
            ends = range(first, len(ids) + 1, most) if len(ids) > most else [len(ids)]
            start = 0
            for number, end in enumerate(ends):
                part = ids[start:end]
                for name, value in zip(out, (doc_id, number, start, end - start, zlib.crc32(part.tobytes())), strict=True):
                    out[name].append(value)
                start = end
        return out

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), rows, PIECES)


class Packing:
    """Bins of item numbers; ``room`` is what is free in each."""

    def __init__(self, bins: list[list[int]], room: list[int]) -> None:
        self.bins, self.room = bins, room

    @classmethod
    def of(cls, assigned: np.ndarray, lengths: list[int], size: int) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(assigned.max(initial=-1)) + 1)]
        for item, b in enumerate(assigned):
            bins[b].append(item)
        return cls(bins, [size - sum(lengths[i] for i in b) for b in bins])

    def assigned(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for number, items in enumerate(self.bins):
            out[items] = number
        return out

    def rank(self) -> tuple[int, int]:
        """Fewer bins are better; among as many, those of unequal filling."""
        return len(self.bins), -sum(r * r for r in self.room)

    def best_fit(self, items: list[int], lengths: list[int], size: int) -> None:
        """Put each item where it leaves least room. Bins of a room are found by the bits of one number."""
        by_room: dict[int, list[int]] = {}
        mask = 0
        for b, room in enumerate(self.room):
            if room:
                by_room.setdefault(room, []).append(b)
                mask |= 1 << room
        for item in items:
            length = lengths[item]
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                same = by_room[room]
                b = same.pop()
                if not same:
                    mask ^= 1 << room
                self.bins[b].append(item)
            else:
                room, b = size, len(self.bins)
                self.bins.append([item])
                self.room.append(size)
            room -= length
            self.room[b] = room
            if room:
                by_room.setdefault(room, []).append(b)
                mask |= 1 << room


def child(one: Packing, two: Packing, lengths: list[int], size: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of ``two`` in ``one``; what they or the emptiest bins displace is put by best fit."""
    order = np.argsort(two.room, kind="stable")[: max(1, len(two.bins) // 2)]
    chosen = rng.choice(order, max(1, int(len(order) * rng.uniform(0.2, 0.8))), replace=False).tolist()
    bins = [list(two.bins[b]) for b in chosen]
    room = [two.room[b] for b in chosen]
    taken = {item for items in bins for item in items}
    loose = set(np.argsort(one.room, kind="stable")[len(one.bins) - max(2, len(one.bins) // 20):].tolist())
    displaced = []
    for b, items in enumerate(one.bins):
        if b not in loose and taken.isdisjoint(items):
            bins.append(list(items))
            room.append(one.room[b])
        else:
            displaced += [i for i in items if i not in taken]
    made = Packing(bins, room)
    displaced.sort(key=lambda i: -lengths[i])
    made.best_fit(displaced, lengths, size)
    return made


def evolve(
    lengths: np.ndarray, started: list[np.ndarray], seed: list[int], size: int = SEQUENCE,
    generations: int = GENERATIONS, population: int = POPULATION,
) -> list[np.ndarray]:
    """Packings of the items (bin numbers per item), best first; it ends early where no packing can be better."""
    rng, n = np.random.default_rng(seed), len(lengths)
    values = lengths.tolist()
    people = [Packing.of(a, values, size) for a in started]
    while len(people) < population:
        # The first island's first packing is plain best fit of the longest first; others shuffle the order a little.
        blur = rng.uniform(0.8, 1.2, n) if people or seed[-1] else np.ones(n)
        made = Packing([], [])
        made.best_fit(np.argsort(-lengths * blur, kind="stable").tolist(), values, size)
        people.append(made)
    least = -(-int(lengths.sum()) // size)
    people.sort(key=Packing.rank)
    for _ in range(generations):
        if len(people[0].bins) <= least:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        made = child(people[a], people[b], values, size, rng)
        if made.rank() < people[-1].rank():
            people[-1] = made
            people.sort(key=Packing.rank)
    return [p.assigned(n) for p in people[:population]]


def packed_level(items: DataFrame, level: int, size: int) -> DataFrame:
    """(rid, length) -> rid, length, sequence_id, offset, room: one level of shards, islands and migrations."""
    shards = max(1, round(items.count() / SHARD_PIECES))
    dealt = saved(items.withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(shards)).cast("int")), "dealt")
    dealt = dealt.select("shard", "rid", "length", F.lit(None).cast("binary").alias("packing"))
    everywhere = dealt.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))

    def split(group: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
        """The items of a shard in the order of their numbers, and the packings that came with them."""
        came = [np.frombuffer(p, np.int32) for p in group["packing"] if p is not None]
        return group[group["packing"].isna()].sort_values("rid").reset_index(drop=True), came

    def epoch(number: int):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            own, came = split(group)
            best = evolve(own["length"].to_numpy(np.int64), came, [level, int(key[0]), number, int(key[1])], size)
            return pd.DataFrame({
                "shard": key[0], "island": key[1], "place": range(len(best)),
                "bins": [int(p.max(initial=-1)) + 1 for p in best], "packing": [p.tobytes() for p in best],
            })

        return run

    columns = ["shard", "island", "rid", "length", "packing"]
    groups = everywhere.select(columns)
    for number in range(EPOCHS):
        grown = saved(
            groups.groupBy("shard", "island").applyInPandas(
                epoch(number), "shard int, island int, place int, bins int, packing binary"
            ),
            "islands",
        )
        # The best packing of each island moves on; the worst of the next makes room for it.
        moved = grown.where("place = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        people = grown.where(F.col("place") < POPULATION - 1).union(moved)
        none = F.lit(None).cast("long")
        groups = everywhere.select(columns).union(people.select("shard", "island", none, none, "packing"))
    best = grown.where("place = 0").groupBy("shard").agg(F.min_by("packing", F.struct("bins", "island")).alias("packing"))

    def lay(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own, (found,) = split(group)
        own["bin"] = found.astype(np.int64)
        by_bin = own.groupby("bin")["length"]
        return pd.DataFrame({
            "rid": own["rid"].astype(np.int64), "length": own["length"].astype(np.int64),
            "sequence_id": (np.int64(level) << 56) + (np.int64(key[0]) << 20) + own["bin"],
            "offset": (by_bin.cumsum() - own["length"]).astype(np.int64),
            "room": (size - by_bin.transform("sum")).astype(np.int64),
        })

    none = F.lit(None).cast("long")
    return saved(
        dealt.union(best.select("shard", none, none, "packing")).groupBy("shard").applyInPandas(
            lay, "rid long, length long, sequence_id long, offset long, room long"
        ),
        "packed",
    )


def packed(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """Every piece of every row with its sequence and place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequences
    hold at most ``size`` ids and are filled gaplessly from 0. Rows are told apart even
    if all their columns agree; columns other than doc_id and text are not read. An
    empty table gives an empty table.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    cut = saved(pieces(docs, path, size).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == size).select(
        "rid", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    done, left, before, level = [whole], cut.where(F.col("length") < size).select("rid", "length"), None, 0
    while True:
        laid = packed_level(left, level, size)
        loose = F.col("room") > size // (SEQUENCE // LOOSE)
        count = laid.where(loose).count()
        shards = laid.count() / SHARD_PIECES
        # The last level keeps all that it packed: it is one shard, or dealing anew no longer shrinks what is left.
        last = shards <= 1.5 or not count or (before is not None and count > before // 2)
        done.append((laid if last else laid.where(~loose)).select("rid", "sequence_id", "offset"))
        if last:
            break
        left, before, level = laid.where(loose).select("rid", "length"), count, level + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.union(more)
    return cut.join(placed, "rid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

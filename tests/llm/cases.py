"""Small tables with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, key string, size int, shard int, slot int, root long, hi long, th long, line int, part int, weight double, "
    "gone string, _id0 long, _th long, _at int, _word string, _maybe boolean, _id string, _key string, maybe int, id0 string"
)
CLASHING = ("g", 1, 2, 3, "w", True, "i", "k", 4, "z")
WORDS = "the of and tion ing heen ated ouse er it Ñandú straße".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) + "."


def texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    base = prose(rng, 60)
    near = base.split()
    near[7] = "changed"
    far = base.split()
    far[20:40] = prose(rng, 20).split()
    line = prose(rng, 30)
    close = line.split()
    close[3] = "other"
    return [
        base, base, " ".join(near), " ".join(far), None, "", " \t\n ", "word", "Word", "two words",
        f"{line}\n{prose(rng, 12)}", f"{prose(rng, 9)}\n{line}\n{line}", f"{' '.join(close)}\n{prose(rng, 8)}",
        "a\n\n---\nb c d", prose(rng, 3000), "x" * 5000, "\U0001f600 é ß   z", prose(rng, 5),
        "BUY NOW!! " * 40, "same same same " * 30, "odd### text$$$ here&&& with%%% marks*** " * 10,
        "Licensed under the Apache License, Version 2.0.", "GNU general\nPublic-License and cc by",
    ]


def messy(spark: SparkSession) -> DataFrame:
    """Texts of all kinds, a missing doc_id, a repeated row, a doc_id with two texts and columns with clashing names."""
    rows = [(k * 3, t, "en", [None, "b", "a", "ä"][k % 4]) for k, t in enumerate(texts())]
    rows += [(None, "without number", "en", "a"), rows[0], (9, "another text of nine", None, "b")]
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 1, "k", 2, 3, 4, 5, 6, 7, 8, 9, 0.5, *CLASHING) for r in rows], SCHEMA
    )


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def groups(nodes: list, linked) -> dict:
    """Smallest node reachable, by comparing all with all."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}

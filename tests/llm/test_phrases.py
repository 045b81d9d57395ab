"""Phrases against plain counting, with whole and with colliding fingerprints."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from harvestlens.llm import phrases
from tests.llm.cases import empty, messy


def plain(rows, least, cover=80, top=2000):
    f, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                for k in range(len(w) - n + 1):
                    f[lang, tuple(w[k : k + n])] += 1
    able = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, p), a in able.items():
        for n in range(2, len(p)):
            for k in range(len(p) - n + 1):
                inside[lang, p[k : k + n]] = max(inside[lang, p[k : k + n]], a)
    out = defaultdict(list)
    for (lang, p), a in able.items():
        if (lang, p) in inside and 100 * inside[lang, p] >= cover * a:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))
        )
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, k + 1, p.decode(), -a, left, right, words[lang], -score)
        for lang, found in out.items() for k, (score, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 9])
def test_equals_plain(spark, bits):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ñandú", "ß", "two\x0bx", "end.", "New York", "New York city", "a\tb", "X", "\U0001f600"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(vocabulary, [9, 8, 3, 2, 1, 4, 3, 2, 2, 1, 1], k=rng.randrange(60)))) for _ in range(150)]
    rows += [(None, None), ("en", ""), ("en", " \t"), rows[0], rows[0]]
    docs = spark.createDataFrame([(lang, t, "x", 1, 2) for lang, t in rows], "lang string, text string, phrase string, n int, th long").repartition(4)
    got = rows_of(phrases.collocations(docs, least=6, bits=bits))
    assert got == plain(rows, 6) and len(got) > 40


def test_top_is_cut_by_rank(spark):
    rows = [("en", "a b c d e f g " * 3)] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.collocations(docs, least=2, top=3)) == plain(rows, 2, top=3)


def test_messy_and_empty(spark):
    docs = messy(spark)
    assert rows_of(phrases.collocations(docs, least=3)) == plain([(r.lang, r.text) for r in docs.collect()], 3)
    assert phrases.collocations(empty(spark)).collect() == []


def test_fingerprints_follow_the_words():
    texts = [(5, b"one two three one two three. one two"), (2, b"three one two")]
    chunk = phrases.Chunk("en", texts, phrases.Vocabulary(), 64)
    at = chunk.at(2)
    keys = chunk.fingerprints(2, at)
    where = dict(zip(zip(*(c.tolist() for c in chunk.pointers(at)), strict=True), keys, strict=True))
    assert where[5, 0] == where[5, 3] == where[5, 6] == where[2, 1]
    assert len(set(keys.tolist())) == 3 and len(at) == 8
    found = phrases.counted(chunk, 2, at)
    best = int(np.argmax(found["counts"]))
    assert (found["counts"][best], found["hashes"][best], found["places"][best]) == (4, 2, 1)

"""Operators on documents against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from harvestlens.llm import licenses, lines, mixing, neardup, packing, quality, sharding, sketches, wordpieces
from tests.llm.cases import empty, groups, messy, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def test_packing_covers_every_id_and_overfills_nothing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = messy(spark).collect()
    got = packing.packed(messy(spark), RANKS, 256).collect()
    wanted = Counter()
    for d in docs:
        ids = [*plain.encode(d.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        starts = [0] if len(ids) <= 256 else [0, *range(first, len(ids), 256)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            part = b"".join(i.to_bytes(4, "little") for i in ids[a:b])
            wanted[d.doc_id, k, a, b - a, zlib.crc32(part)] += 1
    assert Counter(tuple(r)[:5] for r in got) == wanted
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.packed(empty(spark), RANKS).count() == 0


def test_islands_improve_on_shuffled_best_fit():
    import numpy as np

    lengths = np.random.default_rng(5).integers(300, 900, 400)
    one = packing.evolve(lengths, [], [0, 1], generations=0, population=1)[0]
    best = packing.evolve(lengths, [], [0, 1], generations=60)[0]
    assert best.max() <= one.max()
    assert np.bincount(best, lengths).max() <= packing.SEQUENCE
    assert len(best) == 400


def test_token_counts_equal_greedy_matching(spark):
    vocabulary = set(wordpieces.vocabulary(PIECES))
    longest = max(map(len, vocabulary))

    def greedy(word):
        word, n = "▁" + word, 0
        while word:
            for k in range(min(longest, len(word)), 0, -1):
                if word[:k] in vocabulary:
                    word, n = word[k:], n + 1
                    break
            else:
                return None
        return n

    got = wordpieces.token_counts(messy(spark), PIECES).collect()
    wanted = []
    for d in messy(spark).collect():
        words = [greedy(w) for w in BLANK.findall(d.text or "")]
        wanted.append((d.doc_id, len(words), sum(1 if n is None else n for n in words), words.count(None)))
    assert Counter(map(tuple, got)) == Counter(wanted)
    assert wordpieces.token_counts(empty(spark), PIECES).count() == 0


def test_failure_links_pop_what_greedy_matching_takes():
    automaton = wordpieces.Automaton(["a", "ab", "abcd", "c", "bcx", "▁"])
    assert [automaton.pieces(w) for w in ("abc", "abcd", "abcda", "abcx", "b", "", "ccab")] == [2, 1, 2, -1, -1, 0, 3]


def test_lines_equal_all_pairs(spark):
    rows = messy(spark).select("doc_id", "text").collect()
    places = sorted(
        {((d.doc_id if d.doc_id is not None else sketches.NO_ID), d.text) for d in rows}, key=lambda x: (x[0], x[1] or "")
    )
    forms = {}
    keyed = lines.keyed(messy(spark)).select("id0", "th", "text").distinct().collect()
    th = {(r.id0, r.text): r.th for r in keyed}
    for id0, text in places:
        for k, words in enumerate(lines.normalised((text or "").encode())):
            if words:
                forms[id0, th[id0, text], k] = words

    def linked(a, b):
        return lines.similar(b" ".join(forms[a]), b" ".join(forms[b]), 0.8)

    roots = groups(sorted(forms), linked)
    got = {tuple(r) for r in lines.removed_lines(messy(spark)).collect()}
    assert got == {p for p, r in roots.items() if p != r}
    assert got
    done = lines.deduplicated(messy(spark))
    assert done.columns == [*messy(spark).columns, "n_removed"]
    assert done.count() == len(rows)
    first = {r.doc_id: r.text for r in done.collect()}
    assert first[30] == texts()[10] and first[12] is None and first[39] == "a\n\n---\nb c d"
    assert lines.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups_equal_all_pairs(spark, words):
    sets = defaultdict(list)
    rows = messy(spark).select("doc_id", "text").collect()
    for d in rows:
        w = BLANK.findall((d.text or "").encode().lower().decode())
        s = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        if d.doc_id is not None:
            sets[d.doc_id].append(s)

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])

    roots = groups(sorted(sets), linked)
    got = neardup.near_groups(messy(spark), words).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else roots[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sum(not r.kept for r in got) >= 2
    assert neardup.near_groups(empty(spark)).count() == 0
    assert neardup.one_of_each(messy(spark)).columns == messy(spark).columns


def test_equal_rows_are_taken_one_by_one(spark):
    rows = [(1, "a b c d", "x")] * 10 + [(2, "e f g h", "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mixed(docs).collect()}
    got = [r.source for r in mixing.mix(docs).collect()]
    assert all(abs(4 * got.count(s) - t) <= 4 for s, t in target.items())


def test_one_of_each_judges_rows(spark):
    base = texts()[0]
    rows = [(1, base), (2, base), (2, texts()[10]), (None, texts()[14]), (None, texts()[14]), (9, texts()[10]), (9, texts()[10]), (4, None), (4, None)]
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, number string").repartition(3)
    got = neardup.one_of_each(docs).collect()
    kept = sorted(((r.doc_id, r.text) for r in got), key=str)
    assert kept == sorted([(1, base), (2, texts()[10]), (None, texts()[14]), (4, None), (4, None)], key=str)


def test_families_are_compared_without_emitting_pairs():
    import numpy as np

    sets = [np.arange(k, k + 100) for k in range(0, 60, 2)]
    ids = np.arange(30)
    got = neardup.compare_family(ids, ids.copy(), sets, 80)
    roots = groups(list(range(30)), lambda a, b: len(set(sets[a]) & set(sets[b])) * 100 >= 80 * len(set(sets[a]) | set(sets[b])))
    found = groups(list(range(30)), lambda a, b: (a, b) in got or (b, a) in got)
    assert found == roots and len(got) < 30


def test_estimate_is_close_to_the_similarity(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows, wanted = [], []
    for share in (0.0, 0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        b = np.concatenate([a[: int(2000 * share)], rng.integers(0, 2**63, 2000 - int(2000 * share), dtype=np.uint64)])
        rows.append([neardup.packed(neardup.minima(x)).tolist() for x in (a, b)])
        wanted.append(share / (2 - share))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(neardup.estimate(F.col("a"), F.col("b"))).collect()
    assert all(abs(g[0] - w) < 0.2 for g, w in zip(got, wanted, strict=True))


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    got = sharding.sharded(messy(spark), 3).collect()
    assert len(got) == messy(spark).count()
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got)
    many = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'copy of a text', concat('t', id, repeat('x', int(id % 50)))) text")
    sizes = Counter()
    for r in sharding.sharded(many, 8).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 200
    assert sharding.sharded(empty(spark)).count() == 0


def test_licenses_equal_plain_search(spark):
    words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    got = licenses.scan_licenses(messy(spark)).collect()
    wanted = Counter()
    for d in messy(spark).collect():
        words, starts, labels = words_of.findall((d.text or "").translate(lower)), [], set()
        for phrase, label in licenses.PHRASES.items():
            for k in range(len(words)):
                if words[k : k + len(phrase.split())] == phrase.split():
                    starts.append(k)
                    labels.add(label)
        wanted[d.doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == wanted
    assert {r.labels for r in got if r.doc_id == 63} == {"apache,apache-2.0"}
    assert licenses.scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("a b d", 1), ("a d", 1), ("x a b c d y", 1), ("a b q d", 1), ("a q d", 1), ("a b q q d", 0), ("a a d", 1), ("b d", 0),
    ],
)
def test_template_regions(text, spans):
    automaton = licenses.compile_template("t", "a [b] {1} d")
    assert len(automaton.run(text.encode().split())[0]) >= spans if spans else not automaton.run(text.encode().split())[0]


def test_fingerprints(spark):
    docs = messy(spark)
    rows = docs.select("doc_id", "text").collect()
    got = sketches.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    keyed = lines.keyed(docs.fillna("", ["text"])).select("id0", "th", "text").distinct().collect()
    order = sorted((r.id0, r.th, r.text) for r in keyed)
    after = {(a[0], a[2]): b[2] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    by_text = {}
    for r in got:
        text, following = r.text, after[(r.doc_id if r.doc_id is not None else sketches.NO_ID), r.text]
        half = len(text) // 2
        assert r.n_chars == len(text)
        assert r.edited == text[: len(text) - half] + following[:half]
        assert by_text.setdefault(text, r.sketch) == r.sketch
        assert (len(r.sketch) > 0) == bool(re.search(r"[^ \t-\r]", text))
    assert sketches.edited_fingerprints(empty(spark)).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"w{k}" for k in range(4000))
    part = " ".join(f"w{k}" for k in range(1000, 2000))
    other = " ".join(f"v{k}" for k in range(900))
    r = spark.createDataFrame([(long, part, other)], "a string, b string, c string").select(
        *[sketches.sketch(F.col(c)).alias(c) for c in "abc"]
    ).select(
        sketches.containment(F.col("b"), F.col("a")), sketches.containment(F.col("a"), F.col("b")),
        sketches.resemblance(F.col("a"), F.col("c")),
        (sketches.merged(F.col("b"), F.col("c")) == sketches.merged(F.col("c"), F.col("b"))),
        sketches.containment(F.col("b"), sketches.merged(F.col("b"), F.col("c"))),
    ).first()
    assert r[0] > 0.9 and 0.15 < r[1] < 0.35 and r[2] < 0.02 and r[3] and r[4] > 0.98


def test_mix_meets_targets(spark):
    got = mixing.mixed(messy(spark)).collect()
    rows = messy(spark).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for d in rows:
        sizes[d.source] += len(BLANK.findall(d.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    share = {s: [1, 2, 3][k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(3 * sizes[s] for s in sizes if s not in open_)
        weight = sum(share[s] for s in open_)
        over = {s for s in open_ if left * share[s] / weight > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    target = {s: left * share[s] / weight if s in open_ else 3 * sizes[s] for s in sizes}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    longest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    assert sorted(map(str, mixing.mixed(messy(spark)).collect())) == sorted(map(str, got))
    assert mixing.mix(messy(spark)).count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark)).columns == empty(spark).columns and mixing.mix(empty(spark)).count() == 0


def test_quality_agrees_with_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classified(docs).join(labels, "doc_id").select("good", "quality").collect()
    right = sum(r.good == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.97
    assert sum(r.good for r in rows if r.quality == 1) / sum(r.quality for r in rows) > 0.99


def test_quality_of_awkward_tables(spark):
    got = quality.classified(messy(spark))
    assert got.count() == messy(spark).count()
    assert all(r.good for r in got.where("text is null or trim(text) = ''").collect())
    assert quality.good_documents(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "A fine sentence of some words.")], "doc_id long, text string")
    assert quality.good_documents(one).count() == 1


def test_edited_sha_is_of_the_text(spark):
    from pyspark.sql import functions as F

    r = sketches.edited_fingerprints(messy(spark)).select("edited", F.sha2("edited", 256).alias("s")).first()
    assert r.s == hashlib.sha256(r.edited.encode()).hexdigest()


def test_a_mix_moves_no_texts(spark):
    docs = spark.createDataFrame(
        [(k, "a b c " * (k % 7 + 1), "abc"[k % 3], k % 2) for k in range(4000)], "doc_id long, text string, source string, key int"
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    try:
        mix = mixing.mix(docs)
        plan = mix._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.doc_id for r in mix.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert got == sorted(r.doc_id for r in mixing.mixed(docs).collect() for _ in range(r.copies))

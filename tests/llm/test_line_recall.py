"""Near lines are found at the declared similarity, whatever their length."""

from __future__ import annotations

import random

import numpy as np

from harvestlens.llm import lines
from tests.llm.cases import groups


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    """Distinct places are replaced; now and then a word goes or comes."""
    out = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.random()
        if kind < 0.7:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.85:
            del out[at]
        else:
            out.insert(at, f"more{rng.randrange(10**6)}")
    return out


def test_all_lines_at_the_similarity_are_found(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for n in [4, 5, 6, 9, 10, 14, 15, 20, 30, 60, 100, 400] * 6:
        base = rng.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=n)
        other = edited(rng, base, max(1, n // 5))
        texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    forms = [t.encode() for t in texts]
    roots = groups(list(range(len(forms))), lambda a, b: lines.similar(forms[a], forms[b], 0.8))
    wanted = {k for k, root in roots.items() if root != k}
    assert len(wanted) > 50
    assert {r.id0 for r in lines.removed_lines(docs).collect()} == wanted


def test_families_are_linked_as_all_pairs_are():
    rng = random.Random(1)
    forms = []
    for _ in range(150):
        forms.append([f"w{k}" for k in range(30)] + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30))])
    for k in range(0, 120, 3):
        forms.append(edited(rng, forms[k], 3))
    forms = [" ".join(f).encode() for f in forms]
    sims = lines.simhashes(forms)
    ids = list(range(len(forms)))
    got = set(lines.compare_family(ids, ids, forms, sims, 0.8))
    wanted = groups(ids, lambda a, b: lines.similar(forms[a], forms[b], 0.8))
    assert groups(ids, lambda a, b: (a, b) in got or (b, a) in got) == wanted
    assert 0 < len(got) < len(forms)


def test_a_family_is_compared_by_rare_words_and_not_by_its_square(spark, monkeypatch):
    monkeypatch.setattr(lines, "FAMILY_BLOCK", 16)
    made = np.random.default_rng(5)
    # All lines share two words; each other word is in a few lines. Each third line is a copy with one other word.
    forms = [" ".join(["we", "ship", *made.choice(4000, 10).astype(str)]).encode() for _ in range(200)]
    forms += [f.rsplit(b" ", 1)[0] + b" changed" for f in forms[::3]]
    sims = lines.simhashes(forms).tolist()
    table = spark.createDataFrame(
        [(k, 12, *s, f) for k, (s, f) in enumerate(zip(sims, forms, strict=True))],
        "id long, length int, " + "".join(f"{s} long, " for s in lines.SIMS) + "form binary",
    )
    family = spark.createDataFrame([(0, k, k) for k in range(len(forms))], "center long, id long, root long")
    got = {tuple(sorted(r)) for r in lines.family_links(family, table.drop("length"), 0.8).collect()}
    assert got == {(3 * k, 200 + k) for k in range(67)}
    rarest = 3
    assert lines.family_squares(family, table.drop("length"), 0.8).count() <= 2 * rarest * len(forms)


def test_bags_keep_all_similar_lines_and_drop_most_others():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    forms = []
    for n in [4, 5, 8, 9, 12, 19, 24, 25, 30, 57, 100, 180] * 20:
        base = rng.choices(vocabulary, [1 / (k + 20) for k in range(3000)], k=n)
        forms += [" ".join(w).encode() for w in (base, edited(rng, base, n // 5), rng.choices(vocabulary, k=n))]
    bag, length = lines.bags(forms).view(np.uint64), np.array([f.count(b" ") + 1 for f in forms])
    one, two = (x.ravel() for x in np.triu_indices(len(forms), 1))
    fits = lines.bags_fit(one, two, bag, length, 0.8)
    same = np.array([lines.similar(forms[a], forms[b], 0.8) for a, b in zip(one, two, strict=True)])
    assert same.sum() > 100 and not (same & ~fits).any()
    assert fits.sum() < 3 * same.sum()
    partner = lines.with_partner(np.arange(len(forms)), length, bag, 0.8)
    assert set(np.flatnonzero(partner)) == set(one[fits]) | set(two[fits])


def test_similar_lines_have_one_of_the_blocks_that_are_needed():
    rng = random.Random(4)
    for n in list(range(5, 27)) * 40:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        forms = [" ".join(w).encode() for w in (base, edited(rng, base, n // 5))]
        if lines.similar(*forms, 0.8):
            line, key, _ = lines.block_keys(forms)
            assert set(key[line == 0]) & set(key[line == 1]), n
    few = lines.block_keys([b"a b c d e f g h i"])[1]
    assert len(few) == 6


def test_texts_of_lines_without_a_candidate_are_not_fetched(spark, monkeypatch):
    made = np.random.default_rng(8)
    # All lines share a passage, so all share blocks; one is nearly a copy of another.
    texts = ["we ship it all today " + " ".join(made.choice(10**6, 20).astype(str)) for _ in range(80)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    fetched, before = [], lines.forms_of

    def counted(docs, wanted):
        fetched.append(wanted.count())
        return before(docs, wanted)

    monkeypatch.setattr(lines, "forms_of", counted)
    assert [r.id0 for r in lines.removed_lines(docs).collect()] == [80]
    assert sum(fetched) <= 4


def test_signatures_of_many_lines_are_made_in_parts(monkeypatch):
    monkeypatch.setattr(lines, "BYTES_AT_ONCE", 1000)
    forms = [b"line %d of some words" % k for k in range(50)]
    sizes = []

    def made(part):
        sizes.append(len(part))
        return lines.bags(part)

    assert (lines.by_parts(made, forms) == lines.bags(forms)).all()
    assert sum(sizes) == 50 and max(sizes) <= 8
    assert lines.by_parts(made, []).shape == (0, lines.BAG)


def test_forms_of_wanted_lines_are_found_by_place(spark):
    text = "One, two THREE four\n\nfive six - seven eight\r\n"
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a b c d"), (2, None)], "doc_id long, text string")
    wanted = lines.keyed(docs).where("id0 = 1").selectExpr("7L id", "id0", "th", "2 line").distinct()
    (got,) = lines.forms_of(docs, wanted).collect()
    assert (got.id, got.length, bytes(got.form)) == (7, 4, b"five six seven eight")
    assert [got[s] for s in lines.SIMS] == lines.simhashes([b"five six seven eight"])[0].tolist()


def test_a_text_is_split_once_whatever_lines_it_loses(spark):
    copy = "seen before in all texts"
    docs = spark.createDataFrame([(1, copy), (2, f"{copy}\n1.\n\nSeen before, in all texts!\n2.\n")], "doc_id long, text string")
    done = lines.deduplicated(docs)
    # A split within the inner function would be made for each line that stays.
    assert "-1)[lambda" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in done.collect()) == [(1, copy, 0), (2, "1.\n\n2.\n", 2)]


def test_only_lines_that_share_a_rare_word_are_partners_in_a_family():
    made = np.random.default_rng(9)
    # All lines are close by their bags, as each has 60 of the same 64 words; few share a token.
    forms = [" ".join(made.permutation(64)[:60].astype(str)).encode() for _ in range(150)]
    bag, length = lines.bags(forms).view(np.uint64), np.full(150, 60)
    tokens, root = [[k // 2, 1000 + k] for k in range(150)], np.arange(150) // 4
    assert lines.with_partner(root, length, bag, 0.8).all()
    assert not lines.with_partner_by_word(root, length, bag, tokens, 0.8).any()
    tokens[3], tokens[9] = [1, 7777], [4, 7777]
    assert np.flatnonzero(lines.with_partner_by_word(root, length, bag, tokens, 0.8)).tolist() == [3, 9]
    # So it is where a token has many lines.
    common = [[5], [6]] * 75
    for k in range(0, 150, 5):
        forms[k] = b"others have none of these words in common with this line %d" % k
    bag, length = lines.bags(forms).view(np.uint64), np.array([f.count(b" ") + 1 for f in forms])
    one, two = (x.ravel() for x in np.triu_indices(150, 1))
    fits = lines.bags_fit(one, two, bag, length, 0.8) & (root[one] != root[two]) & (one % 2 == two % 2)
    got = np.flatnonzero(lines.with_partner_by_word(root, length, bag, common, 0.8))
    assert set(got) == set(one[fits]) | set(two[fits])


def test_partners_are_those_of_all_pairs_whatever_their_lengths(monkeypatch):
    rng = random.Random(12)
    forms = []
    for n in [5, 9, 40, 200, 250, 256, 257, 260, 300, 400] * 8:
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        forms += [" ".join(base).encode(), " ".join(edited(rng, base, n // 5)).encode()]
    bag, length = lines.bags(forms).view(np.uint64), np.array([f.count(b" ") + 1 for f in forms])
    root = np.arange(len(forms)) // 3
    one, two = (x.ravel() for x in np.triu_indices(len(forms), 1))
    fits = lines.bags_fit(one, two, bag, length, 0.8) & (root[one] != root[two])
    monkeypatch.setattr(lines, "WIDE", 30)
    assert set(np.flatnonzero(lines.with_partner(root, length, bag, 0.8))) == set(one[fits]) | set(two[fits])


def test_forms_have_single_blanks_and_similar_lines_are_those_by_distance():
    rng = random.Random(13)
    for _ in range(2000):
        text = bytes(rng.choice(b"aB .,-_|/\t\n\r\x0b\x0c\x00\x1c\x85\xc3\xa9  ") for _ in range(rng.randrange(40)))
        words = [line.split() for line in text.translate(lines.KEEP, lines.DROP).split(b"\n")]
        assert lines.forms_in(text) == [b" ".join(w) for w in words]
        one = rng.choices("abcdefghij", k=rng.randrange(1, 25))
        two = edited(rng, one, rng.randrange(min(7, len(one)))) or ["x"]
        near = lines.edit_distance(one, two) <= int(0.2 * max(len(one), len(two)) + 1e-9)
        assert lines.similar(" ".join(one).encode(), " ".join(two).encode(), 0.8) == near

"""Quality classifier from weak labels.

No document is labelled by hand. Heuristic labellers look at one trait each and say
good, bad or nothing. How reliable each is follows from how they overlap: expectation
maximisation fits the accuracy of each, given the counts of all answer patterns in the corpus (there are at most
``3 ** labellers`` of them, however large the corpus). The patterns' posteriors then
are the training labels of a linear scorer over hashed word shapes, which also judges
what no labeller looks at. Documents whose score is below one half are rejected.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.llm.common import mapped, saved

GOOD, BAD, SILENT = 1, 2, 0
#: Documents the scorer is fitted on, about; votes and their reliability use all documents.
SAMPLE = 8_000
#: Places of the hashed features. The first is the repetition of the word before.
DIMENSIONS = 4096
#: Words whose shape is remembered in a task; then the memory is emptied.
REMEMBERED = 100_000

SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
LETTERS_DIGITS = bytes(b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128)
SENTENCE = b" \t\r\n\v\f.,;:?'\"-()"
SYMBOLS = bytes(b for b in range(128) if not chr(b).isalnum())
ODD = bytes(b for b in SYMBOLS if b not in SENTENCE)


LABELLERS = 9


def votes(text: bytes, words: list[bytes], repeats: int) -> list[int]:
    """The answers of all labellers on one text; a text without words gets none.

    Seven look for one fault each and are silent where they do not find it; faults of
    a kind are looked for by more than one. Two look for prose and are silent on the rest.
    """
    n = len(words)
    if not n:
        return [SILENT] * LABELLERS
    odd = len(text.translate(None, LETTERS_DIGITS + SENTENCE)) / len(text)
    shaped = text.translate(SHAPES)
    upper, lower = shaped.count(b"A"), shaped.count(b"a")
    shout = upper / (upper + lower) if upper + lower > 20 else 0.0
    bare = decorated = 0
    if odd:
        bare = sum(not w.translate(None, SYMBOLS) for w in words) / n
        decorated = sum(len(w) - len(w.rstrip(ODD)) >= 2 for w in words) / n
    repeated = repeats / n
    variety = len(set(words)) / n if n >= 20 else 1.0
    prose = odd < 0.03 and shout < 0.3 and repeated < 0.1 and bare < 0.05
    ended = text.rstrip()[-1:] in b".?!"
    bad = [
        odd >= 0.05,
        decorated >= 0.15,
        shout >= 0.5,
        text.count(b"!!") / n >= 0.2,
        repeated >= 0.2,
        variety < 0.25 and repeated >= 0.1,
        bare >= 0.15,
    ]
    good = [prose, prose and ended and text.lstrip()[:1].translate(SHAPES) in b"Aa"]
    return [BAD if x else SILENT for x in bad] + [GOOD if x else SILENT for x in good]




class Shapes(dict):
    """Word -> place of its shape: letters, capitals and digits stand for their kind, runs are one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        shaped = word.translate(SHAPES)[:64]
        runs = bytes(b for k, b in enumerate(shaped) if not k or b != shaped[k - 1])
        place = self[word] = 1 + zlib.crc32(runs) % (DIMENSIONS - 1)
        return place


def features(words: list[bytes], repeats: int, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: square roots of the shares of shapes, of pairs of neighbouring shapes and of repetitions."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    one = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    two = 1 + (one[:-1] * 31 + one[1:] * 7919) % (DIMENSIONS - 1)
    counts = np.bincount(one, minlength=DIMENSIONS) + np.bincount(two, minlength=DIMENSIONS)
    counts[0] = repeats
    places = np.flatnonzero(counts)
    return places, np.sqrt(counts[places] / len(words))


def parts(text: bytes | None) -> tuple[bytes, list[bytes], int]:
    words = (text or b"").split()
    return text or b"", words, sum(map(operator.eq, words, words[1:]))


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, th, pattern (the answers as a number of base 3) of every row."""

    def rows(batch: dict) -> dict:
        patterns = [
            sum(v * 3**k for k, v in enumerate(votes(*parts(text.as_py())))) for text in batch["text"]
        ]
        return {"doc_id": batch["doc_id"], "th": batch["th"], "pattern": patterns}

    return mapped(
        docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) th", "cast(text as binary) text"), rows,
        "doc_id long, th long, pattern int",
    )


def answers(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(LABELLERS)], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good per pattern, the share of good documents, and each labeller's accuracy where it speaks.

    Whether a labeller speaks says nothing; given the class, labellers err on their
    own. It starts from equal trust in all. Each labeller is taken to have been right
    in four of five earlier cases, so one that hardly speaks keeps a sane accuracy.
    """
    given = answers(patterns)
    accuracy, share = np.full(LABELLERS, 0.8), 0.7
    posterior = np.full(len(patterns), share)
    for _ in range(rounds):
        trust = np.log(accuracy / (1 - accuracy))
        gap = np.log(share / (1 - share)) + ((given == GOOD) * trust - (given == BAD) * trust).sum(axis=1)
        following = 1 / (1 + np.exp(-np.clip(gap, -50, 50)))
        right = (given == GOOD) * following[:, None] + (given == BAD) * (1 - following)[:, None]
        accuracy = (4 + (right * counts[:, None]).sum(axis=0)) / (5 + ((given != SILENT) * counts[:, None]).sum(axis=0))
        share = ((following * counts).sum() + 7) / (counts.sum() + 10)
        if np.abs(following - posterior).max(initial=0) < 1e-9:
            break
        posterior = following
    return posterior, share, accuracy


@dataclass
class Model:
    """Weights of the scorer and the posterior of each answer pattern seen."""

    weights: np.ndarray
    bias: float
    share: float
    posteriors: dict[int, float]
    accuracy: np.ndarray

    def score(self, text: bytes | None, shapes: Shapes) -> float:
        """Chance that a text is good; without words it is the corpus's share of good documents, but at least one half."""
        _, words, repeats = parts(text)
        if not words:
            return max(0.5, self.share)
        places, values = features(words, repeats, shapes)
        return float(1 / (1 + np.exp(-np.clip(self.weights[places] @ values + self.bias, -50, 50))))


def train(rows: np.ndarray, places: np.ndarray, values: np.ndarray, labels: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, a light ridge, accelerated gradient steps."""
    w = step = np.zeros(DIMENSIONS + 1)
    rows = np.concatenate([rows, np.arange(len(labels))])
    places = np.concatenate([places, np.full(len(labels), DIMENSIONS)])
    values = np.concatenate([values, np.ones(len(labels))])
    for k in range(rounds if len(labels) else 0):
        ahead = w + (k / (k + 3)) * (w - step)
        gap = 1 / (1 + np.exp(-np.bincount(rows, values * ahead[places], len(labels)))) - labels
        slope = np.bincount(places, values * gap[rows], DIMENSIONS + 1) / len(labels) + 1e-5 * ahead
        step, w = w, ahead - slope
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Estimate the labellers over all documents and train the scorer on about ``sample`` of them, chosen by hash."""
    answered = saved(voted(docs), "votes")
    rows = answered.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** LABELLERS
    patterns, counts = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], float)
    posterior, share, accuracy = estimate(patterns, counts)
    posteriors = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))

    most = 2**31
    limit = int(most * min(1.0, sample / max(1.0, counts.sum())))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(most)) < limit)

    state: list[Shapes] = []

    def hashed(batch: dict) -> dict:
        shapes = state[0] if state else state.append(Shapes()) or state[0]
        out: dict[str, list] = {"places": [], "values": [], "label": []}
        for text in batch["text"]:
            text, words, repeats = parts(text.as_py())
            places, values = features(words, repeats, shapes)
            pattern = sum(v * 3**k for k, v in enumerate(votes(text, words, repeats)))
            out["places"].append(places)
            out["values"].append(values)
            out["label"].append(posteriors.get(pattern, share))
        return out

    got = mapped(
        chosen.selectExpr("cast(text as binary) text"), hashed, "places array<long>, values array<double>, label double"
    ).where(F.size("places") > 0).toArrow()
    lengths = np.array([len(x) for x in got["places"]], int)
    joined = [np.concatenate([np.asarray(x.values) for x in got[c]] or [np.zeros(0)]) for c in ("places", "values")]
    weights, bias = train(
        np.repeat(np.arange(len(lengths)), lengths), joined[0].astype(int), joined[1], got["label"].to_numpy()
    )
    if not len(lengths):
        bias = 10.0  # nothing to learn from: nothing is rejected
    return Model(weights, bias, share, posteriors, accuracy)


def score(text: Column, model: Model) -> Column:
    """The scorer as a column: chance of good, from the whole text."""

    state: list[Shapes] = []

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        # A task remembers the shapes from batch to batch.
        shapes = state[0] if state else state.append(Shapes()) or state[0]
        return pa.array([model.score(t.as_py(), shapes) for t in texts], pa.float64())

    return run(text.cast("binary"))


def classified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns, with ``quality_score`` and ``good`` (score of one half or more) in place of such columns.

    NULL, empty and blank texts are good: there is nothing to hold against them.
    Repeated rows get the same score. An empty table gives an empty table.
    """
    model = model or fit(docs)
    return docs.withColumn("quality_score", score(F.col("text"), model)).withColumn("good", F.col("quality_score") >= 0.5)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows that the classifier accepts, with their columns."""
    model = fit(docs)
    return docs.where(score(F.col("text"), model) >= 0.5)

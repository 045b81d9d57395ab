"""License scans by template markup.

A template is license wording with two kinds of regions: ``[...]`` may be missing,
and ``{n}`` stands for 0 to n words of any kind (names, years, numbers). All other
words are mandatory and must stand in the text exactly and in order. A template is
compiled into an automaton over words, one state per place, held as the bits of an
integer; a text is accepted where a run reaches the last state, at whatever word it
began. Words are runs of letters, digits and non-ASCII characters in lower case, so
punctuation and line breaks do not matter.

Phrases are templates without regions; every place of theirs is counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from harvestlens.llm.common import mapped

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and of usual notices, with regions that may be missing or differ.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license [,] version 2.0",
        "[you may obtain a copy of the license at {6}] http www apache org licenses license 2.0",
    ],
    "apache-2.0-notice": [
        "licensed under the apache license version 2.0 [the license] you may not use this {1} except in compliance "
        "with the license you may obtain a copy of the license at {8} unless required by applicable law or agreed to "
        "in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied",
    ],
    "gpl-2.0": ["gnu general public license [as published by the free software foundation] [either] version 2 [or later]"],
    "gpl-3.0": ["gnu general public license [as published by the free software foundation] [either] version 3 [or later]"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl-3.0": ["gnu affero general public license [as published by the free software foundation] [either] version 3"],
    "mit-notice": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files [the software] to deal in {1} software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of {1} software",
    ],
    "mit-release": ["[this {3} is] released under the [terms of the] mit license"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license [v] [version] 2.0"],
    "cc-by-nc": ["[licensed under] [a] cc by nc [4.0]", "creative commons attribution non commercial", "creative commons attribution noncommercial"],
    "cc-by-sa": ["[licensed under] [a] cc by sa [4.0]", "creative commons attribution share alike", "creative commons attribution sharealike"],
    "cc0": ["cc0 [1.0]", "creative commons zero"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Automaton:
    """Place k waits for word k of the template; the place after the last accepts."""

    label: str
    size: int = 0
    mandatory: list[bytes] = field(default_factory=list)
    #: Places entered by reading this word.
    on: dict[bytes, int] = field(default_factory=dict)
    #: Places entered by reading any word.
    free: int = 0
    #: From a place, the further places reached without reading.
    skips: list[int] = field(default_factory=list)
    #: Mandatory words read when a place is reached.
    progress: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.skips, self.progress = [1], [0]

    def word(self, word: bytes | None) -> None:
        bit = 1 << self.size
        if word is None:
            self.free |= bit
        else:
            self.on[word] = self.on.get(word, 0) | bit
        self.size += 1
        self.skips.append(1 << self.size)
        self.progress.append(self.progress[-1])

    def closed(self) -> None:
        """Follow skips to the end, from the last place back."""
        for k in range(self.size, -1, -1):
            reach, todo = 0, self.skips[k]
            while todo:
                low = todo & -todo
                todo ^= low
                reach |= low if low == 1 << k else self.skips[low.bit_length() - 1] | low
            self.skips[k] = reach

    def spread(self, places: int) -> int:
        """The places and all that they reach without reading."""
        out, todo = places, places
        while todo:
            low = todo & -todo
            todo ^= low
            out |= self.skips[low.bit_length() - 1]
        return out

    def run(self, words: list[bytes]) -> tuple[list[tuple[int, int]], float]:
        """Word spans accepted (the first run to end, from the place it began) and the best share of the mandatory words."""
        start = self.skips[0]
        goal, best, spans = 1 << self.size, 0, []
        live: dict[int, int] = {}  # first word -> places
        for at, word in enumerate(words):
            step = self.on.get(word, 0) | self.free
            moved = {}
            if self.on.get(word, 0) & start:
                live[at] = start
            for begin, places in live.items():
                places = self.spread((places & step) << 1)
                if places:
                    best = max(best, self.progress[places.bit_length() - 1])
                    if places & goal:
                        spans.append((begin, at + 1))
                    else:
                        moved[begin] = places
            live = moved
        whole = max(1, len(self.mandatory))
        return spans, 1.0 if spans else min(best / whole, 1.0)


def compile_template(label: str, markup: str) -> Automaton:
    """``[a b]``: optional, ``{n}``: 0 to n words of any kind, anything else: mandatory words."""
    automaton = Automaton(label)
    opened = None
    for token in re.findall(r"\[|\]|\{\d+\}|[^\[\]{}]+", markup):
        if token == "[":
            opened = automaton.size
        elif token == "]":
            automaton.skips[opened] |= 1 << automaton.size
            opened = None
        elif token[0] == "{":
            for _ in range(int(token[1:-1])):
                automaton.skips[automaton.size] |= 1 << (automaton.size + 1)
                automaton.word(None)
        else:
            for word in WORDS.findall(token.lower().encode()):
                automaton.word(word)
                if opened is None:
                    automaton.mandatory.append(word)
                    automaton.progress[-1] += 1
    if not automaton.mandatory:
        raise ValueError(f"template {label} has no mandatory word")
    automaton.closed()
    return automaton


def compiled(templates: dict[str, list[str]]) -> list[Automaton]:
    return [compile_template(label, markup) for label, markups in templates.items() for markup in markups]


class Scanner:
    """Phrases and templates, applied to one text after another."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]) -> None:
        self.phrases = [(words.split(), label) for words, label in phrases.items()]
        self.phrases = [([w.encode() for w in words], label) for words, label in self.phrases]
        self.automata = compiled(templates)
        self.is_word = np.zeros(256, bool)
        self.is_word[np.frombuffer(WORD_BYTES, np.uint8)] = True
        # A text without the longest word of any phrase or template needs no second look.
        self.rare = sorted(
            {max(words, key=len) for words, _ in self.phrases} | {max(a.mandatory, key=len) for a in self.automata}
        )

    def count(self, text: bytes) -> int:
        mask = self.is_word[np.frombuffer(text, np.uint8)]
        return int(mask[:1].sum() + np.count_nonzero(mask[1:] & ~mask[:-1]))

    def scan(self, text: bytes) -> dict:
        """n_words, starts of base phrases, base labels, all labels, spans (label, first word, end) and the score."""
        text = text.lower()
        found = {"n_words": self.count(text), "starts": [], "base": set(), "labels": set(), "spans": [], "score": 0.0}
        if not any(word in text for word in self.rare):
            return found
        words = WORDS.findall(text)
        places: dict[bytes, list[int]] = {}
        for k, word in enumerate(words):
            places.setdefault(word, []).append(k)
        for phrase, label in self.phrases:
            for k in places.get(phrase[0], ()):
                if words[k : k + len(phrase)] == phrase:
                    found["starts"].append(k)
                    found["base"].add(label)
        for automaton in self.automata:
            if all(word in places for word in automaton.mandatory):
                spans, score = automaton.run(words)
                found["spans"] += [(automaton.label, *span) for span in spans]
                found["score"] = max(found["score"], score)
            else:
                have = sum(word in places for word in automaton.mandatory)
                # Scattered words are no match: only the share that could match, halved.
                found["score"] = max(found["score"], have / len(automaton.mandatory) / 2 if found["base"] else 0.0)
        found["labels"] = found["base"] | {label for label, *_ in found["spans"]}
        found["score"] = 1.0 if found["base"] else found["score"]
        return found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, first long, end long>>"
)


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES
) -> DataFrame:
    """One row per document: words, base phrases and template matches.

    ``labels`` has the labels of the phrases and of the accepted templates, sorted and
    comma-joined; ``spans`` the accepted word ranges. ``score`` is 1 where a phrase or
    template stands, else the largest share of a template's mandatory words read in
    order by a run. NULL and empty text: no words, empty labels, score 0. Repeated rows
    give repeated results; columns other than doc_id and text are not read.
    """

    scanner: list[Scanner] = []

    def rows(batch: dict) -> dict:
        if not scanner:
            scanner.append(Scanner(phrases, templates))
        out: dict[str, list] = {name: [] for name in (
            "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"
        )}
        out["doc_id"] = batch["doc_id"]
        for text in batch["text"]:
            got = scanner[0].scan(text.as_py() or b"")
            out["n_words"].append(got["n_words"])
            out["n_base"].append(len(got["starts"]))
            out["first_word"].append(min(got["starts"], default=None))
            out["last_word"].append(max(got["starts"], default=None))
            out["base_labels"].append(",".join(sorted(got["base"])))
            out["labels"].append(",".join(sorted(got["labels"])))
            out["score"].append(got["score"])
            out["spans"].append([{"label": a, "first": b, "end": c} for a, b, c in got["spans"]])
        return out

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text"), rows, SCHEMA)

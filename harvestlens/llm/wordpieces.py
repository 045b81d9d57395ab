"""Token counts by a linear longest-match automaton.

Greedy word pieces take, at each place of a word, the longest vocabulary entry that
fits. Instead of trying entries and going back, one automaton reads each character
once. Its states are the trie of the vocabulary; a state's failure link leads to the
state that is left after the longest entry (and those after it) has been cut off the
front, and its popped count says how many entries that cut off. So the length in
pieces is a sum of popped counts, and no piece is built.

Words are runs without ASCII white space. Entries that begin with the mark stand at
the start of a word, all others inside. A word that no sequence of greedy matches
covers counts as one unknown piece.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from harvestlens.llm.common import mapped

#: Marks the start of a word in the vocabulary.
MARK = "▁"
#: Words whose length is remembered in a task; then the memory is emptied.
REMEMBERED = 400_000


class Automaton:
    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.step: list[dict[str, int]] = [{}]
        ends = [False]
        for entry in vocabulary:
            at = 0
            for character in entry:
                to = self.step[at].get(character)
                if to is None:
                    to = self.step[at][character] = len(self.step)
                    self.step.append({})
                    ends.append(False)
                at = to
            if at:
                ends[at] = True
        # Breadth first: a state's link needs only the links of shorter states.
        self.link: list[int] = [-1] * len(self.step)
        self.popped = [0] * len(self.step)
        self.link[0] = -1
        level = [0]
        while level:
            following = []
            for parent in level:
                for character, state in self.step[parent].items():
                    following.append(state)
                    if ends[state]:
                        self.link[state], self.popped[state] = 0, 1
                        continue
                    via, count = self.link[parent], self.popped[parent]
                    while via >= 0 and character not in self.step[via]:
                        count += self.popped[via]
                        via = self.link[via]
                    if via >= 0:
                        self.link[state], self.popped[state] = self.step[via][character], count
            level = following

    def pieces(self, word: str) -> int:
        """Number of greedy longest matches that make up the word; -1 if they do not."""
        step, link, popped = self.step, self.link, self.popped
        at, count = 0, 0
        for character in word:
            while character not in step[at]:
                if link[at] < 0:
                    return -1
                count += popped[at]
                at = link[at]
            at = step[at][character]
        while at:
            if link[at] < 0:
                return -1
            count += popped[at]
            at = link[at]
        return count


def vocabulary(path: str) -> list[str]:
    """Entries of a sentence-piece model, without its control, unknown and byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


class Lengths(dict):
    """Word (bytes) -> pieces, with unknown words as 2**32 + 1 so that one sum counts both."""

    def __init__(self, automaton: Automaton, mark: str) -> None:
        super().__init__()
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = self.automaton.pieces(self.mark + word.decode())
        value = count if count >= 0 else 2**32 + 1
        if len(word) <= 64:
            self[word] = value
        return value


def token_counts(docs: DataFrame, path: str, mark: str = MARK) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row's whole text.

    ``path`` names a vocabulary file that every executor can read. NULL, empty and
    blank texts have no words. An unknown word counts as one token. Repeated rows give
    repeated results; columns other than doc_id and text are not read.
    """
    ready: list[Lengths] = []

    def rows(batch: dict) -> dict:
        if not ready:
            ready.append(Lengths(Automaton(vocabulary(path)), mark))
        length = ready[0].__getitem__
        words, sums = [], []
        for text in batch["text"]:
            split = (text.as_py() or b"").split()
            words.append(len(split))
            sums.append(sum(map(length, split)))
        sums = np.array(sums, np.int64)
        return {"doc_id": batch["doc_id"], "n_words": words, "n_tokens": sums % 2**32, "n_unknown": sums // 2**32}

    return mapped(
        docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text"), rows,
        "doc_id long, n_words long, n_tokens long, n_unknown long",
    )

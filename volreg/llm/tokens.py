"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

Both vocabularies begin a new pre-token at a single space before a character that is not
white space, so the ids of a text are those of its pieces cut there, one after another.
A process keeps the ids of pieces it has met, as most words come back. Texts where a
space stands beside other white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import KEPT

#: Distinct pieces kept by a process; it starts anew beyond that.
KEPT_PIECES = 1_000_000
#: Pieces encoded as one text, and the character that parts them if the vocabulary drops spaces.
_TOGETHER = 200
_MARK = "\x01"
_unsafe = re.compile(r" \s|\s ")


class _Pieces(dict):
    """Numbers of pieces; a missing one gets the next number and waits to be encoded."""

    def __init__(self, lead: str):
        super().__init__()
        self.lead, self.waiting = lead, []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.waiting.append(self.lead + piece)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the ids that begin a piece, where a vocabulary keeps the space before it
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(1 + max(vocabulary.values()), bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.keeps_space = int(self.begins[self._encode([" a b"])[0]].sum()) == 2
        mark = self._encode([_MARK])[0]
        self.mark = mark[0] if len(mark) == 1 and self._encode([f"a {_MARK} b"])[0][1:-1] == mark else None
        self.clear()

    def clear(self) -> None:
        self.pieces = _Pieces(" ")
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.n, self.size = 0, 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces and each one's count. Many pieces go as one text, as a call costs more than a piece."""
        groups = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        lengths, flat, n = [], [], np.zeros(0, np.int64)
        joint = self._encode([("" if self.keeps_space else f" {_MARK}").join(g) for g in groups]) if self.keeps_space or self.mark is not None else [[]] * len(groups)
        for group, ids in zip(groups, joint, strict=True):
            ids = np.array(ids, np.uint32)
            if self.keeps_space:
                at = np.flatnonzero(self.begins[np.minimum(ids, len(self.begins) - 1)])
                n = np.diff(np.append(at, len(ids)))
            elif self.mark is not None:
                marks = ids == self.mark
                at = np.flatnonzero(marks)
                n = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
                ids = ids[~marks]
            if len(n) != len(group) or not len(ids) or any(x == " " or _MARK in x for x in group):
                each = self._encode(group)
                n = np.fromiter(map(len, each), np.int64, len(each))
                ids = np.fromiter(chain.from_iterable(each), np.uint32, int(n.sum()))
            lengths.append(n)
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(lengths)

    def _learn(self) -> None:
        """Encode the pieces that wait."""
        new = self.pieces.waiting
        if not new:
            return
        flat, lengths = self._pieces_ids(new)
        self.pieces.waiting = []
        while self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(new) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.size : self.size + len(flat)] = flat
        self.at[self.n + 1 : self.n + 1 + len(new)] = self.size + np.cumsum(lengths)
        self.n, self.size = self.n + len(new), self.size + len(flat)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty one."""
        if len(self.pieces) > KEPT_PIECES:
            self.clear()
        heads, tails, numbers = [], [], []
        for text in texts:
            if not text:
                head, rest = "", []
            elif _unsafe.search(text):
                head, rest = text, []
            else:
                head, *rest = text.split(" ")
            heads.append(head)
            tails.append(len(rest))
            numbers.append(list(map(self.pieces.__getitem__, rest)))
        self._learn()
        number = np.fromiter(chain.from_iterable(numbers), np.int64, sum(tails))
        start, length = self.at[number], self.at[number + 1] - self.at[number]
        end = np.cumsum(length)
        flat = self.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)]
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(tails)])]
        first = self._encode(heads)
        return [np.concatenate([np.array(h, np.uint32), flat[a:b]]) for h, a, b in zip(first, bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file that every worker has at ``path``."""
    return Encoder(path)


KEPT.append(encoder.cache_clear)

"""Token ids of whole texts, with a bounded cache of text chunks.

BPE never merges across the cuts of a tokenizer's pre-tokenizer. Texts are cut
at places where the two tokenizers in use always cut too, each distinct chunk
is encoded once by the ``tokenizers`` library, and a text's ids are the joined
ids of its chunks, so they equal those of the whole text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: White space other than the blank and the line feed.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    　﻿"
#: Fixed value: a token that both vocabularies hold as a special one.
SPECIAL = "<|endoftext|>"
CUT = re.compile(r"(?<=[^\s᠎​﻿])(?=[ \n][^\s᠎​﻿])")


class _Known(dict):
    """Chunk to its number; chunks met for the first time get the next one and wait to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str | tuple[str]] = []

    def __missing__(self, chunk: str | tuple[str]) -> int:
        self[chunk] = number = len(self)
        self.waiting.append(chunk)
        return number


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as an array of unsigned 32-bit integers.

    ``bound``: chunks kept from one call to the next at most, whatever the
    input's size. Chunks met for the first time go to the library in one call,
    held apart by text with an id of its own; if that id turns up elsewhere,
    they are held apart by a special token or encoded one by one.
    """

    def __init__(self, path: str, bound: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        #: White space is dropped between words by some tokenizers, and kept as a word's first character by others.
        self.drops = self._ids(" \n ").size == 0
        self.apart = " \x01 " if self.drops else "\n\n"
        self._empty()

    def _empty(self) -> None:
        self.known, self.size = _Known(), 0
        self.pool, self.start, self.length = np.empty(1 << 16, "<u4"), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def cut(self, text: str | None) -> list[str | tuple[str]]:
        """Chunks of a text; blanks before a chunk are left out, and where they matter a text's first chunk, which has none, stands in a tuple."""
        if not text:
            return []
        if self.drops:
            return text.replace("\n", " ").split(" ")
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE):
            head, *tail = CUT.split(text)
            return [(head,), *(x[1:] if x[0] == " " else x for x in tail)]
        head, *tail = text.replace("\n", " \n").split(" ")
        return [(head,), *tail]

    def _whole(self, chunk: str | tuple[str]) -> str:
        if isinstance(chunk, tuple):
            return chunk[0]
        return chunk if self.drops or chunk[:1] == "\n" else " " + chunk

    def _learn(self) -> None:
        waiting, self.known.waiting = self.known.waiting, []
        first = len(self.known) - len(waiting)
        while len(self.known) > self.start.size:
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        blank, bare, lone = [], [], []
        for i, x in enumerate(waiting):
            y = x[0] if isinstance(x, tuple) else x[1:] if x[:1] == "\n" else x
            if not y.isprintable() or " " in y or "<|" in y:
                lone.append(i)
            else:
                (bare if y is not x else blank).append(i)
        for group, apart in ((blank, self.apart), (bare, SPECIAL)):
            if not group:
                continue
            ids = self._ids("".join(self._whole(waiting[i]) + apart for i in group))
            ends = np.flatnonzero(ids == self._ids(apart)[0])
            if len(ends) == len(group):
                self._add(ids, first + np.array(group), ends)
            else:
                lone += group
        for i in lone:
            ids = self._ids(self._whole(waiting[i]))
            self._add(ids, np.array([first + i]), np.array([ids.size]))

    def _add(self, ids: np.ndarray, numbers: np.ndarray, ends: np.ndarray) -> None:
        """Put ``ids`` in the pool: those of the chunk ``numbers[k]`` stand before ``ends[k]``, after the mark at ``ends[k - 1]``."""
        while self.size + ids.size > self.pool.size:
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.size : self.size + ids.size] = ids
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.start[numbers], self.length[numbers] = self.size + starts, ends - starts
        self.size += ids.size

    def encode(self, texts) -> list[np.ndarray]:
        if len(self.known) > self.bound:
            self._empty()
        find, numbers, counts = self.known.__getitem__, [], []
        for text in texts:
            chunks = self.cut(text)
            counts.append(len(chunks))
            numbers.append(np.fromiter(map(find, chunks), np.int64, len(chunks)))
        if self.known.waiting:
            self._learn()
        out = []
        for x in numbers:
            lengths = self.length[x]
            ends = np.cumsum(lengths)
            at = np.repeat(self.start[x] - (ends - lengths), lengths)
            at += np.arange(at.size)
            out.append(self.pool[at])
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary file."""
    return ChunkEncoder(path)


def release() -> None:
    """Forget this worker's encoders and their chunks, for a step that runs when all is encoded: idle workers keep what they hold."""
    encoder.cache_clear()

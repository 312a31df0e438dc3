"""Encoding with a public byte-level BPE vocabulary, in bounded segments.

A long text falls apart at *safe boundaries*: a single space, tab or line end
between two characters that are not white space. The pre-tokenizer's pattern lets a
word take one leading space, any other single white space is a token of its own, and
the only look-ahead concerns runs of white space, so the ids of a text are the ids
of its segments, each later one with its leading character. Special strings hold no
white space and are never cut. A stretch without a safe boundary stays whole.
Both libraries are called with batches of segments that are balanced by their bytes.

The tokenizers library is the authority. Texts of plain characters (ASCII and
Latin letters, where every Unicode table agrees, without a special string) are
encoded by tiktoken from the same file's vocabulary, which takes a fifth of the
CPU time; each worker first compares the two on the texts it meets and stops on any
difference. All other texts go to tokenizers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: The pre-token pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SAFE = re.compile(r"(?<=\S)[ \t\r\n](?=\S)")
_ODD = re.compile(r"[^!-;=-~ \t\r\n¡-©«-±´¶-¸»¿-ſ<]|<\|")

#: Characters in a segment, bytes in a call, and texts that a worker compares.
SEGMENT, CALL_BYTES, COMPARED = 1 << 16, 1 << 18, 8


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's file: visible Latin-1 characters for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """The text in segments of about ``most`` characters, cut at safe boundaries alone."""
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """The ids of texts by the vocabulary in a tokenizers file, without added tokens, padding or truncation."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # threads are left to Spark
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {x["content"] for x in file["added_tokens"]}
        of = byte_letters()
        ranks = {bytes(of[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special, self.left = special, COMPARED

    def _by_tokenizers(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_tiktoken(self, texts: list[str], at_once: bool) -> list[list[int]]:
        found = self.fast.encode_ordinary_batch(texts, num_threads=1) if at_once else [self.fast.encode_ordinary(t) for t in texts]
        if self.left:
            some = texts[: self.left]
            self.left -= len(some)
            if found[: len(some)] != self._by_tokenizers(some):
                raise ValueError("the two libraries disagree on this vocabulary")
        return found

    def plain(self, text: str) -> bool:
        return _ODD.search(text) is None and not any(s in text for s in self.special)

    def calls(self, texts: list[str]) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
        """Batches of (place of the text, segment) of about ``CALL_BYTES`` bytes, each of plain texts (true) or of others; the segments of a text stay in order."""
        held: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        size = {True: 0, False: 0}
        for i, t in enumerate(texts):
            kind = self.plain(t)
            for s in segments(t):
                n = len(s.encode())
                if held[kind] and size[kind] + n > CALL_BYTES:
                    yield kind, held[kind]
                    held[kind], size[kind] = [], 0
                held[kind].append((i, s))
                size[kind] += n
        yield from ((kind, some) for kind, some in held.items() if some)

    def segments(self, texts: list[str], at_once: bool = True) -> Iterator[tuple[int, list[int]]]:
        """(place of the text, ids of its next segment). Not ``at_once``, plain segments of a batch go one by one, which takes less CPU time than the library's threads."""
        for plain, some in self.calls(texts):
            batch = [s for _, s in some]
            yield from zip([i for i, _ in some], self._by_tiktoken(batch, at_once) if plain else self._by_tokenizers(batch), strict=True)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for i, ids in self.segments(texts):
            out[i] += len(ids)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit little-endian ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, ids in self.segments(texts, at_once=False):
            out[i].append(np.array(ids, "<u4"))
        return [np.concatenate(x) for x in out]

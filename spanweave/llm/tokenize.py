"""Token ids of whole texts by a word BPE vocabulary file, with the ids of words seen before kept."""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np

#: Words whose ids a worker keeps; then it starts anew.
KEPT_WORDS = 400_000
#: White space to Python's split() that the vocabulary's rule takes for symbols, the one letter whose lower case depends on
#: what follows, and the start of the special tokens: texts with any of these go to the tokenizer whole.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """``encode(texts)`` gives what the tokenizer's own ``encode_batch(texts, add_special_tokens=False)`` gives.

    The vocabulary drops white space and works word by word, and the last token of each of its words is marked, so new
    words can go to the tokenizer as one text and be told apart again in the result.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.first, self.length, self.flat, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint16), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _learn(self, words: list[str]) -> None:
        """Add words free of white space, in normal form and lower case."""
        counts = np.array([1 if w.isalpha() else len(self.split(w)) for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != counts.sum() or (len(ids) and ends[-1] != len(ids)):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        stops = np.concatenate(([0], ends))[np.cumsum(counts)]
        starts = np.concatenate(([0], stops[:-1]))
        k, have = len(self.index), self.n
        while k + len(words) > len(self.first):
            self.first, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.length))
        while have + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.first[k : k + len(words)], self.length[k : k + len(words)] = starts + have, stops - starts
        self.flat[have : have + len(ids)] = ids
        self.n = have + len(ids)
        self.index.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > KEPT_WORDS:
            self._forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list[list[str]] = []
        for i, t in enumerate(texts):
            if any(c in t for c in _WHOLE):
                out[i] = self._whole(t)
                words.append([])
            else:
                words.append((t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split())
        new = set(chain.from_iterable(words)).difference(self.index)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64)
        length = self.length[at]
        upto = np.concatenate(([0], np.cumsum(length)))
        flat = self.flat[np.repeat(self.first[at] - upto[:-1], length) + np.arange(upto[-1])] if len(at) else np.zeros(0, np.uint16)
        ends = upto[np.cumsum([len(w) for w in words])] if words else []
        starts = np.concatenate(([0], ends[:-1])) if words else []
        return [flat[s:e] if x is None else x for x, s, e in zip(out, starts, ends, strict=True)]


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    """One tokenizer a worker process, kept between tasks."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]

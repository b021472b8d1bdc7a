"""Counts that describe a text's quality, for the rules of operator 5 and the classifier of operator 6."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tidemill.llm.bytewords import ALNUM, LOWER, NOT_SPACE, Texts, windows

#: Common words of the reference languages, as in any list of function words.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "fr": "de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont mais avec ou son".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque".split(),
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Classes of bytes: a-z, A-Z, digits, blanks, line breaks, sentence marks, symbols, other ASCII, other characters.
CLASSES = ("lower", "upper", "digit", "blank", "break", "mark", "symbol", "ascii", "other")
_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[SYMBOLS] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = len(CLASSES)  # bytes that go on with a character


@lru_cache(maxsize=1)
def _word_table() -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in WORDS]
    cuts = np.cumsum([0, *map(len, raw)])
    hashes = Texts(np.frombuffer(b"".join(raw), np.uint8), cuts).hashes(cuts[:-1], cuts[1:])
    return hashes, np.argsort(hashes)


def _apart(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes changed by their text's number, so that equal spans of other texts differ."""
    return hashes ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Counts:
    """Per text of a slice: the base counts, and the histograms over character classes and common words."""

    def __init__(self, texts: Texts):
        n = len(texts)
        starts, ends, first = texts.spans(NOT_SPACE)
        hashes = texts.hashes(starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        kinds, at = _CLASS[texts.buf], texts.offsets.tolist()
        width = len(CLASSES) + 1
        counts = [np.bincount(kinds[i:j], minlength=width) for i, j in zip(at, at[1:])]
        self.chars = np.stack(counts)[:, :-1] if n else np.empty((0, width - 1), np.int64)
        self.n_words = np.diff(first)
        self.n_chars = self.chars.sum(axis=1)
        self.n_symbols = self.chars[:, CLASSES.index("symbol")]
        self.word_chars = self.n_chars - self.chars[:, CLASSES.index("blank")] - self.chars[:, CLASSES.index("break")]
        self.n_lines, self.n_dup_lines = self._dup_lines(texts, starts)
        self.n_repeat_words = self._repeats(hashes, first, doc, n)
        lowered = Texts(LOWER[texts.buf], texts.offsets)
        ws, we, wf = lowered.spans(ALNUM)
        known, order = _word_table()
        wh = lowered.hashes(ws, we)
        at = np.searchsorted(known[order], wh).clip(max=len(known) - 1)
        which = np.where(known[order][at] == wh, order[at], len(WORDS))
        width = len(WORDS) + 1
        self.words = np.bincount(np.repeat(np.arange(n), np.diff(wf)) * width + which, minlength=n * width).reshape(n, width)

    @staticmethod
    def _dup_lines(texts: Texts, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word by text, and how many of them equal an earlier one."""
        starts, ends, first = texts.lines()
        full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
        row = np.repeat(np.arange(len(texts)), np.diff(first))[full]
        hashes = texts.hashes(starts[full], ends[full])
        n_lines = np.bincount(row, minlength=len(texts))
        _, at = np.unique(_apart(hashes, row), return_index=True)
        return n_lines, n_lines - np.bincount(row[at], minlength=len(texts))

    @staticmethod
    def _repeats(hashes: np.ndarray, first: np.ndarray, doc: np.ndarray, n: int, size: int = 5) -> np.ndarray:
        """Words inside windows of ``size`` words that their text has twice or more."""
        grams = windows(hashes, size)
        if not len(grams):
            return np.zeros(n, dtype=np.int64)
        within = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :])
        keys = _apart(grams[within], doc[within])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(len(hashes), dtype=bool)
        for i in range(size):
            inside[within[twice] + i] = True
        return np.bincount(doc[inside], minlength=n)

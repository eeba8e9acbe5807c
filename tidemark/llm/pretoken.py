"""Byte-level BPE words: vectorised pre-tokenization and a word table.

A byte-level BPE tokenizer first cuts a text into words with a fixed
pattern, then merges inside each word; a word's ids never depend on its
neighbours.  So a text is encoded by (a) finding all word boundaries of
a whole batch of texts with a few array passes over its code points and
(b) looking every word up in a table that encodes each distinct word
once.

The pattern (fixed value, the public byte-level BPE one)::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

reads as: a word is a run of one class (letters, numbers, others) with at
most one U+0020 before it; a white-space run gives its last character to
the next word if that is U+0020 and otherwise keeps it as a word of its
own; an apostrophe that starts a word takes one of the seven endings.
Which class a code point has is asked of the tokenizer itself, once per
code point seen, so no other Unicode version can creep in.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

SPACE, LETTER, NUMBER, OTHER, END, SPECIAL, UNSEEN = 0, 1, 2, 3, 4, 5, 9

#: Characters after a boundary that can still decide it: an apostrophe
#: ending looks two ahead, white space one; special strings are longer.
LOOKAHEAD = 3


def load_tokenizer(path: str):
    """The tokenizers library's object, single-threaded inside a Spark task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves; the rest take the code
    points from 256 on, in byte order (the public byte-level rule).
    """
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Splitter:
    """Word boundaries of many texts at once."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.margin = max([LOOKAHEAD, *map(len, self.specials)]) + 1
        self._class = np.full(0x110001, UNSEEN, np.uint8)
        self._class[0x110000] = END

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        cls = self._class[codes]
        if (cls == UNSEEN).any():
            probe = self.tok.pre_tokenizer.pre_tokenize_str
            for c in np.unique(codes[cls == UNSEEN]).tolist():
                kind = SPACE
                for first, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                    if len(probe(first + chr(c))) == 1:
                        kind = k
                        break
                self._class[c] = kind
            cls = self._class[codes]
        return cls

    def split(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All words of ``texts``: (joined text, starts, ends, first).

        Word i is ``joined[starts[i]:ends[i]]``; the words of text k are
        ``first[k]:first[k + 1]``.  Special strings come out as one word.
        """
        joined = "\0".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        after = np.cumsum(sizes)                      # one past each text's separator
        codes[after - 1] = 0x110000
        cls = self._classes(codes)
        forced = []
        for s in self.specials:                       # leftmost, non-overlapping
            at = joined.find(s)
            while at >= 0:
                cls[at:at + len(s)] = SPECIAL
                forced.append(at)
                at = joined.find(s, at + len(s))
        start = np.empty(len(cls), bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start[forced] = True
        # the last white space before a word leaves its run; a blank joins the word
        wordy = (cls >= LETTER) & (cls <= OTHER)
        last = np.flatnonzero((cls[:-1] == SPACE) & wordy[1:])
        start[last] = True
        start[last[codes[last] == 0x20] + 1] = False
        # apostrophe endings
        quote = np.flatnonzero(start & (codes == 0x27) & (cls == OTHER))
        quote = quote[cls[quote + 1] == LETTER]
        if len(quote):
            one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                             | ((one == ord("l")) & (two == ord("l"))))
            for at, n in ((quote[short], 2), (quote[long], 3)):
                start[at + 1] = False
                start[(at + n)[cls[at + n] == LETTER]] = True
        edge = np.flatnonzero(start)
        ends = np.append(edge[1:], len(cls))
        real = cls[edge] != END
        starts, ends = edge[real], ends[real]
        first = np.concatenate([[0], np.searchsorted(starts, after)])
        return joined, starts, ends, first

    def cuts(self, text: str, size: int) -> list[str]:
        """``text`` in pieces of about ``size`` characters that encode alone
        as they do inside it: each cut is a word boundary decided by
        characters well before the end of the window it was found in."""
        out, lo = [], 0
        while len(text) - lo > size:
            width = size
            while True:
                window = text[lo:lo + width + self.margin]
                _, starts, _, _ = self.split([window])
                sure = [a for a in starts[(starts > 0) & (starts <= len(window) - self.margin)].tolist()
                        if self._class[ord(window[a - 1])] != SPACE]      # a run's end would change its cut
                if sure or lo + width >= len(text):
                    break
                width *= 2                            # one word fills the window
            if not sure:
                break
            out.append(text[lo:lo + sure[-1]])
            lo += sure[-1]
        out.append(text[lo:])
        return out


class WordTable(dict):
    """word -> row of a growing table of ids, each distinct word encoded once.

    ``encode`` maps a word to its list of ids.  The table is emptied when
    it holds ``max_words``, so a task's memory does not grow with the data.
    """

    def __init__(self, encode, max_words: int = 250_000):
        super().__init__()
        self.encode, self.max_words = encode, max_words
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.flat, self.off = array("I"), array("Q", [0])

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.encode(word))
        self.off.append(len(self.flat))
        self[word] = row = len(self.off) - 2
        return row

    def rows(self, joined: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table rows of the words of one batch (call before ``ids``/``counts``)."""
        if len(self) >= self.max_words:
            self._reset()
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Number of ids of each word."""
        return np.diff(np.array(self.off, np.int64))[rows]

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each word)."""
        off = np.array(self.off, np.int64)
        n = np.diff(off)[rows]
        before = np.cumsum(n) - n
        at = np.repeat(off[rows] - before, n) + np.arange(int(n.sum()))
        return np.array(self.flat, np.uint32)[at], n


class DistinctWordTable(WordTable):
    """A word table that looks each distinct word of a batch up once.

    Words of one batch are grouped by a 64-bit hash of their code points, taken from prefix sums of code
    points times powers of an odd number.  Every word is then compared, code point by code point, with the
    first one of its group; should one differ, the batch is looked up word by word."""

    ODD = 0x9E3779B97F4A7C15

    def __init__(self, encode, max_words: int = 250_000):
        super().__init__(encode, max_words)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n).bit_length()
            power = lambda x: np.multiply.accumulate(
                np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
            self.up, self.down = power(self.ODD), power(pow(self.ODD, -1, 1 << 64))

    def rows(self, joined: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self._powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint32(1)) * self.up[:len(codes)], dtype=np.uint64, out=total[1:])
        size = ends - starts
        h = (total[ends] - total[starts]) * self.down[starts] + size.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        shift = starts[first][group] - starts           # from a word to the first one of its group
        at = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
        if not (np.array_equal(size, size[first][group])
                and np.array_equal(codes[at], codes[at + np.repeat(shift, size)])):
            return super().rows(joined, starts, ends)
        return super().rows(joined, starts[first], ends[first])[group]


def library_words(splitter: Splitter):
    """word -> ids by the library's own BPE model."""
    chars = byte_chars()
    table = {b: chars[b] for b in range(256)}
    model, specials = splitter.tok.model, splitter.specials

    def encode(word: str) -> list[int]:
        if word in specials:
            return [specials[word]]
        return [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(table))]

    return encode


def slices(texts: list[str], chars: int):
    """(from, to) ranges of ``texts`` that hold about ``chars`` characters each."""
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t) + 1
        if n >= chars:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Encoder:
    """Whole texts -> ids through a word table, a few million characters at a time."""

    def __init__(self, path: str, words=library_words, batch_chars: int = 2_000_000, max_words: int = 250_000):
        self.splitter = Splitter(path)
        self.table = DistinctWordTable(words(self.splitter), max_words)
        self.batch_chars = batch_chars

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, starts, ends, first = self.splitter.split(texts)
        ids, n = self.table.ids(self.table.rows(joined, starts, ends))
        return ids, np.concatenate([[0], np.cumsum(n)])[first]

    def encode(self, texts: list[str]):
        """Yield (ids, offsets) per slice: text k of the slice has ids[offsets[k]:offsets[k+1]]."""
        for lo, hi in slices(texts, self.batch_chars):
            part = texts[lo:hi]
            if max(map(len, part)) <= self.batch_chars:
                yield self._plain(part)
                continue
            pieces = [self.splitter.cuts(t, self.batch_chars) if len(t) > self.batch_chars else [t] for t in part]
            got, sizes = [], []
            for p in pieces:
                n = 0
                for a, b in slices(p, self.batch_chars):
                    ids, off = self._plain(p[a:b])
                    got.append(ids)
                    n += int(off[-1])
                sizes.append(n)
            yield np.concatenate(got), np.concatenate([[0], np.cumsum(sizes)])

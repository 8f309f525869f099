"""A bidirectional FM index over a delimited vocabulary, searched in batches of numpy arrays.

The text is the sorted words, each between delimiters. A pattern is a range of suffix ranks in
the text and, in step, one in the reversed text, so that it grows by a symbol on either side.
Symbols are counted in a wavelet matrix of the Burrows-Wheeler transform: one pass over its
levels gives a symbol's rank and the number of smaller symbols in the range.
"""

from __future__ import annotations

import numpy as np

END, DELIMITER = 0, 1
#: First code of a letter; END stands for letters that the vocabulary lacks.
LETTER = 2


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text with a unique smallest last symbol, sorted by doubling prefixes."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:n - width] += rank[width:] + 1
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class Wavelet:
    """Counts of symbols in prefixes and ranges of a sequence."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        rest = symbols.astype(np.int32)
        for level in reversed(range(self.levels)):
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(rest) - int(self.ones[-1][-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        # where each symbol's run starts after the last level
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ones[at]
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + one, at - one)
        return at

    def count(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the symbol before low, within low to high, and of smaller ones within."""
        smaller = np.zeros(len(low), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            low1, high1 = ones[low], ones[high]
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            low0, high0 = low - low1, high - high1
            smaller += np.where(bit, high0 - low0, 0)
            low, high = np.where(bit, zeros + low1, low0), np.where(bit, zeros + high1, high0)
        return low - self.start[symbol], high - low, smaller


class Ranges:
    """Ranges of suffix ranks: in the text, in the reversed text, and their common size."""

    def __init__(self, low: np.ndarray, reverse: np.ndarray, size: np.ndarray):
        self.low, self.reverse, self.size = low, reverse, size

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, which: np.ndarray) -> Ranges:
        return Ranges(self.low[which], self.reverse[which], self.size[which])


class Index:
    """Index of distinct words, given as sorted strings."""

    def __init__(self, words: list[str]):
        self.words = words
        points = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words]
        letters = np.concatenate(points) if points else np.zeros(0, "<u4")
        self.alphabet = np.unique(letters)
        sigma = LETTER + len(self.alphabet)
        sizes = np.array([len(p) for p in points], np.int64)
        text = np.full(int(sizes.sum()) + len(words) + 1, DELIMITER, np.int64)
        letter = np.ones(len(text), bool)
        letter[np.concatenate([[0], np.cumsum(sizes + 1)])] = False
        text[letter] = LETTER + np.searchsorted(self.alphabet, letters)
        self.left, self.right = self._transform(text), self._transform(text[::-1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(np.append(text, END), minlength=sigma))])[:sigma]
        self.waves = Wavelet(self.left, sigma), Wavelet(self.right, sigma)

    @staticmethod
    def _transform(text: np.ndarray) -> np.ndarray:
        """What stands before each suffix, in suffix order."""
        text = np.append(text, END)
        return text[suffix_order(text) - 1]

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; END for those that no word has."""
        if not len(self.alphabet):
            return np.zeros(points.shape, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + LETTER, END)

    def delimited(self, n: int) -> Ranges:
        """``n`` times the range of the delimiter."""
        start = np.full(n, self.before[DELIMITER])
        return Ranges(start, start.copy(), np.full(n, len(self.words) + 1))

    def extend(self, at: Ranges, symbol: np.ndarray, right: bool) -> Ranges:
        """The ranges with a symbol added on one side; size 0 where no word has it."""
        near, far = (at.reverse, at.low) if right else (at.low, at.reverse)
        rank, size, smaller = self.waves[right].count(symbol, near, near + at.size)
        size = np.where(symbol == END, 0, size)
        near, far = self.before[symbol] + rank, far + smaller
        return Ranges(far, near, size) if right else Ranges(near, far, size)

    def beside(self, at: Ranges, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(which range, letter) of every letter that stands beside the ranges.

        Ranges of patterns of one length that share an edge are equal or apart, so each is listed once.
        """
        near = at.reverse if right else at.low
        starts, first, own = np.unique(near, return_index=True, return_inverse=True)
        sizes = at.size[first]
        owner = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        sigma = len(self.before)
        pairs = np.unique(owner * sigma + (self.right if right else self.left)[place])
        owner, letter = pairs // sigma, pairs % sigma
        owner, letter = owner[letter >= LETTER], letter[letter >= LETTER]
        firsts = np.searchsorted(owner, np.arange(len(starts) + 1))
        counts = (firsts[1:] - firsts[:-1])[own]
        which = np.repeat(np.arange(len(at)), counts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, letter[np.repeat(firsts[:-1][own], counts) + nth]

    def _match(self, at: Ranges, which: np.ndarray, symbols: np.ndarray, right: bool) -> tuple[Ranges, np.ndarray]:
        """Add columns of ``symbols`` (row ``which`` of it) in turn; what survives."""
        for column in (symbols.T if right else symbols.T[::-1]):
            at = self.extend(at, column[which], right)
            alive = at.size > 0
            at, which = at[alive], which[alive]
        return at, which

    def _branch(self, at: Ranges, which: np.ndarray, symbols: np.ndarray, place: int, right: bool) -> tuple[Ranges, np.ndarray]:
        """The ranges with a letter other than the row's at ``place``, and their rows."""
        owner, letter = self.beside(at, right)
        if place < symbols.shape[1]:
            # of the places where the same insertion can stand only the last is taken
            other = letter != symbols[which[owner], place]
            owner, letter = owner[other], letter[other]
        return self.extend(at[owner], letter, right), which[owner]

    def _finish(self, at: Ranges, which: np.ndarray, place: np.ndarray, symbols: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of ranges whose rows go on without error from ``place``, each from its own, to the delimiter."""
        length = symbols.shape[1]
        rows, words = [], []
        while len(which):
            last = (place == length) if right else (place < 0)
            at = self.extend(at, np.where(last, DELIMITER, symbols[which, np.clip(place, 0, length - 1)]), right)
            done = last & (at.size > 0)
            rows.append(which[done])
            words.append(at.low[done] - self.before[DELIMITER] - 1)
            going = ~last & (at.size > 0)
            at, which, place = at[going], which[going], place[going] + (1 if right else -1)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *words])

    def one_error(self, symbols: np.ndarray, insert: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``symbols``, number of a word) of all words with one error against the row.

        Rows have one length. The error is a replaced symbol or, with ``insert``, one more. It lies
        in either half: the other is matched first and without error, from its delimiter on, and the
        pattern then grows across the half with the error.
        """
        n, length = symbols.shape
        half = length // 2
        found = []
        for right in (True, False):
            exact = symbols[:, :half] if right else symbols[:, half:]
            at, which = self._match(self.delimited(n), np.arange(n), exact, right)
            grown = []
            for place in range(half, length + insert) if right else range(half - 1, -1, -1):
                step = symbols[:, place:place + 1]
                if insert and not right:  # what is inserted before place stands left of its symbol
                    at, which = self._match(at, which, step, right)
                if not len(which):
                    break
                more, rows = self._branch(at, which, symbols, place, right)
                grown.append((more.low, more.reverse, more.size, rows, np.full(len(rows), place + (not insert) if right else place - 1)))
                if not (insert and not right):
                    at, which = self._match(at, which, step, right)
            if grown:
                low, reverse, size, rows, places = (np.concatenate(x) for x in zip(*grown))
                found.append(self._finish(Ranges(low, reverse, size), rows, places, symbols, right))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, words = zip(*found)
        return np.concatenate(rows), np.concatenate(words)

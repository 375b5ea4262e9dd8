"""Word and shingle hashes inside tasks, with numpy."""

from __future__ import annotations

#: Bytes that are hashed together; longer texts are taken alone.
CHUNK = 1 << 20


def scramble(x):
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    import numpy as np

    if not isinstance(x, np.ndarray):
        x = np.asarray(x, np.uint64)
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def heads(x):
    """Where runs of equal values begin in an array that is not empty."""
    import numpy as np

    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def run_lengths(first, n: int):
    """Lengths of runs that begin at `first` in an array of n."""
    import numpy as np

    out = np.empty(len(first), np.int64)
    out[:-1] = first[1:]
    out[-1] = n
    out -= first
    return out


def runs_of(hashes, n: int):
    """Hash of every run of n consecutive words; empty if there are fewer."""
    import numpy as np

    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
    return scramble(total)


class WordHashes:
    """64-bit hashes of all words of many texts at once.

    A word's hash is a polynomial in its scrambled bytes: differences of one running sum over the
    text, brought to the word's start by the inverse power. Powers are kept for the longest text seen.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        import numpy as np

        self.table = scramble(np.arange(1, 257, dtype=np.uint64))
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            ones = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)])
            self.powers, self.inverse = ones(np.uint64(self.BASE)), ones(np.uint64(pow(self.BASE, -1, 1 << 64)))

    def of(self, texts: list):
        """(hashes of all words in order, index of each text's first word and, last, their number)."""
        return self.placed(texts)[:2]

    def placed(self, texts: list):
        """As of(), with the texts joined by blanks and where each word starts and ends there."""
        import numpy as np

        joined = b" ".join(texts) + b" "
        b = np.frombuffer(joined, np.uint8)
        self._grow(max(len(b), CHUNK))
        gap = self.space[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.r_[0, edge]
        start, end = edge[0::2], edge[1::2]
        start = start[: len(end)]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.powers[: len(b)], out=total[1:])
        hashes = scramble((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        at = np.cumsum([0, *(len(x) + 1 for x in texts)])
        return hashes, np.searchsorted(start, at), joined, start, end


def chunks(rows, size_of, most: int = CHUNK):
    """Lists of consecutive rows whose sizes add up to about `most`."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += size_of(row)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some

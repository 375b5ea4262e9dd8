"""Secret scans: credential patterns, and a guess-cost dynamic program over values in a credential context.

Three base kinds are plain patterns. Every value in a credential context, whether or not a base span
covers it, is priced: the least sum of base-10 logarithms of guesses over all ways to cut the value into

* words of ranked lists (a public vocabulary, and the words of the corpus itself, whatever its languages), a capital, a swapped sign
  (leet) and the word's rank in the list where it comes first each having their price,
* years and dates,
* walks of three keys or more over the keyboard's neighbours or along the alphabet, priced by length and turns,
* repeats: all whole repetitions, from within the first of them, of a unit of up to UNIT characters, which is
  itself priced as a value of its own without repeats,
* brute-force characters, priced by the classes of characters that the value uses; separators cost less.

Words are taken up in order of where they start; a walk is carried along as a state of its own, so it costs
no loop over its lengths. Work is linear in a value's length. A value that needs 10**cost guesses or more
is a span of kind `guess`, unless it only refers to a secret (${NAME}, {{name}}, %(name)s), is an expression (a call, an index, a chain
of attributes), a URL without a password in it, or a placeholder (your-key-here). A word that no list has costs what its letters cost.

Defined cases: a null text is empty; an empty table gives no rows; repeated rows give repeated results; a
null doc_id is kept; columns beyond doc_id and text are ignored, whatever their names. Offsets are in code
points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, costs string"

# The patterns of the base kinds, with the least length of what counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
CONTEXT = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client)[_-]?key)["']?[\x20\t]*(?:[:=]|=>)[\x20\t]*["']?([^\s"'`,;<>]{6,})"""
REFERENCE = r"\$\(?\{?[\w.:-]+\}?\)?|\{\{.*|%\(?\w+\)?s?|\{[\w.]+\}|\*+|\.+|x+"
EXPRESSION = r"(?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*(?:\([^()]*\)|\[[^\[\]]*\])(?:\.?\w+|\([^()]*\)|\[[^\[\]]*\])*;?|[a-z_]+(?:\.[a-z_]+)+;?"
LINK = r"[A-Za-z][A-Za-z0-9+.-]*://[^/@:]*(?::\d+)?(?:/[^@]*)?"
PLACEHOLDER = r"(?i:(?:your|my|insert|enter|replace|change|put)[-_][a-z]+(?:[-_][a-z]+)*|<[^>]*>?)"

# Words of frequent passwords, most frequent first, and rows of keys.
COMMON = "password admin welcome login monkey dragon master letmein sunshine princess football baseball shadow qwerty iloveyou superman trustno hello freedom whatever secret test user root guest default changeme summer winter spring autumn love star pass token key server access account company office service system data cloud example sample demo temp public private local host database backup".split()
KEYS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
LEET = {"4": "a", "@": "a", "3": "e", "0": "o", "1": "i", "!": "i", "$": "s", "5": "s", "7": "t"}

WORD_LEAST, WORD_MOST, UNIT = 2, 20, 16
WORD_PRICE, CAPITAL_PRICE, LEET_PRICE = 0.3, 0.3, 0.5
YEAR_PRICE, DATE_PRICE = 2.1, 4.6
SEPARATORS, SEPARATOR_PRICE = "-_.", 0.7
WALK_PRICE, TURN_PRICE, STEP_PRICE = 1.7, 0.7, 0.05


def ranked_words(vocabulary: str) -> list[str]:
    """COMMON, then the whole words of a public tokenizer's vocabulary (JSON, words end in </w>) in the order of their merges."""
    import json
    from pathlib import Path

    ids = json.loads(Path(vocabulary).read_text())["model"]["vocab"]
    whole = (t[:-4] for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    return list(dict.fromkeys([*COMMON, *(w for w in whole if WORD_LEAST <= len(w) <= WORD_MOST and w.isascii() and w.isalpha())]))


def corpus_words(docs: DataFrame, most: int = 50_000, least: int = 5) -> list[str]:
    """The words of WORD_LEAST + 1 to WORD_MOST letters that stand most often in the documents, in lower case: counted over all, `most` of them kept.

    One that stands there less than `least` times may be a secret itself and is no word.
    """
    letters = F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{WORD_LEAST + 1},{WORD_MOST}}}(?![\p{{L}}\p{{N}}])"), F.lit(0))
    times = docs.select(F.explode(letters).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least)
    return [r.word for r in times.orderBy(F.desc("times"), "word").limit(most).collect()]


class Prices:
    """guess_cost with its tables made once. words, and any list in also: most frequent first."""

    def __init__(self, words: Sequence[str] = COMMON, also: Sequence[Sequence[str]] = ()):
        from math import log10

        self.rank: dict[str, float] = {}
        for some in (words, *also):
            for k, w in enumerate(some):
                self.rank[w] = min(self.rank.get(w, 99.0), log10(k + 2))
        self.leet = str.maketrans(LEET)
        at = {c: (x, y) for y, row in enumerate(KEYS) for x, c in enumerate(row)}
        ways = {(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)}
        keys = {(a, b): d for a, (x, y) in at.items() for b, (u, v) in at.items() if (d := (u - x, v - y)) in ways}
        letters = "abcdefghijklmnopqrstuvwxyz"
        alphabet = {(a, b): way for way, row in ((1, letters), (-1, letters[::-1])) for a, b in zip(row, row[1:])}
        self.steps = [keys, alphabet]

    def character(self, value: str) -> float:
        """Price of a brute-force character: the logarithm of how many the classes that value uses hold."""
        from math import log10

        sizes = [(26, any(c.islower() for c in value)), (26, any(c.isupper() for c in value)), (10, any(c.isdigit() for c in value)), (33, not value.isalnum())]
        return log10(max(10, sum(n for n, used in sizes if used)))

    def word(self, value: str, i: int, j: int, low: str, plain: str) -> float | None:
        rank = self.rank.get(plain[i:j])
        if rank is None:
            return None
        return WORD_PRICE + rank + (CAPITAL_PRICE if value[i:j] != low[i:j] else 0) + (LEET_PRICE if plain[i:j] != low[i:j] else 0)

    @staticmethod
    def dates(low: str, i: int):
        """(end, price) of the year and the dates that start at i."""
        if low[i : i + 2] not in ("19", "20") or not (low[i : i + 4].isascii() and low[i : i + 4].isdigit() and len(low) >= i + 4):
            return
        yield i + 4, YEAR_PRICE
        for size, digits in ((8, low[i + 4 : i + 8]), (10, low[i + 5 : i + 7] + low[i + 8 : i + 10] if low[i + 4 : i + 5] == low[i + 7 : i + 8] and low[i + 4 : i + 5] in ("-", ".", "/", "_") else "")):
            if len(digits) == 4 and digits.isascii() and digits.isdigit() and 1 <= int(digits[:2]) <= 12 and 1 <= int(digits[2:]) <= 31:
                yield i + size, DATE_PRICE

    def cost(self, value: str, one: float | None = None, repeats: bool = True) -> float:
        """Base-10 logarithm of the guesses that the cheapest segmentation of value needs."""
        from math import inf, log10

        n, low = len(value), value.lower()
        if len(low) != n:  # a character whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(self.leet)
        one = self.character(value) if one is None else one
        best, walks = [0.0] + [inf] * n, [inf] * len(self.steps)
        ways = [[steps.get(pair) for pair in zip(low, low[1:])] for steps in self.steps]
        runs = _repeats(low) if repeats else {}
        units: dict[str, float] = {}
        for i in range(n + 1):
            # all else that ends at i is known by now: best[i] is final once the walks that end here are
            for k, way in enumerate(ways):
                if i >= 3 and way[i - 2] is not None and way[i - 3] is not None:
                    turn = TURN_PRICE * (way[i - 2] != way[i - 3])
                    walks[k] = min(walks[k] + STEP_PRICE + turn, best[i - 3] + WALK_PRICE + turn + 3 * STEP_PRICE)
                    best[i] = min(best[i], walks[k])
                else:
                    walks[k] = inf
            if i == n:
                return best[n]
            here = best[i]
            best[i + 1] = min(best[i + 1], here + (min(one, SEPARATOR_PRICE) if value[i] in SEPARATORS else one))
            for j in range(i + WORD_LEAST, min(n, i + WORD_MOST) + 1):
                price = self.word(value, i, j, low, plain)
                if price is not None:
                    best[j] = min(best[j], here + price)
            for j, price in self.dates(low, i):
                best[j] = min(best[j], here + price)
            for unit, times in runs.get(i, ()):
                text = value[i : i + unit]
                if text not in units:
                    units[text] = self.cost(text, one, False)
                best[i + unit * times] = min(best[i + unit * times], here + units[text] + log10(times))


def _repeats(low: str) -> dict[int, list[tuple[int, int]]]:
    """start -> (unit length, whole repetitions, two at least), for starts within the first unit of each maximal periodic run."""
    found: dict[int, list[tuple[int, int]]] = {}
    n = len(low)
    for unit in range(1, min(UNIT, n // 2) + 1):
        start = 0
        for i in range(n - unit + 1):
            if i < n - unit and low[i] == low[i + unit]:
                continue
            end = i + unit  # low[start:end] has this period and cannot be extended
            if end - start >= 2 * unit:
                for s in range(start, min(start + unit, end - 2 * unit + 1)):
                    found.setdefault(s, []).append((unit, (end - s) // unit))
            start = i + 1
    return found


def guess_cost(value: str, words: Sequence[str] = COMMON) -> float:
    return Prices(words).cost(value)


def scan_secrets(docs: DataFrame, words: Sequence[str] = COMMON, cost: float = 10.0, also: Sequence[Sequence[str]] = ()) -> DataFrame:
    """A row for each document: counts by kind, digest of the base spans, all spans as kind:start:end, and costs.

    Spans are in order of start, then of kind (assign, access, hex, guess); end is exclusive. A base
    match is dropped if what counts of it is too short. cost is the least power of ten of guesses
    for a `guess` span. words and the lists of also are ranked, and sent to every task: their sizes are parameters, whatever the
    data. costs has start:end:price of every value in a credential context, reported or not.
    """
    sent = docs.sparkSession.sparkContext.broadcast((list(words), [list(x) for x in also]))

    def scan(batches):
        import hashlib
        import re

        import pyarrow as pa

        assign, access, digits = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
        context, reference = re.compile(CONTEXT, re.I | re.A), re.compile("|".join((REFERENCE, EXPRESSION, LINK, PLACEHOLDER)), re.A)
        prices = Prices(*sent.value)
        kinds = [pa.int64()] * 5 + [pa.string()] * 3
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "costs"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                a = [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
                k = [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
                h = [(m.start(), 2, m.end()) for m in digits.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
                base = sorted(a + k + h)
                priced = [(*m.span(1), 0.0 if reference.fullmatch(m[1]) else prices.cost(m[1])) for m in context.finditer(text)]
                g = [(s, 3, e) for s, e, price in priced if price >= cost]
                spell = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'guess')[kind]}:{s}:{e}" for s, kind, e in spans)
                rows.append((doc_id, len(a), len(k), len(h), len(g), hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted(base + g)), ",".join(f"{s}:{e}:{price:.2f}" for s, e, price in priced)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, OUT)

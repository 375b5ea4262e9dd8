"""Bounded-space packing of token ids into sequences.

Each scan task keeps a fixed number of open windows. A document's full windows go out at once; its
tail goes to the open window that it fills best. If it fits none, the fullest window takes the tail's
head as far as it has room (unless the gap is tiny) and goes out, and the rest opens a window. What is
open at the end of a task is merged with the open windows of FAN tasks, cutting where a sequence is full.

Ids are remembered by white-space separated chunk. That is exact for a tokenizer that splits at white
space before merging, as the word vocabulary used here does; tests compare it with whole texts.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are
packed each; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.tokens import WordHashes
from siltbed.llm.tokens import chunks as grouped

FAN = 8
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE = OUT + ", grp long, ids binary"


def _schema(with_ids: bool):
    import pyarrow as pa

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.schema([(n, pa.int64()) for n in names] + ([("grp", pa.int64()), ("ids", pa.binary())] if with_ids else []))


class ChunkIds:
    """Token ids of texts, put together from remembered chunks by numpy.

    The vocabulary is in lower case and takes letters, digits and runs of punctuation apart. So a text in
    normal form whose punctuation marks stand alone may be put in lower case, with blanks around the
    marks, before it is cut at white space: far fewer chunks differ then. Other texts are cut as they are.
    Chunks are looked up by 64-bit hash in a sorted table of `most` at most; new words of letters are
    encoded many at a time and cut apart at the ids that end a word, other chunks one by one.
    """

    MARKS = ".,!?;:"

    def __init__(self, tokenizer: str, most: int = 1_000_000):
        import os
        import re

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.most, self.encoder, self.hashes = most, Tokenizer.from_file(tokenizer), WordHashes()
        self.ends = np.zeros(self.encoder.get_vocab_size(), bool)
        self.ends[[k for w, k in self.encoder.get_vocab().items() if w.endswith("</w>")]] = True
        self.together = re.compile(r"[^\w \n][^\w \n]|_")
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.names, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, and where each chunk's ids are
        self.first, self.sizes, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def plain(self, text: str) -> bytes:
        """The text to be cut: lower case with blanks around marks where that changes no id."""
        from unicodedata import normalize

        low = text.lower() if text.isascii() else normalize("NFC", text).lower()
        if (low.isascii() or ("Σ" not in text and normalize("NFC", low) == low)) and not self.together.search(low):
            for mark in self.MARKS:
                low = low.replace(mark, f" {mark} ")
            text = low
        return text.encode()

    def encode(self, words: list) -> list:
        """For each chunk the list of its ids."""
        from itertools import chain
        from unicodedata import normalize

        import numpy as np

        out: dict[int, list] = {}
        letters = [k for k, w in enumerate(words) if w.isalpha() and len(w) < 64 and (w.isascii() or normalize("NFC", w).lower().isalpha())]
        for i in range(0, len(letters), 4096):
            some = letters[i : i + 4096]
            found = self.encoder.encode_batch_fast([" ".join([words[k] for k in some[j : j + 64]]) for j in range(0, len(some), 64)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in found), "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(some):
                ids = ids.tolist()
                out |= {k: ids[a:b] for k, a, b in zip(some, [0, *ends], ends)}
        return [out[k] if k in out else self.encoder.encode(w, add_special_tokens=False).ids for k, w in enumerate(words)]

    def learn(self, names, words: list) -> None:
        """names: sorted new hashes of words."""
        from itertools import chain

        import numpy as np

        found = self.encode(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        place = np.searchsorted(self.names, names)
        self.names, self.rows = np.insert(self.names, place, names), np.insert(self.rows, place, len(self.sizes) + np.arange(len(names)))
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum()))]

    def of_texts(self, texts):
        """The ids of each text as an array, in order; about a million bytes are looked at together."""
        import numpy as np

        for some in grouped(map(self.plain, texts), len):
            if len(self.names) > self.most:
                self.forget()
            hashes, first, joined, start, end = self.hashes.placed(some)
            names, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
            new = self.names[place] != names if len(self.names) else np.ones(len(names), bool)
            if new.any():
                self.learn(names[new], [joined[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())])
            row = self.rows[np.searchsorted(self.names, names)][which]
            sizes = self.sizes[row]
            upto = np.cumsum(sizes)
            ids = self.ids[np.repeat(self.first[row] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
            bound = np.r_[0, upto][first]
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
                yield ids[a:b]


def chunk_ids(tokenizer: str) -> ChunkIds:
    """The process's own ChunkIds: a Python worker serves many tasks and keeps what it has learnt."""
    import sys
    import types

    kept = sys.modules.setdefault("siltbed_worker_cache", types.ModuleType("siltbed_worker_cache"))
    if tokenizer not in kept.__dict__:
        kept.__dict__[tokenizer] = ChunkIds(tokenizer)
    return kept.__dict__[tokenizer]


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, open_windows: int = 64, end_id: int = 1, least_gap: int = 16) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids are unique, not dense. Space in a task: open_windows * size ids and a cache of chunks.
    """

    def place(batches):
        import zlib
        from itertools import count

        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        chunks = chunk_ids(tokenizer)
        end = end_id.to_bytes(4, "little")
        numbers = count(pid << 33)
        windows: list[list] = []  # [fill, pieces]; a piece: doc_id, start, ids, doc_tokens
        rows: list[tuple] = []

        def emit(pieces, seq):
            at = 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), total, seq, at, seq, None))
                at += n

        for batch in batches:
            rows.clear()
            for doc_id, ids in zip(batch.column(0).to_pylist(), chunks.of_texts(x.as_py() or "" for x in batch.column(1))):
                ids = ids.tobytes() + end
                total, start = len(ids) // 4, 0
                while total - start >= size:
                    emit([(doc_id, start, ids[4 * start : 4 * (start + size)], total)], next(numbers))
                    start += size
                if start == total:
                    continue
                n = total - start
                best = max((w for w in windows if w[0] + n <= size), key=lambda w: w[0], default=None)
                if best is None and len(windows) >= open_windows:
                    fullest = max(windows, key=lambda w: w[0])
                    gap = size - fullest[0]
                    if gap >= least_gap:
                        fullest[1].append((doc_id, start, ids[4 * start : 4 * (start + gap)], total))
                        start, n = start + gap, n - gap
                    emit(fullest[1], next(numbers))
                    windows.remove(fullest)
                if best is None:
                    best = [0, []]
                    windows.append(best)
                best[0] += n
                best[1].append((doc_id, start, ids[4 * start :], total))
                if best[0] == size:
                    emit(best[1], next(numbers))
                    windows.remove(best)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _schema(True).types)] if rows else [pa.array([], t) for t in _schema(True).types], schema=_schema(True))
        rows.clear()
        for _, pieces in windows:
            at, seq = 0, next(numbers)
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, seq, at, -1 - pid // FAN, ids))
                at += len(ids) // 4
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _schema(True).types)], schema=_schema(True))

    def merge(batches):
        import zlib

        import pyarrow as pa
        import pyarrow.compute as pc

        left: dict[int, list] = {}
        for batch in batches:
            done = batch.filter(pc.is_null(batch.column("ids")))
            if done.num_rows:
                yield done.select(_schema(False).names)
            for r in batch.filter(pc.is_valid(batch.column("ids"))).to_pylist():
                left.setdefault(r["grp"], []).append(r)
        for grp, pieces in left.items():
            pieces.sort(key=lambda r: (r["sequence_id"], r["offset"]))
            seq, at, rows = (1 << 62) + ((-1 - grp) << 33), 0, []
            for r in pieces:
                ids, start = r["ids"], r["start"]
                while ids:
                    part = ids[: 4 * (size - at)]
                    n = len(part) // 4
                    rows.append((r["doc_id"], start, n, zlib.crc32(part), r["doc_tokens"], seq, at))
                    ids, start, at = ids[4 * n :], start + n, at + n
                    if at == size:
                        seq, at = seq + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_schema(False))

    placed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(place, PIECE)
    return placed.repartition("grp").mapInArrow(merge, OUT)

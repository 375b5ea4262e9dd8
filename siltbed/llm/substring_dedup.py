"""Substring dedup by super-k-mer partitioning of word windows.

Every document is cut into runs of consecutive windows that share a minimiser (the least hash among the
window's word triples). A run travels to its minimiser's bucket as one packed string, so equal windows
meet there. A minimiser that a sample of the documents shows to hold too much for one bucket (a passage that
very many documents share, each with its own words around it) is split: its windows travel one by one, to
buckets by the hash of the whole window. The table of these minimisers is bounded and only steers cost.

Within a batch of BATCH_BYTES of text equal runs are stored once and only the smallest document's place goes
along: for the others the answer is known at once. In a bucket the windows are sorted by hash, and those
that meet in several documents are compared word for word; the answers, as word intervals, go back to
their documents. A passage with any number of copies costs a bucket one run for each batch that has it.

The numbers of buckets and of tasks follow the bytes of text, so a bucket, which is held whole, does not grow
with the input.

Defined cases: a null text has no words; documents with fewer than `size` words keep all; rows with the
same doc_id count as one document, so they do not remove each other's words, and are told apart by 64 bits of
their text's hash; a null doc_id ranks after all others; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import text_hash
from siltbed.llm.tokens import WordHashes, chunks, runs_of, scramble

LAST = (1 << 63) - 1
TRIPLE = 3
BATCH_BYTES = 12 << 20
BUCKET_BYTES, TASK_BYTES = 12 << 20, 64 << 20
SHARE, HOT_MOST = 64, 1 << 16  # hot minimisers: looked for in 1/64 of the documents, at most so many
PACKED = "bucket long, places binary, texts binary"
ANSWER = "id long, th long, starts array<int>, ends array<int>"


def runs_in(hashes: WordHashes, texts: list, size: int):
    """Runs of windows that share a minimiser, over texts of blank-separated words.

    Returns (words, joined, start, end, first) as WordHashes.placed has them, then for each run its text, first
    word, word after its last, and minimiser.
    """
    import numpy as np

    words, first, joined, start, end = hashes.placed(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    m = len(words) - size + 1
    none = np.empty(0, np.int64)
    if m <= 0:
        return words, joined, start, end, first, none, none, none, np.empty(0, np.uint64)
    triples = runs_of(words, TRIPLE)
    windows = np.flatnonzero(owner[:m] == owner[size - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(triples, size - TRIPLE + 1)[windows].argmin(axis=1) + windows
    if not len(windows):
        return words, joined, start, end, first, none, none, none, np.empty(0, np.uint64)
    head = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (owner[windows[1:]] != owner[windows[:-1]])])
    a = windows[head]
    b = windows[np.r_[head[1:] - 1, len(windows) - 1]] + size
    return words, joined, start, end, first, owner[a], a, b, triples[least[head]]


def hot_minimisers(rows: DataFrame, size: int, most_bytes: float, share: int = SHARE) -> list[int]:
    """Minimisers whose runs, by a sample, hold more than most_bytes; HOT_MOST at most, the largest."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            for some in chunks((b" ".join((t.as_py() or b"").split()) for t in batch.column(0)), len):
                _, _, start, end, _, _, a, b, minimiser = runs_in(hashes, some, size)
                if len(a):
                    names, at = np.unique(minimiser, return_inverse=True)
                    held = np.bincount(at, (end[b - 1] - start[a]).astype(float)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(held)], ["name", "held"])

    some = rows.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(share)) == 0).select("text")
    found = some.mapInArrow(count, "name long, held long").groupBy("name").agg(F.sum("held").alias("held")).where(F.col("held") * share > most_bytes)
    return sorted(r.name for r in found.orderBy(F.desc("held"), "name").limit(HOT_MOST).select("name").toLocalIterator())


def dedup_substrings(docs: DataFrame, size: int = 13, buckets: int | None = None, share: int = SHARE) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed and kept_sha256 of the words that stay.

    A word goes if a window of `size` words covers it whose word sequence also starts in a document with
    a smaller doc_id. buckets: as many as the text needs if None.
    """
    th = text_hash(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), th.alias("th"), F.col("text").cast("binary").alias("text"))
    n_tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n_tasks = max(n_tasks, -(-held // TASK_BYTES))
    n_buckets = buckets or max(4 * n_tasks, -(-held // BUCKET_BYTES))
    hot_names = hot_minimisers(rows, size, held / n_buckets / 4, share)

    def squeezed(z, counts, docs_, th, start):
        """Places of runs as one compressed string: the number of places of each run, then the places' columns."""
        import numpy as np

        parts = [np.int32(len(counts)), np.asarray(counts, np.int32), np.diff(np.asarray(docs_, np.int64), prepend=np.int64(0)), np.asarray(th, np.int64), np.asarray(start, np.int32)]
        return z.compress(b"".join(x.tobytes() for x in parts))

    def spread(z, data):
        """The reverse: (run of each place, doc, th, start)."""
        import numpy as np

        data = z.decompress(data)
        n = int(np.frombuffer(data, np.int32, 1)[0])
        counts = np.frombuffer(data, np.int32, n, 4)
        m, at = int(counts.sum()), 4 + 4 * n
        docs_ = np.cumsum(np.frombuffer(data, np.int64, m, at))
        return np.repeat(np.arange(n), counts), docs_, np.frombuffer(data, np.int64, m, at + 8 * m), np.frombuffer(data, np.int32, m, at + 16 * m)

    def packed(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.binary(), pa.binary()])], ["bucket", "places", "texts"])

    def cut_runs(batches):
        import numpy as np
        import zstandard

        hashes = WordHashes()
        z = zstandard.ZstdCompressor(level=3)
        hot = np.array(hot_names, np.int64).view(np.uint64)
        hot.sort()
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (b" ".join((t.as_py() or b"").split()) for t in b.column(2))))

        def one_chunk(some):
            """Columns of the chunk's runs: key, bucket, doc, th, first word in the document, number of words, bytes from and to; and its text."""
            words, joined, start, end, first, owner, a, b, name = runs_in(hashes, [r[2] for r in some], size)
            windows = runs_of(words, size)
            if len(hot) and len(a):
                is_hot = hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name
                n = np.where(is_hot, b - a - size + 1, 1)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner, name, is_hot = np.repeat(owner, n), np.repeat(name, n), np.repeat(is_hot, n)
                a, b = np.repeat(a, n) + np.where(is_hot, step, 0), np.repeat(b, n)
                b = np.where(is_hot, a + size, b)
                name = np.where(is_hot, windows[a], name)
            # a run has fewer than 2 * size words, so its first and last window name it
            key = scramble(windows[a] + scramble(windows[b - size] + (b - a).astype(np.uint64))) if len(a) else np.empty(0, np.uint64)
            doc = np.array([LAST if r[0] is None else r[0] for r in some], np.int64)
            th = np.array([r[1] for r in some], np.int64)
            return (key, (name % np.uint64(n_buckets)).astype(np.int64), doc[owner], th[owner], a - first[owner], b - a, start[a], end[b - 1]), joined

        for batch in chunks(rows, lambda r: len(r[2]), BATCH_BYTES):
            parts, texts, base = [], [], 0
            for some in chunks(batch, lambda r: len(r[2])):
                columns, joined = one_chunk(some)
                parts.append((*columns[:6], columns[6] + base, columns[7] + base))
                texts.append(joined)
                base += len(joined)
            joined = b"".join(texts)
            key, bucket, doc, th, at, n, s, e = (np.concatenate(c) for c in zip(*parts))
            del parts, texts
            order = np.argsort(key, kind="stable")
            alone = np.ones(len(key), bool)
            if len(key) > 1:
                same = key[order[1:]] == key[order[:-1]]
                alone[order[1:][same]] = alone[order[:-1][same]] = False
            runs: dict[bytes, list] = {}  # repeated runs: text -> [bucket, doc, [(th, first word)]] of the smallest doc
            known: dict[tuple, list] = {}  # (doc, th) -> [start, end, ...]
            again = np.flatnonzero(~alone)
            for k_bucket, k_doc, k_th, k_at, k_n, k_s, k_e in zip(*(c[again].tolist() for c in (bucket, doc, th, at, n, s, e))):
                was = runs.setdefault(joined[k_s:k_e], [k_bucket, k_doc, []])
                if was[1] == k_doc:
                    was[2].append((k_th, k_at))
                elif was[1] < k_doc:
                    known.setdefault((k_doc, k_th), []).extend((k_at, k_at + k_n))
                else:
                    for th_, at_ in was[2]:
                        known.setdefault((was[1], th_), []).extend((at_, at_ + k_n))
                    was[1:] = [k_doc, [(k_th, k_at)]]
            by_bucket: dict[int, list] = {}
            for run, (k_bucket, k_doc, places) in runs.items():
                by_bucket.setdefault(k_bucket, []).append((run, k_doc, places))
            one = np.flatnonzero(alone)
            one = one[np.argsort(bucket[one], kind="stable")]
            numbers, begin = np.unique(bucket[one], return_index=True)
            own = dict(zip(numbers.tolist(), np.split(one, begin[1:]))) if len(one) else {}
            out = []
            for k_bucket in {**own, **by_bucket}:
                mine, found = own.get(k_bucket, one[:0]), by_bucket.get(k_bucket, [])
                counts = np.r_[np.ones(len(mine), np.int32), np.array([len(x[2]) for x in found], np.int32)]
                docs_ = np.r_[doc[mine], np.array([x[1] for x in found for _ in x[2]], np.int64)]
                places = np.array([p for x in found for p in x[2]], np.int64).reshape(-1, 2)
                runs_text = [joined[x:y] for x, y in zip(s[mine].tolist(), e[mine].tolist())] + [x[0] for x in found]
                out.append((k_bucket, squeezed(z, counts, docs_, np.r_[th[mine], places[:, 0]], np.r_[at[mine], places[:, 1]]), z.compress(b"\n".join(runs_text))))
                if len(out) >= 64:
                    yield packed(out)
                    out = []
            known_rows = list(known.items())
            for i in range(0, len(known_rows), 5000):  # a document's starts and ends travel as the places of one run
                some = known_rows[i : i + 5000]
                counts = np.array([len(x) for _, x in some])
                docs_, ths = (np.repeat(np.array([k[c] for k, _ in some], np.int64), counts) for c in (0, 1))
                out.append((-1 - int(some[0][0][1] % n_buckets), squeezed(z, counts, docs_, ths, [p for _, x in some for p in x]), None))
            if out:
                yield packed(out)

    def count_windows(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        hashes = WordHashes()
        z = zstandard.ZstdDecompressor()

        def answers(rows):
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 5000]), types)], ["id", "th", "starts", "ends"])

        def solve(texts, places):
            """texts: strings of newline-separated runs; places: (run, doc, th, start) arrays of each string."""
            base = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
            run = np.concatenate([p[0] + b for p, b in zip(places, base)])
            doc, th, begin = (np.concatenate([p[k] for p in places]) for k in (1, 2, 3))
            first_place = np.searchsorted(run, np.arange(base[-1]))
            run_doc = doc[first_place]
            parts, offset = [], 0
            for some in chunks(zip(texts, base.tolist()), lambda x: len(x[0])):  # what hashing needs is many times the text
                words, _, joined, start, end = hashes.placed([b"\n".join(text for text, _ in some)])
                breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
                parts.append((words, np.searchsorted(breaks, start) + some[0][1], start + offset, end + offset))
                offset += len(joined)
            words, owner, start, end = (np.concatenate(c) for c in zip(*parts))
            joined = b"\n".join(texts)
            windows = runs_of(words, size)
            del parts, words
            inside = np.flatnonzero(owner[: len(windows)] == owner[size - 1 :])
            docs_of = run_doc[owner[inside]]
            order = np.lexsort((docs_of, windows[inside]))
            h, d = windows[inside][order], docs_of[order]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[head, len(h)])
            shared = np.repeat(np.maximum.reduceat(d, head) != d[head], count)
            at = inside[order[shared]]
            del windows, inside, docs_of, order, h, d, shared
            least: dict[bytes, int] = {}
            keys = [joined[s:e] for s, e in zip(start[at].tolist(), end[at + size - 1].tolist())]
            its = run_doc[owner[at]].tolist()
            for key, doc_ in zip(keys, its):
                if least.setdefault(key, doc_) > doc_:
                    least[key] = doc_
            gone = np.sort(at[np.fromiter((least[key] < doc_ for key, doc_ in zip(keys, its)), bool, len(keys))])
            if not len(gone):
                return
            cuts = np.flatnonzero(np.r_[True, (np.diff(gone) != 1) | (owner[gone[1:]] != owner[gone[:-1]])])
            a, b = gone[cuts], gone[np.r_[cuts[1:] - 1, len(gone) - 1]]
            run_start = np.searchsorted(owner, np.arange(base[-1]))
            spans: dict[int, list] = {}
            for k, x, y in zip(owner[a].tolist(), (a - run_start[owner[a]]).tolist(), (b - run_start[owner[a]] + size).tolist()):
                spans.setdefault(k, []).append((x, y))
            found: dict[tuple, list] = {}
            for p in np.flatnonzero(np.isin(run, np.fromiter(spans, np.int64))).tolist():
                found.setdefault((int(doc[p]), int(th[p])), []).extend((int(begin[p]) + x, int(begin[p]) + y) for x, y in spans[int(run[p])])
            yield from answers([(*key, [x for x, _ in s], [y for _, y in s]) for key, s in found.items()])

        now, texts, places = None, [], []
        for batch in batches:
            for bucket, where, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if bucket < 0:
                    known: dict[tuple, list] = {}
                    for _, doc, th, x in zip(*(c.tolist() for c in spread(z, where.as_py()))):
                        known.setdefault((doc, th), []).append(x)
                    yield from answers([(*key, x[0::2], x[1::2]) for key, x in known.items()])
                    continue
                if bucket != now:
                    if texts:
                        yield from solve(texts, places)
                    now, texts, places = bucket, [], []
                texts.append(z.decompress(text.as_py()))
                places.append(spread(z, where.as_py()))
        if texts:
            yield from solve(texts, places)

    def digest(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, text, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text.as_py() or b"").split()
                kept = words
                if starts:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.array([x for part in starts for x in part]), 1)
                    np.add.at(change, np.array([x for part in ends for x in part]), -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = rows.mapInArrow(cut_runs, PACKED).repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(count_windows, ANSWER)
    by_row = found.groupBy("id", "th").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    whole = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).join(by_row.hint("shuffle_hash"), ["id", "th"], "left")
    return whole.select("doc_id", "text", "starts", "ends").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")

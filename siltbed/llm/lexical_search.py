"""Ranked lexical search: postings are traversed in fixed windows of documents, scores are scattered into small arrays.

Documents are numbered as tasks read them and cut into windows of WINDOW documents (fewer where their postings exceed POSTINGS).
A window is one row of the index: its documents, their lengths, and for each term of the items' vocabulary the places in the window
that hold it and how often, in order of term. The index is written to the shared folder, nothing is shuffled for it,
and the corpus statistics (documents, terms, document frequencies) are summed from it.

Scoring goes window by window. A term's share of a score is computed once for a window; for each item the shares of its
terms are added into an array of WINDOW 64-bit sums, and a bitset tells which places are occupied. Occupied places that reach
the item's k-th best so far are harvested into its heap, which a task keeps from window to window. Tasks return k documents for
each item at most; these are ranked in two steps, by salt and then by item, so no item's rows meet in one task unreduced.

Items are taken in blocks by hash so that a block has about BLOCK_TERMS terms: its items and their vocabulary are sent to
all tasks. Each block scans the documents once.

Defined cases: a null or empty text, or one without terms, is in no result and counts nowhere; an item without terms, or whose
terms no document holds, has no rows. Every row of documents is a document of its own, also where rows are equal or share a
doc_id; a null doc_id ranks after others of the same score. Items equal in item_id and text are one item; texts that share an item_id
are ranked each. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.llm.common import cut

WINDOW, POSTINGS = 8192, 1 << 20
BLOCK_TERMS = 200_000
SALTS = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "docs array<long>, sizes array<long>, terms array<int>, ends array<int>, places array<int>, times array<int>"


def item_terms(text: Column) -> Column:
    """The distinct terms of a text, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))


def index_windows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each window of documents: ids, numbers of terms, and the postings of the vocabulary in order of term."""

    def build(batches):
        import re
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        term_of = re.compile(rb"[0-9a-z\x80-\xff]+")  # the bytes of TERM's characters in UTF-8, after lower()
        ids, sizes, terms, places, times = [], [], [], [], []

        def window():
            term, place, n = (np.array(x, np.int32) for x in (terms, places, times))
            order = np.argsort(term, kind="stable")
            names, first = np.unique(term[order], return_index=True)
            ends = np.r_[first[1:], len(term)].astype(np.int32) if len(names) else np.empty(0, np.int32)
            row = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))]
            row += [pa.array([x], pa.list_(pa.int32())) for x in (names, ends, place[order], n[order])]
            for x in (ids, sizes, terms, places, times):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["docs", "sizes", "terms", "ends", "places", "times"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = term_of.findall((text.as_py() or b"").lower())
                if not found:
                    continue
                for term, n in Counter(filter(vocabulary.__contains__, found)).items():
                    terms.append(vocabulary[term])
                    places.append(len(ids))
                    times.append(n)
                ids.append(doc)
                sizes.append(len(found))
                if len(ids) == WINDOW or len(terms) >= POSTINGS:
                    yield window()
        if ids:
            yield window()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(build, INDEX)


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best of every item; items: lists of terms as bytes."""
    import math

    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in items for t in terms}))}
    index = cut(index_windows(docs, vocabulary), "postings")
    total = index.agg(F.sum(F.size("docs")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    start = F.when(F.col("at") == 0, 0).otherwise(F.element_at("ends", F.col("at")))
    held = index.select("ends", F.posexplode("terms").alias("at", "term")).select("term", (F.element_at("ends", F.col("at") + 1) - start).alias("docs"))
    weight = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.docs + 1))) for r in held.groupBy("term").agg(F.sum("docs").alias("docs")).collect()}  # no more than the vocabulary
    wanted = [[vocabulary[t] for t in terms] for terms in items]

    def score(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        heaps: list[list] = [[] for _ in wanted]
        sums, occupied = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for batch in batches:
            for row in range(batch.num_rows):
                docs_, sizes, terms, ends, places, times = (batch.column(c)[row].values for c in range(6))
                absent = np.array(docs_.is_null())
                ids, size = docs_.fill_null(0).to_numpy(), sizes.to_numpy()
                ends, places, times = ends.to_numpy(), places.to_numpy(), times.to_numpy().astype(np.int64)
                length = 20 * (50 + 50 * size * n_docs // n_terms)
                share = np.int64(1_000_000_000) * times // (1000 * times + length[places])
                parts, begin = {}, 0
                for term, end in zip(terms.to_pylist(), ends.tolist()):
                    parts[term] = (places[begin:end], weight[term] * share[begin:end])
                    begin = end
                for heap, own in zip(heaps, wanted):
                    mine = [parts[t] for t in own if t in parts]
                    if not mine:
                        continue
                    for at, value in mine:
                        sums[at] += value  # a term has a place once
                        occupied[at] = True
                    least = heap[0][0] if len(heap) == k else 1
                    found = np.flatnonzero(occupied)
                    found = found[sums[found] >= max(least, 1)]
                    if len(found) > k:
                        found = found[np.lexsort((ids[found], absent[found], -sums[found]))[:k]]
                    for p in found.tolist():
                        entry = (int(sums[p]), not absent[p], -int(ids[p]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    for at, _ in mine:
                        sums[at] = 0
                        occupied[at] = False
        out = [(item, -e[2] if e[1] else None, e[0]) for item, heap in enumerate(heaps) for e in heap]
        for i in range(0, len(out), 50_000):
            columns = zip(*out[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return index.mapInArrow(score, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, by falling score and then by doc_id."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), "text").distinct().select("item_id", item_terms(F.col("text")).alias("terms"), F.xxhash64("item_id", "text").alias("h")).where("size(terms) > 0")
    asked = cut(asked, "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    top = lambda frame, *keys: frame.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*first))).where(F.col("rank") <= k)
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod("h", F.lit(blocks)) == b).orderBy("item_id", "h").collect()  # BLOCK_TERMS terms or so
        best = _block(docs, [[t.encode() for t in r.terms] for r in rows], k).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        best = top(top(best, "item", "salt").drop("rank"), "item")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id long")
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

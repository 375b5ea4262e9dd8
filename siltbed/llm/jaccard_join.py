"""N-gram Jaccard join: exact links between shingle sets, by universe partition and the pigeonhole principle.

Sets with Jaccard similarity of 3/4 or more differ in at most (|r| + |s|) / 7 shingles and in size by a
third. Documents are grouped into size bands (of the smaller set; a document is also indexed in the band
below if a partner may lie there). A band hashes the universe of shingles into segments.

First links. Of each set the least shingle hash in every quarter of the hash range is kept. Documents that share one meet the
first of their run, the partner that a document meets most often is verified, and these links, with those between equal sets, join
components. They steer cost only: what follows finds every link again that lies between components, and nothing within them.

Allocation. For each band a sample of the documents, one of each component, tells what a segment would cost: how many rows an index
of it has and how many pairs meet there, with its whole subset alone (one unit of the pigeonhole budget) or
with its one-deletion neighbourhood too (two units, where a document has two shingles or more there).
The cheapest units are taken until they cover the budget that documents of the band need; these
segments come first, in order of cost, with one unit or two as chosen; the others come after them and are not
indexed unless a document falls short. The table is bounded (segments are told apart up to CLASSES) and
steers cost only.

Exact scheme. A document lists its non-empty segments in that order and indexes them up to its budget: as
long as the units before one are at most d, the number of shingles that it may differ in. Take the first
segment that two similar documents have alike, or, if it counts for two units, that differs by one
shingle and is empty in neither. Every segment before it differs by at least as many shingles as the
units it counts for in either document, so it lies within both budgets; and there is one if either document's
units exceed d. Where a shingle lies in no segment, the argument still holds: the shingles
that a small share of the documents shows to be very frequent (a bounded table, for cost only) lie in none, so
a common passage brings no documents together.
A document whose units do not exceed d (short, or made of frequent shingles) is also indexed with larger
segments, each whole and with any one shingle left out: if twice the segments of two shingles or more
exceed d, one of them differs by one shingle at most. If even these are too few, it goes on with further
partitions until there are enough; a pair is safe as soon as one of its two has enough.

Equal signatures meet in sorted runs; of equal sets one is indexed. A run within one component gives nothing, and neither does one whose documents
all belong to a higher band (guests): a pair of these meets in that band. A run of two documents gives a
pair; in a longer one the documents outside the largest component are paired with the first of it, and the run is kept. Pairs are verified on
whole sets, only between components. For long runs that is: of all documents that met one first document, those outside the largest
component against the others, guests against guests excepted, after a filter by parity sketches (their difference never exceeds d). They are
compared once, on however many signatures they met, by longer sketches that are made for them alone, and in pieces of about PIECE_BYTES,
piece against piece, so no task holds them whole. First each of them is tried with two of those that sketches do not rule out (and each document with
the partner that it met most often), then, with the components that this joins, whatever still lies between components: a family of variants that are not similar to each other costs a comparison of sketches
for each two, and candidates only where sketches cannot tell. No copies are expanded into pairs: equal sets are joined by their hash.

A shingle is named by a 64-bit hash; sets are compared by these.

Defined cases: a null or empty text, or one without words, has no shingles and no links; fewer words
than n are one shingle; each distinct (doc_id, text) is a node of its own: a 64-bit hash, and where a second hash tells that
two of them share it, all but one are renamed by both. link_documents joins the nodes
of a doc_id that is not null: these are one document with several texts, which links if one of them does. Rows
with a null doc_id are joined by their texts only, and their component is null unless a link gives it one. An empty
table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import broadcast_if, cut
from siltbed.llm.components import components
from siltbed.llm.tokens import WordHashes, chunks, heads, run_lengths, runs_of, scramble

SMALL = 2
IDS_TO_BROADCAST = 2_000_000
SIGNATURE_BITS = 56  # of which the lowest 5 are the band's number
CLASSES = 1024
PIECE_BYTES, RUNS_TO_BROADCAST = 1 << 24, 500_000
SHARE, HOT_TIMES, HOT_MOST = 32, 3, 1 << 17  # hotness: counted in 1/32 of the documents, three times, at most so many


def shingle_sets(texts, n: int, hashes: WordHashes):
    """For each text (bytes or None) the sorted distinct 64-bit hashes of its n-word shingles, A-Z in lower case."""
    import numpy as np

    for some in chunks(((t or b"") for t in texts), len):
        words, first = hashes.of([t.lower() for t in some])
        runs = runs_of(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                s = np.sort(runs[a : b - n + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            elif b > a:
                yield scramble(runs_of(words[a:b], b - a) + np.uint64(b - a))
            else:
                yield words[:0]


def _tops() -> list[int]:
    """Largest size in each band; bands grow by 16/9."""
    tops = [3]
    while len(tops) < 32:
        tops.append(tops[-1] * 16 // 9)
    return tops


TOPS = _tops()


def bands_of(n: int):
    """(number of the band, most shingles a partner there differs in) for a set of n: its own and perhaps the one below."""
    from bisect import bisect_left

    band = bisect_left(TOPS, n)
    yield band, (n + n * 4 // 3) // 7
    if band and n <= TOPS[band - 1] * 4 // 3:
        yield band - 1, (n + TOPS[band - 1]) // 7


def _by_segment(hashes, salt: int, segments: int):
    """Shingles in order of segment, the first place and the number of each non-empty segment."""
    import numpy as np

    segment = scramble(hashes + np.uint64(salt)) % np.uint64(segments)
    order = np.argsort(segment.astype(np.uint16) if segments <= 1 << 16 else segment, kind="stable")
    segment = segment[order]
    first = heads(segment)
    return scramble(hashes[order]), first, segment[first]


def segments_of(band: int) -> int:
    return max(2, -(-TOPS[band] * 5 // 11))


def _cold(hashes, hot):
    import numpy as np

    return hashes[hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] != hashes] if len(hot) else hashes


def _segment_signatures(parts, first, salt):
    """Of each segment the whole subset's signature, and those with one shingle left out with their segment's index."""
    import numpy as np

    sums, sizes = np.add.reduceat(parts, first), run_lengths(first, len(parts))
    owner = np.repeat(np.arange(len(first)), sizes)
    several = sizes[owner] > 1
    return scramble(sums + salt), scramble((sums[owner] - parts)[several] + salt[owner[several]]), owner[several]


def signatures(hashes, hot, plan: dict | None = None):
    """Signatures of a set, over its bands and schemes, twice each, and one more where it is a guest. plan: band -> (rank, units) of each class of segments."""
    import numpy as np

    out = []
    mask = np.uint64((1 << SIGNATURE_BITS) - 32)
    cold = _cold(hashes, hot)
    for band, most in bands_of(len(hashes)):
        if not most:
            continue  # only equal sets are similar
        mine, enough = [], False
        if len(cold):
            parts, first, segment = _by_segment(cold, TOPS[band] * 64, segments_of(band))
            whole, without, owner = _segment_signatures(parts, first, scramble(segment + np.uint64(TOPS[band] << 20)))
            kind = (segment % np.uint64(CLASSES)).astype(np.int64)
            rank, units = (plan or {}).get(band, (None, None))
            if rank is None:
                order, mode = np.arange(len(first)), np.ones(len(first), np.int64)
            else:
                order = np.lexsort((segment, rank[kind]))
                mode = np.minimum(units[kind], np.minimum(run_lengths(first, len(parts)), 2))
            enough = mode.sum() > most
            before = np.empty(len(first), np.int64)
            before[order] = np.cumsum(mode[order]) - mode[order]
            taken = before <= most
            mine += [whole[taken], without[(taken & (mode == 2))[owner]]]
        scheme = 1
        while not enough:
            parts, first, segment = _by_segment(hashes, TOPS[band] * 64 + scheme, max(1, TOPS[band] // 4))
            whole, without, _ = _segment_signatures(parts, first, scramble(segment + np.uint64((TOPS[band] << 20) + (scheme << 50))))
            enough = 2 * int((run_lengths(first, len(parts)) >= 2).sum()) > most
            mine += [whole, without]
            scheme += 1
        out.append((((np.concatenate(mine) & mask) | np.uint64(band)) << np.uint64(1)) | np.uint64(len(hashes) > TOPS[band]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def allocate(costs: list, share: int) -> dict:
    """band -> (rank, units) of each class of segments, from a sample of 1/share of the documents.

    costs: (band, class, units, rows, met, pairs, need) by band, class and units: index rows of the sample, (document,
    segment) cases that count for so many units, pairs that meet, and the sum of the budgets of the
    band's sampled documents (the same in all rows of a band).
    """
    import numpy as np

    bands: dict[int, list] = {}
    for row in costs:
        bands.setdefault(row[0], []).append(row[1:])
    plan = {}
    for band, rows in bands.items():
        price, cases = np.full((2, CLASSES), np.inf), np.zeros((2, CLASSES))
        for kind, units, n_rows, met, pairs, _ in rows:
            price[units - 1, kind] = n_rows + share * pairs
            cases[units - 1, kind] = met
        one = price[0] / np.maximum(cases[0], 1)
        more = np.where(cases[1] > 0, (price[1] - np.where(np.isfinite(price[0]), price[0], 0)) / np.maximum(cases[1], 1), np.inf)
        each = np.r_[one, np.maximum(more, one)]  # the second unit of a segment is not taken before its first
        gain = np.r_[cases[0], cases[1]]
        order = np.argsort(each, kind="stable")
        order = order[np.isfinite(each[order])]
        upto = np.cumsum(gain[order])
        chosen = np.zeros(2 * CLASSES, bool)
        chosen[order[upto - gain[order] < 1.25 * rows[0][5]]] = True
        units = np.where(chosen[CLASSES:], 2, 1)
        last = np.where(chosen[:CLASSES], 0, 1)
        rank = np.empty(CLASSES, np.int64)
        rank[np.lexsort((one, last))] = np.arange(CLASSES)
        plan[band] = (rank, units)
    return plan


def sketch(hashes, bits: int) -> bytes:
    """Parities of how many shingles fall on each of `bits` places."""
    import numpy as np

    bits = bits + 7 & ~7
    return np.packbits((np.bincount((scramble(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _verified(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar. pairs is read twice. Sets are made for the documents of pairs only."""

    def read(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets((t.as_py() for t in batch.column(1)), n, hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc", "set"])

    def test(batches):
        """Rows in order of (v, piece, u): first v's own set, with u null, then those of its partners."""
        import numpy as np
        import pyarrow as pa

        now, own = None, None
        for batch in batches:
            good = []
            for v, piece, u, x in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                a = np.frombuffer(x.as_py(), np.uint64)
                if u is None:
                    now, own = (v, piece), a
                    good.append(False)
                    continue
                if now != (v, piece):
                    raise ValueError("a set is missing")
                both = len(np.intersect1d(a, own, assume_unique=True))
                good.append(100 * both >= 75 * (len(a) + len(own) - both))
            yield batch.select([2, 0]).filter(pa.array(good, pa.bool_())).rename_columns(["u", "v"])

    wanted = broadcast_if(cut(pairs.select(F.col("u").alias("doc")).union(pairs.select("v")).distinct(), "wanted"), IDS_TO_BROADCAST)
    sets = rows.select("doc", "text").join(wanted, "doc", "left_semi").mapInArrow(read, "doc long, set binary").dropDuplicates(["doc"])
    dealt = pairs.select("u", "v", F.pmod(F.xxhash64("u"), F.lit(64)).cast("int").alias("piece"))  # a hot v is sent to 64 tasks at most
    partners = dealt.join(sets.withColumnRenamed("doc", "u"), "u").select("v", "piece", "u", "set")
    own = dealt.select("v", "piece").distinct().join(sets.withColumnRenamed("doc", "v"), "v").select("v", "piece", F.lit(None).cast("long").alias("u"), "set")
    return partners.union(own).repartition("v", "piece").sortWithinPartitions("v", "piece", "u").mapInArrow(test, "u long, v long")


def node():
    """The node of a row of docs, but for those that renamed() has."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def second_name():
    return F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), "text")


def renamed(names: DataFrame) -> tuple[DataFrame | None, bool]:
    """(doc, second, own) for nodes that a different (doc_id, text) has too, all but one of each, none if there are no such
    nodes; and whether rows repeat. names: doc, second."""
    shared = names.groupBy("doc").agg(F.min("second").alias("stays"), F.max("second").alias("most"), F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = cut(shared, "shared-names")
    if shared.isEmpty():
        return None, False
    two = shared.where("stays <> most").select("doc", "stays")
    if two.isEmpty():
        return None, True
    own = names.join(two, "doc").where("second <> stays").select("doc", "second", F.xxhash64(F.lit(2), "doc", "second").alias("own")).distinct()
    return cut(own, "renamed"), True


def with_own_names(df: DataFrame, again: DataFrame | None) -> DataFrame:
    """df with the nodes (doc) that renamed() gives; second is dropped."""
    if again is None:
        return df.drop("second")
    return df.join(broadcast_if(again, IDS_TO_BROADCAST), ["doc", "second"], "left").withColumn("doc", F.coalesce("own", "doc")).drop("second", "own")


def _with_roots(linked: DataFrame) -> DataFrame:
    """(node, component), with each component's smallest node too."""
    return linked.union(linked.select("component", "component").distinct())


def _summaries(rows: DataFrame, n: int) -> DataFrame:
    """Of each row: size and name of its set, its least hashes, and a sketch for each band."""

    def summarise(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        quarters = np.arange(4, dtype=np.uint64) << np.uint64(62)
        names = ["doc", "second", "doc_id", "n_shingles", "name1", "name2", "least", "bands", "sketches"]
        types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        for batch in batches:
            out = []
            for doc, second, doc_id, found in zip(*(batch.column(c).to_pylist() for c in range(3)), shingle_sets((t.as_py() for t in batch.column(3)), n, hashes)):
                name1, name2 = (int(scramble(x).sum(dtype=np.uint64).view(np.int64)) for x in (found, found * np.uint64(3)))
                at = np.searchsorted(found, quarters)
                least = found[at[at < np.r_[at[1:], len(found)]]].view(np.int64).tolist()
                bands = [band for band, most in bands_of(len(found)) if most] if len(found) else []
                out.append((doc, second, doc_id, len(found), name1, name2, least if bands else [], bands, [sketch(found, 2 * TOPS[band]) for band in bands]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, types)], names)

    schema = "doc long, second long, doc_id long, n_shingles long, name1 long, name2 long, least array<long>, bands array<long>, sketches array<binary>"
    return rows.select("doc", "second", "doc_id", "text").mapInArrow(summarise, schema)


def _about(summary: DataFrame, name: str, key: str) -> DataFrame:
    return summary.select(F.col("doc").alias(key), F.struct("n_shingles", "name1", "name2", "bands", "sketches").alias(name))


def _not_ruled_out(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """The pairs (u, v, times) that sketches do not rule out and whose sets are not equal."""

    def apart(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                bands = [band for band in a["bands"] if band in b["bands"]]
                if not bands or (a["name1"], a["name2"]) == (b["name1"], b["name2"]):
                    keep.append(False)
                    continue
                x, y = (np.frombuffer(r["sketches"][r["bands"].index(bands[-1])], np.uint8) for r in (a, b))
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= (a["n_shingles"] + b["n_shingles"]) // 7)
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(_about(summary, "au", "u"), "u").join(_about(summary, "av", "v"), "v")
    return met.select("u", "v", "times", "au", "av").mapInArrow(apart, "u long, v long, times long")


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.max(F.struct("times", -F.col("v"))).alias("best")).select("u", (-F.col("best.col2")).alias("v"))


def _first_links(named: DataFrame, summary: DataFrame, rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) of equal sets, and (node, component) from these and the verified links of documents that share a least hash."""
    copied = cut(named.groupBy("name1", "name2").agg(F.min("doc").alias("v"), F.max("doc").alias("most")).where("v <> most").drop("most"), "copied")
    marked = cut(named.select("doc", "name1", "name2", "least").join(copied, ["name1", "name2"], "left").select("doc", "v", "least"), "marked")
    equal = marked.where("doc <> v").select(F.col("doc").alias("u"), "v").distinct()
    least = marked.where("v is null or doc = v").select("doc", F.explode("least").alias("least"))
    runs = cut(least.groupBy("least").agg(F.min("doc").alias("v"), F.max("doc").alias("most")).where("v <> most").drop("most"), "runs-of-least")
    pairs = least.join(runs, "least").where("doc <> v").groupBy(F.col("doc").alias("u"), "v").agg(F.count(F.lit(1)).alias("times"))
    best = cut(_best(_not_ruled_out(cut(pairs, "first-pairs"), summary)), "first-best")
    links = cut(_verified(best, rows, n).union(equal), "first-links")
    return equal, components(links)


def _hot_names(some: DataFrame, n: int) -> list[int]:
    """Hashes of the shingles that most documents of a sample have: a bounded table, for cost only."""

    def frequent(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            found = list(shingle_sets((t.as_py() for t in batch.column(0)), n, hashes))
            if found:
                names, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(times)], ["name", "times"])

    times = some.mapInArrow(frequent, "name long, times long").groupBy("name").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT_TIMES)
    return sorted(r[0] for r in times.orderBy(F.desc("times"), "name").limit(HOT_MOST).select("name").toLocalIterator())


def _plan(some: DataFrame, hot_names: list[int], n: int) -> dict:
    """What allocate() makes of a sample's segments."""

    def weigh(batches):
        """(band, kind, units, sig, cases) of every segment of the sampled documents, and (band, null, ..., budget)."""
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        hot = np.sort(np.array(hot_names, np.int64).view(np.uint64))
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for s in shingle_sets((t.as_py() for t in batch.column(0)), n, hashes):
                cold = _cold(s, hot)
                if not len(cold):
                    continue
                for band, most in bands_of(len(s)):
                    if not most:
                        continue
                    parts, first, segment = _by_segment(cold, TOPS[band] * 64, segments_of(band))
                    whole, without, owner = _segment_signatures(parts, first, scramble(segment))
                    kind = (segment % np.uint64(CLASSES)).astype(np.int32)
                    two = run_lengths(first, len(parts)) > 1
                    for units, sig, of, cases in ((1, whole, kind, np.ones(len(kind), np.int64)), (2, whole[two], kind[two], np.ones(int(two.sum()), np.int64)), (2, without, kind[owner], np.zeros(len(owner), np.int64))):
                        for column, values in zip(columns, (np.full(len(of), band, np.int32), of, np.full(len(of), units, np.int32), sig.view(np.int64), cases)):
                            column.append(values)
                    for column, value in zip(columns, (band, -1, 0, 0, most + 1)):
                        column.append(np.array([value]))
            if columns[0]:
                types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, types)], ["band", "kind", "units", "sig", "cases"])

    weighed = some.mapInArrow(weigh, "band int, kind int, units int, sig long, cases long").groupBy("band", "kind", "units", "sig").agg(F.count(F.lit(1)).alias("rows"), F.sum("cases").alias("cases"))
    weighed = weighed.groupBy("band", "kind", "units").agg(F.sum("rows").alias("rows"), F.sum("cases").alias("cases"), F.sum(F.col("rows") * (F.col("rows") - 1) / 2).alias("pairs")).collect()  # 2 * CLASSES for each band at most
    need = {r.band: r.cases for r in weighed if r.kind < 0}
    return allocate([(r.band, r.kind, r.units, r.rows, r.cases, r.pairs, need[r.band]) for r in weighed if r.kind >= 0], SHARE)


def _met(known: DataFrame, hot_names: list[int], plan: dict, n: int) -> DataFrame:
    """Pairs (0, u, v, 0, guest) and members of longer runs (1, sig, doc, first doc, guest), between components. known: doc, component, text."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        hashes, seen = WordHashes(), set()
        hot = np.sort(np.array(hot_names, np.int64).view(np.uint64))
        for batch in batches:
            columns: list[list] = [[], [], []]
            for doc, of, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets((t.as_py() for t in batch.column(2)), n, hashes)):
                if len(s) and doc not in seen:  # a repeated row
                    seen.add(doc)
                    mine = signatures(s, hot, plan)
                    for column, values in zip(columns, (mine.view(np.int64), np.full(len(mine), doc, np.int64), np.full(len(mine), of, np.int64))):
                        column.append(values)
            if columns[0]:
                whole = [np.concatenate(c) for c in columns]
                for i in range(0, len(whole[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in whole], ["sig", "doc", "component"])

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        told: set = set()

        def out(kind, *columns):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], ["kind", "a", "b", "lead", "guest"])

        def runs(key, doc, of):
            keep = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
            key, doc, of = key[keep], doc[keep], of[keep]
            sig, guest = key >> 1, (key & 1).astype(bool)
            first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[first, len(sig)])
            several = (np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)) & ~np.logical_and.reduceat(guest, first)
            us, vs, member = [], [], []
            for s, m in zip(first[several].tolist(), size[several].tolist()):
                ids, mine, away = doc[s : s + m], of[s : s + m], guest[s : s + m]
                names, at, times = np.unique(mine, return_index=True, return_counts=True)
                lead = int(at[times.argmax()])
                if m > SMALL:
                    member.append((s, m, int(ids[lead])))
                for k in np.flatnonzero((mine != mine[lead]) & ~(away & away[lead])).tolist():
                    p = (int(ids[k]), int(ids[lead]))
                    if p not in told:
                        told.add(p)
                        us.append(p[0])
                        vs.append(p[1])
            if len(told) > 1_000_000:
                told.clear()
            if us:
                yield out(0, us, vs, np.zeros(len(us), np.int64), np.zeros(len(us), bool))
            if member:
                at = np.concatenate([np.arange(s, s + m) for s, m, _ in member])
                yield out(1, sig[at], doc[at], np.repeat([lead for *_, lead in member], [m for _, m, _ in member]), guest[at])

        rest = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.r_[r, batch.column(c).to_numpy()] for c, r in enumerate(rest)]
            last = int(np.searchsorted(rows[0], rows[0][-1] & ~1)) if len(rows[0]) else 0
            rest = [r[last:] for r in rows]
            if last:
                yield from runs(*(r[:last] for r in rows))
        if len(rest[0]):
            yield from runs(*rest)

    signed = known.select("doc", "component", "text").mapInArrow(sign, "sig long, doc long, component long")
    dealt = signed.repartition(F.shiftright("sig", 1)).sortWithinPartitions("sig", "doc")
    return dealt.mapInArrow(meet, "kind int, a long, b long, lead long, guest boolean")


def _across(frame: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """frame with the component of its column `name`: of has the nodes of components but the smallest ones."""
    mine = of.select(F.col("node").alias(name), F.col("component").alias(f"{name}_of"))
    return frame.join(mine, name, "left").withColumn(f"{name}_of", F.coalesce(f"{name}_of", name))


def long_sketch_bits(band: int) -> int:
    return max(2 * TOPS[band], min(16 * TOPS[band], 1 << 15))


def _long_sketches(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc, band, n_shingles, sketch) of the documents in wanted, for each of their bands."""

    def read(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), shingle_sets((t.as_py() for t in batch.column(1)), n, hashes)):
                out += [(doc, band, len(found), sketch(found, long_sketch_bits(band))) for band, most in bands_of(len(found)) if most]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "band", "n_shingles", "sketch"])

    chosen = rows.select("doc", "text").join(broadcast_if(wanted, IDS_TO_BROADCAST), "doc", "left_semi")
    return chosen.mapInArrow(read, "doc long, band long, n_shingles long, sketch binary").dropDuplicates(["doc", "band"])


def _members(met: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lead, band, doc, guest, doc_of) of the documents that met one first document in long runs of a band, on however many signatures; and the runs
    among these that have more than one component."""
    band = F.col("a").bitwiseAND(31).alias("band")
    members = _across(met.where("kind = 1").select("lead", band, F.col("b").alias("doc"), "guest").distinct(), joined, "doc")
    of_run = members.groupBy("lead", "band", "doc_of").agg(F.count(F.lit(1)).alias("n"))
    runs = of_run.groupBy("lead", "band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "doc_of")).alias("most")).where("most.n < n")
    bytes_each = F.array(*[F.lit(long_sketch_bits(b) // 8) for b in range(32)])
    pieces = lambda n: F.ceil(n * F.get(bytes_each, F.col("band").cast("int")) / PIECE_BYTES).cast("int")
    runs = cut(runs.select("lead", "band", F.col("most.doc_of").alias("largest"), pieces(F.col("n")).alias("all_pieces"), pieces(F.col("n") - F.col("most.n")).alias("stray_pieces")), "runs")
    return members.join(broadcast_if(runs, RUNS_TO_BROADCAST), ["lead", "band"]), runs


def _candidates(there: DataFrame, sketches: DataFrame, few: bool) -> DataFrame:
    """(u, v): pairs of documents of different components that met in long runs and that sketches do not rule out.

    few: for each document outside the largest component the nearest one in it and the first one elsewhere, of each piece.
    """

    def compare(batches):
        """Pairs of a piece's documents outside the run's largest component with those of other components."""
        import numpy as np
        import pyarrow as pa

        told: set = set()

        def pairs_of(group):
            bits = np.frombuffer(b"".join(r["sketch"] for r in group), np.uint8).reshape(len(group), -1)
            doc, of, size, largest = (np.array([r[c] for r in group]) for c in ("doc", "doc_of", "n_shingles", "largest"))
            stray, guest = (np.array([r[c] for r in group]) for c in ("stray", "guest"))
            rest = np.flatnonzero(~stray)
            us, vs = [], []
            for i in np.flatnonzero(stray).tolist():
                other = rest[(of[rest] != of[i]) & ~(guest[rest] & guest[i]) & ((of[rest] == largest[i]) | (doc[rest] > doc[i]))]
                apart = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1)
                near = apart <= (size[other] + size[i]) // 7
                other, apart = other[near], apart[near]
                if few and len(other):
                    main = of[other] == largest[i]
                    chosen = [other[main][apart[main].argmin()]] if main.any() else []
                    chosen += [other[~main][doc[other[~main]].argmin()]] if not main.all() else []
                    other = np.array(chosen)
                for j in other.tolist():
                    p = (max(doc[i], doc[j]), min(doc[i], doc[j]))
                    if p not in told:
                        told.add(p)
                        us.append(p[0])
                        vs.append(p[1])
            if len(told) > 1_000_000:
                told.clear()
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        now, group = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["lead"], r["band"], r["i"], r["j"]) != now:
                    if group:
                        yield from pairs_of(group)
                    now, group = (r["lead"], r["band"], r["i"], r["j"]), []
                group.append(r)
        if group:
            yield from pairs_of(group)

    number = lambda n: F.array(F.pmod(F.xxhash64("doc"), n).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    grid = lambda stray, i, j: there.select("lead", "band", "doc", "doc_of", "guest", "largest", F.lit(stray).alias("stray"), F.explode(i).alias("i"), j.alias("js")).withColumn("j", F.explode("js")).drop("js")
    strays = grid(True, number(F.col("stray_pieces")), all_of(F.col("all_pieces"))).where("doc_of <> largest")
    dealt = strays.union(grid(False, all_of(F.col("stray_pieces")), number(F.col("all_pieces"))))
    met_there = dealt.join(sketches, ["doc", "band"]).repartition("lead", "band", "i", "j").sortWithinPartitions("lead", "band", "i", "j")
    return met_there.mapInArrow(compare, "u long, v long")


def link_texts(docs: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc, doc_id, n_shingles, ...) for each row, doc being its node; (node, component) for the nodes that have links; what renamed() gives."""
    rows = docs.select(F.col("doc_id").cast("long"), node().alias("doc"), second_name().alias("second"), F.col("text").cast("binary").alias("text"))
    summary = cut(_summaries(rows, n), "summary")
    again, repeated = renamed(summary.select("doc", "second"))
    summary, rows = with_own_names(summary, again), with_own_names(rows, again)
    sets = cut(summary.dropDuplicates(["doc"]), "sets") if repeated else summary
    equal, joined = _first_links(sets.where("n_shingles > 0"), sets, rows, n)

    known = joined.join(equal.select(F.col("u").alias("node"), F.lit(True).alias("copy")), "node", "left").withColumnRenamed("node", "doc")
    known = rows.select("doc", "text").join(broadcast_if(cut(known, "known"), IDS_TO_BROADCAST), "doc", "left").where("copy is null")
    known = known.select("doc", F.coalesce("component", "doc").alias("component"), "text")
    some = known.where((F.col("doc") == F.col("component")) & (F.pmod(F.xxhash64("doc"), F.lit(SHARE)) == 0))
    some = (some.dropDuplicates(["doc"]) if repeated else some).select("text")
    hot_names = _hot_names(some, n)
    met = cut(_met(known, hot_names, _plan(some, hot_names, n), n), "met")

    pairs = met.where("kind = 0").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("times"))
    pairs = cut(_not_ruled_out(pairs, sets), "pairs")
    both = lambda links: components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links))
    there, runs = _members(met, joined)
    long_runs, some = not runs.isEmpty(), _best(pairs)
    if long_runs:
        sketches = cut(_long_sketches(rows, cut(there.select("doc").distinct(), "compared"), n), "long-sketches")
        some = some.union(_candidates(there, sketches, True)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    more = cut(_verified(cut(some, "some-candidates"), rows, n), "some-links")
    joined = joined if more.isEmpty() else both(more)
    left = _across(_across(pairs.select("u", "v"), joined, "u"), joined, "v").where("u_of <> v_of").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if long_runs:
        left = left.union(_candidates(_members(met, joined)[0], sketches, False))
    left = cut(left.distinct(), "candidates")
    if left.isEmpty():
        return summary, _with_roots(joined), again
    more = cut(_verified(left, rows, n), "last-links")
    return summary, _with_roots(joined if more.isEmpty() else both(more)), again


def link_documents(docs: DataFrame, n: int = 5) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    summary, linked, _ = link_texts(docs, n)
    several = summary.where("doc_id is not null").groupBy("doc_id").agg(F.min("doc").alias("v"), F.max("doc").alias("most")).where("v <> most").select("doc_id", "v")
    several = cut(several, "several")
    if not several.isEmpty():
        same = summary.join(several, "doc_id").where("doc <> v").select(F.col("doc").alias("u"), "v")
        linked = _with_roots(components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).union(same)))
    out = summary.select("doc", "doc_id", "n_shingles").join(linked.withColumnRenamed("node", "doc"), "doc", "left")
    least = broadcast_if(cut(out.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least"), IDS_TO_BROADCAST)
    return out.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))

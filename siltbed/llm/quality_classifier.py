"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are UTF-8 bytes, n of them to an n-gram, so an n-gram is one exact 64-bit number
and no vocabulary has to be built. Counts of trusted text (labels with quality 1, not toxic), the lower orders'
continuation counts, discounts and back-off weights are tables keyed by n-gram, spread over the shuffle's shards.

Documents are scored by blocks of a scan task's texts. Blocks are dealt once and written, with their texts
packed; a block then asks once for each n-gram that it contains. The distinct n-grams of all blocks are
joined with the count tables order by order, from single bytes up, each order interpolating with the one
below; the answers go back by block, and the task that has a block's answers reads its texts. What moves is
thus each block's distinct n-grams; texts lie packed in the shared folder, once, and are not shuffled. As
the deal is read and not made again, executors may come and go between the steps.

Text that repeats itself is cheap under the model, so what is judged is a text's cost: its bits a byte over
the share of its windows of WINDOW bytes that are distinct (1 for a text that never repeats so much).

A language's threshold comes from trusted documents only, so junk cannot move it however much there is:
the trusted texts with a hash of one in HELD_OUT are kept out of the model, and the third quartile of their costs, plus `reach` times its
distance from the median, is the limit. With fewer than FEW of these texts it is not below that of all languages' together. The model cannot judge a
language of which it has seen nothing: one with fewer than LEAST trusted texts in all takes the quantiles of all its own documents, if these
are above the common limit, so that only what stands out in such a language is rejected (and junk that fills more than a quarter of it is
not). A text of m bytes is allowed SHORT / sqrt(m) bits
more, since a short text's mean is noisy; so nothing is rejected for being short.

Defined cases: a null or empty text has no perplexity and is rejected; a null lang is a
language of its own; with fewer than LEAST trusted texts held out nothing is rejected for its perplexity; labels with null or
repeated ids count once; a null doc_id is kept and never trusted; rows equal in doc_id and text get
equal results; an empty table gives no rows; further columns are ignored by classify and returned by
accepted_rows as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.llm.common import broadcast_if, cut, scratch_dir, text_hash
from siltbed.llm.tokens import chunks, scramble

ORDER = 5
BLOCK_BYTES = 32 << 20
SHORT = 8.0
IDS_TO_BROADCAST, LANGUAGES_TO_BROADCAST = 2_000_000, 100_000
HELD_OUT, FEW, LEAST = 4, 50, 8
WINDOW = 16
PACK = "block long, ids array<long>, hashes array<long>, langs array<string>, lengths array<int>, path string"


def ngrams_of(data, n: int):
    """The n-gram that ends at each byte of data, which n - 1 zero bytes precede."""
    import numpy as np

    b = np.frombuffer(bytes(n - 1) + data, np.uint8).astype(np.int64)
    out = np.zeros(len(data), np.int64)
    for k in range(n):
        out = (out << 8) | b[k : k + len(data)]
    return out


def fresh_share(eights) -> float:
    """Share of distinct ones among a text's windows of WINDOW bytes, from the 8-grams that end at its bytes; 1 if it has none."""
    import numpy as np

    windows = np.sort(scramble(eights[WINDOW - 1 :].view(np.uint64)) + eights[WINDOW - 9 : -8].view(np.uint64))
    return (1 + int((windows[1:] != windows[:-1]).sum())) / len(windows) if len(windows) else 1.0


def _blocks(batches, block_bytes: int):
    """Lists of (id, th, lang, text) of block_bytes or more of text, each with its block's number."""
    from pyspark import TaskContext

    number, rows, held = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            text = row[3].as_py() or b""
            rows.append((*row[:3], text))
            held += len(text)
            if held >= block_bytes:
                yield number, rows
                number, rows, held = number + 1, [], 0
    if rows:
        yield number, rows


def trusted_ids(labels: DataFrame) -> DataFrame:
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return broadcast_if(ids, IDS_TO_BROADCAST)


def held_out(th: str, one_in: int):
    """Whether a text, and so all its copies, stays out of the model; one_in = 0: none does."""
    return F.pmod(F.col(th), F.lit(one_in)) == 0 if one_in else F.lit(False)


def trusted_counts(docs: DataFrame, labels: DataFrame, n: int, one_in: int = 0) -> DataFrame:
    """(gram, c): n-gram counts over all trusted documents but those held out."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def table(parts):
            grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)

        parts = []
        for batch in batches:
            for some in chunks((x.as_py() or b"" for x in batch.column(0)), len, 4 << 20):
                parts.append(np.unique(np.concatenate([ngrams_of(text, n) for text in some]), return_counts=True))
            if sum(len(g) for g, _ in parts) > 4_000_000:
                parts = [table(parts)]
                if len(parts[0][0]) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0]), pa.array(parts[0][1])], ["gram", "c"])
                    parts = []
        if parts:
            grams, counts = table(parts)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "c"])

    texts = docs.select("doc_id", text_hash(F.col("text")).alias("th"), F.col("text").cast("binary").alias("text")).where(~held_out("th", one_in)).join(trusted_ids(labels), "doc_id", "left_semi").select("text")
    return texts.mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def probabilities(counts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(gram, logp): base-2 logarithm of the interpolated probability of every wanted n-gram's last byte.

    The tables grow with the text, so none of them is to be broadcast, however small it may be here. Each is written
    once, as it is read three times and the next one comes from it, and so is each order's answer: while a plan runs, the driver plans
    what is left of it anew after every shuffle, so one plan for all orders costs it memory with the square of their number.
    """
    tables = {n: counts}
    for k in range(n - 1, 0, -1):
        tables[k] = cut(tables[k + 1].groupBy((F.col("gram").bitwiseAND((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"counts-{k}")
    few = [t.select(F.lit(k).alias("k"), F.least("c", F.lit(5)).alias("c")) for k, t in tables.items()]
    frequencies = few[0]
    for t in few[1:]:
        frequencies = frequencies.union(t)
    seen = {(r.k, r.c): r["count"] for r in frequencies.groupBy("k", "c").count().collect()}  # 5 * n rows at most
    found = None
    for k in range(1, n + 1):
        n1, n2, n3, n4 = (seen.get((k, c), 0) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        d = [min(max(c - (c + 1) * y * b / a, 0.1), 0.95 * c) if a else 0.5 * c for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        table = tables[k].select("gram", F.col("c").cast("double").alias("c"), discount.alias("d"))
        context = F.shiftrightunsigned("gram", 8)
        contexts = table.groupBy(context.alias("context")).agg(F.sum("c").alias("s"), F.sum("d").alias("left"))
        ask = wanted.select((F.col("gram").bitwiseAND((1 << 8 * k) - 1)).alias("gram")).distinct() if k < n else wanted
        ask = ask.join(table.hint("merge"), "gram", "left").withColumn("context", context).join(contexts.hint("merge"), "context", "left")
        if found is None:
            ask = ask.withColumn("p", F.lit(1 / 256))
        else:
            ask = ask.withColumn("shorter", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(found.hint("merge"), "shorter")
        p = F.when(F.col("s").isNull(), F.col("p")).otherwise(F.coalesce(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("s") + F.col("left") / F.col("s") * F.col("p"))
        found = ask.select(F.col("gram").alias("shorter"), p.alias("p"))
        if k < n:
            found = cut(found, f"found-{k}")
    return found.select(F.col("shorter").alias("gram"), F.log2("p").cast("float").alias("logp"))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs dealt to blocks: block, ids, hashes, langs, lengths, and the path of the block's texts, compressed together.

    Files have names of their own, so an attempt that is repeated leaves the ones of the first alone.
    """
    folder = f"{scratch_dir(docs.sparkSession)}/texts-{uuid.uuid4().hex}"

    def pack(batches):
        import pyarrow as pa
        import zstandard
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        z = zstandard.ZstdCompressor(level=3)
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string()]
        for number, rows in _blocks(batches, block_bytes):
            ids, hashes, langs, texts = zip(*rows)
            name = f"{uuid.uuid4().hex}.pack"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(z.compress(b"".join(texts)))
            row = [[number], [ids], [hashes], [langs], [[len(x) for x in texts]], [f"{folder}/{name}"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], ["block", "ids", "hashes", "langs", "lengths", "path"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(pack, PACK)


def _texts(path: str) -> bytes:
    import zstandard
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        return zstandard.ZstdDecompressor().decompressobj().decompress(f.read())


def block_grams(packed: DataFrame, n: int) -> DataFrame:
    """(block, gram): the distinct n-grams of each block."""

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number, lengths, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ends = np.cumsum(lengths.values.to_numpy())
                data, grams, at = _texts(path), np.empty(0, np.int64), 0
                for some in _slices(ends, 4 << 20):
                    found = np.concatenate([ngrams_of(data[a:b], n) for a, b in zip(np.r_[at, some[:-1]].tolist(), some.tolist())])
                    at = int(some[-1])
                    grams = np.union1d(grams, np.unique(found))
                for i in range(0, len(grams), 100_000):
                    part = grams[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int64)), pa.array(part)], ["block", "gram"])

    return packed.select("block", "lengths", "path").mapInArrow(ask, "block long, gram long")


def _slices(ends, most: int):
    """Parts of a sorted array of places that each span about `most`."""
    import numpy as np

    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield ends[at:to]
        at = to


def log_perplexities(docs: DataFrame, labels: DataFrame, n: int = ORDER, block_bytes: int = BLOCK_BYTES, one_in: int = 0) -> DataFrame:
    """(doc_id, th, lang, n_bytes, bits, fresh): bits a byte under the trusted model, and fresh_share; null for empty texts."""

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                ids, hashes, langs, lengths = (batch.column(c)[k].values for c in range(4))
                data = _texts(batch.column(4)[k].as_py())
                grams, logp = (batch.column(c)[k].values for c in (5, 6))
                grams, logp = (x.to_numpy() if x is not None else np.empty(0, np.int64) for x in (grams, logp))
                order = np.argsort(grams)
                grams, logp = grams[order], logp[order].astype(float)
                at, bits, fresh = 0, [], []
                for m in lengths.to_pylist():
                    if not m:
                        bits.append(None)
                        fresh.append(None)
                        continue
                    mine = ngrams_of(data[at : at + m], n)
                    bits.append(-float(logp[np.searchsorted(grams, mine)].mean()))
                    fresh.append(fresh_share(ngrams_of(data[at : at + m], 8)))
                    at += m
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), hashes, langs, lengths.cast(pa.int64()), pa.array(bits, pa.float64()), pa.array(fresh, pa.float64())], ["doc_id", "th", "lang", "n_bytes", "bits", "fresh"])

    packed = cut(blocks(docs, block_bytes), "blocks")
    counts = cut(trusted_counts(docs, labels, n, one_in), "counts")
    asked = cut(block_grams(packed, n), "asked")
    known = probabilities(counts, asked.select("gram").distinct(), n)
    answers = asked.join(known.hint("merge"), "gram").groupBy("block").agg(F.collect_list("gram").alias("grams"), F.collect_list("logp").alias("logps"))
    met = packed.join(answers.hint("merge"), "block", "left").select("ids", "hashes", "langs", "lengths", "path", "grams", "logps")
    return met.mapInArrow(score, "doc_id long, th long, lang string, n_bytes long, bits double, fresh double")


def language():
    """The name of a row's language, which differs for null and any text."""
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("language")


def thresholds(scores: DataFrame, reach: float) -> DataFrame:
    """(language, most, texts): the cost that a document of the language may have, and of how many texts; language null: of all languages together.

    scores are those of the trusted texts held out, or of all texts; copies of a text count once.
    Quantiles are exact on a grid of 1/1000 bit: the grid points of a language are few whatever the input.
    """
    one = scores.where("bits is not null").select(language(), "th", F.round(F.col("bits") / F.col("fresh") * 1000).cast("long").alias("g")).distinct()
    grid = one.groupBy("language", "g").agg(F.count(F.lit(1)).alias("n"))
    grid = grid.union(grid.groupBy(F.lit(None).cast("string").alias("language"), "g").agg(F.sum("n").alias("n")))
    all_of = W.partitionBy("language")
    run = grid.select("language", "g", F.sum("n").over(all_of.orderBy("g")).alias("upto"), F.sum("n").over(all_of).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("g")))
    q = run.groupBy("language").agg(at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("total").alias("total"))
    return q.select("language", ((F.col("q3") + reach * (F.col("q3") - F.col("q2")) + 50) / 1000).alias("most"), F.col("total").alias("texts"))


def _limits(scores: DataFrame, labels: DataFrame, reach: float) -> tuple[DataFrame, float | None]:
    """(language, own) for every language that has a limit of its own, and the limit of all others; none if too few trusted texts are held out."""
    scores = scores.where("bits is not null")
    trusted = cut(scores.join(trusted_ids(labels), "doc_id", "left_semi").select("lang", language(), "th", "bits", "fresh"), "trusted")
    limits = cut(thresholds(trusted.where(held_out("th", HELD_OUT)), reach), "limits")
    common = limits.where("language is null").first()
    if not common or common.texts < LEAST:
        return limits.where("false").select("language", F.col("most").alias("own")), None
    seen = trusted.select("language", "th").distinct().groupBy("language").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("language")
    seen = broadcast_if(cut(seen, "seen"), LANGUAGES_TO_BROADCAST)
    least = F.lit(common.most)
    own = F.when(F.col("texts") >= FEW, F.col("most")).otherwise(F.greatest("most", least))
    known = seen.join(limits, "language", "left").select("language", F.coalesce(own, least).alias("own"))
    rest = thresholds(scores.select("*", language()).join(seen, "language", "left_anti").drop("language"), reach)
    rest = rest.where("language is not null").select("language", F.greatest("most", least))
    return cut(known.union(rest), "own-limits"), common.most


def classify(docs: DataFrame, labels: DataFrame, reach: float = 6.0, n: int = ORDER) -> DataFrame:
    """A row for each document: doc_id, th (hash of its text), lang, n_bytes, perplexity (a byte), distinct_share, threshold, kept.

    The threshold is the perplexity that the document may have, given how much of it repeats: the limit of its language times
    distinct_share, the share of its windows that are distinct.
    """
    scores = cut(log_perplexities(docs, labels, n, one_in=HELD_OUT), "scores")
    own, common = _limits(scores, labels, reach)
    out = scores.withColumn("language", language()).join(broadcast_if(own, LANGUAGES_TO_BROADCAST), "language", "left")
    most = F.coalesce("own", F.lit(common).cast("double"))
    most = (most + SHORT / F.sqrt("n_bytes")) * F.col("fresh")
    kept = F.col("bits").isNotNull() & F.coalesce(F.col("bits") <= most, F.lit(True))
    power = lambda c: F.round(F.pow(F.lit(2.0), c), 6)
    return out.select("doc_id", "th", "lang", "n_bytes", power("bits").alias("perplexity"), F.round("fresh", 6).alias("distinct_share"), power(F.when(F.col("n_bytes") > 0, most)).alias("threshold"), kept.alias("kept"))


def accepted_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns as they were."""
    good = classify(docs, labels, **options).where("kept").select(F.col("doc_id").alias("good_id"), F.col("th").alias("good_th")).distinct().hint("shuffle_hash")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text")).alias("th"))
    return d.join(good, F.col("id").eqNullSafe(F.col("good_id")) & (F.col("th") == F.col("good_th")), "left_semi").select("row.*")

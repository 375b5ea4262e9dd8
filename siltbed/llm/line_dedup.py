"""Line dedup by winnowing over line hashes. DataFrame functions only.

The non-blank lines of a document are hashed; every window of `lines` consecutive lines selects its
least hash (the last one on a tie) as a fingerprint, and a line of `words` words or more is one by
itself. A repeated run of `lines` lines thus shares a selected fingerprint wherever it stands. Positions
of fingerprints that occur once are dropped; around the others the match is extended both ways, to every
window of `lines` lines that contains the position. Of each such window (or long line) the earliest
occurrence, by (doc_id, position), stays; the lines that later ones cover are deleted.

Windows are told apart by two 64-bit hashes of their lines, each from another hash of every line; a fingerprint, which only
brings windows together, is one. So a line goes exactly if it is part of a run of `lines` consecutive non-blank lines, or is a line of
`words` words, that also occurs at an earlier place. Each key is reduced to its earliest place before
it is joined, so a line in every document costs rows in proportion to its occurrences, never pairs. Both
reductions are map-side combined and written; each is then one side of a plain join whose other side are
the occurrences: broadcast if it is small by count, and otherwise, where one line has very many, adaptive execution deals these to several
tasks. Texts move only if the lines that go are too many to be sent to the scan.

Defined cases: a null text stays null with no lines; blank lines stay; documents with fewer lines than
a window lose long lines only; a text may become empty, its row stays; a null doc_id ranks first; rows
equal in doc_id and text are one place and give equal results; an empty table gives no rows. Further
columns are returned as they are in the struct `row`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import WORD, broadcast_if, count_words, cut, text_hash

#: Sides up to so many rows, by count, are broadcast: fingerprints, first places of windows, and lines that go.
FINGERPRINTS_TO_BROADCAST, PLACES_TO_BROADCAST, LINES_TO_BROADCAST = 2_000_000, 500_000, 1_000_000


def line_hash(line):
    return F.xxhash64(line)


def _fingerprints(docs: DataFrame, lines: int, words: int) -> DataFrame:
    """(id, th, fp, spans): every selected line's hash, with the windows around it (start s, hashes wh and wh2, line indexes at)."""
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    d = docs.select("id", "th", F.filter(numbered, lambda x: x["line"].rlike(WORD)).alias("found"))
    d = d.select(
        "id",
        "th",
        F.transform("found", lambda x: x["at"]).alias("at"),
        F.transform("found", lambda x: line_hash(x["line"])).alias("h"),
        F.transform("found", lambda x: F.xxhash64(F.lit(1), x["line"])).alias("h2"),
        F.transform("found", lambda x: count_words(x["line"]) >= words).alias("long"),
    )
    last = F.size("h") - lines  # of the windows' starts
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    least = lambda s: F.least(*[F.struct(F.get("h", s + k).alias("x"), (-(s + k)).alias("p")) for k in range(lines)])
    alone = F.filter(F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0))), lambda i: F.coalesce(F.get("long", i), F.lit(False)))
    d = d.withColumn("chosen", F.array_distinct(F.concat(F.transform(starts, lambda s: -least(s)["p"]), alone)))
    name = lambda h, s, n: F.xxhash64(F.lit(n), *[F.get(h, s + k) for k in range(n)])
    span = lambda s, n: F.struct(s.alias("s"), name("h", s, n).alias("wh"), name("h2", s, n).alias("wh2"), F.array(*[F.get("at", s + k) for k in range(n)]).alias("at"))
    none = F.array().cast("array<struct<s:int,wh:bigint,wh2:bigint,at:array<int>>>")

    def around(p):
        low, high = F.greatest(p - lines + 1, F.lit(0)), F.least(p, last)
        return F.concat(F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda s: span(s, lines))).otherwise(none), F.when(F.get("long", p), F.array(span(p, 1))).otherwise(none))

    # explode_outer: the filter that Spark infers from explode would compute every array once more
    rows = d.select("id", "th", F.explode_outer(F.transform("chosen", lambda p: F.struct(F.get("h", p).alias("fp"), around(p).alias("spans")))).alias("x"))
    return rows.where("x is not null").select("id", "th", "x.fp", "x.spans")


def deleted_lines(docs: DataFrame, lines: int = 3, words: int = 25) -> DataFrame:
    """(id, th, gone): indexes of the \\n-split lines that go, for documents that lose any. docs: id, th, text."""
    fps = cut(_fingerprints(docs, lines, words), "fingerprints")
    shared = cut(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("fp"), "shared")
    spans = fps.join(broadcast_if(shared, FINGERPRINTS_TO_BROADCAST), "fp").select("id", "th", F.explode("spans").alias("w")).select("id", "th", "w.s", "w.wh", "w.wh2", "w.at")
    place = F.struct("id", "th", "s")
    first = cut(spans.groupBy("wh", "wh2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("wh", "wh2", "first"), "first")
    later = spans.join(broadcast_if(first, PLACES_TO_BROADCAST), ["wh", "wh2"]).where(place > F.col("first"))
    return later.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def dedup_lines(docs: DataFrame, lines: int = 3, words: int = 25) -> DataFrame:
    """A row for each row of docs: row (its columns as they were), text (what stays), n_lines, n_removed."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("th"), F.col("text").alias("text"))
    gone = cut(deleted_lines(d, lines, words).withColumnRenamed("id", "gone_id").withColumnRenamed("th", "gone_th"), "gone")
    n_gone = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    gone = F.broadcast(gone) if n_gone <= LINES_TO_BROADCAST else gone.hint("shuffle_hash")
    met = d.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    parts = met.select("row", "text", "gone", F.split("text", "\n").alias("parts"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    return parts.select("row", text.alias("text"), F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def dedup_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with text replaced by what stays, n_chars (where there is one) following it."""
    out = dedup_lines(docs, **options)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])

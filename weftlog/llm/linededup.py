"""Line dedup over content-defined chunks, in DataFrame functions alone.

A document is its lines. A chunk ends after a line where a rolling hash over the hashes of that line and the ones before
it hits a residue, and nothing else ends one. By default every hash hits (DIVISOR is 1), as with fewer boundaries a
passage of few lines often has no whole chunk between two of them (the README has the share found by divisor). Chunks are grouped by hash and bytes over the whole corpus, and chunks of one text share a digest.

What goes is a run of neighbouring chunks, LEAST words long, that stands elsewhere before as a whole: from each chunk on,
and up to each chunk, the shortest run with so many words is looked up by its chunks' digests. These runs overlap, so
they cover a repeated passage from its first to its last line whatever stands around it, and short lines that many
documents share, such as a licence line, stay. Of the places of a run the first (by document id, then position) stays.
Blank chunks are passed over; those inside a run go with it.

Grouping is by partial aggregation, so a chunk that stands in a third of all documents is one row from each task. Only
places come back to the documents, and runs are made of repeated chunks only. The places of the HOT most frequent chunks
and runs are salted where they meet their group, so none of them is one task's.

Defined cases: null text stays null, empty text empty; ids are of any type that has an order (numbers by size, strings by
code points); rows that share an id are one document, whose places are no
repeats of each other; a null id is one id, the least; a line break at the end of a text is a last empty line; copies
that overlap each other (a short line repeated many times) count as copies; documents of which nothing is left get empty
text (see dedup_lines' emptied); no rows give no rows. Output columns replace those of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import let, release, settle

#: Lines in the rolling window, average lines between hits, words that a repeated run has to have.
WINDOW, DIVISOR, LEAST = 2, 1, 20
#: Most frequent chunks (and runs) that are salted, and places of one for a salt; there are no more salts than tasks.
HOT, HOT_PLACES = 1000, 500
#: Chunks to remove, and documents that have some, up to which they are broadcast to the documents (under 32 MB).
FEW_CHUNKS, FEW_DOCS = 2_000_000, 200_000
_LOW = 0xFFFFFF
#: Chunks that a document has room for where its id and a chunk's number are one number.
PLACES = 1_000_000_000


#: A word, and characters of scripts that do not part words: two of them count as a word more.
_WORD, _UNPARTED = r"[^\x20\x09-\x0D]+", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def word_count(text: Column) -> Column:
    """Words as the other operators part them, and more where a script does not part them."""
    return (F.regexp_count(text, F.lit(_WORD)) + F.floor(F.regexp_count(text, F.lit(_UNPARTED)) / 2)).cast("int")


def rolling(hashes: Column, i: Column, window: int) -> Column:
    """Polynomial hash of the line hashes that end at i (from 0)."""
    total = F.lit(0).cast("long")
    for k in range(window):
        own = F.when(i - k >= 0, F.element_at(hashes, F.greatest(i - k + 1, F.lit(1)))).otherwise(F.lit(0).cast("long"))
        total = total * 31 + own.bitwiseAND(F.lit(_LOW))
    return total


def chunk_texts(text: Column, window: int, divisor: int) -> Column:
    """The text of each chunk, in order; null of null."""
    if divisor == 1:  # every hash hits
        return F.split(text, "\n", -1)

    def piece(lines: Column, ends: Column, end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))) + 1)
        return F.array_join(F.slice(lines, start + 1, end - start + 1), "\n")

    def of(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.xxhash64(x))
        hits = lambda known, i: (i == F.size(lines) - 1) | (F.pmod(rolling(known, i, window), F.lit(divisor)) == 0)
        ends = let(hashes, lambda known: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: hits(known, i)))
        return let(ends, lambda ends: F.transform(ends, lambda end, k: piece(lines, ends, end, k)))

    return F.when(text.isNotNull(), let(F.split(text, "\n", -1), of))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """docs with the text that stays in text_col, n_lines, n_removed (lines) and emptied (had words, and none is left)."""
    new = ("n_lines", "n_removed", "emptied")
    source = docs.select(*[c for c in docs.columns if c not in new or c in (id_col, text_col)])
    own = source.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    place = _place(isinstance(docs.schema[id_col].dataType, T.IntegralType))
    pieces = F.filter(F.transform(chunk_texts(F.col("_text"), window, divisor), lambda p, k: F.struct(k.alias("k"), p.alias("piece"))), lambda c: c["piece"].rlike(_WORD))
    chunks = own.select("_id", "_key", F.posexplode(pieces).alias("o", "c")).select("_id", "_key", "o", "c.k", "c.piece").withColumn("hash", F.xxhash64("piece"))
    groups = chunks.withColumn("place", place(F.col("k"))).groupBy("hash", "piece").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    groups = settle(groups.select("hash", F.sha2("piece", 256).alias("sha"), word_count(F.col("piece")).alias("words"), "first", "n"), "chunks")
    placed = chunks.select("_id", "_key", "o", "k", "hash", F.sha2("piece", 256).alias("sha"))
    mark = F.struct("o", "k", "words", "sha", (place(F.col("k")) != F.col("first")).alias("hit"))
    marks = settle(_met(placed, groups, ["hash", "sha"], "k").groupBy("_id", "_key").agg(F.array_sort(F.collect_set(mark)).alias("marks")), "marks")
    release(groups)
    runs = marks.select("_id", "_key", F.explode(_runs(F.col("marks"), least)).alias("r")).select("_id", "_key", "r.*").withColumn("place", place(F.col("a")))
    first = settle(runs.groupBy("run").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1"), "runs")
    again = _met(runs, first, ["run"], "a").where("place <> first").select("_id", "_key", F.sequence("a", "b").alias("ks"))
    alone = F.transform(F.filter("marks", lambda m: m["hit"] & (m["words"] >= least)), lambda m: m["k"])
    gone = again.unionByName(marks.select("_id", "_key", alone.alias("ks")).where(F.size("ks") > 0))
    gone = settle(gone.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_list("ks"))).alias("marks")), "gone")
    release(marks, first)
    size = gone.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("marks")), F.lit(0)).alias("chunks")).first()
    few = size["docs"] <= FEW_DOCS and size["chunks"] <= FEW_CHUNKS
    keyed = source.withColumn("_key", F.xxhash64(text_col))
    both = keyed.join(F.broadcast(gone) if few else gone, keyed[id_col].eqNullSafe(gone["_id"]) & (keyed["_key"] == gone["_key"]), "left").select(keyed["*"], gone["marks"])
    return _without_runs(both, text_col, window, divisor).select(*[c for c in source.columns], *new)


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows and what groups (n: their rows) says of them: a join on keys, where the rows of the most frequent groups are
    dealt over several tasks by _id and spread."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = groups.orderBy(F.desc("n"), *keys).limit(HOT).select(*keys, F.least(F.ceil(F.col("n") / HOT_PLACES), F.lit(most)).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = groups.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "n")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64("_id", spread), parts.cast("long")).cast("int")).drop("parts")
    return salted.join(dealt, [*keys, "salt"]).drop("salt")


def _place(integral: bool) -> Callable[[Column], Column]:
    """Where a chunk with number k is: a number for ids that are whole numbers, which aggregates in place, else a struct."""
    if not integral:
        return lambda k: F.struct(F.col("_id"), k.alias("k"))
    return lambda k: (F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(PLACES) + k).cast("decimal(38,0)")


def _runs(marks: Column, least: int) -> Column:
    """a, b (first and last chunk) and run (its digest) of the shortest runs of several marked chunks that have enough
    words: one from each chunk on, and one up to each."""

    def reach(around: Column, m: Column) -> Column:
        """How many of the chunks around, which begin with m and go away from it, make a run, and their words."""

        def step(sofar: Column, c: Column) -> Column:
            more = (sofar["words"] < least) & (F.abs(c["o"] - m["o"]) == sofar["n"])
            return F.when(more, F.struct((sofar["n"] + 1).alias("n"), (sofar["words"] + c["words"]).alias("words"))).otherwise(sofar)

        return F.aggregate(around, F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")), step)

    def run(own: Column, start: Column, n: Column) -> Column:
        of = F.slice(own, start, n)
        digest = F.sha2(F.array_join(F.transform(of, lambda m: m["sha"]), ""), 256)
        return F.struct(F.element_at(of, 1)["k"].alias("a"), F.element_at(of, -1)["k"].alias("b"), digest.alias("run"))

    def found(own: Column, m: Column, i: Column) -> Column:
        low = F.greatest(i - least + 2, F.lit(1))
        ahead, back = reach(F.slice(own, i + 1, F.lit(least)), m), reach(F.reverse(F.slice(own, low, i + 2 - low)), m)
        of = lambda r, start: let(r, lambda r: F.when((r["words"] >= least) & (r["n"] > 1), run(own, start(r["n"]), r["n"])))
        return F.when(m["words"] < least, F.array(of(ahead, lambda n: i + 1), of(back, lambda n: i + 2 - n)))

    every = let(marks, lambda own: F.flatten(F.filter(F.transform(own, lambda m, i: found(own, m, i)), lambda x: x.isNotNull())))
    return F.array_distinct(F.filter(every, lambda r: r.isNotNull()))


def _without_runs(both: DataFrame, text_col: str, window: int, divisor: int) -> DataFrame:
    """Take out the marked chunks; texts without marks pass as they are."""
    text, marks = F.col(text_col), F.col("marks")
    done = let(chunk_texts(text, window, divisor), lambda own: let(marks, lambda gone: _parted(own, gone)))
    own = both.withColumn("_done", F.when(marks.isNotNull(), done))
    lines = F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(breaks(text) + 1).cast("long")
    own = own.withColumn("n_lines", lines).withColumn("n_removed", F.coalesce("_done.lost", F.lit(0)).cast("long"))
    kept = F.when(F.col("_done").isNotNull(), F.col("_done.kept")).otherwise(text)
    return own.withColumn("emptied", F.coalesce((F.col("n_removed") > 0) & ~kept.rlike(_WORD), F.lit(False))).withColumn(text_col, kept)


def breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _parted(chunks: Column, gone: Column) -> Column:
    """The text that stays, and the lines that go."""
    kept = F.array_join(F.filter(chunks, lambda c, k: ~F.array_contains(gone, k)), "\n")
    lost = F.aggregate(F.filter(chunks, lambda c, k: F.array_contains(gone, k)), F.lit(0).cast("long"), lambda a, c: a + breaks(c) + 1)
    return F.struct(kept.alias("kept"), lost.alias("lost"))

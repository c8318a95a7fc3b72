"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is its set of distinct shingles as 64-bit hashes; texts with equal sets (by a 128-bit digest) are one class, so
copies never pair up. All classes order their shingles by one order: estimated frequency, rarest first, then hash.
Frequencies are counts of all documents' shingles in hashed cells, as many as the corpus asks for up to MOST_CELLS, added
up in two rounds of as many tasks as there are rows of cells. Two sets with Jaccard similarity t or more share at
least m of the first n - ceil(t * n) + m shingles of each, for any m. Each class picks its own m: a longer prefix costs
its postings, and asking for m shared shingles leaves fewer candidates to verify; the m with the least estimated cost
is taken. A pair has to share min(m, m') shingles of the prefixes for that number.

Links are only needed as far as they join classes, so no group of near copies is expanded into all its pairs. First each
class is verified against one member of its posting lists, the hub that most of them have in common. Then lists are cut
by the sets' sizes, as sets that link are in the same or the next step of sizes, and only those with members in different
components are left. Short ones give their cross-component pairs, of which those with enough shared shingles are
verified; long ones, of equal lists but one, are cut into blocks, and each pair of blocks is verified in one task that
emits no more than one link for each member. All pairs with enough similarity in different components are met in one of these ways, so components
are exact. Components come from repeated minimum labels with shortcuts, as tables; none is collected.

Defined cases: null or wordless text: no shingles, linked with nothing, component its own id; fewer words than a shingle:
the whole sequence is the one shingle; rows that repeat, with one id or several, are one class; a null id stays null and
does not lend its class an id unless all are null. Shingles are told apart by 64-bit hashes, classes by 128 bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_columns, bound_batches, release, settle, utf8

#: Hashed cells for frequencies, at least and at most (powers of 2), bytes of input for one, cells in a row that is sent,
#: and tasks among which the first round of adding up splits a row.
LEAST_CELLS, MOST_CELLS, CELL_BYTES, ROW_CELLS, ROUNDS = 1 << 16, 1 << 20, 128, 1 << 12, 64
#: Largest m of a prefix; members up to which a list gives pairs; shingles in a block of a longer one.
MOST_SHARED, SHORT, BLOCK_SHINGLES = 8, 32, 1 << 20
#: Members of a hub in one task; rows of pairs or ids up to which they are broadcast (24 bytes each), beyond which they
#: are joined by a shuffle.
MEMBERS, FEW = 2000, 400_000
#: Costs of a posting and of verifying a pair; partners that a shingle has by chance.
POSTING, VERIFY, CHANCE = 0.5, 8.0, 0.5

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1 << 12)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word: blanks part words, A-Z are lower-cased."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = ~_BLANK[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not start.size:
        return np.empty(0, np.uint64)
    ink = _INK[data[inside]]
    lengths = end - start
    first = np.cumsum(lengths) - lengths
    place = np.arange(ink.size) - np.repeat(first, lengths)
    ink = ink * _POWERS[place % len(_POWERS)]
    if lengths.max() > len(_POWERS):  # in longer words powers repeat, each time with another odd factor
        ink *= (2 * (place // len(_POWERS)) + 1).astype(np.uint64)
    return _mixed(np.add.reduceat(ink, first) + lengths.astype(np.uint64))


def all_shingles(raw: bytes, width: int) -> np.ndarray:
    """Shingle hashes of a text, repeats too."""
    words = word_hashes(raw)
    if not words.size:
        return words
    if words.size < width:
        width = words.size
    out = np.zeros(words.size - width + 1, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(31) + words[k : k + len(out)])
    return _mixed(out + np.uint64(width))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    return np.unique(all_shingles(raw, width))


def digest_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set that it links with: ceil(n * t)."""
    return -(-n * percent // 100)


def cell_of(own: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How often the cell of each shingle was met."""
    return cells[(own & np.uint64(len(cells) - 1)).astype(np.int64)]


def rarest(own: np.ndarray, cells: np.ndarray, k: int) -> np.ndarray:
    """The first k of own in the common order: by cell, then by hash."""
    met = cell_of(own, cells)
    if k < len(own):
        near = met <= np.partition(met, k - 1)[k - 1]
        own, met = own[near], met[near]
    return own[np.lexsort((own, met))][:k]


def adaptive_prefix(own: np.ndarray, cells: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int, int]:
    """Prefix, length of the shortest prefix (m = 1), and the m that is asked for: that of the least estimated cost, of
    postings and of candidates, which fall with the factorial of m as shared shingles are mostly by chance."""
    n = len(own)
    base = n - least_shared(n, percent) + 1
    in_order = rarest(own, cells, base + MOST_SHARED - 1)
    total = np.cumsum(np.maximum(CHANCE, cell_of(in_order, cells) - noise))
    costs = [POSTING * (base + m - 1) + VERIFY * total[base + m - 2] / math.factorial(m) for m in range(1, MOST_SHARED + 1) if base + m - 1 <= n]
    m = int(np.argmin(costs)) + 1
    return in_order[: base + m - 1], base, m


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def cell_count(docs: DataFrame) -> int:
    """Cells for a corpus, by the optimizer's estimate of its bytes. Any number gives the same result."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // CELL_BYTES).bit_length()))


def frequency_cells(docs: DataFrame, width: int) -> np.ndarray:
    """How often shingles of each cell stand in all documents. A task sends one number for each cell, in as few bytes as
    they take; rows of cells are added up in two rounds, first of some tasks' each, then of all."""
    n = cell_count(docs)
    rows = n // ROW_CELLS

    def sent(keys: list, parts: list, sums: list[np.ndarray]) -> pa.RecordBatch:
        small = [x.astype(np.min_scalar_type(int(x.max()))) for x in sums]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(parts, pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())], names=["row", "part", "counts"])

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.dtype(f"u{len(raw) // ROW_CELLS}")).astype(np.int64)

    def run(batches):
        cells = np.zeros(n, np.int64)
        for b in batches:
            found = [all_shingles(raw, width) for raw in utf8(b.column(0))]
            cells += np.bincount((np.concatenate(found or [np.empty(0, np.uint64)]) & np.uint64(n - 1)).astype(np.int64), minlength=n)
        yield sent(list(range(rows)), [TaskContext.get().partitionId() % ROUNDS] * rows, list(cells.reshape(rows, -1)))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[k] = sums[k] + read(x) if k in sums else read(x)
        if sums:
            yield sent(list(sums), [0] * len(sums), list(sums.values()))

    kind = "row int, part int, counts binary"
    out = np.zeros((rows, ROW_CELLS), np.int64)
    for r in docs.select("text").mapInArrow(run, kind).repartition("row", "part").mapInArrow(add, kind).repartition("row").mapInArrow(add, kind).toLocalIterator():
        out[r["row"]] += read(r["counts"])
    return out.ravel()


_SIGNED = [T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("base", T.IntegerType()), T.StructField("m", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))]


def signatures(docs: DataFrame, cells: np.ndarray, width: int, percent: int) -> DataFrame:
    """id, row (a number of its own), n, digest, base, m, prefix of each row of id, text."""
    shipped = docs.sparkSession.sparkContext.broadcast(cells)
    noise = float(np.median(cells)) + 2 * float(np.median(cells)) ** 0.5

    def make():
        cells = shipped.value

        def compute(batch):
            rows = []
            for raw in utf8(batch.column("text")):
                own = shingles(raw, width)
                if len(own):
                    prefix, base, m = adaptive_prefix(own, cells, noise, percent)
                    rows.append((len(own), digest_of(own), base, m, prefix.view(np.int64)))
                else:
                    rows.append((0, b"", 0, 0, np.empty(0, np.int64)))
            return [[r[k] for r in rows] for k in range(5)]

        return compute

    return append_columns(docs.withColumn("row", F.monotonically_increasing_id()), _SIGNED, make).drop("text")


def _pair_rows(batch: pa.RecordBatch, width: int, percent: int) -> list[bool]:
    sets: dict[int, np.ndarray] = {}

    def of(key: int, raw: bytes) -> np.ndarray:
        if key not in sets:
            sets[key] = shingles(raw, width)
        return sets[key]

    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    return [similar(of(x, p), of(y, q), percent) for x, y, p, q in zip(a, b, utf8(batch.column("text_a")), utf8(batch.column("text_b")), strict=True)]


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b: classes; a table) whose texts are similar enough. Up to FEW pairs go to the texts, more
    are joined with them."""
    few = pairs.count() <= FEW
    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    if few:
        two = two.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    both = one.join(F.broadcast(pairs) if few else pairs, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    checked = append_columns(both, [T.StructField("ok", T.BooleanType())], lambda: lambda batch: [_pair_rows(batch, width, percent)])
    return checked.where("ok").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """class and component (least class that links reach) for each class that has a link. Each round every class takes
    the least label of its neighbours and of the class its label names, until none changes."""
    edges = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    first = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("class"), "label", F.lit(True).alias("moved"))
    held = settle(first, "labels")
    while True:
        labels = held.select("class", "label")
        near = edges.join(labels, edges["b"] == labels["class"]).groupBy(edges["a"].alias("class")).agg(F.min("label").alias("near"))
        named = labels.select(F.col("class").alias("label"), F.col("label").alias("far"))
        after = labels.join(near, "class").join(named, "label", "left").select("class", F.least("label", "near", "far").alias("label"), (F.least("label", "near", "far") < F.col("label")).alias("moved"))
        before, held = held, settle(after, "labels")
        release(before)
        if not held.where("moved").limit(1).count():
            release(edges)
            return held.select("class", F.col("label").alias("component"))


def _spanning(batches, width: int, percent: int):
    """For each block pair of a posting list: verify its cross-component pairs, and emit a link for each union made.
    Members of the largest component are only met by the others."""
    for _, rows in _groups(batches):
        classes, comps, sides, guests = (np.array(x) for x in zip(*[r[:4] for r in rows], strict=True))
        sets = [shingles(r[4], width) for r in rows]
        size = np.array([len(x) for x in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        names, counts = np.unique(comps, return_counts=True)
        largest, two_sides = names[np.argmax(counts)], sides.min() != sides.max()
        parent = {int(x): int(x) for x in names}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for i in np.flatnonzero(comps != largest):
            low = np.searchsorted(tokens, sets[i])
            spans = np.searchsorted(tokens, sets[i], "right") - low
            hits = owner[np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())]
            shared = np.bincount(hits, minlength=len(sets))
            fits = (100 * shared >= percent * (size[i] + size - shared)) & (comps != comps[i])
            if two_sides:
                fits &= sides != sides[i]
            if guests[i]:  # two sets of the step of sizes below meet there
                fits &= guests == 0
            for j in np.flatnonzero(fits):
                x, y = root(int(comps[i])), root(int(comps[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((classes[i], classes[j]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _groups(batches):
    """Rows of one (token, step, x, y) at a time from sorted batches."""
    held, rows = None, []
    for b in batches:
        columns = [b.column(n).to_pylist() for n in (*_LIST, "x", "y", "class", "component", "side", "guest")] + [utf8(b.column("text"))]
        for token, step, x, y, *row in zip(*columns, strict=True):
            if (token, step, x, y) != held:
                if rows:
                    yield held, rows
                held, rows = (token, step, x, y), []
            rows.append(row)
    if rows:
        yield held, rows


#: What a list is known by once lists are cut by sizes.
_LIST = ("token", "step")


def _cut_by_size(located: DataFrame, percent: int) -> DataFrame:
    """Rows of located in the lists of their step of sizes and, as guests, of the next; with members (of the list) for
    lists that have some in different components. Sets that link differ by a step at most, so they meet in the list of
    the larger one's step, and not both are guests there."""
    width = math.log(100 / percent) + 1e-9
    own = F.floor(F.log(F.col("n").cast("double")) / width)
    cut = located.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("step", own + F.col("guest"))
    apart = cut.groupBy(*_LIST).agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("guest").alias("hosts")).where("low <> high and hosts = 0")
    return cut.join(apart.select(*_LIST, "members"), [*_LIST])


def _different(long: DataFrame) -> DataFrame:
    """Of lists with the same members all but one go: shingles of one passage often share all their documents."""
    member = F.xxhash64("class", "guest"), F.xxhash64("guest", "class")
    lists = long.groupBy(*_LIST).agg(F.count("*").alias("n"), *[F.bit_xor(x).alias(f"of{k}") for k, x in enumerate(member)])
    kept = lists.groupBy("n", "of0", "of1").agg(F.min(F.struct(*_LIST)).alias("l")).select("l.*")
    return long.join(kept, [*_LIST], "left_semi")


def _tasks(df: DataFrame) -> int:
    """Tasks for work that its bytes do not show: stated, so that adaptive execution does not put them together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of long lists, dealt by pairs of blocks: token, step, x, y (the pair), class, component, side, guest, text. A
    block has about BLOCK_SHINGLES shingles; a list of k blocks has each member k times."""
    sizes = members.groupBy(*_LIST).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("k"))
    own = members.join(sizes, [*_LIST]).withColumn("u", F.pmod(F.xxhash64("class"), F.col("k").cast("long")).cast("int"))
    dealt = own.select(*_LIST, "class", "component", "guest", "u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("v"))
    at = [*_LIST, "x", "y"]
    keyed = dealt.select(*_LIST, F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "class", "component", (F.col("u") > F.col("v")).cast("int").alias("side"), "guest")
    return keyed.join(texts, "class").repartition(_tasks(texts), *at).sortWithinPartitions(*at).select(*at, "class", "component", "side", "guest", "text")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_shingles and component_id (least id that links reach, its own included) for each row of docs."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = settle(signatures(own, frequency_cells(own, width), width, percent), "signatures")
    grouped = signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("class"), F.min("id").alias("least"))
    classes = settle(grouped, "classes")
    rows = signed.where("n > 0").select(F.col("row").alias("class"), "n", "base", "m", "prefix").join(classes.select("class"), "class", "left_semi")
    # Postings are two numbers; what else is known of a class comes back to those of shared shingles. A shingle's level
    # is the least m whose prefix has it.
    postings = rows.select("class", F.explode("prefix").alias("token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    met = postings.join(lists, "token").groupBy("class").agg(F.collect_list("token").alias("tokens"))
    known = rows.join(met, "class").join(classes.select("class", "least", "digest"), "class")
    met = known.select("class", "least", "digest", "n", "m", "base", "prefix", F.explode("tokens").alias("token"))
    shared = settle(met.select("class", "n", "m", "token", F.greatest(F.lit(1), F.array_position("prefix", F.col("token")).cast("int") - F.col("base") + 1).alias("level")), "shared")
    stars = settle(_star_hubs(shared, percent), "stars")
    texts = _texts(own, classes, stars.select("class").union(stars.select("hub")), width)
    links = settle(_stars(texts.join(F.broadcast(stars) if stars.count() <= FEW else stars, "class", "left"), width, percent), "links")
    release(stars, texts)
    first = components(links)
    located = shared.join(first, "class", "left").select("class", "n", "m", "token", "level", F.coalesce("component", "class").alias("component"))
    left = settle(_cut_by_size(located, percent), "apart")
    release(shared)
    pairs = settle(_cross_pairs(left.where(F.col("members") <= SHORT), percent), "pairs")
    long = settle(_different(left.where(F.col("members") > SHORT)), "long")
    release(left)
    texts = _texts(own, classes, pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(long.select("class")), width)
    more = verified(pairs, texts, width, percent)
    dense = _blocks(long, texts).mapInArrow(lambda batches: _spanning(batches, width, percent), "a long, b long")
    joined = components(links.union(settle(more.union(dense), "links")))
    release(pairs, long, texts)
    by_class = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = by_class.join(least, "component").select("digest", "component_id")
    full = signed.where("n > 0").join(named, "digest").select("id", "n", "component_id")
    empty = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _fitting(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _star_hubs(shared: DataFrame, percent: int) -> DataFrame:
    """class, hub: of the hubs of a class's posting lists (each list's member with the least hash) that which it shares
    most lists with, if these are as many as the smaller m of the two asks for."""
    hubs = shared.groupBy("token").agg(F.min(F.struct(F.xxhash64("class").alias("by"), F.col("n").alias("size"), F.col("m").alias("hub_m"), F.col("class").alias("hub"))).alias("h")).select("token", "h.size", "h.hub_m", "h.hub")
    met = shared.select("token", "class", "n", "m").join(hubs, "token").where((F.col("class") != F.col("hub")) & _fitting("n", "size", percent))
    counted = met.groupBy("class", "hub").agg(F.count("*").alias("lists"), F.min(F.least("m", "hub_m")).alias("asked")).where("lists >= asked")
    return counted.groupBy("class").agg(F.max(F.struct("lists", "hub")).alias("h")).select("class", "h.hub")


def _texts(own: DataFrame, classes: DataFrame, some: DataFrame, width: int) -> DataFrame:
    """class and text of some classes: each has the text of its least id's row."""
    wanted = settle(classes.join(some.select("class").distinct(), "class", "left_semi"), "wanted")
    n = wanted.count()
    found = own.join(F.broadcast(wanted) if n <= FEW else wanted, own["id"].eqNullSafe(wanted["least"])).select("class", "digest", "text")
    checked = append_columns(found, [T.StructField("own", T.BinaryType())], lambda: lambda b: [[digest_of(shingles(x, width)) for x in utf8(b.column("text"))]])
    texts = settle(checked.where("own = digest").select("class", "text"), "texts")
    release(wanted)
    if texts.count() == n:
        return texts
    once = settle(texts.dropDuplicates(["class"]), "texts")  # ids that several rows share
    release(texts)
    return once


def _stars(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between classes and their hubs. A hub's row comes first among its members' and is held while they pass; a
    hub of many members is dealt over several tasks, with a copy of its own row for each."""
    members = texts.where("hub is not null").groupBy("hub").agg(F.count("*").alias("n")).select("hub", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"))
    members = settle(members, "hubs")
    members = F.broadcast(members) if members.count() <= FEW else members
    part = F.pmod(F.xxhash64("class"), F.col("parts").cast("long")).cast("int")
    rows = texts.join(members, "hub").select("hub", part.alias("part"), F.lit(1).alias("kind"), "class", "text")
    heads = texts.select("class", "text").join(members, F.col("class") == F.col("hub")).select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "class", "text")
    dealt = rows.unionByName(heads).repartition(_tasks(texts), "hub", "part").sortWithinPartitions("hub", "part", "kind")

    def run(batches):
        held, key = None, None
        for b in batches:
            links = []
            for *at, kind, cls, raw in zip(*[b.column(n).to_pylist() for n in ("hub", "part", "kind", "class")], utf8(b.column("text")), strict=True):
                if kind == 0:
                    held, key = shingles(raw, width), at
                elif at == key and similar(held, shingles(raw, width), percent):
                    links.append((cls, at[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _cross_pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that share as many shingles of their prefixes as the smaller m of the two asks for.
    A pair that shares one of a long list as well is met there, so here the short lists' count is all that counts."""
    one, two = (short.select(*_LIST, *[F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "m", "level", "component", "guest")]) for s in "ab")
    asked = F.least("m_a", "m_b")
    cross = one.join(two, [*_LIST]).where((F.col("class_a") < F.col("class_b")) & (F.col("guest_a") + F.col("guest_b") < 2) & (F.col("component_a") != F.col("component_b")) & _fitting("n_a", "n_b", percent) & (F.greatest("level_a", "level_b") <= asked))
    return cross.groupBy("class_a", "class_b").agg(F.count("*").alias("shared"), F.max(asked).alias("asked")).where("shared >= asked").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))

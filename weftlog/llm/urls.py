"""URL filters by a sort-merge range join.

A host is keyed by its labels reversed, each ended by a dot (blog.example.org: ``org.example.blog.``), with the path
after it. All hosts under a rule's host then lie in one interval of keys, and intervals of rules are nested or apart.
Pages are dealt over key ranges whose bounds come from the pages' own keys; the page id's hash is the bounds' last part,
so a host with a third of all pages is cut into many ranges. A rule goes to every range that its interval touches. A range
is a task: in it, pages and rules are sorted by key, and one sweep keeps a stack of the rules whose interval is open; of those whose
path a url's path starts with, the longest wins. No side is broadcast, however many rules there are.

Defined cases: null, or a url without ``://``: host and path empty, no rule; a rule with null host or path is ignored;
repeated rules count once; of equally long rules the one with the longer host wins, then block; ports and user names are
part of the host, as it is defined here; no rule: the verdict is the default. An output column replaces one of its name.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .base import bound_batches

#: Page keys that the range bounds are taken from (8 for each range, where that is more), and characters of each. They
#: only even out the ranges: any bounds give the same result.
BOUNDS_FROM, BOUND_CHARS = 20_000, 200
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, found without a pattern: patterns that look ahead at each character recurse."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bounds(keys: DataFrame, parts: int) -> list[tuple[str, int]]:
    """Where key ranges begin, the first aside: quantiles of the keys with the smallest hashes, cut to BOUND_CHARS."""
    some = keys.select("salt", F.substring("key", 1, BOUND_CHARS).alias("key")).orderBy("salt", "key").limit(max(BOUNDS_FROM, 8 * parts))
    found = sorted((r["key"], r["salt"]) for r in some.toLocalIterator())
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


class Stack:
    """Rules whose host interval is open at the current key, outermost first."""

    def __init__(self):
        self.open: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def push(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, rules, sizes = self.open[-1]
        if path not in rules or verdict == "block":
            rules[path] = (rule, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))

    def best(self, path: str) -> tuple[str, str] | None:
        found, most = None, (-1, -1)
        for depth, (_, rules, sizes) in enumerate(self.open):
            for n in sizes:
                if n <= len(path) and (own := rules.get(path[:n])) and (len(own[0]), depth) > most:
                    found, most = own, (len(own[0]), depth)
        return found


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (host and path of the rule that wins, else null) and verdict (allow or block).
    rules: host, path, verdict."""
    spark = pages.sparkSession
    bound_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in new or c == url_col]
    row = F.struct(*[F.col(c) for c in kept])
    keyed = pages.select(row.alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.pmod(F.xxhash64(*[F.col(c) for c in kept]), F.lit(1 << 31)).alias("salt"))
    keyed = keyed.withColumn("key", F.concat(reversed_host(F.col("host")), "path"))
    bounds = _bounds(keyed.select("key", "salt"), parts)
    own = rules.where("host is not null and path is not null").select("host", "path", "verdict").distinct().withColumn("key", reversed_host(F.translate("host", _UPPER, _LOWER)))

    kind = [to_arrow_type(x) for x in (T.ArrayType(T.IntegerType()), T.IntegerType())]

    def deal_pages(batches):
        for b in batches:
            ranges = [bisect_right(bounds, x) for x in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges, kind[1])], names=[*b.schema.names, "range"])

    def deal_rules(batches):
        for b in batches:
            ranges = [list(range(bisect_right(bounds, (x, -1)), bisect_right(bounds, (x + "\U0010ffff", 1 << 31)) + 1)) for x in b.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges, kind[0])], names=[*b.schema.names, "ranges"])

    left = keyed.mapInArrow(deal_pages, T.StructType([*keyed.schema.fields, T.StructField("range", T.IntegerType())]))
    right = own.mapInArrow(deal_rules, T.StructType([*own.schema.fields, T.StructField("ranges", T.ArrayType(T.IntegerType()))]))
    both = left.select("range", "key", F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        right.select(F.explode("ranges").alias("range"), "key", F.lit(0).alias("kind"), F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), "host", "path", "verdict")
    )
    swept = both.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "key", "kind")
    out = T.StructType([swept.schema["row"], *(T.StructField(n, T.StringType()) for n in new)])
    names = out.names
    row_type = to_arrow_type(out["row"].dataType)

    def sweep(batches):
        stack, at = Stack(), None
        for b in batches:
            take, rule, verdict = [], [], []
            columns = [b.column(n).to_pylist() for n in ("range", "key", "kind", "host", "path", "verdict")]
            for i, (r, key, is_page, host, path, said) in enumerate(zip(*columns, strict=True)):
                if r != at:
                    stack, at = Stack(), r
                if not is_page:
                    stack.push(key, path, host + path, said)
                    continue
                stack.close(key)
                won = stack.best(path)
                take.append(i)
                rule.append(won[0] if won else None)
                verdict.append(won[1] if won else default)
            some = b.take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column("row").cast(row_type), some.column("host"), some.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=names)

    return swept.mapInArrow(sweep, out).select("row.*", *new)

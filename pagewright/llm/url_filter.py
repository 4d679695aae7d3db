"""URL filters as a sort-merge range join.

A host's labels in reverse order, each followed by a dot, make a key in which "this host and all its subdomains" is an
interval. URLs and rule intervals are dealt by key ranges and sorted together; a sweep over each range keeps a stack of
the nested rule hosts that are open at the current key, each with its path prefixes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: About how many keys the range boundaries are taken from, drawn by a hash of their rows. They steer how even the ranges are, never the result.
BOUNDARY_KEYS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """``blog.example.org`` gives ``org.example.blog.``: a host's key starts with the key of every domain above it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class OpenRules:
    """The stack of the sweep: rule hosts whose intervals hold the current key, innermost last."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, list[tuple]]]] = []

    def advance(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, rule: tuple) -> None:
        """rule: (host, path, verdict). Rules of one host come together; their paths are kept by length."""
        self.advance(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        by_length = self.stack[-1][1]
        by_length.setdefault(len(rule[1]), {}).setdefault(rule[1], []).append(rule)

    def best(self, key: str, path: str) -> tuple | None:
        """The longest rule that fits; of equally long ones the more specific host, then block before allow."""
        self.advance(key)
        found = None
        for host_key_, by_length in self.stack:
            for n in sorted(by_length, reverse=True):
                if n <= len(path) and (rules := by_length[n].get(path[:n])):
                    host, rule_path, verdict = min(rules, key=lambda r: r[2] != "block")
                    rank = (len(host) + n, len(host), verdict == "block")
                    if found is None or rank > found[0]:
                        found = (rank, host + rule_path, verdict)
                    break
        return found


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict): a row for each row of pages, repeated ones and null ids too.

    rules: host, path, verdict; rows with a null in any of them fit nothing. Without a fitting rule, rule is null and
    the verdict is the default; so it is for null urls, urls without :// and empty rule tables. A key that many rows
    share makes several equal boundaries; its rows are dealt over all ranges between them, and rules go to every range
    that their interval touches.
    """
    spark = pages.sparkSession
    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.xxhash64("id", "path"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, BOUNDARY_KEYS / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("key", "path", "salt"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sorted((r[0], r[1]) for r in drawn.select("key", "path").collect())
    bounds = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    edge = spark.sparkContext.broadcast(bounds)  # ranges rows at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = edge.value
        for batch in batches:
            cells = batch.to_pydict()
            part = []
            for key, path, salt in zip(cells["key"], cells["path"], cells["salt"]):
                low, high = bisect_left(edges, (key, path)), bisect_right(edges, (key, path))
                part.append(low + salt % (high - low + 1))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch["key"], pa.array([1] * n, pa.int8()), batch["id"], batch["host"], batch["path"], pa.nulls(n, pa.string())], names=EVENT)

    EVENT = ["part", "key", "kind", "id", "host", "path", "verdict"]
    event = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("kind", T.ByteType()), T.StructField("id", rows.schema["id"].dataType), *[T.StructField(c, T.StringType()) for c in EVENT[4:]]])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = edge.value
        for batch in batches:
            cells = batch.to_pydict()
            out = []
            for i, key in enumerate(cells["key"]):
                low, high = bisect_left(edges, (key,)), bisect_right(edges, (key + "\U0010ffff",))
                out += [(p, i) for p in range(low, high + 1)]
            pick = pa.array([i for _, i in out], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), batch["key"].take(pick), pa.array([0] * len(out), pa.int8()), pa.nulls(len(out), id_type), batch["host"].take(pick), batch["path"].take(pick), batch["verdict"].take(pick)], names=EVENT)

    id_type = to_arrow_type(rows.schema["id"].dataType)
    opened = rules.select("host", "path", "verdict").dropna().distinct().withColumn("key", host_key(F.col("host")))
    events = rows.select("id", "host", "path", "key", "salt").mapInArrow(deal, event).unionByName(opened.mapInArrow(deal_rules, event))
    events = events.repartition("part").sortWithinPartitions("part", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rules_open = None, OpenRules()
        for batch in batches:
            cells = batch.to_pydict()
            keep, rule, verdict = [], [], []
            for i, (p, key, kind, host, path, says) in enumerate(zip(*(cells[c] for c in ("part", "key", "kind", "host", "path", "verdict")))):
                if p != part:
                    part, rules_open = p, OpenRules()
                if kind == 0:
                    rules_open.open(key, (host, path, says))
                else:
                    best = rules_open.best(key, path)
                    keep.append(i)
                    rule.append(best and best[1])
                    verdict.append(best[2] if best else default)
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pick), batch["host"].take(pick), batch["path"].take(pick), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    judged = T.StructType([event["id"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return events.mapInArrow(sweep, judged).withColumnRenamed("id", id_column)

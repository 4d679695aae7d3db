"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Training words are streamed through the automaton, which keeps the longest suffix read so far that occurs in some
item. A match of ``window`` words (or of a whole shorter item) marks its words; spans are cut where a document's marked
share reaches the coverage limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import WORD_BYTES, free_name, slices, words_of, written

WINDOW = 13
#: A document is contaminated if its marked words make up this share or more.
COVERAGE = (1, 20)
#: Item words that one automaton holds (some hundreds of bytes each); more items are matched in several passes.
MAX_WORDS = 200_000


class SuffixAutomaton:
    """Words of all items in one automaton; states are list indexes, 0 is the root.

    After finish(): windows[s] names the items that contain the window-long suffix of any match of at least that
    length in s, short[s] the (length, items) of whole shorter items that end there.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        items = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._finish(items)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the strings of p with w appended, taken out of q where q also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _finish(self, items: list[tuple[str, list[int]]]) -> None:
        """Walks every item once more to note which items own which windows."""
        owners: dict[int, set[str]] = {}
        whole: dict[int, tuple[int, set[str]]] = {}
        for name, words in items:
            s = n = 0
            for w in words:
                s, n = self.next[s][w], n + 1
                if n >= self.window:
                    while self.length[self.link[s]] >= self.window:
                        s = self.link[s]
                        n = self.length[s]
                    owners.setdefault(s, set()).add(name)
            if len(words) < self.window:
                whole.setdefault(s, (len(words), set()))[1].add(name)
        # a match in s of the window's length or more has its window in the ancestor where lengths pass the window
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.at: list[int] = [0] * len(order)
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(order)
        for s in order[1:]:
            up = self.link[s]
            self.at[s] = 0 if self.length[s] < self.window else s if self.length[up] < self.window else self.at[up]
            own = ((whole[s][0], frozenset(whole[s][1])),) if s in whole else ()
            self.short[s] = self.short[up] + own
        self.owners = {s: frozenset(x) for s, x in owners.items()}
        self.any_short = bool(whole)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Marked word ranges (start, end), merged and ascending, and the items whose windows occur."""
        moves, link, length, window, at, short = self.next, self.link, self.length, self.window, self.at, self.short
        ids = list(map(self.ids.get, words))
        spans: list[list[int]] = []
        seen: set[int] = set()
        items: set[str] = set()
        s = n = 0
        shorts = self.any_short
        for i, w in enumerate(ids):
            t = moves[s].get(w)
            if t is not None:
                s, n = t, n + 1
            elif s:
                s = link[s]
                while s >= 0 and (t := moves[s].get(w)) is None:
                    s = link[s]
                if s < 0:
                    s = n = 0
                else:
                    n, s = length[s] + 1, t
            if n >= window:
                if spans and i - n + 1 <= spans[-1][1]:
                    spans[-1][1] = i + 1
                    spans[-1][0] = min(spans[-1][0], i - n + 1)
                else:
                    spans.append([i - n + 1, i + 1])
                seen.add(at[s])
            if shorts and s and short[s]:
                for m, names in short[s]:
                    if m <= n:
                        items |= names
                        spans.append([i - m + 1, i + 1])
        for u in seen:
            items |= self.owners[u]
        return merged(spans), items


def merged(spans: Iterable) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


class Items:
    """A benchmark's items in groups of about max_words words, each read on its own; a null id counts as the empty string."""

    def __init__(self, benchmark: DataFrame, item_column: str, text_column: str, max_words: int):
        self.rows = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(text_column).cast("string").alias("text"))
        size = self.rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        self.groups = max(1, math.ceil(size / 2 / max_words))  # a word and its separator take two characters at least

    def __iter__(self) -> Iterator[list[tuple[str, list[bytes]]]]:
        for k in range(self.groups):
            part = self.rows if self.groups == 1 else self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.groups)) == k)
            yield [(r["item"], words_of(r["text"])) for r in part.toLocalIterator()]


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
ARROW_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def scanned(texts: DataFrame, machine, every: bool) -> DataFrame:
    """(key, hits) of (key, text) by a broadcast automaton; only of rows with hits, if not every."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = machine.value
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                spans, found = automaton.match(words)
                out.append({"n_words": len(words), "spans": spans, "items": sorted(found)})
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, ARROW_HITS)], names=["key", "hits"])
            yield made if every else made.filter(pa.array([bool(h["spans"]) for h in out], pa.bool_()))

    return texts.mapInArrow(scan, T.StructType([texts.schema["key"], T.StructField("hits", HITS)]))


def joined_hits(found: DataFrame) -> DataFrame:
    """One row for each key of (key, hits): ranges merged, items in order."""
    one = found.groupBy("key").agg(F.max("hits.n_words").alias("n_words"), F.flatten(F.collect_list("hits.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits.items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"n_words": n, "spans": merged(s), "items": i} for n, s, i in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, ARROW_HITS)], names=["key", "hits"])

    return one.mapInArrow(run, T.StructType([found.schema["key"], T.StructField("hits", HITS)]))


def with_hits(rows: DataFrame, items: Items, name: str, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """rows and a column of that name: n_words, marked word ranges and the items whose windows occur.

    For items of several automata: there are as many passes over the rows, which are written once, with a number; each
    pass writes hits alone, and they are joined to the rows at the end.
    """
    key = free_name([*rows.columns, name], "key")
    spark = rows.sparkSession
    rows = written(rows.withColumn(key, F.monotonically_increasing_id()), "decontamination")
    texts = rows.select(F.col(key).alias("key"), F.col(text_column).cast("string").alias("text"))
    parts = []
    for k, group in enumerate(items):
        machine = spark.sparkContext.broadcast(SuffixAutomaton(group, window))
        parts.append(written(scanned(texts, machine, not k), "decontamination-hits"))
        machine.unpersist()
    found = joined_hits(reduce(DataFrame.unionByName, parts)).select(F.col("key").alias(key), F.col("hits").alias(name))
    return rows.join(found, key).drop(key)


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """(id, hits): n_words, marked word ranges and the items whose windows occur, a row for each row of docs.

    Null and empty texts have no words and no hits; repeated rows and null ids are kept; an empty benchmark marks
    nothing.
    """
    items = Items(benchmark, item_column, item_text, max_words)
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    if items.groups == 1:
        found = scanned(rows, docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(next(iter(items)), window)), True)  # bounded by max_words
    else:
        found = with_hits(rows, items, "hits", "text", window)
    return found.select(F.col("key").alias(id_column), F.col("hits").alias(free_name([id_column], "hits")))


def marked_words(hits) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, hits)."""
    h = F.col("hits")
    n = marked_words(h)
    return found.select(
        "doc_id", h["n_words"].alias("n_words"), n.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        over_limit(h, COVERAGE).alias("contaminated"),
    )


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the marked words: each range goes from its first word's start to its last word's end."""
    flat, at, k = raw.translate(WORD_BYTES), 0, 0
    starts, ends = {a for a, _ in spans}, {b - 1 for _, b in spans}
    out, kept = [], 0
    for word in flat.split():
        at = flat.index(word, at)
        if k in starts:
            out.append(raw[kept:at].rstrip(b" "))
        at += len(word)
        if k in ends:
            kept = at
        k += 1
    out.append(raw[kept:])
    return b"".join(out)


def over_limit(hits: Column, coverage: tuple[int, int]) -> Column:
    n, (num, den) = marked_words(hits), coverage
    return (n > 0) & (F.lit(den) * n >= F.lit(num) * hits["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW, coverage: tuple[int, int] = COVERAGE, max_words: int = MAX_WORDS, length_column: str = "n_chars") -> DataFrame:
    """docs with the marked spans cut from each document whose marked share reaches the coverage limit.

    A document below the limit stays as it is, in full. Cutting joins what stood around a span, so cut texts are matched
    again until none is over the limit. A document left without any word goes. length_column, if there, is set anew for
    cut texts. Other columns pass through, whatever their names; null texts stay.
    """
    name = free_name(docs.columns, "hits")
    items = Items(benchmark, "item_id", "text", max_words)
    if items.groups == 1:
        machine = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(next(iter(items)), window))
        return _cut_by(docs, text_column, length_column, coverage, lambda words: machine.value.match(words)[0])
    rows = docs
    while True:  # more than one automaton: shares are known only after all of them
        found = written(with_hits(rows, items, name, text_column, window), "decontaminated")
        if not found.where(over_limit(F.col(name), coverage)).limit(1).count():
            return found.select(*docs.columns)
        rows = _cut_by(found, text_column, length_column, coverage, None, name).select(*docs.columns)


def _cut_by(rows: DataFrame, text_column: str, length_column: str, coverage: tuple[int, int], match, hits: str | None = None) -> DataFrame:
    """rows with texts cut where the marked share is over the limit: by match, again and again, or once by the ranges in the column hits."""
    num, den = coverage

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            texts, keep, changed = batch.column(at).to_pylist(), [], {}
            known = batch.column(batch.schema.get_field_index(hits)).to_pylist() if hits else None
            for i, text in enumerate(texts):
                words = words_of(text)
                spans = match(words) if match else [tuple(s) for s in known[i]["spans"]]
                while spans and den * sum(b - a for a, b in spans) >= num * len(words):
                    changed[i] = text = cut(text.encode("utf-8", "replace"), spans).decode("utf-8", "replace")
                    words = words_of(text)
                    spans = match(words) if match else []
                if i not in changed or words:
                    keep.append(i)
            if changed:
                texts = [changed.get(i, t) for i, t in enumerate(texts)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if length_column in batch.schema.names:
                    to = batch.schema.get_field_index(length_column)
                    sizes = [len(texts[i]) if i in changed else n for i, n in enumerate(batch.column(to).to_pylist())]
                    batch = batch.set_column(to, batch.schema.field(to), pa.array(sizes, batch.schema.field(to).type))
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(scan, rows.schema)

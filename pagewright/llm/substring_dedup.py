"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text's words; a word starts a chunk where the hash of the bytes before it says so,
so that cuts depend on what stands there and an insertion shifts none but the nearest. A variable chunk goes from a cut
to the first cut at least LEAST_WORDS words on, so that neighbours overlap and no short line makes a chunk. Words that
recur have few hashes and may have no cut at all, so no chunk is longer than SURE_WORDS words, and each window of so many
words that holds no chunk is one itself: no passage of that length is missed, and no insertion changes more than the
chunks around it. Chunks with equal digests are the same passage: its occurrence in the document
with the smallest id stays, the others are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import free_name, slices, words_of
from pagewright.llm.decontamination import cut
from pagewright.llm.ngram_join import MIX1, MIX2, mix, powers

#: A word starts a chunk with this probability; a chunk has this many words at least.
CUT = 1 / 4
LEAST_WORDS = 24
#: A passage of this many words holds a chunk, or is one.
SURE_WORDS = 51
WINDOW = 32
SLICE = 1 << 20


def gear_table(seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


GEAR = gear_table()


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 * h + GEAR[byte] modulo 2**32 after each byte; it depends on the last 32 bytes. Windows are doubled five times."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def bare_windows(cuts: np.ndarray, first: np.ndarray, last: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every window of SURE_WORDS words without a chunk whose cuts rest on the window's own bytes: what stands around it doesn't matter."""
    n = np.maximum(count - SURE_WORDS + 1, 0)
    own = np.repeat(np.arange(len(count)), n)
    start = np.arange(len(own)) + np.repeat(last - count - np.cumsum(n) + n, n)
    never = np.iinfo(np.int64).max // 2
    beyond = np.append(cuts, never)
    cut = beyond[np.searchsorted(first[cuts], first[start] + WINDOW)]
    bare = beyond[np.searchsorted(cuts, cut + LEAST_WORDS)] >= start + SURE_WORDS
    return own[bare], start[bare]


def chunks(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(index of the text, d1, d2, first word, words, repeat) of every chunk; repeat counts earlier equal chunks of the text.

    A run of bare windows, each a word after the other, is one passage, which doesn't repeat itself; equal windows of a
    run that overlap are one row. Digests have 96 bits. Case, punctuation and white space don't matter; a text of fewer than LEAST_WORDS words has no
    chunk. The hash starts anew in each text.
    """
    words = [words_of(t) for t in texts]
    gap = b" " * WINDOW
    flat = np.frombuffer(gap + b"".join(b" ".join(w) + gap for w in words), np.uint8)
    count = np.array([len(w) for w in words], np.int64)
    last = np.cumsum(count)
    begin = last - count
    letter = flat != 32
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    after = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    if not len(first):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32))
    is_cut = gear(flat)[first - 1] < np.uint32(int(CUT * (1 << 32)))
    bare_own, bare = bare_windows(np.flatnonzero(is_cut), first, last, count)
    is_cut[begin[count > 0]] = True
    cuts = np.flatnonzero(is_cut)
    own = np.searchsorted(last, cuts, side="right")
    to = np.searchsorted(cuts, cuts + LEAST_WORDS)
    end = np.where(to < len(cuts), cuts[np.minimum(to, len(cuts) - 1)], last[own])
    end = np.minimum(end, last[own])
    sized = (end - cuts >= LEAST_WORDS) & (end - cuts <= SURE_WORDS)
    cuts, own, end = cuts[sized], own[sized], end[sized]
    cuts, own, end = np.concatenate([cuts, bare]), np.concatenate([own, bare_own]), np.concatenate([end, bare + SURE_WORDS])
    kind = np.repeat(np.array([0, 1], np.uint64), [len(cuts) - len(bare), len(bare)])
    # chunks stand for themselves; windows in a row share a number
    row = np.concatenate([np.arange(len(cuts) - len(bare)), len(cuts) + np.cumsum(np.diff(bare, prepend=-1) != 1)])
    a, b = first[cuts], after[end - 1]
    digests = []
    for base, seed in ((0x2545F4914F6CDD1D, MIX1), (0x9FB21C651E98DF25, MIX2)):
        up, down = powers(len(flat) + 1, base), powers(len(flat) + 1, pow(base, -1, 1 << 64))
        table = mix(np.arange(1, 257, dtype=np.uint64) * seed)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[flat] * up[: len(flat)], dtype=np.uint64)])
        digests.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * MIX2 + kind * MIX1))
    d1, d2 = digests[0].view(np.int64), (digests[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    repeat = np.zeros(len(cuts), np.int32)
    order = np.lexsort((cuts, d2, d1, own))
    same = (own[order][1:] == own[order][:-1]) & (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])
    if same.any():
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
        repeat[order] = np.where(row[order] != row[order[np.arange(len(order)) - run]], run, 0)
    # equal windows of a run that overlap cover one stretch: a single row stands for them, however often a line of few words goes on
    if not len(order):
        return own, d1, d2, cuts.astype(np.int32), cuts.astype(np.int32), repeat
    head = np.concatenate([[True], ~(same & (np.diff(row[order]) == 0) & (np.diff(cuts[order]) <= SURE_WORDS))])
    at = np.flatnonzero(head)
    first, final = order[at], order[np.append(at[1:], len(order)) - 1]
    return own[first], d1[first], d2[first], (cuts - begin[own])[first].astype(np.int32), (end[final] - cuts[first]).astype(np.int32), repeat[first]


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(d1, d2, doc, start, words, again) of every chunk of texts with an id, which may be of any type that has an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            own, d1, d2, start, words, repeat = chunks(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), batch.column(0).take(pa.array(own)), pa.array(start), pa.array(words), pa.array(repeat > 0)], names=["d1", "d2", "doc", "start", "words", "again"])

    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))
    field = lambda name, kind: T.StructField(name, kind)
    return rows.mapInArrow(run, T.StructType([field("d1", T.LongType()), field("d2", T.IntegerType()), field("doc", rows.schema["doc"].dataType), field("start", T.IntegerType()), field("words", T.IntegerType()), field("again", T.BooleanType())]))


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", within: bool = False) -> DataFrame:
    """(id, n_words, spans, first_docs) for each document that repeats passages of others, or also, if asked, of itself (within).

    spans: [first word, end word) in order, merged; n_words: words in them; first_docs: the ids that keep those
    passages, ascending. The document with a passage's smallest id keeps it (its first occurrence there), so a document
    without repeats has no row. Rows with a null id are left out; rows that repeat an id are one document, whose equal
    chunks don't count against each other. Null, empty and short texts have no chunks. Other columns are not read.

    Counts and minima are aggregated before the shuffle; the join that finds the repeats has one row for each digest on
    one side, so that Spark can split a passage that very many documents share.
    """
    found = occurrences(docs, id_column, text_column)
    first = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1").select("d1", "d2", "first")
    hits = found.join(first, ["d1", "d2"]).where("again OR doc <> first" if within else "doc <> first")
    hits = hits.select("doc", "start", (F.col("start") + F.col("words")).alias("end"), "first")
    # chunks that overlap or touch make one span; a document's chunks are sorted, never held together
    by = Window.partitionBy("doc").orderBy("start", "end")
    hits = hits.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    hits = hits.withColumn("number", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = hits.groupBy("doc", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("first").alias("firsts"))
    spans = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_docs"))
    return spans.select(F.col("doc").alias(id_column), F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_words"), "spans", "first_docs")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars", within: bool = False) -> DataFrame:
    """docs without the repeated passages, length_column (if there) set anew; a document left without words goes.

    Rows without an id, and null, empty and short texts stay as they are; rows that repeat an id all lose its spans; an
    empty table stays empty. Other columns pass through, whatever their names.
    """
    key = free_name(docs.columns, "doc")
    cuts = free_name([*docs.columns, key], "spans")
    spans = repeats(docs, id_column, text_column, within).select(F.col(id_column).alias(key), F.transform("spans", lambda s: F.array(s["start"], s["end"])).alias(cuts))
    joined = docs.join(spans, docs[id_column] == spans[key], "left").select(*[docs[c] for c in docs.columns], spans[cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            hit = [k for k, s in enumerate(spans) if s and texts[k]]
            for k in hit:
                texts[k] = cut(texts[k].encode("utf-8", "replace"), spans[k]).decode("utf-8", "replace")
            gone = {k for k in hit if not words_of(texts[k])}
            out = batch.select(batch.schema.names[:-1]).set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if length_column in out.schema.names:
                to = out.schema.get_field_index(length_column)
                sizes = out.column(to).to_pylist()
                for k in hit:
                    sizes[k] = len(texts[k])
                out = out.set_column(to, out.schema.field(to), pa.array(sizes, out.schema.field(to).type))
            yield out.take(pa.array([k for k in range(out.num_rows) if k not in gone], pa.int64())) if gone else out

    return joined.mapInArrow(run, docs.schema)

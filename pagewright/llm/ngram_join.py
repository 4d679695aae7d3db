"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide.

Documents with the same set of word n-grams are one class. Representatives meet in buckets of equal band hashes. A
bucket is worked on in blocks of bounded size; a pair is verified in the first band that it shares, and a block gives
one row for each of its members (its number of links, and one member that its links reach), never one for each pair.

Members of a bucket of several blocks are compared with its smallest one first. Those so near to it that any two of them
must link (half the allowed Jaccard distance, which obeys the triangle inequality) are a ball: their links are counted by
adding up, and none of their pairs is verified, so that a large group of near copies takes no blocks of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import WORD_BYTES, free_name, slices, written
from pagewright.llm.components import components

WORDS = 5
THRESHOLD = 0.8
#: Share of the pairs right at the threshold that meet in some band, and the greatest one of pairs half as similar.
RECALL, UNLIKE = 0.9999, 0.25
#: Members and n-grams of one chunk of a bucket; a block holds two chunks.
CHUNK_MEMBERS = 1_024
CHUNK_NGRAMS = 1_000_000
SLICE = 1 << 20

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def banding(threshold: float, recall: float, unlike: float = UNLIKE) -> tuple[int, int]:
    """(bands, rows of each): the fewest rows, thus the fewest hashes, by which pairs at the threshold meet with the probability recall and pairs half as similar with that of unlike at most."""
    for rows in range(1, 65):
        bands = max(1, math.ceil(math.log1p(-recall) / math.log1p(-min(threshold**rows, 1 - 1e-12))))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= unlike:
            break
    return bands, rows


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


def ngrams(texts: list[str | None], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every distinct word n-gram, by text and hash. Fewer than n words, but not none, are one n-gram."""
    raw = [(t.encode("utf-8", "replace") if t else b"").translate(WORD_BYTES) for t in texts]
    flat = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    inside = flat != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, after = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's hash: sum of its mixed bytes times powers of an odd base, moved back to power 0
    base = 0x2545F4914F6CDD1D
    up, down = powers(len(flat) + 1, base), powers(len(flat) + 1, pow(base, -1, 1 << 64))
    table = mix(np.arange(1, 257, dtype=np.uint64) * MIX1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[flat] * up[: len(flat)], dtype=np.uint64)])
    word = mix((total[after] - total[first]) * down[first])
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    owner = np.searchsorted(starts, first, side="right") - 1
    if len(word) >= n:
        gram = np.zeros(len(word) - n + 1, np.uint64)
        for k in range(n):
            gram = (gram + word[k : len(word) - n + 1 + k]) * MIX1
        keep = owner[: len(gram)] == owner[n - 1 :]
        gram, own = mix(gram[keep]), owner[: len(keep)][keep]
    else:
        gram, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=len(texts))
    if len(short := np.flatnonzero((count > 0) & (count < n))):
        begin = np.searchsorted(owner, short)
        brief = []
        for s, b in zip(short, begin):
            h = np.uint64(count[s])
            with np.errstate(over="ignore"):
                for w in word[b : b + count[s]]:
                    h = (h + w) * MIX2
            brief.append(h)
        gram, own = np.concatenate([gram, mix(np.array(brief, np.uint64))]), np.concatenate([own, short])
    order = np.lexsort((gram, own))
    gram, own = gram[order], own[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    return gram[new], own[new]


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def __call__(self, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Band hashes (sets, bands) of sets that start at first."""
        out = np.zeros((len(first), self.bands), np.uint64)
        for k, (a, b) in enumerate(zip(self.times, self.plus)):
            least = np.minimum.reduceat((gram * a + b) >> np.uint64(20), first)
            out[:, k // self.rows] = (out[:, k // self.rows] + least) * MIX1
        return mix(out + np.arange(self.bands, dtype=np.uint64) * MIX2)


def signatures(docs: DataFrame, id_column: str, text_column: str, bands: int, band_rows: int) -> DataFrame:
    """(id, n, d1, d2, bands): size, 128-bit digest and band hashes of each text's n-gram set; n is 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, band_rows)
        for batch in slices(batches, "text", SLICE):
            gram, own = ngrams(batch.column(1).to_pylist())
            texts, first, n = np.unique(own, return_index=True, return_counts=True)
            size, digest = np.zeros(batch.num_rows, np.int32), np.zeros((2, batch.num_rows), np.uint64)
            band = [None] * batch.num_rows
            if len(texts):
                size[texts] = n
                for k, m in enumerate((MIX1, MIX2)):
                    digest[k, texts] = np.add.reduceat(mix(gram * m), first)
                for t, row in zip(texts, minhash(gram, first).view(np.int64)):
                    band[t] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *(pa.array(d.view(np.int64)) for d in digest), pa.array(band, pa.list_(pa.int64()))], names=["id", "n", "d1", "d2", "bands"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n int, d1 long, d2 long, bands array<long>")


def verify(members: list[dict], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(rep, links, peer) of a block's members that have links: links count documents, peer is the least member that the block's links reach."""
    band, cross = members[0]["band"], members[0]["i"] != members[0]["j"]
    rep = np.array([m["rep"] for m in members], np.int64)
    copies = np.array([m["copies"] for m in members], np.int64)
    side = np.array([m["side"] for m in members])
    k = len(members)
    gram, own = ngrams([m["text"] for m in members])
    size = np.bincount(own, minlength=k)
    # only n-grams that two members share make intersections
    _, at, count = np.unique(gram, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    own, col = own[keep], column[at[keep]]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    inter = np.zeros((k, k), np.float32)  # counts below 2**24 are exact
    columns = int(shared.sum())
    slab = max(1, min(columns, (8 << 20) // k))
    for low in range(0, columns, slab):
        a, b = np.searchsorted(col, (low, low + slab))
        dense = np.zeros((k, slab), np.float32)
        dense[own[a:b], col[a:b] - low] = 1
        inter += dense @ dense.T
    link = np.zeros((k, k), bool)
    for at in range(0, k, 256):
        part = inter[at : at + 256].astype(np.float64)
        link[at : at + 256] = part >= threshold * (size[at : at + 256, None] + size[None, :] - part) - 1e-9
    del inter
    if cross:
        link &= side[:, None] != side[None, :]
    ball = np.array([-1 - k if m["ball"] is None else m["ball"] for k, m in enumerate(members)], np.int64)
    apart = np.array([m["ball"] is None for m in members])
    link &= (ball[:, None] != ball[None, :]) | apart[:, None] | apart[None, :]  # pairs of a ball are counted already
    np.fill_diagonal(link, False)
    hashes = np.array([m["bands"][:band] for m in members], np.int64).reshape(k, band)
    for b in range(band):  # pairs of an earlier band have been counted there
        link &= hashes[:, b][:, None] != hashes[:, b][None, :]
    linked = np.flatnonzero(link.any(1))
    if not len(linked):
        return
    link = link[np.ix_(linked, linked)]
    links = link @ copies[linked]
    peer = rep[linked].copy()
    while True:
        least = np.concatenate([np.where(link[at : at + 256], peer[None, :], np.iinfo(np.int64).max).min(1) for at in range(0, len(link), 256)])
        least = np.minimum(peer, least)
        if (least == peer).all():
            break
        peer = least
    yield from zip(rep[linked].tolist(), links.tolist(), peer.tolist())


FOUND = "rep long, links long, peer long"


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, peer) from rows sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["rep", "links", "peer"])

        block, members = None, []
        for batch in slices(batches, "text", 8 << 20):
            found = []
            for row in batch.to_pylist():
                key = (row["h"], row["i"], row["j"])
                if key != block:
                    if len(members) > 1:
                        found += verify(members, threshold)
                    block, members = key, []
                members.append(row)
            yield out(found)
        if len(members) > 1:
            yield out(list(verify(members, threshold)))

    return blocks.mapInArrow(run, FOUND)


def near_pivot(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, ball) of the rows (rep, ball, text, pivot_text) whose similarity with the pivot is so high that any two of them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n = batch.num_rows
            # pivots repeat: each different text is cut into n-grams once
            pivots, which = np.unique(np.array(batch.column(3).to_pylist(), object), return_inverse=True)
            gram, own = ngrams([*batch.column(2).to_pylist(), *pivots])
            sets = np.split(gram, np.searchsorted(own, np.arange(1, n + len(pivots))))
            near = []
            for k in range(n):
                a, b = sets[k], sets[n + which[k]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(2 * both >= (1 + threshold) * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["rep", "ball"]).filter(pa.array(near, pa.bool_()))

    return rows.select("rep", "ball", "text", "pivot_text").mapInArrow(run, "rep long, ball long")


def balls_of(hot: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(rep, ball): of (rep, pivot), the smallest pivot of each rep, if it is near enough; texts holds rep and text."""
    nearest = written(hot.groupBy("rep").agg(F.min("pivot").alias("ball")), "ngram-pivots")  # its size is known now: texts need not be dealt out for a small one
    pivots = nearest.select("ball").distinct().join(texts.select(F.col("rep").alias("ball"), F.col("text").alias("pivot_text")), "ball")
    return written(near_pivot(nearest.join(texts, "rep").join(pivots, "ball"), threshold), "ngram-balls")


def links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, class_id, rep_id): a row for each row of docs.

    n_links counts the other documents whose Jaccard similarity is the threshold or more, copies included; class_id is
    the smallest id that links reach, rep_id the smallest id with the same n-grams. Texts without words (null, empty)
    link with nothing; rows with a null id link with nothing and have no class. Equal rows of one id are one document;
    rows of one id with different texts are documents of their own, which link like others. The id must be an integer.
    Other columns are not read; an empty table has no rows.
    """
    bands, band_rows = banding(threshold, recall)
    made = written(signatures(docs, id_column, text_column, bands, band_rows), "ngram-signatures")
    if made.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count():
        return _repeated(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")), threshold, recall).withColumnRenamed("id", id_column)
    ids = made.where("id IS NOT NULL AND n > 0")
    reps = written(ids.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "ngram-classes")
    spread = reps.select("rep", "n", F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("h").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("size"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", "n")).alias("x2")).where("m > 1")
    # of buckets with the same members, the one of the earliest band has all their pairs
    buckets = buckets.groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "h", "size")).alias("first"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK_MEMBERS), F.ceil(F.col("first.size") / CHUNK_NGRAMS)).cast("int")
    buckets = buckets.select("first.band", "first.h", chunks.alias("chunks"))
    members = written(spread.select("rep", "h", "n").join(buckets, "h"), "ngram-members")
    texts = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text_column).cast("string").alias("text"))
    hot = members.where("chunks > 1")
    ball = None
    if hot.limit(1).count():  # else texts would be dealt out to find no ball
        pivots = hot.groupBy("h").agg(F.min("rep").alias("pivot"))
        ball = balls_of(hot.select("rep", "h").join(pivots, "h"), texts, threshold)
    members = _dealt(members, ball)
    active = members.select("rep").distinct().join(reps.select("rep", "copies", "bands"), "rep")
    blocks = members.join(texts.join(active, "rep"), "rep").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    found = written(verified(blocks, threshold), "ngram-links")
    if ball is not None:  # in a ball all link with all others
        inside = ball.join(reps.select("rep", "copies"), "rep")
        inside = inside.join(inside.groupBy("ball").agg(F.sum("copies").alias("all")), "ball").select("rep", (F.col("all") - F.col("copies")).alias("links"), F.col("ball").alias("peer"))
        found = found.unionByName(inside)
    near = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    reps = reps.select("d1", "d2", "n", "rep", "copies").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    reps = reps.join(near.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("d1", "d2", "n", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    known = ids.select("id", "d1", "d2", "n").join(reps, ["d1", "d2", "n"]).select("id", "n_links", "class_id", F.col("rep").alias("rep_id"))
    alone = made.where("id IS NULL OR n = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"), F.col("id").alias("rep_id"))
    return known.unionByName(alone).withColumnRenamed("id", id_column)


def _dealt(members: DataFrame, ball: DataFrame | None) -> DataFrame:
    """(rep, h, band, ball, side, i, j) of (rep, h, n, band, chunks) and (rep, ball): members in chunks, and chunks in blocks; a ball has chunks of its own, which meet all others of the bucket."""
    members = members.withColumn("ball", F.lit(None).cast("long")) if ball is None else members.join(ball, "rep", "left")
    small = members.where("chunks = 1").select("rep", "h", "band", "ball", F.lit(0).alias("side"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    if ball is None:
        return small
    large = members.where("chunks > 1")
    parts = large.groupBy("h", "ball").agg(F.greatest(F.ceil(F.count("*") / CHUNK_MEMBERS), F.ceil(F.sum(F.col("n").cast("long")) / CHUNK_NGRAMS)).cast("int").alias("size"))
    # chunks of a bucket are numbered on: first those of the rest, then ball by ball
    order = Window.partitionBy("h").orderBy(F.col("ball").asc_nulls_first())
    parts = parts.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    whole = parts.groupBy("h").agg(F.sum("size").alias("total"))
    parts = written(parts.join(whole, "h"), "ngram-chunks").select(F.col("h").alias("h_"), F.col("ball").alias("ball_"), "size", "before", "total")
    large = large.join(parts, (F.col("h") == F.col("h_")) & F.col("ball").eqNullSafe(F.col("ball_")))
    large = large.withColumn("side", (F.col("before") + F.pmod(F.xxhash64("rep", "h"), F.col("size"))).cast("int"))
    every = F.sequence(F.lit(0), (F.col("total") - 1).cast("int"))
    own = lambda k: F.col("ball").isNotNull() & (k >= F.col("before")) & (k < F.col("before") + F.col("size"))
    large = large.withColumn("other", F.explode(F.filter(every, lambda k: ~own(k))))
    return small.unionByName(large.select("rep", "h", "band", "ball", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")))


def _repeated(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """links() of (id, text) where ids repeat: the different rows are numbered, and the numbers link."""
    nodes = written(rows.where("id IS NOT NULL").distinct().withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    once = written(links(nodes, "node", "text", threshold, recall), "ngram-once")
    least = lambda c: once.join(nodes, "node").groupBy(F.col(c).alias("of")).agg(F.min("id").alias("least"))
    for c in ("class_id", "rep_id"):
        named = least(c)
        once = once.join(named, once[c] == named["of"]).drop(c, "of").withColumnRenamed("least", c)
    own = nodes.join(once, "node").select(F.col("id").alias("id_"), F.col("text").alias("text_"), "n_links", "class_id", "rep_id")
    out = rows.join(own, (F.col("id") == F.col("id_")) & F.col("text").eqNullSafe(F.col("text_")), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_id", "rep_id")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs of which one row of each class stays: of those with the smallest id, any one. Rows without an id or without words stay. Other columns pass through, whatever their names."""
    ids = docs.where(F.col(id_column).isNotNull()).groupBy(id_column).count()
    if not ids.where("count > 1").limit(1).count():
        gone = links(docs, id_column, text_column).where(F.col(id_column) != F.col("class_id"))
        return docs.join(gone.select(id_column).distinct(), id_column, "left_anti").select(*docs.columns)
    key = free_name(docs.columns, "key")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "ngram-rows")
    own = keyed.where(F.col(id_column).isNotNull()).select(F.col(key).alias("node"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    once = written(links(own, "node", "text").select("node", "class_id").join(own.select("node", "id"), "node"), "ngram-once")
    first = once.groupBy("class_id").agg(F.min(F.struct("id", "node")).alias("first"))
    gone = once.join(first, "class_id").where("node <> first.node").select(F.col("node").alias(key))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)

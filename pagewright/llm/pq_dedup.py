"""Embedding near-duplicates by product quantisation.

Equal vectors are one class, whose representative goes to a coarse inverted list; residuals are coded by sub-space
codebooks. Each representative probes its nearest lists: table look-ups give asymmetric distances to the codes there.
Only those that have something near them fetch their vectors and are ranked again by exact cosine. Lists are worked on in
blocks of bounded size that give one row for each linked vector, never one for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import groups, written
from pagewright.llm.components import components

THRESHOLD = 0.93
#: At most this many different vectors (those that hash lowest), of this many bytes in all, train the index; every vector is indexed.
TRAIN_ROWS = 65_536
TRAIN_BYTES = 64 << 20
#: Rows of the sample for each list.
ROWS_A_LIST = 4
#: Share of the pairs right at the threshold of which one is to probe the other's list; the number of probes is measured by it.
RECALL = 0.99
TUNE_ROWS = 1_000
#: Rows of the sample that train the codebooks.
BOOK_ROWS = 16_384
SUBSPACES = 8
CODES = 256
#: Members and queries of one block; pairs that are compared at once.
CHUNK = 8_192
TILE = 1 << 21


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, in slices of bounded memory; the lowest index on ties."""
    half = 0.5 * (centres**2).sum(1)
    step = max(1, (4 << 20) // max(1, len(centres)))
    return np.concatenate([(x[k : k + step] @ centres.T - half).argmax(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def apart(x: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """The first rows of length 1, at most k, of which no two have a cosine of the threshold or more."""
    chosen = x[:0]
    for at in range(0, len(x), 512):
        block = x[at : at + 512]
        free = (block @ chosen.T < threshold).all(1)
        near = block @ block.T >= threshold
        for row in range(len(block)):
            if free[row]:
                free[row + 1 :] &= ~near[row, row + 1 :]
        chosen = np.concatenate([chosen, block[free]])[:k]
        if len(chosen) == k:
            break
    return chosen


def kmeans(x: np.ndarray, k: int, rounds: int = 10, start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's rounds from the start, or else from evenly spaced rows; a centre without rows stays."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy() if start is None else start.copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        there, first, n = np.unique(own[order], return_index=True, return_counts=True)
        centres[there] = np.add.reduceat(x[order], first) / n[:, None]
    return centres


class Index:
    """Coarse centres and the codebooks of the residuals' sub-spaces.

    Copies count once, and no two centres start within a link of each other: a hot group, be it of equal or of near
    vectors, must not take the lists that probes are for. Centres without rows are dropped.
    """

    def __init__(self, sample: np.ndarray, lists: int, threshold: float = THRESHOLD):
        sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
        # probes are measured by rows that the centres haven't seen, if there are enough
        aside = min(TUNE_ROWS, len(sample) // 10)
        unseen, sample = (sample[-aside:], sample[:-aside]) if aside >= 50 else (sample, sample)
        centres = kmeans(sample, lists, start=apart(sample, lists, threshold))
        self.centres = centres[np.unique(nearest(sample, centres))]
        sample = sample[:BOOK_ROWS]
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], CODES, 6) for a, b in zip(self.cuts, self.cuts[1:])]
        self.width = self.tuned(unseen, threshold)

    def tuned(self, sample: np.ndarray, threshold: float, recall: float = RECALL) -> int:
        """The least number of probes by which pairs right at the threshold meet: rows of the sample, and each turned by the threshold's angle in a random direction."""
        rng = np.random.default_rng(7)
        a = sample[rng.choice(len(sample), min(TUNE_ROWS, len(sample)), replace=False)]
        side = rng.normal(size=a.shape)
        side -= (side * a).sum(1, keepdims=True) * a
        b = threshold * a + math.sqrt(1 - threshold**2) * side / np.maximum(np.sqrt((side**2).sum(1, keepdims=True)), 1e-300)
        needed = np.sort(np.concatenate([np.minimum(self.place(x, y), self.place(y, x)) for x, y in ((a[k : k + 250], b[k : k + 250]) for k in range(0, len(a), 250))]))
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1

    def place(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many lists each row would probe before the list of the other row."""
        far = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        there = far[np.arange(len(x)), nearest(other, self.centres)]
        return (far < there[:, None]).sum(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its codes stand for."""
        residual = x - self.centres[own]
        codes = np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)
        return codes, np.sqrt(((residual - self.decode(codes)) ** 2).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)

    def probes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The nearest lists of each vector, its own first."""
        far = -2 * x @ self.centres.T + (self.centres**2).sum(1)
        far[np.arange(len(x)), own] = -np.inf
        return np.argsort(far, 1, kind="stable")[:, : self.width]

    def distances(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to codes of a list, by a table of each sub-space."""
        residual = queries - self.centres[centre]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            part = residual[:, a:b]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += table.astype(np.float32)[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))


def matrix(cells: list[bytes], dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), dimension)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components there and finite, not all zero."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda v: v != 0)


#: What is stored of a vector: its list, the lists it probes, the codes of its residual and how far they are off, and a brief of one byte for each component with its scale and how far that is off.
CODED = "label string, d1 long, d2 long, id long, own int, probes array<int>, codes binary, error float, brief binary, scale float, slack float"


def coded(vectors: DataFrame, index, dimension: int) -> DataFrame:
    """CODED of (label, d1, d2, id, vector). Distances that say how far something is off are rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = index.value
        for batch in batches:
            x = unit(np.array(batch.column(4).flatten(), float).reshape(-1, dimension))
            own = nearest(x, model.centres)
            codes, error = model.encode(x, own)
            probes = model.probes(x, own).astype(np.int32)
            scale = (np.abs(x).max(1, initial=0) / 127).astype(np.float32)
            brief = np.rint(x / scale[:, None].astype(float)).clip(-127, 127).astype(np.int8)
            slack = np.sqrt(((x - brief * scale[:, None].astype(float)) ** 2).sum(1))
            up = lambda v: pa.array((v * (1 + 1e-6) + 1e-6).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(own.astype(np.int32)), pa.array(list(probes), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), up(error),
                 pa.array([c.tobytes() for c in brief], pa.binary()), pa.array(scale), up(slack)],
                names=["label", "d1", "d2", "id", "own", "probes", "codes", "error", "brief", "scale", "slack"],
            )

    return vectors.select("label", "d1", "d2", "id", "vector").mapInArrow(run, CODED)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x**2).sum(1, keepdims=True)) if len(x) else x


def halves(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the members (kind 0) and of the queries (kind 1) of a block."""
    kind = block["kind"].to_numpy()
    return np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)


def near_rows(index: Index, block: pa.Table, threshold: float) -> np.ndarray:
    """Numbers of the rows of a block that may have another one near them, by table look-ups."""
    m, q = halves(block)
    if not len(m) or not len(q):
        return m[:0]
    rep, slack = block["rep"].to_numpy(), block["slack"].to_numpy()
    raw = block["code"].combine_chunks()
    codes = np.frombuffer(b"".join(raw.take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
    brief = np.frombuffer(b"".join(raw.take(pa.array(q)).to_pylist()), np.int8).reshape(len(q), -1) * block["scale"].to_numpy()[q, None].astype(float)
    centre = block["list"][0].as_py()
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-4
    hit_m, hit_q = np.zeros(len(m), bool), np.zeros(len(q), bool)
    step = max(1, TILE // len(m))
    for at in range(0, len(q), step):
        own = q[at : at + step]
        # a member is at most its error away from what its codes stand for, a query its slack from its brief
        close = index.distances(brief[at : at + step], centre, codes) <= radius + slack[m][None, :] + slack[own][:, None]
        close &= rep[own][:, None] != rep[m][None, :]
        hit_m |= close.any(0)
        hit_q[at : at + step] = close.any(1)
    return np.concatenate([m[hit_m], q[hit_q]])


def reached(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and of the columns of a matrix of links; -1 without links. Each row and column is walked once."""
    rows, columns = np.full(len(link), -1), np.full(link.shape[1], -1)
    for start in np.flatnonzero(link.any(1)):
        if rows[start] >= 0:
            continue
        rows[start], wave = start, np.array([start])
        while len(wave):
            new = np.flatnonzero(link[wave].any(0) & (columns < 0))
            columns[new] = start
            wave = np.flatnonzero(link[:, new].any(1) & (rows < 0)) if len(new) else new
            rows[wave] = start
    return rows, columns


def link_block(block: pa.Table, threshold: float, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, peer) for the rows of a block that link: links count vectors, peer is the least rep that the block's links reach."""
    m, q = halves(block)
    none = np.zeros(0, np.int64)
    if not len(m) or not len(q):
        return none, none, none
    x = unit(block["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dimension).astype(float))
    rep, copies, own = block["rep"].to_numpy(), block["copies"].to_numpy().astype(float), block["own"].to_numpy()
    # a member finds the query too if it probes the query's list; else the link is counted for both here
    homes, home = np.unique(own[q], return_inverse=True)
    probed = np.array(block["probes"].combine_chunks().take(pa.array(m)).to_pylist(), np.int64).reshape(len(m), -1)
    probing = np.stack([(probed == h).any(1) for h in homes])
    link = np.zeros((len(q), len(m)), bool)
    n_q, n_m = np.zeros(len(q)), np.zeros(len(m))
    step = max(1, TILE // len(m))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        found = (x[q[part]] @ x[m].T >= threshold) & (rep[q[part]][:, None] != rep[m][None, :])
        link[part] = found
        n_q[part] = found @ copies[m]
        n_m += copies[q[part]] @ (found & ~probing[home[part]])
    rows, columns = reached(link)
    node = np.concatenate([rep[q][rows >= 0], rep[m][columns >= 0]])
    number = np.concatenate([rows[rows >= 0], columns[columns >= 0]])
    least = np.full(len(q), np.iinfo(np.int64).max)
    np.minimum.at(least, number, node)
    return node, np.concatenate([n_q[rows >= 0], n_m[columns >= 0]]).astype(np.int64), least[number]


BLOCK = ["label", "list", "i", "j"]


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows of (label, list, kind, rep) in blocks (i, j) of at most CHUNK members and CHUNK queries; sizes holds the chunks of each list."""
    member = F.col("kind") == 0
    out = rows.join(sizes, ["label", "list"]).withColumn("chunk", F.pmod(F.xxhash64("rep", "list"), F.when(member, F.col("mc")).otherwise(F.col("qc"))).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(member, F.col("qc")).otherwise(F.col("mc")) - 1)))
    return out.withColumn("i", F.when(member, F.col("chunk")).otherwise(F.col("other"))).withColumn("j", F.when(member, F.col("other")).otherwise(F.col("chunk"))).drop("mc", "qc", "chunk", "other")


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)


def linked(sound: DataFrame, dimension: int, different: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes (label, d1, d2, rep, copies) of (label, d1, d2, id, vector), vectors of one length of which about so many differ, and (rep, links, peer) of those that link to other classes."""
    spark = sound.sparkSession
    # copies fall into the sample together, and count once there
    rows = max(1, min(TRAIN_ROWS, TRAIN_BYTES // (8 * dimension)))
    share = min(1.0, 1.25 * rows / max(1, different) + 0.001)
    order = F.xxhash64("vector")
    sample = lambda some: some.select("vector").distinct().orderBy(order, "vector").limit(rows).toArrow()
    taken = sample(sound.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))))
    if not taken.num_rows:
        taken = sample(sound)
    training = unit(np.array(taken["vector"].combine_chunks().flatten(), float).reshape(-1, dimension))
    lists = max(1, min(int(math.sqrt(different) / 2), len(training) // ROWS_A_LIST))
    index = spark.sparkContext.broadcast(Index(training, lists, threshold))  # bounded by the sample
    stored = [F.any_value(c).alias(c) for c in ("own", "probes", "codes", "error", "brief", "scale", "slack")]
    reps = written(coded(sound, index, dimension).groupBy("label", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *stored), "pq-classes")
    sizes = reps.select("label", F.col("own").alias("list"), F.lit(0).alias("kind")).unionByName(reps.select("label", F.explode("probes").alias("list"), F.lit(1).alias("kind")))
    sizes = sizes.groupBy("label", "list").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("members"), F.count(F.when(F.col("kind") == 1, 1)).alias("queries"))
    # a list's members all probe it, so two queries are the least that can make a link
    sizes = sizes.where("members > 0 AND queries > 1").select("label", "list", F.ceil(F.col("members") / CHUNK).cast("int").alias("mc"), F.ceil(F.col("queries") / CHUNK).cast("int").alias("qc"))
    members = reps.select("label", F.col("own").alias("list"), F.lit(0).cast("byte").alias("kind"), "rep", F.col("codes").alias("code"), F.col("error").alias("slack"), F.lit(0).cast("float").alias("scale"))
    queries = reps.select("label", F.explode("probes").alias("list"), F.lit(1).cast("byte").alias("kind"), "rep", F.col("brief").alias("code"), "slack", "scale")
    blocks = in_blocks(dealt(members.unionByName(queries), sizes))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, BLOCK):
            if len(hit := near_rows(index.value, block, threshold)):
                yield from block.select([*BLOCK, "kind", "rep"]).take(pa.array(hit)).to_batches()

    near = written(blocks.mapInArrow(look, "label string, list int, i int, j int, kind byte, rep long"), "pq-near")
    vectors = sound.select(F.col("id").alias("rep"), "vector").join(near.select("rep").distinct(), "rep")
    full = near.join(reps.select("rep", "copies", "own", "probes"), "rep").join(vectors, "rep")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, BLOCK):
            found = link_block(block, threshold, dimension)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["rep", "links", "peer"])

    found = written(in_blocks(full).mapInArrow(rank, "rep long, links long, peer long"), "pq-links")
    return reps.select("label", "d1", "d2", "rep", "copies"), found


def links(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept): a row for each row of vectors.

    Vectors link if their labels (of any type that casts to a string) are equal and their cosine in double precision is
    the threshold or more. A vector that is null, empty or zero, or holds null or non-finite components, or has a null
    label, links with nothing, and vectors of different lengths don't link; each length has an index of its own, made one
    after the other. Nor does one link with a null id, whose component and kept are null too. The id must be an integer.
    Equal rows of one id are one vector; rows of one id that differ are vectors of their own, which link like others.
    Links that the index misses are missing for both sides. Other columns are not read.
    """
    kind = vectors.schema[vector_column].dataType.simpleString()
    vector = F.col(vector_column) if kind in ("array<float>", "array<double>") else F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), vector.alias("vector"))
    if rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count():
        return _repeated(rows, threshold).withColumnRenamed("id", id_column)
    rows = rows.withColumns({"d1": F.xxhash64("vector"), "d2": F.xxhash64(F.lit(1), "vector")})
    sound = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    lengths = sound.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct("d1").alias("different")).where("n > 1").orderBy("d").collect()
    none = F.lit(0).cast("long")
    if not lengths:
        return rows.select("id", none.alias("n_links"), F.col("id").alias("component_id"), F.when(F.col("id").isNotNull(), F.lit(True)).alias("kept")).withColumnRenamed("id", id_column)
    made = [linked(sound.where(F.size("vector") == r["d"]), r["d"], r["different"], threshold) for r in lengths]
    reps, found = (reduce(DataFrame.unionByName, x) for x in zip(*made))
    near = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    reps = reps.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(near.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("label", "d1", "d2", (F.col("copies") - 1 + F.coalesce("links", none)).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    # what links with nothing has no class: its label is taken away for the join
    known = rows.select("id", "d1", "d2", F.when(usable(F.col("vector")) & F.col("id").isNotNull(), F.col("label")).alias("label")).join(reps, ["label", "d1", "d2"], "left")
    component = F.coalesce("component", "id")
    return known.select("id", F.coalesce("n_links", none).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")).withColumnRenamed("id", id_column)


def _repeated(rows: DataFrame, threshold: float) -> DataFrame:
    """links() of (id, label, vector) where ids repeat: the different rows are numbered, and the numbers link."""
    nodes = written(rows.where("id IS NOT NULL").distinct().withColumn("node", F.monotonically_increasing_id()), "pq-nodes")
    once = links(nodes, "node", "vector", "label", threshold).join(nodes.select("node", F.col("id").alias("of")), "node")
    least = once.groupBy("component_id").agg(F.min("of").alias("component"))
    once = written(once.join(least, "component_id").select("node", "n_links", "component"), "pq-once")
    own = nodes.join(once, "node").select(F.col("id").alias("id_"), F.col("label").alias("label_"), F.col("vector").alias("vector_"), "n_links", "component")
    same = (F.col("id") == F.col("id_")) & F.col("label").eqNullSafe(F.col("label_")) & F.col("vector").eqNullSafe(F.col("vector_"))
    out = rows.join(own, same, "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))

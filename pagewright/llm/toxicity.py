"""Toxicity by a linear classifier on character n-grams whose presence is scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import free_name, slices, written

SIZES = (3, 4, 5, 6)
BITS = 22
#: At most this many labelled rows of each class train the model: those whose ids hash lowest.
TRAIN_ROWS = 8_000
#: N-grams that the model keeps, those that tell the classes apart best; 65,536 at most. They must occur in so many texts of a class.
FEATURES = 8_192
LEAST_TOXIC, LEAST_CLEAN = 3, 30
THRESHOLD = 0.3
SLICE = 1 << 20
#: Features of rows that are summed at once on the driver.
BLOCK = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size (buckets, index of the text) of all n-grams of lower-cased texts with a space at either end."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace") if t else b"", np.uint32) for t in texts]
    length = np.array([len(c) for c in codes], np.int64)
    owner = np.repeat(np.arange(len(texts)), length)
    flat = np.concatenate(codes).astype(np.uint64) if texts else np.zeros(0, np.uint64)
    rolled = flat.copy()
    for n in range(2, max(SIZES) + 1):
        if len(flat) < n:
            return
        rolled = rolled[: len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :]
        if n in SIZES:
            keep = owner[: len(rolled)] == owner[n - 1 :]
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (mixed >> np.uint64(64 - BITS))[keep].astype(np.int32), owner[: len(rolled)][keep]


def present(texts: list[str | None], lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, feature), each once, of n-grams that lookup numbers."""
    pairs = []
    for bucket, owner in buckets(texts):
        feature = lookup[bucket]
        hit = feature >= 0
        pairs.append(owner[hit] * np.int64(FEATURES) + feature[hit])
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return pairs // FEATURES, pairs % FEATURES


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, rows: int) -> DataFrame:
    """(id, toxic, text) of at most rows labelled documents of each class, as a written table. Null labels and ids are left out; of a repeated id, the higher label counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # only rows near the lowest hashes are sorted, so that the sort stays as small as the sample however many labels there are
    near = lambda one: int(min(1.0, (1.1 * rows + 200) / max(1, size.get(one, 0))) * (1 << 30))
    parts = [known.where((F.col("toxic") == one) & (F.col("h") < near(one))).orderBy("h", "doc_id").limit(rows).select(F.col("doc_id").alias("id"), "toxic") for one in (1, 0)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * rows rows of 12 bytes
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return written(texts.join(picked, "id"), "toxicity-train")


def document_counts(train: DataFrame) -> DataFrame:
    """(bucket, clean, toxic): in how many training texts of either class a bucket occurs, without the rarest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        stamp = np.zeros(1 << BITS, np.int64)
        for batch in slices(batches, "text", SLICE):
            toxic = np.array(batch.column(0).to_pylist(), np.int64)
            for bucket, owner in buckets(batch.column(1).to_pylist()):
                for one in (0, 1):
                    own = toxic[owner] == one
                    b, o = bucket[own], owner[own]
                    # n-grams of a text stand together: the last of each bucket in a text counts, found without sorting all
                    for start, end in zip(*_runs(o)):
                        part = b[start:end]
                        order = np.arange(len(part))
                        stamp[part] = order
                        total[one][part[stamp[part] == order]] += 1
        found = np.flatnonzero(total.sum(0))
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[0][part]), pa.array(total[1][part])], names=["bucket", "clean", "toxic"])

    rows = train.select("toxic", "text").mapInArrow(count, "bucket int, clean int, toxic int")
    return rows.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where((F.col("toxic") >= LEAST_TOXIC) | (F.col("clean") >= LEAST_CLEAN))


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(owner)) + 1
    return (np.concatenate([[0], edge]), np.concatenate([edge, [len(owner)]])) if len(owner) else (edge[:0], edge[:0])


class Model:
    """Bucket numbers, a weight for each (ratio times fitted weight) and the bias."""

    def __init__(self, chosen: np.ndarray, weight: np.ndarray, bias: float):
        self.chosen, self.weight, self.bias = chosen, weight, bias

    def lookup(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.chosen] = np.arange(len(self.chosen))
        return out

    def score(self, texts: list[str | None], lookup: np.ndarray) -> np.ndarray:
        owner, feature = present(texts, lookup)
        z = self.bias + np.bincount(owner, self.weight[feature], minlength=len(texts)) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Presence:
    """Which features each row has, as two bytes a feature; unpacked from bit rows and walked in blocks of bounded size."""

    def __init__(self, bits: list[bytes], width: int):
        self.width, parts, sizes = width, [], []
        for at in range(0, len(bits), 1_024):
            block = np.unpackbits(np.frombuffer(b"".join(bits[at : at + 1_024]), np.uint8).reshape(-1, len(bits[0])), axis=1)[:, :width]
            parts.append(np.nonzero(block)[1].astype(np.uint16))
            sizes.append(block.sum(1, dtype=np.int64))
        self.cols, self.sizes = np.concatenate(parts), np.concatenate(sizes)
        self.ends = np.cumsum(self.sizes)
        cuts = np.searchsorted(self.ends, np.arange(0, self.ends[-1] + BLOCK, BLOCK)[1:], side="right")
        self.blocks = sorted({0, *cuts.tolist(), len(bits)})

    def __iter__(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, their sizes, their features) by blocks."""
        for a, b in zip(self.blocks, self.blocks[1:]):
            first = self.ends[a] - self.sizes[a]
            yield slice(a, b), self.sizes[a:b], self.cols[first : self.ends[b - 1]]

    def times(self, v: np.ndarray) -> np.ndarray:
        """The sum of v over the features of each row."""
        out = np.zeros(len(self.sizes))
        for rows, sizes, cols in self:
            some = np.flatnonzero(sizes)
            if len(some):
                out[rows.start + some] = np.add.reduceat(v[cols], (np.cumsum(sizes) - sizes)[some])
        return out

    def turned(self, g: np.ndarray) -> np.ndarray:
        """The sum of g over the rows of each feature."""
        return sum((np.bincount(cols, np.repeat(g[rows], sizes), minlength=self.width) for rows, sizes, cols in self), np.zeros(self.width))


def fit_linear(x: Presence, ratio: np.ndarray, y: np.ndarray, steps: int = 250, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio by accelerated gradient steps of fixed number, so that runs agree."""
    w, b = np.zeros(x.width), 0.0
    v, c = w, b
    step = 4 / min(x.times(ratio**2).max(initial=0) + 1, 400.0)
    best = (np.inf, w, b)
    for k in range(steps):
        z = c + x.times(ratio * v)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = -np.mean(np.where(y > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12))) + ridge / 2 * (v @ v)
        if loss < best[0]:
            best = (loss, v, c)
        elif loss > 1.5 * best[0] + 1e-9:  # too long a step
            step /= 2
            w, b = best[1], best[2]
            v, c = w, b
            continue
        g = (p - y) / len(y)
        w2, b2 = v - step * (ratio * x.turned(g) + ridge * v), c - step * g.sum()
        m = k / (k + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return best[1], best[2]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on at most rows rows of each class. Without rows of both classes, all scores equal the share of toxic labels."""
    sample = training_rows(docs, labels, id_column, text_column, rows)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 if size.get(1) else -40.0)
    # G statistic of presence against class; the best FEATURES buckets come to the driver
    a, c = (F.col(x).cast("double") for x in ("toxic", "clean"))
    n1, n0 = (F.lit(float(size[x])) for x in (1, 0))
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    share = (a + c) / (n1 + n0)
    g = term(a, n1 * share) + term(c, n0 * share) + term(n1 - a, n1 * (1 - share)) + term(n0 - c, n0 * (1 - share))
    top = document_counts(sample).select("bucket", "toxic", "clean", F.round(g, 6).alias("g")).orderBy(F.desc("g"), "bucket").limit(FEATURES).toPandas().sort_values("bucket")
    chosen = top["bucket"].to_numpy(np.int64)
    p, q = top["toxic"].to_numpy(float) + 1, top["clean"].to_numpy(float) + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(Model(chosen, ratio, 0.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value.lookup()
        for batch in slices(batches, "text", SLICE):
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                owner, feature = present(part.column(2).to_pylist(), lookup)
                has = np.zeros((part.num_rows, FEATURES), bool)
                has[owner, feature] = True
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([row.tobytes() for row in np.packbits(has, axis=1)], pa.binary())], names=["id", "toxic", "bits"])

    # a bit for each feature of each sampled row: 2 * rows * FEATURES / 8 bytes at most, however long the texts are
    kind = T.StructType([sample.schema["id"], T.StructField("toxic", T.IntegerType()), T.StructField("bits", T.BinaryType())])
    got = sample.select("id", "toxic", "text").mapInArrow(features, kind).toArrow()
    rows_ = sorted(zip(map(str, got["id"].to_pylist()), got["toxic"].to_pylist(), got["bits"].to_pylist()))
    weight, bias = fit_linear(Presence([r[2] for r in rows_], len(chosen)), ratio, np.array([r[1] for r in rows_], float))
    # the classes were taken in equal numbers at most: the bias goes back to the shares among all labels that may be learned from
    all_rows = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.sum((F.col("toxic") > 0).cast("long")).alias("one"), F.count("*").alias("n")).first()
    bias += np.log(all_rows["one"] / (all_rows["n"] - all_rows["one"])) - np.log(size[1] / size[0])
    return Model(chosen, weight * ratio, float(bias))


def score(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (named otherwise if docs has such columns). Null and empty texts score by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [free_name(docs.columns, "score"), free_name(docs.columns, "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = model.lookup()
        for batch in slices(batches, text_column, SLICE):
            p = model.score(batch.column(batch.schema.get_field_index(text_column)).to_pylist(), lookup)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def reject(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without those predicted toxic. Null and empty texts score by the bias; repeated rows stay or go together; an empty table stays empty. Other columns pass through, whatever their names."""
    scored = score(docs, train(docs, labels, id_column, text_column), text_column)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)

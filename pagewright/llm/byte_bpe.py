"""Byte-level BPE by DuckDB recursive queries.

Texts are split by the tokenizer's pattern; the distinct pieces of a batch become token-position rows. A recursive
query joins neighbours with the merge table and contracts each word's leftmost pair of minimum rank until none is left.
Decoding joins ids with the vocabulary and concatenates the bytes by an ordered aggregation.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import free_name, slices

#: Bytes of pieces that one recursive query holds; pieces, and bytes of them, in each of the two generations that a worker remembers; longer pieces than LONG are not remembered.
QUERY_BYTES = 400_000
MEMORY = 250_000
MEMORY_BYTES = 8 << 20

#: Each step unnests a word's tokens to rows of a position and its neighbour, joins them with the merge table, and contracts the least rank's leftmost pair; ranks are token ids, and positions take 20 bits beside them.
CONTRACT = """
WITH RECURSIVE state(word, toks, step) AS (
    SELECT word, toks, 0 FROM start
  UNION ALL
    SELECT s.word, list_concat(list_append(s.toks[:(b.best & 1048575) - 1], CAST(b.best >> 20 AS INTEGER)), s.toks[(b.best & 1048575) + 2:]), s.step + 1
    FROM state s
    JOIN (
        SELECT word, min((CAST(m.merged AS BIGINT) << 20) + pos) AS best
        FROM (SELECT word, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS after, unnest(range(1, len(toks))) AS pos FROM state) p
        JOIN merges m ON m.l = p.tok AND m.r = p.after
        GROUP BY word
    ) b ON b.word = s.word
)
SELECT word, arg_max(toks, step) AS toks FROM state GROUP BY word
"""
#: The same rule for long pieces, at many places in each step. {0} is the length of the longest token of the piece's
#: bytes. A token that grows from further away can't reach a pair, so a pair whose rank is the least among {0} neighbours on
#: either side (least) is contracted before them, if pairs of its own rank to its left leave it alone. So pairs of one rank
#: make groups with gaps of {0} at most, which go from left to right: every second one of a run of neighbours, up to the
#: first that is not least, or whose contraction makes a pair of a lower rank (lower). The others wait for the next step.
LONG = 512
CONTRACT_LONG = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
    SELECT word, toks FROM start
  UNION
    SELECT word, list(CASE WHEN chosen THEN rank ELSE tok END ORDER BY pos) FILTER (WHERE NOT gone) AS toks
    FROM (
        SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS gone
        FROM (
            SELECT *, may AND NOT coalesce(bool_or(lower) OVER (PARTITION BY word, rank, cluster ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS chosen
            FROM (
                SELECT t.*, coalesce(may AND (x.merged < t.rank OR y.merged < t.rank), false) AS lower
                FROM (
                    SELECT *, CASE WHEN may THEN CASE WHEN lag(may, 2) OVER (PARTITION BY word ORDER BY pos) AND lag(rank, 2) OVER (PARTITION BY word ORDER BY pos) = rank THEN rank
                                                      ELSE lag(tok) OVER (PARTITION BY word ORDER BY pos) END END AS before,
                              CASE WHEN may THEN lead(tok, 2) OVER (PARTITION BY word ORDER BY pos) END AS beyond
                    FROM (
                        SELECT *, bool_and(least) OVER (PARTITION BY word, rank, cluster ORDER BY pos) AND (pos - run) % 2 = 0 AS may
                        FROM (
                            SELECT *, max(CASE WHEN gap > 1 THEN pos END) OVER (PARTITION BY word, rank ORDER BY pos) AS run,
                                   max(CASE WHEN gap > {0} THEN pos END) OVER (PARTITION BY word, rank ORDER BY pos) AS cluster
                            FROM (SELECT p.word, p.pos, p.tok, m.merged AS rank,
                                         coalesce(rank = min(rank) OVER (PARTITION BY p.word ORDER BY p.pos ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING), false) AS least,
                                         coalesce(p.pos - lag(p.pos) OVER (PARTITION BY p.word, rank ORDER BY p.pos), 1073741824) AS gap
                                  FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS after
                                        FROM (SELECT word, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM state)) p
                                  LEFT JOIN merges m ON m.l = p.tok AND m.r = p.after)
                        )
                    )
                ) t
                LEFT JOIN merges x ON x.l = t.before AND x.r = t.rank
                LEFT JOIN merges y ON y.l = t.rank AND y.r = t.beyond
            )
        )
    )
    GROUP BY word HAVING bool_or(chosen)
)
SELECT word, toks FROM state
"""
DECODE = "SELECT word, string_agg(v.bytes, '' ORDER BY pos) AS bytes FROM ids JOIN vocabulary v USING (tok) GROUP BY word"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base-64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Bpe:
    """One worker's DuckDB connection with the merge table, and the pieces it has seen lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        # ids (as 32-bit integers) by piece, of this generation and of the one before; what decodes to other bytes than its own stands apart
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held, self.apart = 0, {}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.most = max(map(len, ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int32) for x in (zip(*pairs) if pairs else ((), (), ())))
        self._table("merges", l=left, r=right, merged=merged)
        self._table("vocabulary", tok=np.array(list(ranks.values()), np.int32), bytes=[t.hex() for t in ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("rows_", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_")
        self.db.unregister("rows_")

    def learn(self, pieces: list[str]) -> None:
        """Codes pieces that are not known."""
        size, group = 0, []
        for piece in pieces:
            group.append((piece, raw := piece.encode("utf-8", "replace")))
            size += len(raw)
            if size >= QUERY_BYTES:
                self._learn(group)
                size, group = 0, []
        if group:
            self._learn(group)

    def _learn(self, group: list[tuple[str, bytes]]) -> None:
        # a piece that is a token as a whole is that token
        rest = [k for k, (_, raw) in enumerate(group) if raw not in self.ranks and len(raw) <= LONG]
        word = [k for k, (_, raw) in enumerate(group) if raw in self.ranks]
        size, tok = [1] * len(word), [self.ranks[group[k][1]] for k in word]
        if rest:
            ends = np.cumsum([0, *(len(group[k][1]) for k in rest)]).astype(np.int32)
            start = self.bytes[np.frombuffer(b"".join(group[k][1] for k in rest), np.uint8)]
            self._table("start", word=np.array(rest, np.int32), toks=pa.ListArray.from_arrays(pa.array(ends), pa.array(start)))
            done = self.db.sql(CONTRACT).to_arrow_table()
            lists = done["toks"].combine_chunks()
            word = np.concatenate([np.array(word, np.int32), done["word"].to_numpy()])
            size = np.concatenate([np.array(size, np.int64), np.diff(lists.offsets.to_numpy())])
            tok = np.concatenate([np.array(tok, np.int32), lists.flatten().to_numpy()])
        word, size, tok = np.asarray(word, np.int32), np.asarray(size, np.int64), np.asarray(tok, np.int32)
        for k in (k for k, (_, raw) in enumerate(group) if raw not in self.ranks and len(raw) > LONG):
            ids = self._long(group[k][1])
            word, size, tok = np.append(word, np.int32(k)), np.append(size, len(ids)), np.concatenate([tok, ids])
        first = np.cumsum(size) - size
        self._table("ids", word=np.repeat(word, size), pos=(np.arange(len(tok)) - np.repeat(first, size)).astype(np.int32), tok=tok)
        raw = dict(self.db.execute(DECODE).fetchall())
        for k, at, n in zip(word.tolist(), first.tolist(), size.tolist()):
            piece, own = group[k]
            self.known[piece] = tok[at : at + n].tobytes()
            self.held += len(own)
            if raw[k] != own.hex():
                self.apart[piece] = bytes.fromhex(raw[k])

    def _long(self, raw: bytes) -> np.ndarray:
        self.db.execute(f"SET memory_limit = '{max(400, len(raw) // 2_500)}MB'")  # beyond a million bytes, what the piece takes
        held = set(raw)
        reach = max(len(t) for t in self.ranks if held.issuperset(t))
        self._table("start", word=np.zeros(1, np.int32), toks=pa.array([self.bytes[np.frombuffer(raw, np.uint8)]], pa.list_(pa.int32())))
        return self.db.sql(CONTRACT_LONG.format(reach)).to_arrow_table()["toks"].combine_chunks().flatten().to_numpy()

    def code(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text; ids are 32-bit integers."""
        if len(self.known) > MEMORY or self.held > MEMORY_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        split = [self.split(t) if t else [] for t in texts]
        fresh = []
        for piece in set(chain.from_iterable(split)).difference(self.known):
            if (ids := self.older.get(piece)) is not None:
                self.known[piece] = ids
                self.held += len(piece)
            else:
                fresh.append(piece)
        self.learn(sorted(fresh, key=len))
        ids = self.known.__getitem__
        out = [(b"".join(map(ids, pieces)), self.decoded(pieces)) for pieces in split]
        for piece in fresh:
            if len(piece) > LONG:
                del self.known[piece]
                self.apart.pop(piece, None)
        return out

    def decoded(self, pieces: list[str]) -> bytes:
        """What the ids of the pieces decode to, as it was found when they were learned."""
        if self.apart and not self.apart.keys().isdisjoint(pieces):
            return b"".join([self.apart.get(p) or p.encode("utf-8", "replace") for p in pieces])
        return "".join(pieces).encode("utf-8", "replace")


_worker: dict[str, Bpe] = {}


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, token_ids, decoded): a row for each row of docs. Null and empty texts have no ids and decode to no bytes.

    ranks_path is read on the driver; the vocabulary (a fixed file) is broadcast.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the collector would walk the remembered pieces again and again
        try:
            if (bpe := _worker.get(name)) is None:
                _worker.clear()
                bpe = _worker[name] = Bpe(*shared.value)
            for batch in slices(batches, "text", 2 << 20):
                ids, raw = map(list, zip(*bpe.code(batch.column(1).to_pylist())))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(raw, pa.binary())], names=["id", "token_ids", "decoded"])
        finally:
            gc.enable()

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))
    return out.select(F.col("id").alias(id_column), *[F.col(c).alias(free_name([id_column], c)) for c in ("token_ids", "decoded")])


def digest(coded: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, token_ids, decoded)."""
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )

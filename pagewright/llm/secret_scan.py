"""Secret scans: an Aho-Corasick pass finds keywords, anchored expressions run only at the hits, checksums embedded in tokens are validated."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import free_name, slices

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = ("assign", "access", "hex")
#: Keywords of the prefilter by kind, in lower case ("access" and the checksummed kinds are compared in their own case afterwards).
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
#: What an anchored match looks like.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CHECKED = {"github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def checksum62(body: bytes) -> bytes:
    """CRC-32 of the body as six base-62 digits, zero-padded."""
    n, out = zlib.crc32(body), []
    for _ in range(6):
        n, digit = divmod(n, 62)
        out.append(BASE62[digit])
    return bytes(out[::-1])


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def find(machine: ahocorasick.Automaton, text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, by start, then kind. Null and empty texts have none.

    Works on UTF-8 bytes: lower() there touches ASCII alone, and every pattern is ASCII. Hits come by their ends, so
    those of a kind are sorted by start; a match consumes its text even if it fails a length test, as a plain
    left-to-right scan would have it.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for end, (kind, length) in machine.iter(raw.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end + 1 - length)
    found = [("hex", *m.span()) for m in HEX.finditer(raw)]
    for kind, starts in hits.items():
        free = 0
        for at in sorted(starts):
            if at < free:
                continue
            if kind == "assign":
                if m := ASSIGN.match(raw, at):
                    free = m.end()
                    if m.end(1) - m.start(1) >= 6:
                        found.append((kind, at, free))
            elif kind == "access":
                if m := ACCESS.match(raw, at):
                    free = m.end()
                    if free - at >= 20:
                        found.append((kind, at, free))
            elif (m := CHECKED[kind].match(raw, at)) and checksum62(m[0][4:-6]) == m[0][-6:]:
                free = m.end()
                found.append((kind, at, free))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    if len(raw) == len(text):
        return found
    out, at, points = [], 0, 0
    for kind, start, end in found:
        points, at = points + len(raw[at:start].decode("utf-8", "surrogatepass")), start
        out.append((kind, points, points + end - start))  # matches are ASCII
    return out


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans): a row for each row of docs, repeated ones too; spans is empty for null or empty texts. A null id stays null. Other columns are not read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in slices(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(machine, text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, ARROW_SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    name = free_name([id_column], "spans")
    return rows.mapInArrow(scan, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", SPANS)])).select(F.col("id").alias(id_column), F.col("spans").alias(name))


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mask (overlapping spans by one).

    Null and empty texts and those without secrets stay as they are, repeated rows and null ids too; an empty table stays
    empty. Other columns pass through, whatever their names.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in slices(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            out = []
            for text in batch.column(at).to_pylist():
                parts, done = [], 0
                for _, start, end in find(machine, text):
                    if start >= done:
                        parts += [text[done:start], mask]
                    done = max(done, end)
                out.append(text if not parts else "".join(parts) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, spans)."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

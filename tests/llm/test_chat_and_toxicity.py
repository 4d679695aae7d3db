"""Operators 2 and 3."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat_format, queries, toxicity

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
key = lambda rows: sorted(map(tuple, rows), key=repr)


def test_chat_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = db.execute(queries.OP2_SQL).fetchall()
    got = queries.op2_chat_format(spark, SMALL)
    assert key(got.collect()) == key(want) and [c for c in got.columns] == [c[0] for c in db.description]


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|x", "<\\\\|im_start|>\n", "<", "|", "", None, "a\nb", "<|nl|>", "\\", "$1 \\1", "é🙂 <|"]
    rows = [(c, t, r, odd[(c * 5 + t * 7) % len(odd)], "x") for c in range(40) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "us<|er\n\\"][: 1 + c % 6])]
    rows += [(None, None, None, None, "x"), (7, 2, "assistant", "same", "y"), (7, 2, "assistant", "same", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    examples = chat_format.expand(frame).cache()
    back = {r["conv_id"]: r["turns"] for r in examples.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("f")).select("conv_id", chat_format.turns_of(F.col("f")).alias("turns")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for c, t, r, x, _ in rows if c == conv], key=lambda v: (v[0] or 0, v[1:]))
        assert [tuple(x) for x in back[conv]] == [x[1:] for x in own]
        made = sorted((e for e in examples.collect() if e["conv_id"] == conv), key=lambda e: e["example"])
        losses = [e["formatted"][e["loss_start"] : e["loss_end"]] for e in made if e["loss_start"] is not None]
        assert len(losses) == sum(r == "assistant" for _, r, _ in own)
        assert len(made) == len(losses) + (own[-1][1] != "assistant")
        assert all(e["formatted"].count(chat_format.START) == k for e, k in zip(made, [i + 1 for i, x in enumerate(own) if x[1] == "assistant" or i + 1 == len(own)]))
    assert chat_format.digest(chat_format.expand(frame.limit(0))).count() == 0


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.op3_toxicity(spark, MORE).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{MORE}/labels.parquet'").fetchall()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{MORE}/documents.parquet'").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in rows.items())
    test = np.array([(rows[d]["predicted"], t) for d, t in labels if rows[d]["held_out"]])
    assert np.mean(test[:, 0] == test[:, 1]) >= 0.95 and np.mean(test[test[:, 0] == 1, 1]) >= 0.95


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(k, ("vile " if k % 2 else "kind ") * 3 + f"word{k}", 1.0) for k in range(80)] + [(None, None, None), (81, "", 0.0), (81, "", 0.0), (82, "so vile", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.columns == ["doc_id", "text", "score", "_score", "predicted"] and scored.count() == 84
    got = {r["doc_id"]: r for r in scored.collect()}
    assert got[82]["predicted"] == 1 and all(got[k]["predicted"] == k % 2 for k in range(80)) and got[81]["_score"] == got[None]["_score"]
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert none.where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


@pytest.mark.parametrize("texts", [[], [None], ["", "ab"], ["a" * 50, "a" * 50, "b"]])
def test_presence(texts):
    lookup = np.zeros(1 << toxicity.BITS, np.int32)
    owner, feature = toxicity.present(texts, lookup)
    assert sorted(set(owner.tolist())) == owner.tolist()


def bucket_of(gram):
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - toxicity.BITS)


def grams(text):
    own = f" {text.lower()} " if text else ""
    return {bucket_of(own[k : k + n]) for n in toxicity.SIZES for k in range(len(own) - n + 1)}


def test_toxicity_by_brute_force(spark):
    """Document counts, log-count ratios, the fit's gradient and scores, against sets of n-grams of whole texts."""
    rng = np.random.default_rng(5)
    say = lambda bad: " ".join(rng.choice(["mild", "Table", "é river", "stone", "vile", "brute"] if bad else ["mild", "Table", "é river", "stone", "soft"], 12))
    texts = {k: say(k % 3 == 0) for k in range(150)} | {150: "", 151: None, 152: "mild " * 3_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in texts], "doc_id long, toxic int")
    learned = {k for k in texts if zlib.crc32(str(k).encode()) % 4 != 2}
    sets = {k: grams(t) for k, t in texts.items()}
    counts = {}
    for k in learned:
        for b in sets[k]:
            counts.setdefault(b, [0, 0])[k % 3 == 0] += 1
    kept = {b: (c, t) for b, (c, t) in counts.items() if t >= toxicity.LEAST_TOXIC or c >= toxicity.LEAST_CLEAN}
    sample = toxicity.training_rows(docs, labels, "doc_id", "text", toxicity.TRAIN_ROWS)
    assert {r["id"] for r in sample.collect()} == learned
    assert {r["bucket"]: (r["clean"], r["toxic"]) for r in toxicity.document_counts(sample).collect()} == kept
    model = toxicity.train(docs, labels)
    assert set(model.chosen.tolist()) == set(kept)  # fewer than FEATURES: all stay
    p, q = (np.array([kept[b][one] for b in model.chosen.tolist()], float) + 1 for one in (1, 0))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    rows = sorted(learned, key=str)
    x = np.array([[b in sets[k] for b in model.chosen.tolist()] for k in rows], float) * ratio
    y = np.array([k % 3 == 0 for k in rows], float)
    w = model.weight / ratio  # the weights before the ratios scale them
    own = model.bias  # every label was learned from, so the shares are those of the sample
    z = own + x @ w
    slope = x.T @ (1 / (1 + np.exp(-z)) - y) / len(y) + 1e-3 * w
    start = x.T @ (0.5 - y) / len(y)
    assert np.abs(slope).max() < 0.05 * np.abs(start).max()  # close to the least loss
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    weight = dict(zip(model.chosen.tolist(), model.weight.tolist()))
    for k in texts:
        want = 1 / (1 + np.exp(-(model.bias + sum(weight.get(b, 0.0) for b in sets[k]))))
        assert abs(got[k]["score"] - want) < 1e-9 and got[k]["predicted"] == int(got[k]["score"] >= 0.3)


def test_presence_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    has = rng.random((300, 37)) < rng.random((300, 1)) * 0.6
    has[40:60] = False
    bits = [row.tobytes() for row in np.packbits(has, axis=1)]
    for block in (1, 50, 1 << 20):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        x = toxicity.Presence(bits, 37)
        v, g = rng.random(37), rng.random(300)
        assert np.allclose(x.times(v), has @ v) and np.allclose(x.turned(g), has.T @ g)

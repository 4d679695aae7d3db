"""Every stage and operator on odd tables: nulls anywhere, empty and very long texts, repeated rows, clashing columns, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import byte_bpe, chat_format, decontamination, ngram_join, pii, queries, secret_scan, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, base string, spans string, id long, rep long, key string"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(30_000)}" if k % 8 == 0 else "".join(rng.choice("aeioulmnst") for _ in range(6)) for k in range(60_000)]
    words[30_000:30_000] = ["write", "to", "someone@mail.example.org", "with", "password=abcdefgh"]
    return " ".join(words)


@pytest.fixture(scope="module")
def odd(spark, long_text):
    rows = [(1, "plain words here", "en", "s", 16), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long_text, "en", "s", len(long_text)), (4, long_text, "en", "s", len(long_text)), (None, "plain words here", "en", "s", 16), (None, None, None, None, None), (5, "  \n\t ", "en", "s", 5), (6, "x" * 1_500 + " ha" * 50_000, "en", "s", 151_500), (7, "🙂 é \x00 \x01 � a@b.cc", "fr", "s", 15)]
    return spark.createDataFrame([(*r, 0.5, "h", "b", "s", 1, 2, "k") for r in rows], SCHEMA)


def test_stages(spark, odd, small):
    docs, seen = odd, odd.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
        rows = out.collect()
        assert len(rows) <= seen
        docs, seen = (spark.createDataFrame(rows, odd.schema), len(rows)) if out.columns == odd.columns else (docs, seen)
    kept = {r["doc_id"] for r in rows}
    assert {1, 2, 3, 4, 5, 6, 7, None} == kept


def test_stages_without_rows(spark, odd, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), small).count() == 0


def test_operators(spark, odd, small, long_text):
    items = spark.createDataFrame([(1, " ".join(long_text.split()[500:530])), (None, None), (2, "")], "item_id long, text string")
    n = odd.count()
    hits = decontamination.contamination(odd, items).collect()
    assert len(hits) == n and sum(r["hits"]["spans"] == [[500, 530]] for r in hits) == 2
    assert toxicity.score(odd, toxicity.train(odd, spark.read.parquet(f"{small}/labels.parquet"))).count() == n
    links = ngram_join.links(odd).collect()
    assert len(links) == n and all(r["n_links"] == 0 for r in links)
    found = pii.digest(pii.personal_data(odd)).where("doc_id = 4").collect()
    assert len(found) == 2 and all(r["n_email"] == 1 for r in found)
    assert secret_scan.digest(secret_scan.secret_spans(odd)).where("doc_id = 4 AND n_assign = 1").count() == 2
    assert substring_dedup.repeats(odd).count() == 0 and substring_dedup.remove_repeats(odd).count() == n
    coded = byte_bpe.round_trip(odd, queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["decoded"] for r in coded.collect()}
    assert texts[4].decode() == long_text and len(texts) == 8


def test_long_conversation(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(600)]
    got = chat_format.digest(chat_format.expand(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert got["n_turns"] == 600 and got["loss_chars"] == sum(len(t[3]) for t in turns if t[2] == "assistant")


def test_hot_key(spark):
    """A third of all rows in one group: copies, near copies, one vector label, one url."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    docs = [(k, " ".join(base)) for k in range(400)]
    docs += [(1000 + k, " ".join([*base[:k % 80], f"y{k}", *base[k % 80 + 1 :]])) for k in range(200)]
    docs += [(2000 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))) for k in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.links(frame).collect()}
    # one changed word of 80 leaves 71 of 76 n-grams: 71 / 81 with the base, 66 / 86 with another at least five words away
    assert all(got[k]["class_id"] == 0 and got[k]["n_links"] == 399 + 200 for k in range(400))
    assert all(got[2000 + k]["n_links"] == 0 for k in range(600)) and all(got[1000 + k]["class_id"] == 0 for k in range(200))
    repeats = substring_dedup.repeats(frame)
    assert repeats.where("doc_id BETWEEN 1 AND 399").count() == 399 and repeats.where("doc_id >= 2000 OR doc_id = 0").count() == 0
    assert frame.where(F.lit(False)).count() == 0

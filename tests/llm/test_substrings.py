"""Operator 10 against brute force."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import queries, substring_dedup
from pagewright.llm.common import words_of

SMALL = "/root/testdata/sf0.001"
WINDOW, LEAST = substring_dedup.WINDOW, substring_dedup.LEAST_WORDS


def slow_gear(raw):
    h, out = 0, []
    for b in raw:
        h = (2 * h + int(substring_dedup.GEAR[b])) % (1 << 32)
        out.append(h)
    return out


def slow_chunks(text):
    """{(first word, end word): chunk} by the definition."""
    words = words_of(text)
    cuts = []
    raw = b" " * WINDOW
    for k, w in enumerate(words):
        if k == 0 or slow_gear(raw[-WINDOW:])[-1] < int(substring_dedup.CUT * (1 << 32)):
            cuts.append(k)
        raw += w + b" "
    out = {}
    for c in cuts:
        end = next((e for e in cuts if e >= c + LEAST), len(words))
        if LEAST <= end - c <= substring_dedup.SURE_WORDS:
            out[c, end] = b" ".join(words[c:end])
    return out


def slow_repeats(docs, within=False):
    where = {}
    for doc, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for (a, b), chunk in slow_chunks(text).items():
            where.setdefault(chunk, []).append((doc, a, b))
    out = {}
    for found in where.values():
        for doc, a, b in found[1:]:
            if doc == found[0][0] and not within:
                continue
            words, firsts = out.setdefault(doc, (set(), set()))
            words |= set(range(a, b))
            firsts.add(found[0][0])
    return {d: (len(w), w, sorted(f)) for d, (w, f) in out.items()}


def as_sets(rows):
    return {r["doc_id"]: (r["n_words"], {k for s in r["spans"] for k in range(s["start"], s["end"])}, r["first_docs"]) for r in rows}


def test_gear_window():
    raw = bytes(random.Random(1).randrange(256) for _ in range(300))
    assert substring_dedup.gear(np.frombuffer(raw, np.uint8)).tolist() == slow_gear(raw)


def test_repeats(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    want = slow_repeats(docs)
    assert as_sets(queries.op10_substring_dedup(spark, SMALL).collect()) == want and len(want) > 5


def test_planted_passages(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passages = [say(60) for _ in range(40)]
    docs = [(k, say(50 + k) + ".\n" + passages[k % 40].upper() + "! " + say(30)) for k in range(80)]
    docs += [(200, say(400)), (201, None), (202, ""), (203, "short text"), (204, "short text"), (None, passages[0]), (205, passages[0]), (206, " ".join([passages[1]] * 3))]
    docs += [(207, "A common line of some thirteen words, which very many of the documents share.\n" + say(30)), (208, say(20) + " a common line of some thirteen words which very many of the documents share")]
    frame = spark.createDataFrame([(*d, len(d[1] or ""), "x") for d in docs], "doc_id long, text string, n_chars int, d1 string")
    assert as_sets(substring_dedup.repeats(frame).collect()) == slow_repeats(docs)
    got = as_sets(substring_dedup.repeats(frame, within=True).collect())
    assert got == slow_repeats(docs, within=True)
    caught = {k for k in range(40, 80) if k in got and got[k][2] == [k - 40]}
    assert len(caught) >= 39 and not {*range(40), 200, 207, 208} & set(got) and 205 in got
    clean = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame, within=True).collect()}
    assert clean[200]["text"] == docs[80][1] and 201 in clean and len(words_of(clean[206]["text"])) < 180
    one = clean[min(caught)]
    assert len(words_of(one["text"])) == len(words_of(docs[min(caught)][1])) - got[min(caught)][0] and one["n_chars"] == len(one["text"])
    assert substring_dedup.repeats(frame.limit(0)).count() == 0


def test_passages_of_few_words(spark):
    """Words that recur have few hashes, and often no cut; their passages are found nonetheless, and a run is no repeat of itself."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passages = [" ".join([rng.choice("abcdefgh") + str(k)] * 60) for k in range(40)]
    docs = [(k, say(30) + " " + passages[k % 40] + " " + say(30)) for k in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = as_sets(substring_dedup.repeats(frame).collect())
    assert all(k - 40 in got[k][2] and got[k][0] >= 40 for k in range(40, 80))
    assert not any(got[k][1] & set(range(30)) or got[k][1] & set(range(90, 120)) for k in got)
    bare = [k for k in range(40) if all(end == 60 for _, end in slow_chunks(passages[k]))]
    assert len(bare) > 5
    alone = passages[bare[0]]
    *_, repeat = substring_dedup.chunks([alone])
    assert not repeat.any()
    *_, start, words, repeat = substring_dedup.chunks([f"{alone} {say(40)} {alone}"])
    again = set().union(*(range(s, s + w) for s, w, r in zip(start, words, repeat) if r))
    assert again == set(range(100, 160))


def test_every_passage_holds_a_chunk():
    """Passages of few words or many, long words or short, between other words: a chunk is the same in both."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    for _ in range(300):
        letters = rng.choice((1, 2, 5, 40))
        vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(letters)) for _ in range(rng.choice((1, 2, 5, 8, 100)))]
        passage = " ".join(rng.choice(vocabulary) for _ in range(substring_dedup.SURE_WORDS))
        own, d1, d2, *_ = substring_dedup.chunks([f"{say(20)} {passage} {say(20)}", f"{say(7)} {passage}", passage])
        sets = [set(zip(d1[own == k].tolist(), d2[own == k].tolist())) for k in range(3)]
        assert sets[0] & sets[1] and sets[1] & sets[2]


def test_ids_and_names_of_any_kind(spark):
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(70))
    docs = [("b", f"{passage} end", 1, "p"), ("a", f"start {passage}", 1, "q"), ("c", None, None, "r"), ("d", "", 0, "s"), (None, passage, 1, "t"), ("b", f"{passage} end", 1, "p")]
    frame = spark.createDataFrame(docs, "doc_id string, text string, n_chars long, doc_id_ string").withColumn("spans_", F.lit(1)).withColumn("doc", F.lit("x"))
    got = substring_dedup.repeats(frame).collect()
    assert [(r["doc_id"], r["first_docs"]) for r in got] == [("b", ["a"])] and got[0]["n_words"] >= 50
    clean = substring_dedup.remove_repeats(frame)
    rows = sorted(clean.collect(), key=repr)
    assert clean.columns == frame.columns and len(rows) == 6 and sum(r["doc_id"] == "b" and len(r["text"]) < 150 and r["n_chars"] == len(r["text"]) for r in rows) == 2
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_many_repeats_in_one_text(spark):
    """A text of 200,000 words that repeats passages of another all over: its spans merge in one walk."""
    rng = random.Random(6)
    passages = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(20)]
    long = " ".join(passages[k % 20] + (f" x{k}" if k % 2 else "") for k in range(3_300))
    frame = spark.createDataFrame([(1, " stop ".join(passages)), (2, long), (3, "one " * 50_000), (4, "two " + "one " * 50_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["first_docs"] for r in substring_dedup.repeats(frame).collect()} == {2: [1], 4: [3]}
    got = {r["doc_id"]: r for r in substring_dedup.repeats(frame, within=True).collect()}
    assert set(got) == {2, 4} and got[2]["n_words"] > 150_000 and got[2]["first_docs"] == [1, 2] and got[4]["n_words"] > 49_000
    assert all(a["end"] < b["start"] for a, b in zip(got[2]["spans"], got[2]["spans"][1:]))

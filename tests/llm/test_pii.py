"""Operator 5 against plain regular expressions."""

import hashlib
import math
import random
import re

import duckdb
import regex

from pagewright.llm import pii, queries

MORE = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
key = lambda rows: sorted(map(tuple, rows), key=repr)


def fits(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(kind, m[0])]


def row(doc, text, extra=()):
    base = base_spans(text)
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc, *[sum(s[0] == k for s in base) for k in pii.KINDS], hashlib.sha256(say(base).encode()).hexdigest(), say([*base, *extra]))


def test_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{MORE}/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r) for r in queries.op5_pii(spark, MORE).collect()}
    assert len(got) == len(docs) and any(g[1] for g in got.values())
    for doc, text in docs:
        want = row(doc, text)
        assert got[doc][:6] == want[:6] and got[doc][6].startswith(want[6])


def test_odd_texts(spark):
    rng = random.Random(9)
    made = ["".join(rng.choice(["a", "b@", ".", "c.d", "1", "23", "-", " ", "+4", "(", ")", "é", "\x01", "255", "256", "4111 1111-1111 1111", "@", "🙂", "%", "_"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    made += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111111111111111" * 3, "0" * 16, "+1 (234) 555-1234.", "a" * 3000 + "@", "1." * 3000, "x@" + "a." * 3000 + "b", "9" * 5000, "+" + "1 " * 4000 + "2", None, "", "\x01\x01a@b.cc\x01"]
    docs = [(k, t) for k, t in enumerate(made)] + [(None, "a@b.cc"), (3, "x"), (3, "x")]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, base string, key int")
    got = pii.digest(pii.personal_data(frame)).collect()
    assert key(r[:6] for r in got) == key(row(*d)[:6] for d in docs)
    assert pii.personal_data(frame.limit(0)).count() == 0
    assert key(pii.redact(frame).select("base", "key").collect()) == key(("clash", 1) for _ in docs)


def test_long_runs(spark):
    """Texts that a pattern which tries again from every place would never get through."""
    docs = ["7" * 300_000, "x@" + "b." * 100_000 + "c", "+1" + " 2" * 200_000, "x@" + "." * 200_000 + "1", "1." * 100_000, "1" + " ab" * 100_000 + " 2"]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))).collect()}
    assert [got[k]["n_email"] for k in range(6)] == [0, 1, 0, 0, 0, 0] and got[4]["n_ip"] == 50_000 // 2 and len(got) == 6


def test_discovery(spark):
    """Numbers in a context that seeds have made a pattern of are found, others are not."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = [(k, f"{word()} {word()} please write to user{k}@mail.example.org today or {word()} {word()}") for k in range(40)]
    docs += [(100, "é you may please write to user_at_home77 today or later"), (101, "the year 1999 was good"), (102, "please pay 1234 today"), (103, None)]
    frame = spark.createDataFrame([(d, t, len(t or "")) for d, t in docs], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(frame)).collect()}
    at = docs[40][1].index("user_at")
    assert got[100] == f"found_email:{at}:{at + 14}" and got[101] == got[102] == got[103] == "" and got[3] == row(*docs[3])[6]
    clean = {r["doc_id"]: r for r in pii.redact(frame).collect()}
    assert clean[100]["text"] == "é you may please write to [EMAIL] today or later" and clean[101]["text"] == docs[41][1] and clean[103]["text"] is None
    assert "[EMAIL]" in clean[0]["text"] and "@" not in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])


def plain_instances(texts):
    """(text, start, end, value, kind, patterns) by a walk over each different text."""
    every = regex.compile(r"\+[0-9][ ().0-9-]+[0-9]|[0-9](?:[ -]?[0-9]){12,}+(?!\S)|(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
    out = []
    for text in set(texts):
        found = list(every.finditer(text))
        for k, m in enumerate(found):
            value = regex.sub(r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "", m[0])
            if not value:
                continue
            start = m.start() + len(regex.match(r"[^\p{L}\p{N}+]*", m[0])[0])
            kind = next((x for x in ("email", "ip", "phone", "card") if re.fullmatch(PATTERNS[x], value) and fits(x, value)), None)
            left = regex.findall(r"\p{L}+", text[found[k - 1].end() if k else 0 : m.start()].lower())
            right = regex.findall(r"\p{L}+", text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)].lower())
            said = [("<", *left[-2:])] * (len(left) > 1) + [(">", *right[:2])] * (len(right) > 1) + [("<", *left[-1:])] * bool(left) + [(">", *right[:1])] * bool(right) + [("=", *left[-1:], *right[:1])] * bool(left and right)
            out.append((text, start, start + len(value), value, kind, said))
    return out


def plain_bootstrap(seen):
    """Value to kind, by dictionaries."""
    edges = {}
    for _, _, _, value, _, said in seen:
        for p in said:
            edges.setdefault(p, set()).add(value)
    edges = {p: v for p, v in edges.items() if len(v) >= pii.SEEDS}
    seeds = {(value, kind): 1.0 for _, _, _, value, kind, _ in seen if kind}
    first, heard = {v for v, _ in seeds}, {}
    for _ in range(pii.ROUNDS):
        known = seeds | heard
        firm = {}
        for p, values in edges.items():
            own = [(v, k, s) for (v, k), s in known.items() if v in values]
            for kind in {k for _, k, _ in own}:
                n = sum(v in first and k == kind for v, k, _ in own)
                share = sum(s for _, k, s in own if k == kind) / (sum(s for *_, s in own) + pii.UNKNOWN * max(0, len(values) - len(own)) + 0.5)
                if n >= pii.SEEDS and share >= pii.CONFIDENCE:
                    firm[p, kind] = share if len(p) > 2 else pii.WEAK * share
        said = {}
        for (p, kind), share in firm.items():
            for v in edges[p]:
                said[v, kind] = said.get((v, kind), 0.0) + math.log1p(-min(share, 0.999))
        heard = {(v, k): 1 - math.exp(x) for (v, k), x in said.items() if v not in first and 1 - math.exp(x) >= pii.SCORE}
    best = {}
    for (v, k), x in heard.items():
        best[v] = max(best.get(v, (-1.0, -9, "")), (x, -pii.KINDS.index(k), k))
    return {v: b[2] for v, b in best.items()}


def test_bootstrap_by_brute_force(spark):
    """What the patterns discover in random texts, against the same graph in dictionaries."""
    total = 0
    for seed in range(3):
        rng = random.Random(seed)
        words = ["mail", "Host", "card", "call", "from", "at", "a", "the", "é"]
        token = {"mail": lambda: f"u{rng.randrange(90)}@m{rng.randrange(5)}.org", "host": lambda: f"10.{rng.randrange(20)}.0.{rng.randrange(9)}", "call": lambda: f"+1 (234) 555-{rng.randrange(1000, 1030)}", "card": lambda: "4111 1111 1111 1111"}
        docs = []
        for k in range(300):
            said = []
            for _ in range(rng.randrange(9)):
                w = rng.choice(words)
                said.append(w)
                if w.lower() in token and rng.random() < 0.8:
                    said.append(token[w.lower()]() if rng.random() < 0.8 else f"id{rng.randrange(12)}{rng.choice(['', '!', 'x' * 300])}")
                elif rng.random() < 0.2:
                    said.append(f"id{rng.randrange(12)}")
            docs.append((k, " ".join(said)))
        docs += [(900, docs[5][1]), (901, "call " + "- " * 200 + "id7 " + "- " * 300 + " now"), (902, None), (None, docs[7][1])]
        seen = plain_instances([t for _, t in docs if t])
        kinds = plain_bootstrap(seen)
        base = {t: base_spans(t) for _, t in docs if t}
        spans = {}
        for text, a, b, value, kind, _ in seen:
            if not kind and value in kinds and all(y <= a or b <= x for _, x, y in base[text]):
                spans.setdefault(text, []).append((f"found_{kinds[value]}", a, b))
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = key((r["doc_id"], r["spans"]) for r in pii.digest(pii.personal_data(frame)).collect())
        assert got == key((d, row(d, t, sorted(spans.get(t, [])))[6]) for d, t in docs)
        total += sum(map(len, spans.values()))
    assert total > 50

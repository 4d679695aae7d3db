"""Personal data: base patterns, and bootstrapped contextual extraction, with DataFrame functions alone.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Those are the seeds: the words around them
are lexical patterns. Patterns and identifier-like tokens make a graph; in each round a pattern's confidence is the
share of its instances that are known for a kind (of those not known yet only a part counts against it), and an instance's
score is what its confident patterns say together. Tokens that score high enough without matching a base pattern are
identifiers that the patterns discovered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import free_name, written

KINDS = ("email", "ip", "card", "phone")
FOUND = "found_"
#: The base patterns. Possessive quantifiers and look-behinds only save retries that can't succeed, and cards start from the thirteen digits that they need.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A token with a digit or an at sign, as it stands between white space.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
MARK, OTHER = "\x01", "\x02"
#: Rounds of scoring; a pattern needs this many seeds of a kind and this share of its instances, of which one that is not known yet counts as this part of one; a token needs this score.
ROUNDS, SEEDS, CONFIDENCE, UNKNOWN, SCORE = 3, 5, 0.8, 0.25, 0.9
#: What a pattern of a single word says counts for this part, so that it takes two of them to discover a token.
WEAK = 0.8
#: So many characters next to a token are split into words first, and all up to the next token if they hold too few.
NEARBY = 80


def runs(text: Column, pattern: str) -> Column:
    """Alternately what stands between matches and a match. The mark is replaced in the text by another character that no pattern holds either."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


MATCH = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"
#: Parts that are walked in one go; an even number. Matches are appended to short arrays, as an accumulator is copied at every step.
GROUP = 256


def placed(parts: str) -> Column:
    """array<struct<start,end,value,before,after>> of the matches among alternate parts; before and after is what stands on either side up to the next match."""
    walk = f"""
        aggregate(slice({parts}, c * {GROUP} + 1, {GROUP}), named_struct('pos', acc.pos, 'k', c * {GROUP} + 1, 'found', cast(array() as array<{MATCH}>)),
            (own, x) -> named_struct('pos', own.pos + length(x), 'k', own.k + 1, 'found',
                if(own.k % 2 = 0,
                   array_append(own.found, named_struct('start', own.pos, 'end', own.pos + length(x), 'value', x, 'before', element_at({parts}, own.k - 1), 'after', element_at({parts}, own.k + 1))),
                   own.found)))"""
    return F.expr(f"""
        aggregate(sequence(0, cast((size({parts}) - 1) div {GROUP} as int)), named_struct('pos', 0L, 'found', cast(array() as array<array<{MATCH}>>)),
            (acc, c) -> element_at(transform(array({walk}), r -> named_struct('pos', r.pos, 'found', array_append(acc.found, r.found))), 1),
            acc -> flatten(acc.found))""")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)), F.lit(0),
        lambda n, k: n + _doubled(F.substring(number, F.length(number) + 1 - k, F.lit(1)).cast("int"), k % 2 == 0),
    )
    return total % 10 == 0


def _doubled(digit: Column, twice: Column) -> Column:
    return F.when(~twice, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    n = F.length(digits(value))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: By kind: the pattern, and what a text must hold for it.
BASE = {"email": (EMAIL, lambda t: F.contains(t, F.lit("@"))), "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, lambda t: t.rlike("[0-9][ -]?[0-9]")), "phone": (PHONE, lambda t: t.rlike(r"\+[0-9]"))}
SPAN = "struct<kind:string,start:bigint,end:bigint>"


def with_base(rows: DataFrame) -> DataFrame:
    """rows (with text) and base: array<struct<kind,start,end>> by kind as listed, then start."""
    parts = rows.select("*", *[F.when(may(F.col("text")), runs(F.col("text"), pattern)).otherwise(F.array(F.lit(""))).alias(f"parts_{k}") for k, (pattern, may) in BASE.items()])
    found = parts.select(*rows.columns, *[placed(f"parts_{k}").alias(f"found_{k}") for k in KINDS])
    named = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    checked = lambda k: lambda m: valid(k, m["value"])
    spans = [F.transform(F.filter(f"found_{k}", checked(k)), named(k)) for k in KINDS]
    return found.select(*rows.columns, F.concat(*spans).alias("base"))


def instances(rows: DataFrame) -> DataFrame:
    """(key, start, end, value, kind, patterns): identifier-like tokens and numbers with the lexical patterns around them.

    value is the token without punctuation at its ends; kind is set if it is a seed. Patterns, in lower case: the two words
    before, the two after, the one before, the one after, and one on either side, of what stands between this token and the
    next one. Equal instances of equal texts count once.
    """
    every = f"{PHONE}|{CARD}(?!\\S)|{TOKEN}"
    found = rows.select("key", runs(F.col("text"), every).alias("parts")).select("key", F.explode(placed("parts")).alias("m")).select("key", "m.*")
    # a run of punctuation is tried from its start alone
    core = F.regexp_replace(F.regexp_replace("value", r"^[^\p{L}\p{N}+]++", ""), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    found = found.withColumn("core", core).where("core <> ''")
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}+]*+", 0))
    found = found.withColumn("start", F.col("start") + lead).withColumn("end", F.col("start") + F.length("core"))
    full = {k: f"^(?:{p})$".replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "") for k, (p, _) in BASE.items()}
    kind = reduce(lambda c, k: c.when(F.col("core").rlike(full[k]) & valid(k, F.col("core")), k), ("email", "ip", "phone", "card"), F.when(F.lit(False), ""))
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")
    near = found.select("key", "start", "end", "core", kind.alias("kind"), "before", "after", words(F.expr(f"right(before, {NEARBY})")).alias("l"), words(F.expr(f"left(after, {NEARBY})")).alias("r"))
    # of three words near by, the two next to the token are whole
    whole = lambda some, side: F.when((F.size(some) > 2) | (F.length(side) <= NEARBY), F.col(some)).otherwise(words(F.col(side))).alias(some)
    near = near.select("key", "start", "end", "core", "kind", whole("l", "before"), whole("r", "after"))
    l1, l2, r1, r2 = _context()
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    patterns = F.array(say("<", l2, " ", l1), say(">", r1, " ", r2), say("<", l1), say(">", r1), say("=", l1, " ", r1))
    return near.select("key", "start", "end", F.col("core").alias("value"), "kind", F.filter(patterns, lambda p: p.isNotNull()).alias("patterns")).distinct()


def _context() -> tuple[Column, ...]:
    at = lambda a, k: F.try_element_at(F.col(a), F.lit(k))
    return at("l", -1), at("l", -2), at("r", 1), at("r", 2)


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confidence: float = CONFIDENCE, unknown: float = UNKNOWN, weak: float = WEAK, score: float = SCORE) -> DataFrame:
    """(value, kind): tokens that are no seeds, with the kind that confident patterns give them.

    Each round joins the graph's edges with the known instances, sums by pattern and kind, and joins the confident
    patterns back. Sums are aggregated before the shuffle; each join has one row for each instance or pattern and kind
    on one side. A value that scores for several kinds takes the best, the first listed on ties.
    """
    edges = written(seen.select("value", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree")).where(F.col("degree") >= seeds)
    edges = written(edges.join(degree, "pattern"), "pii-graph")
    sure = seen.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0)).withColumn("seed", F.lit(1))
    known = written(sure, "pii-seeds")
    first = known
    for _ in range(rounds):
        support = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.sum("seed").alias("seeds"), F.count("*").alias("n"), F.max("degree").alias("degree"))
        every = support.groupBy("pattern").agg(F.sum("sum").alias("all"), F.greatest(F.max("degree") - F.sum("n"), F.lit(0)).alias("new"))
        share = F.col("sum") / (F.col("all") + unknown * F.col("new") + 0.5)
        firm = support.join(every, "pattern").withColumn("confidence", share).where((F.col("seeds") >= seeds) & (F.col("confidence") >= confidence))
        firm = firm.select("pattern", "kind", F.when(F.contains("pattern", F.lit(" ")), F.col("confidence")).otherwise(weak * F.col("confidence")).alias("confidence"))
        heard = edges.select("value", "pattern").join(firm, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        heard = heard.join(first.select("value"), "value", "left_anti").where(F.col("score") >= score)
        known = written(first.unionByName(heard.select("value", "kind", "score", F.lit(0).alias("seed"))), "pii-known")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = known.where("seed = 0").groupBy("value").agg(F.max(F.struct("score", (-order).alias("rank"), "kind")).alias("best"))
    return best.select("value", "best.kind")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of docs (or the id alone), base and extra: arrays of struct<kind,start,end> in code points, end exclusive.

    extra holds what the patterns discovered, of kinds found_email, found_ip, found_card and found_phone; it never
    overlaps base. Null and empty texts have no spans; repeated rows and null ids stay. A text without a digit or an at
    sign can hold neither base nor discovered data: it is passed by.
    """
    others = list(docs.columns) if keep_text else [id_column]
    base, extra = (free_name(others, c) for c in ("base", "extra"))
    rows = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    may = F.col("text").rlike("[0-9@]")
    none = F.array().cast(f"array<{SPAN}>")
    plain = rows.where(~may).select("row", none.alias("base"), none.alias("extra"))
    marked = with_base(rows.where(may).withColumn("key", F.unhex(F.sha2("text", 256))))
    marked = written(marked, "pii-texts")
    seen = written(instances(marked), "pii-instances")
    named = seen.where("kind IS NULL").drop("kind").join(bootstrap(seen), "value")
    named = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit(FOUND), "kind").alias("kind"), "start", "end"))).alias("named"))
    joined = marked.join(named, "key", "left")
    clear = F.filter(F.coalesce("named", none), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = plain.unionByName(joined.select("row", "base", clear.alias("extra")))
    return out.select("row.*", F.col("base").alias(base), F.col("extra").alias(extra))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, base, extra)."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """docs with every span of text replaced by its kind in brackets (overlapping spans by the first one's), length_column (if there) set anew.

    Null and empty texts and those without spans stay as they are, repeated rows and null ids too; an empty table stays
    empty. Other columns pass through, whatever their names.
    """
    found = personal_data(docs, text_column=text_column, keep_text=True)
    base, extra = found.columns[-2:]
    spans = F.array_sort(F.transform(F.concat(base, extra), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    clean = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(text_column), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(F.replace(s["kind"], F.lit(FOUND), F.lit(""))), F.lit("]"))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_column), (acc["at"] + 1).cast("int"), F.length(text_column))),
    )
    hit = F.size(spans) > 0
    new = free_name(found.columns, "clean")
    found = found.withColumn(new, F.when(hit, clean))
    own = {c: F.col(c) for c in docs.columns}
    own[text_column] = F.coalesce(F.col(new), F.col(text_column)).alias(text_column)
    if length_column in own:
        own[length_column] = F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col(length_column)).cast(docs.schema[length_column].dataType).alias(length_column)
    return found.select(*own.values())

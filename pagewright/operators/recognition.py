"""Decoding of recognition scores and structure tokens, without a model: score matrices are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that a structure decode wraps around, that open cells, and that begin and end a sequence.
PREFIX, SUFFIX = ("<html>", "<body>", "<table>"), ("</table>", "</body>", "</html>")
CELL_TOKENS = ("<td>", "<td", "<td></td>")
BEGIN, END = "sos", "eos"


def first_maximum(scores: Column) -> Column:
    """Index of the largest score; the lowest index on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def ctc_decode(steps: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """(key, text, score, n, error): a class is kept if it isn't blank (0) and differs from the step before, blank or not; score is the single-precision mean of kept maxima, 0 without any.

    steps: key, t, scores array<float>; dictionary: class_id, text (a small fixed table). A kept class that the
    dictionary lacks gives an error, and neither text nor score.
    """
    best = steps.select(key, "t", first_maximum(F.col("scores")).alias("class_id"), F.array_max("scores").alias("top"))
    before = F.lag("class_id").over(Window.partitionBy(key).orderBy("t"))
    kept = best.withColumn("before", before).where((F.col("class_id") != 0) & (F.col("before").isNull() | (F.col("before") != F.col("class_id"))))
    named = kept.join(F.broadcast(dictionary), "class_id", "left")  # a recognizer's dictionary: tens of thousands of entries at most
    rows = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("text", F.lit("")).alias("text"), "top", F.when(F.col("text").isNull(), F.col("class_id")).alias("unknown")))).alias("rows"))
    total = F.aggregate("rows", F.lit(0).cast("float"), lambda s, r: (s + r["top"]).cast("float"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "")
    unknown = F.get(F.filter("rows", lambda r: r["unknown"].isNotNull()), F.lit(0))["unknown"]
    error = F.concat(F.lit("class "), unknown.cast("string"), F.lit(" is unknown"))
    sound = lambda c: F.when(unknown.isNull(), c)
    found = rows.select(key, sound(text).alias("text"), sound((total / F.size("rows").cast("float")).cast("float")).alias("score"), F.size("rows").alias("n"), error.alias("error"))
    none = steps.select(key).distinct().join(found.select(key), key, "left_anti")
    return found.unionByName(none.select(key, F.lit("").alias("text"), F.lit(0).cast("float").alias("score"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("error")))


def dictionary_rows(lines: DataFrame, appends_space: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, class_id, text) from whole dictionary texts in column value: an entry a line, one carriage return at its end goes, nothing else is trimmed; class 0 is blank."""
    text = F.regexp_replace(F.col("value"), r"\n\z", "")
    rows = lines.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "entry")).select(*keys, (F.col("pos") + 1).alias("class_id"), F.regexp_replace("entry", r"\r\z", "").alias("text"))
    if appends_space:
        rows = rows.unionByName(rows.groupBy(*keys).agg((F.max("class_id") + 1).alias("class_id")).select(*keys, "class_id", F.lit(" ").alias("text")))
    return rows


def vocabulary(tokens: Column, merge_empty_cells: bool = True) -> Column:
    """Begin, the dictionary's tokens and end; with merging, the empty cell is appended if missing and the bare open cell removed."""
    if merge_empty_cells:
        tokens = F.when(F.array_contains(tokens, "<td></td>"), tokens).otherwise(F.array_append(tokens, "<td></td>"))
        tokens = F.filter(tokens, lambda t: t != "<td>")
    return F.concat(F.array(F.lit(BEGIN)), tokens, F.array(F.lit(END)))


def structure_decode(steps: DataFrame, tokens: list[str], key: str) -> DataFrame:
    """(key, tokens, score, cells): the largest class of each step up to the first end after step 0; begin and end are skipped; cell tokens carry their step's box.

    steps: key, t, scores array<float>, box array<double> (already scaled; truncated here).
    """
    last = len(tokens) - 1
    best = steps.select(key, "t", first_maximum(F.col("scores")).alias("c"), F.array_max("scores").alias("top"), "box")
    stop = F.min(F.when((F.col("t") > 0) & (F.col("c") == last), F.col("t"))).over(Window.partitionBy(key))
    kept = best.withColumn("stop", stop).where((F.col("stop").isNull() | (F.col("t") < F.col("stop"))) & ~F.col("c").isin(0, last))
    token = F.array(*map(F.lit, tokens))[F.col("c")]
    kept = kept.select(key, F.struct("t", token.alias("token"), "top", F.transform("box", lambda v: v.cast("bigint")).alias("box")).alias("s"))
    rows = kept.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    rows = steps.select(key).distinct().join(rows, key, "left").withColumn("s", F.coalesce("s", F.array().cast(rows.schema["s"].dataType)))
    lit = lambda xs: F.array(*map(F.lit, xs))
    total = F.aggregate("s", F.lit(0.0), lambda a, s: a + s["top"].cast("double"))
    return rows.select(
        key, F.concat(lit(PREFIX), F.transform("s", lambda s: s["token"]), lit(SUFFIX)).alias("tokens"),
        F.when(F.size("s") == 0, F.lit(0).cast("float")).otherwise((total / F.size("s")).cast("float")).alias("score"),
        F.transform(F.filter("s", lambda s: s["token"].isin(*CELL_TOKENS)), lambda s: s["box"]).alias("cells"),
    )


def row_starts(tables: DataFrame, key: str) -> DataFrame:
    """(key, row, start): for each table row, the count of finished cells at its first finished one; rows without cells have none."""
    rows = tables.select(key, F.posexplode("tokens").alias("pos", "token"))
    by = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    closes = F.col("token").isin("</td>", "<td></td>")
    rows = rows.withColumn("tr", F.sum((F.col("token") == "<tr>").cast("int")).over(by)).withColumn("ended", F.sum((F.col("token") == "</tr>").cast("int")).over(by))
    rows = rows.withColumn("cell", F.sum(closes.cast("int")).over(by) - 1).where(closes & (F.col("tr") > F.col("ended")))
    starts = rows.groupBy(key, "tr").agg(F.min("cell").cast("int").alias("start"))
    return starts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("tr")) - 1).alias("row"), "start")


def table_html(tables: DataFrame, matches: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(key, html): tokens with the texts of their cells.

    matches: key, row, position, n, text for each text of a cell, n its place among them; starts: key, row, start.
    The n-th finished cell belongs to the last row whose start isn't past it, of rows that both starts and matches
    have. A cell with several texts gets each without a leading space and bold tags, joined by spaces, in bold if the
    first was. Tables of fewer than six tokens have a null html.
    """
    texts = matches.groupBy(key, "row", "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda t: t["text"]).alias("texts"))
    several = F.size("texts") > 1
    bold = several & F.contains(F.col("texts")[0], F.lit("<b>"))

    def clean(text: Column) -> Column:
        text = F.when(F.startswith(text, F.lit(" ")), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
        cut = lambda c, first, length: F.substring(c.cast("binary"), first, length).cast("string")  # noqa: E731  bytes, not characters
        text = F.when(F.contains(text, F.lit("<b>")), cut(text, F.lit(4), F.octet_length(text))).otherwise(text)
        return F.when(F.contains(text, F.lit("</b>")), cut(text, F.lit(1), F.octet_length(text) - 4)).otherwise(text)

    said = F.transform("texts", lambda t: clean(t))
    joined = F.aggregate(
        F.sequence(F.lit(0), F.size("texts") - 1), F.lit(""),
        lambda out, k: F.when(said[k] == "", out).otherwise(F.concat(out, said[k], F.when((k < F.size("texts") - 1) & ~F.endswith(said[k], F.lit(" ")), F.lit(" ")).otherwise(F.lit("")))),
    )
    whole = F.when(several, F.concat(F.when(bold, F.lit("<b>")).otherwise(F.lit("")), joined, F.when(bold, F.lit("</b>")).otherwise(F.lit("")))).otherwise(F.col("texts")[0])
    cells = texts.select(key, "row", "position", whole.alias("content"))
    tokens = tables.select(key, F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token"))
    inner = (F.col("pos") >= 3) & (F.col("pos") < F.col("size") - 3)
    closing = inner & F.contains("token", F.lit("</td>"))
    by = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tokens = tokens.withColumn("cell", F.when(closing, F.sum(closing.cast("int")).over(by) - 1))
    have = matches.groupBy(key).agg((F.max("row") + 1).alias("matched"))
    ends = starts.join(have, key, "left").where("row = 0 OR row < matched").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), F.col("start").cast("int").alias("start")))).alias("starts"))
    tokens = tokens.join(ends, key, "left")
    at = F.aggregate(
        F.filter(F.coalesce("starts", F.array().cast("array<struct<row:int,start:int>>")), lambda s: s["row"] > 0),
        F.struct(F.lit(0).alias("row"), F.lit(0).alias("first")),
        lambda acc, s: F.when(F.greatest(s["start"], acc["first"] + 1) <= F.col("cell"), F.struct(s["row"].alias("row"), F.greatest(s["start"], acc["first"] + 1).alias("first"))).otherwise(acc),
    )
    tokens = tokens.withColumn("at", F.when(F.col("cell").isNotNull(), at)).withColumn("row", F.col("at.row")).withColumn("position", F.col("cell") - F.col("at.first"))
    filled = tokens.join(cells, [key, "row", "position"], "left")
    content = F.coalesce("content", F.lit(""))
    piece = F.when(F.col("cell").isNull(), F.col("token")).when(F.col("token") == "<td></td>", F.concat(F.lit("<td>"), content, F.lit("</td>"))).otherwise(F.concat(content, F.col("token")))
    rows = filled.select(key, "size", F.struct("pos", piece.alias("piece")).alias("p")).groupBy(key).agg(F.max("size").alias("size"), F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select(key, F.when(F.col("size") >= 6, F.array_join(F.transform("p", lambda p: p["piece"]), "")).alias("html"))

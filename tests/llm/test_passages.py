"""Operator 10 against its purpose: passages of 51 words or more that an earlier document holds."""

import duckdb

from pagewright.llm import queries
from pagewright.llm.common import words_of
from pagewright.llm.substring_dedup import SURE_WORDS

MORE = "/root/testdata/sf0.1"


def test_documents_with_long_repeats(spark):
    """All documents that share so many words in a row with an earlier one are found; few others, which share shorter passages."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{MORE}/documents.parquet' ORDER BY doc_id").fetchall()
    seen, want = set(), set()
    for doc, text in docs:
        words = words_of(text)
        own = {hash(tuple(words[k : k + SURE_WORDS])) for k in range(len(words) - SURE_WORDS + 1)}
        if not own.isdisjoint(seen):
            want.add(doc)
        seen |= own
    got = {r["doc_id"] for r in queries.op10_substring_dedup(spark, MORE).select("doc_id").collect()}
    assert len(want) > 1_000 and want <= got and len(got - want) <= 0.03 * (len(docs) - len(want))

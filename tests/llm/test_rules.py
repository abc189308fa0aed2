from __future__ import annotations

from millrace.llm import quality_rules


def test_copies_are_documents(spark):
    """A line is counted by documents, of which exact copies are some; a row that repeats id and text is none more."""
    copies = [(i, "shared line\nbody of all copies", "a") for i in range(5)] + [(None, "shared line\nbody of all copies", "a")]
    repeated = [(9, "seldom\nand more of it", "a")] * 6
    docs = spark.createDataFrame([*copies, *repeated, (10, "shared line\nin another host", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r.removed for r in quality_rules.line_frequency_rules(docs, max_docs=5).collect()}
    assert got == {None: "0,1", 0: "0,1", 1: "0,1", 2: "0,1", 3: "0,1", 4: "0,1", 9: "", 10: ""}
    assert all(not r.removed for r in quality_rules.line_frequency_rules(docs, max_docs=6).collect())

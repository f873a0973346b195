"""The line stage cuts passages of short lines too."""

from __future__ import annotations

import corpus_pipeline
from palimpsest.llm import line_dedup


def test_a_repeated_menu_of_short_lines_is_cut(spark):
    menu = "".join(f"go {n}\n" for n in range(30))
    docs = spark.createDataFrame([(i, f"own text {i}\n" + menu) for i in range(3)], "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left == {0: "own text 0\n" + menu, 1: "own text 1\n", 2: "own text 2\n"}


def test_the_query_cuts_short_lines_and_long_sentences_too(spark):
    menu = "Home\nAbout\nBlog\n"
    long = "when the lamps along the quay had all gone out and nobody, neither the ferryman nor the boy who minded the ropes for him in winter, could say how the boats had been untied, since the knots were of a kind that takes two hands, the harbour master wrote it down as weather and went home to sleep through what was left of the night, and the next morning too"
    rows = [(i, f"Text {i} begins here {i * 7} and there. {long} number {i}.\nEnd {i}.\n{menu}") for i in range(2)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_removed"] == 0
    assert out[1]["n_removed"] >= 6 and "Home" not in out[1]["text"] and "ferryman" not in out[1]["text"]


def test_columns_with_the_names_it_uses(spark):
    docs = spark.createDataFrame([(i, "One a. Two b. Three c. ", i, "x") for i in range(2)], "doc_id bigint, text string, __cut_id bigint, _id string")
    out = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    assert out == [(0, "One a. Two b. Three c. ", 0, "x", 0), (1, "", 1, "x", 3)]

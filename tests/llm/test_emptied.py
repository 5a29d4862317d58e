"""The pipeline's line stage drops the documents that it empties."""

import corpus_pipeline


def test_copies_are_gone_and_blank_documents_stay(spark, docs_of):
    text = "a first line that is long enough\nanother line with words of its own"
    rows = [(1, text), (2, text), (3, "\n" + text + "\n\n"), (4, text + "\nsomething that only this one has"), (5, ""), (6, None), (7, " \n"), (8, "a first line that is long enough")]
    out = {x.doc_id: x.text for x in corpus_pipeline.dedup_lines(spark, docs_of(rows), "").collect()}
    assert out == {1: text, 4: "something that only this one has", 5: "", 6: None, 7: " \n"}

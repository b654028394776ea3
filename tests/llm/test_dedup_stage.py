"""The MinHash stage keeps one row of each group, whatever the doc_ids, and all rows without words."""

import corpus_pipeline as cp

A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
B = "one two three four five six seven eight nine ten eleven twelve"
C = "red orange yellow green blue indigo violet black white grey pink brown"
D = "north east south west up down left right near far in out"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = cp.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_unlinked_texts_of_one_id_all_stay(spark):
    rows = [(5, A), (5, B), (5, C), (5, D)]
    assert kept(spark, rows) == sorted(rows, key=repr)


def test_one_row_of_each_group(spark):
    # A of 5 is a copy of 3, B of 5 is named by 5 and copied by 9, null ids go where an id is known
    rows = [(3, A), (5, A), (5, A), (5, B), (9, B), (None, B), (None, C), (None, C), (None, C.upper()), (7, D), (7, D.upper())]
    got = kept(spark, rows)
    assert [g for g in got if g[1] in (A, B)] == [(3, A), (5, B)]
    assert [(i, t.lower()) for i, t in got if t not in (A, B)] == [(7, D), (None, C)]


def test_rows_without_words_all_stay(spark):
    rows = [(None, None), (None, None), (None, ""), (1, None), (1, None), (2, " \t\n\x0b\x0c\r"), (2, " \t\n\x0b\x0c\r"), (3, ""), (3, " ")]
    assert kept(spark, rows) == sorted(rows, key=repr)

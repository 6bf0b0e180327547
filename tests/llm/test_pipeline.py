import random

import numpy as np

import corpus_pipeline
from pulselake.llm import decontaminate
from tests.llm.edges import odd_documents
from tests.llm.test_text_ops import QUESTION, bpe_ids


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": ["the", "and", "ing", "of", "that", "with", "er"], "fr": ["le", "eau", "que", "é", "dans", "ment"]}
    vocabulary = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(1, 4))) for _ in range(800)] for k, v in words.items()}

    def text(lang, n=150):
        return " ".join(rng.choice(vocabulary[lang]) for _ in range(n))

    rows = [(i, text(lang), lang) for i in range(60) for lang in [("en", "fr")[i % 2]]]
    clean = {i: t for i, t, _ in rows}
    rows += [(100, None, None), (101, "", "en"), (102, "12 34 !!", None)]
    rows += [(110, clean[4], "en"), (111, clean[4] + " moreover", "en")]
    rows += [(120, text("en", 40) + " " + QUESTION.replace("9", "6"), "en")]
    passage = text("en", 70)
    lead = [text("fr", 90), text("fr", 80)]
    rows += [(130, f"{lead[0]} {passage}", "fr"), (131, f"{lead[1]} {passage}", "fr")]
    spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    everyone = {r[0] for r in rows}
    assert set(seen[0]) == everyone - {100, 101, 102}
    assert set(seen[1]) == set(seen[0]) - {110, 111}
    assert set(seen[2]) == set(seen[1]) and seen[2][130] == f"{lead[0]} {passage}" and seen[2][131].strip() == lead[1]
    assert set(seen[3]) == set(seen[2]) - {120}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in got.items()} == {i: bpe_ids(t) for i, t in seen[3].items()}


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names go through all stages;
    so does a table without rows."""
    docs = odd_documents(spark)
    spark.createDataFrame([(1, QUESTION), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        path = f"{tmp_path}/{name}"
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
    ids = [r.doc_id for r in kept.collect()]
    assert not {0, 1, 2, 10} & set(ids) and {5, 6} <= set(ids) and ids.count(6) == 1 and sum(i in (8, 9) for i in ids) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids)
    empty = f"{tmp_path}/none"
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_a_window_that_many_items_have(spark):
    """A document is kept or goes once, however many items begin alike."""
    lead = "please read the following text with care and then answer the question below in one word"
    items = spark.createDataFrame([(i, f"{lead} item{i} a{i} b{i}") for i in range(40)], "item_id long, text string")
    rows = [(i, f"{lead} something else {i} " * 2) for i in range(30)] + [(100, "nothing of it at all in this text")]
    kept = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert [r.doc_id for r in kept.collect()] == [100]

"""A table of documents with every odd case, and its like without rows."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} the of" for i in range(15_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, start string, h int, fp double, key string, n int, score string, rank int, labels int"
TEXTS = [None, "", "   \n\t ", "one", "two words", "The MIT License covers this text. " * 12, LONG, "été ça va? 漢字 🙂 \u00a0 end", "same text here again " * 20, "same text here again " * 20, "123 456 !!"]


def odd_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (None, None), (3, "one"), (3, "another text of the same id")]
    rows = [(i, t, None if k % 4 == 0 else "en", None, None, "x", "y", 1, 2.0, "k", 3, "s", 4, 5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

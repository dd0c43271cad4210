import pytest
from pyspark.sql import functions as F

#: Texts that are null, empty, blank, short, long, repeated, and with characters beyond ASCII.
ODD = [None, "", " \t\n", "one", "Ünï cödé ñ — 日本語 text", "a b c d e f g h i j k l m n o p", "A b C d e F g h i j k l m n o p", "x\x0by\x0cz\r\n1", "tail  spaces  ", "word " * 3000]


@pytest.fixture
def docs(spark):
    """Make a documents table: ids from 0, texts, with extra columns whose names clash with those inside the operators."""

    def make(texts, ids=None, **columns):
        n = len(texts)
        rows = [(i if ids is None else ids[i], t, columns.get("lang", ["en"] * n)[i], columns.get("source", ["s"] * n)[i], 0, "z", 1.0) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string, rep double")
        return df.withColumns({c: F.lit("clash") for c in ("mark", "g", "hub", "size", "keep_id", "part", "path", "id", "words")})

    return make

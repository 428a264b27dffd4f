import pytest

#: Names that operators use within.
CLASHES = ("node", "root", "h1", "_h1", "_H2", "_chunk", "chunk", "_row", "_f0", "f0", "_gone", "_hits", "_doc", "ids", "score", "blob", "rid", "n_lines", "host", "good", "copies", "lowest", "first", "usual", "component_id")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of texts; ids count from 0 unless they are given."""

    def make(texts, ids=None, langs=None, extra=False):
        ids = range(len(texts)) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        df = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in zip(ids, texts, langs)], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(c) for c in CLASHES})
        return df.repartition(3)

    return make

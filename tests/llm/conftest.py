import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Python workers import the library too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, ROOT)

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, over several partitions."""
    def make(rows, extra=(), partitions=3):
        full = []
        for r in rows:
            i, text, source, lang = (*r, *("src0", "en")[len(r) - 2:])
            full.append((i, text, lang, source, None if text is None else len(text), *(["x"] * len(extra))))
        schema = DOCUMENTS + "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame(full, schema).repartition(partitions)
    return make


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]

"""Small awkward inputs for the corpus operators."""

from __future__ import annotations

import os

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def frame(spark, texts, start=0):
    """Documents with the given texts and ids from ``start``."""
    return spark.createDataFrame([(start + i, t, "en", "s", 0 if t is None else len(t))
                                  for i, t in enumerate(texts)], SCHEMA)


def folder(tmp_path, spark, **tables):
    """A data folder holding the given frames as tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(str(tmp_path), f"{name}.parquet"))
    return str(tmp_path)


AWKWARD = [None, "", " \t\n", "one", "one two", "x" * 5000, "word " * 3000, "same text here again",
           "same text here again", "Ünï çödé \U0001f600 text", "a\x0bb\x0cc\rd", "\\### Assistant: </turn> ok",
           "tab\tand\x00nul", "+49 30 1234567 a@b.co 1.2.3.4"]

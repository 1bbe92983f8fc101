"""Registered queries: near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query
from .simhash import near_duplicates
from .substrings import remove_repeats


@query("op9_simhash")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Windows of 13 words and their first document by plain grouping. List order is not needed:
#: a word is removed if any window over it repeats.
SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS low FROM g) WHERE low < doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM r GROUP BY doc_id),
k AS (
  SELECT w.doc_id, words, coalesce(gone, []) AS gone,
    [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(coalesce(gone, []), j)] AS kept
  FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""


@query("op6_substrings", SUBSTRING_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

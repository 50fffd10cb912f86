"""One document of each group of near copies: SimHash links, completed by an exact join.

Fingerprints of 64 bits within 2 bits find copies that hardly differ, but only
some at a Jaccard similarity of 0.8. So groups are what the links of both lead
to: of SimHash fingerprints, and of the exact join of the sets of five-word
shingles at 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import ngramjoin, simhash
from tidegrid.llm.common import components, materialise

SHINGLE = 5
SIMILAR = 80


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable, for each row of (doc_id, text).

    Words are compared in ASCII lower case; a text shorter than a shingle is one
    shingle. Null and wordless texts are copies of each other (their fingerprint
    is zero). A null id names a group only if it has no other id; a wordless row
    without an id is in none. Repeated rows stay repeated.
    """
    docs = docs.select("doc_id", "text")
    exact = materialise(ngramjoin.join(docs, shingle, similar).select("doc_id", "component_id"), "exact")
    prints = materialise(simhash.near_duplicates(docs, shingle=shingle).select("doc_id", "component_id"), "prints")
    links = exact.unionByName(prints).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    labels = components(links).select(F.col("node").alias("component_id"), "component")
    return exact.join(labels, "component_id", "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id. Of rows that share that id one stays.
    Rows without an id stay, as nothing can name them."""
    keep = materialise(near_copies(docs, shingle, similar).filter("doc_id = component_id").select("doc_id").distinct(), "representatives")
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))

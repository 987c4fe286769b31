"""N-gram Jaccard join: near duplicates by the word n-grams that documents share; the search is in setjoin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .components import components
from .setjoin import classes, search, set_join


def gram_sets(n: int):
    def tokenise(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h, doc, _ = kit.Words(b.column("text")).grams(n, short=True)
        return kit.distinct_by_doc(h, doc)

    return tokenise


def similar_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, spanning: bool = False) -> DataFrame:
    """doc_a < doc_b and jaccard of every pair of documents whose sets of word n-grams have a Jaccard similarity of threshold or more.

    Words are those of kit; a text of 1 to n - 1 words has one n-gram, of all
    its words. Null texts and texts without words are similar to nothing, not
    even each other. Rows with null doc_id can't be named and are left out.
    Where a doc_id has several rows, a pair has its most similar rows' value,
    and no document is paired with itself. Similarity equal to the threshold
    counts. Very long texts count whole. An empty table gives no rows. Other columns are ignored, whatever
    their names. With spanning, only as many pairs as join up the same
    groups, with no meaning in jaccard.
    """
    _, size = kit.measure(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return set_join(slim, "text", gram_sets(n), size // 5, threshold, spanning).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.col("similarity").alias("jaccard"))


def similar_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """doc_id, class_id and links, a row for each doc_id: the smallest doc_id of its connected component of similar_pairs, and the number of documents that it is similar to.

    As similar_pairs, but as many rows as documents, however large the groups
    of copies are. A document similar to nothing (so those with null texts or
    without words) is a class of its own, with 0 links. Rows with null doc_id
    are left out, the rows of one doc_id are one document. An empty table
    gives no rows.
    """
    _, size = kit.measure(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = classes(*search(slim, "text", gram_sets(n), size // 5, threshold))
    every = slim.filter("doc_id is not null").select("doc_id").distinct()
    return every.join(found, every["doc_id"] == found["id"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_similar(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """docs, with all columns, without the documents of each group of similar ones but that with the smallest doc_id.

    A group is a connected component of similar_pairs. Rows with null doc_id
    or null text, or with a text without words, stay; the rows of one doc_id
    stay or go together. A similarity equal to the threshold joins. Very long
    texts count whole. An empty table gives no rows.
    """
    groups = components(similar_pairs(docs, n, threshold, spanning=True).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    gone = groups.filter("id <> root").select(F.col("id").alias("_gone"))
    gone = kit.if_small(gone, gone.count())
    return docs.join(gone, gone["_gone"] == docs["doc_id"].cast("long"), "left_anti")

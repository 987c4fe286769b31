"""Packing of tokenised documents into sequences of fixed capacity.

First-fit decreasing with a tournament tree over the bins' free room, run
independently in randomised groups of documents. A group is a hash of doc_id
and a seed, so that a rerun gives the same groups and every group is a fair
sample of all lengths; groups are packed in parallel and never meet.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "group_id long, bin_id long, place long, doc_id long, piece long, first_token long, n_tokens long, bin_tokens long"


def encoder(vocabulary: str, pattern: str | None = None):
    """A tiktoken encoding of a vocabulary file of ranks; made once in each Python worker."""
    import tiktoken

    key = (vocabulary, pattern)
    if key not in _encoders:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern or PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


_encoders: dict = {}
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, lengths being in descending order and at most capacity.

    The tree's leaves hold the free room of all bins; an inner node holds the
    larger of its two. The first bin with room is found by going down, left
    if the left node has room.
    """
    n = len(lengths)
    size = 1
    while size < max(n, 1):
        size *= 2
    tree = [capacity] * (2 * size)
    out = np.empty(n, np.int64)
    for k, length in enumerate(lengths.tolist()):
        i = 1
        while i < size:
            i *= 2
            if tree[i] < length:
                i += 1
        out[k] = i - size
        tree[i] -= length
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            m = a if a > b else b
            if tree[i] == m:
                break
            tree[i] = m
            i //= 2
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row: the tokens of the whole text and one more, which ends the document; 0 for a null text."""

    def count(batches):
        enc = encoder(vocabulary)
        for b in kit.slices(batches):
            n = [0 if t is None else 1 + len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pc.cast(b.column("doc_id"), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kit.batchwise(count), "doc_id long, n_tokens long")


def pack(docs: DataFrame, capacity: int = 2048, group_docs: int = 4096, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """The bin of every document, or of every piece of a document longer than a bin.

    A document of more than capacity tokens is cut into full pieces, each a
    bin by itself, and a rest that is packed as any other; so no token is
    dropped. Row: group_id, bin_id (within the group), place (order within
    the bin), doc_id, piece, first_token, n_tokens, bin_tokens.

    Null text: one row of 0 tokens with null bin_id, place and bin_tokens.
    Empty text: 1 token. Very long texts are cut as said. Null doc_id: packed,
    in groups by place in the table, with null doc_id. Ties of
    length go by doc_id, then piece; repeated rows are packed each. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    groups = kit.parts(docs.count(), group_docs)
    counted = token_counts(docs, vocabulary).withColumn("group_id", F.pmod(F.xxhash64(F.coalesce("doc_id", -1 - F.monotonically_increasing_id()), F.lit(seed)), F.lit(groups)))

    def one(group: pa.Table) -> pa.Table:
        gid = group.column("group_id")[0].as_py()
        ids = group.column("doc_id").combine_chunks()
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        n = group.column("n_tokens").to_numpy()
        pieces = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(capacity, n[row] - piece * capacity)
        order = np.lexsort((piece, doc[row], null[row], -length))
        row, piece, length = row[order], piece[order], length[order]
        some = int(np.count_nonzero(length > 0))
        at = first_fit_decreasing(length[:some], capacity)
        by = np.argsort(at, kind="stable")
        place = np.empty(some, np.int64)
        begin = np.flatnonzero(np.r_[True, np.diff(at[by]) != 0]) if some else np.empty(0, np.int64)
        place[by] = np.arange(some) - np.repeat(begin, np.diff(np.r_[begin, some]))
        full = np.bincount(at, length[:some]).astype(np.int64) if some else np.empty(0, np.int64)
        none = np.arange(len(row)) >= some
        pad = lambda a: pa.array(np.r_[a, np.zeros(len(row) - some, np.int64)].astype(np.int64), mask=none)
        return pa.table({
            "group_id": pa.array(np.full(len(row), gid, np.int64)), "bin_id": pad(at), "place": pad(place), "doc_id": pa.array(doc[row], mask=null[row]), "piece": pa.array(piece.astype(np.int64)),
            "first_token": pa.array((piece * capacity).astype(np.int64)), "n_tokens": pa.array(length.astype(np.int64)), "bin_tokens": pad(full[at]),
        })

    return counted.groupBy("group_id").applyInArrow(kit.groupwise(one), SCHEMA)

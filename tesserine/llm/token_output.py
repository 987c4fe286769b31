"""Token ids as Parquet list columns that can be read selectively.

Tokens are a list<int> column with dictionary pages, which fall back to delta
binary packing when a chunk's dictionary grows too large (writer version 2);
ids and counts are delta-packed, source and language dictionary-coded. Row
groups and pages have set sizes, rows lie in the order of doc_id within a
file, and the writer adds column and offset indexes, so that a range of
doc_id reads only the pages that hold it and a read of metadata skips all
token pages.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit
from .packing import VOCABULARY, encoder

SCHEMA = "doc_id long, source string, lang string, n_bytes long, n_tokens int, tokens array<int>"


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, n_bytes, n_tokens and tokens of every row; whole texts, one id list each.

    Null text: null n_bytes, n_tokens and tokens. Empty text: an empty list.
    Null doc_id, source or lang stay null; where docs has no source or lang
    they are null. Repeated rows stay. Very long texts are one list. An empty
    table gives no rows. Other columns are left out.
    """

    def encode(batches):
        enc = encoder(vocabulary)
        for b in kit.slices(batches):
            texts = b.column("text")
            arrays = [np.empty(0, np.uint32) if t is None else enc.encode_to_numpy(t, disallowed_special=()) for t in texts.to_pylist()]
            n = np.array([len(a) for a in arrays], np.int32)
            null = pc.is_null(texts).to_numpy(zero_copy_only=False)
            off = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32), mask=np.r_[null, False])
            lists = pa.ListArray.from_arrays(off, pa.array(np.concatenate(arrays).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, mask=null), lists], ["doc_id", "source", "lang", "n_bytes", "n_tokens", "tokens"])

    named = {c: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("text", "string"))}
    return docs.select(*named.values()).sortWithinPartitions("doc_id").mapInArrow(kit.batchwise(encode), SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, dictionary: bool = True) -> None:
    """Writes tokenise(docs) at path. dictionary=False has the tokens delta-packed from the start."""
    (
        tokenise(docs, vocabulary)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#n_bytes", "false")
        .option("compression", "zstd")
        .mode("overwrite")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: tuple[int, int] | None = None, tokens: bool = True) -> DataFrame:
    """What write_tokens wrote; doc_ids, both ends included, and leaving out the tokens reach the scan."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if doc_ids is not None:
        df = df.filter(F.col("doc_id").between(*doc_ids))
    return df if tokens else df.drop("tokens")


def token_output(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """Writes the token table, at path or in the shared folder, and reads it back whole: the columns of SCHEMA, a row for each row of docs."""
    path = path or f"{kit.ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path)

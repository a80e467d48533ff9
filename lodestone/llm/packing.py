"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded, no token is lost.

A document of n tokens becomes as many sequences of ``longest`` tokens as fit, and one for each binary digit of
the rest, the longest first. Sequences of equal length form a bucket, from which a trainer draws whole batches of
one length: ``write_buckets`` writes each to a folder of its own. Every row is cut by itself, without a shuffle.

Defined results. Null, empty and token-less texts give no sequence. Every row is cut whatever its doc_id (null stays
null); repeated rows give repeated sequences; an empty table gives none. A text of any length is tokenised whole, and gives rows of at
most ``longest`` tokens. Columns other than doc_id and text aren't read and not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.tokens import RANKS, encoder
from lodestone.llm.vocab import byte_ranks
from lodestone.session import ship

LONGEST = 8192
SCHEMA = "doc_id long, piece int, start int, bucket int, tokens array<int>"


def decompose(n: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(pieces a document, length of each piece) for documents of n tokens; ``longest`` is a power of two."""
    top = longest.bit_length() - 1
    counts = np.stack([n >> top, *(n >> b & 1 for b in range(top - 1, -1, -1))], axis=1)
    lengths = np.tile(1 << np.arange(top, -1, -1), len(n))
    return counts.sum(1), np.repeat(lengths, counts.ravel())


def pack(docs: DataFrame, path: str = RANKS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, piece, start, bucket, tokens): bucket is the sequence's length."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(byte_ranks(path))  # the fixed vocabulary
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        enc = encoder(path, ranks.value)
        for batch in batches:
            for i, j in A.row_blocks(batch.column("text"), 1 << 22):
                part = batch.slice(i, j - i)
                ids, off = enc.encode(part.column("text"))
                count, length = decompose(np.diff(off), longest)
                row = np.repeat(np.arange(len(count)), count)
                piece = A.ragged(np.zeros(len(count), np.int64), count)
                edges = np.concatenate([[0], np.cumsum(length)])
                tokens = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array((edges[:-1] - off[row]).astype(np.int32)), pa.array(length.astype(np.int32)), tokens], names=["doc_id", "piece", "start", "bucket", "tokens"])

    return texts.mapInArrow(run, SCHEMA)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Each length in a folder bucket=<length>, so that a trainer reads whole batches of one length; no shuffle."""
    sequences.write.partitionBy("bucket").parquet(path)

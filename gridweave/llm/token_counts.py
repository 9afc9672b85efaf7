"""Token counts without keeping ids: lengths leave the workers, nothing else."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import released, slices_by_bytes
from gridweave.llm.tokenizer import word_bpe

#: Bytes of text in one batch of the encoder, whatever the number of rows.
BATCH_BYTES = 4 << 20


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count UTF-8 bytes and tokens of every whole text.

    One narrow pass over two columns: Arrow batches are cut by bytes, so a batch of
    very long texts is as large as one of many short ones, and a long text is
    encoded in parts that start at white space, where the tokenizer cuts anyway. Within
    a batch the library encodes batches of distinct pieces, balanced by characters.
    A null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows
    are counted each; an empty table gives an empty result; other columns are not
    read. Returns (id, n_bytes, n_tokens, over_limit).
    """

    def count(batches):
        encoder = word_bpe(tokenizer_path)
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            tokens = encoder.counts(batch.column(1))
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(released(count), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)

"""Encoding of a whole corpus with a public byte-level BPE vocabulary, and its inverse."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import bpe

#: Where the vocabulary is read on the driver; a parameter of every function here.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _lists(lengths: list[int], ids: list[int]) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(ids, np.int32)))


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, ids array<int>)``, one row for each row of ``docs``.

    Whole texts are encoded, without special tokens; NULL and empty texts give the empty list, and
    the string of a special token in a text is ordinary text. Other columns are not read, whatever
    their names. The work is one pass without a shuffle. What is sent to the workers is the
    vocabulary file, whose size doesn't depend on the corpus (1.5 MB here).
    """
    model = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        transducer = bpe.loaded(model.value)
        for batch in batches:
            lengths, ids = [], []
            for text in batch.column(1).to_pylist():
                before = len(ids)
                if text:
                    transducer.encode_into(text, ids)
                lengths.append(len(ids) - before)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(lengths, ids)], ["id", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def texts_of(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, text string)``: ids back to text, decoded by the incremental UTF-8 machine.

    NULL and empty lists give the empty text; ids outside the vocabulary are left out; bytes that are no UTF-8 give U+FFFD.
    """
    model = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        transducer = bpe.loaded(model.value)
        for batch in batches:
            texts = [transducer.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    schema = T.StructType([T.StructField("id", tokens.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema).withColumnRenamed("id", id_col)

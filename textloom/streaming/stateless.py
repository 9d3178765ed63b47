"""Streams: the row-local operators on streaming tables.

Tokens, sentences and annotation are functions of a row, so they keep no state and need
no watermark; window operators are for batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segment
from ..operators.tokenize import TokenizerConfig, tokenize


def token_stream(docs: DataFrame, config: TokenizerConfig = TokenizerConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text) of a streaming or batch table."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokenize(F.col(text_col), config)).alias("pos", "text"))


def sentence_stream(docs: DataFrame, parameters: segment.Parameters = segment.Parameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return segment.sentences(docs, parameters, id_col, text_col)

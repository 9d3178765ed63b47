"""The document pipeline: segmentation, tokens, tags, entities, as asked for.

All columns are arrays of the document's row, so the pipeline is the same on batch
and streaming tables, and a stage that is not asked for costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chunk as chunking
from ..operators import ner, pos, segment
from ..operators.tokenize import TokenizerConfig, tokenize
from ..sources.models import Model


@dataclass(frozen=True)
class Options:
    segment: bool = True
    tag: bool = True
    extract: bool = True
    #: A configuration, a function of the text column, or None for no tokens.
    tokenizer: object = field(default_factory=TokenizerConfig)


def annotate(docs: DataFrame, model: Model, options: Options = Options(), parameters: segment.Parameters = segment.Parameters(), text_col: str = "text") -> DataFrame:
    """docs with sentences, tokens, tags and labels, by the options. Extraction needs tags."""
    out = docs
    if options.segment:
        out = out.withColumn("sentences", segment.sentences_udf(parameters)(F.col(text_col)))
    if options.tokenizer is None:
        return out
    made: Column = options.tokenizer(F.col(text_col)) if callable(options.tokenizer) else tokenize(F.col(text_col), options.tokenizer)
    out = out.withColumn("tokens", made)
    extract = options.extract and model.recognizer is not None
    if (options.tag or extract) and model.tagger is not None:
        out = out.withColumn("tags", pos.tag_udf(model.tagger)(F.col("tokens")))
        if extract:
            out = out.withColumn("labels", ner.label_udf(model.recognizer)(F.col("tokens"), F.col("tags")))
    return out


def token_rows(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, text, tag, label) of annotated documents."""
    null = F.array().cast("array<string>")
    tags = F.col("tags") if "tags" in annotated.columns else null
    labels = F.col("labels") if "labels" in annotated.columns else null
    zipped = annotated.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(F.col("tokens").alias("text"), tags.alias("tag"), labels.alias("label"))).alias("pos", "t"))
    return zipped.select("doc_id", "pos", "t.text", "t.tag", "t.label")


def sentence_rows(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return annotated.select(F.col(id_col).alias("doc_id"), F.posexplode("sentences").alias("sent_pos", "text"))


def entity_rows(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return chunking.chunk(token_rows(annotated, id_col))

"""Models from labelled data: tokens, tags, labels, features, recogniser, end to end.

Data are rows (doc_id, text, accept, spans) with spans an array of (start, end, label) of
character offsets, as sources.tagged reads them. Rows that are not accepted, and rows
without spans, give tokens that are labelled O.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, ner, pos
from ..operators.tokenize import TokenizerConfig, tokenize
from ..sources import seed
from ..sources.models import Model


def corpus(data: DataFrame, tagger: pos.Tagger, tokenizer=TokenizerConfig()) -> DataFrame:
    """(doc_id, pos, text, tag, label) of labelled data; ``tokenizer`` is a configuration or
    a function of the text column."""
    made = tokenizer(F.col("text")) if callable(tokenizer) else tokenize(F.col("text"), tokenizer)
    words = data.select("doc_id", made.alias("words")).withColumn("tags", pos.tag_udf(tagger)(F.col("words")))
    tokens = words.select("doc_id", F.posexplode(F.arrays_zip(F.col("words").alias("text"), F.col("tags").alias("tag"))).alias("pos", "t")).select("doc_id", "pos", "t.text", "t.tag")
    spans = data.select("doc_id", "text", "accept", F.posexplode("spans").alias("span_no", "s"))
    moved = spans.select("doc_id", "span_no", T.adjusted_position(F.col("text"), F.col("s.start")).alias("start"), T.adjusted_position(F.col("text"), F.col("s.end")).alias("end"), "s.label", F.coalesce("accept", F.lit(False)).alias("accept"))
    return ner.assign_labels(tokens, moved)


def using_entities(data: DataFrame, tokenizer=TokenizerConfig(), iterations: int = 100, base_words: tuple[str, ...] = (), consistent_history: bool = False) -> Callable[[Model], None]:
    """A source for model_from_data(): it trains the model's recogniser from labelled data,
    tagged by the model's tagger."""

    def source(model: Model) -> None:
        labelled = corpus(data, model.tagger, tokenizer)
        model.recognizer = ner.train(features.entity_context(labelled, base_words, consistent_history), iterations, base_words)

    return source


def using_recognizer(recognizer: ner.Recognizer) -> Callable[[Model], None]:
    """A source that puts a trained recogniser into the model."""

    def source(model: Model) -> None:
        model.recognizer = recognizer

    return source


def model_from_data(name: str, *sources: Callable[[Model], None], tagger: pos.Tagger | None = None) -> Model:
    """A model with a tagger (that of the default model, if none is given) and what the
    sources give it."""
    model = Model(name, tagger or default_tagger())
    for source in sources:
        source(model)
    return model


def default_tagger() -> pos.Tagger:
    sentences = [tuple(zip(*(item.rsplit("/", 1) for item in line.split()), strict=True)) for line in seed.TAGGED.splitlines()]
    return pos.train([(list(words), list(tags)) for words, tags in sentences], epochs=8)


def default_model(spark: SparkSession, tagging: bool = True, extracting: bool = True, iterations: int = 8) -> Model:
    """The model for those who have none: trained on the seed text, by what is asked for."""
    model = Model("default", default_tagger() if tagging or extracting else None)
    if extracting:
        rows = [(k, text, True, [(text.index(part), text.index(part) + len(part), label) for part, label in parts]) for k, (text, parts) in enumerate(seed.ENTITIES)]
        using_entities(spark.createDataFrame(rows, "doc_id long, text string, accept boolean, spans array<struct<start:int,end:int,label:string>>"), iterations=iterations)(model)
    return model

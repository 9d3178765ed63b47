"""SQL names of the operators: nlp_tokenize, nlp_sentences, nlp_tag, nlp_labels (of tokens
and tags), nlp_entities (of a text) and the table function nlp_tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators import ner, pos, segment
from ..operators.chunk import chunk_words
from ..sources.models import Model
from . import constants as C


def register(spark: SparkSession, model: Model | None = None, parameters: segment.Parameters = segment.Parameters()) -> None:
    spark.udf.register("nlp_sentences", segment.sentences_udf(parameters))
    spark.udf.register("nlp_tokenize", _tokenize_udf())
    if model and model.tagger:
        spark.udf.register("nlp_tag", pos.tag_udf(model.tagger))
    if model and model.recognizer:
        spark.udf.register("nlp_labels", ner.label_udf(model.recognizer))
        if model.tagger:
            spark.udf.register("nlp_entities", _entities_udf(model))

    @udtf(returnType="pos int, text string")
    class Tokens:
        def eval(self, text: str):
            for k, t in enumerate(tokenize_text(text)):
                yield k, t

    spark.udtf.register("nlp_tokens", Tokens)


def _entities_udf(model: Model):
    """The entities of a text: array of (text, label)."""
    tagger, recognizer = model.tagger, model.recognizer

    @F.pandas_udf("array<struct<text:string,label:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def of(text):
            words = tokenize_text(text)
            if words is None:
                return None
            tags = pos.tag_words(words, tagger)
            return [{"text": t, "label": x} for t, x in chunk_words(words, tags, ner.label_words(words, tags, recognizer))]

        return texts.map(of)

    return run


def _tokenize_udf():
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(tokenize_text)

    return run


def tokenize_text(text: str | None) -> list[str] | None:
    """The default tokenizer on one string; equal to operators.tokenize.tokenize."""
    import re

    if text is None:
        return None
    clean = text.translate(str.maketrans("“”‘’", "\"\"''")).replace("&rsquo;", "'")
    special = re.compile(C.SPECIAL.replace(r"\z", r"\Z"))
    out = []
    for span in clean.split():
        back: list[str] = []
        while span:
            if span in C.EMOTICONS or special.search(span):
                break
            lower = span.lower()
            head = next((p for p in C.PREFIXES if span.startswith(p) and len(span) > len(p)), None)
            at = next((lower.index(c) for c in C.CONTRACTIONS if c in lower and len(span) > len(c)), 0)
            tail = next((s for s in C.SUFFIXES if span.endswith(s) and len(span) > len(s)), None)
            if head:
                out.append(head)
                span = span[len(head) :]
            elif at > 0:
                out.append(span[:at])
                span = span[at:]
            elif tail:
                back.insert(0, tail)
                span = span[: -len(tail)]
            else:
                break
        out += [span] if span else []
        out += back
    return out

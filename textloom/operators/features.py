"""Context features of taggers and recognisers, as window columns over token tables.

Tables have (doc_id, pos, text) and, where named, tag and label. All windows share one
partitioning by document, so Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _order():
    return Window.partitionBy("doc_id").orderBy("pos")


def _near(name: str, k: int, default: Column) -> Column:
    w = _order()
    return F.coalesce(F.lag(name, -k).over(w) if k < 0 else F.lead(name, k).over(w), default) if k > 0 else F.coalesce(F.lag(name, -k).over(w), default)


def tagging_context(tokens: DataFrame) -> DataFrame:
    """The ten features of a tagger that do not depend on earlier tags."""
    own = tokens.withColumn("norm", T.normalize(F.col("text")))
    w = _order()
    n = F.row_number().over(w)
    left = F.count("*").over(Window.partitionBy("doc_id")) - n
    back1 = F.coalesce(F.lag("norm", 1).over(w), F.lit("-START2-"))
    back2 = F.coalesce(F.lag("norm", 2).over(w), F.when(n == 1, F.lit("-START-")).otherwise(F.lit("-START2-")))
    next1 = F.coalesce(F.lead("norm", 1).over(w), F.lit("-END-"))
    next2 = F.coalesce(F.lead("norm", 2).over(w), F.when(left == 0, F.lit("-END2-")).otherwise(F.lit("-END-")))
    return own.select(
        "doc_id", "pos", "text", F.right("text", F.lit(3)).alias("suffix"), F.left("text", F.lit(1)).alias("pref1"), F.col("norm").alias("word"),
        back1.alias("prev_word"), F.right(back1, F.lit(3)).alias("prev_suffix"), back2.alias("prev2_word"),
        next1.alias("next_word"), F.right(next1, F.lit(3)).alias("next_suffix"), next2.alias("next2_word"),
    )


def entity_context(tokens: DataFrame, base_words: Iterable[str] = (), consistent_history: bool = False) -> DataFrame:
    """The seventeen features of each token, given tags and gold labels as history.
    ``base_words`` is the word list of the feature en-wordlist. The history of training
    is the whole label (B-X), that of decoding only its first part (B); with
    ``consistent_history`` training takes the first part too."""
    w = _order()
    none = F.lit("None")
    shaped = tokens.withColumn("shape", T.shape(F.col("text"))).withColumn("at", F.row_number().over(w))
    prev_word = F.coalesce(F.lower(F.lag("text").over(w)), none)
    before = F.lag("label").over(w)
    prev_tag = F.coalesce(T.simple_tag(before) if consistent_history else before, none)
    prev_pos = F.coalesce(F.lag("tag").over(w), none)
    prev_shape = F.when(F.col("at") > 2, F.lag("shape").over(w)).otherwise(none)
    next_pos = F.coalesce(F.lower(F.lead("tag").over(w)), none)
    next_word = F.coalesce(F.lower(F.lead("text").over(w)), none)
    basic = F.when(F.col("text").isin(list(base_words)), "True").otherwise("False") if base_words else F.lit("False")
    join = lambda a, b: F.concat_ws("+", a, b)
    return shaped.select(
        "doc_id", "pos", "text", "tag", "label",
        F.lit("True").alias("bias"), basic.alias("en-wordlist"), next_pos.alias("nextpos"), next_word.alias("nextword"), F.col("tag").alias("pos_"),
        join(F.col("tag"), prev_tag).alias("pos+prevtag"), T.prefix(F.col("text")).alias("prefix3"), prev_pos.alias("prevpos"), prev_tag.alias("prevtag"),
        prev_word.alias("prevword"), F.col("shape"), join(prev_shape, prev_tag).alias("shape+prevtag"), T.suffix(F.col("text")).alias("suffix3"),
        F.col("text").alias("word"), join(F.lower("text"), next_pos).alias("word+nextpos"), F.lower("text").alias("word.lower"), F.octet_length("text").cast("string").alias("wordlen"),
    )


def long_features(context: DataFrame) -> DataFrame:
    """(doc_id, pos, label, fname, fval): one row a feature."""
    from ..functions.constants import FEATURES

    pairs = F.array(*(F.struct(F.lit(f).alias("fname"), F.col("pos_" if f == "pos" else f"`{f}`").alias("fval")) for f in FEATURES))
    return context.select("doc_id", "pos", "label", F.explode(pairs).alias("f")).select("doc_id", "pos", "label", "f.fname", "f.fval")

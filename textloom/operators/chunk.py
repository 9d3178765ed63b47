"""Entities from token labels, as windows.

A document has two states, in or out of an entity. At each token the next state is
known for either state before it, so a token resets the state, keeps it or toggles
it; the state is the last reset plus the parity of toggles since. An entity still open
at the end of a document is not returned unless ``flush_tail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk(tokens: DataFrame, flush_tail: bool = False) -> DataFrame:
    """(doc_id, ent_pos, text, label, start_pos, end_pos) of tokens (doc_id, pos, text,
    tag, label)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.select("doc_id", "pos", "text", "tag", "label", F.lag("label").over(w).alias("pl"), F.lag("tag").over(w).alias("pt"))
    ended = F.regexp_replace("pl", "^([^B]*)B", "$1I")
    some = F.col("label") != "O"
    closed = some
    opened = F.coalesce((some & (F.col("label") != ended)) | (F.col("tag") == F.col("pt")) | ((F.col("tag") == "CD") & (F.col("pl") != "O")), F.lit(False))
    t = t.withColumn("c", closed.cast("int")).withColumn("o", opened.cast("int"))
    t = t.withColumn("rv", F.when(F.col("c") == F.col("o"), F.col("c"))).withColumn("tg", F.when((F.col("c") == 1) & (F.col("o") == 0), 1).otherwise(0))
    t = t.withColumn("ct", F.sum("tg").over(up))
    t = t.withColumn("last", F.last("rv", ignorenulls=True).over(up)).withColumn("base", F.last(F.when(F.col("rv").isNotNull(), F.col("ct")), ignorenulls=True).over(up))
    t = t.withColumn("st", F.pmod(F.coalesce("last", F.lit(0)) + F.col("ct") - F.coalesce("base", F.lit(0)), F.lit(2)))
    t = t.withColumn("ps", F.coalesce(F.lag("st").over(w), F.lit(0)))
    t = t.withColumn("ent", F.sum(F.when((F.col("ps") == 0) & (F.col("st") == 1), 1).otherwise(0)).over(up))
    inside = t.filter((F.col("st") == 1) | ((F.col("ps") == 1) & (F.col("label") != "O")))
    emitted = t.filter((F.col("ps") == 1) & (F.col("st") == 0)).select("doc_id", "ent")
    parts = F.sort_array(F.collect_list(F.struct("pos", "text", "label")))
    found = inside.groupBy("doc_id", "ent").agg(parts.alias("p"), F.count("*").alias("n"))
    if not flush_tail:
        found = found.join(emitted, ["doc_id", "ent"], "left_semi")
    first = F.split(F.col("p")[0]["label"], "-")
    person = (F.col("n") == 2) & F.exists("p", lambda x: x["label"] == "B-PERSON")
    label = F.when(person, "PERSON").otherwise(F.coalesce(F.try_element_at(first, F.lit(2)), F.lit("")))
    return found.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("ent")) - 1).cast("int").alias("ent_pos"),
        F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), label.alias("label"),
        F.col("p")[0]["pos"].alias("start_pos"), F.element_at("p", -1)["pos"].alias("end_pos"),
    )


def chunk_words(words: list[str], tags: list[str], labels: list[str], flush_tail: bool = False) -> list[tuple[str, str]]:
    """(text, label) of the entities of one text, by the same rule, for SQL functions."""
    out: list[tuple[str, str]] = []
    part: list[tuple[str, str, str]] = []

    def close():
        named = [p[2] for p in part]
        label = "PERSON" if len(part) == 2 and "B-PERSON" in named else (named[0].split("-") + [""])[1]
        out.append((" ".join(p[0] for p in part), label))
        part.clear()

    for item in zip(words, tags, labels, strict=True):
        _, tag, label = item
        ended = part[-1][2].replace("B", "I", 1) if part else ""
        if (label != "O" and label != ended) or part and (tag == part[-1][1] or tag == "CD" and part[-1][2] != "O"):
            part.append(item)
        elif part:
            if label != "O":
                part.append(item)
            close()
    if part and flush_tail:
        close()
    return out

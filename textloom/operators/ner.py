"""Named entities: maximum entropy by generalised iterative scaling.

Training is relational: encoded features are an (example, label, feature id) table; an
iteration is a join with the weights, a log-sum-exp over labels and a sum by feature. The
weights stay a DataFrame, written in the shared folder after each iteration. Only the
finished model is collected, for the decoder.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..storage import stored
from .features import long_features


@dataclass
class Recognizer:
    labels: list[str] = field(default_factory=list)
    #: (feature name, value) -> {label: weight}
    weights: dict[tuple[str, str], dict[str, float]] = field(default_factory=dict)
    base_words: tuple[str, ...] = ()


def assign_labels(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens with ``label``: B-, I- or O by labelled spans (doc_id, span_no, start, end,
    label, and accept if there) of offsets in the text without spaces; of spans over a
    token the last counts. Spans that are not accepted leave no label."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = tokens.withColumn("off", F.coalesce(F.sum(T.non_space_length(F.col("text"))).over(before), F.lit(0)))
    if "accept" in spans.columns:
        spans = spans.filter("accept")
    s = spans.select(F.col("doc_id").alias("s_doc"), "span_no", "start", "end", F.col("label").alias("name"))
    hit = at.join(s, (F.col("doc_id") == F.col("s_doc")) & (F.col("off") >= F.col("start")) & (F.col("off") < F.col("end")), "left")
    label = F.when(F.col("name").isNull(), "O").when(F.col("off") == F.col("start"), F.concat(F.lit("B-"), "name")).otherwise(F.concat(F.lit("I-"), "name"))
    top = F.max(F.struct(F.coalesce("span_no", F.lit(-1)).alias("k"), label.alias("label"))).alias("m")
    return hit.groupBy(*tokens.columns).agg(top).select(*tokens.columns, F.col("m.label").alias("label"))


def encode(features: DataFrame) -> DataFrame:
    """(fname, fval, label, fid): dense ids, in order, of the feature values seen with each
    label. Ranks are taken within (name, first two characters of the value); only the
    counts of those small groups are added up in one place."""
    seen = features.select("fname", "fval", "label").distinct().withColumn("head", F.left("fval", F.lit(2)))
    sizes = seen.groupBy("fname", "head").agg(F.count("*").alias("n"))
    starts = sizes.select("fname", "head", (F.sum("n").over(Window.orderBy("fname", "head")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("fname", "head").orderBy("fval", "label")) - 1
    ranked = seen.withColumn("rank", rank).join(starts, ["fname", "head"])
    return ranked.select("fname", "fval", "label", (F.col("first") + F.col("rank")).cast("int").alias("fid"))


def empirical_counts(features: DataFrame, mapping: DataFrame) -> DataFrame:
    return features.join(mapping, ["fname", "fval", "label"]).groupBy("fid").agg(F.count("*").alias("n"))


def candidates(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, pos, cand, fid): the feature ids of each example under every label that
    any of its values was seen with."""
    m = mapping.select("fname", "fval", F.col("label").alias("cand"), "fid")
    return features.join(m, ["fname", "fval"]).select("doc_id", "pos", "cand", "fid")


def probabilities(cand: DataFrame, weights: DataFrame, labels: list[str], cardinality: int, correction: Column | float) -> DataFrame:
    """(doc_id, pos, cand, p, extra): the probability of every label for every example, from
    the candidates' weights and ``correction`` for each feature that a label lacks."""
    known = cand.join(weights, "fid").groupBy("doc_id", "pos", "cand").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    # every label for each example; labels are a short list
    grid = cand.select("doc_id", "pos").distinct().select("doc_id", "pos", F.explode(F.array(*map(F.lit, labels))).alias("cand"))
    lacking = cardinality - F.coalesce("n", F.lit(0))
    share = correction if isinstance(correction, Column) else F.lit(float(correction))
    full = grid.join(known, ["doc_id", "pos", "cand"], "left").select("doc_id", "pos", "cand", (F.coalesce("s", F.lit(0.0)) + share * lacking).alias("v"), lacking.alias("extra"))
    w = Window.partitionBy("doc_id", "pos")
    raised = full.withColumn("p", F.pow(F.lit(2.0), F.col("v") - F.max("v").over(w)))
    return raised.select("doc_id", "pos", "cand", (F.col("p") / F.sum("p").over(w)).alias("p"), "extra")


def expected(cand: DataFrame, p: DataFrame) -> DataFrame:
    """(fid, est): expected counts; fid -1 is the correction feature."""
    est = cand.join(p.select("doc_id", "pos", "cand", "p"), ["doc_id", "pos", "cand"]).groupBy("fid").agg(F.sum("p").alias("est"))
    return est.unionByName(p.select(F.lit(-1).alias("fid"), (F.col("p") * F.col("extra")).alias("est")).groupBy("fid").agg(F.sum("est").alias("est")))


def scaled_step(cand: DataFrame, weights: DataFrame, labels: list[str], cardinality: int, correction: float) -> DataFrame:
    """(fid, est): expected counts under the weights; fid -1 is the correction feature."""
    return expected(cand, probabilities(cand, weights, labels, cardinality, correction))


def prob_classify(features: DataFrame, mapping: DataFrame, weights: DataFrame, labels: list[str], cardinality: int) -> DataFrame:
    """(doc_id, pos, label, p): the distribution over labels of each example (doc_id, pos,
    fname, fval) under weights (fid, w), in which fid -1 is the correction."""
    made = probabilities(candidates(features, mapping), weights.filter("fid >= 0"), labels, cardinality, 0.0)
    correction = weights.filter("fid = -1").agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("c"))
    raised = made.crossJoin(F.broadcast(correction)).withColumn("v", F.log2("p") + F.col("c") * F.col("extra"))
    w = Window.partitionBy("doc_id", "pos")
    out = raised.withColumn("q", F.pow(F.lit(2.0), F.col("v") - F.max("v").over(w)))
    return out.select("doc_id", "pos", F.col("cand").alias("label"), (F.col("q") / F.sum("q").over(w)).alias("p"))


def train(context: DataFrame, iterations: int = 100, base_words: tuple[str, ...] = ()) -> Recognizer:
    """A recogniser from entity contexts with gold labels."""
    features = stored(long_features(context), "features")
    mapping = stored(encode(features), "mapping")
    labels = [r[0] for r in features.select("label").distinct().orderBy("label").collect()]
    cand = stored(candidates(features, mapping), "candidates")
    cardinality = mapping.select("fname").distinct().count() + 1
    gold = empirical_counts(features, mapping).select("fid", F.col("n").cast("double").alias("n"))
    left = features.groupBy("doc_id", "pos").count().agg(F.coalesce(F.sum(cardinality - F.col("count")), F.lit(0)).cast("double").alias("n"))
    counts = stored(gold.unionByName(left.select(F.lit(-1).alias("fid"), "n")), "counts")
    weights = counts.select("fid", F.lit(0.0).alias("w"))
    correction = 0.0
    for _ in range(iterations):
        est = scaled_step(cand, weights.filter("fid >= 0"), labels, cardinality, correction)
        moved = counts.join(weights, "fid").join(est, "fid", "left")
        step = (F.log2("n") - F.log2("est")) / cardinality
        fresh = stored(moved.select("fid", F.when((F.col("n") > 0) & (F.col("est") > 0), F.col("w") + step).otherwise(float("-inf")).alias("w")), "weights")
        weights, correction = fresh, fresh.filter("fid = -1").first()[1]
    out = Recognizer(labels, {}, base_words)
    for r in mapping.join(weights, "fid").select("fname", "fval", "label", "w").collect():
        out.weights.setdefault((r.fname, r.fval), {})[r.label] = r.w
    return out


def _simple(label: str) -> str:
    return "v" if label.startswith("V") else label.split("-", 1)[0]


def _shape(word: str) -> str:
    """functions.text.shape of one word, for the decoder."""

    def number() -> bool:
        if re.fullmatch(r"[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+", word):
            return True
        if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", word):
            return math.isfinite(float(word))
        return bool(re.fullmatch(r"[+-]?(?i:inf|infinity)|(?i:nan)", word))

    if number():
        return "number"
    if re.search(r"[^A-Za-z0-9_]\Z", word):
        return "punct"
    if word.lower() == word:
        return "downcase"
    return "upcase" if not re.search(r"(?:^|[^\w]|\s)(?=[^\W\d_])[a-zß-öø-ÿ]", word) else "mixedcase"


def label_words(words: list[str], tags: list[str], model: Recognizer) -> list[str]:
    """Labels in order; each depends on the label before it."""
    out: list[str] = []
    base = frozenset(model.base_words)
    shapes = [_shape(w) for w in words]
    for i, (w, t) in enumerate(zip(words, tags, strict=True)):
        last = i == len(words) - 1
        prev = _simple(out[-1]) if i else "None"
        nextpos = "None" if last else tags[i + 1].lower()
        values = {
            "bias": "True", "en-wordlist": str(w in base), "nextpos": nextpos, "nextword": "None" if last else words[i + 1].lower(), "pos": t,
            "pos+prevtag": f"{t}+{prev}", "prefix3": w[:3].lower(), "prevpos": tags[i - 1] if i else "None", "prevtag": prev,
            "prevword": words[i - 1].lower() if i else "None", "shape": shapes[i], "shape+prevtag": f"{shapes[i - 1] if i > 1 else 'None'}+{prev}",
            "suffix3": w[-3:].lower(), "word": w, "word+nextpos": f"{w.lower()}+{nextpos}", "word.lower": w.lower(), "wordlen": str(len(w.encode())),
        }
        score = dict.fromkeys(model.labels, 0.0)
        for f in C.FEATURES:
            for label, x in model.weights.get((f, values[f]), {}).items():
                score[label] += x
        out.append(max(sorted(score), key=lambda k: score[k], default="O"))
    return out


def label_udf(model: Recognizer):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, tags in batches:
            yield pd.Series([label_words(list(w), list(t), model) if w is not None and t is not None else None for w, t in zip(words, tags, strict=True)])

    return run

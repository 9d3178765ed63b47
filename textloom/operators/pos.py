"""Part-of-speech tagging: rules, a table of sure words, then an averaged perceptron.

The perceptron's choice depends on the two tags before, so a document is decoded in
order, one row a document (token array in, tag array out), Arrow-batched. Ties go to
the first tag by name.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

_NONE, _KEPT = re.compile(C.NONE_WORD.replace(r"\z", r"\Z"), re.A), re.compile(C.KEPT_WORD.replace(r"\z", r"\Z"))
_EMOTICONS = frozenset(C.EMOTICONS)


def rule_tag(word: Column) -> Column:
    """The tag that follows from a word's form, else null."""
    return (
        F.when(word == "-", "-")
        .when(word.isin(list(C.EMOTICONS)), "SYM")
        .when(word.startswith("@"), "NN")
        .when(word.rlike(C.NONE_WORD), "-NONE-")
        .when(word.rlike(C.KEPT_WORD), word)
    )


@dataclass
class Tagger:
    tags: dict[str, str] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)


def normalize(word: str) -> str:
    if "-" in word and not word.startswith("-"):
        return "!HYPHEN"
    if len(word.encode()) == 4 and re.fullmatch(r"[+-]?[0-9]+", word):
        return "!YEAR"
    return "!DIGITS" if "0" <= word[:1] <= "9" else word.lower()


def _features(i: int, word: str, context: list[str], p1: str, p2: str) -> list[str]:
    """context has two places before the first word and after the last."""
    at = i + 2
    return [
        "bias", f"suffix {word[-3:]}", f"pref1 {word[:1]}", f"t1 {p1}", f"t2 {p2}", f"t12 {p1} {p2}", f"w {context[at]}", f"t1w {p1} {context[at]}",
        f"w-1 {context[at - 1]}", f"s-1 {context[at - 1][-3:]}", f"w-2 {context[at - 2]}", f"w+1 {context[at + 1]}", f"s+1 {context[at + 1][-3:]}", f"w+2 {context[at + 2]}",
    ]


def _context(words: list[str]) -> list[str]:
    return ["-START-", "-START2-", *map(normalize, words), "-END-", "-END2-"]


def _predict(weights: dict, features: list[str], classes: Iterable[str]) -> str:
    score: dict[str, float] = defaultdict(float)
    for f in features:
        for c, w in weights.get(f, {}).items():
            score[c] += w
    best = max(classes, key=lambda c: (score[c], [-ord(x) for x in c]), default="")
    return best


def tag_words(words: list[str], tagger: Tagger) -> list[str]:
    context, p1, p2, out = _context(words), "-START-", "-START2-", []
    for i, w in enumerate(words):
        if w == "-":
            tag = "-"
        elif w in _EMOTICONS:
            tag = "SYM"
        elif w.startswith("@"):
            tag = "NN"
        elif _NONE.match(w):
            tag = "-NONE-"
        elif _KEPT.match(w):
            tag = w
        else:
            tag = tagger.tags.get(w) or _predict(tagger.weights, _features(i, w, context, p1, p2), tagger.classes)
        out.append(tag)
        p2, p1 = p1, tag
    return out


def tag_map(tagged: DataFrame, least: int = 20, share: float = 0.97) -> DataFrame:
    """(word, tag) of words with at least ``least`` uses, ``share`` of them one tag."""
    counts = tagged.groupBy("word", "tag").agg(F.count("*").alias("n"))
    by = counts.groupBy("word").agg(F.sum("n").alias("all"), F.max(F.struct("n", "tag")).alias("top"))
    return by.filter((F.col("all") >= least) & (F.col("top.n") / F.col("all") >= share)).select("word", F.col("top.tag").alias("tag"))


def train(sentences: list[tuple[list[str], list[str]]], epochs: int = 5, seed: int = 1, least: int = 20, share: float = 0.97) -> Tagger:
    """An averaged perceptron from (words, tags) sentences, a bounded training set."""
    counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for words, tags in sentences:
        for w, t in zip(words, tags, strict=True):
            counts[w][t] += 1
    tagger = Tagger(classes=sorted({t for _, tags in sentences for t in tags}))
    for w, found in counts.items():
        t, n = max(found.items(), key=lambda x: (x[1], x[0]))
        if sum(found.values()) >= least and n / sum(found.values()) >= share:
            tagger.tags[w] = t
    weights: dict = defaultdict(lambda: defaultdict(float))
    totals: dict = defaultdict(float)
    stamps: dict = defaultdict(int)
    now, rng, order = 0, random.Random(seed), list(sentences)
    for _ in range(epochs):
        rng.shuffle(order)
        for words, tags in order:
            context, p1, p2 = _context(words), "-START-", "-START2-"
            for i, (w, gold) in enumerate(zip(words, tags, strict=True)):
                guess = tagger.tags.get(w)
                if guess is None:
                    now += 1
                    fs = _features(i, w, context, p1, p2)
                    guess = _predict(weights, fs, tagger.classes)
                    if guess != gold:
                        for f in fs:
                            for c, step in ((gold, 1.0), (guess, -1.0)):
                                totals[f, c] += (now - stamps[f, c]) * weights[f][c]
                                stamps[f, c] = now
                                weights[f][c] += step
                p2, p1 = p1, guess
    for f, by in weights.items():
        kept = {}
        for c, w in by.items():
            mean = round((totals[f, c] + (now - stamps[f, c]) * w) / max(1, now), 3)
            if mean:
                kept[c] = mean
        if kept:
            tagger.weights[f] = kept
    return tagger


def tag_udf(tagger: Tagger):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda ws: tag_words(list(ws), tagger) if ws is not None else None)

    return run


def perceptron_scores(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, pos, class, score): the best class of each token by its (feature) rows
    and weights (feature, class, weight), as a join and two aggregates."""
    scored = features.join(weights, "feature").groupBy("doc_id", "pos", "class").agg(F.sum("weight").alias("score"))
    best = scored.groupBy("doc_id", "pos").agg(F.min(F.struct((-F.col("score")).alias("s"), "class")).alias("b"))
    return best.select("doc_id", "pos", F.col("b.class").alias("class"), (-F.col("b.s")).alias("score"))

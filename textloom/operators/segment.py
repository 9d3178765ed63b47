"""Sentence segmentation: Punkt with rules for dotted abbreviations.

Parameters are estimated without labels by ``train`` (aggregates over all texts) or
given. ``split`` cuts one text; ``sentences`` maps it over a table, row by row, so it
runs on streams too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..storage import stored

BEG_UC, MID_UC, UNK_UC, BEG_LC, MID_LC, UNK_LC = 2, 4, 8, 16, 32, 64
#: Beside the flags of letter case in a row of the rest of a model: an abbreviation.
SHORT = 128
ANY_UC, ANY_LC = BEG_UC | MID_UC | UNK_UC, BEG_LC | MID_LC | UNK_LC
#: Common English abbreviations, a seed where no trained parameters are given.
SEED_ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "rep", "sen", "gen", "col", "lt", "capt", "rev", "hon", "inc", "co", "corp", "ltd", "vs",
    "etc", "e.g", "i.e", "u.s", "u.k", "u.n", "a.m", "p.m", "d.c", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "p", "pp", "fig", "art", "ave", "blvd",
)
#: Common English words that are written in lower case within a sentence, a seed too.
SEED_LOWER = (
    "a", "an", "and", "are", "as", "at", "but", "by", "did", "do", "for", "from", "he", "her", "how", "if", "in", "is", "it", "its", "my", "next", "not", "of", "on", "or", "our", "please",
    "she", "so", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what", "when", "where", "who", "why", "will", "with", "you", "your",
)
_NUMBER = re.compile(r"^-?[.,]?\d[\d,.-]*\.?$")
_ABBREVIATION, _ELLIPSIS = re.compile(C.ABBREVIATION), re.compile(C.ELLIPSIS)
_INTERNAL = re.compile(r"[)’”\"']$")
_INITIAL = re.compile(r"^[^\W\d_]\.$")
#: A token from its first stop on, and the token behind a place.
_STOP, _NEXT = re.compile(r"[.?!]\S*"), re.compile(r"\s+(\S+)")
_INNER = re.compile("|".join(map(re.escape, C.INNER_ENDERS)))


@dataclass
class Parameters:
    """``rest`` (type, flags) holds what training found beyond the tables kept here;
    ``sentences`` joins to each text what it needs of it, which becomes ``more``. Without
    ``rest_abbreviates`` all abbreviations are here and the rest has letter cases alone."""

    abbreviations: frozenset[str] = frozenset((*SEED_ABBREVIATIONS, *C.EXTRA_ABBREVIATIONS))
    collocations: frozenset[tuple[str, str]] = frozenset()
    starters: frozenset[str] = frozenset({"i"})
    ortho: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SEED_LOWER, BEG_UC | BEG_LC | MID_LC))
    rest: DataFrame | None = None
    more: Mapping[str, int] = field(default_factory=dict)
    rest_abbreviates: bool = True

    def abbreviates(self, word: str) -> bool:
        return word in self.abbreviations or bool(self.more.get(word, 0) & SHORT)

    def seen(self, kind: str) -> int:
        found = self.ortho.get(kind)
        return self.more.get(kind, 0) & (ANY_UC | ANY_LC) if found is None else found


def ends(token: str) -> bool:
    return (token.endswith(C.ENDERS) and C.NEVER_END not in token) or bool(_INNER.search(token))


def type_of(token: str) -> str:
    return "##number##" if _NUMBER.match(token) else token.lower()


def bare(token: str) -> str:
    t = type_of(token)
    return t[:-1] if len(t) > 1 and t.endswith(".") else t


class _Token:
    """``single``: its only stop is its last character."""

    __slots__ = ("text", "single", "ends", "abbreviated", "ellipsis")

    def __init__(self, text: str, single: bool = False):
        self.text, self.single, self.ends, self.abbreviated, self.ellipsis = text, single, False, False, False

    @property
    def upper(self) -> bool:
        return self.text[:1].isupper()

    @property
    def lower(self) -> bool:
        return self.text[:1].islower()


def _first_pass(t: _Token, p: Parameters) -> None:
    if not (t.single and t.text.endswith(".")) and ends(t.text):
        t.ends = True
    elif t.text.endswith(".."):
        t.ellipsis = True
    elif t.text.endswith("."):
        word = t.text[:-1].lower()
        if p.abbreviates(word) or p.abbreviates(word.rsplit("-", 1)[-1]):
            t.abbreviated = True
        else:
            t.ends = True


def _evidence(t: _Token, p: Parameters) -> int:
    """1: it starts a sentence, 0: it does not, -1: unknown."""
    if t.text in {";", ":", ",", ".", "!", "?"}:
        return 0
    seen = p.seen(bare(t.text))
    if t.upper and seen & ANY_LC and not seen & MID_UC:
        return 1
    if t.lower and (seen & ANY_UC or not seen & BEG_LC):
        return 0
    return -1


def _pair(one: _Token, two: _Token, p: Parameters) -> None:
    if not one.text.endswith("."):
        return
    first, following = bare(one.text), bare(two.text)
    initial = bool(_INITIAL.match(one.text))
    if (first, following) in p.collocations:
        one.ends, one.abbreviated = False, True
        return
    if (one.abbreviated or one.ellipsis) and not initial:
        if _evidence(two, p) == 1 or (two.upper and following in p.starters):
            one.ends = True
            return
    if initial or first == "##number##":
        known = _evidence(two, p)
        if known == 0 or (known == -1 and initial and two.upper and not p.seen(following) & ANY_LC):
            one.ends, one.abbreviated = False, True


def _dotted(one: _Token, two: _Token, p: Parameters) -> None:
    """The rules for ellipses, inner ends and dotted abbreviations."""
    stop, following = one.text.endswith("."), bare(two.text)
    if stop and two.text == ".":
        one.ends = two.ends = False
        return
    if _ELLIPSIS.search(one.text) and (two.upper or following in p.starters):
        one.ends = True
        return
    if one.ends and _INTERNAL.search(one.text) and two.lower and following not in p.starters:
        one.ends = False
        return
    if stop and not one.ends and two.upper and p.seen(following) & ANY_LC:
        one.ends = True
    if not _ABBREVIATION.search(one.text) or _INITIAL.match(one.text):
        return
    one.abbreviated = True
    one.ends = _evidence(two, p) == 1 or (two.upper and following in p.starters)


def _stop_tokens(text: str) -> tuple[list[_Token], list[tuple[int, int]]]:
    """The tokens that hold a stop, and their places. No other can end a sentence or be
    changed by a rule."""
    tokens, places, done = [], [], 0
    for m in _STOP.finditer(text):
        at, end = m.span()
        head = text[done:at]
        start = at if not head or head[-1].isspace() else at - len(head.rsplit(None, 1)[-1])
        tokens.append(_Token(text[start:end], at == end - 1))
        places.append((start, end))
        done = end
    return tokens, places


def _settled(t: _Token, p: Parameters) -> bool:
    """Whether no rule changes a token after the first pass, save one on a lone stop behind
    it: a word that is no initial, number or abbreviation, with one stop, its last
    character. No rule looks up what stands behind it."""
    return t.single and t.ends and len(t.text) > 2 and t.text[0].isalpha() and not p.collocations


def _pairs(text: str, tokens: list[_Token], places: list[tuple[int, int]], settled) -> list[tuple[_Token, _Token]]:
    """Each token that is not settled, or has a lone stop behind it, with what is there."""
    out = []
    for k, t in enumerate(tokens):
        lone = k + 1 < len(tokens) and len(tokens[k + 1].text) == 1
        if (lone or not settled(t)) and (two := _NEXT.match(text, places[k][1])):
            same = k + 1 < len(tokens) and places[k + 1][0] == two.start(1)
            out.append((t, tokens[k + 1] if same else _Token(two.group(1))))
    return out


def split(text: str | None, p: Parameters = Parameters()) -> list[str]:
    """The sentences of a text, trimmed, inner line breaks kept."""
    text = text or ""
    tokens, places = _stop_tokens(text)
    for t in tokens:
        _first_pass(t, p)
    pairs = _pairs(text, tokens, places, lambda t: _settled(t, p))
    for rule in (_pair, _dotted):
        for one, two in pairs:
            rule(one, two, p)
    out, start = [], 0
    for t, (_, end) in zip(tokens, places):
        if t.ends:
            out.append(text[start:end].strip())
            start = end
    last = text[start:].strip()
    return [*out, last] if last else out


def sentences_udf(p: Parameters = Parameters()):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split(t, p))

    return run


def _needed(text: str | None, p: Parameters) -> list[str]:
    """The types of a text that a rule may look up and that p does not hold itself."""
    tokens, places = _stop_tokens(text or "")
    for t in tokens:
        _first_pass(t, p)
    # Where the rest has abbreviations, a word with a final stop may be one.
    settled = lambda t: _settled(t, p) and not (p.rest_abbreviates and t.text.endswith("."))
    types = {t for _, two in _pairs(text or "", tokens, places, settled) if (t := bare(two.text)) not in p.ortho}
    if not p.rest_abbreviates:
        return list(types)
    short = {t.text[:-1].lower() for t in tokens if t.text.endswith(".")}
    return list(types | (short | {w.rsplit("-", 1)[-1] for w in short}) - p.abbreviations)


def _needed_udf(p: Parameters):
    p = replace(p, rest=None)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _needed(t, p))

    return run


def _sentences_with_rest_udf(p: Parameters):
    p = replace(p, rest=None)

    def cut(text: str | None, types, flags) -> list[str]:
        more: dict[str, int] = {}
        if types is not None:
            for t, f in zip(types, flags):
                more[t] = more.get(t, 0) | int(f)
        return split(text, replace(p, more=more))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, types, flags in batches:
            yield pd.Series([cut(*x) for x in zip(texts, types, flags)], dtype=object)

    return run


def sentences(docs: DataFrame, p: Parameters = Parameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_pos, text). With p.rest, texts are joined by hash, so that copies
    share it, to the entries of the rest that they need (texts of one hash get those of
    both); else row by row."""
    if p.rest is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences_udf(p)(F.col(text_col))).alias("sent_pos", "text"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    needed = own.select("digest", F.explode(_needed_udf(p)(F.col("text"))).alias("type")).distinct()
    found = needed.join(p.rest, "type").groupBy("digest").agg(F.collect_list(F.struct("type", "flags")).alias("more"))
    cut = _sentences_with_rest_udf(p)(F.col("text"), F.col("more.type"), F.col("more.flags"))
    return own.join(found, "digest", "left").select("doc_id", F.posexplode(cut).alias("sent_pos", "text"))


def _without_stop(word: Column) -> Column:
    """The word without a final stop, unless it is one."""
    return F.when(word.endswith(".") & (F.char_length(word) > 1), F.left(word, F.char_length(word) - 1)).otherwise(word)


def type_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, with_stop, without_stop): how often each type has a final stop. Words are
    counted as they stand, so that distinct ones alone get a type."""
    word = docs.select(F.explode(T.space_split(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    number = (F.col("w") < ":") & F.col("w").rlike(r"^-?[.,]?[0-9][0-9,.-]*\.?\z")
    base = F.when(number, "##number##").otherwise(_without_stop(F.lower("w")))
    stop = F.col("w").endswith(".") & (F.char_length("w") > 1)
    kinds = word.select(base.alias("type"), F.when(stop, F.col("n")).otherwise(0).alias("s"), "n")
    return kinds.groupBy("type").agg(F.sum("s").alias("with_stop"), F.sum(F.col("n") - F.col("s")).alias("without_stop"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(type, score) of types seen with a stop: a log-likelihood ratio weighted by the
    type's length, inner stops and how often it stands without one."""
    total = counts.agg(F.sum(F.col("with_stop") + F.col("without_stop")).alias("all"), F.sum("with_stop").alias("stops"))
    t = counts.filter("with_stop > 0").crossJoin(F.broadcast(total))
    a = (F.col("with_stop") + F.col("without_stop")).cast("double")
    p1 = F.col("stops") / F.col("all")
    null = F.col("with_stop") * F.log(p1) + F.col("without_stop") * F.log(1 - p1 + 1e-12)
    alt = F.col("with_stop") * F.lit(math.log(0.99)) + F.col("without_stop") * F.lit(math.log(0.01))
    dots = F.char_length("type") - F.char_length(F.replace("type", F.lit("."), F.lit("")))
    others = F.char_length("type") - dots + 1
    score = -2 * (null - alt) * F.exp(-others.cast("double")) * (dots + 1) * F.pow(others.cast("double"), -F.col("without_stop").cast("double"))
    return t.withColumn("a", a).select("type", "with_stop", "without_stop", score.alias("score"))


def _beyond(df: DataFrame, value: str, head: list[Row], most: int) -> DataFrame:
    """The rows behind the last of head in the order (value descending, type)."""
    if len(head) < most:
        return df.limit(0)
    last = head[-1]
    return df.filter((F.col(value) < last[value]) | ((F.col(value) == last[value]) & (F.col("type") > last["type"])))


def train(docs: DataFrame, text_col: str = "text", least: float = 0.3, most: int = 50_000) -> Parameters:
    """Parameters from all texts: abbreviations by score, then orthographic contexts. The
    ``most`` entries of each table that score or occur most travel with the code; all
    others stay a table, ``rest``, that ``sentences`` joins. Empty tables give no entries.
    Collocations and frequent starters are not estimated."""
    spark = docs.sparkSession
    counts = stored(type_counts(docs, text_col), "types")
    scored = abbreviation_scores(counts).filter((F.col("score") >= least) & (F.col("type") != "##number##") & F.col("type").rlike("[a-z]"))
    scored = stored(scored.select("type", "score"), "abbreviations")
    first = scored.orderBy(F.desc("score"), "type").limit(most).collect()
    fixed = spark.createDataFrame([(x,) for x in C.EXTRA_ABBREVIATIONS], "type string")
    known = scored.select("type").union(fixed).distinct()
    contexts = stored(ortho_contexts(docs, known, text_col, few=len(first) < most), "contexts")
    ortho = contexts.orderBy(F.desc("n"), "type").limit(most).collect()
    rest = None
    if len(first) == most or len(ortho) == most:
        short = _beyond(scored, "score", first, most).select("type", F.lit(SHORT).alias("flags"))
        rest = _beyond(contexts, "n", ortho, most).select("type", "flags").union(short)
    return Parameters(frozenset(r["type"] for r in first) | frozenset(C.EXTRA_ABBREVIATIONS), ortho={r["type"]: r["flags"] for r in ortho}, rest=rest, rest_abbreviates=len(first) == most)


def ortho_contexts(
    docs: DataFrame, abbreviations: frozenset[str] | DataFrame = frozenset((*SEED_ABBREVIATIONS, *C.EXTRA_ABBREVIATIONS)), text_col: str = "text", few: bool = False
) -> DataFrame:
    """(type, flags, n): where types were seen in upper and lower case. Abbreviations are
    a short list or a table (type): of ``few``, each pair meets it before pairs are counted,
    else counted pairs are joined to it. Words are counted as they stand, so that distinct
    ones alone get a type."""
    words = docs.select(T.space_split(F.col(text_col)).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), "w").alias("p"))).alias("x")).select("x.w", "x.p").filter("w is not null")
    p, w = F.col("p"), F.col("w")
    closed = F.lit(False)
    for x in (")", '"', "'", "’", "”"):
        closed = closed | p.endswith(x)
    stop = p.endswith(".") | p.endswith("?") | p.endswith("!") | (closed & p.rlike(r"[.?!][)\"'’”]\z"))
    before = F.regexp_replace(F.lower("p"), r"\.\z", "")
    place = F.when(p == "", "beg").when(stop, "stop").otherwise("mid")
    behind = pairs.select("w", place.alias("place"), F.when(stop, before).alias("key"))
    if isinstance(abbreviations, DataFrame):
        known = abbreviations.select(F.col("type").alias("key"), F.lit(True).alias("short"))
    if not isinstance(abbreviations, DataFrame):
        behind = behind.withColumn("short", F.col("key").isin(list(abbreviations))).drop("key")
    elif few:
        behind = behind.join(F.broadcast(known), "key", "left").drop("key")
    where = F.when(F.col("place") != "stop", F.col("place")).when(F.col("short"), "unk").otherwise("beg")
    by = ["key"] if "key" in behind.columns else []
    behind = behind.select("w", F.col("place") if by else where.alias("place"), *by)
    letter = F.when((w >= "a") & (w < "{"), "l").when((w >= "A") & (w < "["), "u").when(w < "\x80", None).when(w.rlike(r"^\p{Lu}"), "u").when(w.rlike(r"^\p{Ll}"), "l")
    counted = behind.groupBy("w", "place", *by).agg(F.count("*").alias("n")).select(_without_stop(F.lower("w")).alias("type"), letter.alias("letter"), "place", *by, "n").filter("letter is not null")
    if by:
        # A word not behind a stop gets a key that no abbreviation has, and not one for all.
        counted = counted.withColumn("key", F.coalesce("key", F.concat(F.lit(" "), "type"))).join(known, "key", "left").withColumn("place", where)
    case = F.when(F.col("letter") == "u", BEG_UC).otherwise(BEG_LC)
    shift = F.when(F.col("place") == "beg", 1).when(F.col("place") == "mid", MID_UC // BEG_UC).otherwise(UNK_UC // BEG_UC)
    return counted.select("type", (case * shift).alias("f"), "n").groupBy("type").agg(F.bit_or("f").alias("flags"), F.sum("n").alias("n"))

"""The tokenizer: white-space spans, each cut by affixes, split cases and contractions.

``tokens`` runs on distinct spans: spans repeat as words do, so the fold that cuts
them works on the vocabulary and is joined back by span. Spans of letters and digits,
and those with one plain suffix behind, need no fold and stay where they are. Tokens are exploded by the outer
form, for which the optimizer makes no filter on the array: such a filter would move
below the distinct and run the fold on every occurrence. ``tokenize`` does the same
for one text in an array column and suits streams.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


@dataclass(frozen=True)
class TokenizerConfig:
    prefixes: tuple[str, ...] = C.PREFIXES
    suffixes: tuple[str, ...] = C.SUFFIXES
    split_cases: tuple[str, ...] = ()
    contractions: tuple[str, ...] = C.CONTRACTIONS
    emoticons: tuple[str, ...] = C.EMOTICONS
    special: str = C.SPECIAL
    sanitizer: Callable[[Column], Column] | None = T.sanitize
    #: Column predicate of spans that are never split.
    unsplittable: Callable[[Column], Column] | None = None
    #: True: a split case at a remainder's start drops the remainder.
    lossy_contractions: bool = False
    cases: tuple[str, ...] = field(init=False)
    #: Whether every affix and case holds an ASCII mark, so that letters and digits alone
    #: are never cut and a span has at most two cuts a mark.
    marked: bool = field(init=False)
    #: Suffixes of one mark that, behind letters and digits, are the only cut of a span that
    #: is not special: no prefix begins with a letter, no case and no longer suffix ends so.
    plain: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "cases", (*self.split_cases, *self.contractions))
        object.__setattr__(self, "marked", all(any(c.isascii() and not c.isalnum() for c in x) for x in (*self.prefixes, *self.suffixes, *self.cases)))
        cut = self.marked and self.unsplittable is None and not any(x[0].isalnum() or not x[0].isascii() for x in self.prefixes)
        one = [x for x in self.suffixes if len(x) == 1 and not any(c.endswith(x) for c in (*self.suffixes, *self.cases) if c != x)]
        object.__setattr__(self, "plain", tuple(one) if cut else ())


def _any(word: Column, affixes: tuple[str, ...], has: Callable) -> Column:
    """The first affix that the word has and is longer than, else null."""
    out = F.lit(None).cast("string")
    for a in reversed(affixes):
        out = F.when(has(word, a) & (F.char_length(word) > len(a)), F.lit(a)).otherwise(out)
    return out


def split_span(span: Column, config: TokenizerConfig = TokenizerConfig()) -> Column:
    """The tokens of one span, as an array."""
    none = F.array().cast("array<string>")
    state = F.struct(span.alias("rest"), none.alias("out"), none.alias("back"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        rest, out, back = s["rest"], s["out"], s["back"]
        size = F.char_length(rest)
        special = T.is_special(rest, config.emoticons, config.special)
        if config.unsplittable is not None:
            special = special | config.unsplittable(rest)
        head = _any(rest, config.prefixes, lambda w, a: w.startswith(a))
        tail = _any(rest, config.suffixes, lambda w, a: w.endswith(a))
        at = F.lit(0)
        for case in reversed(config.cases):
            found = F.instr(F.lower(rest), case)
            at = F.when((found > 0) & (size > len(case)), found).otherwise(at)
        keep = lambda rest, out, back, done: F.struct(rest.alias("rest"), out.alias("out"), back.alias("back"), F.lit(done).alias("done"))
        whole = keep(F.lit(""), F.concat(out, F.array(rest)), back, True)
        result = F.when(tail.isNotNull(), keep(F.left(rest, size - F.char_length(tail)), out, F.concat(F.array(tail), back), False)).otherwise(whole)
        if config.lossy_contractions:
            result = F.when(at == 1, keep(F.lit(""), out, back, True)).otherwise(result)
        result = F.when(at > 1, keep(F.substring(rest, at, size), F.concat(out, F.array(F.left(rest, at - 1))), back, False)).otherwise(result)
        result = F.when(head.isNotNull(), keep(F.substring(rest, F.char_length(head) + 1, size), F.concat(out, F.array(head)), back, False)).otherwise(result)
        return F.when(s["done"] | (rest == ""), s).when(special, whole).otherwise(result)

    most = F.char_length(span) + 1
    if config.marked:
        marks = F.char_length(F.regexp_replace(span, r"[\p{L}\p{N}]+", ""))
        most = F.least(most, 2 * marks + 2)
    cut = F.filter(F.aggregate(F.sequence(F.lit(1), most), state, step, lambda s: F.concat(s["out"], s["back"])), lambda t: t.rlike(r"(?U)\S"))
    return F.when(span.rlike(r"^[\p{L}\p{N}]+\z"), F.array(span)).otherwise(cut) if config.marked else cut


def tokenize(text: Column, config: TokenizerConfig = TokenizerConfig()) -> Column:
    """The tokens of a text, as an array."""
    clean = config.sanitizer(text) if config.sanitizer else text
    return F.flatten(F.transform(T.space_split(clean), lambda s: split_span(s, config)))


def spans(docs: DataFrame, config: TokenizerConfig = TokenizerConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, span_pos, span)."""
    clean = config.sanitizer(F.col(text_col)) if config.sanitizer else F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.space_split(clean)).alias("span_pos", "span"))


def split_spans(found: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """(span, tokens) of the distinct spans."""
    return found.select("span").distinct().select("span", split_span(F.col("span"), config).alias("tokens"))


def _class(chars: tuple[str, ...]) -> str:
    return "[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]"


def _whole(span: Column) -> Column:
    """Whether a span is letters and digits alone."""
    return span.rlike(r"^[\p{L}\p{N}]+\z")


def _closed(span: Column, config: TokenizerConfig) -> Column:
    out = F.lit(False)
    for x in config.plain:
        out = out | span.endswith(x)
    return out


def _cut_once(span: Column, config: TokenizerConfig) -> Column:
    """Whether a span with a plain suffix has letters and digits before it and is not special."""
    if not config.plain:
        return F.lit(False)
    return span.rlike(rf"^[\p{{L}}\p{{N}}]+{_class(config.plain)}\z") & ~T.is_special(span, config.emoticons, config.special)


def _odd(clean: Column) -> Column:
    """The spans of a text that are not letters and digits alone, as an array."""
    return F.regexp_extract_all(clean, F.lit(r"(?U)(?<!\S)[\p{L}\p{N}]*+[^\p{L}\p{N}\s]\S*+"), F.lit(0))


def tokens(docs: DataFrame, config: TokenizerConfig = TokenizerConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, span_pos, sub_pos, text) in order of (span_pos, sub_pos)."""
    found, here = spans(docs, config, id_col, text_col), []
    if config.marked:
        span, size = F.col("span"), F.char_length("span")
        closed, once = _closed(span, config), _cut_once(span, config)
        two = F.array(F.left(span, size - 1), F.right(span, F.lit(1)))
        here = [found.select("doc_id", "span_pos", F.posexplode(F.when(closed, F.when(once, two)).when(_whole(span), F.array(span))).alias("sub_pos", "text"))]
        found = found.filter(F.when(closed, ~once).otherwise(~_whole(span)))
        clean = config.sanitizer(F.col(text_col)) if config.sanitizer else F.col(text_col)
        cut = split_spans(docs.select(F.explode(_odd(clean)).alias("span")).filter(~(closed & once)), config)
    else:
        cut = split_spans(found, config)
    made = found.join(cut, "span", "left").select("doc_id", "span_pos", F.posexplode_outer("tokens").alias("sub_pos", "text")).filter("sub_pos is not null")
    for more in here:
        made = made.unionByName(more)
    return made


def tokens_per_text(docs: DataFrame, config: TokenizerConfig = TokenizerConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of texts with a token: spans that need no fold are counted in
    their text, all others by document before they meet their number of tokens, so a
    frequent span is one row a document."""
    clean = config.sanitizer(F.col(text_col)) if config.sanitizer else F.col(text_col)
    if not config.marked:
        found = spans(docs, config, id_col, text_col).withColumn("own", F.lit(0))
    else:
        # Every span that is not letters and digits alone, and a null that brings the number of all others.
        parts = docs.select(F.col(id_col).alias("doc_id"), clean.alias("clean")).select("doc_id", F.size(T.space_split(F.col("clean"))).alias("n_spans"), _odd(F.col("clean")).alias("odd"))
        span = F.col("span")
        found = parts.select("doc_id", (F.col("n_spans") - F.size("odd")).alias("whole"), F.explode(F.array_append("odd", F.lit(None).cast("string"))).alias("span"))
        own = F.when(span.isNull(), F.col("whole")).when(_closed(span, config) & _cut_once(span, config), 2)
        found = found.withColumn("own", own).select("doc_id", F.when(F.col("own").isNull(), span).alias("span"), "own")
    found = found.groupBy("doc_id", "span").agg(F.count("*").alias("n"), F.sum("own").alias("own"))
    sizes = split_spans(found.filter("span is not null"), config).select("span", F.size("tokens").alias("size"))
    n = F.when(F.col("span").isNull(), F.col("own")).otherwise(F.col("n") * F.col("size"))
    return found.join(sizes, "span", "left").groupBy("doc_id").agg(F.sum(n).alias("n_tokens")).filter("n_tokens > 0")


def alias_repeats(tagged: DataFrame, columns: tuple[str, ...] = ("tag", "label")) -> DataFrame:
    """Tokens (doc_id, span_pos, sub_pos, text, ..) with ``columns`` of the last occurrence
    of the same span in the document, as if equal spans shared their tokens. The last
    span of a document keeps its own and lends nothing."""
    from pyspark.sql import Window

    whole = F.array_join(F.collect_list("text").over(Window.partitionBy("doc_id", "span_pos").orderBy("sub_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "")
    own = tagged.withColumn("__span", whole).withColumn("__last", F.max("span_pos").over(Window.partitionBy("doc_id")) == F.col("span_pos"))
    same = Window.partitionBy("doc_id", "__span", "sub_pos", "__last")
    for c in columns:
        own = own.withColumn(c, F.when(F.col("__last"), F.col(c)).otherwise(F.max_by(c, "span_pos").over(same)))
    return own.drop("__span", "__last")


def with_positions(found: DataFrame) -> DataFrame:
    """Tokens with ``pos``, their number within the document from 0."""
    from pyspark.sql import Window

    return found.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("span_pos", "sub_pos")) - 1).cast("int"))


def token_counts(docs: DataFrame, by: list[str], config: TokenizerConfig = TokenizerConfig(), text_col: str = "text") -> DataFrame:
    """(by.., text, n): spans are counted before they are cut, so the vocabulary alone
    meets the tokenizer and nothing is joined back to places."""
    clean = config.sanitizer(F.col(text_col)) if config.sanitizer else F.col(text_col)
    counted = docs.select(*by, F.explode(T.space_split(clean)).alias("span")).groupBy(*by, "span").agg(F.count("*").alias("n"))
    cut = split_spans(counted, config)
    made = counted.join(cut, "span", "left").select(*by, F.explode_outer("tokens").alias("text"), "n").filter("text is not null")
    return made.groupBy(*by, "text").agg(F.sum("n").alias("n"))

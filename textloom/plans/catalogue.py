"""Registered queries of the engine's own operators, each with its SQL for DuckDB.

The test tables hold few quotes, dotted abbreviations or odd spaces, so queries on them
add the rows of ``SAMPLES`` (negative ids) on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import chunk as chunking
from ..operators import features as feat
from ..operators import ner, pos, segment
from ..operators import tokenize as tok
from ..sources.models import Model
from ..sources.tagged import parse_tagged, train_test
from . import pipeline

SAMPLES = [
    (-1, "“He’s here,” said Mr. James; it&rsquo;s the N.B.A., don't you know?"),
    (-2, "I can't pay $100.00. (Really!) She'll go... 'This' :-) xD [20-22]."),
    (-3, "A B C D\u0085E U.S. e.g. Dr. Jonas, i.e. wait... Yahoo! is up. \"No?\" he asked."),
    (-4, "  "),
    (-5, ""),
    (-6, "-LRB- 0 *T*-1 @you 1984 -123 well-known 12-3 1e5 inf 1_000 0x1p-2 iPhone USA McDonald O'neil"),
]
#: A short list of common words, the parameter of the word-list feature here.
WORDS = ("I", "a", "and", "are", "as", "at", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
TAG_MAP = {"the": "DT", "and": "CC", "of": "IN", "to": "TO", "is": "VBZ", "in": "IN", "a": "DT"}
CLASS_WEIGHTS = [("pref1 t", "DT", 0.5), ("pref1 t", "NN", 0.25), ("pref1 o", "IN", 0.75), ("suffix ing", "VBG", 1.5), ("suffix ing", "NN", 0.5), ("bias", "NN", 0.375), ("bias", "IN", 0.125), ("suffix the", "DT", 2.0)]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    cell = lambda x: str(x) if not isinstance(x, str) else _q(x)
    return f"(select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(id_col).alias("doc_id"), "text")
    return own.unionByName(spark.createDataFrame(SAMPLES, "doc_id long, text string"))


def _docs_sql(name: str = "documents", id_col: str = "doc_id") -> str:
    return f"(select {id_col} doc_id, text from {name} union all select * from {_values(SAMPLES, 'doc_id, text')})"


_CLEAN = "replace(translate(text, '“”‘’', '\"\"''''' ), '&rsquo;', '''')"
_SPACE = r"[\s\x{0B}\x{85}\pZ]+"
_LIST = rf"list_filter(string_split_regex({_CLEAN}, '{_SPACE}'), lambda x: x <> '')"


def _spans_sql(source: str, keys: str = "doc_id", spans: str = _LIST) -> str:
    return f"(select {keys}, unnest(l) span, generate_subscripts(l, 1) - 1 span_pos from (select {keys}, {spans} l from {source}))"


def _special_sql(x: str, config: tok.TokenizerConfig = tok.TokenizerConfig()) -> str:
    return f"({x} in ({', '.join(map(_q, config.emoticons))}) or regexp_matches({x}, {_q(config.special.replace(chr(92) + 'z', '$'))}))"


def _fold_sql(x: str, config: tok.TokenizerConfig = tok.TokenizerConfig()) -> str:
    """The tokenizer's fold over one span as a list."""
    r = "a.rest"
    make = lambda rest, out, back, done: f"{{'rest': {rest}, 'out': {out}, 'back': {back}, 'done': {done}}}"
    parts = [f"when a.done or {r} = '' then a", f"when {_special_sql(r, config)} then {make(_q(''), f'list_append(a.out, {r})', 'a.back', 'true')}"]
    parts += [f"when starts_with({r}, {_q(p)}) and length({r}) > {len(p)} then {make(f'{r}[{len(p) + 1}:]', f'list_append(a.out, {_q(p)})', 'a.back', 'false')}" for p in config.prefixes]
    at = "case " + " ".join(f"when strpos(lower({r}), {_q(c)}) > 0 and length({r}) > {len(c)} then strpos(lower({r}), {_q(c)})" for c in config.cases) + " else 0 end"
    parts.append(f"when {at} > 1 then {make(f'{r}[({at}):]', f'list_append(a.out, {r}[:({at}) - 1])', 'a.back', 'false')}")
    if config.lossy_contractions:
        parts.append(f"when {at} = 1 then {make(_q(''), 'a.out', 'a.back', 'true')}")
    parts += [f"when ends_with({r}, {_q(s)}) and length({r}) > {len(s)} then {make(f'{r}[:length({r}) - {len(s)}]', 'a.out', f'list_prepend({_q(s)}, a.back)', 'false')}" for s in config.suffixes]
    whole = make(_q(""), f"list_append(a.out, {r})", "a.back", "true")
    start = make(x, "[]::varchar[]", "[]::varchar[]", "false")
    folded = f"list_reduce(list_transform(range(0, length({x}) + 2), lambda i: {start}), lambda a, b: case {' '.join(parts)} else {whole} end)"
    return f"list_filter((select list_concat(f.out, f.back) from (select {folded} f)), lambda t: t <> '')"


def _tokens_sql(source: str, keys: str = "doc_id", config: tok.TokenizerConfig = tok.TokenizerConfig()) -> str:
    """CTEs sp, cut and tok (keys, span_pos, sub_pos, text)."""
    spans = _LIST if config.sanitizer else _LIST.replace(_CLEAN, "text")
    return f"""sp as {_spans_sql(source, keys, spans)}, cut as (select span, {_fold_sql('span', config)} toks from (select distinct span from sp)),
tok as (select {keys}, span_pos, unnest(toks) as text, generate_subscripts(toks, 1) - 1 sub_pos from sp join cut using (span))"""


_POS_SQL = "tp as (select *, row_number() over (partition by doc_id order by span_pos, sub_pos) - 1 pos from tok)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"select doc_id, md5({_CLEAN}) digest, length({_CLEAN}) n_chars from {_docs_sql()}")
def sanitize_text(spark, sf_dir):
    clean = T.sanitize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.encode(clean, "UTF-8")).alias("digest"), F.char_length(clean).cast("long").alias("n_chars"))


@query(f"select doc_id, span_pos, span from {_spans_sql(_docs_sql())}")
def whitespace_spans(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).select("doc_id", F.col("span_pos").cast("long").alias("span_pos"), "span")


@query(f"select span, count(*) n from {_spans_sql(_docs_sql())} group by 1")
def span_vocabulary(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).groupBy("span").agg(F.count("*").alias("n"))


@query(f"select span, count(*) n from {_spans_sql(_docs_sql())} where {_special_sql('span')} group by 1")
def special_tokens(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).filter(T.is_special(F.col("span"))).groupBy("span").agg(F.count("*").alias("n"))


@query(f"with {_tokens_sql(_docs_sql())} select doc_id, span_pos, sub_pos, text from tok")
def tokenize_docs(spark, sf_dir):
    return tok.tokens(_docs(spark, sf_dir)).select("doc_id", F.col("span_pos").cast("long").alias("span_pos"), F.col("sub_pos").cast("long").alias("sub_pos"), "text")


@query(f"with {_tokens_sql(_docs_sql())} select doc_id, count(*) n_tokens from tok group by 1")
def tokens_per_doc(spark, sf_dir):
    return tok.tokens_per_text(_docs(spark, sf_dir))


@query(f"with {_tokens_sql('documents', 'lang')} select lang, text, n, rnk from (select lang, text, count(*) n, row_number() over (partition by lang order by count(*) desc, text) rnk from tok group by 1, 2) where rnk <= 20")
def top_tokens_by_lang(spark, sf_dir):
    """The flagship query: twenty most frequent tokens of each language."""
    counted = tok.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "text"))
    return counted.withColumn("rnk", rank.cast("long")).filter("rnk <= 20").select("lang", "text", "n", "rnk")


@query(f"with {_tokens_sql('conversations', 'conv_id, turn')} select conv_id, turn, count(*) n_tokens, count(distinct text) n_types from tok group by 1, 2")
def tokenize_conversations(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.struct("conv_id", "turn").alias("id"), "text")
    return tok.tokens(docs, id_col="id").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("text").alias("n_types")).select("doc_id.conv_id", "doc_id.turn", "n_tokens", "n_types")


def _conversations(spark, sf_dir) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    return own.unionByName(spark.createDataFrame(SAMPLES, "doc_id long, text string"))


_CONVERSATIONS = f"(select conv_id * 100000 + turn doc_id, text from conversations union all select * from {_values(SAMPLES, 'doc_id, text')})"
_CASES = tok.TokenizerConfig(split_cases=("(", "th", "/"))


@query(f"with {_tokens_sql(_CONVERSATIONS, config=_CASES)} select doc_id, span_pos, sub_pos, text from tok")
def tokenize_custom_splitcases(spark, sf_dir):
    return tok.tokens(_conversations(spark, sf_dir), _CASES).select("doc_id", F.col("span_pos").cast("long").alias("span_pos"), F.col("sub_pos").cast("long").alias("sub_pos"), "text")


_CONTRACTIONS = tok.TokenizerConfig(contractions=("'ve", "er", "'t"))


@query(f"with {_tokens_sql(_CONVERSATIONS, config=_CONTRACTIONS)} select doc_id, span_pos, sub_pos, text from tok")
def tokenize_custom_contractions(spark, sf_dir):
    return tok.tokens(_conversations(spark, sf_dir), _CONTRACTIONS).select("doc_id", F.col("span_pos").cast("long").alias("span_pos"), F.col("sub_pos").cast("long").alias("sub_pos"), "text")


#: One option of the tokenizer each, over the conversations and the samples.
OPTIONS = {
    "tokenize_custom_prefixes": tok.TokenizerConfig(prefixes=("“", "th", "$", "[")),
    "tokenize_custom_suffixes": tok.TokenizerConfig(suffixes=("ing", ".", "”", "e")),
    "tokenize_custom_emoticons": tok.TokenizerConfig(emoticons=("(Really!)", "100.00.", ":-)")),
    "tokenize_custom_special": tok.TokenizerConfig(special=r"^[A-Z][a-z]+[.,]\z"),
    "tokenize_no_sanitizer": tok.TokenizerConfig(sanitizer=None),
    "tokenize_lossy_contractions": tok.TokenizerConfig(lossy_contractions=True),
}


def _option_query(config: tok.TokenizerConfig):
    def run(spark, sf_dir):
        return tok.tokens(_conversations(spark, sf_dir), config).select("doc_id", F.col("span_pos").cast("long").alias("span_pos"), F.col("sub_pos").cast("long").alias("sub_pos"), "text")

    return run


for _name, _config in OPTIONS.items():
    QUERIES[_name] = _option_query(_config)
    ORACLES[_name] = f"with {_tokens_sql(_CONVERSATIONS, config=_config)} select doc_id, span_pos, sub_pos, text from tok"


_NUMERIC_SQL = "((regexp_matches(w, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') and coalesce(abs(try_cast(w as double)) < 'inf'::double, false)) or regexp_matches(w, '^([+-]?(?i:inf|infinity)|(?i:nan))$') or regexp_matches(w, '^[+-]?0[xX]([0-9a-fA-F]+\\.?[0-9a-fA-F]*|\\.[0-9a-fA-F]+)[pP][+-]?[0-9]+$'))"
_SHAPE_SQL = f"case when {_NUMERIC_SQL} then 'number' when regexp_matches(w, '[^A-Za-z0-9_]$') then 'punct' when lower(w) = w then 'downcase' when not regexp_matches(w, '(^|[\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{40}}\\x{{5B}}-\\x{{5E}}\\x{{60}}\\x{{7B}}-\\x{{7F}}]|{_SPACE})\\p{{Ll}}') then 'upcase' when w <> '' then 'mixedcase' else 'other' end"
_NORM_SQL = "case when contains(w, '-') and not starts_with(w, '-') then '!HYPHEN' when regexp_matches(w, '^[+-]?[0-9]+$') and strlen(w) = 4 then '!YEAR' when regexp_matches(w, '^[0-9]') then '!DIGITS' else lower(w) end"


@query(f"select distinct span as text, {_SHAPE_SQL.replace('(w', '(span').replace(' w ', ' span ').replace('= w', '= span')} as shape from {_spans_sql(_docs_sql('benchmark', 'item_id'))}")
def token_shape(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir, "benchmark", "item_id")).select(F.col("span").alias("text")).distinct().withColumn("shape", T.shape(F.col("text")))


@query(f"select {_SHAPE_SQL} as shape, count(*) n from (select span w from {_spans_sql(_docs_sql())}) group by 1")
def shape_histogram(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).groupBy(T.shape(F.col("span")).alias("shape")).agg(F.count("*").alias("n"))


@query(f"select w as word, {_NORM_SQL} as norm, count(*) n from (select span w from {_spans_sql(_docs_sql())}) group by 1, 2")
def token_normalize(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).groupBy(F.col("span").alias("word")).agg(F.count("*").alias("n")).select("word", T.normalize(F.col("word")).alias("norm"), "n")


@query(f"select case when starts_with({_NORM_SQL}, '!') then {_NORM_SQL} else 'word' end as kind, count(*) n from (select span w from {_spans_sql(_docs_sql())}) group by 1")
def normalize_histogram(spark, sf_dir):
    norm = T.normalize(F.col("span"))
    return tok.spans(_docs(spark, sf_dir)).groupBy(F.when(norm.startswith("!"), norm).otherwise("word").alias("kind")).agg(F.count("*").alias("n"))


@query(f"select distinct w as word, lower(left(w, 3)) pre, lower(right(w, 3)) suf, strlen(w) n_bytes from (select span w from {_spans_sql(_docs_sql('benchmark', 'item_id'))})")
def affix_features(spark, sf_dir):
    w = F.col("span")
    return tok.spans(_docs(spark, sf_dir, "benchmark", "item_id")).select(w.alias("word"), T.prefix(w).alias("pre"), T.suffix(w).alias("suf"), F.octet_length(w).cast("long").alias("n_bytes")).distinct()


_IN_WORDS = f"in ({', '.join(map(_q, WORDS))})"


@query(f"select distinct span word, span {_IN_WORDS} basic from {_spans_sql(_docs_sql())}")
def basic_word_flag(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).select(F.col("span").alias("word"), F.col("span").isin(list(WORDS)).alias("basic")).distinct()


@query(f"select lang, round(avg(case when span {_IN_WORDS} then 1.0 else 0.0 end), 6) ratio, count(*) n from {_spans_sql('documents', 'lang')} group by 1")
def basic_word_ratio_by_lang(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.explode(T.space_split(T.sanitize(F.col("text")))).alias("span"))
    return found.groupBy("lang").agg(F.round(F.avg(F.col("span").isin(list(WORDS)).cast("double")), 6).alias("ratio"), F.count("*").alias("n"))


def _bench_tokens(spark, sf_dir) -> DataFrame:
    return tok.with_positions(tok.tokens(_docs(spark, sf_dir, "benchmark", "item_id")))


_BENCH = f"with {_tokens_sql(_docs_sql('benchmark', 'item_id'))}, {_POS_SQL}"
_CONTEXT = f"""{_BENCH}, nn as (select doc_id, pos, text, {_NORM_SQL.replace('(w', '(text')} norm, row_number() over w n, count(*) over (partition by doc_id) m from tp window w as (partition by doc_id order by pos)),
cx as (select doc_id, pos, text, right(text, 3) suffix, left(text, 1) pref1, norm word, coalesce(lag(norm, 1) over w, '-START2-') prev_word,
  coalesce(lag(norm, 2) over w, case when n = 1 then '-START-' else '-START2-' end) prev2_word, coalesce(lead(norm, 1) over w, '-END-') next_word,
  coalesce(lead(norm, 2) over w, case when n = m then '-END2-' else '-END-' end) next2_word from nn window w as (partition by doc_id order by pos))"""


@query(f"{_CONTEXT} select *, right(prev_word, 3) prev_suffix, right(next_word, 3) next_suffix from cx")
def context_features_pos(spark, sf_dir):
    return feat.tagging_context(_bench_tokens(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


#: Rule labels: a run of capitalised words is an entity; tags from the word's form.
_TAG = lambda w: F.when(w.rlike("^[0-9]"), "CD").when(w.rlike(r"^\p{Lu}"), "NNP").when(w.rlike(r"^[^\p{L}0-9]"), "SYM").otherwise("NN")
_TAG_SQL = r"case when regexp_matches(text, '^[0-9]') then 'CD' when regexp_matches(text, '^\p{Lu}') then 'NNP' when regexp_matches(text, '^[^\p{L}0-9]') then 'SYM' else 'NN' end"


def _labelled(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = _bench_tokens(spark, sf_dir).withColumn("tag", _TAG(F.col("text")))
    up = F.col("text").rlike(r"^\p{Lu}")
    kind = F.when(F.char_length("text") % 2 == 0, "PERSON").otherwise("GPE")
    return t.withColumn("up", up).withColumn("label", F.when(~up, "O").when(F.coalesce(F.lag("up").over(w), F.lit(False)), F.concat(F.lit("I-"), kind)).otherwise(F.concat(F.lit("B-"), kind))).drop("up")


_LABELLED = rf"""{_BENCH}, lu as (select doc_id, pos, text, {_TAG_SQL} tag, regexp_matches(text, '^\p{{Lu}}') up from tp),
lb as (select doc_id, pos, text, tag, case when not up then 'O' when coalesce(lag(up) over (partition by doc_id order by pos), false) then 'I-' else 'B-' end || case when not up then '' when length(text) % 2 = 0 then 'PERSON' else 'GPE' end label from lu)"""

_SIMPLE_SQL = "case when starts_with(x, 'V') then 'v' else split_part(x, '-', 1) end"
_ENTITY = f"""{_LABELLED}, sh as (select *, {_SHAPE_SQL.replace('(w', '(text').replace(' w ', ' text ').replace('= w', '= text')} shape, row_number() over w n, lag(label) over w x from lb window w as (partition by doc_id order by pos)),
ec as (select doc_id, pos, text, tag, label, 'True' bias, case when text {_IN_WORDS} then 'True' else 'False' end wordlist, coalesce(lower(lead(tag) over w), 'None') nextpos,
  coalesce(lower(lead(text) over w), 'None') nextword, coalesce(x, 'None') prevtag, lower(left(text, 3)) prefix3, coalesce(lag(tag) over w, 'None') prevpos,
  coalesce(lower(lag(text) over w), 'None') prevword, shape, case when n > 2 then lag(shape) over w else 'None' end pshape, lower(right(text, 3)) suffix3, strlen(text)::varchar wordlen
  from sh window w as (partition by doc_id order by pos)),
lf as (select doc_id, pos, label, unnest(['bias', 'en-wordlist', 'nextpos', 'nextword', 'pos', 'pos+prevtag', 'prefix3', 'prevpos', 'prevtag', 'prevword', 'shape', 'shape+prevtag', 'suffix3', 'word', 'word+nextpos', 'word.lower', 'wordlen']) fname,
  unnest([bias, wordlist, nextpos, nextword, tag, tag || '+' || prevtag, prefix3, prevpos, prevtag, prevword, shape, pshape || '+' || prevtag, suffix3, text, lower(text) || '+' || nextpos, lower(text), wordlen]) fval from ec)"""


def _entity_features(spark, sf_dir) -> DataFrame:
    return feat.long_features(feat.entity_context(_labelled(spark, sf_dir), WORDS))


@query(f"{_ENTITY} select * from lf")
def context_features_ner(spark, sf_dir):
    return _entity_features(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


_NONE_SQL, _KEPT_SQL = C.NONE_WORD.replace(r"\z", "$"), C.KEPT_WORD.replace(r"\z", "$")
_RULE_SQL = f"case when w = '-' then '-' when w in ({', '.join(map(_q, C.EMOTICONS))}) then 'SYM' when starts_with(w, '@') then 'NN' when regexp_matches(w, {_q(_NONE_SQL)}) then '-NONE-' when regexp_matches(w, {_q(_KEPT_SQL)}) then w end"


@query(f"select w as word, {_RULE_SQL} as tag, count(*) n from (select span w from {_spans_sql(_docs_sql())}) group by 1, 2")
def pos_rule_cascade(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).groupBy(F.col("span").alias("word")).agg(F.count("*").alias("n")).select("word", pos.rule_tag(F.col("word")).alias("tag"), "n")


@query(f"select coalesce(tag, 'model') tag, count(*) n from {_spans_sql(_docs_sql())} left join {_values(list(TAG_MAP.items()), 'word, tag')} m on span = word group by 1")
def tagmap_lookup(spark, sf_dir):
    table = spark.createDataFrame(list(TAG_MAP.items()), "word string, tag string")
    found = tok.spans(_docs(spark, sf_dir)).join(F.broadcast(table), F.col("span") == F.col("word"), "left")
    return found.groupBy(F.coalesce("tag", F.lit("model")).alias("tag")).agg(F.count("*").alias("n"))


@query(f"""{_CONTEXT}, ft as (select doc_id, pos, unnest(['bias', 'suffix ' || suffix, 'pref1 ' || pref1]) feature from cx),
sc as (select doc_id, pos, class, sum(weight) score from ft join {_values(CLASS_WEIGHTS, 'feature, class, weight')} w using (feature) group by 1, 2, 3)
select doc_id, pos, class, round(score, 6) score from sc qualify row_number() over (partition by doc_id, pos order by score desc, class) = 1""")
def perceptron_score_argmax(spark, sf_dir):
    cx = feat.tagging_context(_bench_tokens(spark, sf_dir))
    rows = cx.select("doc_id", F.col("pos").cast("long").alias("pos"), F.explode(F.array(F.lit("bias"), F.concat(F.lit("suffix "), "suffix"), F.concat(F.lit("pref1 "), "pref1"))).alias("feature"))
    weights = spark.createDataFrame(CLASS_WEIGHTS, "feature string, class string, weight double")
    return pos.perceptron_scores(rows, F.broadcast(weights)).withColumn("score", F.round("score", 6) + F.lit(0.0))


_SPAN_ROWS = [(0, 4, 9, "ONE"), (1, 8, 14, "TWO"), (2, 30, 42, "THREE")]


@query(f"""{_BENCH}, ofs as (select *, coalesce(sum(length(text)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) off from tp),
hit as (select doc_id, pos, text, coalesce(k, -1) k, case when k is null then 'O' when off = s then 'B-' || name else 'I-' || name end label from ofs left join {_values(_SPAN_ROWS, 'k, s, e, name')} v on off >= s and off < e)
select doc_id, pos, text, label from hit qualify row_number() over (partition by doc_id, pos order by k desc) = 1""")
def iob_assign(spark, sf_dir):
    tokens = _bench_tokens(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")
    spans = spark.createDataFrame(_SPAN_ROWS, "span_no int, start int, end int, label string").crossJoin(tokens.select("doc_id").distinct())
    return ner.assign_labels(tokens, spans)


@query(rf"select doc_id, cut_at, length(regexp_replace(left(text, cut_at), '{_SPACE}', '', 'g')) moved from {_docs_sql('benchmark', 'item_id')}, (select unnest([0, 5, 17, 40]) cut_at)")
def whitespace_adjust_pos(spark, sf_dir):
    docs = _docs(spark, sf_dir, "benchmark", "item_id").withColumn("cut_at", F.explode(F.array(*map(F.lit, (0, 5, 17, 40)))))
    return docs.select("doc_id", "cut_at", T.adjusted_position(F.col("text"), F.col("cut_at")).cast("long").alias("moved"))


@query(f"""{_LABELLED}, l0 as (select *, lag(label) over w pl, lag(tag) over w pt from lb window w as (partition by doc_id order by pos)),
l1 as (select *, (label <> 'O')::int c, coalesce((label <> 'O' and label <> regexp_replace(pl, '^([^B]*)B', '\\1I')) or tag = pt or (tag = 'CD' and pl <> 'O'), false)::int o from l0),
l2 as (select *, case when c = o then c end rv, sum(case when c = 1 and o = 0 then 1 else 0 end) over (partition by doc_id order by pos) ct from l1),
l3 as (select *, last_value(rv ignore nulls) over w lr, last_value(case when rv is not null then ct end ignore nulls) over w base from l2 window w as (partition by doc_id order by pos)),
l4 as (select *, (coalesce(lr, 0) + ct - coalesce(base, 0)) % 2 st from l3),
l5 as (select *, coalesce(lag(st) over (partition by doc_id order by pos), 0) ps from l4),
l6 as (select *, sum(case when ps = 0 and st = 1 then 1 else 0 end) over (partition by doc_id order by pos) ent from l5),
ins as (select * from l6 where st = 1 or (ps = 1 and label <> 'O')),
g as (select doc_id, ent, string_agg(text, ' ' order by pos) as text, count(*) n, bool_or(label = 'B-PERSON') bp, arg_min(label, pos) fl, min(pos) start_pos, max(pos) end_pos from ins
  where (doc_id, ent) in (select doc_id, ent from l6 where ps = 1 and st = 0) group by 1, 2)
select doc_id, row_number() over (partition by doc_id order by ent) - 1 ent_pos, text, case when n = 2 and bp then 'PERSON' else split_part(fl, '-', 2) end as label, start_pos, end_pos from g""")
def chunk_entities(spark, sf_dir):
    found = chunking.chunk(_labelled(spark, sf_dir))
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("ent_pos", "start_pos", "end_pos")), "text", "label")


_MAPPING = f"{_ENTITY}, mp as (select fname, fval, label, row_number() over (order by fname, fval, label) - 1 fid from (select distinct fname, fval, label from lf))"


@query(f"{_MAPPING} select * from mp")
def feature_encode_ids(spark, sf_dir):
    return ner.encode(_entity_features(spark, sf_dir)).withColumn("fid", F.col("fid").cast("long"))


@query(f"{_MAPPING} select fid, count(*) n from lf join mp using (fname, fval, label) group by 1")
def empirical_counts(spark, sf_dir):
    f = _entity_features(spark, sf_dir)
    return ner.empirical_counts(f, ner.encode(f)).withColumn("fid", F.col("fid").cast("long"))


_LABEL_NAMES = ["B-GPE", "B-PERSON", "I-GPE", "I-PERSON", "O"]


@query(f"""{_MAPPING}, ca as (select doc_id, pos, mp.label cand, fid from lf join mp using (fname, fval)),
gr as (select doc_id, pos, cand from (select distinct doc_id, pos from ca), (select unnest([{', '.join(map(_q, _LABEL_NAMES))}]) cand)),
kn as (select doc_id, pos, cand, sum(1.0 / (1 + fid % 7)) s, count(*) n from ca group by 1, 2, 3),
fu as (select gr.*, coalesce(s, 0.0) + 0.25 * (18 - coalesce(n, 0)) v, 18 - coalesce(n, 0) extra from gr left join kn using (doc_id, pos, cand)),
pr as (select *, pow(2.0, v - max(v) over w) e from fu window w as (partition by doc_id, pos)),
pp as (select *, e / sum(e) over (partition by doc_id, pos) p from pr)
select fid, round(sum(p), 6) est from ca join pp using (doc_id, pos, cand) group by 1 union all select -1, round(sum(p * extra), 6) from pp""")
def gis_one_iteration(spark, sf_dir):
    f = _entity_features(spark, sf_dir)
    mapping = ner.encode(f)
    weights = mapping.select("fid", (1.0 / (1 + F.col("fid") % 7)).alias("w"))
    out = ner.scaled_step(ner.candidates(f, mapping), weights, _LABEL_NAMES, 18, 0.25)
    return out.select(F.col("fid").cast("long").alias("fid"), F.round("est", 6).alias("est"))


@query("select lang, round(max(v) + log2(sum(pow(2.0, v - m))), 6) total from (select lang, log2(n_chars + 1.0) v, max(log2(n_chars + 1.0)) over (partition by lang) m from documents) group by 1")
def log2_sum_exp(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.log2(F.col("n_chars") + 1.0).alias("v"))
    top = d.groupBy("lang").agg(F.max("v").alias("m"))
    part = d.join(F.broadcast(top), "lang").groupBy("lang", "m").agg(F.sum(F.pow(F.lit(2.0), F.col("v") - F.col("m"))).alias("s"))
    return part.select("lang", F.round(F.col("m") + F.log2("s"), 6).alias("total"))


def _ends_sql(x: str) -> str:
    ends = " or ".join(f"ends_with({x}, {_q(e)})" for e in C.ENDERS)
    return f"((({ends}) and not contains({x}, 'Yahoo!')) or {' or '.join(f'contains({x}, {_q(e)})' for e in C.INNER_ENDERS)})"


@query(f"select span, {_ends_sql('span')} ends, count(*) n from {_spans_sql(_docs_sql())} group by 1, 2")
def sent_end_flags(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).groupBy("span").agg(F.count("*").alias("n")).select("span", T.ends_sentence(F.col("span")).alias("ends"), "n")


@query(f"select span, count(*) n from {_spans_sql(_docs_sql())} where regexp_matches(span, {_q(C.ABBREVIATION)}) group by 1")
def abbrev_candidates(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).filter(F.col("span").rlike(C.ABBREVIATION)).groupBy("span").agg(F.count("*").alias("n"))


@query(f"select span, count(*) n from {_spans_sql(_docs_sql())} where regexp_matches(span, {_q(C.ELLIPSIS)}) group by 1")
def ellipsis_tokens(spark, sf_dir):
    return tok.spans(_docs(spark, sf_dir)).filter(F.col("span").rlike(C.ELLIPSIS)).groupBy("span").agg(F.count("*").alias("n"))


_ABBREVIATIONS = sorted(segment.Parameters().abbreviations)
_STOP_SQL = f"""sp as {_spans_sql(_docs_sql())}, f as (select *, {_ends_sql('span')} or (ends_with(span, '.') and not ends_with(span, '..') and lower(left(span, length(span) - 1)) not in ({', '.join(map(_q, _ABBREVIATIONS))})) brk,
  lead(span) over w nx, lag(span) over w pv from sp window w as (partition by doc_id order by span_pos))"""


@query(rf"""with {_STOP_SQL} select doc_id, span_pos, span from f where case
  when ends_with(span, '.') and nx = '.' then false when span = '.' and ends_with(pv, '.') then false
  when regexp_matches(span, '(?:\.\s?){{2,}}\.') and regexp_matches(nx, '^\p{{Lu}}') then true
  when brk and regexp_matches(span, '[)’”"'']$') and regexp_matches(nx, '^\p{{Ll}}') then false
  when regexp_matches(span, {_q(C.ABBREVIATION)}) and not regexp_matches(span, '^\pL\.$') then false else brk end""")
def sentence_split_rules(spark, sf_dir):
    """The pairwise break rules (no trained evidence) as windows: where sentences end."""
    w = Window.partitionBy("doc_id").orderBy("span_pos")
    span, nx, pv = F.col("span"), F.col("nx"), F.col("pv")
    known = F.lower(F.left(span, F.char_length(span) - 1)).isin(_ABBREVIATIONS)
    f = tok.spans(_docs(spark, sf_dir)).withColumn("nx", F.lead("span").over(w)).withColumn("pv", F.lag("span").over(w))
    brk = T.ends_sentence(span) | (span.endswith(".") & ~span.endswith("..") & ~known)
    no = F.lit(False)
    rule = (
        F.when(span.endswith(".") & (nx == "."), no).when((span == ".") & pv.endswith("."), no)
        .when(span.rlike(C.ELLIPSIS) & nx.rlike(r"^\p{Lu}"), F.lit(True))
        .when(brk & span.rlike("[)’”\"']\\z") & nx.rlike(r"^\p{Ll}"), no)
        .when(span.rlike(C.ABBREVIATION) & ~span.rlike(r"^\p{L}\.\z"), no).otherwise(brk)
    )
    return f.filter(rule).select("doc_id", F.col("span_pos").cast("long").alias("span_pos"), "span")


_KIND_SQL = "case when regexp_matches(w, '^-?[.,]?[0-9][0-9,.-]*\\.?$') then '##number##' else lower(w) end"
_TYPES_SQL = rf"""tw as (select unnest(list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '')) w from {_docs_sql()}),
ty as (select case when {_KIND_SQL} <> '##number##' and ends_with(w, '.') and length(w) > 1 then left({_KIND_SQL}, length({_KIND_SQL}) - 1) else {_KIND_SQL} end as type,
  (ends_with(w, '.') and length(w) > 1)::int s from tw), tc as (select type, sum(s)::bigint with_stop, sum(1 - s)::bigint without_stop from ty group by 1)"""


@query(f"with {_TYPES_SQL} select * from tc")
def punkt_type_counts(spark, sf_dir):
    return segment.type_counts(_docs(spark, sf_dir))


@query(f"""with {_TYPES_SQL}, tt as (select sum(with_stop + without_stop) al, sum(with_stop) st from tc),
x as (select *, st::double / al p1, length(type) - length(replace(type, '.', '')) dots, length(type) - (length(type) - length(replace(type, '.', ''))) + 1 others from tc, tt where with_stop > 0)
select type, with_stop, without_stop, round(-2 * ((with_stop * ln(p1) + without_stop * ln(1 - p1 + 1e-12)) - (with_stop * ln(0.99) + without_stop * ln(0.01))) * exp(-others::double) * (dots + 1) * pow(others::double, -without_stop::double), 6) + 0.0 score from x""")
def punkt_abbrev_llr(spark, sf_dir):
    return segment.abbreviation_scores(segment.type_counts(_docs(spark, sf_dir))).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query(rf"""with o0 as (select doc_id, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') l from {_docs_sql()}),
o1 as (select unnest(l) w, unnest(list_prepend('', l)[:len(l)]) p from o0),
o2 as (select regexp_replace(lower(w), '(.)\.$', '\1') as type, case when p = '' then 'beg' when regexp_matches(p, '[.?!][)"''’”]?$') and regexp_replace(lower(p), '\.$', '') not in ({', '.join(map(_q, _ABBREVIATIONS))}) then 'beg'
  when regexp_matches(p, '[.?!][)"''’”]?$') then 'unk' else 'mid' end pl, case when regexp_matches(w, '^\p{{Lu}}') then 'u' when regexp_matches(w, '^\p{{Ll}}') then 'l' end cs from o1),
o3 as (select type, case pl || cs when 'begu' then 2 when 'begl' then 16 when 'midu' then 4 when 'midl' then 32 when 'unku' then 8 when 'unkl' then 64 end f from o2 where cs is not null)
select type, bit_or(f) flags, count(*) n from o3 group by 1""")
def punkt_ortho_context(spark, sf_dir):
    return segment.ortho_contexts(_docs(spark, sf_dir))


@query(f"with {_tokens_sql(_CONVERSATIONS)}, {_POS_SQL} select doc_id, pos, text, null::varchar tag, null::varchar as label from tp")
def pipeline_tokens_only(spark, sf_dir):
    """The document pipeline with segmentation, tagging and extraction off."""
    made = pipeline.annotate(_conversations(spark, sf_dir), Model("none"), pipeline.Options(segment=False, tag=False, extract=False))
    return pipeline.token_rows(made).withColumn("pos", F.col("pos").cast("long"))


@query(f"select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 pos from (select doc_id, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') l from {_CONVERSATIONS})")
def pipeline_own_tokenizer(spark, sf_dir):
    """The document pipeline with a tokenizer of the caller's."""
    made = pipeline.annotate(_conversations(spark, sf_dir), Model("none"), pipeline.Options(segment=False, tokenizer=T.space_split))
    return pipeline.token_rows(made).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


@query(f"select doc_id, text from {_CONVERSATIONS}")
def pipeline_all_off(spark, sf_dir):
    """The document pipeline with no stage asked for: the documents as they are."""
    return pipeline.annotate(_conversations(spark, sf_dir), Model("none"), pipeline.Options(segment=False, tokenizer=None))


@query(f"""{_BENCH}, ofs as (select *, coalesce(sum(length(text)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) off from tp),
hit as (select doc_id, pos, text, coalesce(k, -1) k, case when k is null then 'O' when off = s then 'B-' || name else 'I-' || name end label from ofs left join {_values(_SPAN_ROWS, 'k, s, e, name')} v on off >= s and off < e and k <> 1)
select doc_id, pos, text, label from hit qualify row_number() over (partition by doc_id, pos order by k desc) = 1""")
def iob_assign_rejected(spark, sf_dir):
    """Labels by spans of which one was not accepted."""
    tokens = _bench_tokens(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")
    spans = spark.createDataFrame([(*r, r[0] != 1) for r in _SPAN_ROWS], "span_no int, start int, end int, label string, accept boolean").crossJoin(tokens.select("doc_id").distinct())
    return ner.assign_labels(tokens, spans)


@query(f"{_ENTITY.replace(chr(99) + 'oalesce(x, ' + chr(39) + 'None' + chr(39) + ') prevtag', 'coalesce(' + _SIMPLE_SQL + ', ' + chr(39) + 'None' + chr(39) + ') prevtag')} select * from lf where fname in ('prevtag', 'pos+prevtag', 'shape+prevtag')")
def context_features_consistent(spark, sf_dir):
    """The features of the history, with the first part of labels, as in decoding."""
    found = feat.long_features(feat.entity_context(_labelled(spark, sf_dir), WORDS, consistent_history=True))
    return found.filter(F.col("fname").isin("prevtag", "pos+prevtag", "shape+prevtag")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""{_MAPPING}, ca as (select doc_id, pos, mp.label cand, fid from lf join mp using (fname, fval)),
gr as (select doc_id, pos, cand from (select distinct doc_id, pos from ca), (select unnest([{', '.join(map(_q, _LABEL_NAMES))}]) cand)),
kn as (select doc_id, pos, cand, sum(1.0 / (1 + fid % 7)) s, count(*) n from ca group by 1, 2, 3),
fu as (select gr.*, coalesce(s, 0.0) + 0.25 * (18 - coalesce(n, 0)) v from gr left join kn using (doc_id, pos, cand)),
pr as (select *, pow(2.0, v - max(v) over w) e from fu window w as (partition by doc_id, pos))
select doc_id, pos, cand as label, round(e / sum(e) over (partition by doc_id, pos), 6) + 0.0 p from pr""")
def prob_classify(spark, sf_dir):
    """The distribution over labels of every token."""
    f = _entity_features(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))
    mapping = ner.encode(f)
    weights = mapping.select("fid", (1.0 / (1 + F.col("fid") % 7)).alias("w")).unionByName(spark.createDataFrame([(-1, 0.25)], "fid int, w double"))
    return ner.prob_classify(f, mapping, weights, _LABEL_NAMES, 18).withColumn("p", F.round("p", 6) + F.lit(0.0))


@query("select doc_id, rn <= floor(0.8 * n) in_train from (select doc_id, row_number() over (order by doc_id) rn, count(*) over () n from documents)")
def train_test_split(spark, sf_dir):
    first, rest = train_test(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    return first.withColumn("in_train", F.lit(True)).unionByName(rest.withColumn("in_train", F.lit(False)))


@query(rf"""{_LABELLED}, sq as (select lb.doc_id, pos, tp.span_pos, tp.sub_pos, lb.text, tag, label, string_agg(lb.text, '' order by tp.sub_pos) over (partition by lb.doc_id, tp.span_pos) sp, tp.span_pos = max(tp.span_pos) over (partition by lb.doc_id) last from lb join tp using (doc_id, pos)),
wh as (select doc_id, span_pos, max(sp) sp from (select doc_id, span_pos, string_agg(text, '' order by sub_pos) sp from sq group by 1, 2) group by 1, 2),
al as (select sq.doc_id, sq.pos, sq.text, sq.last, sq.tag, sq.label, sq.span_pos, sq.sub_pos, wh.sp w2 from sq join wh using (doc_id, span_pos))
select doc_id, pos, text, case when last then tag else arg_max(tag, span_pos) over g end tag, case when last then label else arg_max(label, span_pos) over g end as label from al window g as (partition by doc_id, w2, sub_pos, last)""")
def alias_repeats(spark, sf_dir):
    """Labels as if equal spans of a document shared their tokens."""
    return tok.alias_repeats(_labelled(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "text", "tag", "label")


_TAGGED = [(1, "Pierre|NNP Vinken|NNP ,|, 61|CD years|NNS old|JJ ,|, will|MD join|VB"), (2, "the|DT board|NN odd as|IN"), (3, "")]


@query(f"select id, unnest(i) item, unnest(list_transform(i, lambda x: split_part(x, '|', 1))) word, unnest(list_transform(i, lambda x: case when contains(x, '|') then split_part(x, '|', 2) end)) tag from (select id, list_filter(string_split(line, ' '), lambda x: x <> '') i from {_values(_TAGGED, 'id, line')})")
def read_tagged(spark, sf_dir):
    lines = spark.createDataFrame(_TAGGED, "id long, line string").withColumn("t", parse_tagged(F.col("line"), "|")).withColumn("i", F.filter(F.split("line", " "), lambda x: x != ""))
    return lines.select("id", F.explode(F.arrays_zip(F.col("i").alias("item"), F.col("t.words").alias("word"), F.col("t.tags").alias("tag"))).alias("z")).select(F.col("id").cast("int").alias("id"), "z.item", "z.word", "z.tag")


@query(f"{_LABELLED}, lw as (select doc_id, text, arg_max(label, pos) label, count(*) n from lb group by 1, 2) select * from lw")
def alias_last_write(spark, sf_dir):
    """The label that the last use of a word in a document got."""
    return _labelled(spark, sf_dir).groupBy("doc_id", "text").agg(F.max_by("label", "pos").alias("label"), F.count("*").alias("n"))


@query()
def sentences_docs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return segment.sentences(docs, segment.train(docs))


@query()
def pos_decode(spark, sf_dir):
    """Tags by a perceptron trained on rule-tagged text of the benchmark table."""
    t = _bench_tokens(spark, sf_dir).withColumn("tag", _TAG(F.col("text")))
    rows = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "tag"))).alias("x")).select("doc_id", F.col("x.text").alias("words"), F.col("x.tag").alias("gold"))
    tagger = pos.train([(r.words, r.gold) for r in rows.orderBy("doc_id").collect()], epochs=3)
    return rows.select("doc_id", F.posexplode(F.arrays_zip("words", pos.tag_udf(tagger)(F.col("words")).alias("tag"))).alias("pos", "z")).select("doc_id", "pos", F.col("z.words").alias("text"), F.col("z.tag").alias("tag"))


@query()
def ner_train_classify(spark, sf_dir):
    """Entities by a recogniser trained for three iterations on rule labels."""
    t = _labelled(spark, sf_dir)
    model = ner.train(feat.entity_context(t, WORDS), iterations=3, base_words=WORDS)
    rows = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "tag"))).alias("x")).select("doc_id", F.col("x.text").alias("text"), F.col("x.tag").alias("tag"))
    found = rows.select("doc_id", F.posexplode(F.arrays_zip("text", "tag", ner.label_udf(model)(F.col("text"), F.col("tag")).alias("label"))).alias("pos", "z")).select("doc_id", "pos", "z.text", "z.tag", "z.label")
    return chunking.chunk(found)


_WHOLE = tok.TokenizerConfig(unsplittable=lambda w: w.startswith("[") & w.endswith("]."))


@query()
def custom_unsplittable(spark, sf_dir):
    return tok.tokens(_docs(spark, sf_dir, "benchmark", "item_id"), _WHOLE)

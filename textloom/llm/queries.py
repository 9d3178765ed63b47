"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, language, licences, media, neighbours, packing, pieces, quality, urls
from .common import table

#: What both turns of conversation -7 say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    made = chat.windows(turns.unionByName(extra), budget=1024, history=256, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return chat.digests(made)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs that some page names with a tracking parameter (utm_source), in
    canonical form; the filter and the exact join then judge every page, whatever scheme,
    parameters or fragment it names its URL by. Pages of one host differ."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.col("url").contains("utm_source="))
    return urls.judge(pages, listed, URL_RULES)


OP4_SQL = r"""
with p as (
  select page_id, case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) else '' end h0,
         case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end path from pages),
q as (select page_id, translate(coalesce(h0, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, coalesce(path, '') path from p),
r as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(v, h, pa)),
m as (select q.page_id, max_by(h || pa, length(h || pa)) as rule, max_by(v, length(h || pa)) as v from (select distinct * from q) q join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, pa) group by 1),
l as (select distinct host || regexp_replace(path, '/+$', '') k from q join pages using (page_id) where contains(url, 'utm_source=') and host || path <> '')
select q.page_id, host, path, rule, coalesce(m.v, case when l.k is not null then 'block' else 'allow' end) verdict, l.k is not null is_listed
from q left join m on q.page_id = m.page_id left join l on l.k = host || regexp_replace(path, '/+$', '')
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language.predict(docs, language.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), percent=90, width=3)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: a directory for each source, in it one for each
    2,000 ids, and every hundredth file of a source is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.lit("corpus"), F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 2000).cast("string"))
    name = F.when(F.floor(F.col("doc_id") / 20) % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan(docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text"))


_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in sorted(licences.TEMPLATES.items()))
OP10_SQL = rf"""
with f as (
  select doc_id, text, 'corpus/' || coalesce(source, 'none') || '/' || (doc_id // 2000) || '/' || case when (doc_id // 20) % 100 = 0 then 'LICENSE' else doc_id || '.txt' end path from documents),
g as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) dir from f),
l as (select doc_id, path, trim(unnest(string_split(text, chr(10))), ' ') line from g where regexp_matches(text, '{licences.HEADER}')),
h0 as (select * from l where regexp_matches(line, '{licences.HEADER}')),
h as (select * from h0 where not regexp_matches(line, '{licences.SPDX}')),
x as (select doc_id, path, line, regexp_replace(regexp_extract(line, '{licences.SPDX}', 1), '-(only|or-later)$', '') licence, 1.0 score from h0 where regexp_matches(line, '{licences.SPDX}')),
d as (select line, count(*) n from h group by 1),
t as (select * from (values {_TEMPLATE_ROWS}) v(licence, text)),
lw0 as (select line, n, regexp_replace(unnest(string_split_regex(lower(line), '[^a-z0-9.]+')), '\.+$', '') w from d),
lw as (select line, n, w, count(*) tf from lw0 where w <> '' group by all),
tw0 as (select licence, regexp_replace(unnest(string_split_regex(lower(text), '[^a-z0-9.]+')), '\.+$', '') w from t),
tw as (select licence, w, count(*) tf from tw0 where w <> '' group by all),
df as (select w, sum(n) df from (select w, n from lw union all select w, 1 from tw) group by 1),
idf as (select w, ln(((select coalesce(sum(n), 0) from d) + {len(licences.TEMPLATES)} + 1) / (df + 1)) + 1 idf from df),
lv as (select line, w, tf * idf x from lw join idf using (w)),
tv as (select licence, w, tf * idf y from tw join idf using (w)),
c as (select line, licence, round(sum(x * y) / (any_value(lx) * any_value(ty)), 6) score from lv join tv using (w)
  join (select line, sqrt(sum(x * x)) lx from lv group by 1) using (line) join (select licence, sqrt(sum(y * y)) ty from tv group by 1) using (licence) group by 1, 2),
b as (select line, split_part(licence, '#', 1) licence, score from c qualify row_number() over (partition by line order by score desc, licence) = 1),
o as (select doc_id, path, licence own_licence, score from (select doc_id, path, licence, score from h join b using (line) where score >= 0.6 union all select doc_id, path, licence, score from x) qualify row_number() over (partition by doc_id, path order by score desc, licence) = 1),
s as (select regexp_extract(path, '^(.*)/[^/]*$', 1) anc, own_licence licence from o where regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{licences.LICENCE_FILE}')
  qualify row_number() over (partition by anc order by score desc, licence) = 1),
i as (select dir, licence inherited from (select distinct dir from g) join s on dir = anc or starts_with(dir, anc || '/') qualify row_number() over (partition by dir order by length(anc) desc) = 1)
select g.doc_id, g.path, own_licence, score, coalesce(own_licence, inherited) licence,
  case when own_licence is not null then 'header' when inherited is not null then 'inherited' end via
from g left join o on g.doc_id = o.doc_id and g.path = o.path left join i on g.dir = i.dir
"""

_ALL = (
    op1_media_columns, op2_quality_classifier, op3_chat_formatting, op4_url_filters, op5_language_id, op6_ngram_jaccard_join,
    op7_embedding_near_dedup, op8_sentencepiece, op9_best_fit_packing, op10_license_scans,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op4_url_filters": OP4_SQL, "op10_license_scans": OP10_SQL}

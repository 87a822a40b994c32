"""The registered queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from . import quality as quality_model
from .chat_format import chat_examples, read_examples
from .decontaminate import contamination
from .divergence import DIVERGENCE_SQL, source_divergence
from .embedding_dedup import embedding_dedup
from .html_extract import html_extract
from .merkle import merkle, merkle_sql
from .ngram_jaccard import ngram_jaccard
from .packing import pack
from .projection_search import nearest
from .scratch import Scratch
from .substring_dedup import substring_dedup
from .token_output import token_output


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def held_out(doc_id="doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_model.fit(docs, read(spark, sf_dir, "labels").where(~held_out()))
    scored = quality_model.quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(read(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    examples = chat_examples(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))
    return read_examples(Scratch(spark, "chat").save(examples, "examples"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    found = language_id.language_id(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle(read(spark, sf_dir, "documents"))


QUERIES = (op1_ngram_jaccard, op2_quality, op3_html_extract, op4_substring_dedup, op5_decontamination, op6_chat_format, op7_language_id, op8_packing, op9_embedding_dedup, op10_token_output, op11_projection_search, op12_source_divergence, op13_merkle_manifest)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
both_ as (select x, y from links union all select y, x from links),
reach as (select x as node, x as seen from both_ union select r.node, b.y from reach r join both_ b on b.x = r.seen)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.least, d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id
left join (select node, min(seen) as least from reach group by node) c on c.node = d.doc_id"""

OP4_SQL = f"""with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, md5(list_aggregate(w[i:i + 49], 'string_agg', ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as least from win) where least < doc_id),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from hit)),
pos as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from w)),
kept as (select pos.doc_id, string_agg(word, ' ' order by pos.p) as t, count(*) as k from pos left join gone on gone.doc_id = pos.doc_id and gone.p = pos.p where gone.p is null group by pos.doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(len(w.w) - coalesce(kept.k, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""

_ESCAPED = r"regexp_replace({}, '([\\#<{}])', '\\\1', 'g')"
OP6_SQL = rf"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (select *, row_number() over (partition by conv_id order by turn, role, text) as i, count(*) over (partition by conv_id) as n,
  14 + length({_ESCAPED.format("role", ":")}) + length({_ESCAPED.format("text", "")}) as size from t),
p as (select *, sum(size) over (partition by conv_id order by i) as upto from o)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) as loss_sha256,
cast(sum(case when role = 'assistant' or i = n then upto else 0 end) as bigint) as formatted_chars from p group by conv_id"""

OP9_SQL = """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
sound as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select x as node, x as seen from links union select r.node, l.y from reach r join links l on l.x = r.seen),
c as (select node, min(seen) as least from reach group by node), n as (select x, count(*) as k from links group by x)
select v.vec_id, coalesce(n.k, 0) as n_links, coalesce(c.least, v.vec_id) as component_id, coalesce(c.least, v.vec_id) = v.vec_id as kept from v left join n on n.x = v.vec_id left join c on c.node = v.vec_id"""


def oracle_sql() -> dict[str, str]:
    """Contracts that SQL can express. Tokenizers, trained models and edit distances are tested instead."""
    return {"op1_ngram_jaccard": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op6_chat_format": OP6_SQL, "op9_embedding_dedup": OP9_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_merkle_manifest": merkle_sql()}

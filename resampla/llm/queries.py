"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resampla.llm import boilerplate, collocations, decontaminate, hilbert, lm, ngram_join, packing, prefix_trie, quality, suffix_dedup, surrogates, toxicity, vector_join


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, fold: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % fold


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, net)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


PII_KEY = "spark.resampla.pii.key"  # the setting that holds a deployment's secret


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(read(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, "test key")).select("doc_id", "n_entities", "text")


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(read(spark, sf_dir, "documents"))


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    clean = boilerplate.drop_boilerplate(pages, boilerplate.host_of(F.col("url")), boilerplate.html_text(F.col("html")))
    return clean.select("page_id", boilerplate.host_of(F.col("url")).alias("host"), F.col("_lines.n_lines").alias("n_lines"), F.col("_lines.n_dropped").alias("n_dropped"), F.md5("text").alias("kept_md5"))


OP4_SQL = rf"""
with p as (
  select page_id, lower(regexp_extract(url, '{boilerplate.HOST}', 1)) as host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html,
      '{boilerplate.HIDDEN}', '', 'g'), '{boilerplate.BREAK}', chr(10), 'g'), '{boilerplate.TAG}', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as ls
  from pages),
l as (select page_id, host, unnest(ls) as line, generate_subscripts(ls, 1) as i from p),
f as (select host, line, count(distinct page_id) as n from l group by host, line),
t as (select host, count(*) as total from p group by host),
b as (select f.host, f.line from f join t using (host) where n >= 2 and n > 0.1::double * total),
k as (select l.page_id, count(*) as kept, string_agg(l.line, chr(10) order by i) as txt
  from l anti join b on l.host = b.host and l.line = b.line group by l.page_id)
select p.page_id, p.host, len(p.ls)::bigint as n_lines, (len(p.ls) - coalesce(k.kept, 0))::bigint as n_dropped, md5(coalesce(k.txt, '')) as kept_md5
from p left join k using (page_id)
"""


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = quality.train_quality(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, net)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), 3, 90)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.cosine_components(read(spark, sf_dir, "embeddings"), 0.9)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = suffix_dedup.substring_dedup(read(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), 100, 2000)


def op12_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(read(spark, sf_dir, "documents"), ["lang", "source", "n_chars", "doc_id"], 40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % 100, h being crc32 of c modulo 6."""
    heads = sequences.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = sequences.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("base"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(rebuilt(prefix_trie.conversation_sequences(read(spark, sf_dir, "conversations"))))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_pii_surrogates": op2_pii_surrogates, "op3_pitman_yor": op3_pitman_yor, "op4_site_line_dedup": op4_site_line_dedup, "op5_benchmark_decontamination": op5_benchmark_decontamination, "op6_quality_classifier": op6_quality_classifier, "op7_best_fit_packing": op7_best_fit_packing, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_embedding_near_dedup": op9_embedding_near_dedup, "op10_suffix_dedup": op10_suffix_dedup, "op11_collocations": op11_collocations, "op12_hilbert_sharding": op12_hilbert_sharding, "op13_conversation_trie": op13_conversation_trie}
CLOSURE = "reach as (select {id} as id, {id} as r from {nodes} union select reach.id, l.b from reach join l on reach.r = l.a)"
OP8_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as sh from g),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
{CLOSURE.format(id="doc_id", nodes="documents")}
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reach.r) as component_id
from documents d left join n using (doc_id) join reach on reach.id = d.doc_id group by d.doc_id
"""
OP9_SQL = f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
{CLOSURE.format(id="vec_id", nodes="embeddings")},
d as (select a, count(*) as n from l group by a), c as (select id, min(r) as r from reach group by id)
select vec_id, coalesce(d.n, 0)::bigint as n_links, c.r as component_id, vec_id = c.r as kept
from embeddings join c on c.id = vec_id left join d on d.a = vec_id
"""
OP13_SQL = """
with recursive crc_table as (select i::bigint as i, i::bigint as v, 0 as round from range(256) t(i)
  union all select i, xor(v >> 1, 3988292384 * (v & 1)), round + 1 from crc_table where round < 8),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, turn, left(role, 64) as r, left(text, 64) as x, md5(length(role)::varchar || ':' || role || text) as code, length(text) as size from t),
own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, r, x, code) as pos, code, size from c),
digits as (select distinct conv_id, conv_id::varchar as s from t),
crc as (select conv_id, s, 0 as i, 4294967295::bigint as v from digits
  union all select conv_id, s, crc.i + 1, xor(crc.v >> 8, k.v) from crc join crc_table k on k.round = 8 and k.i = xor(crc.v & 255, ascii(substr(s, crc.i + 1, 1))::bigint) where crc.i < length(s)),
h as (select conv_id, xor(v, 4294967295) % 6 as h from crc where i = length(s)),
whole as (select h.conv_id, 0 as part, pos, code, size from h join own on own.conv_id = h.conv_id - h.conv_id % 100 and pos <= h.h
  union all select h.conv_id, 1, pos, code, size from h join own on own.conv_id = h.conv_id and pos > h.h),
seq as (select conv_id, row_number() over w as d, code, size, md5(string_agg(code, ',') over (w rows unbounded preceding)) as key from whole window w as (partition by conv_id order by part, pos)),
p as (select conv_id, 0::bigint as d, '' as key, null::varchar as up, 0 as size from h
  union all select conv_id, d, key, coalesce(lag(key) over (partition by conv_id order by d), '') as up, size from seq),
node as (select key, any_value(up) as up, d as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size from p group by key, d),
kids as (select up as key, count(*) as n_children from node where up is not null group by up),
below as (select p.key, count(*) filter (k.key is null) as n_leaves, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens
  from node n left join kids k using (key) join p on p.conv_id = n.conv_id and p.d <= n.depth group by p.key),
stop as (select conv_id, arg_max(key, d) as key from p group by conv_id),
ends as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from stop group by key)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n_children, 0)::bigint as n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from node n left join node u on u.key = n.up left join kids on kids.key = n.key join below on below.key = n.key left join ends on ends.key = n.key
"""
OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
t as (select lang, sum(len(w))::hugeint as n from w group by lang),
g as (select lang, w, unnest(range(1, len(w) + 1)) as i from w where len(w) > 0),
f as (select lang, w[i:i + k - 1] as p, count(*)::hugeint as a from g, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w) group by 1, 2 having count(*) >= 100),
held as (select distinct l.lang, unnest([l.p[1:len(l.p) - 1], l.p[2:len(l.p)]]) as p, l.a from f l where len(l.p) > 2),
c as (select lang, p, a from f anti join held using (lang, p, a) where len(p) > 1),
k as (select lang, p, a, unnest(range(1, len(p))) as k from c),
s as (select k.lang, k.p, k.a, k.k, x.a as l, y.a as r, t.n, (1000 * k.a * t.n) // (x.a * y.a) as score from k join t using (lang)
  join f x on x.lang = k.lang and x.p = k.p[1:k.k] join f y on y.lang = k.lang and y.p = k.p[k.k + 1:len(k.p)]),
b as (select * from s qualify row_number() over (partition by lang, p order by score, k) = 1),
o as (select *, array_to_string(p, ' ') as phrase from b)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from o qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
ORACLE: dict[str, str] = {"op4_site_line_dedup": OP4_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_embedding_near_dedup": OP9_SQL, "op11_collocations": OP11_SQL, "op13_conversation_trie": OP13_SQL}

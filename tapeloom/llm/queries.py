"""Registered queries of this folder: thin digests of the operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import chat_format, chunk_bpe, collocations, divergence, language_id, line_crf, line_dedup, packing, quality_score, records, shingle_join, suffix_dedup, top_k
from tapeloom.llm.common import bounded_batches, bucket_of, read

QUERIES, ORACLES = {}, {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def _escape_sql(col: str) -> str:
    out = f"replace(coalesce({col}, ''), '{chat_format.ESCAPE}', '{chat_format.ESCAPE}0')"
    for i, c in enumerate(chat_format.CONTROL):
        out = f"replace({out}, '{c}', '{chat_format.ESCAPE}{i + 1}')"
    return out


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escape_sql("text")}) + length(replace({_escape_sql("role")}, chr(10), '{chat_format.ESCAPE}9')) + {len(chat_format.TURN) + 1 + len(chat_format.END)}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op1_chat_format", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_facts(chat_format.format_turns(chat_format.with_text_part(turns.unionByName(more))))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language_id.learn(docs)
    out = language_id.with_language(docs.select("doc_id", "text"), known)
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op4_quality_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_score.with_quality(docs, quality_score.learn(docs, read(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


@query("op6_exact_top_k", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, end_id=0, capacity=2048)


@query("op8_token_records")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(read(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, end_id=2)


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.learn(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return line_crf.with_rules(docs, model).select("doc_id", *line_crf.FIELDS, "base_failed", "kept", "content_share")


WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT l.a, c.r FROM c JOIN l ON l.b = c.doc_id WHERE c.r < l.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(r) FROM c WHERE c.doc_id = s.doc_id) AS component_id FROM s"""


@query("op2_jaccard_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(read(spark, sf_dir, "documents"))


OP2_LINKS_SQL = OP2_SQL.removesuffix(" FROM s") + ", (SELECT count(DISTINCT b) FROM l WHERE l.a = s.doc_id) AS n_links FROM s"


@query("jaccard_links", OP2_LINKS_SQL)
def op2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_join(read(spark, sf_dir, "documents"))


@query("op5_chunk_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encoded_documents(read(spark, sf_dir, "documents"), BYTE_BPE)


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs, keep_text=False)


OP11_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, unnest(flatten([[w[i:i+k-1] FOR i IN range(1, len(w) - k + 2)] FOR k IN range(1, 6)])) AS g FROM w WHERE len(w) > 0),
c AS (SELECT lang, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
cut AS (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM c WHERE len(g) > 1),
s AS (
  SELECT cut.lang, cut.g, cut.f AS a, k, x.f AS l, y.f AS r, n.n, 1000 * cut.f * n.n // (x.f * y.f) AS score
  FROM cut JOIN c x ON x.lang = cut.lang AND x.g = cut.g[:k] JOIN c y ON y.lang = cut.lang AND y.g = cut.g[k+1:] JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest(flatten([[g[i:i+m-1] FOR i IN range(1, len(g) - m + 2)] FOR m IN range(2, len(g))])) AS g, f FROM c WHERE len(g) > 2)
SELECT b.lang, row_number() OVER o AS rank, array_to_string(b.g, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.g = b.g AND i.f >= b.a)
WINDOW o AS (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) QUALIFY row_number() OVER o <= 2000"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT d, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (gn.n + v.v) AS p
  FROM gn JOIN v ON v.lang = gn.lang JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
lc AS (SELECT lang, term, sum(c)::HUGEINT AS c, sum(sum(c)) OVER (PARTITION BY lang)::HUGEINT AS n FROM c GROUP BY lang, term),
lp AS (SELECT lc.lang, term, 1 + 1000000000 * (c + 1) // (n + v) AS q FROM lc JOIN v ON v.lang = lc.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(max(f), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN lp ON lp.lang = p.lang AND lp.term = p.term WHERE c > 0 AND p > q),
both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER o AS INTEGER) AS rank FROM both_
WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER o <= 200"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k, len(ls) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, coalesce(k.doc_id <> c.keeper, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query("op13_line_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

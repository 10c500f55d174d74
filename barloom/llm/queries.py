"""The corpus operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_dedup, language_id, licences, mixing, nearest, ngram_join, personal_data, secrets, spelling, token_counts, warc, whitening

#: The most repeated source is seen at most so often where the least repeated one is seen once.
MAX_REPETITION = 1.5
#: How far the mixture's entropy goes from the corpus's own towards that of equal weights.
EVENNESS = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), digests=True)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), evenness=EVENNESS)
    return mixed.selectExpr("doc_id", "source", "_mix_tokens AS n_tokens", "_mix_epoch AS epoch", "_mix_weight AS weight", "_mix_key AS mix_key")


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.train(docs))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"), least_length=7, least_count=2, ratio=10)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), top=16)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_byte_bpe, op3_embedding_dedup, op4_source_mixing, op5_warc_zstd, op6_secret_scan, op7_nearest_neighbours, op8_licence_scan, op9_token_counts, op10_language_id,
        op11_spelling_variants, op12_personal_data, op13_embedding_whitening,
    )
}

_OP5 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT p.*, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 160, 5), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[bits[i + 1:i + 5]::BIT::INT + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: bin(('0x' || h[i])::INT).lpad(4, '0')), 'string_agg', '') AS bits FROM f)
"""

_OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
k AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)), y AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
reach(d, r) AS (SELECT a, b FROM y UNION SELECT reach.d, y.b FROM reach JOIN y ON reach.r = y.a)
SELECT l.doc_id, len(s)::BIGINT AS n_shingles, least(l.doc_id, coalesce(m, l.doc_id)) AS component_id FROM l LEFT JOIN (SELECT d, min(r) AS m FROM reach GROUP BY d) ON d = l.doc_id
"""

_OP11 = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r),
x AS (SELECT run, hex(encode(doc_id::VARCHAR || ':' || run)) AS bytes FROM l),
h AS (SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, t),
w AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
s AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS rest FROM i),
d AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest FROM i),
p AS (SELECT a.word, b.word AS o, b.n AS m FROM s a JOIN s b USING (rest) WHERE a.word <> b.word UNION ALL SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = rest UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = rest),
q AS (SELECT word, count(*) AS n_near, max(m) AS form_n, arg_min(o, row(-m, o)) AS form FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN q USING (word)),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.root WHERE e.form IS NULL
"""

ORACLES: dict[str, str] = {"op11_spelling_variants": _OP11, "op1_ngram_jaccard_join": _OP1, "op5_warc_zstd": _OP5, "op8_licence_scan": licences.oracle_sql()}

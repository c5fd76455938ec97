"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import jaccard, langid, merges, mixing, mtree, packing, periodic, quality, secretscan, spelling, suffix, warc, webp
from tremor.llm.common import documents


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.text_media(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secrets(documents(spark, sf_dir)).drop("span_list")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.vocabulary(spelling.slipped(spelling.letter_runs(documents(spark, sf_dir)))))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.id_digests(merges.encoded(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.repeated_tails(documents(spark, sf_dir))))


QUERIES = {"op1_quality": op1_quality, "op2_pack": op2_pack, "op3_warc": op3_warc, "op4_jaccard": op4_jaccard, "op5_topk": op5_topk, "op6_mix": op6_mix, "op7_media": op7_media, "op8_secrets": op8_secrets, "op9_language": op9_language, "op10_repeats": op10_repeats, "op11_spelling": op11_spelling, "op12_sentencepiece": op12_sentencepiece, "op13_runs": op13_runs}
OP5_SQL = """
WITH usable AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * p[2])), 0) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.r <> c.r AND len(q.v) = len(c.v)
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
    FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS sh FROM sets),
met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * n_both >= 85 * (x.n_shingles + y.n_shingles - n_both)
), reach AS (
    SELECT doc_id, doc_id AS other FROM sizes
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, s.n_shingles, r.component_id
FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""

#: The checksum by a table of 256 numbers made from its polynomial; near words by what is left of them without one place.
OP11_SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) g(i)
), occurrences AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents
), named AS (
    SELECT w, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k FROM occurrences GROUP BY doc_id, w
), bytes AS (
    SELECT w, c, flatten(list_transform(string_split(k, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END)) AS b FROM named
), summed AS (
    SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1])), 4294967295) AS h FROM bytes, crc_table
), words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN w[1 : h % len(w)] || w[h % len(w) + 2 :] ELSE w END AS word, c FROM summed)
    WHERE len(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2
), cut AS (
    SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS most, min(struct_pack(n := -n, w := encode(other))) AS b FROM near GROUP BY 1
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN decode(b.w) END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
    SELECT word, form, 1 AS step FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.form WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, n, n_near, form_n
FROM formed f LEFT JOIN (SELECT word, max_by(form, step) AS root FROM chain GROUP BY 1) r USING (word)
"""

ORACLE_SQL: dict[str, str] = {"op4_jaccard": OP4_SQL, "op5_topk": OP5_SQL, "op11_spelling": OP11_SQL}

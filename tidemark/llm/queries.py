"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import fit, fold, predict

    docs = _table(spark, sf_dir, "documents")
    fitted = fit(docs.filter(fold() != 0))
    out = predict(docs, fitted)
    return out.select(F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "lang_pred", "score", "n_words", "known_share")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neighbours import search

    rows = _table(spark, sf_dir, "embeddings")
    out = search(rows, rows.filter("vec_id % 20 = 0"))
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import join

    out = join(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substrings import remove_repeated

    out = remove_repeated(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tiff import described_texts

    return described_texts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.pieces import checked

    return checked(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import extract

    out = extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import fold
    from tidemark.llm.pitman_yor import score

    out = score(_table(spark, sf_dir, "documents"), fold(folds=10) != 0)
    return out.select(F.col("id").alias("doc_id"), (fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score")


_ALL = (op1_language_id, op2_nearest_neighbours, op3_ngram_join, op4_substring_dedup, op5_packing, op6_token_counts, op7_tiff_media, op8_piece_dropout, op9_html_extraction, op10_lm_scoring)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"

#: The others can't be expressed in SQL: they hold trained models, token ids, files or approximations.  Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS % "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0) x),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a AS doc_id, a AS node FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id""",
    "op4_substring_dedup": f"""WITH k AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_WORDS % "coalesce(text, '')"} AS ws FROM documents) x),
    v AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, n - 49)) AS i FROM k WHERE n >= 50) x),
    f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT v.doc_id, unnest(generate_series(i, i + 49)) AS p FROM v JOIN f ON f.h = v.h WHERE v.doc_id > f.first) x),
    words AS (SELECT doc_id, unnest(generate_series(1, n)) AS p, unnest(ws) AS word FROM k WHERE n > 0),
    kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS c FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT k.doc_id, n AS n_words, n - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN kept ON kept.doc_id = k.doc_id""",
}

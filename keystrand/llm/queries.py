"""Queries over the driver's tables, each over whole tables with the operators' production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.substring_dedup import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.simple8b import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm import language_id

    docs, fold = table(spark, sf_dir, "documents"), language_id.fold_of()
    model = language_id.fit(docs, fold != 1)
    found = language_id.predict(docs, model, ("doc_id",))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.simhash_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_substring_dedup, op3_simple8b_token_files, op4_exact_top_k, op5_line_dedup, op6_language_id, op7_bpe_round_trip, op8_html_extraction, op9_simhash_near_dedup, op10_document_fingerprints)}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": """
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
        again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM again, unnest(range(i, i + 20)) AS t(p) GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
            sha256(array_to_string(list_filter(words, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)""",
    "op5_line_dedup": """
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS t FROM documents),
        l AS (SELECT doc_id, i AS place, list_sort(list_distinct(list_filter(regexp_split_to_array(t[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS w
            FROM split, unnest(range(1, len(t) + 1)) AS r(i)),
        sets AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, place) AS copy FROM l WHERE len(w) > 0),
        firsts AS (SELECT doc_id, place, w, row_number() OVER (ORDER BY doc_id, place) AS line FROM sets WHERE copy = 1),
        words AS (SELECT line, unnest(w) AS word, len(w) AS n FROM firsts),
        ranked AS (SELECT line, word, n, row_number() OVER (PARTITION BY line ORDER BY df, word) AS r FROM words JOIN (SELECT word, count(*) AS df FROM words GROUP BY 1) USING (word)),
        posted AS (SELECT * FROM ranked WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
        pairs AS (SELECT DISTINCT a.line AS earlier, b.line AS later FROM posted a JOIN posted b USING (word) WHERE a.line < b.line AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
        met AS (SELECT b.doc_id, b.place, len(list_intersect(a.w, b.w)) AS same, len(a.w) + len(b.w) AS total FROM pairs JOIN firsts a ON a.line = earlier JOIN firsts b ON b.line = later),
        gone AS (SELECT doc_id, list(place) AS p FROM (SELECT doc_id, place FROM sets WHERE copy > 1 UNION SELECT doc_id, place FROM met WHERE same >= 0.8 * (total - same) - 1e-9) GROUP BY 1)
        SELECT doc_id, coalesce(len(t), 0)::BIGINT AS n_lines, coalesce(len(p), 0)::BIGINT AS n_removed,
            sha256(array_to_string(list_filter(t, lambda x, i: p IS NULL OR NOT list_contains(p, i)), chr(10))) AS kept_sha256
        FROM split LEFT JOIN gone USING (doc_id)""",
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}

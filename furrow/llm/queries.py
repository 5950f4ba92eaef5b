"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import (
    bpe, chat, decontam, fill_middle, html, langid, pii, simhash, suffix_dedup, token_count, token_files, topk, vector_codes
)
from furrow.session import ensure_checkpoint_dir, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect_pii(docs).select("doc_id", "pii_spans")

    def kind(name: str):
        return F.filter("pii_spans", lambda s: s["kind"] == name)

    base = F.filter("pii_spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    counts = {k: F.size(kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS}
    return found.select(
        "doc_id",
        *[counts[k] for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("pii_spans")).alias("spans"),
        *[counts[k] for k in ("iban", "ssn", "secret")],
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = langid.predict(docs.select("doc_id", "text"), langid.fit(docs), score_out="score")
    return named.select("doc_id", F.coalesce(~langid.learnable("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, ranks, pattern, decoded_out="decoded").select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_chats(table(spark, sf_dir, "conversations"))


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk.top_inner_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("contamination").alias("hit")).select(
        "doc_id", "hit.item_id", "hit.score", "hit.first_word", "hit.last_word"
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = vector_codes.compress(rows.filter(vector_codes.usable(F.col("embedding"))))
    summed = vector_codes.with_group_total(coded, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return fill_middle.restore(filled).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    size = (F.octet_length("token_ids") / 4).cast("long")
    return token_files.read_tokens(spark, folder).select("doc_id", "start", size.alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))


QUERIES = {"op1_pii": op1_pii, "op2_language": op2_language, "op3_simhash": op3_simhash, "op4_bpe": op4_bpe, "op5_chat": op5_chat, "op6_top_products": op6_top_products, "op7_suffix_dedup": op7_suffix_dedup, "op8_decontamination": op8_decontamination, "op9_main_text": op9_main_text, "op10_token_count": op10_token_count, "op11_vector_codes": op11_vector_codes, "op12_fill_in_middle": op12_fill_in_middle, "op13_token_files": op13_token_files}

ORACLES: dict[str, str] = {
    "op6_top_products": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op11_vector_codes": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS MATERIALIZED (
            SELECT n, p, w[p * (len(w) // 16) + 1 : (p + 1) * (len(w) // 16)] AS x FROM v, range(16) AS r(p)
        ), c0 AS MATERIALIZED (
            SELECT p, n - 1 AS e, x AS c FROM x WHERE n <= 64
        ), a0 AS MATERIALIZED (
            SELECT n, p, any_value(x) AS x, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m
            FROM x JOIN c0 USING (p) GROUP BY n, p
        ), s0 AS (
            SELECT p, m.e AS e, i, sum(x[i]) AS s, count(*) AS k FROM a0, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, m.e, i
        ), c1 AS MATERIALIZED (
            SELECT p, e, coalesce(t.c, c0.c) AS c FROM c0 LEFT JOIN (
                SELECT p, e, list(CAST((s - (s % k + k) % k) // k AS BIGINT) ORDER BY i) AS c FROM s0 GROUP BY p, e
            ) AS t USING (p, e)
        ), a1 AS MATERIALIZED (
            SELECT n, p, any_value(x) AS x, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m
            FROM x JOIN c1 USING (p) GROUP BY n, p
        ), s1 AS (
            SELECT p, m.e AS e, i, sum(x[i]) AS s, count(*) AS k FROM a1, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, m.e, i
        ), c2 AS MATERIALIZED (
            SELECT p, e, coalesce(t.c, c1.c) AS c FROM c1 LEFT JOIN (
                SELECT p, e, list(CAST((s - (s % k + k) % k) // k AS BIGINT) ORDER BY i) AS c FROM s1 GROUP BY p, e
            ) AS t USING (p, e)
        ), a2 AS MATERIALIZED (
            SELECT n, p, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m
            FROM x JOIN c2 USING (p) GROUP BY n, p
        ), coded AS (
            SELECT n, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY n
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
        FROM coded JOIN v USING (n)
    """,
    "op12_fill_in_middle": """
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), d AS (
            SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                   CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
            FROM h
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}

"""A training-corpus pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage sees all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, decontam, langid, pii, simhash
from furrow.llm.common import fresh, quoted
from furrow.session import ensure_checkpoint_dir, table


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go. If no language could be learned, only they do.

    What is predicted fills a missing label; a label that is there stays.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "lang_pred", "lang_score")
    named = langid.predict(docs, model, lang_out=lang, score_out=score).filter(F.col(lang) != langid.UNKNOWN)
    filled = {"lang": F.coalesce(F.col("lang"), F.col(lang).cast(docs.schema["lang"].dataType)).alias("lang")}
    return named.select(*[filled.get(c, F.col(quoted(c))) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; a group of null ids keeps one too."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; all columns stay as they are, whatever their names."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text. A null text stays null (and so does its n_chars); all columns stay."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its bytes: doc_id, lang, source and these, no other column. A null text has no ids."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, decoded_out="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language", keep_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", redact),
    ("encode", encode),
]

#: Learned models and alignments have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is checkpointed for the next."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)

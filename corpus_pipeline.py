"""Corpus pipeline: documents to token ids, in five stages.

1 language identification: documents whose language the model rejects go (a row without text or letters too).
2 near-duplicates: of each group one document stays, that with the smallest id. Linked are documents whose sets of five-word shingles have a similarity of 0.80 or more.
3 benchmark decontamination: documents that hold a passage of a benchmark item go.
4 secret scan: each found secret is replaced by a mark; documents stay, n_chars follows.
5 BPE: one row per document with its ids, the digests of ids and decoded text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, further ones included. run() writes each stage's result as
Parquet to the shared folder and reads it back as the next one's ``docs``.

Defined results. Rows of null id are never near-duplicates; rows that repeat an id and a text are copies of each other and all but one go in stage 2. A null text or one without a letter goes in stage 1; a stage that is given
such rows by themselves keeps them (2 to 4), and the last gives them no ids. Very long texts are taken whole. Empty tables stay empty. Further columns may have any names, those that the operators use inside included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.llm import bpe, decontaminate, langid, neardup, secrets
from webskein.plans.staging import stage


#: Similarity of near-duplicates, of 100; op4_neardup has its own, 85.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, ~langid.held_out("doc_id", 3, 1))
    return langid.known_languages(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, percent=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    keep = {c: F.col(c) for c in ("lang", "source") if c in docs.columns}
    return bpe.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), keep=keep, with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("bpe", tokens)]
#: Stages 1 and 5 can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs

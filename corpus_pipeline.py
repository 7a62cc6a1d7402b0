"""A training corpus from raw documents, in five stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, langid, secrets, sentencepiece_codec, simhash
from lumenframe.llm.common import finished, new_path, read, renamed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and those without a letter go; of the others, a null lang becomes the predicted one.

    Where no model could be trained the test of letters alone decides. Repeated rows stay; an empty table stays empty.
    """
    rows, text = renamed(docs)
    model = langid.train(docs)
    if not model.languages:
        return langid.lettered(rows, text=text, keep=rows.columns).where("lettered").select(*rows.columns).toDF(*docs.columns)
    kept = langid.predict(rows, model, text=text, keep=rows.columns).where(F.col("lang_pred") != "und")
    filled = [F.coalesce(own, "lang_pred").alias(own) if name == "lang" else own for own, name in zip(rows.columns, docs.columns)]
    return kept.select(*filled).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the least id, null ids last; of equal ids the least hash of the text."""
    return simhash.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    return decontaminate.without_matches(docs, read(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text. Null and empty texts stay as they are."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the token ids of the text, and digests of the ids and of their decoded text; null and empty texts have no ids.

    An input column of an added one's name gets ``_in`` at its end.
    """
    rows, text = renamed(docs)
    found = sentencepiece_codec.sentencepiece_codec(rows, sentencepiece_codec.model_path(), text, tuple(rows.columns), with_ids=True).drop("decoded")
    added = found.columns[len(rows.columns) :]
    return found.toDF(*[f"{c}_in" if c in added else c for c in docs.columns], *added)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark),
    ("secret_scan", secret_spans),
    ("sentencepiece", tokens),
]

#: The stages hash, link and encode in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All stages; with a ``path`` they are kept there, and stages that an earlier run over the same input has finished are not run again."""
    docs = read(spark, sf_dir, "documents")
    base = path or new_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES, 1):
        out = f"{base}/{i}-{name}"
        if not finished(spark, out):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs

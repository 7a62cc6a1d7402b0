"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import decontaminate, langid, licenses, pii, quality, secrets, sentencepiece_codec, sharding, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.query,
    "op2_decontaminate": decontaminate.query,
    "op3_pii": pii.query,
    "op4_language_id": langid.query,
    "op5_warc": warc.query,
    "op6_simhash": simhash.query,
    "op7_quality_rules": quality.query,
    "op8_secret_scan": secrets.query,
    "op9_sharding": sharding.query,
    "op10_sentencepiece": sentencepiece_codec.query,
}

ORACLE_SQL: dict[str, str] = {"op5_warc": warc.SQL}

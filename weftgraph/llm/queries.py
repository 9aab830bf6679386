"""Queries on the text of documents, over whole tables and whole texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import leakage, subjects, tokenizer

#: Where the vocabulary files are; a parameter of the environment.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(_table(spark, d, "documents"), "doc_id", "text", f"{VOCABULARIES}/byte_bpe_50k.tiktoken")


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens of each board."""
    ids = tokenizer.encode_corpus(_table(spark, d, "documents"), "doc_id", "text", f"{VOCABULARIES}/byte_bpe_50k.tiktoken", ("source",))
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"))


def p8_reposts(spark: SparkSession, d: str) -> DataFrame:
    """Ids of posts that repeat another but for formatting, from the tables of the original."""
    return tokenizer.reposts(_table(spark, d, "documents"), "doc_id", "text", f"{VOCABULARIES}/byte_bpe_50k.tiktoken")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("n_verbatim > 0").select("doc_id", "item_id")


def p9_changed(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share only re-parameterised windows."""
    return _leaks(spark, d).filter("n_verbatim = 0").select("doc_id", "item_id", "n_changed")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(_table(spark, d, "documents"), _table(spark, d, "area_labels"), _table(spark, d, "areas"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each area."""
    return p10_found(spark, d).groupBy("area").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_by_source, p8_reposts, p9_found, p9_changed, p10_found, p10_shares)}
_WORDS = r"regexp_extract_all(lower(regexp_replace(regexp_replace({}, '<[^<>]{{0,60}}>|\[[^\[\]]{{0,60}}\]|&[A-Za-z0-9#]{{1,8}};', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')"
SQL = {
    "p9_found": f"""with dw as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
dx as (select doc_id, array_to_string(w[i : i + 11], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from dw where len(w) >= 12)),
iw as (select item_id, {_WORDS.format("passage")} as w from eval_items where passage is not null),
ix as (select item_id, array_to_string(w[i : i + 11], ' ') as x from (select item_id, w, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12))
select distinct doc_id, item_id from dx join ix using (x)"""
}

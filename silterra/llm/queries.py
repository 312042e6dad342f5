"""The queries opN_<name> of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silterra.llm import chattemplate, covertree, cubemix, dartminhash, htmltemplate, langid, licences, suffixdedup, toxicity, wumanber
from silterra.session import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page: ``(kind, doc_id, page_id, lang, confidence)``."""
    docs = table(spark, sf_dir, "documents")
    texts = langid.document_texts(docs).union(langid.page_texts(table(spark, sf_dir, "pages")))
    found = langid.identify(texts, langid.train(docs))
    ids = [F.when(F.col("kind") == k, F.col("id")).alias(c) for k, c in (("document", "doc_id"), ("page", "page_id"))]
    return found.select("kind", *ids, "lang", "confidence")


def op2_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents: ``(doc_id, group_id)`` of every member."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_cubemix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a sample balanced to the sources' target weights."""
    return cubemix.mix_sources(table(spark, sf_dir, "documents"))


def op4_wumanber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items."""
    return wumanber.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that lie in windows of 50 words that occur repeatedly, and how many of them are cut."""
    return suffixdedup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and flag of every document, by a classifier fitted on a bounded sample of ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each one whose id is divisible by 100."""
    return covertree.neighbours(table(spark, sf_dir, "embeddings"), queries=F.expr(covertree.ASKED)).withColumn("similarity", F.round("similarity", 6))


def op8_chattemplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as ChatML, with the character spans that the model writes, as ``start-end`` between spaces."""
    spans = F.array_join(F.transform("generated", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return chattemplate.format_conversations(table(spark, sf_dir, "conversations")).withColumn("generated", spans)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a license, their own or their directory's; a document's path is its source and its id."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"))


def op10_htmltemplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page has in the slots of its host's template."""
    return htmltemplate.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_dartminhash": op2_dartminhash,
    "op3_cubemix": op3_cubemix,
    "op4_wumanber": op4_wumanber,
    "op5_suffixdedup": op5_suffixdedup,
    "op6_toxicity": op6_toxicity,
    "op7_covertree": op7_covertree,
    "op8_chattemplate": op8_chattemplate,
    "op9_licences": op9_licences,
    "op10_htmltemplate": op10_htmltemplate,
}

ORACLES: dict[str, str] = {
    "op4_wumanber": wumanber.ORACLE,
    "op5_suffixdedup": suffixdedup.ORACLE,
    "op7_covertree": covertree.ORACLE,
    "op8_chattemplate": chattemplate.ORACLE,
    "op9_licences": licences.oracle(),
}

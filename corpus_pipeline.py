"""The corpus pipeline: each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, mixing, ngram_join, pii, rules
from tracewell.llm.common import free_name, table
from tracewell.session import shared_folder


def _set_aside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose columns called like one of ``names`` keep their values meanwhile."""
    taken = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in names}
    done = work(docs.withColumnsRenamed(taken))
    return done.select(*[F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base limits nor the learned decision list reject.

    A null or empty text has no words and goes. Rows are judged one by one, whatever their id; equal
    rows share their fate. Without usable labels only the base limits hold. Columns stay as they are.
    """
    return rules.keep(docs, rules.learn(rules.count(docs), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a shingle similarity of 0.8 or more.

    The least id stays, nulls last, then the least row. Null and empty texts are one group, as are
    texts of the same characters without a word. Columns stay as they are.
    """
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced by their kinds.

    ``n_chars`` counts the new text; a null text stays null. Any other column stays as it is, also one
    that is called like a column of the operator. Repeated rows stay rows.
    """
    counted = lambda clean: clean.withColumn("n_chars", F.length("text").cast("long"))
    return _set_aside(docs, ("base", "terms"), lambda own: counted(pii.sanitise(pii.mark(own))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    A text without words takes no part. Equal rows with one id share their draw. A null source is a
    source, the last one. Columns stay as they are, also those called like a column of the operator.
    """
    names = ("size", "source_size", "target", "copies")
    return _set_aside(docs, names, lambda own: mixing.repeat(mixing.mix(own)))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed token ids; a null or empty text has none. Repeated rows stay rows."""
    coded = bpe.encode(docs)
    return coded.select("doc_id", "lang", "source", bpe.n_tokens("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("bpe_encoding", bpe_encoding),
]

#: The stages learn, iterate and tokenize, which SQL cannot state; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

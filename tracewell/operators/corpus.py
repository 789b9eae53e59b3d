"""Text preparation for the language-model branch: phrases, split, truncation, fingerprint."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import hash60, phrase_parts, tokens
from tracewell.operators.order import key_range, running_before


MANIFEST = "content_hash long, n_rows long, signature string, folder string"


def phrases(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per phrase with its position in the text."""
    return docs.select(*keys, F.posexplode(phrase_parts(text)).alias("phrase_no", "phrase"))


def head_fraction(docs: DataFrame, key: str, frac: float = 0.9, text: str = "text") -> DataFrame:
    """The first ``frac`` of all phrases in (key, position) order, at least one.

    Phrases are counted per text before anything is exploded; only whole-text counts are summed.
    """
    if not 0 < frac <= 1:
        raise ValueError("frac must lie in (0, 1]")
    listed = docs.select(key, phrase_parts(text).alias("parts"))
    total = listed.agg(F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("n"))
    cut = total.select(F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(frac)))).cast("long")).scalar()
    counted = running_before(
        listed, "_start", [key], [key_range(key, 10_000)], value=F.size("parts")
    )
    rows = counted.select(key, "_start", F.posexplode("parts").alias("phrase_no", "phrase"))
    rank = F.col("_start") + F.col("phrase_no")
    return rows.filter(rank < cut).select(key, "phrase_no", "phrase")


def hash_split(rows: DataFrame, row_id: Column, percent: int = 10, seed: int = 42) -> DataFrame:
    """Label each row train or eval by a hash of its id: stable under any partitioning."""
    bucket = hash60(F.concat(row_id, F.lit(f":{seed}"))) % 100
    return rows.withColumn("split", F.when(bucket < percent, "eval").otherwise("train"))


def truncate_tokens(rows: DataFrame, text: str, limit: int = 128) -> DataFrame:
    """At most ``limit`` white-space tokens of each phrase, with the full token count."""
    t = tokens(text)
    return rows.withColumn("n_tokens", F.size(t)).withColumn(
        text, F.array_join(F.slice(t, 1, limit), " ")
    )


def token_length_stats(rows: DataFrame, text: str) -> DataFrame:
    n = F.size(tokens(text))
    return rows.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.avg(n), 6).alias("avg_tokens"),
        F.max(n).cast("long").alias("max_tokens"),
    )


def fingerprint(rows: DataFrame, row_text: Column, signature: str) -> DataFrame:
    """Order-free content hash: exclusive-or of the rows' hashes, the row count and the parameters."""
    return rows.agg(
        F.bit_xor(hash60(row_text)).alias("content_hash"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("signature", F.lit(signature))


def write_if_changed(rows: DataFrame, row_text: Column, signature: str, path: str) -> bool:
    """Write the prepared rows unless the stored manifest already matches; returns True on a write.

    Each content gets its own data folder and the manifest is written last, so a broken run leaves
    the earlier data set ready and a half-written one never counts.
    """
    spark = rows.sparkSession
    now = fingerprint(rows, row_text, signature).first()
    try:
        old = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None and (old["content_hash"], old["n_rows"], old["signature"]) == tuple(now):
        return False
    folder = f"data_{now['content_hash']:015x}_{now['n_rows']}"
    rows.write.mode("overwrite").parquet(f"{path}/{folder}")
    manifest = spark.createDataFrame([(*now, folder)], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return True

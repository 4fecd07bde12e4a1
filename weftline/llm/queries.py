"""Queries over the whole corpus for the training-text problems, with the SQL they must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encoding import encode_corpus, with_token_counts
from weftline.llm.mixing import mix, mix_report
from weftline.llm.subjects import area_shares, subject_areas, thread_root
from weftline.session import written
from weftline.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(with_token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"), "n_tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per source: its target share and most repeats, and whether the mix keeps to them, or takes all it may of a source."""
    counted, targets = written(with_token_counts(table(spark, d, "documents")).select("doc_id", "text", "source", "n_tokens")), table(spark, d, "mix_targets")
    own = counted.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"))
    report = mix_report(mix(counted, targets, "n_tokens"), targets).join(own, "source", "left")
    all_taken = F.col("tokens") >= 0.99 * F.col("max_repeats") * F.coalesce("own_tokens", F.lit(0))
    return report.select(
        "source", "target_share", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"),
        ((F.col("actual_share") >= F.col("target_share") - 0.01) | all_taken).alias("share_met"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("thread", thread_root("message_id", "in_reply_to", "ref_ids"))
    return subject_areas(documents, table(spark, d, "doc_labels"), table(spark, d, "subject_areas"), thread="thread")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return area_shares(table(spark, d, "documents"), p9_found(spark, d), table(spark, d, "subject_areas"))


QUERIES = {f.__name__: f for f in (p7_ids, p8_mix, p8_report, p8_invariants, p9_found, p9_shares)}
SQL = {
    "p8_invariants": """
select source, greatest(coalesce(weight, 0), 0) / sum(greatest(coalesce(weight, 0), 0)) over () as target_share, max_repeats, true as repeats_kept, true as share_met
from mix_targets where source is not null""",
}

"""From raw documents to token ids: each stage works on all that the one before it kept."""

from pyspark.sql import functions as F

from skygrade.llm import bytebpe, decontam, exact, minmax, quality
from skygrade.llm.common import Scratch, table
from skygrade.llm.filters import without


def drop_low_quality(spark, docs, sf_dir):
    """Documents whose quality score reaches the threshold."""
    score = quality.scorer(docs, table(spark, sf_dir, "labels"))
    return without(docs, lambda given: given.select("doc_id", score("text").alias("_score")).where(F.col("_score") < quality.REJECT_BELOW))


def drop_copies(spark, docs, sf_dir):
    """Of documents with equal normalised texts, the one with the smallest doc_id."""
    return without(docs, lambda given: exact.exact_groups(given).where("not kept"))


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of near duplicates, the document with the smallest doc_id."""
    return without(docs, lambda given: minmax.near_groups(given).where("not kept"))


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold no passage of the benchmark."""
    return without(docs, lambda given: decontam.find_leaks(given, table(spark, sf_dir, "benchmark")))


def encode(spark, docs, sf_dir):
    """Token ids of what is left, and their reversal, as digests."""
    return bytebpe.round_trip(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte BPE", encode),
]

#: The first stage is a trained network, which SQL cannot state; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written out and read again; the last one's rows."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Training data from documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factline.llm import decontaminate, jaccard, langid, mixing, sharding
from factline.llm.common import stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some mixture of languages explains; the rows themselves are unchanged.

    Null, empty and wordless texts go (no language explains them); null ids, sources and
    languages don't matter; repeated rows stay; very long texts are read whole. Ties of languages
    reject nothing. An empty table gives an empty one, and so does one without any labelled language."""
    return langid.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join connects: that of the least id.

    Null ids and wordless texts stay; rows that repeat a kept one in id and text go, of
    rows that share an id and differ in text all stay if the id is kept. Very long texts count whole. An empty table gives
    an empty one; other columns are ignored."""
    return jaccard.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    By text: null and empty texts stay, equal texts share their fate whatever their ids. An empty
    benchmark takes nothing away, and an empty table gives an empty one."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, under their own columns only.

    A null source is a source; rows of one id (or of none) share their count; columns called like those that
    the operator adds keep what they hold. An empty table gives an empty one."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    ident, source = (f"c{docs.columns.index(c)}" for c in ("doc_id", "source"))
    mixed = mixing.mix_sources(plain, id_col=ident, source_col=source)
    return mixed.select(*plain.columns).toDF(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, shuffled into shards, with their places.

    Every row comes out once, whatever is null in it; repeated rows are spread like others. Columns called
    ``shard`` or ``position`` give way. An empty table gives an empty one."""
    return sharding.shard(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

#: Expectation-maximisation and singular vectors are beyond SQL; tests hold
#: the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written to the shared folder
    and read again, so a lost executor costs a stage's tasks at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{k}")
    return docs

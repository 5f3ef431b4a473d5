"""A training-data pipeline over ``documents``: rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import Table, released, sized
from loomspan.llm.line_dedup import line_dedup
from loomspan.llm.mixing import mix_sources
from loomspan.llm.packing import pack_documents
from loomspan.llm.quality import quality_rules
from loomspan.llm.simhash import simhash_dedup
from loomspan.llm.tokens import tokenizer_path


class Apart:
    """The columns of ``docs`` under names that no operator uses for its results, so that all of them pass unchanged."""

    def __init__(self, docs: DataFrame):
        self.docs, self.names = docs, docs.columns
        self.of = {name: f"column_{i}" for i, name in enumerate(self.names)}
        self.frame = docs.toDF(*self.of.values())

    def back(self, result: DataFrame) -> DataFrame:
        """The columns of ``docs`` only, under their own names, in files of a sensible size."""
        return sized(result.select(*[F.col(c).alias(name) for name, c in self.of.items()]), self.docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    apart = Apart(docs)
    return apart.back(quality_rules(apart.frame, text=apart.of["text"]).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least three documents share, but for one of them; n_chars follows the text."""
    apart = Apart(docs)
    kept = line_dedup(apart.frame, doc_id=apart.of["doc_id"], text=apart.of["text"])
    if "n_chars" in apart.of:
        kept = kept.withColumn(apart.of["n_chars"], F.length(apart.of["text"]).cast(docs.schema["n_chars"].dataType))
    return apart.back(kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group."""
    return sized(simhash_dedup(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to their sources' target shares, in a global shuffle."""
    apart = Apart(docs)
    return apart.back(mix_sources(apart.frame, doc_id=apart.of["doc_id"], source=apart.of["source"], text=apart.of["text"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences: a row a piece."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


#: Each takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
STAGES = [("quality_rules", rules), ("line_dedup", lines), ("simhash_dedup", near_copies), ("mix_sources", mixture), ("best_fit_packing", packing)]

#: Token ids, SimHash components and packing are not expressible in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. Once a stage is written, the tables
    that its operator made and the stage before go; the last stage's table stays for the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with released() as keep:
            table = Table(stage(spark, docs, sf_dir), name)
            keep.add(table.path)
        if before is not None:
            before.drop()
        docs, before = table.read(), table
    return docs

"""The corpus pipeline: quality rules, SimHash near-duplicates, repeated strings,
personal data, packing. Each stage takes (spark, docs, sf_dir), works on all
rows it is given and returns documents' columns, the last one the pieces of the
packed sequences. Stages after which texts changed set n_chars anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import packing, pii, quality, simhash, suffix_dedup
from cadenza.llm.common import materialize, prepare, table


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


_ROW = "corpus_pipeline_row"


def _row(docs: DataFrame):
    """Names a row by its text's hash and then all of its columns'; rows with
    the same name are the same in every column."""
    return F.concat(F.md5(F.coalesce("text", F.lit(""))), F.lit("-"), F.hex(F.xxhash64(*docs.columns)), F.hex(F.hash(*docs.columns)))


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    prepare(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows joined by chains of Jaccard similarity 0.8 or more
    over shingles of five words one row stays: the one of least id (none comes
    last), of these the one of least text hash. Ids may repeat or be null."""
    prepare(spark)
    named = docs.withColumn(_ROW, _row(docs))
    found = simhash.similar_texts(named.select(F.col(_ROW).alias("row"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    ids = named.select(F.col(_ROW).alias("row"), "doc_id").distinct()
    lead = found.distinct().join(ids, "row").groupBy("component").agg(F.min(order).alias("lead"))
    kept = named.join(lead.select(F.col("lead.row").alias(_ROW)), _ROW, "left_semi")
    return kept.dropDuplicates([_ROW]).select(*docs.columns)


def repeated_strings(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 200 bytes that occur elsewhere go."""
    prepare(spark)
    return _counted(suffix_dedup.without_repeats(docs))


def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Detected entities get surrogates."""
    prepare(spark)
    return _counted(pii.without_pii(docs, pii.session_key(spark)))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    prepare(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("pii_surrogates", personal_data),
    ("packing", packed),
]

#: A conditional random field, fingerprints and token ids are beyond SQL; the
#: stages are held against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs

"""The corpus pipeline: its stages over documents, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightledger.llm.decontaminate import find_windows
from brightledger.llm.near_dup import near_duplicates
from brightledger.llm.packing import pack
from brightledger.llm.quality import judge_quality
from brightledger.llm.suffix_dedup import remove_repeats
from brightledger.llm.tables import settled, whole_row
from brightledger.llm.url_filter import not_listed
from brightledger.session import load_table, ship_package

ship_package()  # executors need no install


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge_quality(docs, carry=True).where("kept").select("row.*")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity
    0.8 or more: that with the least id. Rows that share an id and a text are
    one document; rows without an id are kept."""
    judged = settled(near_duplicates(docs).select("doc_id", "kept"), "judged")
    kept = not_listed(docs, "doc_id", judged.where(~F.col("kept")))
    repeated = settled(judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = kept.select("doc_id", "text", whole_row(kept)).join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select("row.*")
    return not_listed(kept, "doc_id", repeated).unionByName(once)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier; a
    character goes if one of its bytes does. No row goes, even if nothing is
    left of it; `n_chars` is counted anew."""
    done = remove_repeats(docs, carry=True)
    values = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[values[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    found = find_windows(docs, load_table(spark, sf_dir, "benchmark"), carry=True)
    return found.where(F.size("spans") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_dup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, one after another."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

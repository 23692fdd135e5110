"""V1-V6: are the numbers and citations of a claim backed by evidence?

claims: claim_id, session_id, text, label.
evidence: session_id, tool, succeeded, output.
citations: claim_id, excerpt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A number as written, labels that claim a computed number, and
# tools whose output is found text rather than a computed result.
NUMBER_SHAPE = r"(?<![A-Za-z])-?\d[\d,]*\.?\d*%?"
NUMERIC_LABELS = ["VERIFIED_FROM_DATA", "CALCULATED", "DERIVED"]
TEXT_TOOLS = ["search_documents", "retrieve_document_evidence", "web_research"]
INTERPRETATION, DOCUMENT, WEB = "AI_INTERPRETATION", "DOCUMENT_EVIDENCE", "VERIFIED_FROM_WEB"

ABSOLUTE_TOLERANCE = 0.5
RELATIVE_TOLERANCE = 0.02
SHARED_WORDS = 3

_SWITCH = ABSOLUTE_TOLERANCE / RELATIVE_TOLERANCE


def extract_numbers(text: Column) -> Column:
    """V1: the numbers written in a text."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_SHAPE), F.lit(0))
    return F.array_compact(F.transform(found, lambda x: F.regexp_replace(x, "[,%]", "").try_cast("double")))


def authoritative(evidence: DataFrame) -> DataFrame:
    """V3: computed results of calls that worked."""
    return evidence.filter(F.col("succeeded") & ~F.col("tool").isin(TEXT_TOOLS))


def magnitude_band(x: Column) -> Column:
    """Bands no wider than the tolerance: 0.5 up to 25, then steps of 2 %."""
    linear = F.floor(x / ABSOLUTE_TOLERANCE)
    ratio = F.floor(F.log(F.greatest(x, F.lit(_SWITCH)) / _SWITCH) / F.log(F.lit(1 + RELATIVE_TOLERANCE)))
    return F.when(x < _SWITCH, linear).otherwise(ratio + int(_SWITCH / ABSOLUTE_TOLERANCE)).cast("long")


def number_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """V2: (claim_id, numbers, supported) for claims that state numbers.

    Evidence shrinks to the least and greatest magnitude per session and band.
    A tolerance range always reaches over a whole band border, so these two
    values decide whether some evidence lies in the range; claim numbers and
    evidence numbers are never paired off.
    """
    pool = (
        authoritative(evidence)
        .select("session_id", F.explode(extract_numbers(F.col("output"))).alias("v"))
        .select("session_id", F.abs(F.round("v", 2)).alias("v"))
        .groupBy("session_id", magnitude_band(F.col("v")).alias("band"))
        .agg(F.min("v").alias("low"), F.max("v").alias("high"))
    )
    numbers = claims.select("claim_id", "session_id", F.posexplode(extract_numbers(F.col("text"))).alias("no", "n")).withColumn(
        "n", F.abs(F.round("n", 2))
    )
    tolerance = F.greatest(F.lit(ABSOLUTE_TOLERANCE), F.col("n") * RELATIVE_TOLERANCE)
    reach = F.sequence(
        magnitude_band(F.greatest(F.col("n") - tolerance, F.lit(0.0))) - 1, magnitude_band(F.col("n") + tolerance) + 1
    )
    near = numbers.withColumn("tolerance", tolerance).withColumn("band", F.explode(reach))
    hit = (F.col("n") - F.col("high") <= F.col("tolerance")) & (F.col("low") - F.col("n") <= F.col("tolerance"))
    return (
        near.join(pool, ["session_id", "band"], "left")
        .groupBy("claim_id", "no")
        .agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("ok"))
        .groupBy("claim_id")
        .agg(F.count(F.lit(1)).alias("numbers"), F.bool_and("ok").alias("supported"))
    )


def verify_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """V2: labels kept or lowered, never raised."""
    asked = claims.filter(F.col("label").isin(NUMERIC_LABELS))
    support = number_support(asked, evidence)
    joined = claims.join(support, "claim_id", "left")
    lowered = F.col("supported").isNotNull() & ~F.col("supported")
    return joined.select(
        "claim_id",
        "session_id",
        "label",
        F.when(lowered, INTERPRETATION).otherwise(F.col("label")).alias("final_label"),
        F.coalesce("numbers", F.lit(0)).alias("numbers"),
        lowered.alias("downgraded"),
    )


def long_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[a-zA-Z]{4,}"), F.lit(0)), lambda w: F.lower(w)))


def verify_grounding(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """V4: (claim_id, cited, grounded): some excerpt shares at least three of the
    claim's words of four letters or more (all of them if it has fewer)."""
    words = claims.select("claim_id", long_words(F.col("text")).alias("words"))
    shared = (
        words.join(citations.select("claim_id", "excerpt"), "claim_id")
        .select("claim_id", F.size(F.array_intersect("words", long_words(F.col("excerpt")))).alias("n"))
        .groupBy("claim_id")
        .agg(F.max("n").alias("shared"), F.count(F.lit(1)).alias("citations"))
    )
    enough = (F.size("words") == 0) | (F.col("shared") >= F.least(F.lit(SHARED_WORDS), F.size("words")))
    cited = F.col("citations").isNotNull()
    return words.join(shared, "claim_id", "left").select(
        "claim_id", cited.alias("cited"), (cited & F.coalesce(enough, F.lit(False))).alias("grounded")
    )


def verify_comparisons(comparisons: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """V5: comparisons (claim_id, session_id, data_finding, label) of documents
    with data; without data backing or citation the evidence is insufficient."""
    verdicts = ["SUPPORTED_BY_DATA", "CONTRADICTED_BY_DATA"]
    asked = comparisons.filter(F.col("label").isin(verdicts)).withColumn("text", F.coalesce("data_finding", F.lit("")))
    support = number_support(asked, evidence)
    cited = citations.select("claim_id").distinct().withColumn("cited", F.lit(True))
    joined = comparisons.join(support, "claim_id", "left").join(cited, "claim_id", "left")
    empty = F.coalesce(F.col("data_finding"), F.lit("")) == ""
    unbacked = F.col("label").isin(verdicts) & (empty | ~F.coalesce("supported", F.lit(True)))
    uncited = (F.col("label") != "DOCUMENT_CLAIM") & F.col("cited").isNull()
    return joined.select(
        "claim_id",
        "label",
        F.when(unbacked | uncited, "INSUFFICIENT_EVIDENCE").otherwise(F.col("label")).alias("final_label"),
    )


def relabel_cited(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """V6: cited claims become document (or web) evidence where grounded; others
    lose their citations and count as interpretation. Uncited go through V2.

    citations may carry source_type ("web" or "document").
    """
    sources = citations if "source_type" in citations.columns else citations.withColumn("source_type", F.lit("document"))
    web = sources.groupBy("claim_id").agg(F.bool_or(F.col("source_type") == "web").alias("web"))
    base = claims.join(verify_grounding(claims, sources), "claim_id").join(web, "claim_id", "left")
    checked = F.col("cited") | F.col("label").isin(DOCUMENT, WEB)
    target = F.when(F.coalesce("web", F.lit(False)) | (F.col("label") == WEB), WEB).otherwise(DOCUMENT)
    new = (
        F.when(~F.col("grounded"), INTERPRETATION).when(F.col("label").isin(DOCUMENT, WEB), F.col("label")).otherwise(target)
    )
    cited = base.filter(checked).select(
        "claim_id", "label", new.alias("final_label"), (F.col("cited") & F.col("grounded")).alias("keeps_citations")
    )
    plain = verify_claims(base.filter(~checked).select(*claims.columns), evidence)
    return cited.unionByName(plain.select("claim_id", "label", "final_label", F.lit(False).alias("keeps_citations")))

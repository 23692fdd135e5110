"""V1-V6: claims about orders and conversations against computed evidence."""

from pyspark.sql import functions as F

from brightledger.operators.verify import (
    authoritative,
    extract_numbers,
    relabel_cited,
    verify_claims,
    verify_comparisons,
    verify_grounding,
)
from brightledger.session import load_table
from queries import query

_TOOL = "CASE o_orderstatus WHEN 'O' THEN 'calculate_metric' WHEN 'F' THEN 'group_and_aggregate' ELSE 'search_documents' END"
_NUMBER = "CAST(floor(o_totalprice * (1.0 + (o_orderkey % 7) * 0.01)) AS BIGINT)"
_LABEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'DERIVED' WHEN '2-HIGH' THEN 'VERIFIED_FROM_DATA' WHEN '3-MEDIUM' THEN 'AI_INTERPRETATION' ELSE 'CALCULATED' END"


def _evidence(spark, d):
    total = F.expr("CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)")
    return load_table(spark, d, "orders").select(
        F.col("o_custkey").alias("session_id"),
        F.expr(_TOOL).alias("tool"),
        (F.col("o_orderpriority") != "5-LOW").alias("succeeded"),
        F.concat(F.lit('{"change": -'), total, F.lit("}")).alias("output"),
    )


def _claims(spark, d):
    return load_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("session_id"),
        F.concat(F.lit("Orders fell by "), F.format_number(F.expr(_NUMBER), 0), F.lit(" in Q3")).alias("text"),
        F.expr(_LABEL).alias("label"),
    )


_EV = f"""ev AS (SELECT DISTINCT o_custkey AS session_id, floor(o_totalprice) AS v FROM orders WHERE {_TOOL} <> 'search_documents' AND o_orderpriority <> '5-LOW'),
  cl AS (SELECT o_orderkey AS claim_id, o_custkey AS session_id, {_NUMBER} AS n, {_LABEL} AS label FROM orders),
  ok AS (SELECT claim_id, bool_or(coalesce(abs(n - v) <= greatest(0.5, n * 0.02), false)) AS backed FROM cl LEFT JOIN ev USING (session_id) GROUP BY 1)"""


@query(
    "v1_numbers",
    r"""SELECT doc_id, CAST(count(*) AS INTEGER) AS numbers, max(abs(CAST(regexp_replace(x, '[,%]', '', 'g') AS DOUBLE))) AS largest
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^A-Za-z])(-?[0-9][0-9,]*\.?[0-9]*%?)', 2)) AS x FROM documents) GROUP BY 1""",
)
def v1_numbers(spark, d):
    found = load_table(spark, d, "documents").select("doc_id", extract_numbers(F.col("text")).alias("x")).filter(F.size("x") > 0)
    return found.select("doc_id", F.size("x").alias("numbers"), F.array_max(F.transform("x", lambda v: F.abs(v))).alias("largest"))


@query(
    "v2_verified_claims",
    f"""WITH {_EV} SELECT claim_id, label, CASE WHEN label <> 'AI_INTERPRETATION' AND NOT backed THEN 'AI_INTERPRETATION' ELSE label END AS final_label,
          label <> 'AI_INTERPRETATION' AND NOT backed AS downgraded FROM cl JOIN ok USING (claim_id)""",
)
def v2_verified_claims(spark, d):
    return verify_claims(_claims(spark, d), _evidence(spark, d)).select("claim_id", "label", "final_label", "downgraded")


@query(
    "v3_authoritative_evidence",
    f"SELECT o_custkey AS session_id, {_TOOL} AS tool, count(*) AS n FROM orders WHERE {_TOOL} <> 'search_documents' AND o_orderpriority <> '5-LOW' GROUP BY 1, 2",
)
def v3_authoritative_evidence(spark, d):
    return authoritative(_evidence(spark, d)).groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"))


_TURN = "conv_id * 100000 + turn"
_WORDS = "list_distinct(regexp_extract_all(lower({x}), '[a-z]{{4,}}'))"
_GROUNDED = f"""g AS (SELECT c.{_TURN.replace('turn', 'c.turn')} AS claim_id, p.text IS NOT NULL AS cited, coalesce(len({_WORDS.format(x='c.text')}) = 0 OR
    len(list_intersect({_WORDS.format(x='c.text')}, {_WORDS.format(x='p.text')})) >= least(3, len({_WORDS.format(x='c.text')})), false) AND p.text IS NOT NULL AS grounded, c.role
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)"""


def _turns(spark, d):
    """Each turn as a claim citing the turn before it."""
    turns = load_table(spark, d, "conversations")
    label = F.when(F.col("role") == "user", "AI_INTERPRETATION").when(F.col("role") == "system", "DOCUMENT_EVIDENCE").otherwise("CALCULATED")
    claims = turns.select(F.expr(_TURN).alias("claim_id"), F.col("conv_id").alias("session_id"), "text", label.alias("label"))
    cited = turns.select(F.expr("conv_id * 100000 + turn + 1").alias("claim_id"), F.col("text").alias("excerpt"))
    return claims, cited.join(claims.select("claim_id"), "claim_id", "left_semi")


@query("v4_grounding", f"WITH {_GROUNDED} SELECT claim_id, cited, grounded FROM g")
def v4_grounding(spark, d):
    return verify_grounding(*_turns(spark, d))


_VERDICT = "CASE o_orderkey % 4 WHEN 0 THEN 'SUPPORTED_BY_DATA' WHEN 1 THEN 'CONTRADICTED_BY_DATA' WHEN 2 THEN 'DOCUMENT_CLAIM' ELSE 'NOT_COMPARABLE' END"


@query(
    "v5_comparisons",
    f"""WITH {_EV} SELECT o_orderkey AS claim_id, {_VERDICT} AS label,
          CASE WHEN ({_VERDICT} LIKE '%_BY_DATA' AND (o_orderpriority = '1-URGENT' OR NOT backed)) OR ({_VERDICT} <> 'DOCUMENT_CLAIM' AND o_orderstatus <> 'F')
          THEN 'INSUFFICIENT_EVIDENCE' ELSE {_VERDICT} END AS final_label FROM orders JOIN ok ON claim_id = o_orderkey""",
)
def v5_comparisons(spark, d):
    orders = load_table(spark, d, "orders")
    compared = orders.select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("session_id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("total "), F.expr(_NUMBER).cast("string"))).alias("data_finding"),
        F.expr(_VERDICT).alias("label"),
    )
    citations = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("excerpt"))
    return verify_comparisons(compared, _evidence(spark, d), citations)


@query(
    "v6_relabelled",
    f"""WITH {_GROUNDED}, l AS (SELECT *, CASE role WHEN 'user' THEN 'AI_INTERPRETATION' WHEN 'system' THEN 'DOCUMENT_EVIDENCE' ELSE 'CALCULATED' END AS label FROM g)
        SELECT claim_id, label, CASE WHEN NOT cited AND role <> 'system' THEN label WHEN NOT grounded THEN 'AI_INTERPRETATION' ELSE 'DOCUMENT_EVIDENCE' END AS final_label,
          cited AND grounded AS keeps_citations FROM l""",
)
def v6_relabelled(spark, d):
    """Cited turns become document evidence or fall; others keep their label."""
    claims, citations = _turns(spark, d)
    return relabel_cited(claims, citations, _evidence(spark, d))

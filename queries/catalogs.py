"""C1-C7, X1-X6."""

from pyspark.sql import functions as F

from brightledger.operators.catalog import fuzzy_pairs, guarded_out, match_columns, match_names, role_bonus
from brightledger.operators.versions import (
    activate_versions,
    add_versions,
    check_duplicates,
    content_hash,
    delete_versions,
    library,
    listing,
    narrowed,
    session_list,
    visible_datasets,
)
from brightledger.functions.exprs import name_parts
from brightledger.session import load_table
from queries import query

# Documents as uploads: a file per language and source, the newest one active.
_VERSIONS = """v AS (SELECT doc_id AS id, lang AS user_id, source AS filename, sha256(text) AS content_hash, doc_id AS version,
  doc_id = max(doc_id) OVER (PARTITION BY lang, source) AS is_active, doc_id AS created_at FROM documents)"""
_UPLOADS = """u AS (SELECT 10000000 + min(doc_id) AS id, lang AS user_id, CASE WHEN lang = 'es' THEN 'new_' ELSE '' END || source AS filename,
  sha256(arg_min(text, doc_id)) AS content_hash, 10000000 + min(doc_id) AS created_at FROM documents GROUP BY lang, source)"""


def _versions(spark, d):
    docs = load_table(spark, d, "documents")
    newest = docs.groupBy("lang", "source").agg(F.max("doc_id").alias("newest"))
    return docs.join(newest, ["lang", "source"]).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("user_id"), F.col("source").alias("filename"),
        content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("version"),
        (F.col("doc_id") == F.col("newest")).alias("is_active"), F.col("doc_id").alias("created_at"),
    )


def _uploads(spark, d):
    first = load_table(spark, d, "documents").groupBy("lang", "source").agg(
        F.min("doc_id").alias("doc_id"), F.min_by(content_hash(F.col("text")), "doc_id").alias("content_hash")
    )
    name = F.concat(F.when(F.col("lang") == "es", "new_").otherwise(""), F.col("source"))
    return first.select(
        (F.col("doc_id") + 10000000).alias("id"), F.col("lang").alias("user_id"), name.alias("filename"),
        "content_hash", (F.col("doc_id") + 10000000).alias("created_at"),
    )


_NEXT = "n AS (SELECT user_id, filename, max(version) + 1 AS nv FROM v GROUP BY 1, 2)"


@query(
    "c1_duplicate_check",
    f"""WITH {_VERSIONS}, {_UPLOADS}, {_NEXT}
        SELECT u.id, u.user_id, u.filename, CASE WHEN a.id IS NULL THEN 'new' WHEN a.content_hash = u.content_hash THEN 'exact_duplicate' ELSE 'changed_version' END AS status,
          a.id AS existing_id, CASE WHEN a.content_hash <> u.content_hash THEN nv END AS next_version
        FROM u LEFT JOIN v a ON a.is_active AND a.user_id = u.user_id AND a.filename = u.filename LEFT JOIN n ON n.user_id = u.user_id AND n.filename = u.filename""",
)
def c1_duplicate_check(spark, d):
    return check_duplicates(_uploads(spark, d), _versions(spark, d)).drop("content_hash", "created_at")


@query(
    "c2_new_versions",
    f"""WITH {_VERSIONS}, {_UPLOADS}, {_NEXT},
        f AS (SELECT u.*, coalesce(nv, 1) AS version FROM u LEFT JOIN v a ON a.is_active AND a.user_id = u.user_id AND a.filename = u.filename
          LEFT JOIN n ON n.user_id = u.user_id AND n.filename = u.filename WHERE a.content_hash IS DISTINCT FROM u.content_hash)
        SELECT v.id, v.user_id, v.filename, v.version, is_active AND f.id IS NULL AS is_active FROM v LEFT JOIN f ON f.user_id = v.user_id AND f.filename = v.filename
        UNION ALL SELECT id, user_id, filename, version, true FROM f""",
)
def c2_new_versions(spark, d):
    return add_versions(_versions(spark, d), _uploads(spark, d)).select("id", "user_id", "filename", "version", "is_active")


@query(
    "c2_repeated_uploads",
    f"""WITH {_VERSIONS}, {_UPLOADS},
        w AS (SELECT * FROM u UNION ALL SELECT id + 1000000, user_id, filename, content_hash, created_at + 1000000 FROM u
              UNION ALL SELECT id + 2000000, user_id, filename, sha256(content_hash), created_at + 2000000 FROM u),
        b AS (SELECT user_id, filename, max(version) AS top, max(CASE WHEN is_active THEN content_hash END) AS hash FROM v GROUP BY 1, 2),
        x AS (SELECT w.*, b.top, coalesce(lag(content_hash) OVER (PARTITION BY user_id, filename ORDER BY created_at, id), b.hash) AS before FROM w LEFT JOIN b USING (user_id, filename)),
        f AS (SELECT *, coalesce(top, 0) + row_number() OVER (PARTITION BY user_id, filename ORDER BY created_at, id) AS version,
              row_number() OVER (PARTITION BY user_id, filename ORDER BY created_at DESC, id DESC) = 1 AS is_active FROM x WHERE before IS DISTINCT FROM content_hash)
        SELECT id, user_id, filename, version, is_active AND (user_id || '/' || filename) NOT IN (SELECT user_id || '/' || filename FROM f) AS is_active FROM v
        UNION ALL SELECT id, user_id, filename, version, is_active FROM f""",
)
def c2_repeated_uploads(spark, d):
    """Each file comes three times: unchanged the second time, changed the third."""
    first = _uploads(spark, d)
    again = lambda n: first.withColumns({"id": F.col("id") + n, "created_at": F.col("created_at") + n})
    changed = again(2000000).withColumn("content_hash", content_hash(F.col("content_hash")))
    uploads = first.unionByName(again(1000000)).unionByName(changed)
    return add_versions(_versions(spark, d), uploads).select("id", "user_id", "filename", "version", "is_active")


@query(
    "c3_activate_older",
    f"WITH {_VERSIONS} SELECT id, filename, version = min(version) OVER (PARTITION BY user_id, filename) AS is_active FROM v",
)
def c3_activate_older(spark, d):
    versions = _versions(spark, d)
    oldest = versions.groupBy("user_id", "filename").agg(F.min("id").alias("id")).select("user_id", "id")
    return activate_versions(versions, oldest).select("id", "filename", "is_active")


@query(
    "c4_delete_and_promote",
    f"""WITH {_VERSIONS}, g AS (SELECT DISTINCT doc_id AS id FROM labels UNION SELECT id FROM v WHERE is_active AND user_id <> 'fr'),
        r AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM g)), o AS (SELECT user_id, filename FROM v WHERE is_active AND id IN (SELECT id FROM g))
        SELECT r.id, r.filename, r.is_active OR (o.filename IS NOT NULL AND r.version = max(r.version) OVER (PARTITION BY r.user_id, r.filename)) AS is_active
        FROM r LEFT JOIN o ON o.user_id = r.user_id AND o.filename = r.filename""",
)
def c4_delete_and_promote(spark, d):
    versions = _versions(spark, d)
    labelled = load_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    gone = labelled.unionAll(versions.filter("is_active AND user_id <> 'fr'").select("id"))
    return delete_versions(versions, gone).select("id", "filename", "is_active")


@query(
    "c5_visible_datasets",
    """WITH own AS (SELECT c_nationkey AS user_id, c_custkey AS id FROM customer),
         line AS (SELECT 10000000 + o_orderkey AS derived_id, o_custkey AS l, o_custkey + 1 AS r FROM orders)
       SELECT DISTINCT user_id, id FROM (SELECT * FROM own UNION ALL SELECT user_id, derived_id FROM line JOIN own ON own.id = l OR own.id = r)""",
)
def c5_visible_datasets(spark, d):
    ownership = load_table(spark, d, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("id"))
    lineage = load_table(spark, d, "orders").select(
        (F.col("o_orderkey") + 10000000).alias("derived_id"), F.col("o_custkey").alias("left_id"), (F.col("o_custkey") + 1).alias("right_id")
    )
    datasets = ownership.select("id").unionAll(lineage.select("derived_id"))
    return visible_datasets(datasets, ownership, lineage).select("user_id", "id")


@query(
    "c5_narrowed",
    "SELECT c_nationkey AS user_id, c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)",
)
def c5_narrowed(spark, d):
    ownership = load_table(spark, d, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("id"))
    chosen = load_table(spark, d, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("id"))
    return narrowed(ownership, chosen.unionAll(chosen.select(F.col("id") + 1000000000)))


@query("c6_listing", "SELECT doc_id AS id, source AS name, doc_id AS created_at FROM documents")
def c6_listing(spark, d):
    docs = load_table(spark, d, "documents")
    return listing(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("doc_id").alias("created_at")))


@query("c6_library", f"WITH {_VERSIONS} SELECT user_id, filename, version FROM v WHERE is_active")
def c6_library(spark, d):
    return library(_versions(spark, d)).select("user_id", "filename", "version")


@query(
    "c7_sessions",
    "SELECT user_id, count(*) AS message_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity FROM events GROUP BY 1",
)
def c7_sessions(spark, d):
    sessions = session_list(load_table(spark, d, "events"), "user_id", "ts")
    return sessions.withColumn("last_activity", F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss"))


# --- column search ------------------------------------------------------------------

_KIND = "CASE WHEN p_size < 20 THEN 'numeric' WHEN p_size < 35 THEN 'categorical' WHEN p_size < 45 THEN 'date' ELSE 'identifier' END"


def _catalog(spark, d):
    """Part names as column names, brands as datasets."""
    parts = load_table(spark, d, "part").withColumn("kind", F.expr(_KIND))
    named = parts.groupBy(F.col("p_brand").alias("dataset_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("column_name"))
    return named.agg(F.min("p_partkey").alias("position"), F.min_by("kind", "p_partkey").alias("inferred_type"))


_CATALOG = f"""cat AS (SELECT p_brand AS dataset_id, replace(p_name, ' ', '_') AS column_name, min(p_partkey) AS position,
  arg_min({_KIND}, p_partkey) AS inferred_type FROM part GROUP BY 1, 2)"""


@query("x1_match_columns")
def x1_match_columns(spark, d):
    """Misspelt and partial phrases from the part names; checked by brute force in tests."""
    words = load_table(spark, d, "part").select("p_name", F.explode(F.split("p_name", " ")).alias("word"))
    twisted = words.select(F.concat(F.substring("word", 1, 1), F.substring("word", 3, 100), F.lit("s")).alias("concept"))
    phrases = words.select(F.concat(F.lit("average "), F.col("p_name")).alias("concept"))
    concepts = twisted.unionAll(phrases).distinct().withColumn("role", F.lit("dimension"))
    out = match_columns(concepts, _catalog(spark, d))
    return out.withColumn("alternatives", F.array_join("alternatives", ","))


# Matching blocks: the longest common run of letters of two parts (the earliest
# among equals, in b first), then the same on its left and on its right.
_SIMILAR = r"""WITH RECURSIVE words AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(p_name || '_' || p_type, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS b FROM part),
  twisted AS (SELECT DISTINCT reverse(substring(b, 1, 2)) || substring(b, 3) AS a FROM words),
  pairs AS (SELECT a, b FROM twisted, words WHERE a <> b AND 2.0 * least(length(a), length(b)) >= 0.72 * (length(a) + length(b))),
  spots AS (SELECT a, b, i, unnest(range(1, length(a) + 1)) AS j FROM (SELECT a, b, unnest(range(1, length(b) + 1)) AS i FROM pairs)),
  runs AS (SELECT * FROM (SELECT a, b, i, j, unnest(range(1, least(length(b) - i, length(a) - j) + 2)) AS k FROM spots) WHERE substring(b, i, k) = substring(a, j, k)),
  part_of(a, b, ilo, ihi, jlo, jhi, i, j, k) AS (
    SELECT a, b, 1, length(b) + 1, 1, length(a) + 1, best.i, best.j, best.k FROM (SELECT a, b, max_by({'i': i, 'j': j, 'k': k}, k * 10000 - i * 100 - j) AS best FROM runs GROUP BY a, b)
    UNION ALL
    SELECT a, b, ilo, ihi, jlo, jhi, best.i, best.j, best.k FROM (
      SELECT s.a, s.b, s.ilo, s.ihi, s.jlo, s.jhi, max_by({'i': r.i, 'j': r.j, 'k': r.k}, r.k * 10000 - r.i * 100 - r.j) AS best
      FROM (SELECT a, b, CASE side WHEN 0 THEN ilo ELSE i + k END AS ilo, CASE side WHEN 0 THEN i ELSE ihi END AS ihi,
              CASE side WHEN 0 THEN jlo ELSE j + k END AS jlo, CASE side WHEN 0 THEN j ELSE jhi END AS jhi FROM part_of, (VALUES (0), (1)) AS sides(side)) s
      JOIN runs r ON r.a = s.a AND r.b = s.b AND r.i >= s.ilo AND r.i + r.k <= s.ihi AND r.j >= s.jlo AND r.j + r.k <= s.jhi
      GROUP BY ALL))
  SELECT a, b FROM part_of GROUP BY a, b HAVING 2.0 * sum(k) / (length(a) + length(b)) >= 0.72"""


@query("x2_similar_words", _SIMILAR)
def x2_similar_words(spark, d):
    """Word pairs of similarity 0.72 or more among brand, type and part words."""
    parts = load_table(spark, d, "part")
    words = parts.select(F.explode(name_parts(F.concat_ws("_", "p_name", "p_type"))).alias("word")).distinct()
    twisted = words.select(F.concat(F.reverse(F.substring("word", 1, 2)), F.substring("word", 3, 100)).alias("word"))
    return fuzzy_pairs(twisted, words)


@query(
    "x3_role_bonus",
    f"""SELECT p_partkey, CAST(CASE WHEN k = 'numeric' THEN 15 WHEN k = 'identifier' THEN -50 ELSE -60 END AS DOUBLE) AS as_measure,
          CAST(CASE k WHEN 'identifier' THEN CASE WHEN p_brand = 'Brand#1' THEN 15 ELSE -10 END WHEN 'categorical' THEN 15 WHEN 'date' THEN -10 ELSE 0 END AS DOUBLE) AS as_dimension,
          CAST(CASE WHEN k = 'date' THEN 15 ELSE -50 END AS DOUBLE) AS as_date FROM (SELECT *, {_KIND} AS k FROM part)""",
)
def x3_role_bonus(spark, d):
    parts = load_table(spark, d, "part").withColumn("k", F.expr(_KIND))
    wants = F.col("p_brand") == "Brand#1"
    return parts.select(
        "p_partkey", *[role_bonus(F.col("k"), F.lit(r), wants).alias(f"as_{r}") for r in ("measure", "dimension", "date")]
    )


@query(
    "x4_exact_names",
    f"""WITH {_CATALOG} SELECT a.column_name AS concept, b.dataset_id, b.column_name, 100.0::DOUBLE AS confidence FROM (SELECT DISTINCT column_name FROM cat) a
        JOIN cat b ON a.column_name = b.column_name WHERE b.inferred_type = 'numeric'""",
)
def x4_exact_names(spark, d):
    """Exact names win outright, unless the type does not suit the role."""
    catalog = _catalog(spark, d)
    concepts = catalog.select(F.upper("column_name").alias("concept")).distinct().withColumn("role", F.lit("measure"))
    out = match_columns(concepts, catalog).filter("confidence = 100")
    return out.select(F.lower("concept").alias("concept"), "dataset_id", "column_name", "confidence")


@query(
    "x5_guards",
    """SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_name NOT LIKE '%ring%' WHEN p_size <= 20 THEN true ELSE false END AS left_out FROM part""",
)
def x5_guards(spark, d):
    """A "return" phrase only fits return columns, other phrases fit any."""
    size = F.col("p_size")
    phrase = F.when(size <= 10, "return rate").when(size <= 20, "marketing spend").when(size <= 30, "staff count").otherwise("rate")
    column = F.when(F.contains("p_name", F.lit("ring")), "returns_total").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return load_table(spark, d, "part").select("p_partkey", guarded_out(name_parts(phrase), name_parts(column)).alias("left_out"))


@query(
    "x6_match_names",
    """WITH l AS (SELECT source || '.xlsx' AS name, min('d' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS id FROM documents GROUP BY 1),
         r AS (SELECT DISTINCT upper(source) || ' ' AS ref, source || '.xlsx' AS name FROM documents)
       SELECT ref, id FROM r JOIN l USING (name) UNION ALL SELECT DISTINCT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') FROM labels
       UNION ALL SELECT 'nowhere', NULL""",
)
def x6_match_names(spark, d):
    docs = load_table(spark, d, "documents")
    number = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    names = docs.select(number.alias("id"), F.concat("source", F.lit(".xlsx")).alias("name"))
    refs = docs.select(F.concat(F.upper("source"), F.lit(" ")).alias("ref")).unionAll(load_table(spark, d, "labels").select(number))
    return match_names(refs.unionAll(spark.createDataFrame([("nowhere",)], "ref string")), names)

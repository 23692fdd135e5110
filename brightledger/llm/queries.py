"""The registered queries of this subpackage, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightledger.llm.class_lm import score_documents
from brightledger.llm.decontaminate import contamination
from brightledger.llm.fill_middle import fill_in_middle, restored
from brightledger.llm.manifest import fold, manifest, proof_digest, tampered_rows
from brightledger.llm.mixing import mix_copies
from brightledger.llm.near_dup import near_duplicates
from brightledger.llm.packing import pack
from brightledger.llm.quality import judge_quality
from brightledger.llm.quotes import link_quotes
from brightledger.llm.suffix_dedup import repeat_counts
from brightledger.llm.token_counts import count_tokens
from brightledger.llm.url_filter import judge_urls
from brightledger.llm.warc_zip import read_archives, write_archives
from brightledger.session import load_table, small_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, d):
    """Bytes of every document in 100-byte strings that start earlier, too."""
    return repeat_counts(load_table(spark, d, "documents"))


@query("op2_decontamination")
def op2_decontamination(spark, d):
    """Words of every document in ten-word windows of benchmark items."""
    return contamination(load_table(spark, d, "documents"), load_table(spark, d, "benchmark"))


_ARCHIVE_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
  hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p),
  bits AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: lpad(bin(CAST('0x' || hex[i + 1] AS INTEGER)), 4, '0')), 'string_agg', '') AS b FROM hashed)
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda k: CASE WHEN b[5 * i + k + 1] = '1' THEN 16 >> k ELSE 0 END)) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM bits"""


@query("op3_warc", _ARCHIVE_SQL)
def op3_warc(spark, d):
    """Archives of all pages, written and read back by ranges."""
    records = read_archives(write_archives(load_table(spark, d, "pages"), min_payload=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_packing")
def op4_packing(spark, d):
    """Pieces of all documents in sequences of 2048 ids."""
    return pack(load_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_quality")
def op5_quality(spark, d):
    """Base counts and verdict of every document."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"]
    return judge_quality(load_table(spark, d, "documents")).select(*columns)


@query("op6_class_lm")
def op6_class_lm(spark, d):
    """Scores of all documents by a class model of those not held out."""
    return score_documents(load_table(spark, d, "documents"))


#: Rules of the URL query: host, path, action (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_URL_SQL = r"""WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
  cut AS (SELECT page_id, u, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(u, '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS query FROM u),
  rules(rule, rhost, rpath, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
  named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:80|:443)?$', '') || CASE WHEN path = '' THEN '/' ELSE path END || query AS canonical,
    (SELECT max_by({'rule': rule, 'action': action}, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM cut),
  bad AS (SELECT DISTINCT canonical FROM named WHERE best.action = 'block')
  SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, CASE WHEN host <> '' AND bad.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
  FROM named LEFT JOIN bad USING (canonical)"""


@query("op7_url_filter", _URL_SQL)
def op7_url_filter(spark, d):
    """Rule and verdict of every page's url."""
    rules = small_frame(spark, URL_RULES, "host string, path string, action string")
    return judge_urls(load_table(spark, d, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op9_token_counts")
def op9_token_counts(spark, d):
    """Tokens of every document by a unigram vocabulary."""
    return count_tokens(load_table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_near_duplicates")
def op10_near_duplicates(spark, d):
    """Component of every document by its four-word shingles."""
    return near_duplicates(load_table(spark, d, "documents"), size=4)


_MAIL_SQL = r"""WITH c AS (SELECT conv_id, turn, role, text, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) AS norm FROM conversations),
  o AS (SELECT conv_id, norm, min(turn) AS original FROM c GROUP BY ALL),
  p AS (SELECT c.*, o.original AS parent_turn FROM c LEFT JOIN c AS q ON q.conv_id = c.conv_id AND q.turn = c.turn - CASE WHEN c.turn % 3 = 0 THEN 3 ELSE 1 END
        LEFT JOIN o ON o.conv_id = q.conv_id AND o.norm = q.norm AND o.original < c.turn)
  SELECT conv_id, turn, role, text, parent_turn FROM p"""


@query("op8_quotation_links", _MAIL_SQL)
def op8_quotation_links(spark, d):
    """Conversations as mail (each message quotes the one it answers, and what
    that one quotes) and back: texts without quotes, and what each answers."""
    turns = load_table(spark, d, "conversations")
    step = F.when(F.col("turn") % 3 == 0, 3).otherwise(1)
    said = turns.select("conv_id", F.col("turn").alias("before"), F.col("text").alias("quoted"))
    mail = turns.withColumn("before", F.col("turn") - step).join(said, ["conv_id", "before"], "left")
    above = said.select("conv_id", F.col("before").alias("earlier"), F.col("quoted").alias("deeper"))
    earlier = F.col("before") - F.when(F.col("before") % 3 == 0, 3).otherwise(1)
    mail = mail.withColumn("earlier", earlier).join(above, ["conv_id", "earlier"], "left")
    quote = lambda c, mark: F.when(F.col(c).isNotNull(), F.concat(F.regexp_replace(c, "(?m)^", mark), F.lit("\n"))).otherwise("")
    mail = mail.select("conv_id", "turn", "role", F.concat(quote("deeper", ">> "), quote("quoted", "> "), F.col("text")).alias("text"))
    return link_quotes(mail).select("conv_id", "turn", "role", "text", "parent_turn")


def _digest_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(parts)})"


#: crc32 of a text's bytes, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce([4294967295] || list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

_MANIFEST_SQL = f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_digest_sql("text")} AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_digest_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_digest_sql("text")} END AS shown FROM documents),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
  nodes(tree, lvl, place, digest, n) AS (SELECT tree, 0, place, leaf, n FROM placed
    UNION ALL SELECT tree, lvl + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, lvl, place // 8, n),
  subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
  tops(lvl, place, digest, n) AS (SELECT 0, place, subroot, n FROM subroots
    UNION ALL SELECT lvl + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY lvl, place // 8, n),
  runs AS (SELECT tree, lvl, place // 8 AS run, list(digest ORDER BY place) AS d FROM nodes WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT NULL, lvl, place // 8, list(digest ORDER BY place) FROM tops WHERE n > 1 GROUP BY ALL),
  cut AS (SELECT p.tree, p.place, r.lvl, r.d, (p.place >> (3 * r.lvl)) % 8 AS own FROM placed AS p JOIN runs AS r ON r.tree = p.tree AND r.run = p.place >> (3 * r.lvl + 3)
    UNION ALL SELECT p.tree, p.place, 100 + r.lvl, r.d, (s.place >> (3 * r.lvl)) % 8 FROM placed AS p JOIN subroots AS s USING (tree) JOIN runs AS r ON r.tree IS NULL AND r.run = s.place >> (3 * r.lvl + 3)),
  steps AS (SELECT tree, place, row_number() OVER (PARTITION BY tree, place ORDER BY lvl) AS step, array_to_string(d[1:own], '') AS l, array_to_string(d[own + 2:], '') AS r FROM cut),
  proofs AS (SELECT tree, place, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, max(step) AS height FROM steps GROUP BY ALL),
  folded(tree, place, step, node) AS (SELECT tree, place, 0, shown FROM placed
    UNION ALL SELECT f.tree, f.place, CAST(f.step + 1 AS INTEGER), sha256(s.l || f.node || s.r) FROM folded AS f JOIN steps AS s ON s.tree = f.tree AND s.place = f.place AND s.step = f.step + 1)
  SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
  FROM placed JOIN subroots USING (tree) CROSS JOIN (SELECT digest AS root FROM tops WHERE n = 1) LEFT JOIN proofs ON proofs.tree = placed.tree AND proofs.place = placed.place
  JOIN folded ON folded.tree = placed.tree AND folded.place = placed.place AND folded.step = coalesce(height, 0)"""


@query("op11_merkle_manifest", _MANIFEST_SQL)
def op11_merkle_manifest(spark, d):
    """Leaf, roots and proof of every document, and what a tampered leaf folds to."""
    docs = load_table(spark, d, "documents")
    proved = manifest(docs, shown=tampered_rows(docs))
    proved = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("shown"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


_MIDDLE_SQL = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
  drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
  formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
  pieces AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM formed)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM pieces"""


@query("op12_fill_middle", _MIDDLE_SQL)
def op12_fill_middle(spark, d):
    """Every document with a middle to fill in, and the text it is rebuilt to."""
    made = fill_in_middle(load_table(spark, d, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_MIX_SQL = r"""WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
  s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
  w AS (SELECT *, CASE (row_number() OVER (ORDER BY key)) % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
  o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, key) AS nth FROM w),
  l AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - 2 * CAST(coalesce(sum(source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
  t AS (SELECT key, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(level, nth) FROM l WHERE level * weight <= 2 * source_size)) AS target FROM l),
  e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS copies FROM t),
  p AS (SELECT *, CAST(floor(copies) AS BIGINT) AS whole, CAST(floor((copies - floor(copies)) * 1073741824 + 0.5) AS BIGINT) AS part, CAST('0x' || sha256('42:' || key)[1:8] AS BIGINT) % 1073741824 AS start FROM e),
  r AS (SELECT doc_id, size, p.*, (start + (row_number() OVER (PARTITION BY d.key ORDER BY size, doc_id NULLS FIRST) - 1) * part) % 1073741824 AS reached FROM d JOIN p ON p.key = d.key)
  SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN reached + part >= 1073741824 THEN 1 ELSE 0 END) AS taken FROM r"""


@query("op13_mix_sources", _MIX_SQL)
def op13_mix_sources(spark, d):
    """Words that a mix of all sources takes of every document."""
    return mix_copies(load_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")

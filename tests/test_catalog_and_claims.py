import difflib
import random

import pytest
from pyspark.sql import functions as F

from brightledger.operators.catalog import SYNONYMS, fuzzy_pairs, match_columns, match_names
from brightledger.operators.verify import (
    extract_numbers,
    number_support,
    relabel_cited,
    verify_claims,
    verify_comparisons,
    verify_grounding,
)
from brightledger.operators.versions import (
    activate_versions,
    add_versions,
    check_duplicates,
    delete_versions,
    listing,
    narrowed,
    recent_turns,
    session_list,
    visible_datasets,
)
from tests.conftest import as_dicts

SALES = [("product_id", "identifier"), ("product_name", "categorical"), ("sales_amount", "numeric"), ("region", "categorical"), ("order_date", "date")]


def resolve(spark, columns, concept, role="any"):
    catalog = spark.createDataFrame([("d", i, n, k) for i, (n, k) in enumerate(columns)], "dataset_id string, position int, column_name string, inferred_type string")
    return match_columns(spark.createDataFrame([(concept, role)], "concept string, role string"), catalog).first()


def resolve_all(spark, columns, concepts):
    catalog = spark.createDataFrame([("d", i, n, k) for i, (n, k) in enumerate(columns)], "dataset_id string, position int, column_name string, inferred_type string")
    asked = spark.createDataFrame(concepts, "concept string, role string")
    return {(r["concept"], r["role"]): r for r in match_columns(asked, catalog).collect()}


def test_resolution(spark):
    expected = {
        ("product", "dimension"): "product_name",
        ("product name", "dimension"): "product_name",
        ("product-name", "dimension"): "product_name",
        ("ProductName", "dimension"): "product_name",
        ("productname", "dimension"): "product_name",
        ("PRODUCT NAME", "dimension"): "product_name",
        ("prodcut", "dimension"): "product_name",
        ("prduct name", "dimension"): "product_name",
        ("product id", "dimension"): "product_id",
        ("product", "measure"): None,
        ("sales", "measure"): "sales_amount",
        ("revenue", "measure"): "sales_amount",
        ("average sales", "measure"): "sales_amount",
        ("Region", "dimension"): "region",
        ("territory", "dimension"): "region",
        ("region", "measure"): None,
        ("order date", "date"): "order_date",
        ("zorblaxian quantum flux", "dimension"): None,
        ("return rate", "any"): None,
        ("xyz", "any"): None,
        ("total", "measure"): None,
    }
    found = resolve_all(spark, SALES, list(expected))
    assert {key: row["column_name"] for key, row in found.items()} == expected
    assert all(row["resolved"] == (row["column_name"] is not None) for row in found.values())


def test_phrases_of_other_domains_stay_unresolved(spark):
    columns = [("order_id", "identifier"), ("price", "numeric"), ("late_delivery_risk", "numeric"), ("department", "categorical"), ("rating", "numeric")]
    phrases = [
        "marketing ROI", "campaign adspend", "stockout rate", "excess inventory", "delivery partner rating", "employee revenue",
        "employee profitability", "target attainment", "return rate",
    ]
    found = resolve_all(spark, columns, [(p, "measure") for p in phrases])
    assert len(found) == len(phrases) and not any(row["resolved"] for row in found.values())


def test_short_name_is_not_lost_in_a_long_one(spark):
    columns = [("product_price_history_id", "identifier"), ("price", "numeric")]
    assert resolve(spark, columns, "price", "measure")["column_name"] == "price"
    names = [("customer_id", "identifier"), ("amount", "numeric")]
    found = resolve_all(spark, names, [(c, "dimension") for c in ("customer id", "customer-id", "CustomerID", "customerid")])
    assert {row["column_name"] for row in found.values()} == {"customer_id"}


def test_exact_name_has_full_confidence(spark):
    assert resolve(spark, SALES, " SALES_AMOUNT ", "measure")["confidence"] == 100.0


def test_alternatives_and_hints(spark):
    row = resolve(spark, SALES, "product", "dimension")
    assert row["confidence"] == 85.0 and row["alternatives"] == ["product_id"]
    low = resolve(spark, [("sales_channel", "categorical")], "sales agent name")
    assert not low["resolved"] and low["alternatives"] == ["sales_channel"]


def test_full_identifier_match_beats_half_category_match(spark):
    columns = [("Sales_Channel", "categorical"), ("Sales_Agent_ID", "identifier")]
    assert resolve(spark, columns, "sales agent", "dimension")["column_name"] == "Sales_Agent_ID"


def test_literal_word_beats_synonym(spark):
    columns = [("Gross_Sales_NGN", "numeric"), ("Realized_Revenue_NGN", "numeric")]
    assert resolve(spark, columns, "revenue", "measure")["column_name"] == "Realized_Revenue_NGN"


def test_fuzzy_pairs_lose_nothing(spark):
    rng = random.Random(11)
    base = [w for group in SYNONYMS for w in group] + ["aa", "a", "mississippi", "date", "late", "rate", "customername", "prodcut"]

    def twist(word):
        letters = list(word)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(letters))
            choice = rng.random()
            if choice < 0.4:
                letters[i] = rng.choice("abcdeilmnorst")
            elif choice < 0.7:
                letters.insert(i, rng.choice("aeiost"))
            elif len(letters) > 1:
                letters.pop(i)
        return "".join(letters)

    asked = sorted({twist(w) for w in base for _ in range(4)})
    words = sorted(set(base))
    expected = {
        (a, b) for a in asked for b in words if a != b and difflib.SequenceMatcher(None, b, a).ratio() >= 0.72
    }
    left = spark.createDataFrame([(a,) for a in asked], "word string")
    right = spark.createDataFrame([(b,) for b in words], "word string")
    assert {tuple(r) for r in fuzzy_pairs(left, right).collect()} == expected and len(expected) > 50


def test_name_matching(spark):
    names = spark.createDataFrame([("d1", "Orders.csv"), ("d2", "people"), ("d3", "orders.xlsx")], "id string, name string")
    refs = spark.createDataFrame([("orders",), ("ORDERS.CSV ",), ("d2",), ("People.xlsx",), ("none",)], "ref string")
    assert {r["ref"]: r["id"] for r in as_dicts(match_names(refs, names))} == {
        "orders": "d1", "ORDERS.CSV ": "d1", "d2": "d2", "People.xlsx": "d2", "none": None,
    }


# --- versions and sessions -----------------------------------------------------------------

VERSION = "id string, user_id string, filename string, content_hash string, version int, is_active boolean, created_at int"
UPLOAD = "id string, user_id string, filename string, content_hash string, created_at int"


@pytest.fixture(scope="module")
def versions(spark):
    rows = [("a", "u", "f", "h1", 1, False, 1), ("b", "u", "f", "h2", 2, True, 2), ("x", "w", "f", "h2", 1, True, 1)]
    return spark.createDataFrame(rows, VERSION)


def active(df):
    return {r["id"] for r in as_dicts(df) if r["is_active"]}


def test_duplicate_check(spark, versions):
    rows = [("u", "f", "h2"), ("u", "f", "h1"), ("u", "g", "h2")]
    incoming = spark.createDataFrame(rows, "user_id string, filename string, content_hash string")
    got = {(r["filename"], r["content_hash"]): (r["status"], r["existing_id"], r["next_version"]) for r in as_dicts(check_duplicates(incoming, versions))}
    assert got == {("f", "h2"): ("exact_duplicate", "b", None), ("f", "h1"): ("changed_version", "b", 3), ("g", "h2"): ("new", None, None)}


def test_new_version_replaces_active_one(spark, versions):
    out = add_versions(versions, spark.createDataFrame([("c", "u", "f", "h3", 3), ("n", "u", "g", "h", 3)], UPLOAD))
    assert active(out) == {"c", "n", "x"} and {r["id"]: r["version"] for r in as_dicts(out)}["c"] == 3
    same = spark.createDataFrame([("c", "u", "f", "h2", 3)], UPLOAD)
    assert add_versions(versions, same).count() == 3
    assert active(add_versions(versions, same, force=True)) == {"c", "x"}


def test_activate_and_delete(spark, versions):
    assert active(activate_versions(versions, spark.createDataFrame([("u", "a")], "user_id string, id string"))) == {"a", "x"}
    assert active(activate_versions(versions, spark.createDataFrame([("w", "a")], "user_id string, id string"))) == {"b", "x"}
    assert active(delete_versions(versions, spark.createDataFrame([("b",)], "id string"))) == {"a", "x"}
    assert active(delete_versions(versions, spark.createDataFrame([("a",)], "id string"))) == {"b", "x"}


def test_ownership(spark):
    datasets = spark.createDataFrame([("d1", 2), ("d2", 1), ("j", 3), ("k", 4)], "id string, created_at int")
    own = spark.createDataFrame([("u", "d1"), ("w", "d2")], "user_id string, id string")
    lineage = spark.createDataFrame([("j", "d1", "d9"), ("k", "d9", "d2")], "derived_id string, left_id string, right_id string")
    assert {(r["user_id"], r["id"]) for r in as_dicts(visible_datasets(datasets, own))} == {("u", "d1"), ("w", "d2")}
    assert {(r["user_id"], r["id"]) for r in as_dicts(visible_datasets(datasets, own, lineage))} == {("u", "d1"), ("w", "d2"), ("u", "j"), ("w", "k")}
    chosen = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "id string")
    assert narrowed(own.filter("user_id = 'u'"), chosen).count() == 1  # never more than owned
    assert [r["id"] for r in listing(datasets).collect()] == ["d2", "d1", "j", "k"]


def test_sessions(spark):
    turns = spark.createDataFrame([("s", i) for i in range(10)] + [("t", 50)], "session string, turn int")
    assert sorted(r["turn"] for r in recent_turns(turns, "session", "turn").collect() if r["session"] == "s") == [4, 5, 6, 7, 8, 9]
    assert [(r["session"], r["message_count"]) for r in session_list(turns, "session", "turn").collect()] == [("t", 1), ("s", 10)]


# --- claims ---------------------------------------------------------------------------------


def numbers(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(extract_numbers(F.col("t")).alias("x")).first()["x"]


def test_numbers_in_text(spark):
    assert numbers(spark, "Revenue fell 14.2% to $1,234.56") == [14.2, 1234.56]
    assert numbers(spark, "Q2 and H1, but -5 and 7.") == [-5.0, 7.0]
    assert numbers(spark, "none") == []


CLAIM = "claim_id int, session_id int, text string, label string"
EVIDENCE = "session_id int, tool string, succeeded boolean, output string"


def test_labels_only_fall(spark):
    claims = spark.createDataFrame(
        [
            (1, 1, "Revenue fell 14.2%.", "CALCULATED"), (2, 1, "It is 99", "VERIFIED_FROM_DATA"), (3, 1, "no number", "DERIVED"),
            (4, 1, "It is 99", "AI_INTERPRETATION"), (5, 2, "It is 14", "CALCULATED"), (6, 1, "88 failed", "CALCULATED"),
        ],
        CLAIM,
    )
    evidence = spark.createDataFrame(
        [(1, "compare_periods", True, '{"percentage_change": -14.2}'), (1, "search_documents", True, "99"), (1, "correlate", False, "88")], EVIDENCE
    )
    got = {r["claim_id"]: r["final_label"] for r in as_dicts(verify_claims(claims, evidence))}
    assert got == {1: "CALCULATED", 2: "AI_INTERPRETATION", 3: "DERIVED", 4: "AI_INTERPRETATION", 5: "AI_INTERPRETATION", 6: "AI_INTERPRETATION"}


def test_number_support_against_brute_force(spark):
    rng = random.Random(2)

    def number():
        return round(rng.choice([rng.uniform(0, 2), rng.uniform(0, 60), rng.uniform(0, 5000), rng.uniform(0, 1e9)]) * rng.choice([1, -1]), 2)

    pool = {s: [number() for _ in range(40)] for s in range(3)}
    asked = []
    for i in range(600):
        s = rng.randrange(4)
        near = rng.choice(pool.get(s, [0.0]))
        n = number() if rng.random() < 0.4 else round(near * rng.uniform(0.96, 1.04) + rng.uniform(-0.7, 0.7), 2)
        asked.append((i, s, n))
    claims = spark.createDataFrame([(i, s, f"value {n:.2f} here", "CALCULATED") for i, s, n in asked], CLAIM)
    evidence = spark.createDataFrame([(s, "m", True, f"[{v:.2f}]") for s, vs in pool.items() for v in vs], EVIDENCE)
    got = {r["claim_id"]: r["supported"] for r in as_dicts(number_support(claims, evidence))}
    for i, s, n in asked:
        expected = any(abs(abs(n) - abs(v)) <= max(0.5, abs(n) * 0.02) for v in pool.get(s, []))
        assert got[i] == expected, (n, expected)
    assert 100 < sum(got.values()) < 500


def test_grounding(spark):
    claims = spark.createDataFrame(
        [(1, 1, "Retrieval improves answer quality", "x"), (2, 1, "Retrieval only", "x"), (3, 1, "a bc", "x"), (4, 1, "Totally different words", "x"), (5, 1, "Uncited claim text", "x")], CLAIM
    )
    cited = spark.createDataFrame([(1, "QUALITY of the answer improves"), (1, "zzz"), (2, "only retrieval"), (3, "anything"), (4, "nope")], "claim_id int, excerpt string")
    got = {r["claim_id"]: (r["cited"], r["grounded"]) for r in as_dicts(verify_grounding(claims, cited))}
    assert got == {1: (True, True), 2: (True, True), 3: (True, True), 4: (True, False), 5: (False, False)}


def test_comparisons(spark):
    rows = [(1, 1, "total 100", "SUPPORTED_BY_DATA"), (2, 1, "total 300", "SUPPORTED_BY_DATA"), (3, 1, None, "CONTRADICTED_BY_DATA"), (4, 1, "total 100", "SUPPORTED_BY_DATA"), (5, 1, None, "DOCUMENT_CLAIM")]
    comparisons = spark.createDataFrame(rows, "claim_id int, session_id int, data_finding string, label string")
    evidence = spark.createDataFrame([(1, "calculate_metric", True, "101")], EVIDENCE)
    cited = spark.createDataFrame([(i, "e") for i in (1, 2, 3)], "claim_id int, excerpt string")
    got = {r["claim_id"]: r["final_label"] for r in as_dicts(verify_comparisons(comparisons, evidence, cited))}
    none = "INSUFFICIENT_EVIDENCE"
    assert got == {1: "SUPPORTED_BY_DATA", 2: none, 3: none, 4: none, 5: "DOCUMENT_CLAIM"}


def test_relabelling(spark):
    words = "Retrieval improves answer quality"
    claims = spark.createDataFrame(
        [(1, 1, words, "CALCULATED"), (2, 1, words, "VERIFIED_FROM_DATA"), (3, 1, words, "DOCUMENT_EVIDENCE"), (4, 1, "It is 7", "CALCULATED"), (5, 1, words, "CALCULATED"), (6, 1, "It is 900", "CALCULATED")], CLAIM
    )
    cited = spark.createDataFrame([(1, words, "document"), (2, "other", "document"), (5, words, "web")], "claim_id int, excerpt string, source_type string")
    evidence = spark.createDataFrame([(1, "m", True, "7")], EVIDENCE)
    got = {r["claim_id"]: (r["final_label"], r["keeps_citations"]) for r in as_dicts(relabel_cited(claims, cited, evidence))}
    low = ("AI_INTERPRETATION", False)
    assert got == {1: ("DOCUMENT_EVIDENCE", True), 2: low, 3: low, 4: ("CALCULATED", False), 5: ("VERIFIED_FROM_WEB", True), 6: low}

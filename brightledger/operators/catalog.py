"""Finding columns and tables of a catalog by phrase."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import ID_WORDS, name_parts
from brightledger.session import small_frame

# Words treated as the same concept.
SYNONYMS = [
    ["sales", "sale", "revenue", "income", "turnover"],
    ["cost", "expense", "expenses", "spend", "spending"],
    ["quantity", "qty", "units", "unit", "volume"],
    ["product", "item", "sku"],
    ["customer", "client", "account"],
    ["region", "territory", "area", "zone"],
    ["category", "group", "class", "segment"],
    ["profit", "margin", "earnings"],
    ["discount", "markdown"],
]

# Words that name the operation, not the column.
OPERATION_WORDS = [
    "total", "sum", "average", "avg", "mean", "minimum", "min", "maximum", "max", "median", "count", "distinct",
]

# A phrase with any word of every trigger list only matches
# columns with one of the required words.
GUARDS = [
    ([["return"]], ["return", "returns", "refund", "refunded"]),
    ([["marketing", "roi", "campaign", "adspend"]], ["marketing", "roi", "campaign", "adspend", "ad_spend", "promotion", "promotions"]),
    ([["stockout", "inventory", "backorder"]], ["stock", "stockout", "inventory", "warehouse", "backorder"]),
    ([["partner", "carrier", "courier"]], ["partner", "carrier", "courier", "transporter"]),
    ([["employee", "staff"], ["revenue", "profit", "profitability", "sales"]], ["employee", "staff", "rep", "agent", "seller"]),
    ([["target", "attainment", "quota"]], ["target", "attainment", "quota", "goal"]),
]

EXACT, SYNONYM, FUZZY = 1.0, 0.85, 0.7
# Letters from rare to frequent in English names, the order of the blocking keys.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"
FUZZY_FLOOR = 0.72
ACCEPT_SCORE = 35.0
HINT_SCORE = 1.0
TOKEN_POINTS = 70.0


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def concept_words(phrase: Column) -> Column:
    return F.array_distinct(F.array_except(name_parts(phrase), _words(OPERATION_WORDS)))


def role_bonus(kind: Column, role: Column, wants_id: Column) -> Column:
    """How well a column type suits the wanted role."""
    measure = F.when(kind == "numeric", 15.0).when(kind == "identifier", -50.0).otherwise(-60.0)
    dimension = (
        F.when(kind == "identifier", F.when(wants_id, 15.0).otherwise(-10.0))
        .when(kind.isin("categorical", "text", "boolean"), 15.0)
        .when(kind == "date", -10.0)
        .otherwise(0.0)
    )
    day = F.when(kind == "date", 15.0).otherwise(-50.0)
    return F.when(role == "measure", measure).when(role == "dimension", dimension).when(role == "date", day).otherwise(0.0)


def guarded_out(concept: Column, column: Column) -> Column:
    """The phrase names a domain the column does not belong to."""
    out = F.lit(False)
    for triggers, required in GUARDS:
        asked = F.lit(True)
        for trigger in triggers:
            asked = asked & F.arrays_overlap(concept, _words(trigger))
        out = out | (asked & ~F.arrays_overlap(column, _words(required)))
    return out


# --- word pairs ---------------------------------------------------------------


def _letter_keys(words: DataFrame, own: str) -> DataFrame:
    """Blocking keys that lose no pair above the fuzzy floor.

    Two words of lengths m and n can only reach the floor when they share
    t = ceil(floor * (m + n) / 2) letters. Sorted by one fixed letter order, rare letters first,
    the first m - t + 1 letters of one and n - t + 1 of the other must then
    have a letter in common (prefix filter), for each possible pair of lengths.
    """
    low, high = FUZZY_FLOOR / (2 - FUZZY_FLOOR), (2 - FUZZY_FLOOR) / FUZZY_FLOOR
    length = F.length("word")
    # Each letter numbered by occurrence, so repeats count; another letter in its
    # place gives the order.
    ordered = F.translate("word", RARE_FIRST, "".join(sorted(RARE_FIRST)))
    letters = F.array_sort(F.filter(F.split(ordered, ""), lambda x: x != ""))
    numbered = F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x)).cast("string")))
    others = F.sequence(F.ceil(length * low).cast("int"), F.floor(length * high).cast("int"))
    spread = words.select("word", length.alias("len"), numbered.alias("letters"), F.explode(others).alias("other"))
    shared = F.ceil((F.col("len") + F.col("other")) * (FUZZY_FLOOR / 2) - 1e-9).cast("int")
    prefix = F.slice("letters", F.lit(1), F.greatest(F.col("len") - shared + 1, F.lit(1)))
    mine = F.col("len").alias("a_len" if own == "a" else "b_len")
    theirs = F.col("other").alias("b_len" if own == "a" else "a_len")
    return spread.select(F.col("word").alias(own), mine, theirs, F.explode(F.array_distinct(prefix)).alias("letter"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two words."""
    return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype="float64")


def fuzzy_pairs(concept_tokens: DataFrame, column_tokens: DataFrame) -> DataFrame:
    """(a, b) word pairs of similarity 0.72 or more; distinct words only,
    candidates from an equi-join on the blocking keys."""
    left, right = _letter_keys(concept_tokens, "a"), _letter_keys(column_tokens, "b")
    candidates = left.join(right, ["a_len", "b_len", "letter"]).select("a", "b").distinct().filter("a <> b")
    return candidates.filter(similarity("a", "b") >= FUZZY_FLOOR)


def word_matches(concept_tokens: DataFrame, column_tokens: DataFrame) -> DataFrame:
    """(a, b, weight): the same word 1, a synonym 0.85, a near spelling 0.7."""
    spark = concept_tokens.sparkSession
    groups = small_frame(spark, [(w, i) for i, ws in enumerate(SYNONYMS) for w in ws], "word string, grp int")
    same = concept_tokens.join(column_tokens, "word").select(F.col("word").alias("a"), F.col("word").alias("b"), F.lit(EXACT).alias("weight"))
    left = concept_tokens.join(F.broadcast(groups), "word").select(F.col("word").alias("a"), "grp")
    right = column_tokens.join(F.broadcast(groups), "word").select(F.col("word").alias("b"), "grp")
    kin = left.join(right, "grp").select("a", "b", F.lit(SYNONYM).alias("weight"))
    near = fuzzy_pairs(concept_tokens, column_tokens).select("a", "b", F.lit(FUZZY).alias("weight"))
    return same.unionAll(kin).unionAll(near).groupBy("a", "b").agg(F.max("weight").alias("weight"))


# --- columns ---------------------------------------------------------------------


def match_columns(concepts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per concept and dataset the best column.

    concepts: concept, role (measure, dimension, date, any).
    catalog: dataset_id, position, column_name, inferred_type.
    Only concept and column pairs with a matching word are ever formed.
    """
    asked = concepts.select("concept", "role").distinct().withColumn("wanted", F.trim("concept"))
    asked = asked.filter("wanted <> ''").withColumns(
        {
            "concept_words": concept_words(F.col("concept")),
            "wants_id": F.arrays_overlap(name_parts(F.col("concept")), _words(ID_WORDS)),
        }
    )
    columns = catalog.select("dataset_id", "position", "column_name", "inferred_type").withColumn(
        "column_words", F.array_distinct(name_parts(F.col("column_name")))
    )
    scored = _scores(asked, columns)
    by_name = (
        asked.join(columns, F.lower("wanted") == F.lower("column_name"))
        .groupBy("concept", "role", "dataset_id")
        .agg(F.min_by(F.struct("column_name", "inferred_type"), "position").alias("hit"))
    )
    fits = (
        F.when(F.col("role") == "measure", F.col("hit.inferred_type") == "numeric")
        .when(F.col("role") == "date", F.col("hit.inferred_type") == "date")
        .otherwise(True)
    )
    exact = by_name.filter(fits).select("concept", "role", "dataset_id", F.col("hit.column_name").alias("exact_name"))
    key = ["concept", "role", "dataset_id"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "position"))
    top = scored.withColumn("rank", rank).filter("rank <= 3").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "column_name", "score"))).alias("top")
    )
    # A phrase no column answers keeps one row, without a dataset.
    best = asked.select("concept", "role").join(top.join(exact, key, "full"), ["concept", "role"], "left")
    accepted = F.col("top")[0]["score"] >= ACCEPT_SCORE
    useful = F.filter("top", lambda t: t["score"] >= HINT_SCORE)
    resolved = F.col("exact_name").isNotNull() | F.coalesce(accepted, F.lit(False))
    none = F.array().cast("array<string>")
    return best.select(
        *key,
        F.when(F.col("exact_name").isNotNull(), F.col("exact_name")).when(accepted, F.col("top")[0]["column_name"]).alias("column_name"),
        resolved.alias("resolved"),
        F.when(F.col("exact_name").isNotNull(), 100.0)
        .when(accepted, F.round(F.least(F.col("top")[0]["score"], F.lit(99.0)), 1))
        .otherwise(0.0)
        .alias("confidence"),
        F.when(F.col("exact_name").isNotNull() | F.col("top").isNull(), none)
        .when(accepted, F.transform(F.filter(F.slice("top", 2, 2), lambda t: t["score"] >= HINT_SCORE), lambda t: t["column_name"]))
        .otherwise(F.transform(useful, lambda t: t["column_name"]))
        .alias("alternatives"),
    )


def _scores(asked: DataFrame, columns: DataFrame) -> DataFrame:
    """70 points times the mean word weight, plus the role bonus."""
    concept_side = asked.select("concept", F.explode("concept_words").alias("word")).distinct()
    column_side = columns.select("dataset_id", "column_name", F.explode("column_words").alias("word"))
    pairs = word_matches(concept_side.select("word").distinct(), column_side.select("word").distinct())
    best_word = (
        concept_side.join(pairs, F.col("word") == F.col("a"))
        .select("concept", "a", "b", "weight")
        .join(column_side, F.col("b") == F.col("word"))
        .groupBy("concept", "dataset_id", "column_name", "a")
        .agg(F.max("weight").alias("weight"))
    )
    total = best_word.groupBy("concept", "dataset_id", "column_name").agg(F.sum("weight").alias("weight"))
    joined = total.join(asked, "concept").join(columns, ["dataset_id", "column_name"])
    score = F.col("weight") / F.size("concept_words") * TOKEN_POINTS + role_bonus(
        F.col("inferred_type"), F.col("role"), F.col("wants_id")
    )
    return joined.filter(~guarded_out(F.col("concept_words"), F.col("column_words"))).select(
        "concept", "role", "dataset_id", "column_name", "position", score.alias("score")
    )


def match_names(references: DataFrame, listing: DataFrame) -> DataFrame:
    """References (ref) to listing (id, name): by id, else by name without
    case or extension; the first listed wins."""

    def stem(text: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(text)), r"\.[^.]*$", "")

    by_id = references.join(listing.select(F.col("id").alias("ref")).distinct(), "ref").select("ref", F.col("ref").alias("id_match"))
    names = listing.groupBy(stem(F.col("name")).alias("stem")).agg(F.min("id").alias("name_match"))
    return (
        references.select("ref").distinct()
        .withColumn("stem", stem(F.col("ref")))
        .join(names, "stem", "left")
        .join(by_id.distinct(), "ref", "left")
        .select("ref", F.coalesce("id_match", "name_match").alias("id"))
    )

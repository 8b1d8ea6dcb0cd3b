"""From raw review text to structured, standardised documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested


def extracted(reviews: DataFrame, terms: list[str], severities: list[str], keep_failed: bool = True) -> DataFrame:
    """reviews with info, the rule-based document of textual_review.

    Side effects are the terms that stand in the text as words, a severity word right before one is its severity, and a dosage is a
    number with mg. Without a brand info is null: the row passes, or goes where keep_failed is off. An extractor of another kind only has to give the same struct.
    """
    text = F.lower(F.coalesce("textual_review", F.lit("")))
    null = F.lit(None).cast("string")
    before = rf"\b({'|'.join(severities)})\s+"
    found = F.filter(F.array(*(F.struct(F.array(F.lit(t)).alias("name"), F.nullif(F.regexp_extract(text, rf"{before}{t}\b", 1), F.lit("")).alias("severity"), null.alias("associated_drug"), text.rlike(rf"\b{t}\b").alias("hit")) for t in terms)), lambda e: e["hit"])
    effects = F.transform(found, lambda e: F.struct(e["name"].alias("name"), e["severity"].alias("severity"), e["associated_drug"].alias("associated_drug")))
    dosage = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?\s*mg)\b", 1), F.lit(""))
    drug = F.struct(F.col("brand_name").alias("name"), dosage.alias("dosage"), null.alias("dosage_form"), null.alias("duration"), null.alias("continued_use"), null.alias("alternative_drug_considered"))
    condition = F.struct(F.col("condition").alias("name"), null.alias("severity"))
    info = F.struct(drug.alias("drug"), condition.alias("condition"), effects.alias("side_effects"))
    out = reviews.withColumn("info", F.when(F.coalesce(F.col("brand_name"), F.lit("")) != "", info))
    return out if keep_failed else out.where(F.coalesce(F.col("brand_name"), F.lit("")) != "")


def post_processed(rows: DataFrame) -> DataFrame:
    """rows with info under the table's own values, and relations."""
    info = nested.post_processed(F.col("info"), F.col("brand_name"), F.col("condition"), F.col("medication_duration"))
    return rows.withColumn("info", info).withColumn("relations", nested.relations(F.col("info"), F.col("brand_name")))


def distinct_terms(rows: DataFrame, info: str = "info") -> DataFrame:
    """Every side effect name once: what is matched against the vocabulary, instead of each row's names."""
    return rows.select(F.explode(nested.effect_names(F.col(info))).alias("term")).where("term != ''").distinct()


def term_maps(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """key and its map of term -> standard, for rows that hold a matched term. Distributed, whatever the vocabulary's size."""
    terms = rows.select(key, F.explode(F.array_distinct(nested.effect_names(F.col("info")))).alias("term"))
    one = terms.join(matches.where("standard is not null"), "term").groupBy(key, "term").agg(F.min(F.lower("standard")).alias("standard"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "standard"))).alias("_map"))


def standardized(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """rows with the matched names replaced in info and relations, and treats relations classified. matches: term, standard."""
    empty: Column = F.create_map().cast("map<string,string>")
    joined = rows.join(term_maps(rows, matches, key), key, "left").withColumn("_map", F.coalesce("_map", empty))
    return joined.withColumns({"info": nested.replaced_info(F.col("info"), F.col("_map")), "relations": nested.standardized_relations(F.col("relations"), F.col("_map"))}).drop("_map")

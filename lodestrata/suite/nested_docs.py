"""JSON cells, nested documents, relations and the extraction and standardisation pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..functions import normalize as N
from ..operators import standardize
from .base import CTE, reviews, table

TERMS = ["nausea", "headache", "fatigue", "hair loss"]
SEVERITIES = ["mild", "moderate", "severe"]


def json_parse_safe(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "not json").when(F.col("event_id") % 5 == 1, " ").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.from_json(F.nullif(N.strip(text), F.lit("")), "k long")["k"].alias("k"))


def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing.name"), F.lit("none")).alias("missing"))


def json_roundtrip(spark, d):
    doc = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))
    return table(spark, d, "events").select("event_id", nested.json_text(F.from_json(nested.json_text(doc), "id long, kind string")).alias("json"))


def _info_text():
    """A document's JSON with a scalar name, a list of names, a padded one and severities as they come."""
    k, b = F.col("row_idx"), F.col("brand_name")
    sev = F.when(F.col("severity_text").isNull(), "null").otherwise(F.concat(F.lit('"'), "severity_text", F.lit('"')))
    one = F.concat(F.lit('{"name": "nausea", "severity": '), sev, F.lit(', "associated_drug": null}'))
    two = F.concat(F.lit('{"name": ["headache", " fatigue "], "severity": "mild", "associated_drug": "'), F.when(k % 3 == 0, "Other Drug").otherwise(""), F.lit('"}'))
    effects = F.when(k % 4 == 0, F.lit("[]")).when(k % 4 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")))
    return F.concat(F.lit('{"drug": {"name": "'), b, F.lit('", "dosage": "5 mg"}, "condition": '), F.when(k % 2 == 0, F.lit("null")).otherwise(F.lit('{"name": "x", "severity": "Mild"}')), F.lit(', "side_effects": '), effects, F.lit("}"))


def documents(spark, d):
    rows = reviews(spark, d).withColumn("info", nested.parsed_info(_info_text()))
    return standardize.post_processed(rows)


def union_to_array(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('["'), "p_type", F.lit('", "'), "p_brand", F.lit('"]'))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(nested.names_of(raw), ",").alias("names"))


def _effects(rows):
    """A row per side effect e. The plain explode would have the optimiser infer filters that parse the document again."""
    return rows.select("row_idx", F.explode_outer("info.side_effects").alias("e")).where("e is not null")


def explode_nested(spark, d):
    return _effects(documents(spark, d)).select(F.explode("e.name").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def doc_validate(spark, d):
    text = F.when(F.col("row_idx") % 7 == 0, '{"drug": {"dosage": "1"}}').when(F.col("row_idx") % 7 == 1, "oops").otherwise(_info_text())
    return reviews(spark, d).select("row_idx", nested.parsed_info(text).isNotNull().alias("valid"))


def post_process(spark, d):
    effects = F.array_join(F.transform("info.side_effects", lambda e: F.concat_ws("/", F.array_join(e["name"], "+"), F.coalesce(e["severity"], F.lit("-")), e["associated_drug"])), ";")
    return documents(spark, d).select("row_idx", "info.drug.name", F.col("info.drug.duration").alias("duration"), F.col("info.condition.name").alias("condition"), F.col("info.condition.severity").alias("severity"), effects.alias("effects"))


_SEV = "CASE WHEN lower(trim(severity_text)) IN ('mild', 'moderate', 'severe') THEN upper(trim(severity_text)[1]) || lower(trim(severity_text)[2:]) ELSE '-' END"
_DURATION = "CASE WHEN trim(medication_duration) <> '' AND lower(trim(medication_duration)) <> 'nan' THEN trim(medication_duration) END"
_COND = "CASE WHEN condition IS NOT NULL AND lower(trim(condition)) <> 'other' THEN condition ELSE 'Other' END"
_SECOND = "CASE WHEN row_idx % 3 = 0 THEN 'Other Drug' ELSE brand_name END"
POST_SQL = f"""{CTE} SELECT row_idx, brand_name AS name, {_DURATION} AS duration, {_COND} AS condition,
CASE WHEN row_idx % 2 = 1 AND {_COND} <> 'Other' THEN 'Mild' END AS severity,
CASE WHEN row_idx % 4 = 0 THEN '' ELSE concat('nausea/', {_SEV}, '/', brand_name) || CASE WHEN row_idx % 4 = 1 THEN '' ELSE concat(';headache+ fatigue /Mild/', {_SECOND}) END END AS effects FROM reviews"""


def assoc_default(spark, d):
    return _effects(documents(spark, d)).groupBy(F.col("e.associated_drug").alias("drug")).agg(F.count("*").alias("n"))


def _told(r):
    return F.concat_ws("/", r["start"]["properties"]["name"], r["relation"], r["end"]["properties"]["name"], F.coalesce(r["properties"]["severity"], r["properties"]["approval"], F.lit("-")))


def build_relations(spark, d):
    return documents(spark, d).select("row_idx", F.array_join(F.transform("relations", _told), ";").alias("relations"))


RELATIONS_SQL = f"""{CTE} SELECT row_idx, concat(brand_name, '/treats/', {_COND}, '/-') || CASE WHEN row_idx % 4 = 0 THEN '' ELSE concat(';', brand_name, '/causes/nausea/', {_SEV}) || CASE WHEN row_idx % 4 = 1 THEN '' ELSE concat(';', {_SECOND}, '/causes/headache/Mild;', {_SECOND}, '/causes/ fatigue /Mild') END END AS relations FROM reviews"""


def _mapping():
    return F.create_map(F.lit("nausea"), F.lit("nausea (standard)"), F.lit("fatigue"), F.lit("tiredness"))


def replace_terms(spark, d):
    names = nested.replaced(nested.effect_names(F.col("info")), _mapping())
    return documents(spark, d).select("row_idx", F.array_join(names, ";").alias("names"))


REPLACE_SQL = f"{CTE} SELECT row_idx, CASE row_idx % 4 WHEN 0 THEN '' WHEN 1 THEN 'nausea (standard)' ELSE 'nausea (standard);headache;tiredness' END AS names FROM reviews"


def standardize_relations(spark, d):
    named = F.when(F.col("row_idx") % 2 == 0, "Ozempic").otherwise("Wegovy")
    rows = documents(spark, d).withColumn("relations", nested.relations(F.col("info"), named))
    return rows.select("row_idx", F.array_join(F.transform(nested.standardized_relations(F.col("relations"), _mapping()), _told), ";").alias("relations"))


STANDARD_SQL = f"""{CTE}, t AS (SELECT *, CASE WHEN row_idx % 2 = 0 THEN 'Ozempic' ELSE 'Wegovy' END AS drug FROM reviews)
SELECT row_idx, concat(drug, '/treats/', {_COND}, '/', CASE WHEN drug = 'Ozempic' AND contains(lower({_COND}), 'diabetes') THEN 'yes' ELSE 'no' END) || CASE WHEN row_idx % 4 = 0 THEN '' ELSE concat(';', brand_name, '/causes/nausea (standard)/', {_SEV}) || CASE WHEN row_idx % 4 = 1 THEN '' ELSE concat(';', {_SECOND}, '/causes/headache/Mild;', {_SECOND}, '/causes/tiredness/Mild') END END AS relations FROM t"""


def _texts(spark, d):
    """Review texts with terms, a severity word and a dosage; every ninth row has no brand."""
    k = F.col("row_idx")
    text = F.concat(F.lit("I took 2.5 mg and had "), F.when(k % 3 == 0, "severe nausea").when(k % 3 == 1, "a headache and FATIGUE").otherwise("no nauseating moment"))
    return reviews(spark, d).withColumn("textual_review", text).withColumn("brand_name", F.when(k % 9 != 0, F.col("brand_name")))


def extract_pipeline(spark, d):
    rows = standardize.post_processed(standardize.extracted(_texts(spark, d), TERMS, SEVERITIES))
    return rows.select("row_idx", F.col("info.drug.dosage").alias("dosage"), F.array_join(F.transform("relations", _told), ";").alias("relations"))


EXTRACT_SQL = f"""{CTE} SELECT row_idx, CASE WHEN row_idx % 9 <> 0 THEN '2.5 mg' END AS dosage, CASE WHEN row_idx % 9 <> 0 THEN concat(brand_name, '/treats/', {_COND}, '/-') || CASE row_idx % 3 WHEN 0 THEN concat(';', brand_name, '/causes/nausea/Severe') WHEN 1 THEN concat(';', brand_name, '/causes/headache/-;', brand_name, '/causes/fatigue/-') ELSE '' END END AS relations FROM reviews"""


def extract_drop_failed(spark, d):
    """The first form of extraction: rows that fail are dropped."""
    rows = standardize.extracted(_texts(spark, d), TERMS, SEVERITIES, keep_failed=False)
    return rows.select("row_idx", F.col("info.drug.dosage").alias("dosage"), F.size("info.side_effects").cast("long").alias("n_effects"))


DROP_SQL = f"{CTE} SELECT row_idx, '2.5 mg' AS dosage, CAST(CASE row_idx % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS n_effects FROM reviews WHERE row_idx % 9 <> 0"


def standardize_pipeline(spark, d):
    """Extraction, distinct terms, a match table (here by rule), and the matched names in their place."""
    rows = standardize.post_processed(standardize.extracted(_texts(spark, d), TERMS, SEVERITIES))
    terms = standardize.distinct_terms(rows)
    matches = terms.select("term", F.when(F.col("term") != "headache", F.concat(F.lit("STD "), "term")).alias("standard"))
    out = standardize.standardized(rows, matches, "row_idx")
    return out.select("row_idx", F.array_join(F.transform("relations", _told), ";").alias("relations"), F.array_join(nested.effect_names(F.col("info")), ";").alias("names"))


PIPELINE_SQL = f"""{CTE} SELECT row_idx, CASE WHEN row_idx % 9 <> 0 THEN concat(brand_name, '/treats/', {_COND}, '/no') || CASE row_idx % 3 WHEN 0 THEN concat(';', brand_name, '/causes/std nausea/Severe') WHEN 1 THEN concat(';', brand_name, '/causes/headache/-;', brand_name, '/causes/std fatigue/-') ELSE '' END END AS relations,
CASE WHEN row_idx % 9 <> 0 THEN CASE row_idx % 3 WHEN 0 THEN 'std nausea' WHEN 1 THEN 'headache;std fatigue' ELSE '' END END AS names FROM reviews"""

QUERIES = {
    "json_parse_safe": (json_parse_safe, "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"),
    "json_extract": (json_extract, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'none' AS missing FROM events"),
    "json_roundtrip": (json_roundtrip, "SELECT event_id, concat('{\"id\":', CAST(event_id AS VARCHAR), ',\"kind\":', CASE WHEN event_id % 2 = 0 THEN '\"' || event_type || '\"' ELSE 'null' END, '}') AS json FROM events"),
    "union_to_array": (union_to_array, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || ',' || p_brand ELSE p_type END AS names FROM part"),
    "explode_nested": (explode_nested, f"{CTE}, e AS (SELECT 'nausea' AS name FROM reviews WHERE row_idx % 4 > 0 UNION ALL SELECT 'headache' FROM reviews WHERE row_idx % 4 > 1 UNION ALL SELECT ' fatigue ' FROM reviews WHERE row_idx % 4 > 1) SELECT name, count(*) AS n FROM e GROUP BY 1"),
    "doc_validate": (doc_validate, f"{CTE} SELECT row_idx, row_idx % 7 > 1 AS valid FROM reviews"),
    "post_process": (post_process, POST_SQL),
    "assoc_default": (assoc_default, f"{CTE}, e AS (SELECT brand_name AS drug FROM reviews WHERE row_idx % 4 > 0 UNION ALL SELECT {_SECOND} FROM reviews WHERE row_idx % 4 > 1) SELECT drug, count(*) AS n FROM e GROUP BY 1"),
    "build_relations": (build_relations, RELATIONS_SQL),
    "replace_terms": (replace_terms, REPLACE_SQL),
    "standardize_relations": (standardize_relations, STANDARD_SQL),
    "extract_pipeline": (extract_pipeline, EXTRACT_SQL),
    "extract_drop_failed": (extract_drop_failed, DROP_SQL),
    "standardize_pipeline": (standardize_pipeline, PIPELINE_SQL),
}

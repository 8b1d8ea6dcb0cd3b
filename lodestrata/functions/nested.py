"""Structured documents and relations as native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from .normalize import approval, condition_name, duration, severity, strip


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def names_of(raw: Column) -> Column:
    """array<string> of a JSON value that is a string or a list of strings; raw is its JSON or plain text."""
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), None).when(F.startswith(F.ltrim(raw), F.lit("[")), listed).otherwise(F.array(F.regexp_replace(raw, '^"|"$', "")))


def parsed_info(text: Column) -> Column:
    """The structured document of a JSON text, null where the text is blank, no JSON, or lacks a required name.

    Side effect names may be a string or a list; NaN literals read as null.
    """
    loose = "drug struct<name string, dosage string, dosage_form string, duration string, continued_use string, alternative_drug_considered string>, condition struct<name string, severity string>, side_effects array<struct<name string, severity string, associated_drug string>>"
    clean = lambda c: F.when(c.isin("NaN", '"NaN"'), None).otherwise(c)
    return bound(F.from_json(F.nullif(strip(text), F.lit("")), loose), lambda doc: _checked(doc, clean))


def _checked(doc: Column, clean: Callable[[Column], Column]) -> Column:
    """A parsed document with its names as lists, null where it lacks a required one."""
    effects = F.transform(doc["side_effects"], lambda e: F.struct(names_of(e["name"]).alias("name"), e["severity"].alias("severity"), e["associated_drug"].alias("associated_drug")))
    condition = F.when(doc["condition"].isNotNull(), F.struct(clean(doc["condition"]["name"]).alias("name"), doc["condition"]["severity"].alias("severity")))
    whole = F.struct(doc["drug"].alias("drug"), condition.alias("condition"), F.coalesce(effects, F.array().cast(schemas.STRUCTURED_INFO["side_effects"].dataType)).alias("side_effects"))
    complete = doc["drug"]["name"].isNotNull() & F.forall(F.coalesce(doc["side_effects"], F.array()), lambda e: e["name"].isNotNull())
    return F.when(complete, whole)


def post_processed(info: Column, brand: Column, condition: Column, told_duration: Column) -> Column:
    """The document under the table's own values: drug name and duration, condition, associated drug and severity."""
    name = condition_name(condition)

    def merged(info: Column) -> Column:
        drug = info["drug"].withField("name", brand).withField("duration", duration(told_duration))
        own = F.struct(name.alias("name"), F.when(name != "Other", info["condition"]["severity"]).alias("severity"))
        effects = F.transform(info["side_effects"], lambda e: F.struct(e["name"].alias("name"), severity(e["severity"]).alias("severity"), F.coalesce(F.nullif(e["associated_drug"], F.lit("")), brand).alias("associated_drug")))
        return F.when(info.isNotNull(), F.struct(drug.alias("drug"), own.alias("condition"), effects.alias("side_effects")))

    return bound(info, merged)


def _node(label: str, name: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), F.struct(name.alias("name")).alias("properties"))


def _relation(start: Column, end: Column, kind: str, **told: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("relation"), F.struct(*(told.get(k, null).alias(k) for k in ("approval", "off_label", "severity", "dosage"))).alias("properties"))


def relations(info: Column, brand: Column) -> Column:
    """One treats relation where the condition has a name, and a causes relation for each side effect name."""

    def told(info: Column) -> Column:
        treats = F.when(info["condition"]["name"].isNotNull(), F.array(_relation(_node("Medication", brand), _node("Disease", info["condition"]["name"]), "treats"))).otherwise(F.array().cast(f"array<{schemas.RELATION.simpleString()}>"))
        causes = F.flatten(F.transform(info["side_effects"], lambda e: F.transform(e["name"], lambda n: _relation(_node("Medication", e["associated_drug"]), _node("SideEffect", n), "causes", severity=e["severity"], dosage=info["drug"]["dosage"]))))
        return F.when(info.isNotNull(), F.concat(treats, causes))

    return bound(info, told)


def effect_names(info: Column) -> Column:
    """All side effect names, stripped."""
    return F.transform(F.flatten(F.transform(info["side_effects"], lambda e: e["name"])), strip)


def replaced(names: Column, mapping: Column) -> Column:
    """Names through a map, stripped first; names that it lacks stay."""
    return F.transform(names, lambda n: F.coalesce(F.element_at(mapping, strip(n)), n))


def replaced_info(info: Column, mapping: Column) -> Column:
    return F.when(info.isNotNull(), info.withField("side_effects", F.transform(info["side_effects"], lambda e: e.withField("name", replaced(e["name"], mapping)))))


def standardized_relations(items: Column, mapping: Column) -> Column:
    """Effect names through the map; approval and off_label of treats relations by the indication rules."""

    def one(r: Column) -> Column:
        effect = (r["relation"] == "causes") & (r["end"]["label"] == "SideEffect")
        named = r.withField("end.properties.name", F.coalesce(F.element_at(mapping, strip(r["end"]["properties"]["name"])), r["end"]["properties"]["name"]))
        treats = (r["relation"] == "treats") & (r["end"]["label"] == "Disease") & (r["start"]["properties"]["name"] != "") & (r["end"]["properties"]["name"] != "")
        ok = approval(r["start"]["properties"]["name"], r["end"]["properties"]["name"]) == "approval"
        judged = r.withField("properties.approval", F.when(ok, "yes").otherwise("no")).withField("properties.off_label", F.when(ok, "no").otherwise("yes"))
        return F.when(effect, named).when(treats, judged).otherwise(r)

    return F.transform(items, one)


def json_text(c: Column) -> Column:
    """JSON with nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})

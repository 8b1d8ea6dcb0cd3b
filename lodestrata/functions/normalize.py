"""Field rules of the review domain as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (SQL's trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def number(c: Column) -> Column:
    """The number a text holds, null for other texts and for NaN."""
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def is_numeric(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def _int(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def age_range(c: Column) -> Column:
    """struct(lo, hi) of an age text: an open end, a range, an upper bound, or one age; else nulls."""
    age = F.lower(strip(c))
    first = _int(age, r"(\d+)")
    open_end = F.contains(age, F.lit("or over")) | F.contains(age, F.lit("+"))
    low, high = _int(age, r"^(\d+)\s*-\s*(\d+)", 1), _int(age, r"^(\d+)\s*-\s*(\d+)", 2)
    under = F.contains(age, F.lit("<"))
    single = _int(age, r"^([+-]?\d+)$")
    lo = F.when(open_end, first).when(low.isNotNull(), low).when(under, F.when(first.isNotNull(), 0)).otherwise(single)
    hi = F.when(open_end, F.when(first.isNotNull(), schemas.AGE_OPEN_END)).when(low.isNotNull(), high).when(under, first - 1).otherwise(single)
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def severity(c: Column) -> Column:
    """Mild, Moderate or Severe; else null."""
    word = F.lower(strip(c))
    return F.when(word.isin(schemas.SEVERITIES), F.initcap(word))


def dosage_form(brand: Column) -> Column:
    out = F.lit(None).cast("string")
    for form, brands in schemas.DOSAGE_FORMS.items():
        out = F.when(F.lower(brand).isin(brands), form).otherwise(out)
    return out


def approval(brand: Column, condition: Column) -> Column:
    """'approval' where the brand's indication stands in the condition, else 'off_label'."""
    hit = F.lit(False)
    for word, brands in schemas.INDICATIONS.items():
        hit = hit | (F.lower(strip(brand)).isin(brands) & F.contains(F.lower(condition), F.lit(word)))
    return F.when(hit, "approval").otherwise("off_label")


def condition_name(told: Column) -> Column:
    """The table's condition, or Other where it has none."""
    return F.when(told.isNotNull() & (told != "") & (F.lower(strip(told)) != "other"), told).otherwise("Other")


def duration(told: Column) -> Column:
    text = strip(told)
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def iso_date(c: Column, pattern: str = "M/d/yyyy") -> Column:
    """yyyy-MM-dd of a date text; null where it is none."""
    return F.date_format(F.try_to_date(c, pattern), "yyyy-MM-dd")


def paged_url(c: Column) -> Column:
    """With a first page's parameters, unless it names a page."""
    return F.when(F.contains(c, F.lit("page=")), c).when(F.contains(c, F.lit("?")), F.concat(c, F.lit("&page=1&next_page=true"))).otherwise(F.concat(c, F.lit("?page=1&next_page=true")))


def page_url(c: Column, page: Column | int) -> Column:
    """The URL of a page: every 'page=1' replaced, as a plain substring."""
    return F.replace(c, F.lit("page=1"), F.concat(F.lit("page="), F.lit(page).cast("string") if isinstance(page, int) else page.cast("string")))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words is a substring of the text, in any case."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def first_of(text: Column, names: list[str]) -> Column:
    """The first name, in list order, that the text mentions."""
    return F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(n.lower())), n) for n in names))


def pipe_fields(c: Column) -> Column:
    """struct(user, age, gender, duration, patient_type) of a details text split at bars; empty parts don't count."""
    parts = F.filter(F.transform(F.split(c, r"\|"), strip), lambda x: x != "")
    at = lambda i: F.get(parts, F.lit(i))
    marker = "On medication for"
    return F.struct(at(0).alias("user"), at(1).alias("age"), at(2).alias("gender"), F.when(F.contains(at(3), F.lit(marker)), strip(F.replace(at(3), F.lit(marker), F.lit("")))).alias("duration"), at(4).alias("patient_type"))


def truncated(c: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """Tokens of a text at 3.5 characters each, rounded up."""
    return F.ceil(F.length(c) / 3.5)


def safe_id(c: Column) -> Column:
    """Letters and digits of any script, underscores and hyphens."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "")

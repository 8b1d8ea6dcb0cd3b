"""Stored HTML pages: elements, review blocks and the end of a paged source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html
from .base import table


def html_attr(spark, d):
    return table(spark, d, "pages").select("page_id", html.tag_attribute(F.col("html"), "html", "lang").alias("lang"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(html.tag_text(F.col("html"), "title")).alias("digest"))


def html_links(spark, d):
    """Targets of all links, by the parser."""
    return html.elements(table(spark, d, "pages").select("page_id", "html"), "a", "href").select("page_id", F.size("found").cast("long").alias("n"), F.array_join("found", " ").alias("targets"))


#: Review blocks of four shapes; {k} is the page's number. Long text and spans; short text with markup and bare bars; details without
#: spans and a text outside of paragraphs; malformed markup with blank and missing parts.
SHAPES = (
    '<div class="x review-details-holder"><div class="date"> 1/2/2024 </div><div class="details"><span>U{k} |</span><span>25-34 |</span><span>Female</span> | On medication for 1 year | <span>Patient</span></div><strong class="condition">Condition: Other</strong><div class="overall-rating"><div class="webmd-rate a" aria-valuenow="{r}"></div></div><div class="categories"><section><div class="webmd-rate" aria-valuenow="4"></div></section><section><p><div class="b webmd-rate" aria-valuenow="3"></div></section><section></section></div><div class="review-like-dislikes"><div class="helpful"><span class="likes"> 7 </span></div><div class="not-helpful"><span class="dislikes">2</span></div></div><div class="description"><p class="description-text">x<span class="a showSec">"Good,</span><span class="hiddenSec"> really"</span></p></div></div>',
    '<div class="review-details-holder"><div class="details"><span> </span><span>U{k}</span>|<span>|</span><span>Male |</span> less than 1 month | <span>Caregiver of a Patient</span></div><strong class="condition"> </strong><div class="like-dislikes"><div class="helpful"><span class="likes">0</span></div></div><div class="description"><p class="description-text"> "short <br> form {r} <b>bold</b> end" </p></div></div>',
    '<div class="review-details-holder b"><div class="details"><b>U{k} | 45-54 | | Other | On medication for 2 to 5 years | Caregiver | more</b></div><div class="categories"><section></section><section></section><section><div><div class="webmd-rate" aria-valuenow="{r}"></div></div></section></div><div class="description"><p class="description-text"> </p><i> {r} stars </i><i>rest</i></div></div>',
    '<p>before<div class="review-details-holder"><div class="date"></div><p><div class="details"><span>U{k}<b>|</span></div><div class="overall-rating"><div class="webmd-rate"></div><img src="x">',
)
#: Their fields in the order of html.FIELDS, as SQL.
SHAPE_FIELDS = (
    ("'1/2/2024'", "'U' || {k}", "'25-34'", "'Female'", "'Patient'", "'1 year'", "'Other'", "{r}", "'4'", "'3'", "NULL", "'7'", "'2'", "'Good,really'"),
    ("NULL", "'U' || {k}", "'Male'", "'Male'", "'Caregiver of a Patient'", "'less than 1 month'", "NULL", "NULL", "NULL", "NULL", "NULL", "'0'", "'0'", "'short form ' || {r} || ' end'"),
    ("NULL", "'U' || {k}", "'45-54'", "'Other'", "'Caregiver'", "'2 to 5 years'", "NULL", "NULL", "NULL", "NULL", "{r}", "NULL", "'0'", "{r} || ' stars'"),
    ("NULL", "'U' || {k}", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "'0'", "''"),
)


def html_blocks(spark, d):
    """Review blocks of four shapes put around each page's number, parsed back; each second page has another block first."""
    k, r = F.col("page_id").cast("string"), (F.col("page_id") % 5).cast("string")
    shapes = F.array(*(F.replace(F.replace(F.lit(x), F.lit("{k}"), k), F.lit("{r}"), r) for x in SHAPES))
    own = F.get(shapes, (F.col("page_id") % len(SHAPES)).cast("int"))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("<body><br>"), F.when(F.col("page_id") % 3 == 0, F.get(shapes, F.lit(0))).otherwise(""), own).alias("html"))
    return html.review_blocks(pages).select("page_id", F.col("block").cast("long").alias("block"), *html.FIELDS)


def _blocks_sql() -> str:
    """The pages' shapes with their numbers, and a field after the other as the shapes have it."""
    k, r = "CAST(page_id AS VARCHAR)", "CAST(page_id % 5 AS VARCHAR)"
    fields = ", ".join(f"CASE shape {' '.join(f'WHEN {i} THEN {x[j].format(k=k, r=r)}' for i, x in enumerate(SHAPE_FIELDS))} END AS \"{name}\"" for j, name in enumerate(html.FIELDS))
    return f"""WITH b AS (SELECT page_id, 0 AS block, 0 AS shape FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END, page_id % {len(SHAPES)} FROM pages)
SELECT page_id, CAST(block AS BIGINT) AS block, {fields} FROM b"""


def page_dedup(spark, d):
    """Ten pages a source; from its fifth on, a source repeats its page."""
    rows = table(spark, d, "customer").select((F.col("c_custkey") / 10).cast("long").alias("src"), (F.col("c_custkey") % 10).alias("page"))
    rows = rows.withColumn("content", F.when((F.col("src") % 3 == 0) & (F.col("page") >= 5), "same").when((F.col("src") % 3 == 1) & (F.col("page") == 7), "").otherwise(F.concat(F.lit("p"), F.col("page").cast("string"))))
    return html.until_repeated(rows, "src", "page", "content")


QUERIES = {
    "html_attr": (html_attr, "SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1), '') AS lang FROM pages"),
    "html_text": (html_text, "SELECT page_id, md5(nullif(regexp_extract(html, '<title[^>]*>([^<]*)', 1), '')) AS digest FROM pages"),
    "html_links": (html_links, "WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT page_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, ' ') AS targets FROM a"),
    "html_blocks": (html_blocks, _blocks_sql()),
    "page_dedup": (page_dedup, "WITH r AS (SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS src, c_custkey % 10 AS page FROM customer) SELECT src, page, CASE WHEN src % 3 = 0 AND page >= 5 THEN 'same' ELSE 'p' || CAST(page AS VARCHAR) END AS content FROM r WHERE NOT (src % 3 = 0 AND page >= 6) AND NOT (src % 3 = 1 AND page >= 7)"),
}

"""HTML functions on ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table

_DROP = r"(?is)<(script|style|nav|footer|header|aside)[^>]*>.*?</(script|style|nav|footer|header|aside)>|<!--.*?-->"


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '(?i)<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and character set from the head."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", '(?i)<meta charset="([^"]*)"', 1).alias("charset"))


@query(r"""SELECT page_id, url AS ld_url, 'Article' AS ld_type FROM pages""")
def jsonld_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked data written into the page and read out of its script element, inside a graph."""
    script = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Article", "url": "'), "url", F.lit('"}]}</script>'))
    page = F.concat(F.col("html"), script)
    body = F.regexp_extract(page, r'(?is)<script type="application/ld\+json">(.*?)</script>', 1)
    return table(spark, sf_dir, "pages").select("page_id", F.get_json_object(body, "$['@graph'][0].url").alias("ld_url"), F.get_json_object(body, "$['@graph'][0]['@type']").alias("ld_type"))


@query(rf"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '{_DROP}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without scripts, styles, menus and tags."""
    x = F.regexp_replace(F.regexp_replace("html", _DROP, " "), "(?s)<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(x, r"\s+", " "))).alias("h"))


@query(r"WITH c AS (SELECT page_id, 0 AS prio, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t FROM pages UNION ALL SELECT page_id, 1, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) FROM pages UNION ALL SELECT page_id, 2, regexp_extract(html, '(?is)<p>(.*?)</p>', 1) FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(t) ORDER BY prio) AS rn FROM c WHERE t <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY prio, -length(t)) AS pos FROM f WHERE rn = 1) SELECT page_id, pos, prio, t FROM r")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several sources: each once, by source priority, then length."""
    found = F.array(*[F.struct(F.lit(i).alias("prio"), F.regexp_extract("html", f"(?is)<{tag}>(.*?)</{tag}>", 1).alias("t")) for i, tag in enumerate(("title", "h1", "p"))])
    once = F.aggregate(found, F.slice(found, 1, 0), lambda acc, x: F.when((x["t"] == "") | F.exists(acc, lambda y: F.lower(y["t"]) == F.lower(x["t"])), acc).otherwise(F.concat(acc, F.array(x))))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(once).alias("pos", "x")).select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "x.prio", "x.t")

"""The company registry: a JSON document of companies, their rules and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANY = """struct<
  company_id: string, name: string, domain: string, platform: string, adapter: string, base_url: string,
  careers_url: string, search_url: string, api_url: string, requires_browser: boolean, sitemap_urls: array<string>, access_mode: string, max_rps: double,
  cooldown_minutes: int, disabled: boolean, discovery_type: string, id_pattern: string, url_prefixes: array<string>,
  headers: map<string,string>, selectors: map<string,string>, status: string, notes: string, tags: array<string>>"""
PLATFORMS = ["sitemap", "phenom_sitemap", "phenom_search", "apply_v2", "paged_html", "browser_paged_html", "encoded_api", "usajobs_api"]
DEFAULT_MAX_RPS = 2.0


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))


def companies(documents: DataFrame) -> DataFrame:
    """One row for each company of registry documents (column doc), defaults filled in."""
    kind = " ".join(COMPANY.split())
    rows = documents.select(F.explode(F.from_json("doc", f"companies map<string,{kind}>")["companies"]).alias("key", "c"))
    defaults = {"max_rps": F.lit(DEFAULT_MAX_RPS), "cooldown_minutes": F.lit(0), "disabled": F.lit(False), **{c: F.array().cast("array<string>") for c in ("sitemap_urls", "url_prefixes", "tags")}, **{c: F.create_map().cast("map<string,string>") for c in ("headers", "selectors")}}
    flat = rows.select("key", "c.*").withColumn("company_id", F.coalesce("company_id", "key")).drop("key")
    return flat.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def violations(rows: DataFrame, most: int = 50) -> DataFrame:
    """(company_id, message) of rules that companies break, `most` at most (it is a report)."""
    rules = {
        "company_id is required": F.col("company_id").isNull() | (F.col("company_id") == ""),
        "company_id must be lower-case letters, digits, - or _": ~F.col("company_id").rlike("^[a-z0-9][a-z0-9_-]*$"),
        "name is required": F.col("name").isNull() | (F.col("name") == ""),
        "domain is not a host name": ~F.col("domain").rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"),
        "platform is not known": ~F.col("platform").isin(PLATFORMS),
        "max_rps must be above 0": F.col("max_rps") <= 0,
        "cooldown_minutes must not be below 0": F.col("cooldown_minutes") < 0,
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(m)) for m, bad in rules.items()]))
    return rows.select("company_id", F.explode(found).alias("message")).orderBy("company_id", "message").limit(most)


def sites(documents: DataFrame) -> DataFrame:
    """Site list: name to website, careers and search pages, under either of their names; other values are skipped."""
    entry = F.try_variant_get(F.try_parse_json("doc"), "$", "map<string,variant>")
    rows = documents.select(F.explode(entry).alias("name", "v"))
    text = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    return rows.where(F.schema_of_variant("v").startswith("OBJECT")).select("name", text("website", "site").alias("website"), text("careers", "career").alias("careers"), text("search").alias("search"))

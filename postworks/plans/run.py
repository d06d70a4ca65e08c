"""A whole run over captured pages: from a listing to stored postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postworks.functions.keys import dedupe_key
from postworks.operators.canonical import canonicalize, errors, since
from postworks.operators.dedupe import cap_each, keep_first
from postworks.operators.incremental import SnapshotTable, known_keys, with_artifacts
from postworks.operators.mapping import normalize
from postworks.sources.pages import detail_artifacts

#: The map column of each letter of a mapping.
MAPS = {"L": "listing", "J": "jsonld", "V": "vendor_fields", "M": "meta", "B": "bold"}
#: Platforms whose documents hold the job inside other objects.
NESTED = {"phenom_search": {"V": "job_fields"}}


#: Platforms whose listing holds the whole document, so that no page is fetched.
API_FIRST = {"usajobs_api"}
#: Counters of a run, in the order in which rows pass them.
COUNTS = ("listed", "known", "new", "parsed", "rejected", "keyless", "stored")


@dataclass(frozen=True)
class Outcome:
    """What a run did: rejected rows, which it returns with their errors, and its counts, which were observed while it wrote."""

    rejected: DataFrame
    counts: dict[str, int]

    def metrics(self, scraper: str, ts: Column) -> DataFrame:
        """The counts as events for `runs.metrics` (scraper, kind, name, value, ts)."""
        rows = [(scraper, "counter", name, float(self.counts[name])) for name in COUNTS]
        return self.rejected.sparkSession.createDataFrame(rows, "scraper string, kind string, name string, value double").withColumn("ts", ts)


def listed_rows(listing: DataFrame, stored: DataFrame | SnapshotTable | None, cap: int | None = None) -> DataFrame:
    """Listing rows with their key, and whether that is stored (known). The cap counts before known rows are told."""
    key = dedupe_key(F.col("posting_id"), F.col("detail_url"), F.col("title"))
    rows = (cap_each(listing, "vendor", cap, "ordinal") if cap is not None else listing).withColumn("dedupe_key", key)
    if stored is None:
        return rows.withColumn("known", F.lit(False))
    known = known_keys(rows, stored).withColumn("known", F.lit(True))
    return rows.join(known, ["vendor", "dedupe_key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def parsed_rows(rows: DataFrame, pages: DataFrame | None, columns: list[str], platform: str, as_of: Column, first_day: Column | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Canonical postings of listing rows, first of each key, with their error codes. columns: those of the listing that mappings may use.

    Pages are only read for these rows, and not at all for platforms whose listing
    has the whole document (the map column `vendor_fields`). stage: writes the
    canonical rows, so that what is asked of them is not planned as part of making them.
    """
    mapped = normalize(_joined(rows, pages, columns, platform), platform, MAPS | NESTED.get(platform, {}))
    postings = stage(canonicalize(mapped, F.col("_vendor"), as_of, keep=("ordinal",)))
    own = dedupe_key(F.col("posting_id"), F.col("detail_url"), F.col("position_title"))
    first = keep_first(postings.withColumn("dedupe_key", own), F.col("dedupe_key"), "ordinal", within="vendor")
    recent = first if first_day is None else since(first, first_day, as_of)
    return recent.withColumn("errors", errors(recent))


def _joined(rows: DataFrame, pages: DataFrame | None, columns: list[str], platform: str) -> DataFrame:
    """Listing rows (_vendor, ordinal) with the maps that the platform's mapping reads."""
    text = [c for c in columns if c not in ("vendor", "ordinal", "vendor_fields")]
    if platform in API_FIRST:
        listed = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in text]))
        none = F.create_map().cast("map<string,string>")
        return rows.select(F.col("vendor").alias("_vendor"), "ordinal", listed.alias("listing"), "vendor_fields", *[none.alias(c) for c in ("jsonld", "meta", "bold")])
    wanted = pages.join(rows.select(F.col("detail_url").alias("url")).distinct(), "url", "left_semi")
    maps = MAPS | NESTED.get(platform, {})
    found = detail_artifacts(wanted, parts=("canonical_url", *[c for c in maps.values() if c != "listing"]))
    listed = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in [*text, "canonical_url"]]))
    return with_artifacts(rows, found).select(F.col("vendor").alias("_vendor"), "ordinal", listed.alias("listing"), *[c for c in maps.values() if c != "listing"])


def new_postings(listing: DataFrame, pages: DataFrame | None, stored: DataFrame | SnapshotTable | None, platform: str, as_of: Column, cap: int | None = None, first_day: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical postings that aren't stored yet, ready to be upserted, and rejected ones with their errors.

    listing: vendor, ordinal, posting_id, title, detail_url, and what else a
    source gives as text. The cap counts before known rows are skipped, and
    pages are only read for rows that are left.
    """
    rows = listed_rows(listing, stored, cap).where("NOT known")
    found = parsed_rows(rows, pages, listing.columns, platform, as_of, first_day)
    return found.where(F.size("errors") == 0).drop("errors"), found.where(F.size("errors") > 0)


def run(table: SnapshotTable, listing: DataFrame, pages: DataFrame | None, platform: str, as_of: Column, cap: int | None = None, first_day: Column | None = None) -> Outcome:
    """One run against a stored table: new postings are upserted; what was rejected is returned, with the run's counts.

    The listing with what is known of it, canonical rows, and the parsed rows are
    each written once; counts are observed as they are written, so nothing is read to count it.
    """
    listed, parsed = Observation(), Observation()
    rows = listed_rows(listing, table, cap)
    rows = table.stage(rows.observe(listed, F.count("*").alias("listed"), F.count_if("known").alias("known")))
    found = parsed_rows(rows.where("NOT known"), pages, listing.columns, platform, as_of, first_day, table.stage)
    good = F.size("errors") == 0
    keyed = table.storable()
    found = table.stage(found.observe(parsed, F.count("*").alias("parsed"), F.count_if(~good).alias("rejected"), F.count_if(good & ~keyed).alias("keyless")))
    keyless = table.upsert(found.where(good).drop("errors"), as_of.cast("timestamp"), "ordinal", staged=True)
    counts = {**listed.get, **parsed.get}
    counts |= {"new": counts["listed"] - counts["known"], "stored": counts["parsed"] - counts["rejected"] - counts["keyless"]}
    return Outcome(found.where(~good).unionByName(keyless, allowMissingColumns=True), counts)

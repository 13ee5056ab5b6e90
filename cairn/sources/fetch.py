"""Fetching from a paper API: query text, plans of what to fetch, and what the listing's order allows to skip.

There is no network here; a listing is a table (id, published, ..) in the order the service gave (``place``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The window's ends where none are given.
FIRST_DAY, LAST_DAY = "1991-01-01", "2099-12-31"


def api_query(categories: Column, keywords: Column, date_from: Column, date_to: Column) -> Column:
    """Categories or-ed, keywords or-ed and quoted, and a window of submission days when either end is given."""
    cats = F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR ")
    keys = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit('all:"'), k, F.lit('"'))), " OR ")
    q = F.when(F.size(keywords) > 0, F.concat(F.lit("("), cats, F.lit(") AND ("), keys, F.lit(")"))).otherwise(cats)
    day = lambda d, default, clock: F.concat(F.replace(F.coalesce(d, F.lit(default)), F.lit("-"), F.lit("")), F.lit(clock))
    window = F.concat(F.lit("("), q, F.lit(") AND submittedDate:["), day(date_from, FIRST_DAY, "0000"), F.lit(" TO "), day(date_to, LAST_DAY, "2359"), F.lit("]"))
    return F.when(date_from.isNotNull() | date_to.isNotNull(), window).otherwise(q)


def wanted(listing: DataFrame, seen: DataFrame, date_from: str | None, date_to: str | None, most: int, sort: str = "date") -> DataFrame:
    """Listed papers to fetch: inside the window, not seen, at most ``most`` listed. A listing by date ends at the first
    paper older than the window; one by relevance only skips it."""
    low = date_from or FIRST_DAY
    first = listing.orderBy("place").limit(most)
    if sort == "date":
        end = first.where(F.col("published") < low).agg(F.min("place").alias("_end"))
        first = first.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("place") < F.col("_end"))).drop("_end")  # one row
    inside = first.where((F.col("published") >= low) & (F.lit(date_to is None) | (F.col("published") <= F.lit(date_to))))
    return inside.join(seen.select("id").distinct(), "id", "left_anti")


def refetch_plan(metadata: DataFrame, present: DataFrame) -> DataFrame:
    """(id, present): which files of a corpus are there and which have to be fetched again."""
    return metadata.select("id").join(present.select("id", F.lit(True).alias("present")).distinct(), "id", "left").na.fill(False, ["present"])


def refetched(metadata: DataFrame, present: DataFrame, answers: DataFrame, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """One row: present, to_download, downloaded, failed (ids with the service's status). metadata is (id, place), answers (id,
    status) is what the service would reply; at most ``limit`` missing files are asked for, in the order of ``place``, and a dry
    run asks for none."""
    plan = refetch_plan(metadata, present).join(metadata.select("id", "place"), "id")
    todo = plan.where(~F.col("present"))
    todo = todo if limit is None else todo.orderBy("place").limit(limit)
    asked = todo.where(F.lit(not dry_run)).join(answers.select("id", "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit(404)))
    bad = F.transform(F.sort_array(F.collect_list(F.when(F.col("status") != 200, F.struct("place", "id", "status")))), lambda x: F.struct(x["id"].alias("id"), x["status"].alias("status")))
    counts = plan.agg(F.count_if("present").alias("present")).crossJoin(todo.agg(F.count("*").alias("to_download")))
    return counts.crossJoin(asked.agg(F.count_if(F.col("status") == 200).alias("downloaded"), bad.alias("failed")))  # one-row tables


def resolved_paths(records: DataFrame, active: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, path): the active folder's file, else the stored path where it exists, else null (a failure)."""
    met = records.join(active.select("id", F.col("path").alias("_active")), "id", "left")
    met = met.join(stored.select(F.col("path").alias("_stored")), F.col("pdf_path") == F.col("_stored"), "left")
    return met.select("id", F.coalesce("_active", "_stored").alias("path"))


def plain_id(paper_id: Column) -> Column:
    """The id without its version."""
    return F.regexp_replace(paper_id, r"v\d+$", "")


def curated(base: DataFrame, excluded: list[str], added: DataFrame, expected: int | None = None) -> DataFrame:
    """Base without excluded ids (versions aside) plus added rows; a wrong number of distinct ids is an error."""
    kept = base.where(~plain_id(F.col("id")).isin([*excluded])) if excluded else base
    out = kept.unionByName(added)
    if expected is not None:
        row = out.agg(F.count("*").alias("n"), F.count_distinct(plain_id(F.col("id"))).alias("d")).first()
        if row.n != expected or row.d != expected:
            raise ValueError(f"the corpus has {row.n} rows and {row.d} papers, not {expected}")
    return out

"""Which file of a resource catalogue, or of a folder, belongs to which table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import presets
from ..operators import joins, rank


def usable(
    resources: DataFrame, exclusions: Sequence[str] = presets.TITLE_EXCLUSIONS,
    min_bytes: int = presets.MIN_FILE_BYTES,
) -> DataFrame:
    """CSV (or unmarked) resources that are not small and not derived datasets."""
    fmt, size = F.lower(F.coalesce("format", F.lit(""))), F.coalesce("filesize", F.lit(0))
    low = F.lower("title")
    derived = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in exclusions])
    return resources.filter(fmt.isin("", "csv") & ((size == 0) | (size >= min_bytes)) & ~derived)


def with_years(resources: DataFrame, years: DataFrame) -> DataFrame:
    """One row per resource and four-digit number in its title that is one of the years."""
    numbers = F.array_distinct(F.regexp_extract_all("title", F.lit(r"(?=(\d{4}))"), F.lit(1)))
    exploded = resources.withColumn("year", F.explode(numbers.cast("array<int>")))
    return exploded.join(years.select("year").distinct(), "year", "left_semi")


def resolve(resources: DataFrame, years: DataFrame, keywords: Mapping[str, Sequence[str]] = presets.CATEGORY_KEYWORDS):
    """Per year and category the usable resource with the shortest title."""
    hits = joins.contains_keyword(with_years(usable(resources), years), "title", keywords)
    best = F.min_by(F.struct("title", "url"), F.struct(F.length("title").alias("n"), "title", "url"))
    return hits.groupBy("year", "category").agg(best.alias("_r")).select("year", "category", "_r.*")


def require_all(resolved: DataFrame, keywords: Mapping = presets.CATEGORY_KEYWORDS) -> None:
    """Error when a year lacks a category (reads at most a few rows)."""
    bad = resolved.groupBy("year").agg(F.collect_set("category").alias("c")).filter(F.size("c") < len(keywords))
    row = bad.orderBy("year").first()
    if row:
        raise ValueError(f"year {row['year']}: missing {sorted(set(keywords) - set(row['c']))}")


def detect_new_year(
    resources: DataFrame, known: DataFrame, order: str,
    keywords: Mapping[str, Sequence[str]] = presets.CATEGORY_KEYWORDS, default: int = 2023,
) -> DataFrame:
    """First of the two years after the newest known one that has any resource.

    Per category the first resource in catalogue order; ``status`` tells full from partial matches.
    """
    newest = F.coalesce(known.agg(F.max("year")).scalar(), F.lit(default))
    ahead = known.sparkSession.range(1).select(F.explode(F.sequence(newest + 1, newest + 2)).alias("year"))
    rows = with_years(resources, ahead)
    first_year = rows.agg(F.min("year")).scalar()
    rows = rows.filter(F.col("year") == first_year)
    hits = joins.contains_keyword(rows, "title", keywords)
    picks = rank.first_in_order(hits, "category", order, ["year", "url"])
    found = picks.agg(F.count(F.lit(1))).scalar()
    status = F.when(found == len(keywords), F.lit("full")).otherwise(F.lit("partial"))
    return picks.select("year", "category", "url", status.alias("status"))


def match_files(
    names: DataFrame, group: Sequence[str], name: str,
    keywords: Mapping[str, Sequence[str]] = presets.CATEGORY_KEYWORDS, threshold: float = presets.FUZZY_THRESHOLD,
) -> DataFrame:
    """File per group (folder) and category: by keyword first, by name similarity for what is left.

    In the similarity step the categories choose one after the other, in the order of ``keywords``, among the files not yet
    taken; ties go to the greater name. A category can lose at most one file to each other one, so as many best files as
    there are categories decide the choice.
    """
    group = list(group)
    files = names.select(*group, name).distinct()
    strict = (
        joins.contains_keyword(files, name, keywords).groupBy(*group, "category").agg(F.min(name).alias(name))
        .withColumns({"score": F.lit(1.0), "how": F.lit("keyword")})
    )
    rest = files.join(strict.select(*group, name), [*group, name], "left_anti")
    scored = joins.fuzzy_to_names(rest.withColumnRenamed(name, "_file"), "_file", list(keywords), threshold)
    scored = scored.withColumnsRenamed({"name": "category", "_file": name})
    open_ = scored.join(strict.select(*group, "category"), [*group, "category"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*group, "category").orderBy(F.desc("score"), F.desc(name)))
    best = open_.withColumn("_n", place).filter(F.col("_n") <= len(keywords))
    offers = best.groupBy(*group).agg(F.collect_list(F.struct("score", F.col(name).alias("file"), "category")).alias("_o"))

    def choose(taken: Column, category: Column) -> Column:
        free = F.filter("_o", lambda o: (o["category"] == category) & ~F.exists(taken, lambda x: x["file"] == o["file"]))
        return F.concat(taken, F.array_compact(F.array(F.array_max(free))))

    none = F.filter("_o", lambda o: F.lit(False))
    chosen = F.aggregate(F.array(*[F.lit(c) for c in keywords]), none, choose)
    fuzzy = offers.select(*group, F.explode(chosen).alias("_b")).select(
        *group, "_b.category", F.col("_b.file").alias(name), "_b.score", F.lit("similarity").alias("how")
    )
    return strict.unionByName(fuzzy)


def require_all_files(
    names: DataFrame, matches: DataFrame, group: Sequence[str],
    keywords: Mapping[str, Sequence[str]] = presets.CATEGORY_KEYWORDS,
) -> DataFrame:
    """``matches`` of ``match_files`` again, or an error naming one group of ``names`` that lacks a category.

    Groups without any match count too; only the one row of the first group at fault reaches the driver.
    """
    group = list(group)
    every = names.select(*group, F.lit(None).cast("string").alias("category"))
    seen = every.unionByName(matches.select(*group, "category")).groupBy(*group).agg(F.collect_set("category").alias("_c"))
    row = seen.filter(F.size("_c") < len(keywords)).orderBy(*group).first()
    if row:
        where = ", ".join(str(row[c]) for c in group)
        raise ValueError(f"{where}: missing {sorted(set(keywords) - set(row['_c']))}")
    return matches

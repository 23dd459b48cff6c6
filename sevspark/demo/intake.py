"""Discovery, reading, validation and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import presets
from ..functions import when
from ..operators import cleanse, joins, rank, validate
from ..plans import feature_table
from ..session import work_path
from ..sources import catalog, listing, sinks, tables
from .base import Tables, query
from .raw import STEPS

RAW = ["caracteristiques", "lieux", "usagers", "vehicules"]

# ---- years ----------------------------------------------------------------------------------


def order_years(t: Tables):
    return t.orders.select(F.year("o_orderdate").alias("year")).distinct()


YEARS = "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders"


def yearly_csv(t: Tables, names: list[str]) -> str:
    """Raw tables as CSV below ``<root>/year=YYYY/``."""
    root = work_path(t.spark, "raw")
    for n in names:
        df = t.__getattr__(n).withColumn("year", F.substring("Num_Acc", 1, 4).cast("int"))
        df.write.mode("append").partitionBy("year").option("header", "true").option("sep", ";").csv(root)
    return root


RAW_YEARS = "SELECT DISTINCT CAST(substr(Num_Acc, 1, 4) AS INT) AS year FROM caracteristiques"


@query("src_available_years", RAW_YEARS, "caracteristiques")
def _(t: Tables):
    return listing.available_years(listing.files(t.spark, yearly_csv(t, RAW)))


@query("src_training_years", RAW_YEARS, "caracteristiques")
def _(t: Tables):
    years = listing.available_years(listing.files(t.spark, yearly_csv(t, RAW)))
    found = listing.sorted_years(years, at_least=2)
    return years.filter(F.col("year").isin(found))


@query(
    "src_drift_reference_years",
    f"WITH y AS ({YEARS}) SELECT year, CASE WHEN year = (SELECT max(year) FROM y) THEN 'current' ELSE 'reference' END AS role FROM y",
)
def _(t: Tables):
    return listing.drift_years(order_years(t))


@query("src_years_upto", f"SELECT year FROM ({YEARS}) WHERE year <= 1998")
def _(t: Tables):
    return listing.years_up_to(order_years(t), 1998)


@query("src_year_label", f"SELECT min(year) || '-' || max(year) AS label FROM ({YEARS})")
def _(t: Tables):
    return listing.year_label(order_years(t))


@query(
    "src_year_range",
    f"SELECT CAST(unnest(range(1990, (SELECT max(year) + 1 FROM ({YEARS})))) AS INT) AS year",
)
def _(t: Tables):
    return listing.year_range(order_years(t).agg(F.max("year").alias("year")), 1990)


# ---- catalogue ------------------------------------------------------------------------------

_category = """CASE WHEN contains(lower(title), 'caract') THEN 'caracteristiques' WHEN contains(lower(title), 'lieux') THEN 'lieux'
  WHEN contains(lower(title), 'usagers') THEN 'usagers' WHEN contains(lower(title), 'vehicul') THEN 'vehicules' END"""
_derived = " AND ".join(f"NOT contains(lower(title), '{w}')" for w in presets.TITLE_EXCLUSIONS)
STEPS["catalog_years"] = (
    ("resources",),
    f"SELECT *, {_category} AS category, CAST(regexp_extract(title, '[0-9]{{4}}') AS INT) AS year FROM resources",
)


def catalog_years(t: Tables):
    """All years the catalogue's titles name."""
    return t.resources.select(F.regexp_extract("title", r"\d{4}", 0).cast("int").alias("year")).distinct()


@query(
    "join_keyword",
    "SELECT doc_id, title, category FROM catalog_years WHERE category IS NOT NULL",
    "catalog_years",
)
def _(t: Tables):
    return joins.contains_keyword(t.resources, "title", presets.CATEGORY_KEYWORDS).select("doc_id", "title", "category")


@query(
    "src_resolve_catalog",
    f"""SELECT year, category, title FROM catalog_years WHERE category IS NOT NULL AND lower(format) IN ('', 'csv')
      AND (filesize = 0 OR filesize >= 512000) AND {_derived}
    QUALIFY row_number() OVER (PARTITION BY year, category ORDER BY length(title), title, url) = 1""",
    "catalog_years",
)
def _(t: Tables):
    return catalog.resolve(t.resources, catalog_years(t)).select("year", "category", "title")


@query(
    "rank_shortest",
    """SELECT source, min(length(title)) AS n, arg_min(title, lpad(CAST(length(title) AS VARCHAR), 6, '0') || title) AS title
    FROM resources r JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1""",
    "resources",
)
def _(t: Tables):
    df = t.resources.join(t.documents.select("doc_id", "source"), "doc_id")
    return rank.shortest(df, "source", "title", ["title"]).select("source", F.length("title").cast("bigint").alias("n"), "title")


@query(
    "src_detect_new_year",
    """WITH n AS (SELECT min(year) AS y FROM catalog_years WHERE year IN (2025, 2026)),
    p AS (SELECT year, category, url FROM catalog_years, n WHERE year = y AND category IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY category ORDER BY doc_id) = 1)
    SELECT year, category, url, CASE WHEN (SELECT count(*) FROM p) = 4 THEN 'full' ELSE 'partial' END AS status FROM p""",
    "catalog_years",
)
def _(t: Tables):
    known = catalog_years(t).filter(F.col("year") <= 2024)
    return catalog.detect_new_year(t.resources, known, "doc_id")


_NAMES = """CASE doc_id % 6 WHEN 0 THEN 'carcteristiques' WHEN 1 THEN 'lieux' WHEN 2 THEN 'usager' WHEN 3 THEN 'vehicules'
  WHEN 4 THEN 'xyz-unrelated' ELSE 'caracteristiques' END || CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '_' END
  || CAST(2021 + doc_id % 4 AS STRING)"""


# longest common block of the texts a and b: the first in a at -i
_BLOCK = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2),
      lambda n: CASE WHEN contains(b, substr(a, i, n)) THEN {'n': n, 'i': -i} ELSE {'n': 0, 'i': 0} END))))"""


def _ratios(pairs: str) -> str:
    """Recursive steps from ``pairs`` (s, c) to ``ratios`` (s, c, score): blocks, then those left and right of each."""
    at = "instr(b, substr(a, -k.i, k.n))"
    return f"""pieces(s, c, a, b) AS (SELECT DISTINCT s, c, c, s FROM {pairs} UNION ALL
      SELECT s, c, CASE side WHEN 0 THEN substr(a, 1, -k.i - 1) ELSE substr(a, -k.i + k.n) END,
        CASE side WHEN 0 THEN substr(b, 1, {at} - 1) ELSE substr(b, {at} + k.n) END
      FROM (SELECT *, {_BLOCK} AS k FROM pieces WHERE a <> '' AND b <> ''), (VALUES (0), (1)) v(side) WHERE k.n > 0),
    ratios AS (SELECT s, c, 2 * sum(coalesce(k.n, 0))::DOUBLE / (length(s) + length(c)) AS score
      FROM (SELECT *, {_BLOCK} AS k FROM pieces) GROUP BY s, c)"""


# one category after the other, each without the files that went before
_PICKS = ",\n    ".join(
    f"b{i} AS (SELECT * FROM o WHERE category = '{c}'"
    + "".join(f" AND NOT EXISTS (FROM b{j} WHERE b{j}.source = o.source AND b{j}.name = o.name)" for j in range(1, i))
    + " QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, name DESC) = 1)"
    for i, c in enumerate(presets.CATEGORY_KEYWORDS, start=1)
)


@query(
    "src_match_files",
    f"""WITH RECURSIVE f AS (SELECT DISTINCT source, {_NAMES} AS name FROM documents),
    s AS (SELECT source, category, min(name) AS name FROM (SELECT *, CASE WHEN contains(name, 'caract') THEN 'caracteristiques'
      WHEN contains(name, 'lieux') THEN 'lieux' WHEN contains(name, 'usagers') THEN 'usagers' WHEN contains(name, 'vehicul') THEN 'vehicules' END
      AS category FROM f) WHERE category IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT f.* FROM f ANTI JOIN s USING (source, name)),
    q AS (SELECT *, regexp_replace(lower(name), '[\\s_-]*\\d+$', '') AS s FROM r,
      (VALUES ('caracteristiques'), ('lieux'), ('usagers'), ('vehicules')) v(c)), {_ratios("q")},
    m AS (SELECT source, name, c AS category, score FROM q JOIN ratios USING (s, c)),
    o AS (SELECT m.* FROM m ANTI JOIN s USING (source, category) WHERE score >= 0.75), {_PICKS},
    b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4)
    SELECT source, category, name, 1.0::DOUBLE AS score, 'keyword' AS how FROM s
    UNION ALL SELECT source, category, name, round(score, 6), 'similarity' FROM b""",
)
def _(t: Tables):
    names = t.documents.selectExpr("source", f"{_NAMES} AS name")
    df = catalog.match_files(names, ["source"], "name")
    return df.select("source", "category", "name", F.round("score", 6).alias("score"), "how")


@query(
    "join_fuzzy",
    f"""WITH RECURSIVE q AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[\\s_-]*\\d+$', '') AS s, c FROM part,
      (VALUES ('red widget'), ('small ring'), ('blue bolts')) v(c)), {_ratios("q")}
    SELECT p_partkey, p_name, c AS name, round(score, 6) AS score FROM q JOIN ratios USING (s, c) WHERE score >= 0.75""",
)
def _(t: Tables):
    df = joins.fuzzy_to_names(
        t.part.select("p_partkey", "p_name"), "p_name", ["red widget", "small ring", "blue bolts"], 0.75
    )
    return df.select("p_partkey", "p_name", "name", F.round("score", 6).alias("score"))


# ---- files ----------------------------------------------------------------------------------


@query(
    "src_header_check",
    f"""SELECT year, c AS category, v AS verdict FROM ({RAW_YEARS}), (VALUES ('caracteristiques', 'ok'), ('lieux', 'ok'), ('usagers', 'ok'),
      ('vehicules', 'ok'), ('lieux as usagers', 'missing: grav,catu'), ('large', 'too small')) v(c, v)""",
    "caracteristiques",
)
def _(t: Tables):
    def verdicts(files: str, category: str, label: str, least: int = 1):
        checked = tables.check_headers(heads[files], presets.HEADER_COLUMNS, category, least)
        year = F.regexp_extract("path", listing.YEAR_FOLDER, 1).cast("int")
        return checked.select(year.alias("year"), F.lit(label).alias("category"), F.coalesce("problem", F.lit("ok")).alias("verdict"))

    heads = {n: tables.header_lines(t.spark, yearly_csv(t, [n])) for n in RAW}
    parts = [verdicts(n, n, n) for n in RAW]
    parts += [verdicts("lieux", "usagers", "lieux as usagers"), verdicts("lieux", "lieux", "large", 2**40)]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


@query(
    "src_read_csv_sniffed",
    "SELECT Num_Acc, CAST(vma AS VARCHAR) AS vma, CAST(catr AS VARCHAR) AS catr FROM lieux",
    "lieux",
)
def _(t: Tables):
    return tables.read_csv(t.spark, yearly_csv(t, ["lieux"])).select("Num_Acc", "vma", "catr")


def written_splits(t: Tables) -> str:
    path = work_path(t.spark, "splits")
    df = feature_table.train_test(feature_rows(t))
    sinks.write_splits(df, path)
    return path


def feature_rows(t: Tables):
    from .tables import feature_rows as rows

    return rows(t)


@query(
    "src_load_split",
    "SELECT Num_Acc, year_acc, grav, vma FROM imputed WHERE split = 'test'",
    "imputed",
)
def _(t: Tables):
    return tables.load_split(t.spark, written_splits(t), "test").select("Num_Acc", "year_acc", "grav", "vma")


@query("src_load_first_available", "SELECT c_custkey, c_name FROM customer")
def _(t: Tables):
    df = tables.load_first_available(t.spark, [t.path("missing_2024"), t.path("missing_2023"), t.path("customer")])
    return df.select("c_custkey", "c_name")


@query("sink_splits", "SELECT split, year_acc, count(*) AS n FROM imputed GROUP BY 1, 2", "imputed")
def _(t: Tables):
    df = t.spark.read.parquet(written_splits(t))
    return df.groupBy("split", "year_acc").agg(F.count(F.lit(1)).alias("n"))


@query("sink_predictions", "SELECT CAST(batch AS INT) AS batch_id, count(*) AS n, round(sum(p), 2) AS p FROM "
       "(SELECT event_id % 3 AS batch, round((value % 100) / 100, 4) AS p FROM events) GROUP BY 1")
def _(t: Tables):
    path = work_path(t.spark, "predictions")
    scored = t.events.select("event_id", ((F.col("value") % 100) / 100).alias("probability"))
    # two writers with the same batch numbers; the last batch comes twice, as after a retry
    for writer, batch in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 2)):
        rows = scored.filter((F.col("event_id") % 3 == batch) & (F.floor(F.col("event_id") / 3) % 2 == writer))
        sinks.append_predictions(sinks.stamp_predictions(rows, "rf:v1"), path, batch, f"job-{writer}")
    log = sinks.read_predictions(t.spark, path)
    return log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("probability"), 2).alias("p"))


@query(
    "sink_predictions_simdate",
    "SELECT event_id, 'rf:v1' AS model_version, '2023-07-15 12:00:00' AS created_at FROM events",
)
def _(t: Tables):
    scored = t.events.select("event_id", F.lit(0.5).alias("probability"))
    df = sinks.stamp_predictions(scored, "rf:v1", "2023-07")
    shown = F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return df.select("event_id", "model_version", shown.alias("created_at"))


@query(
    "sink_drift_json",
    "SELECT CAST(year AS INT) AS year, level, drifted AS drifted_count, share AS drift_share FROM year_summaries",
    "year_summaries",
)
def _(t: Tables):
    from .measures import yearly_summaries

    folder = work_path(t.spark, "drift")
    s = yearly_summaries(t)
    sinks.write_drift_reports(s, folder)
    kinds = "year int, level string, drifted_count bigint, drift_share double"
    return t.spark.read.schema(kinds).json(f"{folder}/reports").select("year", "level", "drifted_count", "drift_share")


@query("sink_reset", "SELECT count(*) AS removed, CAST(0 AS BIGINT) AS remaining FROM events")
def _(t: Tables):
    path = work_path(t.spark, "reset")
    t.events.select("event_id", "value").write.parquet(path)
    removed = sinks.reset(t.spark, path)
    left = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("remaining"))
    return left.select(F.lit(removed).cast("bigint").alias("removed"), "remaining")


@query("sink_fingerprint")
def _(t: Tables):
    return sinks.fingerprint(t.lineitem)


# ---- validation -----------------------------------------------------------------------------


@query(
    "val_files",
    """SELECT 'CRITICAL' AS level, t AS "table", 'file_discovery' AS "check", '0 files, 0 bytes' AS detail
    FROM (VALUES ('caracteristiques'), ('usagers')) v(t)""",
)
def _(t: Tables):
    found = listing.files(t.spark, yearly_csv(t, ["lieux", "vehicules"]))
    expected = found.select(
        F.when(F.col("year") % 2 == 0, F.lit("lieux")).otherwise(F.lit("vehicules")).alias("table"), "length",
        F.lit(None).cast("bigint").alias("rows"),
    )
    return validate.file_messages(expected, RAW)


@query(
    "val_required_columns",
    """SELECT 'CRITICAL' AS level, 'caracteristiques' AS "table", 'required_columns' AS "check",
      'missing: dep (' || count(*) || ' rows)' AS detail FROM orders
    UNION ALL SELECT 'INFO', 'lieux', 'required_columns', 'all present (' || count(*) || ' rows)' FROM orders""",
)
def _(t: Tables):
    a = validate.schema_messages(t.caracteristiques.drop("dep"), "caracteristiques")
    b = validate.schema_messages(t.lieux, "lieux")
    return a.unionByName(b).filter("check = 'required_columns'")


@query(
    "val_unknown_columns",
    """SELECT 'WARNING' AS level, 'lieux' AS "table", 'unknown_columns' AS "check", 'not in schema: voie (' || count(*) || ' rows)'
    AS detail FROM orders""",
)
def _(t: Tables):
    return validate.schema_messages(t.lieux, "lieux").filter("check = 'unknown_columns'")


@query(
    "val_coerce_types",
    """WITH f AS (SELECT count(*) FILTER (TRY_CAST(trim(replace(dep, chr(160), '')) AS INT) IS NULL) AS dep,
        count(*) FILTER (TRY_CAST(lat AS DOUBLE) IS NULL) AS lat FROM caracteristiques)
    SELECT 'caracteristiques' AS "table", c AS "column", n, dep + lat AS failures, CASE WHEN dep + lat = 0 THEN wanted ELSE 'string' END AS type
      FROM f, LATERAL (VALUES ('dep', dep, 'int'), ('lat', lat, 'double')) v(c, n, wanted)
    UNION ALL SELECT 'lieux', c, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'int' FROM (VALUES ('catr'), ('vma')) v(c)
      WHERE (SELECT count(*) FROM lieux) > 0""",
    "caracteristiques lieux",
)
def _(t: Tables):
    # one table that keeps its text, and one that takes its types
    cases = {
        "caracteristiques": (cleanse.clean_strings(t.caracteristiques), {"dep": ("int", None), "lat": ("double", None)}),
        "lieux": (t.lieux.select(F.col("catr").cast("string"), F.col("vma").cast("string")), {"catr": ("int", None), "vma": ("int", None)}),
    }
    parts = []
    for name, (df, wanted) in cases.items():
        typed, failures = validate.coerce(df, wanted)
        have = dict(typed.dtypes)
        kinds = F.create_map(*[F.lit(x) for c in wanted for x in (c, have[c])])
        counts = validate.counts_frame(df, validate.cast_failures(df, wanted))
        parts.append(
            counts.select(
                F.lit(name).alias("table"), "column", "n", F.lit(failures).cast("bigint").alias("failures"), kinds[F.col("column")].alias("type")
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "val_domain_checks",
    """SELECT 'place' AS "column", count(*) FILTER (place NOT BETWEEN 1 AND 9) AS n FROM usagers
    UNION ALL SELECT 'catu', count(*) FILTER (catu NOT IN (1, 2, 3)) FROM usagers
    UNION ALL SELECT 'grav', count(*) FILTER (grav NOT IN (1, 2, 3, 4)) FROM usagers""",
    "usagers",
)
def _(t: Tables):
    rules = {
        "place": ("int", ("range", 1, 9)), "catu": ("int", ("set", [1, 2, 3])), "grav": ("int", ("set", [1, 2, 3, 4])),
    }
    return validate.counts_frame(t.usagers, validate.domain_failures(t.usagers, rules))


@query(
    "val_row_count",
    """SELECT CASE WHEN count(*) BETWEEN 40000 AND 90000 THEN 'INFO' ELSE 'WARNING' END AS level, 'row_count' AS "check",
      count(*) || ' rows, expected 40000 to 90000' AS detail FROM orders""",
)
def _(t: Tables):
    df = validate.quality_messages(t.caracteristiques, "caracteristiques", presets.ROW_COUNT_BOUNDS)
    return df.filter("check = 'row_count'").select("level", "check", "detail")


@query(
    "val_null_rate",
    """SELECT 'surf' AS "column", round(avg(CASE WHEN surf IS NULL THEN 1 ELSE 0 END), 8) AS rate FROM lieux
    UNION ALL SELECT 'vma', round(avg(CASE WHEN vma IS NULL THEN 1 ELSE 0 END), 8) FROM lieux""",
    "lieux",
)
def _(t: Tables):
    return validate.null_rates(t.lieux, ["surf", "vma"]).withColumn("rate", F.round("rate", 8))


@query(
    "val_allowed_values",
    "SELECT 'severity_values' AS \"check\", count(*) || ' rows with an unknown severity' AS detail FROM usagers WHERE grav + catu > 4",
    "usagers",
)
def _(t: Tables):
    worse = t.usagers.withColumn("grav", F.col("grav") + F.col("catu"))
    worse = worse.withColumn("grav", F.when(F.col("grav") > 4, 5).otherwise(F.greatest("grav", F.lit(1))))
    return validate.quality_messages(worse, "usagers", severity="grav").filter("check = 'severity_values'").select("check", "detail")


@query(
    "val_bbox",
    """SELECT 'lat_long_range' AS "check", count(*) || ' rows outside the box' AS detail FROM (SELECT TRY_CAST(replace(lat, ',', '.') AS DOUBLE)
      AS a, TRY_CAST(replace(long, ',', '.') AS DOUBLE) AS o FROM caracteristiques) WHERE a < 41 OR a > 51.5 OR o < -5.5 OR o > 9.6""",
    "caracteristiques",
)
def _(t: Tables):
    df = validate.quality_messages(t.caracteristiques, "caracteristiques", lat_lon=("lat", "long"))
    return df.filter("check = 'lat_long_range'").select("check", "detail")


def full_report(t: Tables):
    frames, renamed = {}, {}
    for n in RAW:
        raw = t.__getattr__(n)
        if n == "caracteristiques":
            raw = raw.withColumnRenamed("Num_Acc", "Accident_Id")
        fixed, renamed[n] = cleanse.known_renames(raw, presets.COLUMN_RENAMES.get(n, {}))
        frames[n] = cleanse.clean_strings(fixed)
    return validate.validate_tables(frames, renamed)


STEPS["report_counts"] = (
    ("caracteristiques",),
    """SELECT count(*) AS n, count(*) FILTER (a < 41 OR a > 51.5 OR o < -5.5 OR o > 9.6) AS outside FROM (SELECT
      TRY_CAST(replace(lat, ',', '.') AS DOUBLE) AS a, TRY_CAST(replace(long, ',', '.') AS DOUBLE) AS o FROM caracteristiques)""",
)


@query(
    "val_report",
    """SELECT 'WARNING' AS overall, CAST(4 + 3 + 1 + 1 + CASE WHEN outside > 0 THEN 1 ELSE 0 END AS BIGINT) AS messages
    FROM report_counts""",
    "report_counts",
)
def _(t: Tables):
    # four required-column notes, three unknown-column warnings, one rename, the box and the row count
    return validate.overall(full_report(t))


@query(
    "val_gate",
    """SELECT 'INFO' AS level, CAST(4 + CASE WHEN n BETWEEN 40000 AND 90000 THEN 1 ELSE 0 END AS BIGINT) AS n, 'WARNING' AS gate FROM report_counts
    UNION ALL SELECT 'AUTO_CORRECTED', 1, 'WARNING' FROM report_counts
    UNION ALL SELECT 'WARNING', 3 + CASE WHEN n BETWEEN 40000 AND 90000 THEN 0 ELSE 1 END + CASE WHEN outside > 0 THEN 1 ELSE 0 END, 'WARNING'
    FROM report_counts""",
    "report_counts",
)
def _(t: Tables):
    messages = full_report(t)
    level = validate.gate(messages)
    return messages.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("gate", F.lit(level))


PAYLOAD_FIELDS = {f: ("double" if f in presets.FLOAT_FEATURES else "int") for f in presets.MODEL_FEATURES}


def payloads(t: Tables):
    """Scoring requests: complete ones, ones without ``secu1`` and ones with text for ``vma``."""
    body = {f: (F.col("o_orderkey") % (7 + i)).cast("string") for i, f in enumerate(PAYLOAD_FIELDS)}
    kind = F.col("o_orderkey") % 10
    body["secu1"] = F.when(kind != 0, body["secu1"])
    body["vma"] = F.when(kind == 1, F.lit("rapide")).otherwise(body["vma"])
    body["extra"] = F.lit("ignored")
    return t.orders.select("o_orderkey", F.to_json(F.struct(*[c.alias(f) for f, c in body.items()])).alias("body"))


@query(
    "val_payload",
    "SELECT o_orderkey, o_orderkey % 10 NOT IN (0, 1) AS ok, CASE WHEN o_orderkey % 10 <> 1 THEN CAST(o_orderkey % 19 AS DOUBLE) END AS vma FROM orders",
)
def _(t: Tables):
    return validate.read_payload(payloads(t), "body", PAYLOAD_FIELDS).select("o_orderkey", "ok", "vma")


@query(
    "val_missing_pct",
    """SELECT 'surf' AS "column", round(avg(CASE WHEN surf IS NULL THEN 100 ELSE 0 END), 6) AS pct FROM lieux
    UNION ALL SELECT c, 0.0::DOUBLE FROM (VALUES ('Num_Acc'), ('catr'), ('circ'), ('situ'), ('vma'), ('voie')) v(c)""",
    "lieux",
)
def _(t: Tables):
    return validate.missing_percent(t.lieux).withColumn("pct", F.round("pct", 6))


@query(
    "val_drop_sparse",
    "SELECT o_orderkey, o_custkey FROM orders",
)
def _(t: Tables):
    rare = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderpriority"))
    return validate.drop_sparse(t.orders.select("o_orderkey", "o_custkey", rare.alias("rare")))

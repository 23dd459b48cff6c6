"""Three-level validation of raw tables.

Every level-2 and level-3 check of a table is a counter in one aggregate over that table; the single
result row then unfolds into messages ``(level, table, check, detail)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from ..functions import geo, text

MESSAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("level", "table", "check", "detail")])
SEVERITY = {"OK": 0, "INFO": 0, "AUTO_CORRECTED": 0, "WARNING": 1, "CRITICAL": 2}


class ValidationError(RuntimeError):
    """Raised by the gate on a CRITICAL report."""


def message(level: Column | str, table: str, check: str, detail: Column) -> Column:
    lvl = F.lit(level) if isinstance(level, str) else level
    return F.struct(
        lvl.alias("level"), F.lit(table).alias("table"), F.lit(check).alias("check"), detail.alias("detail")
    )


# ---- counters -------------------------------------------------------------------------------


#: Least and greatest value of the whole-number types.
WHOLE = {"int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def cast_failures(df: DataFrame, schema: Mapping[str, tuple]) -> dict[str, Column]:
    """Per column: values that cannot take the declared type. A column already of its type costs nothing."""
    have = dict(df.dtypes)

    def failures(c: str, kind: str) -> Column:
        if have[c] == kind or kind == "string":
            return F.lit(0).cast("bigint")
        if have[c] in ("double", "float") and kind in WHOLE:
            # whole numbers stand as doubles where a column has nulls
            least, most = WHOLE[kind]
            fits = (F.col(c) == F.floor(F.col(c))) & F.col(c).between(least, most)
            return F.count_if(F.col(c).isNotNull() & ~F.coalesce(fits, F.lit(False)))
        return F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(kind).isNull())

    return {c: failures(c, kind) for c, (kind, _) in schema.items() if c in have}


def _number(df: DataFrame, column: str) -> Column:
    """The column as a number, unreadable text as NULL."""
    return F.col(column).try_cast("double") if dict(df.dtypes)[column] == "string" else F.col(column)


def _violates(value: Column, check: tuple) -> Column:
    ok = value.between(check[1], check[2]) if check[0] == "range" else value.isin(list(check[1]))
    return F.coalesce(~ok, F.lit(False))


def domain_failures(df: DataFrame, schema: Mapping[str, tuple]) -> dict[str, Column]:
    """Per checked column: known values outside their range or set."""
    return {
        c: F.count_if(_violates(_number(df, c), check))
        for c, (_, check) in schema.items()
        if check and c in df.columns
    }


def missing_values(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Per declared non-null column: rows without a value. A NaN of a numeric column has none."""
    have = dict(df.dtypes)

    def missing(c: str) -> Column:
        gone = F.col(c).isNull()
        return F.count_if(gone | F.isnan(c)) if have[c] in ("double", "float") else F.count_if(gone)

    return {c: missing(c) for c in columns if c in have}


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, rate)`` from one pass."""
    names = list(columns or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in names])
    return row.unpivot([], names, "column", "rate")


def counts_frame(df: DataFrame, counters: Mapping[str, Column], name: str = "n") -> DataFrame:
    """``(column, n)`` rows for a dictionary of counters, from one pass."""
    row = df.agg(*[c.alias(k) for k, c in counters.items()])
    return row.unpivot([], list(counters), "column", name)


# ---- level 1 --------------------------------------------------------------------------------


def file_messages(listing: DataFrame, tables: Sequence[str]) -> DataFrame:
    """CRITICAL for every expected table without a file, with only empty files, or without rows.

    ``listing`` has ``table``, ``length`` and ``rows`` (rows may be NULL when not probed).
    """
    spark = listing.sparkSession
    expected = spark.createDataFrame([(t,) for t in tables], "table string")
    seen = listing.groupBy("table").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("rows").alias("rows")
    )
    found = expected.join(seen, "table", "left")
    problem = (
        F.when(F.coalesce("files", F.lit(0)) == 0, F.lit("file_discovery"))
        .when(F.col("bytes") == 0, F.lit("file_nonempty"))
        .when(F.col("rows") == 0, F.lit("file_nonempty"))
    )
    return found.select(
        F.lit("CRITICAL").alias("level"), "table", problem.alias("check"),
        F.concat(F.coalesce("files", F.lit(0)).cast("string"), F.lit(" files, "),
                 F.coalesce("bytes", F.lit(0)).cast("string"), F.lit(" bytes")).alias("detail"),
    ).filter(F.col("check").isNotNull())


# ---- level 2 --------------------------------------------------------------------------------


def required_columns(columns: Sequence[str], table: str, required: Sequence[str], rows: Column) -> Column:
    missing = sorted(set(required) - set(columns))
    affected = F.concat(F.lit(" ("), rows.cast("string"), F.lit(" rows)"))
    if missing:
        return message("CRITICAL", table, "required_columns", F.concat(F.lit("missing: " + ", ".join(missing)), affected))
    return message("INFO", table, "required_columns", F.concat(F.lit("all present"), affected))


def unknown_columns(columns: Sequence[str], table: str, known: Sequence[str], rows: Column) -> Column:
    unknown = sorted(set(columns) - set(known))
    affected = F.concat(F.lit(" ("), rows.cast("string"), F.lit(" rows)"))
    level = "WARNING" if unknown else None
    return message(
        F.lit(level).cast("string"), table, "unknown_columns", F.concat(F.lit("not in schema: " + ", ".join(unknown)), affected)
    )


def changed_types(df: DataFrame, schema: Mapping[str, tuple]) -> list[str]:
    """Columns whose stored type differs from the declared one."""
    have = dict(df.dtypes)
    return [c for c, (kind, _) in schema.items() if c in have and have[c] != kind]


def _schema_checks(
    df: DataFrame, table: str, schema: Mapping[str, tuple], required: Sequence[str], renamed: Sequence[str],
    not_null: Sequence[str] | None = None,
) -> tuple[dict[str, Column], list[Column]]:
    """Counters of level 2 and the messages built on them."""
    bad = {f"type:{c}": n for c, n in cast_failures(df, schema).items()}
    bad |= {f"domain:{c}": n for c, n in domain_failures(df, schema).items()}
    not_null = presets.NOT_NULL_COLUMNS.get(table, ()) if not_null is None else not_null
    bad |= {f"nullable:{c}": n for c, n in missing_values(df, not_null).items()}
    listed = F.array_compact(
        F.array(
            *[F.when(F.col(f"`{k}`") > 0, F.concat(F.lit(f"{k}="), F.col(f"`{k}`").cast("string"))) for k in bad]
        )
    )
    changed = changed_types(df, schema)
    clean = "AUTO_CORRECTED" if changed else None
    out = [
        required_columns(df.columns, table, required, F.col("rows")),
        unknown_columns(df.columns, table, [*schema, *required], F.col("rows")),
        message(F.when(F.size(listed) > 0, F.lit("WARNING")), table, "type_check", F.array_join(listed, ", ")),
        message(
            F.when(F.size(listed) == 0, F.lit(clean).cast("string")), table, "type_coercion", F.lit(", ".join(changed))
        ),
    ]
    if renamed:
        out.append(message("AUTO_CORRECTED", table, "column_rename", F.lit(", ".join(renamed))))
    return bad, out


def _unfold(df: DataFrame, counters: Mapping[str, Column], messages: Sequence[Column]) -> DataFrame:
    """Run all counters in one aggregate and keep the messages that apply."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[n.alias(k) for k, n in counters.items()])
    return row.select(F.inline(F.array(*messages))).filter(F.col("level").isNotNull())


def schema_messages(
    df: DataFrame, table: str, schema: Mapping[str, tuple] | None = None, required: Sequence[str] | None = None,
    renamed: Sequence[str] = (),
) -> DataFrame:
    """Level 2 of one table: required and unknown columns, types and domains."""
    schema = presets.TABLE_SCHEMAS[table] if schema is None else schema
    required = presets.REQUIRED_COLUMNS[table] if required is None else required
    return _unfold(df, *_schema_checks(df, table, schema, required, renamed))


def coerce(df: DataFrame, schema: Mapping[str, tuple], not_null: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """The table in its declared types, or unchanged when any value fails a cast or a check or is missing in ``not_null``.

    The decision changes the schema, so it needs one small row of counters on the driver.
    """
    counters = [*cast_failures(df, schema).values(), *domain_failures(df, schema).values(), *missing_values(df, not_null).values()]
    failures = df.agg(sum(counters, F.lit(0)).alias("n")).first()["n"]
    if failures:
        return df, failures
    have = dict(df.dtypes)
    edits = {c: F.col(c).cast(kind) for c, (kind, _) in schema.items() if c in have and have[c] != kind}
    return df.withColumns(edits), 0


# ---- level 3 --------------------------------------------------------------------------------


def _quality_checks(
    df: DataFrame, table: str, count_bounds: tuple[int, int] | None, null_limit: float, severity: str | None,
    lat_lon: tuple[str, str] | None,
) -> tuple[dict[str, Column], list[Column]]:
    """Counters of level 3 and the messages built on them; checks on absent columns are skipped."""
    counters: dict[str, Column] = {f"null:{c}": F.avg(F.col(c).isNull().cast("int")) for c in df.columns}
    out = []
    for c in df.columns:
        rate = F.col(f"`null:{c}`")
        out.append(
            message(
                F.when(rate > null_limit, F.lit("WARNING")), table, f"nan_rate_{c}",
                F.concat(F.round(rate * 100, 1).cast("string"), F.lit("% missing")),
            )
        )
    if count_bounds:
        low, high = count_bounds
        out.append(
            message(
                F.when(F.col("rows").between(low, high), F.lit("INFO")).otherwise(F.lit("WARNING")), table, "row_count",
                F.concat(F.col("rows").cast("string"), F.lit(f" rows, expected {low} to {high}")),
            )
        )
    if severity in df.columns:
        s = _number(df, severity)
        counters["severity"] = F.count_if(s.isNull() | ~s.isin(presets.SEVERITY_VALUES))
        out.append(
            message(
                F.when(F.col("severity") > 0, F.lit("WARNING")), table, "severity_values",
                F.concat(F.col("severity").cast("string"), F.lit(" rows with an unknown severity")),
            )
        )
    if lat_lon and set(lat_lon) <= set(df.columns):
        lat, lon = (text.decimal_comma(F.col(c)) for c in lat_lon)
        counters["box"] = F.count_if(
            geo.outside_box(lat, lon, presets.LAT_BOUNDS, presets.LON_BOUNDS_VALIDATION)
        )
        out.append(
            message(
                F.when(F.col("box") > 0, F.lit("WARNING")), table, "lat_long_range",
                F.concat(F.col("box").cast("string"), F.lit(" rows outside the box")),
            )
        )
    return counters, out


def quality_messages(
    df: DataFrame, table: str, count_bounds: tuple[int, int] | None = None,
    null_limit: float = presets.NULL_RATE_LIMIT, severity: str | None = None,
    lat_lon: tuple[str, str] | None = None,
) -> DataFrame:
    """Level 3 of one table: row count, null rates, severity values and the coordinate box."""
    return _unfold(df, *_quality_checks(df, table, count_bounds, null_limit, severity, lat_lon))


# ---- report ---------------------------------------------------------------------------------


def report(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def overall(messages: DataFrame) -> DataFrame:
    """One row: CRITICAL over WARNING over OK; corrections and notes do not raise it."""
    code = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[F.col("level")]
    worst = F.coalesce(F.max(code), F.lit(0))
    level = F.when(worst == 2, F.lit("CRITICAL")).when(worst == 1, F.lit("WARNING")).otherwise(F.lit("OK"))
    return messages.agg(level.alias("overall"), F.count(F.lit(1)).alias("messages"))


def gate(messages: DataFrame) -> str:
    """Overall level; stops with an error on CRITICAL. Brings one row to the driver."""
    level = overall(messages).first()["overall"]
    if level == "CRITICAL":
        raise ValidationError("validation report is CRITICAL")
    return level


def validate_tables(tables: Mapping[str, DataFrame], renamed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Levels 2 and 3 of the four raw tables: one scan and one aggregate per table."""
    renamed = renamed or {}
    frames = []
    for name, df in tables.items():
        is_main = name == "caracteristiques"
        two = _schema_checks(
            df, name, presets.TABLE_SCHEMAS[name], presets.REQUIRED_COLUMNS[name], renamed.get(name, ())
        )
        three = _quality_checks(
            df, name, presets.ROW_COUNT_BOUNDS if is_main else None, presets.NULL_RATE_LIMIT,
            "grav" if name == "usagers" else None, ("lat", "long") if is_main else None,
        )
        frames.append(_unfold(df, two[0] | three[0], two[1] + three[1]))
    return report(frames)


# ---- payloads -------------------------------------------------------------------------------


def read_payload(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """Parse a JSON request; ``ok`` is false when a field is missing or has the wrong type.

    Fields are read as text and cast, so numbers written as text pass and extra fields are ignored.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    parsed = df.withColumn("_p", F.from_json(F.col(column), schema))

    def typed(name: str, kind: str) -> Column:
        number = F.col("_p")[name].try_cast("double")
        if kind == "int":
            return F.when(number == F.floor(number), number.try_cast("int"))
        return number

    values = {f: typed(f, kind) for f, kind in fields.items()}
    out = parsed.withColumns(values).drop("_p")
    return out.withColumn("ok", reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields]))


def split_payloads(parsed: DataFrame, column: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows with typed fields, and rejected rows with their text."""
    return parsed.filter("ok").drop("ok"), parsed.filter(~F.col("ok")).drop("ok", *fields)


# ---- exploration ----------------------------------------------------------------------------


def missing_percent(df: DataFrame) -> DataFrame:
    return null_rates(df).select("column", (F.col("rate") * 100).alias("pct")).orderBy(F.col("pct").desc(), "column")


def drop_sparse(df: DataFrame, limit: float = presets.SPARSE_LIMIT) -> DataFrame:
    """Drop columns with a larger share of NULLs; reads one row of rates to fix the schema."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if rates[c] is not None and rates[c] > limit])

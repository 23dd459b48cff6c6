"""Cleansing, joins, aggregates, picks, features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..functions import geo, when
from ..operators import aggregate, cleanse, features, hotspots, joins, rank
from ..plans import feature_table
from .base import Tables, query
from .steps import sql_case, sql_int, sql_tidy

# ---- cleansing ------------------------------------------------------------------------------


@query(
    "proj_known_renames",
    "SELECT Num_Acc, jour, 'Accident_Id' AS renamed FROM caracteristiques",
    "caracteristiques",
)
def _(t: Tables):
    old = t.caracteristiques.withColumnRenamed("Num_Acc", "Accident_Id")
    df, renamed = cleanse.known_renames(old, presets.COLUMN_RENAMES["caracteristiques"])
    return df.select("Num_Acc", "jour", F.lit(",".join(renamed)).alias("renamed"))


@query(
    "proj_clean_strings",
    f"SELECT Num_Acc, {sql_tidy('hrmn')} AS hrmn, {sql_tidy('dep')} AS dep, {sql_tidy('com')} AS com, "
    f"{sql_tidy('adr')} AS adr FROM caracteristiques",
    "caracteristiques",
)
def _(t: Tables):
    return cleanse.clean_strings(t.caracteristiques).select("Num_Acc", "hrmn", "dep", "com", "adr")


@query(
    "proj_decimal_comma",
    "SELECT Num_Acc, TRY_CAST(replace(lat, ',', '.') AS DOUBLE) AS lat, "
    "TRY_CAST(replace(long, ',', '.') AS DOUBLE) AS long FROM caracteristiques",
    "caracteristiques",
)
def _(t: Tables):
    return cleanse.decimal_commas(t.caracteristiques.select("Num_Acc", "lat", "long"), ["lat", "long"])


@query(
    "proj_hour",
    f"SELECT Num_Acc, {sql_int('substr(hrmn, 1, greatest(length(hrmn) - 3, 0))')} AS hour FROM caracteristiques",
    "caracteristiques",
)
def _(t: Tables):
    return cleanse.hours(t.caracteristiques, "hrmn", "hour").select("Num_Acc", "hour")


@query(
    "proj_corsica",
    "SELECT Num_Acc, replace(replace(dep, '2A', '201'), '2B', '202') AS dep, "
    "replace(replace(com, '2A', '201'), '2B', '202') AS com FROM caracteristiques",
    "caracteristiques",
)
def _(t: Tables):
    df = t.caracteristiques.select("Num_Acc", "dep", "com")
    return cleanse.replace_text(df, ["dep", "com"], presets.DEPARTMENT_LETTERS)


@query(
    "proj_numeric_or_zero",
    f"SELECT Num_Acc, {sql_int(sql_tidy('dep'))} AS dep, {sql_int(sql_tidy('com'))} AS com FROM caracteristiques",
    "caracteristiques",
)
def _(t: Tables):
    df = cleanse.clean_strings(t.caracteristiques.select("Num_Acc", "dep", "com"))
    return cleanse.numeric_or_zero(df, ["dep", "com"])


@query(
    "proj_recode_map",
    f"""SELECT Num_Acc, 'grav' AS col, {sql_case('grav', presets.SEVERITY_RECODE)} AS value FROM usagers
    UNION ALL SELECT Num_Acc, 'atm', {sql_case('atm', presets.WEATHER_RECODE)} FROM caracteristiques
    UNION ALL SELECT Num_Acc, 'catv', {sql_case('catv', presets.VEHICLE_RECODE)} FROM vehicules""",
    "usagers caracteristiques vehicules",
)
def _(t: Tables):
    parts = [
        ("grav", t.usagers, presets.SEVERITY_RECODE),
        ("atm", t.caracteristiques, presets.WEATHER_RECODE),
        ("catv", t.vehicules, presets.VEHICLE_RECODE),
    ]
    return cleanse.union_years(
        [
            cleanse.recode(df, c, m).select("Num_Acc", F.lit(c).alias("col"), F.col(c).alias("value"))
            for c, df, m in parts
        ]
    )


@query(
    "proj_target_binary",
    "SELECT Num_Acc, grav, CASE WHEN grav IN (1, 2) THEN 0 WHEN grav IN (3, 4) THEN 1 ELSE grav END AS target "
    "FROM usagers",
    "usagers",
)
def _(t: Tables):
    df = t.usagers.select("Num_Acc", "grav", F.col("grav").alias("target"))
    return cleanse.recode(df, "target", presets.TARGET_RECODE)


@query(
    "proj_sentinel_null",
    """SELECT Num_Acc, 'veh' AS src, CAST(nullif(nullif(catv, -1), 0) AS DOUBLE) AS a,
      CAST(nullif(obsm, -1) AS DOUBLE) AS b, CAST(nullif(nullif(motor, -1), 0) AS DOUBLE) AS c FROM vehicules
    UNION ALL SELECT Num_Acc, 'usr', nullif(secu1, -1), CAST(nullif(nullif(trajet, -1), 0) AS DOUBLE), CAST(place AS DOUBLE)
      FROM usagers
    UNION ALL SELECT Num_Acc, 'loc', CAST(nullif(circ, -1) AS DOUBLE), CAST(nullif(surf, -1) AS DOUBLE),
      CAST(nullif(situ, -1) AS DOUBLE) FROM lieux
    UNION ALL SELECT Num_Acc, 'vma', CAST(nullif(vma, -1) AS DOUBLE), CAST(catr AS DOUBLE), CAST(nullif(circ, -1) AS DOUBLE) FROM lieux
    UNION ALL SELECT Num_Acc, 'car', CAST(nullif(atm, -1) AS DOUBLE), CAST(nullif(col, -1) AS DOUBLE), CAST(lum AS DOUBLE) FROM caracteristiques""",
    "vehicules usagers lieux caracteristiques",
)
def _(t: Tables):
    marks = {-1: presets.NULL_IF_MINUS_ONE, 0: presets.NULL_IF_ZERO}

    def part(df, src, cols):
        out = cleanse.sentinels_to_null(df, marks)
        return out.select(
            "Num_Acc", F.lit(src).alias("src"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, "abc")]
        )

    return cleanse.union_years(
        [
            part(t.vehicules, "veh", ["catv", "obsm", "motor"]),
            part(t.usagers, "usr", ["secu1", "trajet", "place"]),
            part(t.lieux, "loc", ["circ", "surf", "situ"]),
            part(t.lieux, "vma", ["vma", "catr", "circ"]),
            part(t.caracteristiques, "car", ["atm", "col", "lum"]),
        ]
    )


@query(
    "proj_rename",
    'SELECT Num_Acc, agg AS agg_, "int" AS intersection_type FROM caracteristiques',
    "caracteristiques",
)
def _(t: Tables):
    df = t.caracteristiques.select("Num_Acc", "agg", "int")
    return cleanse.rename(df, {"agg": "agg_", "int": "intersection_type"})


@query("proj_drop_if_present", "SELECT place, catu, grav, sexe, an_nais, secu1 FROM usagers", "usagers")
def _(t: Tables):
    return cleanse.drop_if_present(t.usagers, presets.TECHNICAL_COLUMNS)


@query(
    "filter_critical_nulls",
    "SELECT * FROM lieux WHERE surf IS NOT NULL AND vma IS NOT NULL",
    "lieux",
)
def _(t: Tables):
    return cleanse.drop_critical_nulls(t.lieux, ["surf", "vma", "atm"])


@query(
    "proj_fill_missing_columns",
    "SELECT Num_Acc, CAST(0 AS INT) AS nbv, CAST(0 AS INT) AS prof, vma, catr FROM lieux",
    "lieux",
)
def _(t: Tables):
    return cleanse.fill_missing_columns(t.lieux, ["Num_Acc", "nbv", "prof", "vma", "catr"])


@query(
    "proj_model_casts",
    "SELECT Num_Acc, CAST(circ AS DOUBLE) AS circ, CAST(surf AS DOUBLE) AS surf, CAST(situ AS DOUBLE) AS situ, "
    "CAST(vma AS DOUBLE) AS vma, catr FROM lieux",
    "lieux",
)
def _(t: Tables):
    df = cleanse.cast_columns(t.lieux, presets.FLOAT_FEATURES)
    return df.select("Num_Acc", "circ", "surf", "situ", "vma", "catr")


@query(
    "proj_datetime",
    """SELECT Num_Acc, strftime(try_strptime(lpad(CAST(an AS VARCHAR), 4, '0') || '-' || lpad(CAST(mois AS VARCHAR), 2, '0')
      || '-' || lpad(CAST(jour AS VARCHAR), 2, '0') || ' ' || hrmn, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M:%S') AS ts
    FROM caracteristiques""",
    "caracteristiques",
)
def _(t: Tables):
    df = cleanse.with_datetime(t.caracteristiques, "an", "mois", "jour", "hrmn", "ts")
    return df.select("Num_Acc", when.stamp(F.col("ts")).alias("ts"))


@query(
    "proj_letter_codes",
    "SELECT o_orderkey, TRY_CAST(replace(replace(code, 'A', '10'), 'B', '11') AS INT) AS code "
    "FROM (SELECT o_orderkey, CASE o_custkey % 12 WHEN 10 THEN 'A' WHEN 11 THEN 'B' "
    "ELSE CAST(o_custkey % 12 AS VARCHAR) END AS code FROM orders)",
)
def _(t: Tables):
    df = t.orders.selectExpr(
        "o_orderkey",
        "CASE o_custkey % 12 WHEN 10 THEN 'A' WHEN 11 THEN 'B' ELSE CAST(o_custkey % 12 AS STRING) END AS code",
    )
    return cleanse.letter_codes(df, ["code"], {"A": "10", "B": "11"})


@query("filter_month", "SELECT Num_Acc, mois FROM caracteristiques WHERE mois = 6", "caracteristiques")
def _(t: Tables):
    return cleanse.in_month(t.caracteristiques, "mois", "2024-06").select("Num_Acc", "mois")


@query("filter_in_list", "SELECT Num_Acc, catr FROM lieux WHERE catr IN (1, 3)", "lieux")
def _(t: Tables):
    return cleanse.in_list(cleanse.in_list(t.lieux, "catr", [1, 3]), "vma", []).select("Num_Acc", "catr")


@query(
    "filter_text_any_column",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(concat_ws(chr(31), "
    "CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)), 'auto')",
)
def _(t: Tables):
    return cleanse.any_column_contains(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "AUTO")


@query(
    "proj_union_years",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, o_orderkey, CASE WHEN year(o_orderdate) >= 1996 THEN o_orderpriority END AS prio
    FROM orders WHERE o_orderdate IS NOT NULL""",
)
def _(t: Tables):
    year = F.year("o_orderdate")
    found = sorted(r[0] for r in t.orders.select(year).distinct().dropna().collect())

    def one(y: int):
        # the first years know no priority
        prio = [F.col("o_orderpriority").alias("prio")] if y >= 1996 else []
        return t.orders.filter(year == y).select(F.lit(y).cast("bigint").alias("yr"), "o_orderkey", *prio)

    return cleanse.union_years([one(y) for y in found])


# ---- joins ----------------------------------------------------------------------------------


@query(
    "join_inner_composite",
    "SELECT Num_Acc, num_veh, id_usager, grav, catv FROM usagers JOIN vehicules USING (Num_Acc, num_veh, id_vehicule)",
    "usagers vehicules",
)
def _(t: Tables):
    df = joins.inner(t.usagers, t.vehicules, ["Num_Acc", "num_veh", "id_vehicule"])
    return df.select("Num_Acc", "num_veh", "id_usager", "grav", "catv")


@query(
    "join_left",
    "SELECT u.Num_Acc, id_usager, vma, mois FROM usagers u LEFT JOIN lieux l ON u.Num_Acc = l.Num_Acc "
    "LEFT JOIN caracteristiques c ON u.Num_Acc = c.Num_Acc",
    "usagers lieux caracteristiques",
)
def _(t: Tables):
    df = joins.left_outer(t.usagers, t.lieux, ["Num_Acc"])
    return joins.left_outer(df, t.caracteristiques, ["Num_Acc"]).select("Num_Acc", "id_usager", "vma", "mois")


@query(
    "join_counts",
    "SELECT Num_Acc, vma, nb_victim, nb_vehicules FROM lieux JOIN (SELECT Num_Acc, count(*) AS nb_victim FROM usagers "
    "GROUP BY 1) USING (Num_Acc) JOIN (SELECT Num_Acc, count(*) AS nb_vehicules FROM vehicules GROUP BY 1) USING (Num_Acc)",
    "usagers vehicules lieux",
)
def _(t: Tables):
    df = joins.with_counts(t.lieux.select("Num_Acc", "vma"), t.usagers, "Num_Acc", "nb_victim")
    return joins.with_counts(df, t.vehicules, "Num_Acc", "nb_vehicules")


@query(
    "join_label_align",
    "SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id)",
)
def _(t: Tables):
    return joins.align_labels(
        t.documents.select("doc_id", "lang", "n_chars"), t.labels.select("doc_id", "quality"), "doc_id"
    )


# ---- aggregates -----------------------------------------------------------------------------


@query("agg_count_per_key", "SELECT Num_Acc, count(*) AS nb_victim FROM usagers GROUP BY 1", "usagers")
def _(t: Tables):
    return aggregate.count_per_key(t.usagers, ["Num_Acc"], "nb_victim")


GRID = "round_even({x} * {c}, 0) / {c}"
SEVERE = "CASE WHEN grav IN (2, 3) THEN 1 ELSE 0 END"


def incident_points(t: Tables):
    """One labelled point per incident: its most severe user at the incident's coordinates."""
    users = feature_table.prepare_users(t.usagers).select("Num_Acc", "grav")
    worst = users.groupBy("Num_Acc").agg(F.max("grav").alias("grav"))
    worst = cleanse.recode(worst.filter("grav > 0"), "grav", presets.TARGET_RECODE)
    places = cleanse.decimal_commas(t.caracteristiques.select("Num_Acc", "lat", "long"), ["lat", "long"])
    return worst.join(places, "Num_Acc")


POINTS = f"""SELECT Num_Acc, {sql_case('g', presets.TARGET_RECODE)} AS grav,
  TRY_CAST(replace(lat, ',', '.') AS DOUBLE) AS lat, TRY_CAST(replace(long, ',', '.') AS DOUBLE) AS long
  FROM (SELECT Num_Acc, max({sql_case('grav', presets.SEVERITY_RECODE)}) AS g FROM usagers GROUP BY 1)
  JOIN caracteristiques USING (Num_Acc) WHERE g > 0"""
CELLS = f"""SELECT {GRID.format(x='lat', c=2)} AS lat_r, {GRID.format(x='long', c=2)} AS lon_r, count(*) AS n,
  avg(grav) AS rate FROM points WHERE lat BETWEEN 41 AND 51.5 AND long BETWEEN -5.5 AND 9.5 GROUP BY 1, 2"""


@query(
    "geo_bbox",
    f"WITH points AS ({POINTS}) SELECT Num_Acc, lat, long FROM points WHERE lat BETWEEN 41 AND 51.5 AND long BETWEEN -5.5 AND 9.5",
    "usagers caracteristiques",
)
def _(t: Tables):
    box = geo.in_box(F.col("lat"), F.col("long"), presets.LAT_BOUNDS, presets.LON_BOUNDS_HOTSPOTS)
    return incident_points(t).filter(box).select("Num_Acc", "lat", "long")


@query(
    "geo_grid",
    f"""WITH points AS ({POINTS}) SELECT Num_Acc, {GRID.format(x='lat', c=200)} AS lat_r,
    {GRID.format(x='long', c=200)} AS lon_r FROM points""",
    "usagers caracteristiques",
)
def _(t: Tables):
    return incident_points(t).select(
        "Num_Acc", geo.grid_cell(F.col("lat"), 200).alias("lat_r"), geo.grid_cell(F.col("long"), 200).alias("lon_r")
    )


@query(
    "agg_grid_rate",
    f"WITH points AS ({POINTS}), cells AS ({CELLS}) SELECT lat_r, lon_r, n, round(rate, 6) AS rate FROM cells",
    "usagers caracteristiques",
)
def _(t: Tables):
    cells = hotspots.cell_rates(incident_points(t), "lat", "long", "grav", 2)
    return cells.select("lat_r", "lon_r", "n", F.round("rate", 6).alias("rate"))


@query(
    "agg_having",
    f"""WITH points AS ({POINTS}), cells AS ({CELLS}) SELECT lat_r, lon_r, n, round(rate, 6) AS rate FROM cells
    WHERE rate >= 0.3 AND n >= 5""",
    "usagers caracteristiques",
)
def _(t: Tables):
    cells = aggregate.having(hotspots.cell_rates(incident_points(t), "lat", "long", "grav", 2), 0.3, 5)
    return cells.select("lat_r", "lon_r", "n", F.round("rate", 6).alias("rate"))


@query(
    "geo_hotspots",
    f"""WITH points AS ({POINTS}), cells AS ({CELLS}), kept AS (SELECT * FROM cells WHERE rate >= 0.3 AND n >= 3)
    SELECT lat_r, lon_r, n, round_even(rate * 100, 1) AS pct, (SELECT count(*) FROM kept) AS n_cells FROM kept
    ORDER BY rate DESC, lat_r, lon_r LIMIT 10""",
    "usagers caracteristiques",
)
def _(t: Tables):
    return hotspots.hotspots(incident_points(t), "lat", "long", "grav", 2, 0.3, 3)


@query(
    "agg_mode",
    """WITH v AS (SELECT 'catr' AS feature, catr AS value FROM lieux UNION ALL SELECT 'circ', circ FROM lieux
      UNION ALL SELECT 'surf', surf FROM lieux UNION ALL SELECT 'vma', vma FROM lieux)
    SELECT feature, CAST(value AS DOUBLE) AS value FROM (SELECT feature, value, count(*) AS n FROM v WHERE value IS NOT NULL
      GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1""",
    "lieux",
)
def _(t: Tables):
    return aggregate.modes(t.lieux, ["catr", "circ", "surf", "vma"])


@query(
    "agg_crosstab",
    "SELECT catu, count(*) FILTER (grav = 1) AS grav_1, count(*) FILTER (grav = 2) AS grav_2, "
    "count(*) FILTER (grav = 3) AS grav_3, count(*) FILTER (grav = 4) AS grav_4 FROM usagers GROUP BY 1",
    "usagers",
)
def _(t: Tables):
    return aggregate.crosstab(t.usagers, "catu", "grav", [1, 2, 3, 4])


@query(
    "agg_value_share",
    "SELECT grav, count(*) AS n, round(count(*) / (SELECT count(*) FROM usagers), 8) AS share FROM usagers GROUP BY 1",
    "usagers",
)
def _(t: Tables):
    return aggregate.value_share(t.usagers, "grav").withColumn("share", F.round("share", 8))


@query(
    "agg_distinct_values",
    """SELECT DISTINCT 'lum' AS feature, CAST(lum AS VARCHAR) AS value FROM caracteristiques
    UNION ALL SELECT DISTINCT 'dep', dep FROM caracteristiques UNION ALL SELECT DISTINCT 'adr', adr FROM caracteristiques""",
    "caracteristiques",
)
def _(t: Tables):
    return aggregate.distinct_values(t.caracteristiques, ["lum", "dep", "adr"])


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "agg_corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, "
        + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)")
        + " AS r FROM lineitem"
        + (" GROUP BY 1" if a == b else "")
        for a in CORR
        for b in CORR
    ),
)
def _(t: Tables):
    return aggregate.correlation_matrix(t.lineitem, CORR).withColumn("r", F.round("r", 6))


@query("agg_class_balance", "SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def _(t: Tables):
    return aggregate.class_balance(t.labels, "quality")


@query(
    "agg_share_positive",
    "SELECT catu, round(avg(CASE WHEN grav IN (2, 3) THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct FROM usagers GROUP BY 1",
    "usagers",
)
def _(t: Tables):
    df = t.usagers.select("catu", F.col("grav").isin(2, 3).cast("int").alias("pred"))
    return aggregate.share_positive(df, "pred", ["catu"]).withColumn("pct", F.round("pct", 6))


@query(
    "ml_class_weight",
    "SELECT quality, n, round(tot / (k * n), 8) AS weight FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1), "
    "(SELECT count(*) AS tot, count(DISTINCT quality) AS k FROM labels)",
)
def _(t: Tables):
    return aggregate.class_weights(t.labels, "quality").withColumn("weight", F.round("weight", 8))


# ---- picks ----------------------------------------------------------------------------------


@query(
    "rank_most_severe",
    "SELECT Num_Acc, num_veh, id_usager, grav, catv FROM picked",
    "picked",
)
def _(t: Tables):
    veh = cleanse.recode(t.vehicules, "catv", presets.VEHICLE_RECODE)
    both = joins.inner(feature_table.prepare_users(t.usagers), veh, ["Num_Acc", "num_veh", "id_vehicule"])
    one = rank.pick_max(both, "Num_Acc", "grav", ["num_veh", "id_vehicule"])
    return one.select("Num_Acc", "num_veh", "id_usager", "grav", "catv")


@query(
    "rank_top10",
    f"""WITH points AS ({POINTS}), cells AS ({CELLS}) SELECT lat_r, lon_r, round_even(rate * 100, 1) AS pct FROM cells
    ORDER BY rate DESC, lat_r, lon_r LIMIT 10""",
    "usagers caracteristiques",
)
def _(t: Tables):
    cells = hotspots.cell_rates(incident_points(t), "lat", "long", "grav", 2)
    return hotspots.top_cells(cells, 10).select("lat_r", "lon_r", "pct")


@query(
    "set_dedup_key",
    """SELECT Num_Acc, num_veh, id_usager FROM usagers QUALIFY row_number() OVER (PARTITION BY Num_Acc ORDER BY
    num_veh DESC, id_usager DESC) = 1""",
    "usagers",
)
def _(t: Tables):
    return rank.dedup_on_key(t.usagers.select("Num_Acc", "num_veh", "id_usager"), "Num_Acc", ["num_veh", "id_usager"])


@query(
    "set_difference",
    "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
)
def _(t: Tables):
    return rank.missing_from(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")))


# ---- features -------------------------------------------------------------------------------


@query("feat_year", "SELECT Num_Acc, CAST(substr(Num_Acc, 1, 4) AS INT) AS year_acc FROM caracteristiques", "caracteristiques")
def _(t: Tables):
    return t.caracteristiques.select("Num_Acc", features.year_of_key(F.col("Num_Acc")).alias("year_acc"))


@query("feat_age", "SELECT Num_Acc, id_usager, victim_age FROM c_users", "c_users")
def _(t: Tables):
    return feature_table.prepare_users(t.usagers).select("Num_Acc", "id_usager", "victim_age")


def feature_rows(t: Tables):
    """The engineered incident table with its key."""
    return feature_table.engineer(
        *[feature_table.clean_table(t.__getattr__(n), n) for n in ("usagers", "caracteristiques", "lieux", "vehicules")],
        keep_key=True,
    )


NULLABLE = presets.IMPUTED_COLUMNS
FEATURE_LIST = ", ".join(
    f'CAST("{c}" AS DOUBLE) AS "{c}"' if c in NULLABLE else f'"{c}"'
    for c in ["Num_Acc", *presets.MODEL_FEATURES, "year_acc", "grav"]
)


@query("feat_engineer", f"SELECT {FEATURE_LIST} FROM features", "features")
def _(t: Tables):
    return cleanse.cast_columns(feature_rows(t), NULLABLE).select("Num_Acc", *presets.MODEL_FEATURES, "year_acc", "grav")


@query("split_temporal", "SELECT Num_Acc, year_acc, split, grav FROM split", "split")
def _(t: Tables):
    return features.split_by_newest_year(feature_rows(t), "year_acc").select("Num_Acc", "year_acc", "split", "grav")


@query(
    "impute_mode_train",
    "SELECT Num_Acc, split, surf, circ, col, motor FROM imputed",
    "imputed",
)
def _(t: Tables):
    df = feature_table.train_test(feature_rows(t))
    return df.select("Num_Acc", "split", *presets.IMPUTED_COLUMNS)

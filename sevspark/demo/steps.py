"""Shared SQL steps of the counterparts."""

from __future__ import annotations

from .. import presets
from .raw import STEPS


def sql_case(column: str, mapping: dict, otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {otherwise or column} END"


def sql_tidy(column: str) -> str:
    return f"trim(replace({column}, chr(160), ''))"


def sql_int(expr: str) -> str:
    return f"COALESCE(CAST(trunc(TRY_CAST({expr} AS DOUBLE)) AS INT), 0)"


def sql_hash(keys: list[str], seed: int) -> str:
    parts = " || '|' || ".join(f"COALESCE(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"md5({parts} || '|{seed}')"


def sql_hash_int(keys: list[str], seed: int) -> str:
    return f"CAST('0x' || substr({sql_hash(keys, seed)}, 1, 13) AS BIGINT)"


def _nullif(column: str) -> str:
    out = column
    if column in presets.NULL_IF_MINUS_ONE:
        out = f"nullif({out}, -1)"
    if column in presets.NULL_IF_ZERO:
        out = f"nullif({out}, 0)"
    return out


STEPS["c_caract"] = (
    ("caracteristiques",),
    f"""SELECT Num_Acc, jour, mois, lum,
      {sql_int("replace(replace(" + sql_tidy("dep") + ", '2A', '201'), '2B', '202')")} AS dep,
      {sql_int("replace(replace(" + sql_tidy("com") + ", '2A', '201'), '2B', '202')")} AS com,
      agg AS agg_, "int", {sql_case("atm", presets.WEATHER_RECODE)} AS atm, col,
      TRY_CAST(replace(lat, ',', '.') AS DOUBLE) AS lat, TRY_CAST(replace(long, ',', '.') AS DOUBLE) AS long,
      {sql_int("substr(hrmn, 1, greatest(length(hrmn) - 3, 0))")} AS hour FROM caracteristiques""",
)
STEPS["c_users"] = (
    ("usagers",),
    f"""SELECT *, CASE WHEN year_acc - an_nais BETWEEN 0 AND 120 THEN year_acc - an_nais END AS victim_age,
      {sql_case("raw_grav", presets.SEVERITY_RECODE)} AS grav
      FROM (SELECT * EXCLUDE (grav), grav AS raw_grav, CAST(substr(Num_Acc, 1, 4) AS INT) AS year_acc FROM usagers)""",
)
STEPS["c_veh"] = (
    ("vehicules",),
    f"SELECT * REPLACE ({sql_case('catv', presets.VEHICLE_RECODE)} AS catv) FROM vehicules",
)
STEPS["picked"] = (
    ("c_users", "c_veh"),
    """SELECT * FROM c_users JOIN c_veh USING (Num_Acc, num_veh, id_vehicule)
      QUALIFY row_number() OVER (PARTITION BY Num_Acc ORDER BY grav DESC, num_veh DESC, id_vehicule DESC,
        id_usager DESC, place DESC, catu DESC, sexe DESC, secu1 DESC, secu2 DESC, trajet DESC) = 1""",
)
STEPS["picked_features"] = (
    ("c_users", "c_veh"),
    """SELECT * FROM c_users JOIN c_veh USING (Num_Acc, num_veh, id_vehicule)
      QUALIFY row_number() OVER (PARTITION BY Num_Acc ORDER BY grav DESC, num_veh DESC, id_vehicule DESC,
        place DESC, catu DESC, sexe DESC, secu1 DESC, victim_age DESC) = 1""",
)
STEPS["features"] = (
    ("picked_features", "lieux", "c_caract"),
    f"""SELECT * FROM (SELECT p.Num_Acc, place, catu, sexe, {_nullif("secu1")} AS secu1, victim_age, {_nullif("catv")} AS catv,
      {_nullif("obsm")} AS obsm, {_nullif("motor")} AS motor, catr, {_nullif("circ")} AS circ, {_nullif("surf")} AS surf,
      {_nullif("situ")} AS situ, {_nullif("vma")} AS vma, jour, mois, lum, dep, com, agg_, "int", {_nullif("atm")} AS atm,
      {_nullif("col")} AS col, lat, long, hour, nb_victim, nb_vehicules, year_acc,
      {sql_case("grav", presets.TARGET_RECODE)} AS grav
      FROM picked_features p LEFT JOIN lieux l ON p.Num_Acc = l.Num_Acc LEFT JOIN c_caract c ON p.Num_Acc = c.Num_Acc
      JOIN (SELECT Num_Acc, count(*) AS nb_victim FROM usagers GROUP BY 1) u ON p.Num_Acc = u.Num_Acc
      JOIN (SELECT Num_Acc, count(*) AS nb_vehicules FROM vehicules GROUP BY 1) v ON p.Num_Acc = v.Num_Acc
      WHERE grav <> -1)
      WHERE catv IS NOT NULL AND vma IS NOT NULL AND secu1 IS NOT NULL AND obsm IS NOT NULL AND atm IS NOT NULL""",
)
STEPS["split"] = (
    ("features",),
    """SELECT *, CASE WHEN year_acc = (SELECT max(year_acc) FROM features) THEN 'test' ELSE 'train' END AS split
      FROM features""",
)


def _mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM split WHERE split = 'train' AND {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


STEPS["imputed"] = (
    ("split",),
    "SELECT * REPLACE ("
    + ", ".join(f"COALESCE({c}, {_mode(c)}) AS {c}" for c in presets.IMPUTED_COLUMNS)
    + ") FROM split",
)

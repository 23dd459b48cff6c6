"""The reference-shaped input tables, derived row by row from the test tables.

Each view is a base table, a list of expressions both engines read alike, and an optional grouping;
the same text feeds ``selectExpr`` and the SQL counterpart. One order is one incident.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

NBSP = " "


def _num_acc(key: str) -> str:
    """Four digits of year, then the key in twelve digits."""
    return f"CAST((2021 + {key} % 4) * 1000000000000 + {key} AS STRING)"


@dataclass(frozen=True)
class View:
    base: str
    exprs: tuple[str, ...]
    distinct: bool = False


def _thousandths(x: str) -> str:
    """Text with a decimal comma for an integer count of thousandths below 100 000."""
    pad = f"lpad(CAST(abs({x}) AS STRING), 5, '0')"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    return f"{sign} || substr({pad}, 1, 2) || ',' || substr({pad}, 3, 3)"


VIEWS: dict[str, View] = {
    "caracteristiques": View(
        "orders",
        (
            f"{_num_acc('o_orderkey')} AS Num_Acc",
            "CAST(day(o_orderdate) AS INT) AS jour",
            "CAST(month(o_orderdate) AS INT) AS mois",
            "CAST(2021 + o_orderkey % 4 AS INT) AS an",
            "lpad(CAST(o_custkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') AS hrmn",
            "CAST(1 + o_orderkey % 5 AS INT) AS lum",
            f"CASE o_custkey % 20 WHEN 0 THEN '2A' WHEN 1 THEN '2B' WHEN 2 THEN 'N/C' WHEN 3 THEN ' 75{NBSP}' "
            "ELSE CAST(1 + o_custkey % 95 AS STRING) END AS dep",
            "CASE o_custkey % 20 WHEN 0 THEN '2A' || lpad(CAST(o_custkey % 900 AS STRING), 3, '0') "
            "WHEN 1 THEN '2B' || lpad(CAST(o_custkey % 900 AS STRING), 3, '0') WHEN 2 THEN 'N/C' "
            "ELSE CAST(1000 + o_custkey % 90000 AS STRING) END AS com",
            "CAST(1 + o_orderkey % 2 AS INT) AS agg",
            "CAST(1 + o_custkey % 9 AS INT) AS int",
            "CAST(CASE WHEN o_orderkey % 50 = 7 THEN -1 ELSE 1 + o_orderkey % 9 END AS INT) AS atm",
            "CAST(CASE WHEN o_custkey % 8 = 0 THEN -1 ELSE o_custkey % 8 END AS INT) AS col",
            f"{_thousandths('(40500 + (o_orderkey % 2300) * 5)')} AS lat",
            f"{_thousandths('(-5500 + (o_custkey % 3100) * 5)')} AS long",
            "o_orderpriority AS adr",
        ),
    ),
    "lieux": View(
        "orders",
        (
            f"{_num_acc('o_orderkey')} AS Num_Acc",
            "CAST(1 + (o_orderkey + 1) % 7 AS INT) AS catr",
            "CAST(CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE o_custkey % 5 END AS INT) AS circ",
            "CAST(CASE WHEN o_orderkey % 10 = 0 THEN -1 WHEN o_orderkey % 10 = 9 THEN NULL "
            "ELSE o_orderkey % 10 END AS INT) AS surf",
            "CAST(1 + o_custkey % 6 AS INT) AS situ",
            "CAST(CASE o_orderkey % 7 WHEN 0 THEN 30 WHEN 1 THEN 50 WHEN 2 THEN 70 WHEN 3 THEN 80 WHEN 4 THEN 90 "
            "WHEN 5 THEN 110 ELSE 130 END AS INT) AS vma",
            "o_orderstatus AS voie",
        ),
    ),
    "usagers": View(
        "lineitem",
        (
            f"{_num_acc('l_orderkey')} AS Num_Acc",
            "CAST(l_linenumber AS STRING) AS num_veh",
            "CAST(l_orderkey * 10 + l_linenumber AS STRING) AS id_vehicule",
            "CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) || '/' "
            "|| CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS id_usager",
            "CAST(1 + l_partkey % 10 AS INT) AS place",
            "CAST(1 + l_suppkey % 4 AS INT) AS catu",
            "CAST(CASE WHEN l_partkey % 211 = 0 THEN -1 WHEN l_quantity + 4 * (l_orderkey % 7) < 24 THEN 1 "
            "WHEN l_quantity + 4 * (l_orderkey % 7) < 45 THEN 4 WHEN l_quantity + 4 * (l_orderkey % 7) < 62 THEN 3 "
            "ELSE 2 END AS INT) AS grav",
            "CAST(1 + l_partkey % 2 AS INT) AS sexe",
            "CAST(CASE WHEN l_suppkey % 40 = 0 THEN NULL ELSE 1895 + l_partkey % 131 END AS DOUBLE) AS an_nais",
            "CAST(l_suppkey % 10 - 1 AS DOUBLE) AS secu1",
            "CAST(l_suppkey % 3 - 1 AS DOUBLE) AS secu2",
            "CAST(l_partkey % 6 AS INT) AS trajet",
        ),
    ),
    "vehicules": View(
        "lineitem",
        (
            f"{_num_acc('l_orderkey')} AS Num_Acc",
            "CAST(l_linenumber AS STRING) AS num_veh",
            "CAST(l_orderkey * 10 + l_linenumber AS STRING) AS id_vehicule",
            "CAST(CASE WHEN (l_orderkey + l_linenumber) % 41 = 40 THEN -1 "
            "ELSE (l_orderkey * 3 + l_linenumber) % 44 END AS INT) AS catv",
            "CAST((l_orderkey + l_linenumber) % 7 - 1 AS INT) AS obsm",
            "CAST((l_orderkey + 2 * l_linenumber) % 8 - 1 AS INT) AS motor",
        ),
        distinct=True,
    ),
}

_UUID = (
    "lpad(CAST({a} AS STRING), 8, '0') || '-0000-4000-8000-' || lpad(CAST({b} AS STRING), 12, '0')"
)
_EVENT = (
    "CASE event_type WHEN 'signup' THEN 'gate_open' WHEN 'purchase' THEN 'gate_resolved' "
    "WHEN 'error' THEN 'interruption_start' WHEN 'click' THEN 'interruption_end' ELSE 'deploy_step' END"
)

VIEWS |= {
    "requests": View(
        "events",
        (
            "event_id", "ts", "'/' || event_type AS endpoint",
            "CASE WHEN user_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method",
            "CASE WHEN event_type <> 'error' THEN '200' WHEN user_id % 4 = 0 THEN '500' WHEN user_id % 4 = 1 THEN '401' "
            "WHEN user_id % 4 = 2 THEN '429' ELSE '503' END AS status",
            "value / 100 AS duration_s",
            "CAST(CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS INT) AS pred",
        ),
    ),
    "log_lines": View(
        "events",
        (
            "event_id", "ts", "'svc' || CAST(user_id % 4 AS STRING) AS service",
            "'stage' || CAST(user_id % 7 AS STRING) AS stage",
            "CAST(CASE event_type WHEN 'error' THEN 40 WHEN 'view' THEN 10 ELSE 20 END AS INT) AS level_no",
            "CASE event_type WHEN 'error' THEN 'INFO wrapped ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END || ' run ' || "
            + _UUID.format(a="user_id", b="event_id")
            + f" || ' event=' || {_EVENT} || ' kind=first user=' || CAST(user_id AS STRING) || ' kind=' || event_type AS line",
        ),
    ),
    "probes": View(
        "events",
        (
            "event_id", "ts", "'host' || CAST(user_id % 3 AS STRING) AS instance",
            "CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INT) AS up",
        ),
    ),
    "counters": View(
        "events",
        ("event_id", "ts", "'series' || CAST(user_id % 5 AS STRING) AS series", "CAST(event_id % 701 AS DOUBLE) AS value"),
    ),
    "hosts": View(
        "events",
        (
            "event_id", "ts", "'host' || CAST(user_id % 3 AS STRING) AS host",
            "CASE WHEN user_id % 2 = 0 THEN 'memory' ELSE 'disk' END AS resource", "value AS avail",
            "CAST(500 AS DOUBLE) AS size",
        ),
    ),
    "flow_runs": View(
        "events",
        (
            _UUID.format(a="user_id", b="event_id") + " AS run_id", "ts AS start_time",
            "CASE event_type WHEN 'signup' THEN 'deploy' WHEN 'purchase' THEN 'train' WHEN 'error' THEN 'drift' "
            "WHEN 'click' THEN 'update' ELSE 'etl' END AS flow",
            "CASE user_id % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'CRASHED' WHEN 3 THEN 'CANCELLED' "
            "ELSE 'RUNNING' END AS state",
            "CASE WHEN user_id % 5 = 4 THEN NULL ELSE value END AS seconds",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'algo' || CAST(event_id % 4 AS STRING) END AS champion",
            "CASE WHEN event_id % 2 = 0 THEN 'sha' || CAST(event_id AS STRING) ELSE '' END AS sha_tag",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(2021 + event_id % 4 AS INT) END AS year",
        ),
    ),
    "model_runs": View(
        "events",
        (
            _UUID.format(a="user_id", b="event_id") + " AS run_id", "ts AS start_time",
            "CASE WHEN user_id % 3 = 0 THEN 'prod' ELSE 'dev' END AS experiment",
            "CASE event_type WHEN 'signup' THEN 'rf' WHEN 'purchase' THEN 'rf' WHEN 'error' THEN 'gbt_depth' "
            "ELSE 'gbt_leaf' END AS algo",
            "CAST(event_id AS INT) AS version",
            "(560 + event_id * 7 % 140) / CAST(1000 AS DOUBLE) AS f1", "(740 + event_id * 11 % 150) / CAST(1000 AS DOUBLE) AS auc",
            "(690 + event_id * 13 % 110) / CAST(1000 AS DOUBLE) AS accuracy",
            "(550 + event_id * 17 % 130) / CAST(1000 AS DOUBLE) AS recall",
            "CASE WHEN event_id % 4 = 0 THEN '[2021]' WHEN event_id % 4 = 1 THEN '[2021, 2022]' "
            "WHEN event_id % 4 = 2 THEN '[2021, 2022, 2023]' ELSE NULL END AS years",
            "CASE WHEN user_id % 10 = 0 THEN 'true' ELSE 'false' END AS export",
            "CASE WHEN user_id % 7 = 0 THEN 'stopped' ELSE '' END AS gate_outcome",
            "CASE WHEN event_id % 6 = 0 THEN value + event_id END AS promoted_at",
            "CASE event_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'None' WHEN 2 THEN CAST(event_id AS STRING) WHEN 3 THEN '0.05' "
            "ELSE 'sqrt' END AS param",
        ),
    ),
    # a catalogue of files: one entry per document
    "resources": View(
        "documents",
        (
            "doc_id",
            "CASE doc_id % 5 WHEN 0 THEN 'Caract' WHEN 1 THEN 'Lieux' WHEN 2 THEN 'Usagers' WHEN 3 THEN 'Vehicules' "
            "ELSE 'Notice' END || ' ' || CAST(2021 + doc_id % 7 AS STRING) || ' ' || source "
            "|| CASE WHEN doc_id % 11 = 0 THEN ' bilan enrichi' ELSE '' END AS title",
            "CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'CSV' ELSE '' END AS format",
            "CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars * 1000 END AS filesize",
            "'https://data.example.org/' || CAST(doc_id AS STRING) AS url",
        ),
    ),
}


def view(t, name: str) -> DataFrame:
    v = VIEWS[name]
    df = t.table(v.base).selectExpr(*v.exprs)
    return df.distinct() if v.distinct else df


def view_sql(name: str) -> str:
    v = VIEWS[name]
    return f"SELECT {'DISTINCT ' if v.distinct else ''}{', '.join(v.exprs)} FROM {v.base}"


# further named SQL steps that several counterparts share: name -> (views needed before it, text)
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def with_views(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the named views and steps, in dependency order."""
    ordered: list[str] = []

    def add(n: str) -> None:
        if n in ordered:
            return
        for dep in STEPS[n][0] if n in STEPS else ():
            add(dep)
        ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return sql.strip()
    ctes = [f"{n} AS ({STEPS[n][1] if n in STEPS else view_sql(n)})" for n in ordered]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body

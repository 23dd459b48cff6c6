"""Sampling, nearest neighbours and what-if data steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..operators import cleanse, knn, sampling, whatif
from .base import Tables, query
from .raw import STEPS
from .steps import sql_case, sql_hash, sql_hash_int

SEED = 42


@query(
    "sample_n",
    f"SELECT Num_Acc, vma FROM lieux ORDER BY {sql_hash(['Num_Acc'], SEED)}, Num_Acc LIMIT 500",
    "lieux",
)
def _(t: Tables):
    return sampling.sample_n(t.lieux.select("Num_Acc", "vma"), ["Num_Acc"], 500, SEED)


@query(
    "split_random",
    f"""SELECT Num_Acc, CASE WHEN row_number() OVER (ORDER BY {sql_hash_int(['Num_Acc'], SEED)}) <=
      ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM lieux""",
    "lieux",
)
def _(t: Tables):
    return sampling.split_random(t.lieux, ["Num_Acc"], 0.3, SEED).select("Num_Acc", "split")


STEPS["fleet"] = (
    ("vehicules",),
    f"SELECT Num_Acc, num_veh, {sql_case('catv', presets.VEHICLE_RECODE)} AS catv FROM vehicules",
)


def fleet(t: Tables):
    return cleanse.recode(t.vehicules, "catv", presets.VEHICLE_RECODE).select("Num_Acc", "num_veh", "catv")


def _replicated(catv: int, mult: float) -> str:
    """Counterpart of drawing int(n * (mult - 1)) rows of a class with replacement."""
    return f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(['Num_Acc', 'num_veh'], SEED)}, Num_Acc, num_veh) AS idx
      FROM fleet WHERE catv = {catv}), c AS (SELECT count(*) AS n FROM m),
    d AS (SELECT {sql_hash_int(['i'], SEED)} % n + 1 AS idx FROM (SELECT unnest(range(CAST(trunc(n * {mult - 1}) AS BIGINT))) AS i, n FROM c)),
    a AS (SELECT Num_Acc, num_veh, catv FROM fleet UNION ALL SELECT Num_Acc, num_veh, catv FROM d JOIN m USING (idx))
    SELECT Num_Acc, num_veh, catv, count(*) AS copies FROM a GROUP BY 1, 2, 3"""


def _copies(df):
    return df.groupBy("Num_Acc", "num_veh", "catv").agg(F.count(F.lit(1)).alias("copies"))


@query("sample_replicate", _replicated(3, 2.5), "fleet")
def _(t: Tables):
    return _copies(sampling.replicate(fleet(t), F.col("catv") == 3, 2.5, ["Num_Acc", "num_veh"], SEED))


for _name, _catv in (("more_bikes", 5), ("more_motos", 4)):

    def _run(t: Tables, name=_name):
        _, after = whatif.apply(fleet(t), name, ["Num_Acc", "num_veh"], 2.0, SEED)
        return _copies(after)

    query(f"whatif_{_name}", _replicated(_catv, 2.0), "fleet")(_run)


@query(
    "sample_oversample",
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash(['doc_id'], SEED)}, doc_id) AS idx,
      count(*) OVER (PARTITION BY quality) AS n FROM labels), x AS (SELECT max(n) AS most FROM m),
    k AS (SELECT DISTINCT quality, n, most FROM m, x WHERE n < most),
    d AS (SELECT quality, {sql_hash_int(['i'], SEED)} % n + 1 AS idx FROM (SELECT quality, n, unnest(range(most - n)) AS i FROM k)),
    a AS (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM d JOIN m USING (quality, idx))
    SELECT doc_id, quality, count(*) AS copies FROM a GROUP BY 1, 2""",
)
def _(t: Tables):
    df = sampling.oversample(t.labels.select("doc_id", "quality"), "quality", ["doc_id"], SEED)
    return df.groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("copies"))


def minority(t: Tables):
    """Embeddings as a two-class table: label 0 against the rest."""
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("int").alias("y"))


_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda j: (a.x[j] - b.x[j]) * (a.x[j] - b.x[j]))))"


@query(
    "sample_smote",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
    c AS (SELECT count(*) FILTER (y = 1) AS n, count(*) FILTER (y = 0) AS most FROM e),
    p AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(['vec_id'], SEED)}, vec_id) AS idx FROM e WHERE y = 1),
    nn AS (SELECT a.vec_id AS base, b.vec_id AS nn_id, a.x AS ax, b.x AS bx, row_number() OVER (PARTITION BY a.vec_id
      ORDER BY {_DIST}, b.vec_id) AS rank FROM p a JOIN p b ON a.vec_id <> b.vec_id),
    d AS (SELECT i AS draw, {sql_hash_int(['i'], SEED)} % n + 1 AS idx, {sql_hash_int(['i'], SEED + 1)} % 5 + 1 AS rank,
      {sql_hash_int(['i'], SEED + 2)} / 4503599627370496.0::DOUBLE AS u FROM (SELECT unnest(range(most - n)) AS i, n FROM c))
    SELECT 1 AS y, draw, base, nn_id, round(ax[1] + u * (bx[1] - ax[1]), 8) AS x1, round(ax[64] + u * (bx[64] - ax[64]), 8) AS x64
    FROM d JOIN p USING (idx) JOIN nn ON nn.base = p.vec_id AND nn.rank = d.rank""",
)
def _(t: Tables):
    df = sampling.smote(minority(t), "x", "y", "vec_id", 5, SEED)
    return df.select("y", "draw", "base", "nn_id", F.round(F.col("x")[0], 8).alias("x1"), F.round(F.col("x")[63], 8).alias("x64"))


_KNN_DISTANCES = {
    "minkowski": "list_sum(list_transform(range(1, 65), lambda j: (a.x[j] - b.x[j]) * (a.x[j] - b.x[j])))",
    "manhattan": "list_sum(list_transform(range(1, 65), lambda j: abs(a.x[j] - b.x[j])))",
    "chebyshev": "list_max(list_transform(range(1, 65), lambda j: abs(a.x[j] - b.x[j])))",
}


@query(
    "ml_knn",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, row_number() OVER (ORDER BY {sql_hash_int(['vec_id'], SEED)})
      <= ceil(0.3 * count(*) OVER ()) AS test FROM embeddings),
    tr AS (SELECT * FROM e WHERE NOT test ORDER BY {sql_hash(['vec_id'], SEED)}, vec_id LIMIT 5000),
    d AS ({' UNION ALL '.join(f"SELECT a.vec_id, b.vec_id AS nn, b.label, '{m}' AS metric, {f} AS dist FROM e a JOIN tr b ON a.test" for m, f in _KNN_DISTANCES.items())}),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, metric ORDER BY dist, nn) AS rank FROM d QUALIFY rank <= 9),
    v AS (SELECT vec_id, metric, k, label, count(*) AS n FROM r JOIN (SELECT unnest(range(1, 10)) AS k) ON rank <= k GROUP BY 1, 2, 3, 4)
    SELECT vec_id, metric, CAST(k AS INT) AS k, CAST(label AS BIGINT) AS pred FROM v
    QUALIFY row_number() OVER (PARTITION BY vec_id, metric, k ORDER BY n DESC, label) = 1""",
)
def _(t: Tables):
    rows = sampling.split_random(t.embeddings, ["vec_id"], 0.3, SEED)
    train = sampling.sample_n(rows.filter("split = 'train'"), ["vec_id"], knn.SAMPLE_LIMIT, SEED)
    return knn.vote(rows.filter("split = 'test'"), "vec_id", "embedding", train, "label")


# ---- what-if --------------------------------------------------------------------------------

STEPS["roads"] = (
    ("lieux", "caracteristiques"),
    'SELECT l.Num_Acc, catr, agg AS agg_, vma, lum, surf, "int" AS intersection_type FROM lieux l JOIN caracteristiques c '
    "ON l.Num_Acc = c.Num_Acc",
)


def roads(t: Tables):
    df = t.lieux.select("Num_Acc", "catr", "vma", "surf").join(
        t.caracteristiques.select("Num_Acc", "agg", "lum", "int"), "Num_Acc"
    )
    return cleanse.rename(df, {"agg": "agg_", "int": "intersection_type"})


_WHERE = {
    "motorway_110": ("catr = 1 AND agg_ = 1 AND vma >= 120", "vma", 110),
    "lighting": ("lum IN (3, 4)", "lum", 5),
    "zone30": ("agg_ = 2 AND vma BETWEEN 45 AND 55", "vma", 30),
    "dry_road": ("surf IN (5, 7)", "surf", 1),
    "roundabout": ("intersection_type IN (2, 3)", "intersection_type", 6),
}
for _name, (_where, _col, _value) in _WHERE.items():

    def _run(t: Tables, name=_name, col=_col):
        before, after = whatif.apply(roads(t), name, ["Num_Acc"])
        old = before.select("Num_Acc", F.col(col).alias("old"))
        return after.select("Num_Acc", F.col(col).alias("new")).join(old, "Num_Acc")

    query(
        f"whatif_{_name}",
        f"SELECT Num_Acc, {_col} AS old, {_value} AS new FROM roads WHERE {_where}",
        "roads",
    )(_run)


@query(
    "whatif_apply",
    " UNION ALL ".join(
        f"SELECT '{n}' AS scenario, count(*) FILTER ({w}) AS n_rows FROM roads" for n, (w, _, _) in _WHERE.items()
    ),
    "roads",
)
def _(t: Tables):
    row = roads(t).agg(*[F.count_if(whatif.SCENARIOS[n].concerns()).alias(n) for n in _WHERE])
    return row.unpivot([], list(_WHERE), "scenario", "n_rows")

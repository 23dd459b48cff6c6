import pytest
from pyspark.sql import functions as F

from sevspark import presets
from sevspark.functions import text, when
from sevspark.operators import cleanse
from sevspark.plans import feature_table


def raw(spark, duplicate_user=False):
    keys = ["2021001", "2021002", "2021003"]
    users = [
        (k, "v1", "A", 1, 1, g, 1, 1970.0, 1.0, 0.0, 0.0, 5, 0, 0, 0) for k, g in zip(keys, (2, 3, 4))
    ]
    if duplicate_user:
        users.append(users[0])
    u = spark.createDataFrame(
        users,
        "Num_Acc string, id_vehicule string, num_veh string, place int, catu int, grav int, sexe int, an_nais double, "
        "secu1 double, secu2 double, secu3 double, trajet int, locp int, actp int, etatp int",
    )
    c = spark.createDataFrame(
        [
            (keys[0], 1, 1, "0000", 2021, 1, "2A", "2A247", 1, 1, 9, 3, "48,60", "2,35", "x"),
            (keys[1], 2, 6, "14:30", 2021, 5, "2B", "2B033", 2, 2, 2, 3, "43,30", "-1,5", "x"),
            (keys[2], 3, 12, "1430", 2021, 2, "N/C", "75056", 1, 3, 8, -1, "bad", None, "x"),
        ],
        "Num_Acc string, jour int, mois int, hrmn string, an int, lum int, dep string, com string, agg int, int int, "
        "atm int, col int, lat string, long string, adr string",
    )
    p = spark.createDataFrame(
        [(k, 3, 2, 2, 0, 0, 1, 0, 1, 80, None) for k in keys],
        "Num_Acc string, catr int, circ int, nbv int, prof int, plan int, surf int, infra int, situ int, vma int, voie string",
    )
    v = spark.createDataFrame(
        [(k, "v1", "A", 1, 7, 0, 2, 1, 1, 1, 0) for k in keys],
        "Num_Acc string, id_vehicule string, num_veh string, senc int, catv int, obs int, obsm int, choc int, manv int, "
        "motor int, occutc int",
    )
    return u, c, p, v


def rows(spark, **kw):
    return {r["Num_Acc"]: r for r in feature_table.engineer(*raw(spark, **kw), keep_key=True).collect()}


def test_one_row_per_incident_with_binary_target(spark):
    got = rows(spark)
    assert len(got) == 3
    assert [got[k]["grav"] for k in sorted(got)] == [1, 1, 0]


def test_area_codes_coordinates_and_hours(spark):
    got = rows(spark)
    a, b, c = (got[k] for k in sorted(got))
    assert (a["dep"], a["com"], a["lat"], a["hour"]) == (201, 201247, 48.6, 0)
    assert (b["dep"], b["com"], b["hour"]) == (202, 202033, 14)
    assert (c["dep"], c["hour"], c["lat"]) == (0, 1, None)


def test_columns_and_counts(spark):
    df = feature_table.engineer(*raw(spark))
    assert set(presets.MODEL_FEATURES) | {"year_acc", "grav"} == set(df.columns)
    assert rows(spark, duplicate_user=True)["2021001"]["nb_victim"] == 2
    r = rows(spark)["2021001"]
    assert (r["victim_age"], r["catv"], r["atm"], r["year_acc"]) == (51.0, 2, 0, 2021)


def test_most_severe_user_wins_with_the_recoded_order(spark):
    u, c, p, v = raw(spark)
    extra = u.filter("Num_Acc = '2021001'").withColumns({"grav": F.lit(3), "place": F.lit(9)})
    got = feature_table.engineer(u.unionByName(extra), c, p, v, keep_key=True)
    # raw 3 becomes 4 and outranks raw 2, which becomes 3
    assert got.filter("Num_Acc = '2021001'").first()["place"] == 9


def test_duplicate_place_rows_do_not_multiply(spark):
    u, c, p, v = raw(spark)
    assert feature_table.engineer(u, c, p.unionByName(p), v).count() == 3
    assert feature_table.engineer(u, c, p.unionByName(p), v, dedupe_places=False).count() == 6


def test_split_and_imputation_use_train_rows_only(spark):
    df = spark.createDataFrame(
        [(2021, 1, 2, 1, 5), (2021, 1, 2, 1, 5), (2021, None, 2, 1, 5), (2022, None, 1, None, 4), (2022, 3, None, 3, None)],
        "year_acc int, surf int, circ int, col int, motor int",
    )
    got = feature_table.train_test(df)
    assert got.filter("split = 'test'").count() == 2
    assert {r["surf"] for r in got.collect()} == {1, 3}
    assert got.filter("circ IS NULL OR col IS NULL OR motor IS NULL").count() == 0


def test_unmapped_severity_is_set_aside(spark):
    u, c, p, v = raw(spark)
    bad = u.withColumn("grav", F.lit(-1))
    assert feature_table.engineer(bad, c, p, v).count() == 0
    assert feature_table.engineer(bad, c, p, v, keep_unmapped_target=True).count() == 3
    assert feature_table.unmapped_severity(bad).count() == 3


def test_known_renames_and_cleaning(spark):
    names = presets.COLUMN_RENAMES["caracteristiques"]
    df, done = cleanse.known_renames(spark.createDataFrame([("1", 2)], "Accident_Id string, jour int"), names)
    assert (df.columns, done) == (["Num_Acc", "jour"], ["Accident_Id"])
    both = spark.createDataFrame([("1", "2")], "Accident_Id string, Num_Acc string")
    assert cleanse.known_renames(both, names)[1] == []
    dirty = spark.createDataFrame([("77 ", 1), (" 75 ", 2), ("2A", 3), (None, 4)], "dep string, n int")
    assert [r["dep"] for r in cleanse.clean_strings(dirty).orderBy("n").collect()] == ["77", "75", "2A", None]


def test_missing_columns_and_empty_filters(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert cleanse.fill_missing_columns(df, ["b", "c", "a"]).first() == (2, 0, 1)
    assert cleanse.in_list(df, "a", []).count() == 1
    assert cleanse.any_column_contains(df, "").count() == 1


@pytest.mark.parametrize("value, kind", [("True", "bool"), ("None", "none"), ("5", "int"), ("0.5", "float"), ("sqrt", "str")])
def test_typed_text(spark, value, kind):
    assert spark.range(1).select(text.typed_text(F.lit(value))).first()[0] == kind


def test_strict_hours_and_bad_dates(spark):
    df = spark.createDataFrame([("1430",), ("14:30",), ("930",), (None,)], "h string")
    assert [r[0] for r in df.select(text.hour_of(F.col("h"), True)).collect()] == [14, 14, 9, 0]
    bad = spark.range(1).select(when.timestamp_of(F.lit(2021), F.lit(2), F.lit(30), F.lit("10:00")))
    assert bad.first()[0] is None


def test_dataset_label():
    assert feature_table.dataset_label([2021]) == "2021"
    assert feature_table.dataset_label([2022, 2021]) == "cumul_2021_2022"

"""Four raw tables -> one feature row per incident -> train/test table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions import text
from ..operators import cleanse, features, joins, rank
from ..session import written


def clean_table(df: DataFrame, table: str) -> DataFrame:
    """Known renames and text cleaning of one raw table."""
    renamed, _ = cleanse.known_renames(df, presets.COLUMN_RENAMES.get(table, {}))
    return cleanse.clean_strings(renamed)


def prepare_users(users: DataFrame) -> DataFrame:
    """Incident year, victim age and the recoded severity."""
    year = features.year_of_key(F.col("Num_Acc"))
    return users.withColumns(
        {
            "year_acc": year,
            "victim_age": features.age(year, F.col("an_nais")),
            "grav": text.recode(F.col("grav"), presets.SEVERITY_RECODE),
        }
    ).drop("an_nais")


def prepare_characteristics(caract: DataFrame, strict_hhmm: bool = False) -> DataFrame:
    """Hour, numeric area codes, decimal coordinates and the weather flag."""
    out = cleanse.hours(caract, "hrmn", "hour", strict_hhmm)
    out = cleanse.rename(cleanse.drop_if_present(out, ["hrmn", "an"]), {"agg": "agg_"})
    out = cleanse.replace_text(out, ["dep", "com"], presets.DEPARTMENT_LETTERS)
    out = cleanse.numeric_or_zero(out, ["dep", "com"])
    out = cleanse.decimal_commas(out, ["lat", "long"])
    return cleanse.recode(out, "atm", presets.WEATHER_RECODE)


def engineer(
    users: DataFrame, caract: DataFrame, places: DataFrame, vehicles: DataFrame,
    keep_unmapped_target: bool = False, dedupe_places: bool = True, keep_key: bool = False,
    strict_hhmm: bool = False,
) -> DataFrame:
    """One row per incident: the most severe user with vehicle, place, characteristics and counts.

    Users and vehicles first shrink to one row per three-part key, then join on it: a hot incident or
    vehicle is reduced before any shuffle, and the join reuses the partitioning of that reduction. The
    pick per incident and both counts aggregate partially too, and the joins on the incident number
    reuse their partitioning.
    """
    key, parts = "Num_Acc", ["num_veh", "id_vehicule"]
    # technical columns never reach the result; without them the pick ships and compares less
    unused = [c for c in presets.TECHNICAL_COLUMNS if c not in {key, *parts}]
    people = cleanse.drop_if_present(prepare_users(users), unused)
    veh = cleanse.recode(cleanse.drop_if_present(vehicles, unused), "catv", presets.VEHICLE_RECODE)
    places = cleanse.drop_if_present(places, unused)
    # one user and one vehicle per joint key are enough for the pick, and no key stays hot in the join
    people = rank.pick_max(people, [key, *parts], "grav")
    veh = rank.pick_max(veh, [key, *parts], next(c for c in veh.columns if c not in {key, *parts}))
    both = joins.inner(people, veh, [key, *parts])
    one = rank.pick_max(both, key, "grav", parts)
    where = rank.dedup_on_key(places, key, [c for c in places.columns if c != key]) if dedupe_places else places
    wide = joins.left_outer(one, where, [key])
    wide = joins.left_outer(wide, prepare_characteristics(caract, strict_hhmm), [key])
    wide = joins.with_counts(wide, users, key, "nb_victim")
    wide = joins.with_counts(wide, vehicles, key, "nb_vehicules")
    wide = cleanse.recode(wide, "grav", presets.TARGET_RECODE)
    if not keep_unmapped_target:
        wide = wide.filter(F.col("grav").isin(0, 1))
    wide = cleanse.sentinels_to_null(
        wide, {-1: presets.NULL_IF_MINUS_ONE, 0: presets.NULL_IF_ZERO}
    )
    drop = [c for c in presets.TECHNICAL_COLUMNS if not (keep_key and c == key)]
    return cleanse.drop_critical_nulls(cleanse.drop_if_present(wide, drop), presets.CRITICAL_COLUMNS)


def unmapped_severity(users: DataFrame) -> DataFrame:
    """Users whose severity has no class; ``engineer`` sets their incidents aside when picked."""
    return users.filter(F.col("grav").isNull() | ~F.col("grav").isin(1, 2, 3, 4))


def train_test(feature_rows: DataFrame, year: str = "year_acc") -> DataFrame:
    """Newest year as test, earlier as train, NULLs filled with train modes.

    The newest year and the modes each need their own look at the rows, so these are written once;
    both looks then read only their columns.
    """
    split = features.split_by_newest_year(written(feature_rows, "features"), year)
    return features.impute_train_modes(split, presets.IMPUTED_COLUMNS)


def dataset_label(years) -> str:
    """'2021', or 'cumul_2021_2022' for several years."""
    ordered = [str(y) for y in sorted(years)]
    return ordered[0] if len(ordered) == 1 else "cumul_" + "_".join(ordered)

import pytest
from pyspark.sql import functions as F

from sevspark import presets
from sevspark.operators import cleanse, validate
from sevspark.sources import catalog, listing, sinks, tables


def levels(df, check=None):
    rows = df.filter(F.col("check") == check).collect() if check else df.collect()
    return [r["level"] for r in rows]


def characteristics(spark, n=100, jour="5"):
    return spark.range(n).select(
        F.col("id").cast("string").alias("Num_Acc"), F.lit(jour).alias("jour"), F.lit(6).alias("mois"),
        F.lit("14:30").alias("hrmn"), F.lit(1).alias("lum"), F.lit("75").alias("dep"), F.lit("75056").alias("com"),
        F.lit(1).alias("agg"), F.lit(1).alias("int"), F.lit(1).alias("atm"), F.lit(1).alias("col"),
        F.lit("48,6").alias("lat"), F.lit("2,3").alias("long"),
    )


def test_row_count_bounds(spark):
    for n, level in ((100, "WARNING"), (55_000, "INFO")):
        df = validate.quality_messages(characteristics(spark, n), "caracteristiques", presets.ROW_COUNT_BOUNDS)
        assert levels(df, "row_count") == [level]


def test_missing_column_is_critical_and_gate_stops(spark):
    bad = validate.schema_messages(characteristics(spark).drop("dep"), "caracteristiques")
    assert levels(bad, "required_columns") == ["CRITICAL"]
    with pytest.raises(validate.ValidationError):
        validate.gate(bad)


def test_rename_and_coercion_do_not_escalate(spark):
    df, renamed = cleanse.known_renames(
        characteristics(spark, jour="5 ").withColumnRenamed("Num_Acc", "Accident_Id"),
        presets.COLUMN_RENAMES["caracteristiques"],
    )
    df = cleanse.clean_strings(df)
    report = validate.schema_messages(df, "caracteristiques", renamed=renamed)
    assert levels(report, "column_rename") == ["AUTO_CORRECTED"]
    assert "jour" in report.filter("check = 'type_coercion'").first()["detail"]
    assert validate.gate(report) == "OK"
    typed, failures = validate.coerce(df, presets.TABLE_SCHEMAS["caracteristiques"])
    assert failures == 0 and dict(typed.dtypes)["jour"] == "int"


def test_uncoercible_value_warns_and_keeps_the_table(spark):
    df = characteristics(spark, jour="abc")
    assert levels(validate.schema_messages(df, "caracteristiques"), "type_check") == ["WARNING"]
    same, failures = validate.coerce(df, presets.TABLE_SCHEMAS["caracteristiques"])
    assert failures == 100 and dict(same.dtypes)["jour"] == "string"


def test_severity_and_box(spark):
    users = spark.createDataFrame([(1,), (5,), (None,)], "grav int")
    got = validate.quality_messages(users, "usagers", severity="grav").filter("check = 'severity_values'").first()
    assert got["detail"].startswith("2 rows")
    c = characteristics(spark, 3).withColumn("lat", F.when(F.col("Num_Acc") == "0", "10,0").when(F.col("Num_Acc") == "1", F.lit(None)).otherwise("48,0"))
    got = validate.quality_messages(c, "caracteristiques", lat_lon=("lat", "long")).filter("check = 'lat_long_range'").first()
    assert got["detail"].startswith("1 rows")


def test_overall_of_nothing_is_ok(spark):
    empty = spark.createDataFrame([], validate.MESSAGE)
    assert validate.overall(empty).first()["overall"] == "OK"


def test_payloads(spark):
    fields = {"catv": "int", "vma": "double", "secu1": "double"}
    good = '{"catv": 2, "vma": 50, "secu1": 1.0, "extra": 3}'
    bodies = [good, '{"catv": 2, "vma": 50}', '{"catv": 2, "vma": "rapide", "secu1": 1}', '{"catv": 2.5, "vma": 1, "secu1": 1}', "no json"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    parsed = validate.read_payload(df, "body", fields)
    assert [r["ok"] for r in parsed.collect()] == [True, False, False, False, False]
    valid, rejected = validate.split_payloads(parsed, "body", list(fields))
    assert (valid.count(), rejected.count(), rejected.columns) == (1, 4, ["body"])


def test_sparse_columns_are_dropped(spark):
    df = spark.range(10).select("id", F.when(F.col("id") < 2, 1).alias("rare"), F.when(F.col("id") < 5, 1).alias("half"))
    assert validate.drop_sparse(df).columns == ["id", "half"]


@pytest.mark.parametrize(
    "names, how",
    [
        (["caract-2021", "lieux-2021", "usagers-2021", "vehicules-2021"], {"keyword"}),
        (["carcteristiques-2021", "lieux-2021", "usagers-2021", "vehicules-2021"], {"keyword", "similarity"}),
    ],
)
def test_file_matching(spark, names, how):
    df = spark.createDataFrame([("f", n) for n in names], "folder string, file string")
    got = catalog.match_files(df, ["folder"], "file").collect()
    assert {r["category"] for r in got} == set(presets.CATEGORY_KEYWORDS)
    assert {r["how"] for r in got} == how


def test_unrelated_file_is_not_matched(spark):
    df = spark.createDataFrame(
        [("f", n) for n in ["xyz-completely-unrelated-2021", "lieux-2021", "usagers-2021", "vehicules-2021"]],
        "folder string, file string",
    )
    assert catalog.match_files(df, ["folder"], "file").count() == 3


def test_catalogue(spark):
    res = spark.createDataFrame(
        [
            (1, "Caract 2024", "csv", 10**6, "a"), (2, "Caract 2024 long", "csv", 10**6, "b"),
            (3, "Lieux 2024 bilan", "csv", 10**6, "c"), (4, "Usagers 2024", "pdf", 10**6, "d"),
            (5, "Vehicules 2024", "", 1000, "e"), (6, "Usagers 2025", "csv", 0, "f"), (7, "Lieux 2025", None, None, "g"),
        ],
        "pos int, title string, format string, filesize long, url string",
    )
    years = spark.createDataFrame([(2024,)], "year int")
    got = catalog.resolve(res, years)
    assert [(r["category"], r["url"]) for r in got.collect()] == [("caracteristiques", "a")]
    with pytest.raises(ValueError):
        catalog.require_all(got)
    new = catalog.detect_new_year(res, years, "pos").orderBy("category").collect()
    assert [(r["year"], r["category"], r["status"]) for r in new] == [(2025, "lieux", "partial"), (2025, "usagers", "partial")]


def test_years_and_headers(spark, tmp_path):
    for year, files in ((2020, 4), (2021, 4), (2022, 3), (2023, 5)):
        d = tmp_path / str(year)
        d.mkdir()
        for i in range(files):
            (d / f"f{i}.csv").write_text('"Num_Acc";"catv"\n1;2\n' if i else "Num_Acc,catv\n1,2\n")
    found = listing.files(spark, str(tmp_path))
    years = listing.available_years(found)
    assert listing.sorted_years(years, 2) == [2021, 2023]
    assert listing.sorted_years(listing.available_years(found, last_year=2022)) == [2021]
    with pytest.raises(ValueError):
        listing.sorted_years(listing.years_up_to(years, 2021), 2)
    heads = tables.header_lines(spark, str(tmp_path / "2021"))
    problems = {r["problem"] for r in tables.check_headers(heads, presets.HEADER_COLUMNS, "vehicules", 1).collect()}
    assert problems == {None, "no ';' in header"}
    small = tables.check_headers(heads, presets.HEADER_COLUMNS, "vehicules", 10**6).collect()
    assert {r["problem"] for r in small} == {"too small"}


@pytest.mark.parametrize("sep, encoding", [(";", "utf-8"), (",", "latin-1"), ("\t", "utf-8-sig")])
def test_sniffed_csv(spark, tmp_path, sep, encoding):
    p = tmp_path / "x.csv"
    p.write_bytes(sep.join(["Num_Acc", "adr"]).encode(encoding) + ("\n" + sep.join(["1", "allée"])).encode(encoding.replace("-sig", "")))
    assert tables.read_csv(spark, str(p)).collect() == [("1", "allée")]


def test_one_column_file_is_unreadable(spark, tmp_path):
    (tmp_path / "x.csv").write_text("abc\n1\n")
    assert tables.read_csv(spark, str(tmp_path / "x.csv")) is None


def test_groups_without_all_files_are_an_error(spark):
    whole = [("f", n) for n in ["caract-2021", "lieux-2021", "usagers-2021", "vehicules-2021"]]
    df = spark.createDataFrame(whole, "folder string, file string")
    found = catalog.match_files(df, ["folder"], "file")
    assert catalog.require_all_files(df, found, ["folder"]).count() == 4
    df = spark.createDataFrame([*whole, ("g", "lieux-2022")], "folder string, file string")
    with pytest.raises(ValueError, match="g: missing .*caracteristiques.*usagers.*vehicules"):
        catalog.require_all_files(df, catalog.match_files(df, ["folder"], "file"), ["folder"])
    df = spark.createDataFrame([*whole, ("h", "xyz")], "folder string, file string")
    with pytest.raises(ValueError, match="h: missing"):
        catalog.require_all_files(df, catalog.match_files(df, ["folder"], "file"), ["folder"])


def test_reset_deletes_drift_reports(spark, tmp_path):
    folder = str(tmp_path / "drift")
    assert not sinks.reset_drift_reports(spark, folder)
    rows = spark.createDataFrame([(2020, "low"), (2021, "high")], "year int, level string")
    sinks.write_drift_reports(rows, folder)
    assert sinks.reset_drift_reports(spark, folder) and not sinks.reset_drift_reports(spark, folder)
    assert not (tmp_path / "drift" / "reports").exists() and not (tmp_path / "drift" / "latest").exists()


def test_first_available_and_reset(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(b)
    assert tables.load_first_available(spark, [a, b]).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.load_first_available(spark, [a])
    assert sinks.reset(spark, b) == 3 and spark.read.parquet(b).count() == 0 and sinks.reset(spark, a) == 0


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = spark.range(100)
    one = sinks.fingerprint(df).first()
    assert one == sinks.fingerprint(df.orderBy(F.col("id").desc()).repartition(7)).first()
    assert one != sinks.fingerprint(df.union(df.limit(2)).union(df.limit(2))).first()


def test_file_messages(spark):
    seen = spark.createDataFrame([("lieux", 10, 5), ("usagers", 0, None), ("vehicules", 9, 0)], "table string, length long, rows long")
    got = {r["table"]: r["check"] for r in validate.file_messages(seen, list(presets.CATEGORY_KEYWORDS)).collect()}
    assert got == {"caracteristiques": "file_discovery", "usagers": "file_nonempty", "vehicules": "file_nonempty"}


def test_block_ratio_is_that_of_recursive_blocks(spark):
    """Against the standard library's block matching, with ties, repeats, empty texts and the typos of file names."""
    import difflib
    import random

    from sevspark.functions import text

    r = random.Random(4)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    pairs = [(some("ab", 9), some("ab", 12)) for _ in range(150)] + [(some("abcde", 14), some("abcde", 20)) for _ in range(150)]
    pairs += [("caracteristiques", x) for x in ("carcteristiques", "caracteristique", "caract", "seuqitsiretcarac", "")]
    pairs += [("usagers", "usager"), ("lieux", "lieu"), ("vehicules", "véhicules"), ("", ""), ("a" * 16, "a" * 300 + "b")]
    frame = spark.createDataFrame([*pairs, ("a", None), (None, "a")], "a string, b string")
    got = frame.select("a", "b", text.block_ratio(F.col("a"), F.col("b")).alias("ratio")).collect()
    for x in got:
        wanted = None if x.a is None or x.b is None else difflib.SequenceMatcher(None, x.a, x.b, autojunk=False).ratio()
        assert x.ratio == wanted, (x.a, x.b)


def test_fuzzy_names_keep_the_limit_and_skip_by_length_only_what_cannot_reach_it(spark):
    import difflib

    from sevspark.operators import joins

    names = ["caracteristiques", "lieux", "usagers", "vehicules"]
    stems = ["carcteristiques", "carac", "lieu", "lieus", "leux", "usager", "usages", "sagers", "vehicles", "vehic", "velo", "x", ""]
    frame = spark.createDataFrame([(f"{s}-2021",) for s in stems] + [(None,)], "file string")
    got = {(x.file, x.name, x.score) for x in joins.fuzzy_to_names(frame, "file", names, 0.75).collect()}
    ratio = lambda n, s: difflib.SequenceMatcher(None, n, s).ratio()
    assert got == {(f"{s}-2021", n, ratio(n, s)) for s in stems for n in names if ratio(n, s) >= 0.75}
    assert ("vehicles-2021", "vehicules", ratio("vehicules", "vehicles")) in got

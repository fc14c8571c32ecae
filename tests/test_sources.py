"""Reading, writing and registering datasets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trialspark import schema as S
from trialspark.operators.tables import dataset_inventory, dataset_profile
from trialspark.sources import domains as D


def test_csv_keeps_zeros_and_missing(spark, tmp_path):
    row = {"USUBJID": "ST-007-001", "SUBJID": "001", "SITEID": "007", "AGE": None, "SEX": "F"}
    df = spark.createDataFrame([tuple(row.get(n) for n in S.DM.fieldNames())], S.DM)
    path = D.write_domain(df, str(tmp_path / "dm.csv"), "csv")
    back = D.read_domain(spark, path, S.DM)
    assert back.schema == S.DM and back.collect() == df.collect()


def test_csv_needs_schema_and_checks_header(spark, tmp_path):
    with pytest.raises(ValueError):
        D.read_domain(spark, "x.csv")


def test_replace_and_partition(spark, tmp_path):
    df = spark.createDataFrame([("101", 1), ("102", 2)], "SITEID string, n int")
    path = D.write_domain(df, str(tmp_path / "d"), partition_by=["SITEID"])
    D.write_domain(df.limit(1), path, partition_by=["SITEID"])
    assert D.read_domain(spark, path).count() == 1


def test_missing_inputs_are_all_named(spark, tmp_path):
    present = D.write_domain(spark.range(1).toDF("n"), str(tmp_path / "ok"))
    with pytest.raises(FileNotFoundError, match="AE .*ADSL"):
        D.require_inputs(
            spark, {"DM": present, "AE": str(tmp_path / "ae"), "ADSL": str(tmp_path / "x.csv")}
        )
    assert D.require_inputs(spark, {"DM": present}) == {"DM": present}


def test_export_is_dated(spark, tmp_path):
    names = D.RISK_COLUMNS
    df = spark.createDataFrame([tuple("1" for _ in names)], ", ".join(f"{n} string" for n in names))
    path = D.export_risk_table(df, str(tmp_path), "ST-01", dt.date(2024, 5, 6))
    assert path.endswith("st-01-risk-report-2024-05-06.csv")
    assert spark.read.option("header", True).csv(path).columns == names


def test_dictionaries(spark):
    assert D.site_dictionary(spark).agg({"N_SUBJ": "sum"}).first()[0] == 280
    terms = {r["AEDECOD"]: r["AEBODSYS"] for r in D.term_dictionary(spark).collect()}
    assert len(terms) == 10 and terms["ALT Increased"] == "Investigations"


def test_registration_profile_inventory(spark):
    df = spark.createDataFrame([("a", "Y"), ("b", None)], "USUBJID string, DPTFL string")
    assert D.register_domains(spark, {"ADSL": df}, "t_") == ["t_adsl"]
    assert spark.sql("SELECT count(*) FROM t_adsl").first()[0] == 2
    row = dataset_profile(df).first()
    assert (row["N_SUBJECTS"], row["FLAG_RATE"], row["COLUMNS"]) == (2, 50.0, "USUBJID,DPTFL")
    got = dataset_inventory({"ADSL": df}, S.DOMAIN_TEXT).first()
    assert (got["DATASET"], got["DOMAIN"], got["RECORDS"]) == ("ADSL", "Subject Level", 2)


def test_csv_returns_texts_as_they_were(spark, tmp_path):
    texts = ["two\nlines", " pad ", "", None, 'say "x"', "a,b", "back\\slash", "\t", "'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    path = D.write_domain(df, str(tmp_path / "t.csv"), "csv")
    assert sorted(D.read_domain(spark, path, df.schema).collect()) == sorted(df.collect())


def test_csv_value_of_another_type_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "n string")
    path = D.write_domain(df, str(tmp_path / "t.csv"), "csv")
    with pytest.raises(Exception, match="MALFORMED|x"):
        D.read_domain(spark, path, D.T.StructType([D.T.StructField("n", D.T.IntegerType())])).collect()


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]

    def cut(size):
        for name, value in zip(names, (size, 1)):
            spark.conf.set(name, str(value))

    yield cut
    for name in names:
        spark.conf.unset(name)


def nasty_rows(n):
    pick = random.Random(7)
    bits = ["a", '"', ",", "\n", "\r", "\r\n", " ", "\\", "é", "x" * 30]
    text = lambda: None if pick.random() < 0.1 else "".join(pick.choice(bits) for _ in range(pick.randint(0, 9)))
    return [(i, text(), pick.choice([None, "", "x\ny"]), pick.random(), text()) for i in range(n)]


@pytest.mark.parametrize("size", [37, 211, 5000, 1 << 27])
def test_csv_read_in_pieces_equals_the_reader_of_whole_files(spark, tmp_path, small_blocks, size):
    df = spark.createDataFrame(nasty_rows(300), "n int, `A b` string, u string, d double, last string").repartition(2)
    path = D.write_domain(df, str(tmp_path / "t.csv"), "csv")
    want = D.read_domain(spark, path, df.schema, whole_files=True).collect()
    small_blocks(size)
    got = D.read_domain(spark, path, df.schema)
    assert len(want) == 300 and sorted(map(repr, got.collect())) == sorted(map(repr, want))
    assert got.schema == df.schema
    assert sorted(r["n"] for r in got.select("n").collect()) == list(range(300))


def test_csv_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    rows = [(i, "a\nb" * 20) for i in range(2000)]
    df = spark.createDataFrame(rows, "n int, t string").coalesce(1)
    path = D.write_domain(df, str(tmp_path / "t.csv"), "csv")
    small_blocks(20_000)
    back = D.read_domain(spark, path, df.schema)
    tasks = back.select(F.spark_partition_id().alias("p"), "n").groupBy("p").count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 1000
    assert sorted(back.collect()) == rows


@pytest.mark.parametrize("size", [5, 64, 1 << 27])
@pytest.mark.parametrize("text, want", [
    ("n,t\r\n1,a\r\n\r\n2,\"b\nc\"\r\n", [(1, "a"), (2, "b\nc")]),
    ("n,t\n1,a\n2,\"end\n\n\nof \"\"it\"\"\"", [(1, "a"), (2, 'end\n\n\nof "it"')]),
    ("\"n\",T\n1,\"\"\n2,\\N\n", [(1, ""), (2, None)]),
    ("n,t\n", []),
    ("", []),
])
def test_csv_line_ends_headers_and_empty_files(spark, tmp_path, small_blocks, size, text, want):
    (tmp_path / "t.csv").write_text(text, newline="")
    small_blocks(size)
    got = D.read_domain(spark, str(tmp_path / "t.csv"), D.T.StructType.fromDDL("n int, t string"))
    assert sorted(map(tuple, got.collect())) == want


def test_csv_header_may_cross_blocks_and_must_fit(spark, tmp_path, small_blocks):
    kind = D.T.StructType([D.T.StructField("long\nname", D.T.IntegerType()), D.T.StructField("t", D.T.StringType())])
    (tmp_path / "t.csv").write_text('"long\nname",t\n1,a\n', newline="")
    small_blocks(4)
    assert [tuple(r) for r in D.read_domain(spark, str(tmp_path / "t.csv"), kind).collect()] == [(1, "a")]
    with pytest.raises(Exception, match="does not fit the schema"):
        D.read_domain(spark, str(tmp_path / "t.csv"), D.T.StructType.fromDDL("n int, t string")).collect()

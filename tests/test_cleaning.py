import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.operators.encoding import BinaryEncoder, OneHotEncoder, binary_encode, one_hot_encode, one_hot_vector
from veilwright.operators.metadata import detect_kinds
from veilwright.operators.missing import handle_missing, missing_report, modes
from veilwright.operators.splitting import train_test_split, with_folds
from veilwright.plans.preprocess import preprocess
from veilwright.sources.hierarchy_files import read_hierarchy
from veilwright.sources.quoted import _lines, _starts, largest_file, split_bytes
from veilwright.sources.tables import load_table, write_table

ODD = "odd name (x)\t"


def test_load_infers_types_around_missing_tokens(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('id;x;flag;name;"odd name (x)\t";empty\n1;NA;true;"a;b";1.5;\n2;7;false;"say ""hi""";;\n3;;TRUE;NaN;2;\n')
    df, name = load_table(spark, str(path), ";")
    assert name == "people"
    assert [f.dataType.simpleString() for f in df.schema.fields] == [
        "bigint", "bigint", "boolean", "string", "double", "double"]
    rows = df.orderBy("id").collect()
    assert [r["x"] for r in rows] == [None, 7, None]
    assert [r["name"] for r in rows] == ["a;b", 'say "hi"', None]
    assert [r[ODD] for r in rows] == [1.5, None, 2.0]


def test_load_with_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\nN/A,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df, _ = load_table(spark, str(path), ",", schema)
    assert df.schema["a"].dataType == T.IntegerType() and sorted(df.collect(), key=str) == sorted(
        [(1, "x"), (None, None)], key=str)


HARD = [
    (1, "plain", "x"), (2, 'two\nlines "quoted"', "y"), (3, "a;b", ""), (4, '"', "\n"), (5, '""\n""', ";"), (6, "\n\n\n", "z"),
    (7, "long " * 300 + "\n" + "more\n" * 200, "w"), (8, " outer blanks ", "tab\t"), (9, "ünï\n漢字", "é"), (10, None, None),
    (11, "; \n;;\n" * 150, "end"), (12, "last", "one")]


@pytest.mark.parametrize("size", [64, 333, 1000, 5000])
def test_large_quoted_files_are_split(spark, tmp_path, setting, size):
    """Ranges of a file that begin anywhere, inside cells too, give the records that one task reads; two files, odd headers."""
    rows = [(i * 20 + n, t, u) for i in range(4) for n, t, u in HARD]
    df = spark.createDataFrame(rows, 'id long, `a "long"\nname` string, u string').coalesce(1)
    path = str(tmp_path / "t")
    write_table(df.where("id < 50"), path, "csv", ";")
    df.where("id >= 50").write.mode("append").option("header", True).option("sep", ";").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    want = sorted(load_table(spark, path, ";", df.schema)[0].collect(), key=lambda r: r["id"])
    setting("spark.sql.files.maxPartitionBytes", str(size))
    setting("spark.sql.files.openCostInBytes", "1")
    got = load_table(spark, path, ";", df.schema)[0]
    assert largest_file(spark, path) > split_bytes(spark) and got.columns == df.columns
    assert sorted(got.collect(), key=lambda r: r["id"]) == want and len(want) == 48
    assert len(_starts(_lines(spark, path))) > 5 or size == 5000


def test_split_files_of_other_hands(spark, tmp_path, setting):
    """Blank lines, line ends of two bytes, a record that is longer than many ranges, no line end at the end."""
    setting("spark.sql.files.maxPartitionBytes", "40")
    setting("spark.sql.files.openCostInBytes", "1")
    path = tmp_path / "t.csv"
    path.write_bytes(b'id,t\r\n1,"x ""y"" z"\r\n\r\n2,"' + b'ab\n' * 60 + b'"\r\n3,plain text that goes on and on and on\r\n4,"e"",""f"')
    got = {r["id"]: r["t"] for r in load_table(spark, str(path))[0].collect()}
    assert got == {1: 'x "y" z', 2: "ab\n" * 60, 3: "plain text that goes on and on and on", 4: 'e","f'}


def test_hierarchy_file(spark, tmp_path):
    path = tmp_path / "sex.csv"
    path.write_bytes('﻿M;Person;*\n"""""";Unknown;*\n;;*\n'.encode())
    got = {r["value"]: r["labels"] for r in read_hierarchy(spark, str(path)).collect()}
    assert got == {"M": ["Person", "*"], '""': ["Unknown", "*"], "": ["", "*"]}


def test_strategies(spark, mixed):
    assert handle_missing(mixed, None) is mixed
    assert [r["id"] for r in handle_missing(mixed, "drop").orderBy("id").collect()] == [1, 6]
    mean = {r["id"]: r for r in handle_missing(mixed, "mean").collect()}
    assert mean[2]["a"] == 4 and mean[3]["b"] == pytest.approx(3.75) and mean[4]["b"] == pytest.approx(3.75)
    assert mean[4]["c"] is None and mean[5][ODD] == 7.0
    median = {r["id"]: r for r in handle_missing(mixed, "median").collect()}
    assert median[2]["a"] == 4 and median[3]["b"] == 2.0
    mode = {r["id"]: r for r in handle_missing(mixed, "mode").collect()}
    assert mode[4]["c"] == "a" and mode[2]["a"] == 4 and mode[3]["b"] == 2.0
    assert handle_missing(mixed, "mean").schema["a"].dataType == T.IntegerType()
    with pytest.raises(ValueError):
        handle_missing(mixed, "magic")


def test_mode_breaks_ties_by_number_order(spark):
    df = spark.createDataFrame([(10,), (9,)], "x int")
    assert modes(df).first()["mode"] == "9"


def test_report(spark, mixed):
    r = missing_report(mixed, handle_missing(mixed, "drop"), "m").first()
    assert (r["original_rows"], r["processed_rows"], r["missing_before"], r["missing_after"], r["dropped_rows"]) == (
        6, 2, 5, 0, 4)
    empty = mixed.where("false")
    assert missing_report(empty, empty).first()["missing_before"] == 0


@pytest.mark.parametrize("limit", [256, 0])
def test_binary_encoding(spark, limit):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "x", 3), (None, "x", 4)], "k string, one string, n int")
    enc = BinaryEncoder.fit(df, inline_limit=limit)
    out = {r["n"]: (r["k_0"], r["k_1"]) for r in enc.transform(df).collect()}
    assert out == {1: (0, 1), 2: (1, 0), 3: (1, 1), 4: (0, 0)}
    assert enc.transform(df).columns == ["k_0", "k_1", "n"]  # the constant column is dropped
    new = spark.createDataFrame([("zzz", "x", 9)], "k string, one string, n int")
    assert enc.transform(new).first()[:2] == (0, 0)


def test_encoders_leave_numbers_alone(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, t double")
    out, info = binary_encode(df, "t")
    assert out.columns == df.columns and info["new_columns"] == []
    assert one_hot_encode(df).columns == df.columns


def test_one_hot(spark):
    r = spark.createDataFrame([("b", "y"), ("a", "n"), (None, "y")], "k string, t string")
    s = spark.createDataFrame([("c", "n")], "k string, t string")
    enc = OneHotEncoder.fit([r, s], "t")
    assert enc.transform(s).columns == ["t", "k_b", "k_c"]
    assert {tuple(x) for x in enc.transform(r).collect()} == {("y", True, False), ("n", False, False), ("y", False, False)}
    with pytest.raises(ValueError):
        OneHotEncoder.fit(r, "t", max_categories=1)
    assert one_hot_vector(r, ["k"]).count() == 3


def test_split_and_folds(spark):
    df = spark.range(5000).withColumn("label", F.when(F.col("id") % 3 == 0, "rare").otherwise("hot"))
    train, test = train_test_split(df, "id")
    assert train.count() + test.count() == 5000 and abs(test.count() - 1000) < 100
    again = train_test_split(df.repartition(7), "id")[1]
    assert test.exceptAll(again).count() == 0
    sizes = with_folds(df, "id", 5, stratify="label").groupBy("label", "fold").count().collect()
    for name in ("rare", "hot"):
        mine = [r["count"] for r in sizes if r["label"] == name]
        assert len(mine) == 5 and max(mine) - min(mine) <= 1


def test_kinds(spark):
    df = spark.range(200).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 4).alias("code"), (F.col("id") % 50).alias("num"),
        (F.col("id") % 2 == 0).alias("flag"), (F.col("id") / 3).alias("real"), (F.col("id") % 3 - 1).alias("signed"),
        F.lit("x").alias("word"), F.timestamp_seconds("id").alias("at"))
    assert detect_kinds(df) == {
        "id": "id", "name": "id", "code": "categorical", "num": "numerical", "flag": "categorical",
        "real": "numerical", "signed": "numerical", "word": "categorical", "at": "numerical"}


def test_preprocess_reuses_only_what_is_unchanged(spark, tmp_path):
    path, folder = tmp_path / "d.csv", str(tmp_path / "cache")
    path.write_text("k,t,n\na,y,1\nb,n,\nc,y,3\n")
    first = preprocess(spark, str(path), ",", "t", cache_folder=folder)
    assert not first.reused and first.encoded.columns == ["k_0", "k_1", "t", "n"]
    assert first.report.first()["dropped_rows"] == 1
    assert preprocess(spark, str(path), ",", "t", cache_folder=folder).reused
    assert not preprocess(spark, str(path), ",", "t", "mean", cache_folder=folder).reused
    path.write_text("k,t,n\na,y,1\nb,n,2\nc,y,3\nd,y,3\n")
    changed = preprocess(spark, str(path), ",", "t", cache_folder=folder)
    assert not changed.reused and changed.cleaned.count() == 4


def test_write_and_read_back(spark, mixed, tmp_path):
    out = write_table(mixed, str(tmp_path / "t"), "csv", "\t")
    assert load_table(spark, out, "\t", mixed.schema)[0].count() == 6
    with pytest.raises(ValueError):
        write_table(mixed, str(tmp_path / "u"), "xml")


def test_large_quoted_texts_are_written_by_many_tasks(spark):
    """One task used to write all rows."""
    from veilwright.catalogue.cleaning import large_files

    docs = spark.range(200).select("id", F.repeat(F.lit("x"), 10).alias("text"))
    assert large_files(docs).rdd.getNumPartitions() == 1
    assert large_files(docs, 500).rdd.getNumPartitions() == 4 and large_files(docs, 500).count() == 200
    assert large_files(docs.where("false"), 500).rdd.getNumPartitions() == 1

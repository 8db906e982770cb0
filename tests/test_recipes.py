import pytest

from counterfair.operators import recipes

BANK = ["age", "job", "balance", "duration", "pdays", "previous", "day", "y"]


def test_bank_by_fixed_lists(spark):
    df = spark.createDataFrame([("58", "management", "-2000", "2610", "-1", "3", "5", "no"),
                                ("5", "services", "120", "9", "12", "0", "6", "yes")], ", ".join(f"{c} STRING" for c in BANK))
    rows = sorted(map(tuple, recipes.encode_bank(df).collect()))
    assert rows == [(1, 11, 2, 0, 0, 0, 6, 1), (5, 3, -20, 99, 1, 1, 5, 0)]
    bad = spark.createDataFrame([("58", "pilot", "0", "0", "0", "0", "5", "no")], ", ".join(f"{c} STRING" for c in BANK))
    with pytest.raises(Exception, match="not in list"):
        recipes.encode_bank(bad).collect()


def test_answer_to_numbers(spark):
    text = "Age: 42\nWorkclass: Private\nEducation: Bachelors\nMarital Status: Divorced\nRace: Martian\nSex: Male\nCapital Gain: 5000\nCapital Loss: 0\nHours per Week: 38\nNative Country: United-States"
    row = recipes.encode_answer(spark.createDataFrame([(text,)], "t STRING"), "t").first()
    assert (row["Age"], row["Workclass"], row["Education"], row["Marital Status"]) == (42, 1, 1, 2)
    assert (row["Race"], row["Sex"], row["Capital Gain"], row["Occupation"]) == (None, 1, 5000, None)
    assert row["Hours per Week"] == 38


def test_students(spark):
    names = "school STRING, age STRING, Mjob STRING, absences STRING, G1 STRING, G2 STRING, G3 STRING"
    mat = spark.createDataFrame([("GP", "18", "teacher", "6", "5", "6", "9")], names)
    por = spark.createDataFrame([("MS", "17", "at_home", "4", "5", "5", "10")], names)
    rows = sorted(map(tuple, recipes.encode_students(mat, por).collect()))
    assert rows == [(0, 18, 2, 6, 5, 6, 0), (1, 17, 1, 4, 5, 5, 1)]


def test_raw_table_with_late_category_and_dotted_name(spark):
    rows = [(str(i), "7", "a") for i in range(8)] + [("x", "", "b")]
    df = spark.createDataFrame(rows, "`job.code` STRING, age STRING, y STRING").coalesce(1)
    ready = recipes.prepare_raw(df, age="negated")
    assert ready.categorical == ["job.code", "age"] and ready.target == "y"
    assert ready.encoder_table().filter("col = 'job.code'").count() == 9
    got = {tuple(r) for r in ready.table.collect()}
    assert (8, 0, 1) in got and (0, 1, 0) in got

import pytest
from pyspark.sql import functions as F

from counterfair.operators import prepare, profile


def test_label_last_requires_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a INT, y INT, b INT")
    assert prepare.label_last(df, "y").columns == ["a", "b", "y"]
    with pytest.raises(ValueError):
        prepare.label_last(df, "z")


def test_negated_age_blank_and_bad_are_old(spark):
    df = spark.createDataFrame([("-39",), ("-40",), ("",), ("x",), (None,), ("12",)], "v STRING")
    got = [r[0] for r in df.select(prepare.binarize_threshold(F.col("v"), negated=True)).collect()]
    assert got == ["young", "old", "old", "old", "old", "young"]


def test_detection_reads_the_whole_column(spark):
    rows = [(str(i),) for i in range(6)] + [("?",)]
    df = spark.createDataFrame(rows, "v STRING").coalesce(1)
    assert profile.detect_categorical(df, ["v"]).first()["categorical"] == 1
    suffixed = spark.createDataFrame([("1d",), ("2",)], "v STRING")
    assert profile.detect_categorical(suffixed, ["v"]).first()["categorical"] == 1
    assert [r["v"] for r in prepare.mean_impute(suffixed, ["v"]).collect()] == [2.0, 2.0]


def test_null_stays_null_when_clipped(spark):
    df = spark.createDataFrame([(None,), (-5,), (50,)], "v INT")
    assert [r["v"] for r in prepare.clip_to_bounds(df, {"v": (0, 9)}).collect()] == [None, 0, 9]
    assert [r[0] for r in df.select(prepare.scale_clip(F.col("v"), 1, 0, 9)).collect()] == [None, 0, 9]
    assert [r["b"] for r in prepare.equal_width_bin(df, "v", 5, "b").collect()] == [None, 1, 5]
    assert [r["v"] for r in prepare.out_of_bounds(df, {"v": (0, 9)}).collect()] == [-5, 50]


def test_last_line_of_a_repeated_key_counts(spark):
    df = spark.createDataFrame([("a: 1\n\n\nb : x:y\na:2",), (None,), ("",)], "t STRING")
    got = [tuple(r) for r in df.select(*prepare.parse_key_values(F.col("t"), ["a", "b", "c"])).collect()]
    assert got == [("2", "x:y", None), (None, None, None), (None, None, None)]


def test_bounds_are_numeric_not_lexicographic(spark):
    df = spark.createDataFrame([("9", "x"), ("100", ""), ("-2.5", "?"), ("", None)], "n STRING, t STRING")
    assert profile.bounds_dict(profile.column_bounds(df, ["n", "t"])) == {"n": (-3, 100), "t": (0, 0)}


def test_codes_are_places_among_the_sorted_values(spark):
    df = spark.createDataFrame([(f"v{i * 37 % 101:03d}", f"w{i * 11 % 7}", None) for i in range(300)], "v STRING, w STRING, x STRING")
    encoder = prepare.label_encoder(df, "v")
    assert encoder.dtypes == [("value", "string"), ("code", "bigint")]
    assert {tuple(r) for r in encoder.collect()} == {(f"v{i:03d}", i) for i in range(101)}
    many = profile.column_codes(df.repartition(9), ["v", "w", "x"])
    want = {("v", f"v{i:03d}", i) for i in range(101)} | {("w", f"w{i}", i) for i in range(7)}
    assert {tuple(r) for r in many.collect()} == want
    coded = prepare.encode_columns(df, many, ["v", "w", "x"]).collect()
    assert {(r["v"], r["w"], r["x"]) for r in coded} == {(i * 37 % 101, i * 11 % 7, None) for i in range(300)}
    assert prepare.label_encoder(df.limit(0), "v").count() == 0 and profile.column_codes(df.limit(0), ["v"]).count() == 0


def test_summary_of_all_columns_is_one_aggregate(spark):
    rows = [("9", "x", "1d", None), ("100", "", "2", ""), ("-2.5", "?", "", "")]
    got = profile.column_summary(spark.createDataFrame(rows, "n STRING, t STRING, d STRING, e STRING"), ["n", "t", "d", "e"])
    assert {c: r["categorical"] for c, r in got.items()} == {"n": False, "t": True, "d": True, "e": False}
    assert (got["n"]["lo"], got["n"]["hi"], got["n"]["mean"]) == (-3, 100, 35.5)
    assert (got["e"]["lo"], got["e"]["hi"], got["e"]["mean"]) == (0, 0, None)


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    from counterfair import session

    df = spark.createDataFrame([("x" * 1000, [1, 2]), (None, None)], "t STRING, a ARRAY<INT>")
    hinted = lambda d: "broadcast" in d.join(session.broadcast_if_small(d), "t")._jdf.queryExecution().logical().toString().lower()
    assert hinted(df)
    monkeypatch.setattr(session, "SMALL_BYTES", 900)
    assert not hinted(df)


def test_decode_inverts_encode_and_unknown_is_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "v STRING")
    encoder = prepare.label_encoder(df, "v")
    coded = prepare.label_encode(df, "v", encoder, "code")
    assert sorted((r["v"], r["code"]) for r in coded.collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    back = prepare.label_decode(coded, "code", encoder, "w")
    assert all(r["v"] == r["w"] for r in back.collect())
    other = spark.createDataFrame([("zz",)], "v STRING")
    assert prepare.label_encode(other, "v", encoder).first()["v"] is None


def test_enum_encode_rejects_unknown(spark):
    known = spark.createDataFrame([("yes",)], "v STRING")
    assert known.select(prepare.enum_encode(F.col("v"), ["no", "yes"])).first()[0] == 1
    df = spark.createDataFrame([("maybe",)], "v STRING")
    with pytest.raises(Exception, match="not in list"):
        df.select(prepare.enum_encode(F.col("v"), ["no", "yes"])).collect()


def test_scale_clip_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-199,), (199,), (99999,), (-99999,)], "v INT")
    got = [r[0] for r in df.select(prepare.scale_clip(F.col("v"), 50, -20, 179)).collect()]
    assert got == [-3, 3, 179, -20]


def test_equal_width_bin_matches_cut(spark):
    import pandas as pd

    numbers = [0, 1, 5, 10, 11, 20, 33, 50, 75, 90, 99, 100]
    df = spark.createDataFrame([(n,) for n in numbers], "v INT")
    got = {r["v"]: r["b"] for r in prepare.equal_width_bin(df, "v", 9, "b").collect()}
    want = pd.cut(pd.Series(numbers), 9, labels=list(range(1, 10))).astype(int)
    assert got == dict(zip(numbers, want))
    flat = spark.createDataFrame([(7,), (7,)], "v INT")
    assert [r["v"] for r in prepare.equal_width_bin(flat, "v", 9).collect()] == [1, 1]


def test_mean_impute(spark):
    df = spark.createDataFrame([("1",), ("",), ("bad",), ("3",), (None,)], "v STRING")
    assert [r[0] for r in prepare.mean_impute(df, ["v"]).collect()] == [1.0, 2.0, 2.0, 3.0, 2.0]


def test_clip_is_idempotent_and_flags_what_it_changes(spark):
    bounds = {"a": (0, 7), "b": (0, 13)}
    df = spark.createDataFrame([(100, 5), (3, -1), (7, 13)], "a INT, b INT")
    once = prepare.clip_to_bounds(df, bounds)
    assert once.collect() == prepare.clip_to_bounds(once, bounds).collect()
    assert prepare.out_of_bounds(df, bounds).count() == 2 and prepare.out_of_bounds(once, bounds).count() == 0


def test_key_values_with_dictionary(spark):
    df = spark.createDataFrame([("Age: 42\nWorkclass: Private\nMarital Status: Divorced",)], "t STRING")
    row = df.select(*prepare.parse_key_values(F.col("t"), ["Age", "Workclass", "Race"])).first()
    assert (row["Age"], row["Workclass"], row["Race"]) == ("42", "Private", None)


def test_one_hot_and_mask(spark):
    df = spark.createDataFrame([(0, 5), (1, 6)], "y INT, p INT")
    assert [r[0] for r in df.select(prepare.one_hot_label(F.col("y"))).collect()] == [[1, 0], [0, 1]]
    assert [r["p"] for r in prepare.mask_protected(df, ["p"]).collect()] == [0, 0]
    assert prepare.mask_protected(df, ["p"], drop=True).columns == ["y"]


def test_schema_prompt_order_and_wording(spark):
    df = spark.createDataFrame([("3", "b"), ("7", "a")], "size STRING, kind STRING")
    row = profile.schema_prompt(profile.column_profile(df, ["kind", "size"], ["kind"]), profile.category_values(df, ["kind"])).first()
    assert row["attributes"] == " kind (['a', 'b']) size (numerical value, range is 3 - 7)"
    assert row["template"] == '{"kind":..., "size":...}'

"""Whole preparations of raw tables, put together from ``operators.prepare``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.functions.scalar import number, q
from counterfair.operators import prepare, profile
from counterfair.sources import datasets


@dataclass
class Prepared:
    """Encoded table with what is needed to read it back: features, codes (col, value, code), profile."""

    table: DataFrame
    features: list[str]
    target: str
    categorical: list[str]
    codes: DataFrame
    profile: DataFrame

    def encoder_table(self) -> DataFrame:
        """(col, value, code) over all categorical features."""
        return self.codes.filter(F.col("col").isin(self.categorical)).withColumn("code", F.col("code").cast("int"))


def prepare_raw(raw: DataFrame, age: str | None = None, age_column: str = "age") -> Prepared:
    """Encode an all-string table whose last column is the label.

    Age is cut into young and old if asked; categorical columns are found and label-encoded, the
    label like any of them; the other columns become numbers with blanks filled by the mean. However many columns there
    are, the table is read three times: for detection, bounds and means; for the distinct values, which only
    categorical columns send; and to be encoded.
    """
    target, features = raw.columns[-1], raw.columns[:-1]
    table = raw
    if age:
        table = table.withColumn(age_column, prepare.binarize_threshold(q(age_column), negated=age == "negated"))
    summary = profile.column_summary(table, features)
    categorical = [c for c in features if summary[c]["categorical"]]
    codes = profile.column_codes(table, [*categorical, target])
    means = {
        c: F.coalesce(number(q(c).cast("string")), F.lit(summary[c]["mean"]).cast("double")) for c in features if c not in categorical
    }
    coded = prepare.encode_columns(table, codes, [*categorical, target]).withColumns(means)
    counts = codes.groupBy("col").agg(F.max("code").alias("hi"))
    shape = profile.shaped(features, {c: (summary[c]["lo"], summary[c]["hi"]) for c in means}, counts, raw)
    return Prepared(coded.select(*[q(c) for c in raw.columns]), features, target, categorical, codes, shape)


def encode_bank(raw: DataFrame) -> DataFrame:
    """Bank table by its fixed value lists and scales; an unknown value is an error."""
    def column(name: str) -> Column:
        if name in datasets.BANK_VALUES:
            return prepare.enum_encode(q(name), datasets.BANK_VALUES[name])
        if name in datasets.BANK_SCALES:
            return prepare.scale_clip(q(name), *datasets.BANK_SCALES[name])
        if name == "pdays":
            return prepare.sentinel_flag(q(name))
        return q(name).cast("int")

    return raw.select(*[column(c).alias(c) for c in raw.columns])


def encode_answer(answers: DataFrame, text: str) -> DataFrame:
    """Numbers from ``Key: value`` answers about a person; an unknown category is NULL."""
    keys = [*datasets.ANSWER_NUMBERS, *datasets.ANSWER_CODES]
    parsed = answers.select("*", *prepare.parse_key_values(F.col(text), keys))
    coded = {k: prepare.dict_encode(q(k), codes) for k, codes in datasets.ANSWER_CODES.items()}
    return parsed.withColumns({**coded, **{k: q(k).try_cast("int") for k in datasets.ANSWER_NUMBERS}})


def encode_students(*tables: DataFrame) -> DataFrame:
    """Student tables in one: categories coded by value, some codes from 1, pass mark as label."""
    table = prepare.union_tables(*tables)
    names = [c for c in table.columns if c not in datasets.STUDENT_PLAIN]
    coded = prepare.encode_columns(table, profile.column_codes(table, names), names)
    coded = prepare.shift_codes(coded, [c for c in datasets.STUDENT_SHIFTED if c in coded.columns])
    numbers = {c: q(c).cast("int") for c in datasets.STUDENT_PLAIN if c in coded.columns}
    return coded.withColumns({**numbers, "G3": prepare.binarize_label(q("G3").cast("int"))}).select(*table.columns)

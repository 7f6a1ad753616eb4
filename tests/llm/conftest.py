from __future__ import annotations

import pytest

#: Nulls, an empty and a very long text, equal rows, a doc_id on two texts, a null doc_id; and
#: columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, k string, kept string, label string, row_no string"
ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, "One two three four five six seven eight. Next one here.\nLast line.", "en", "s"),
    (4, "ONE two three four five six seven eight. Next one here.\nLast line.", None, "s"), (5, "word " * 30_000, "en", "s"), (6, "a" * 3_000, "en", None),
    (7, "zwölf Boxkämpfer jagen Viktor quer über den Deich é ñ", "de", "s"), (7, "another text under the same id", "en", "s"), (8, "same", "en", "s"), (8, "same", "en", "s"),
    (None, "no id", "en", "s"), (9, " \t\n ", "en", "s"), (10, "123 !!! 456", "en", "s"), (11, "don't  we'LL\n\n'tis <|endoftext|> <| x\x00y", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "x", "x", "x", "x") for i, t, lang, s in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

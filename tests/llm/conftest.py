import pytest

#: Texts that an operator must stand: null, empty, white space only, repeated, very long, other scripts, special names.
ODD = [None, "", " \n\t ", "a", "a", "It's 12 o'clock, déjà VU!", "Σας ΟΔΟΣ", "é İ x y\x1cz\x85w", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "日本語 テキスト 🙂🙂", "x" * 5000, "ab " * 3000, "1 2 3 4.5.6.7 " * 50]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "clash", 0.5) for i, t in enumerate(ODD)] + [(3, "a", "clash", 0.5), (None, "no id at all", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, row double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

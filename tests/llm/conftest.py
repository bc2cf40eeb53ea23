import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A checkpoint folder where the session names none, as on a developer's machine."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    """documents with nulls, empty and long texts, ties, repeated rows, and columns named like internal ones."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, sid bigint, rank int, `__id` int"
    base = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i % 977}y{i % 13}" for i in range(30_000))
    rows = [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
        (9, long), (10, long + " more"), (11, "ÀÉ é  two  spaces x\n\n"), (None, base), (None, "alone in the world with no id"),
        (12, "unique words only here in this row of the table"), (12, "another text under the same number as before"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 3, 1, 0) for i, t in rows], schema)

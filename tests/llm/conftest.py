import pytest

LONG = ("harbour lantern meadow quartz ripple " * 9000).strip()
#: doc_id, text, lang, source: nulls, empty and blank texts, a very long one, ties and repeated rows
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, "b"), (4, LONG, "en", None), (5, "one", "en", "b"),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "fr", "a"), (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "fr", "a"),
    (7, "a  b c d e f g h i j k l m n o p q r s t u v w x\ty z", None, "c"), (8, "Ünïcode 😀 wörds — “quoted” don't we'll <|endoftext|> 12 ½  x", "de", "c"),
    (None, "no id here", "en", None), (None, None, None, None), (9, "x" * 70_000, "es", "a"), (10, "\u0000 ​ tab\u000bvertical", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with extra columns whose names clash with those the operators use."""
    extra = ", ".join(f"{n} int" for n in ("size", "key", "band", "rep", "label", "score", "taken", "shard", "print", "_id", "_drop_id", "skey", "n", "_times", "_copy", "row", "times", "row_key"))
    rows = [(*r, *[i] * 18) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, f"{SCHEMA}, n_chars long, {extra}".replace("n_chars long, ", ""))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"{SCHEMA}, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}

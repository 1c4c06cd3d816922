import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents with columns whose names clash with those of results."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({n: F.lit(1) for n in ("score", "shard", "slot", "n_words", "kept", "cls", "root", "length", "rank")})


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals look on from the old stone wall "
ODD = [
    (1, PROSE * 3 + "end"), (2, PROSE * 3 + "end"), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "One"),
    (None, PROSE), (None, None), (8, LONG), (9, LONG + " tail"), (10, "a b 　 ć \x1c d <|endoftext|> 's"),
    (11, PROSE), (11, PROSE), (11, "same id, other text"), (12, "don't stop\r\n\r\n  two  blanks  "), (13, "ÄÖÜ été ñandú 漢字 🙂"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, ODD[:1]).where("false")

import random

import regex
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.sources import store


def test_fast_tokens_are_the_tokens(spark):
    random.seed(5)
    texts = ["".join(random.choices("ab1٣é²9._-. ,\n", k=random.randrange(40))) for _ in range(3000)] + ["1.2.3", "a1.2b.3", "1..2", ".5", "x-1.0_y.z"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    found = {r["i"]: r for r in df.select("i", text.tokens(F.col("x")).alias("t"), text.token_set(F.col("x")).alias("s")).collect()}
    for i, x in enumerate(texts):
        assert regex.findall(text.FAST_TOKEN, x) == regex.findall(text.TOKEN, x), x
        assert found[i]["t"] == text.tokenize(x) and set(found[i]["s"]) == set(found[i]["t"]), x


def test_words_of_an_index_are_exchanged_as_hashes(spark):
    rows = spark.createDataFrame([("f", "a long-word a", "a", "S")], "file string, message string, raw string, source string")
    words = store._words(rows)
    assert words.dtypes == [("file", "string"), ("a", "bigint"), ("b", "bigint")] and words.count() == 5  # a long-word long word s

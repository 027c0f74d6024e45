"""Small tables with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""

import random

from pyspark.sql import types as T

WORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this have from".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le de la et les des un une que est dans qui par pour au sur pas plus ne se".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, cls long, key string, n int, rank int, language string, x int, path int, page_id string"


def prose(lang: str, n: int, seed: int) -> str:
    g = random.Random(seed)
    return " ".join(g.choice(WORDS[lang]) + (g.choice("abcdefgh") * g.randint(0, 3) if g.random() < 0.4 else "") for _ in range(n)).capitalize() + "."


def rows() -> list[tuple]:
    out: list[tuple] = []
    add = lambda i, text, lang="en", source="a": out.append((i, text, lang, source, len(text) if text else None, 1, 0.5, 7, "k", 2, 1, "zz", 3, 4, "p"))
    for i in range(40):
        lang = ("en", "de", "fr")[i % 3]
        add(i, prose(lang, 30 + i, i), lang, "hot" if i % 3 else f"s{i % 5}")
    add(100, out[3][1])  # an exact copy
    add(101, out[4][1] + " one more word at the end", "de")  # a near copy
    add(102, out[4][1] + " other words at its very end", "de")
    add(103, None)
    add(104, "")
    add(105, " \t\n\r \x0b\x0c")
    add(106, "four words are here")
    add(107, "four words are here")
    add(108, "x" * 60_000)
    add(109, prose("en", 30_000, 9))
    add(110, "Ünïcödé ΣΑΣ 中文 ́x İ! <|endoftext|> don't", None, None)
    add(None, "an id is missing here but the text is not", "en", None)
    add(None, "an id is missing here but the text is not", "en", None)
    add(111, None, None, None)
    add(5, out[5][1], "fr", out[5][3])  # rows repeated
    add(5, out[5][1], "fr", out[5][3])
    add(6, "the same id but quite another text than the first one", "en", "s1")
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pages(spark, data):
    return spark.createDataFrame(data, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("value", T.IntegerType())]))

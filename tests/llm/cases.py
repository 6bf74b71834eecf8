"""Small tables with the cases that every operator must take."""

import os

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, media string"


def rows():
    long = " ".join(f"word{k % 700}" for k in range(30_000))
    body = "the quick brown fox jumps over the lazy dog while the cat sleeps under a tall tree near the old river bank"
    texts = [(0, None), (1, ""), (2, " \n\t \n"), (3, long), (4, body), (5, body), (6, body + " today"), (7, body.upper()), (8, "é ü 東京 \U0001f600 x"), (9, "one\r\ntwo\x0bthree\x00four"), (10, "a" * 5000), (11, "<|endoftext|> and <s> </s>"), (12, "Mixed CASE Words, 12 34"), (13, body + "\n" + body), (5, body), (None, body), (None, "null id")]
    texts += [(100 + k, f"line shared by many\nown line {k}\n  Line SHARED by many  \nx") for k in range(12)]
    return [(d, t, "en", "s", 0 if t is None else len(t), 7, "m") for d, t in texts]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def write(spark, to, data=None, **others):
    """A folder of tables: documents of ``data``, and others by name."""
    table(spark, data).write.mode("overwrite").parquet(f"{to}/documents.parquet")
    for name, df in others.items():
        df.write.mode("overwrite").parquet(f"{to}/{name}.parquet")
    return os.fspath(to)


def collected(df, *by):
    return sorted(map(tuple, df.collect()), key=repr)

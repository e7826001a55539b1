"""Documents with everything that operators have to take: nulls, empties, repeats, long texts, clashing column names."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, key string, n long, row long, _hash string, fp long, kept string, size string, ids string"


def odd(spark, extra=()):
    long_text = "word " * 30_000 + "ende"
    rows = [
        (1, "Hello world, this is a text."), (2, "Hello  world,\tthis is a text."), (3, None), (4, ""), (5, " \n\t "), (6, long_text), (7, long_text), (8, "x" * 70_000),
        (9, "ünï cödé ▁ 漢字 😀"), (10, "a@b.co and +1 (555) 123-4567, then 4111 1111 1111 1111; 10.0.0.1"), (None, "no id"), (None, None), (1, "Hello world, this is a text."), (11, "one"), (12, "two words"), *extra,
    ]
    return spark.createDataFrame([(i, t, "en" if t else None, None, None, "z", 0.5, "k", 1, 1, "h", 1, "no", "s", "i") for i, t in rows], COLUMNS)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

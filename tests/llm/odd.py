"""Rows that operators must withstand: nulls, empty and very long texts, repeated rows, clashing names."""

LONG = " ".join(f"w{i * i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, row string, rep long, digest string, size string, n string, pos int, id string, pass int, target string, part int, score string, name string, block string, component string"
ROWS = [
    (1, "One two three four five six seven eight"),
    (2, "One  two\tthree four five six\nseven eight"),
    (3, None),
    (4, ""),
    (5, "  \n "),
    (6, LONG),
    (7, LONG + " more"),
    (7, "One two three four five six seven eight"),
    (8, "Straße 漢字 😀 write to a.b@c.de or +49 30 1234 5678, 10.0.0.1, 4111 1111 1111 1111"),
    (9, "word"),
    (9, "word"),
    (None, "a text without an id"),
    (None, None),
]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, *[None] * 15) for k, (i, t) in enumerate(ROWS)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

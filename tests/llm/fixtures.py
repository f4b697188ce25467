"""Awkward documents: nulls, empty and long texts, ties, repeated rows, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, hash string, TEXT2 string"


def docs_of(spark, pairs):
    """A table of documents from (doc_id, text), with columns whose names the operators use themselves."""
    rows = [(d, t, "en", f"src{i % 3}", len(t or ""), "k", i, "h", t) for i, (d, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{i % 977} Ünï{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, "a small text\nwith two lines"), (2, None), (3, ""), (4, ""), (5, "a small text\nwith two lines"), (5, "a small text\nwith two lines"), (None, "a small text\nwith two lines"),
    (None, None), (6, LONG), (7, LONG), (8, "\n\n\n"), (9, " \t\n"), (10, "A small text\nwith two lines"), (7, "another text of the same id"), (11, "çé ñandú — “quoted” 漢字 😀 <|endoftext|>"),
]

"""Small frames with the awkward rows every operator must take."""

import random

CLASH = "id long, n long, key string, _h string, _t string, size long, cls long, v string, text_sha256 string"


def docs(spark, rows, clash=True):
    """(doc_id, text, source) rows as documents, with columns whose names the
    operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = (7, 7, "k", "h", "t", 7, 7, "v", "x") if clash else ()
    full = [(i, t, "en", s, None, *extra) for i, t, s in rows]
    return spark.createDataFrame(full, schema + (", " + CLASH if clash else ""))


def prose(seed, n_words, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n_words))


def awkward():
    """Nulls, empties, ties, repeated rows, a long text, odd characters."""
    long = prose(1, 40_000)
    return [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one two", "b"), (5, "ONE two", "b"),
            (6, "one two", None), (None, "one two", "b"), (7, prose(2, 60), "c"), (8, prose(2, 60), "c"),
            (8, prose(2, 60), "c"), (9, long, "c"), (10, long + " tail", "d"), (11, "ça İstanbul 漢字 \x00 x\r\ny", "d"),
            (12, "<|endoftext|> it's  two spaces ", "a"), (None, None, None), (13, prose(3, 60) + "\n" + prose(4, 9), "a")]

"""Documents with the odd cases that every operator must take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


def rows():
    """Nulls, empty and very long texts, repeated rows, ties, other scripts."""
    base = [
        (0, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"),
        (1, None), (2, ""), (3, "   \n\t "), (4, "!!! ???"), (5, "word"), (6, "two words"),
        (7, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"),
        (8, LONG), (9, LONG + " tail"), (10, "éà ñ ü ß 漢字 😀 \u0000 x"), (11, "x" * 50_000),
        (12, "the quick brown fox jumps over the lazy dog and runs away from the big bad bear"),
        (None, "a row without an id"), (None, None),
    ]
    out = [(i, t, "en", "src%d" % (k % 3) if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(base)]
    return [*out, out[0], out[5]]


def odd(spark):
    """The odd documents."""
    return spark.createDataFrame(rows(), DOC_SCHEMA)


def none(spark):
    """No documents."""
    return spark.createDataFrame([], DOC_SCHEMA)


def clashing(spark):
    """The odd documents with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("size", "key", "score", "root", "paths", "block", "draw", "slice", "target", "id", "part", "row", "taken", "sources", "_key", "label", "held_out")
    return odd(spark).select("*", *(F.lit("x").alias(n) for n in names))

"""Awkward document tables shared by the operator tests."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """(doc_id, text[, lang]) rows as a documents table, with clashing columns if asked."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] else None) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "body", "digest", "run", "slot", "page", "fp", "rep", "key", "cell", "capsule", "keep_id", "h"):
            df = df.withColumn(name, F.lit("clash"))
    return df


WORDS = "the of and thing onerend thatch within ferent alone garden river stone cloud number seven window".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


AWKWARD = [
    (1, "the same text"),
    (2, "the same text"),
    (2, "the same text"),
    (3, None),
    (4, ""),
    (5, "   \t\n "),
    (None, "no identifier"),
    (None, None),
    (6, "é ü ñ ça     x"),
    (7, prose(7, 20000)),
    (8, prose(7, 20000)),
    (9, "a"),
    (10, "The Same Text"),
    (11, "\x00 !?''s 12345 "),
]

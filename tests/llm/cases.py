"""Small tables that hold the awkward cases."""

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et magna".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text[, lang, source]); extra columns clash with inner names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for c in ("id", "n", "x", "y", "key", "line", "pos", "at", "raw", "words", "uid", "spans", "hits", "score", "rep", "more", "region", "h", "size", "target"):
            df = df.withColumn(c, F.lit(c))
    return df


def nothing(spark):
    return documents(spark, [], extra=False)

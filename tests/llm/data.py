"""Small tables with the awkward cases every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size long, fp long, shard int, slot int, taken long, toxic int, removed string, hits int, n_lines int, kind int, _bucket int"

A = "The quick brown fox jumps over the lazy dog near the river bank."
B = "Entirely different words are written here to keep this apart from others."
AWKWARD = [
    (5, A, "en", "s1", 1), (5, A, "en", "s1", 1),        # a repeated row
    (9, A, None, "s2", 1), (9, B, "en", None, 1),        # an id with two texts
    (None, A, "en", "s1", None), (None, None, None, None, None),
    (1, "", "en", "", 0), (2, None, "de", "s1", None), (3, "   \n\t ", None, "s2", 5),
    (4, "word " * 30_000, "en", "s1", 150_000),          # a very long text
    (6, B, "en", "s2", 1), (7, "x", "en", "s2", 1), (8, "$$$ 123 !!!", "en", "s2", 1),
]


def table(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c.split()[0]: F.lit(7).cast(c.split()[1]) for c in CLASH.split(", ")})
        df = df.withColumns({"a.b": F.lit("dot"), "_ka": F.lit(1), "_kb": F.lit(2), "_text": F.lit("no"), "_id": F.lit(3),
                             "notes": F.create_map(F.lit("k"), F.col("doc_id"))})
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

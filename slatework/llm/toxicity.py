"""Toxicity by a classifier chain (operator 3).

The categories are predicted one after the other; each linear model sees the
words of the text and the probabilities of all earlier categories. While the
later models are trained, those probabilities are out-of-fold predictions of
models that did not see the row, so a later model learns how far it can trust
an earlier one; for new text they come from a model fitted on all folds.

Training reads a bounded sample of the labelled rows (``sample`` rows, chosen
by a hash of the id); its vocabulary holds the words whose presence separates
a category best (log-likelihood ratio). Prediction is one pass over whole
texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import seeded, stored, table

SAMPLE = 20_000
WORDS_PER_CATEGORY = 500
LEAST_G = 20.0  # chance alone reaches it for one word in 100,000
FOLDS = 3
TRAIN_PARTS = 6
# category -> SQL of its 0/1 label over the columns of ``labels``, in chain order
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int, id_col: str,
             text_col: str) -> DataFrame:
    """At most ``sample`` labelled ids with their words, fold and 0/1 columns.

    Several label rows of an id count as their maximum; a null label leaves
    the id out; of repeated ids in ``docs`` the text with the least MD5 is used.
    """
    y = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        *[F.max(F.expr(sql)).cast("double").alias(f"y_{c}") for c, sql in categories.items()]).dropna()
    y = y.withColumn("_h", seeded(3, F.col("_id"))).orderBy("_h").limit(sample)
    x = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    x = x.join(F.broadcast(y), "_id")  # bounded by ``sample``, but for repeated ids
    x = x.groupBy("_id", "_h", *[f"y_{c}" for c in categories]).agg(F.min(F.struct(F.md5(F.col("_text").cast("binary")), "_text"))["_text"].alias("_text"))
    fold = F.pmod(F.crc32(F.col("_h").cast("binary")), F.lit(FOLDS)).cast("int")
    return x.select("_id", fold.alias("_fold"), *[f"y_{c}" for c in categories], tokens(F.col("_text")).alias("_words"))


def vocabulary(train: DataFrame, category: str, size: int, least: float = LEAST_G) -> list[str]:
    """The ``size`` words whose presence tells most about a category, by the
    log-likelihood ratio of the 2 x 2 table (Dunning's G), ``least`` at least."""
    y = f"y_{category}"
    n, pos = train.agg(F.count(F.lit(1)), F.sum(y)).first()
    if not pos or pos == n:
        return []
    seen = train.select(y, F.explode(F.array_distinct("_words")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p"))

    def part(seen_of: Column, row: Column, col: Column) -> Column:
        return F.when(seen_of > 0, seen_of * F.log(seen_of * n / (row * col))).otherwise(0.0)

    has, hit, lacks = F.col("_n"), F.col("_p"), n - F.col("_n")
    g = 2 * (part(hit, has, F.lit(pos)) + part(has - hit, has, F.lit(n - pos)) + part(pos - hit, lacks, F.lit(pos))
             + part(lacks - (pos - hit), lacks, F.lit(n - pos)))
    best = seen.select("word", g.alias("_g")).filter(F.col("_g") >= least).orderBy(F.desc("_g"), "word").limit(size)
    return [r.word for r in best.collect()]


@dataclass
class Chain:
    """A fitted chain; ``models`` is empty if no label was there to learn."""

    counter: CountVectorizerModel | None
    models: dict
    threshold: float

    def apply(self, df: DataFrame) -> DataFrame:
        """``_words`` -> ``p_<category>`` columns, each feeding the next."""
        x = self.counter.transform(df)
        for i, (c, model) in enumerate(self.models.items()):
            x = _score(model, _features(x, list(self.models)[:i]), c)
        return x


def _features(df: DataFrame, earlier: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=["_tf", *[f"p_{c}" for c in earlier]], outputCol="_features").transform(df)


def _fit(df: DataFrame, category: str):
    lr = LogisticRegression(featuresCol="_features", labelCol=f"y_{category}", probabilityCol="_probability",
                            rawPredictionCol="", predictionCol="", maxIter=40, regParam=0.01)
    return lr.fit(df)


def _score(model, df: DataFrame, category: str) -> DataFrame:
    x = model.transform(df)
    return x.withColumn(f"p_{category}", vector_to_array("_probability")[1]).drop("_probability", "_features")


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> Chain:
    train = stored(labelled(docs, labels, categories, sample, id_col, text_col), "labelled")
    words = list(dict.fromkeys(w for c in categories for w in vocabulary(train, c, WORDS_PER_CATEGORY)))
    if not words:
        return Chain(None, {}, 1.0)
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="_words", outputCol="_tf")
    counter = counter.setBinary(True)
    # the sample is bounded, so a few partitions hold it and each step of a fit is a short job
    rows = stored(counter.transform(train).drop("_words").coalesce(TRAIN_PARTS), "features")
    models = {}
    for c in categories:
        x = _features(rows, list(models)).persist()
        folds = [_score(_fit(x.filter(f"_fold <> {k}"), c), x.filter(f"_fold = {k}"), c) for k in range(FOLDS)]
        models[c] = _fit(x, c)
        held = folds[0]
        for f in folds[1:]:
            held = held.unionByName(f)
        rows = stored(held.coalesce(TRAIN_PARTS), "out-of-fold")
        x.unpersist()
    return Chain(counter, models, best_threshold(rows, c))


def best_threshold(rows: DataFrame, category: str) -> float:
    """The threshold in steps of 1/50 with the best F1 out of fold."""
    y = F.col(f"y_{category}")
    cut = rows.select(y.alias("_y"), F.explode(F.sequence(F.lit(5), F.lit(45))).alias("_t"), f"p_{category}").filter(
        F.col(f"p_{category}") >= F.col("_t") / 50)
    got = cut.groupBy("_t").agg((F.sum("_y") / F.count(F.lit(1))).alias("_precision"), F.sum("_y").alias("_hit"))
    total = rows.agg(F.sum(y)).first()[0] or 0.0
    f1 = 2 * F.col("_hit") * F.col("_precision") / (F.col("_hit") + F.col("_precision") * total)
    best = got.filter("_hit > 0").orderBy(F.desc(f1), F.desc("_t")).first()
    return best["_t"] / 50 if best else 1.0


def classify(docs: DataFrame, chain: Chain, target: str = "toxic", text_col: str = "text") -> DataFrame:
    """``_row`` (the whole input row as a struct), ``p_<category>`` and ``toxic``.

    One row per row, in place. A text without letters (null or empty too) is
    not toxic; without any learned label nothing is, and probabilities are 0.
    """
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                    tokens(F.col(f"`{text_col}`")).alias("_words"))
    if not chain.models:
        return x.select("_row", *[F.lit(0.0).alias(f"p_{c}") for c in CATEGORIES], F.lit(False).alias("toxic"))
    scored = chain.apply(x)
    toxic = (F.size("_words") > 0) & (F.col(f"p_{target}") >= chain.threshold)
    return scored.select("_row", *[f"p_{c}" for c in chain.models], toxic.alias("toxic"))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over whole ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("_row.doc_id").alias("doc_id"), *[c for c in out.columns if c[:2] == "p_"], "toxic")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects as toxic go, with all their columns kept as they are.

    Null texts and texts without letters stay; repeated rows stay or go together;
    an empty table, or one without labels, passes."""
    out = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.filter(~F.col("toxic")).select("_row.*")

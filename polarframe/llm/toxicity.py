"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each is a logistic regression over the presence of words and the probabilities of
the categories before it; in training those probabilities come from models that have not seen the row (out-of-fold),
so a later model learns from the same kind of scores it gets in use.

The chain is fitted on about ``SAMPLE_ROWS`` labelled rows, drawn by a hash of the id from all labels; that sample is the
only thing that is bounded. Scoring is one pass over all documents inside the JVM, without a shuffle. The threshold
of the last category is the one with the best F1 on out-of-fold predictions, but above the score of an empty text.

Null and empty texts have no words, get the score of the intercept and are not rejected. Labelled rows with a null label or
without a document are not used; a document labelled twice counts twice. If a category has rows of one class only (or none),
its probability is that class's rate (0 without rows), and a last category without both classes rejects nothing.
Repeated documents get equal scores. Other columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarframe.llm.shared import drawn_share, stored

SAMPLE_ROWS = 20_000
#: Words of the sample that a model can use: the most frequent, in at least ``LEAST_DOCS`` sampled documents.
FEATURES = 8192
LEAST_DOCS = 5
STEM = 4
FOLDS = 2
#: Everything in ASCII that is neither a letter nor a digit separates words.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def text_words(text: Column) -> Column:
    """Distinct lower-case words and their first ``STEM`` characters (marked by a star), so that forms share evidence."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != ""))
    return F.flatten(F.array(words, F.array_distinct(F.transform(words, lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))))


@dataclass
class Link:
    """One category: its model, or a constant probability where there was nothing to learn."""

    category: str
    earlier: list[str]
    model: LogisticRegressionModel | float

    def apply(self, df: DataFrame) -> DataFrame:
        name = f"p_{self.category}"
        if isinstance(self.model, float):
            return df.withColumn(name, F.lit(self.model))
        joined = VectorAssembler(inputCols=["_presence", *[f"p_{c}" for c in self.earlier]], outputCol="_features").transform(df.drop(name))
        scored = self.model.transform(joined)
        return scored.withColumn(name, vector_to_array("_probability")[1]).drop("_features", "_probability", "_raw", "_prediction")


@dataclass
class Chain:
    words: CountVectorizerModel
    links: list[Link]
    threshold: float

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with p_<category> of every category and ``toxic``, the verdict of the last one."""
        df = self.words.transform(docs.withColumn("_words", text_words(F.col(text))))
        for link in self.links:
            df = link.apply(df)
        return df.withColumn("toxic", F.col(f"p_{self.links[-1].category}") >= self.threshold).drop("_words", "_presence")


def _fit(rows: DataFrame, category: str, earlier: list[str]) -> Link:
    stats = rows.agg(F.count(category).alias("n"), F.sum(F.col(category).cast("double")).alias("ones")).first()
    if not stats["n"] or stats["ones"] in (0.0, float(stats["n"])):
        return Link(category, earlier, float((stats["ones"] or 0.0) / stats["n"]) if stats["n"] else 0.0)
    joined = VectorAssembler(inputCols=["_presence", *[f"p_{c}" for c in earlier]], outputCol="_features").transform(rows.where(F.col(category).isNotNull()))
    learner = LogisticRegression(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw",
        maxIter=20, regParam=0.001, elasticNetParam=0.9, standardization=False,
    )
    return Link(category, earlier, learner.fit(joined.withColumn("_label", F.col(category).cast("double"))))


def best_threshold(rows: DataFrame, category: str) -> float:
    """The threshold among hundredths with the highest F1; above 1 if no row of the category is positive."""
    grid = [i / 100 for i in range(1, 100)]
    hit = [F.sum(F.when((F.col(f"p_{category}") >= t) & (F.col(category) == 1), 1).otherwise(0)).alias(f"h{i}") for i, t in enumerate(grid)]
    said = [F.sum(F.when(F.col(f"p_{category}") >= t, 1).otherwise(0)).alias(f"s{i}") for i, t in enumerate(grid)]
    stats = rows.where(F.col(category).isNotNull()).agg(F.sum(F.col(category)).alias("ones"), *hit, *said).first()
    if not stats["ones"]:
        return 2.0
    f1 = [2 * stats[f"h{i}"] / (stats[f"s{i}"] + stats["ones"]) for i in range(len(grid))]
    best = [i for i, v in enumerate(f1) if v == max(f1)]
    return grid[best[len(best) // 2]]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> Chain:
    """Fit the categories in order; ``labels`` has the id and one 0/1 column per category."""
    share = min(1.0, sample_rows / max(labels.count(), 1))
    draw = drawn_share(share, F.lit("sample"), F.col(id_col))
    # Bounded by ``sample_rows``, so the broadcast is.
    chosen = labels.where(draw).select(id_col, *categories)
    joined = docs.select(id_col, F.col(text).alias("_text")).join(F.broadcast(chosen), id_col)
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(FOLDS))
    sample = stored(joined.select(*categories, fold.alias("_fold"), text_words(F.col("_text")).alias("_words")), "labelled")
    counter = CountVectorizer(inputCol="_words", outputCol="_presence", vocabSize=FEATURES, minDF=LEAST_DOCS, binary=True)
    words = counter.fit(sample) if sample.count() >= LEAST_DOCS else CountVectorizerModel.from_vocabulary([""], "_words", "_presence")
    rows = words.transform(sample).drop("_words").coalesce(8).cache()
    links: list[Link] = []
    for i, category in enumerate(categories):
        earlier = categories[:i]
        held_out = None
        for k in range(FOLDS):
            part = _fit(rows.where(F.col("_fold") != k), category, earlier).apply(rows.where(F.col("_fold") == k))
            held_out = part if held_out is None else held_out.unionByName(part)
        links.append(_fit(rows, category, earlier))
        scored = held_out.cache()
        scored.count()
        rows.unpersist()
        rows = scored
    threshold = best_threshold(rows, categories[-1])
    rows.unpersist()
    if isinstance(links[-1].model, float):
        return Chain(words, links, 2.0)
    # A text without any known word is no evidence, however few labels there were.
    blank = Chain(words, links, threshold).score(docs.sparkSession.range(1).select(F.lit("").alias("text"))).first()
    return Chain(words, links, max(threshold, blank[f"p_{categories[-1]}"] + 0.01))

"""Quality classifier by co-training of two views.

One classifier sees the text's content, the other the document's metadata (language,
source, length as recorded). In every round each is fitted on the labelled rows and on
the pseudo-labels that the *other* gave it, scores all unlabelled documents, and hands
its confident ones to the other. At last both are calibrated on labelled rows that no
fit has seen, and their evidence is added: the prior's log-odds plus what each
calibrated view moves them. A view without a say is calibrated to the prior and adds
nothing.

Labelled rows are those of the label table, one a document (the mean of its labels,
rounded half up); a fixed hash of the key keeps a fifth of them for calibration. At most
``most_labelled`` (a documented bound; by lowest hash) of them are fitted on. Pseudo-labels
come from all unlabelled documents, and all documents are scored.

Defined cases: null text counts as empty, null metadata is a value of its own; null
labels and keys don't label; without both classes among the labels the score is the
labels' mean (null if there are none); repeated rows get equal scores; an empty table
gives an empty table; other columns are ignored. Fits run on Spark's distributed
logistic regression; features and scores are DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.text import null_safe_key, whole, words
from pitpanel.session import settle

MOST_LABELLED = 200_000
ROUNDS = 2
CONFIDENT = 0.95
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16


def text_view(body: Column, tokens: Column) -> Column:
    """Content features of a text whose words are ``tokens``; no NaN."""
    n = F.greatest(F.size(tokens), F.lit(1)).cast("double")
    chars = F.greatest(F.length(body), F.lit(1)).cast("double")
    letters = F.greatest(F.regexp_count(body, F.lit(r"\p{L}")), F.lit(1)).cast("double")
    lines = F.filter(F.split(body, "\n"), lambda x: x != "")
    line_count = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return F.array(
        F.log1p(F.size(tokens).cast("double")),
        F.least(letters / n, F.lit(20.0)),
        F.regexp_count(body, F.lit(r"[#*$%&<>]")) / n,
        F.regexp_count(body, F.lit(r"\|")) / n,
        F.regexp_count(body, F.lit("!")) / n,
        F.regexp_count(body, F.lit(r"\p{Lu}")) / letters,
        F.regexp_count(body, F.lit("[0-9]")) / chars,
        F.regexp_count(body, F.lit(r"[.,;:?]")) / n,
        F.size(F.array_distinct(tokens)) / n,
        F.log1p(n) * F.size(F.array_distinct(tokens)) / n,
        (F.size(lines) - F.size(F.array_distinct(lines))) / line_count,
        F.log1p(n / line_count))


def metadata_view(lang: Column, source: Column, n_chars: Column) -> Column:
    """Length, hashed language and hashed source."""
    def one_hot(value: Column, buckets: int) -> Column:
        at = F.pmod(null_safe_key(value), F.lit(buckets))
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)),
                           lambda i: (i == at).cast("double"))

    length = F.log1p(F.greatest(F.coalesce(n_chars.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.concat(F.array(length, n_chars.isNull().cast("double")),
                    one_hot(lang, LANG_BUCKETS), one_hot(source, SOURCE_BUCKETS))


@dataclass(frozen=True)
class Linear:
    """Log-odds that are linear in a feature array."""

    weights: tuple[float, ...]
    bias: float

    def logit(self, features: Column) -> Column:
        weights = F.array(*[F.lit(w) for w in self.weights])
        return F.aggregate(F.zip_with(features, weights, lambda f, w: f * w),
                           F.lit(self.bias), lambda a, x: a + x)


def _fit(rows: DataFrame, view: str, label: str) -> Linear | None:
    """A fit on (view, label); None without both classes."""
    training = rows.select(array_to_vector(F.col(view)).alias("features"),
                           F.col(label).cast("double").alias("label"))
    counts = [r["count"] for r in training.groupBy("label").count().collect()]
    if len(counts) < 2:
        return None
    # The fewer the rows, the less their weights may say.
    model = LogisticRegression(maxIter=25, regParam=1e-3 + 5 / sum(counts)).fit(training)
    return Linear(tuple(float(w) for w in model.coefficients), float(model.intercept))


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


VIEWS = ("in_text", "in_metadata")


@dataclass(frozen=True)
class Model:
    views: dict[str, Linear]
    #: (scale, shift) of each view's calibrated log-odds.
    calibration: dict[str, tuple[float, float]]
    prior: float

    def calibrated(self, view: str) -> Column:
        scale, shift = self.calibration[view]
        return self.views[view].logit(F.col(view)) * scale + shift

    def score(self) -> Column:
        return _probability(F.lit(self.prior) + sum(
            (self.calibrated(v) - self.prior for v in self.views), F.lit(0.0)))


def prepare(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
            lang: str = "lang", source: str = "source", n_chars: str = "n_chars",
            label: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(key, in_text, in_metadata, label, role): both views of every document.

    role: ``fit`` and ``check`` for labelled rows, null for the others.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")) \
        .filter("key IS NOT NULL AND y IS NOT NULL").groupBy("key") \
        .agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    known = settle(known.withColumn("draw", F.pmod(F.xxhash64(F.lit(10), "key"), F.lit(1 << 40))))
    fitted = F.col("draw") % 5 != 0
    count = known.filter(fitted).count()
    limit = (1 << 40) * min(1.0, most_labelled / max(count, 1))
    role = F.when(~fitted, "check").when(F.col("draw") < limit, "fit")
    rows = docs.select(
        F.col(key).alias("key"), whole(F.col(text)).alias("body"), words(F.col(text))
        .alias("tokens"), metadata_view(F.col(lang), F.col(source), F.col(n_chars))
        .alias("in_metadata"))
    views = rows.select("key", text_view(F.col("body"), F.col("tokens")).alias("in_text"),
                        "in_metadata")
    return settle(views.join(known.withColumn("role", role), "key", "left").drop("draw"))


def train(rows: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model | None:
    """The co-trained, calibrated model; None without both classes among the labels."""
    labelled = rows.filter("role = 'fit'").cache()
    models: dict[str, Linear] = {}
    for view in VIEWS:
        first = _fit(labelled, view, "label")
        if first is None:
            labelled.unpersist()
            return None
        models[view] = first
    pool = rows.filter("label IS NULL")
    for _ in range(rounds):
        given = {}
        for view, other in zip(VIEWS, reversed(VIEWS)):
            p = _probability(models[other].logit(F.col(other)))
            sure = F.when(p >= confident, 1).when(p <= 1 - confident, 0)
            given[view] = pool.select(view, sure.alias("label")).filter("label IS NOT NULL")
        for view in VIEWS:
            both = labelled.select(view, "label").unionByName(given[view])
            models[view] = _fit(both, view, "label") or models[view]
    labelled.unpersist()
    checks = rows.filter("role = 'check'")
    share = checks.agg(F.avg("label")).first()[0]
    share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
    prior = math.log(share / (1 - share))
    calibration = {}
    for view in VIEWS:
        line = _fit(checks.select(F.array(models[view].logit(F.col(view))).alias("z"), "label"),
                    "z", "label")
        # An upside-down view is worth nothing.
        calibration[view] = (line.weights[0], line.bias) if line and line.weights[0] > 0 \
            else (0.0, prior)
    return Model(models, calibration, prior)


def score(docs: DataFrame, labels: DataFrame, keep_above: float = 0.5, **options) -> DataFrame:
    """(key, score, text_score, metadata_score, kept) of every document."""
    rows = prepare(docs, labels, **options)
    model = train(rows)
    if model is None:
        mean = rows.agg(F.avg("label")).first()[0]
        flat = F.lit(mean).cast("double")
        return rows.select("key", flat.alias("score"), flat.alias("text_score"),
                           flat.alias("metadata_score"),
                           F.coalesce(flat >= keep_above, F.lit(True)).alias("kept"))
    value = model.score()
    return rows.select(
        "key", value.alias("score"), _probability(model.calibrated("in_text")).alias("text_score"),
        _probability(model.calibrated("in_metadata")).alias("metadata_score"),
        (value >= keep_above).alias("kept"))

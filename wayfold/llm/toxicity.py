"""Operator 3: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learnt: words whose share of toxic documents is well above their share of others. Features of a text are
densities of such words by strength, how near second persons they stand, capitals, punctuation, and obfuscation (digits
and signs for letters, letters drawn apart). Trees are boosted on one fold of the labelled rows, and their scores
calibrated on another. Features that teach come from the lexicon of the other fold, so no row's features know its label;
documents are scored with the lexicon of both.

Learning takes at most FIT_ROWS labelled rows, chosen by a hash of doc_id, and this bounds lexicon and calibration too;
scoring takes all documents. Null texts count as empty and get a score. Rows whose label is null teach nothing. Without
labels of both kinds nothing can be told apart: every score is UNKNOWN, and no document is rejected. An empty table gives no
rows. Repeated rows each give a row. Other columns do not matter; kept() passes them on as they are.
"""

from __future__ import annotations

import collections
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import chunks, written

#: The bound on labelled rows that the classifier is fitted on, and the score where nothing could be learnt.
FIT_ROWS, UNKNOWN = 40_000, 0.5
#: Toxic documents that a word of the lexicon is in at least; log odds from which a word counts, counts as strong.
LEAST_TOXIC, WEAK, STRONG = 3, 1.0, 2.0
#: Words between a strong word and a second person that still counts as near.
NEAR = 8
TREES, DEPTH = 20, 4
THRESHOLD = 0.7

#: Second persons of English, German, French and Spanish.
SECOND_PERSONS = frozenset("you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros vuestro su".split())
#: Letters that signs and digits stand for.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
EDGES = ".,;:!?\"'()[]{}#$%&*-_~<>|"
ODD = re.compile(r"[^\W\d_]+[\d@$!|*.\-_]+[^\W\d_]+")

FEATURES = ("strong_density", "strong_count", "weak_density", "strength_sum", "strength_max", "near_density", "nearest", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_strong", "log_words")


class Lexicon:
    """Words and their log odds."""

    def __init__(self, words: dict[str, tuple[int, int]], toxic: int, other: int):
        self.toxic, self.other = toxic, other
        self.odds = {w: math.log((k + 0.2) / (toxic + 1)) - math.log((c + 0.5) / (other + 1)) for w, (k, c) in words.items()}


def plain_words(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = plain_words(text)
    n, odds = max(1, len(words)), lexicon.odds
    hits = [(i, w) for i, w in enumerate(words) if w in odds]
    strange = [(i, w) for i, w in enumerate(words) if w and not w.isalpha() and ODD.search(w)] if ODD.search(text) else []
    hidden = [(i, v) for i, w in strange for v in {w.translate(STANDS_FOR), re.sub(r"[^\w]|_", "", w)} if v in odds]
    worth = [(i, odds[w]) for i, w in hits + hidden]
    strong = [i for i, s in worth if s >= STRONG]
    weak = sum(WEAK <= s < STRONG for _, s in worth)
    total, most = sum(s for _, s in worth if s >= WEAK), max((s for _, s in worth), default=0.0)
    near, nearest = 0, NEAR + 1
    if strong:
        persons = np.array([i for i, w in enumerate(words) if w in SECOND_PERSONS])
        if len(persons):
            at, own = np.searchsorted(persons, strong), np.array(strong)
            gaps = np.minimum(np.abs(own - persons[np.maximum(at - 1, 0)]), np.abs(persons[np.minimum(at, len(persons) - 1)] - own))
            near, nearest = int((gaps <= NEAR).sum()), float(min(gaps.min(), NEAR + 1))
    letters = max(1, len(text))
    capitals = letters - 1 - sum(map(len, re.findall(r"[^A-ZÀ-ÖØ-Þ]+", text))) + 1 if text else 0
    capital_words = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b", text))
    return [
        1000 * len(strong) / n, float(len(strong)), 1000 * weak / n, total, most, 1000 * near / n, float(nearest), capitals / letters, capital_words / n,
        text.count("!") / n, text.count("?") / n, len(re.findall(r"[^\w\s]", text)) / letters, 1000 * len(strange) / n, 1000 * sum(odds[v] >= STRONG for _, v in hidden) / n, math.log(n),
    ]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, label and fold (crc32 of doc_id as text, modulo 3) of at most about `rows` rows to learn from; never fold 1."""
    fold = (F.crc32(F.col("doc_id").cast("string")) % 3).cast("int")
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).withColumn("fold", fold).filter("fold <> 1")
    n = own.count()
    if n > rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return own


def learnt_words(texts: DataFrame) -> Lexicon:
    """texts: text and label. Counts of documents by word, of words in enough toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in chunks(batch):
                counts: dict[str, list[int]] = collections.defaultdict(lambda: [0, 0])
                for t, label in zip(own, part.column("label").to_pylist(), strict=True):
                    for w in set(plain_words(t)):
                        counts[w][1 - label] += 1
                counts.pop("", None)
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([k for k, _ in counts.values()], pa.int64()), pa.array([c for _, c in counts.values()], pa.int64())], ["word", "k", "c"])

    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    each = texts.select("text", "label").mapInArrow(run, "word string, k long, c long").groupBy("word").agg(F.sum("k").alias("k"), F.sum("c").alias("c"))
    odds = F.log((F.col("k") + 0.2) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (other + 1))
    best = each.filter(F.col("k") >= LEAST_TOXIC).withColumn("s", odds).filter(F.col("s") >= WEAK)  # words of FIT_ROWS rows at most
    return Lexicon({r.word: (r.k, r.c) for r in best.collect()}, toxic, other)


def with_features(docs: DataFrame, lexicon: Lexicon | dict[int, Lexicon]) -> DataFrame:
    """doc_id, label and fold where docs have them, and the features of each text, by one lexicon or one for each fold."""
    kept = [c for c in ("doc_id", "label", "fold") if c in docs.columns]
    schema = ", ".join([f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} double" for c in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                own = [lexicon[f] for f in part.column("fold").to_pylist()] if isinstance(lexicon, dict) else [lexicon] * len(texts)
                x = np.array([features(t, known) for t, known in zip(texts, own, strict=True)], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(x[:, i]) for i in range(len(FEATURES))]], [*kept, *FEATURES])

    return docs.select(*kept, "text").mapInArrow(run, schema)


class Model:
    """Lexicon, trees and calibration; score() gives columns of with_features() a score."""

    def __init__(self, lexicon: Lexicon, trees=None, calibration=None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="x")

    def margin(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(self.assembler.transform(rows)).withColumn("margin", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame) -> DataFrame:
        if self.trees is None:
            return rows.withColumn("score", F.lit(UNKNOWN))
        scored = self.margin(rows)
        if self.calibration is None:
            return scored.withColumn("score", F.col("margin"))
        # Spark's own prediction: a Python function here would be a second Python worker in each task
        return self.calibration.transform(scored).withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    teach = F.broadcast(written(labelled(docs, labels, rows), "teach"))  # at most about FIT_ROWS small rows
    texts = docs.select("doc_id", "text").join(teach, "doc_id")
    model = Model(learnt_words(texts))
    folds = {f: learnt_words(texts.filter(F.col("fold") == 2 - f)) for f in (0, 2)}
    if any(not x.toxic or not x.other for x in folds.values()):
        return model
    table = written(with_features(texts, folds), "features")
    boosted = table.filter("fold = 0").withColumn("label", F.col("label").cast("double"))
    model.trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=3, seed=7).fit(model.assembler.transform(boosted))
    # equal margins are one weighted point, so none of them meet in one task
    held = model.margin(table.filter("fold = 2")).groupBy("margin").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    model.calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(held)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = fit(docs, labels)
    rows = model.score(with_features(docs.select("doc_id", "text"), model.lexicon))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic; columns as in docs. Texts are scored where they are, without a join."""
    model = fit(docs, labels)
    names = docs.columns
    schema = docs.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                x = np.array([features(t, model_lexicon) for t in texts], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x[:, i]) for i in range(len(FEATURES))]], [*part.schema.names, *FEATURES])

    model_lexicon = model.lexicon
    plain = docs.toDF(*[f"_{i}" if c != "text" else "text" for i, c in enumerate(names)])
    schema = ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", " + ", ".join(f"{c} double" for c in FEATURES)
    rows = model.score(plain.mapInArrow(run, schema))
    return rows.filter(F.col("score") < THRESHOLD).select(*[F.col(f"_{i}" if c != "text" else "text").alias(c) for i, c in enumerate(names)])

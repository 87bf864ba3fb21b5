"""Learning and recognising symbol labels with MLlib and plain joins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from formulaspark.sources.scratch import kept

#: Labels that are easily taken for each other.
CONFUSABLE = [("0", "O"), ("0", "o"), ("1", "l"), ("1", "I"), ("1", "|"), ("2", "Z"), ("2", "z"), ("5", "S"), ("5", "s"), ("6", "b"), ("6", "G"), ("8", "B"), ("x", "times"), ("minus", "line")]


def label_index(labels: DataFrame) -> DataFrame:
    """``label, idx``: distinct labels in order, from 0."""
    distinct = labels.select("label").where("label is not null").distinct()
    # one row per class
    return distinct.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("idx"))


def scaler(vectors: DataFrame) -> DataFrame:
    """``dim, mean, std`` (population) of ``features`` arrays."""
    e = vectors.select(F.posexplode("features").alias("dim", "v"))
    return e.groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))


def standardize(vectors: DataFrame, scale: DataFrame) -> DataFrame:
    """``features`` as (x - mean) / std; a deviation of 0 counts as 1."""
    table = scale.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("scale"))  # one row, one entry a dimension
    std = lambda s: F.when(s["std"] == 0, 1.0).otherwise(s["std"])
    return vectors.crossJoin(F.broadcast(table)).withColumn("features", F.zip_with("features", "scale", lambda v, s: (v - s["mean"]) / std(s))).drop("scale")


def stratified_split(rows: DataFrame, share: float = 0.2, key: str = "id") -> DataFrame:
    """``rows`` with ``is_test``: of each label the first ``round(share * n)`` by a hash of the id."""
    number = F.col(key) if isinstance(rows.schema[key].dataType, IntegralType) else F.xxhash64(key)
    h = F.pmod(F.pmod(number, F.lit(1 << 31)) * 2654435761, F.lit(4294967296))
    # of each label the bucket of hashes in which the share ends; only rows there need an order among themselves
    rows = rows.withColumns({"_hash": h, "_bucket": F.shiftright(h, 20)})
    up = Window.partitionBy("label").orderBy("_bucket")
    counts = rows.groupBy("label", "_bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"upto": F.sum("n").over(up), "want": F.floor(F.sum("n").over(Window.partitionBy("label")) * share + 0.5)})
    ends = counts.where("upto - n < want and want <= upto").select(F.col("label").alias("_label"), F.col("_bucket").alias("_end"), (F.col("want") - F.col("upto") + F.col("n")).alias("_left"))
    place = F.row_number().over(Window.partitionBy("label", "_bucket").orderBy("_hash", key))
    first = (F.col("_bucket") < F.col("_end")) | ((F.col("_bucket") == F.col("_end")) & (F.col("_place") <= F.col("_left")))
    placed = rows.withColumn("_place", place).join(ends, F.col("label").eqNullSafe(F.col("_label")), "left")
    return placed.withColumn("is_test", F.coalesce(first, F.lit(False))).drop("_hash", "_bucket", "_place", "_label", "_end", "_left")


def classification_report(pairs: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` from ``y, pred``."""
    seen = pairs.groupBy("y", "pred").agg(F.count("*").alias("n"))
    actual = seen.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    guessed = seen.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("guessed"))
    r = actual.join(guessed, "label", "full").fillna(0, ["support", "hit", "guessed"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, c = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    f1 = F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0))
    return r.select("label", F.round(p, 6).alias("precision"), F.round(c, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support``: plain (``macro avg``) and by support (``weighted avg``) over a report's classes."""
    names, n = ("precision", "recall", "f1"), F.sum("support")
    both = report.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.try_divide(F.sum(F.col(c) * F.col("support")), n).alias(f"w_{c}") for c in names], n.alias("support"))
    rows = F.array(*[F.struct(F.lit(f"{name} avg").alias("label"), *[F.round(F.coalesce(f"{name[0]}_{c}", F.lit(0.0)), 6).alias(c) for c in names], F.coalesce("support", F.lit(0)).alias("support")) for name in ("macro", "weighted")])
    return both.select(F.inline(rows))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg((F.col("y") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def top_candidates(probabilities: DataFrame, k: int = 3, key: str = "vec_id") -> DataFrame:
    """``key, rank, label, prob``: the most likely labels, of equal ones the higher index first."""
    order = Window.partitionBy(key).orderBy(F.col("prob").desc(), F.col("idx").desc())
    return probabilities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "label", "prob")


def nearest_labels(queries: DataFrame, train: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """``id, pred, prob`` of ``nearest_candidates``."""
    return nearest_candidates(queries, train, k, block).select("id", "pred", "prob")


def nearest_candidates(queries: DataFrame, train: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """k-NN by Euclidean distance: ``id, pred, prob, candidates``; majority of the ``k`` nearest, ties to the smaller label.

    Training rows are dealt once to parts of about ``block`` rows; a task holds one part as a matrix
    and streams the queries, of which each part gets a copy, past it.
    """
    n = max(1, -(-train.count() // block))
    values = F.col("features").cast("array<double>").alias("features")
    t = train.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "label", values)
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.lit(True).alias("asks"), "id", F.lit(None).cast(train.schema["label"].dataType).alias("label"), values)

    def near(frames):
        part, held, matrix = None, [], None
        for frame in frames:
            for (p, asks), own in frame.groupby(["part", "asks"], sort=True):
                if p != part:
                    part, held, matrix = p, [], None
                if not asks:
                    held.append(own)
                    continue
                if matrix is None and held:
                    rows = pd.concat(held)
                    held, matrix = [], np.stack(rows.features.to_list()).astype(float)
                    order = np.unique(rows.id.to_numpy(), return_inverse=True)[1]
                if matrix is None:
                    continue
                for at in range(0, len(own), 512):
                    asked = own.iloc[at : at + 512]
                    a = np.stack(asked.features.to_list()).astype(float)
                    d = np.round((a * a).sum(1)[:, None] - 2 * a @ matrix.T + (matrix * matrix).sum(1)[None], 9)
                    # only what is as near as the k-th is sorted; ties are all kept until then
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
                    ask, near_to = np.nonzero(d <= edge)
                    by = np.lexsort((order[near_to], d[ask, near_to], ask))
                    ask, near_to = ask[by], near_to[by]
                    first = np.arange(len(ask)) - np.searchsorted(ask, ask) < k
                    ask, near_to = ask[first], near_to[first]
                    yield pd.DataFrame({"query": asked.id.to_numpy()[ask], "id": rows.id.to_numpy()[near_to], "label": rows.label.to_numpy()[near_to], "d": d[ask, near_to]})

    type_of = lambda table, name: table.schema[name].dataType.simpleString()
    both = t.union(q).repartitionById(n, "part").sortWithinPartitions("part", "asks")
    found = both.mapInPandas(near, f"query {type_of(queries, 'id')}, id {type_of(train, 'id')}, label {type_of(train, 'label')}, d double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).where(F.col("r") <= k)
    votes = best.groupBy("query", "label").agg(F.count("*").alias("n"))
    ranked = votes.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "label"))).alias("ranked"))  # k labels at most
    likely = F.transform(F.slice("ranked", 1, 3), lambda c: F.struct(c["label"].alias("label"), (-c["less"] / k).alias("prob")))
    ranked = ranked.select(F.col("query").alias("id"), likely.alias("candidates"))
    return ranked.select("id", F.get("candidates", 0)["label"].alias("pred"), F.get("candidates", 0)["prob"].alias("prob"), "candidates")


def match_templates(symbols: DataFrame, templates: DataFrame) -> DataFrame:
    """``id, label, score``: the template (``label, t_features``) with the greatest normalised
    correlation, the first label on ties.  Dimension by dimension, so both sides are joins."""
    unit = lambda d, key, col: d.select(key, F.posexplode(col).alias("dim", "v"))
    per = lambda key: Window.partitionBy(key)

    def centred(d: DataFrame, key: str, col: str, out: str) -> DataFrame:
        e = unit(d, key, col).withColumn("c", F.col("v") - F.avg("v").over(per(key)))
        norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(per(key)))
        return e.select(key, "dim", F.coalesce(F.try_divide("c", norm), F.lit(0.0)).alias(out))

    s, t = centred(symbols, "id", "features", "a"), centred(templates, "label", "t_features", "b")
    scores = s.join(F.broadcast(t) if templates.count() <= 1000 else t, "dim").groupBy("id", "label").agg(F.round(F.sum(F.col("a") * F.col("b")), 9).alias("score"))
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "label")
    return scores.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "label", "score")


def resolve_ambiguity(symbols: DataFrame, order: DataFrame, runner_up: DataFrame) -> DataFrame:
    """``formula_id, sym_idx, label``: labels of uncertain symbols (confidence 0.9 or less) whose
    second candidate (``second``) is easily confused, chosen by the neighbours in reading order."""
    pairs = symbols.sparkSession.createDataFrame(CONFUSABLE, "p string, q string")
    pairs = F.broadcast(pairs.union(pairs.select("q", "p")).withColumn("mixed", F.lit(True)))
    s = symbols.join(order.select("formula_id", "sym_idx", "rank"), ["formula_id", "sym_idx"]).join(runner_up, ["formula_id", "sym_idx"], "left")
    line = Window.partitionBy("formula_id").orderBy("rank")
    s = s.withColumns({"before": F.lag("label").over(line), "after": F.lead("label").over(line)})
    s = s.join(pairs, (F.col("label") == F.col("p")) & (F.col("second") == F.col("q")), "left")
    either = lambda pattern: F.coalesce(F.col("before").rlike(pattern), F.lit(False)) | F.coalesce(F.col("after").rlike(pattern), F.lit(False))
    both = lambda pattern: F.coalesce(F.col("before").rlike(pattern) & F.col("after").rlike(pattern), F.lit(False))
    digit, letter = "^[0-9]$", "^[a-zA-Z]$"
    is_in = lambda *labels: F.col("label").isin(*labels) & F.col("second").isin(*labels)
    chosen = (
        F.when(is_in("0", "O", "o"), F.when(either(digit), "0").when(either(letter), "O").otherwise(F.col("label")))
        .when(is_in("1", "l", "I"), F.when(either(digit), "1").otherwise("l"))
        .when(is_in("x", "times"), F.when(both(digit), "times").otherwise("x"))
        .otherwise(F.col("label"))
    )
    doubtful = F.coalesce(F.col("mixed"), F.lit(False)) & (F.col("confidence") <= 0.9)
    return s.select("formula_id", "sym_idx", F.when(doubtful, chosen).otherwise(F.col("label")).alias("label"))


def recognize_symbols(symbols: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """``formula_id, sym_idx, label, confidence``: lines and roots by their flags, others by
    ``predictions`` (``formula_id, sym_idx, pred, prob``), ``unknown`` where there is none;
    without a model ``symbol_<i>``."""
    s = symbols.drop("label", "confidence")
    if predictions is None:
        s = s.withColumns({"pred": F.concat(F.lit("symbol_"), F.col("sym_idx").cast("string")), "prob": F.lit(0.0)})
    else:
        s = s.join(predictions, ["formula_id", "sym_idx"], "left")
    label = F.when(F.col("is_fraction_line"), "fraction_line").when(F.col("is_sqrt"), "sqrt").otherwise(F.coalesce("pred", F.lit("unknown")))
    sure = F.when(F.col("is_fraction_line") | F.col("is_sqrt"), 1.0).otherwise(F.coalesce("prob", F.lit(0.0)))
    return s.select("formula_id", "sym_idx", label.alias("label"), sure.alias("confidence"))


def fourier_features(vectors: DataFrame, gamma: float, n: int = 256, seed: int = 42) -> DataFrame:
    """Random features whose inner products approximate the kernel exp(-gamma d^2)."""
    schema = vectors.schema
    place = schema.fieldNames().index("features")

    def map_rows(batches):
        for frame in batches:
            if len(frame):
                x = np.stack(frame.features.to_list()).astype(float)
                rng = np.random.default_rng(seed)
                w, b = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
                frame["features"] = list(np.sqrt(2 / n) * np.cos(x @ w + b))
            yield frame

    kind = ", ".join(f"{f.name} {'array<double>' if i == place else f.dataType.simpleString()}" for i, f in enumerate(schema))
    return vectors.mapInPandas(map_rows, kind)


CLASSIFIERS = ("random_forest", "svm", "knn")


def fit_classifier(train: DataFrame, kind: str = "svm", trees: int = 100, depth: int = 12, penalty: float = 1e-3) -> PipelineModel:
    """A pipeline from ``label`` (string) and ``features`` (vector) to ``probability``.

    ``svm`` expects Fourier features and fits multinomial logistic regression on them,
    which stands for an RBF machine with probabilities; ``knn`` has no model to fit.
    """
    if kind not in CLASSIFIERS[:2]:
        raise ValueError(f"no model of kind {kind!r}")
    index = StringIndexer(inputCol="label", outputCol="idx", stringOrderType="alphabetAsc", handleInvalid="skip")
    if kind == "random_forest":
        fit = RandomForestClassifier(labelCol="idx", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=42)
    else:
        fit = LogisticRegression(labelCol="idx", featuresCol="vector", maxIter=50, regParam=penalty)
    return Pipeline(stages=[index, fit]).fit(train.withColumn("vector", array_to_vector(F.col("features").cast("array<double>"))))


def predict(model: PipelineModel, rows: DataFrame, k: int = 3) -> DataFrame:
    """``rows`` with ``pred`` and ``prob`` of the likeliest label, and the ``k`` likeliest as ``candidates``."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = model.stages[1].transform(rows.withColumn("vector", array_to_vector(F.col("features").cast("array<double>"))))
    each = F.transform(vector_to_array("probability"), lambda p, i: F.struct(p.alias("prob"), (-i).alias("at"), F.get(names, i).alias("label")))
    likely = F.transform(F.slice(F.reverse(F.array_sort(each)), 1, k), lambda c: F.struct(c["label"].alias("label"), c["prob"].alias("prob")))
    out = out.withColumn("candidates", likely).drop("vector", "rawPrediction", "probability", "prediction")
    return out.withColumns({"pred": F.get("candidates", 0)["label"], "prob": F.get("candidates", 0)["prob"]})


def mean_variance(vectors: DataFrame) -> float:
    """The variance of all entries of ``features`` arrays together."""
    return vectors.select(F.explode("features").alias("v")).agg(F.var_pop(F.col("v").cast("double")).alias("v")).first()["v"] or 1.0


@dataclass(frozen=True)
class Recognizer:
    """A scaler, and a fitted pipeline or, for ``knn``, the rows that were learned."""

    kind: str
    scale: DataFrame
    gamma: float = 0.0
    model: PipelineModel | None = None
    learned: DataFrame | None = None

    def predict(self, vectors: DataFrame) -> DataFrame:
        """``id, pred, prob, candidates`` of ``vectors`` (``id, features``); candidates are up to three labels with their shares."""
        rows = standardize(vectors.select("id", "features"), self.scale)
        if self.kind == "knn":
            return nearest_candidates(rows, self.learned)
        if self.kind == "svm":
            rows = fourier_features(rows, self.gamma)
        return predict(self.model, rows.withColumn("label", F.lit(""))).select("id", "pred", "prob", "candidates")

    def save(self, path: str) -> None:
        spark = self.scale.sparkSession
        spark.createDataFrame([(self.kind, self.gamma)], "kind string, gamma double").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        self.scale.write.mode("overwrite").parquet(f"{path}/scale")
        if self.model:
            self.model.write().overwrite().save(f"{path}/model")
        if self.learned:
            self.learned.write.mode("overwrite").parquet(f"{path}/learned")


def create_recognizer(spark: SparkSession, path: str) -> Recognizer:
    """A recognizer that ``save`` wrote."""
    kind, gamma = spark.read.parquet(f"{path}/about").first()
    model = None if kind == "knn" else PipelineModel.load(f"{path}/model")
    return Recognizer(kind, spark.read.parquet(f"{path}/scale"), gamma, model, spark.read.parquet(f"{path}/learned") if kind == "knn" else None)


def train(vectors: DataFrame, kind: str = "svm", share: float = 0.2, c: float = 10.0) -> tuple[Recognizer, DataFrame]:
    """A recognizer from ``id, label, features``, and the pairs ``y, pred`` of its held-out rows.

    The scaler is fitted on all rows before the split.  ``svm`` takes the kernel width ``scale``
    (one over features times their variance) and the penalty ``1 / (c n)``.
    """
    if kind not in CLASSIFIERS:
        raise ValueError(f"no classifier of kind {kind!r}")
    scale = kept(scaler(vectors), "scale")
    rows = kept(stratified_split(standardize(vectors.select("id", "label", "features"), scale), share), "scaled")
    seen, held = rows.where("not is_test"), rows.where("is_test")
    if kind == "knn":
        made = Recognizer(kind, scale, learned=seen.select("id", "label", "features"))
        found = nearest_labels(held.select("id", "features"), made.learned)
    else:
        gamma, n = 0.0, max(seen.count(), 1)
        if kind == "svm":
            gamma = 1.0 / (scale.count() * mean_variance(seen))
            seen, held = fourier_features(seen, gamma), fourier_features(held, gamma)
        made = Recognizer(kind, scale, gamma, fit_classifier(seen, kind, penalty=1.0 / (c * n)))
        found = predict(made.model, held)
    return made, held.select("id", F.col("label").alias("y")).join(found.select("id", "pred"), "id").select("y", "pred")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

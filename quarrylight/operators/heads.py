"""Class-balanced logistic heads on vectors, with MLlib: one of several classes, several labels at once, and how much data they need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that a head may have; each has its coefficients on the driver.
MOST_CLASSES = 1_000
#: Strength of the data against the penalty, and the steps of the solver.
STRENGTH, STEPS = 2.0, 3_000
FRACTIONS = (0.25, 0.5, 0.75, 1.0)


@dataclass
class Head:
    """A fitted head and its classes in the order of its probabilities."""

    model: LogisticRegressionModel
    classes: list

    def scored(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with predicted (class), confidence, and probability (an array in the order of ``classes``); rows without a fit vector are left out."""
        sound = _sound(df, features).where(F.size("__features") == self.model.numFeatures)
        rows = self.model.setFeaturesCol("__vector").setPredictionCol("__place").setProbabilityCol("__p").setRawPredictionCol("__raw").transform(sound.withColumn("__vector", array_to_vector("__features")))
        p = vector_to_array("__p")
        named = F.element_at(F.array(*map(F.lit, self.classes)), F.col("__place").cast("int") + 1)
        return rows.select(*df.columns, named.alias("predicted"), F.array_max(p).alias("confidence"), p.alias("probability"))


def _sound(df: DataFrame, features: str) -> DataFrame:
    """Rows whose vector is whole and finite, as doubles."""
    v = F.col(features).cast("array<double>")
    return df.withColumn("__features", v).where(F.col(features).isNotNull() & (F.size(features) > 0) & F.forall("__features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)))


def balanced(df: DataFrame, label: str) -> tuple[DataFrame, list, int]:
    """``df`` with __place (of the class) and __weight: rows / (classes x rows of the class), so that all classes weigh the same."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if len(counts) < 2:
        raise ValueError("a head needs two classes")
    classes, total = sorted(r[label] for r in counts), sum(r["n"] for r in counts)
    of = {r[label]: r["n"] for r in counts}
    table = F.create_map(*(x for k, c in enumerate(classes) for x in (F.lit(c), F.struct(F.lit(float(k)).alias("place"), F.lit(total / (len(classes) * of[c])).alias("weight")))))
    own = F.try_element_at(table, F.col(label))
    return df.where(F.col(label).isNotNull()).withColumn("__place", own["place"]).withColumn("__weight", own["weight"]), classes, total


def fit_head(train: DataFrame, features: str, label: str, strength: float = STRENGTH, steps: int = STEPS) -> Head:
    """A logistic head in which every class weighs the same.

    ``strength`` stands for the data's side: the loss is ``strength`` times the weighted sum of the rows' losses plus half
    the squared length of the coefficients; intercepts are free. MLlib divides by the weights' sum, which the penalty
    takes into account. Rows without a label or a whole vector don't count; one class alone is an error.
    """
    rows, classes, _ = balanced(_sound(train, features), label)
    total = rows.agg(F.sum("__weight").alias("w")).first()["w"]
    solver = LogisticRegression(featuresCol="__vector", labelCol="__place", weightCol="__weight", maxIter=steps, regParam=1 / (strength * total), elasticNetParam=0.0, standardization=False, tol=1e-7)
    return Head(solver.fit(rows.select(array_to_vector("__features").alias("__vector"), "__place", "__weight")), classes)


def fit_heads(train: DataFrame, features: str, labels: str, names: list[str], strength: float = STRENGTH) -> dict[str, Head]:
    """A yes-or-no head for each of several labels that a row may have at once (``labels``: an array).

    Labels that all rows or none have, have no head.
    """
    found = {}
    for name in names:
        rows = train.withColumn("__has", F.coalesce(F.array_contains(labels, name), F.lit(False)).cast("int"))
        if rows.agg(F.countDistinct("__has").alias("n")).first()["n"] == 2:
            found[name] = fit_head(rows, features, "__has", strength)
    return found


def scored_labels(df: DataFrame, features: str, heads: dict[str, Head], cut: float = 0.5) -> DataFrame:
    """``df`` with predicted_labels: those whose head says so with ``cut`` or more, in the order of the heads."""
    out, columns = df, df.columns
    for k, head in enumerate(heads.values()):
        out = head.scored(out, features).withColumn(f"__yes{k}", F.element_at("probability", head.classes.index(1) + 1)).drop("predicted", "confidence", "probability")
    yes = F.array_compact(F.array(*(F.when(F.col(f"__yes{k}") >= cut, name) for k, name in enumerate(heads)))).cast("array<string>")
    return out.select(*columns, yes.alias("predicted_labels"))


def probability_of(head: Head, value) -> Column:
    """The probability of one class in what ``scored`` gives, whatever order the solver has them in."""
    return F.element_at("probability", head.classes.index(value) + 1)


def protected_rows(df: DataFrame, text: str, potential: str) -> DataFrame:
    """(text, potential) of rows with a text: potential in capitals, UNCERTAIN where it is not stated."""
    return df.where(F.trim(text) != "").select(F.trim(text).alias("text"), F.upper(F.coalesce(F.nullif(F.trim(F.col(potential).cast("string")), F.lit("")), F.lit("UNCERTAIN"))).alias("potential"))


def learning_curve(train: DataFrame, dev: DataFrame, features: str, label: str, negative, key: str, fractions: tuple[float, ...] = FRACTIONS, strength: float = STRENGTH) -> DataFrame:
    """Whether more negatives would still help: a head for each share of them, judged on the same rows.

    The shares are nested: a row is in from the share on that the hash of its key falls below. Returns fraction,
    negatives, recall of the negatives and of the others, accuracy; a flat tail says that enough are there.
    """
    spark, rows = train.sparkSession, []
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for fraction in fractions:
        own = train.where((F.col(label) != negative) | (place < fraction))
        n = own.where(F.col(label) == negative).count()
        said = fit_head(own, features, label, strength).scored(dev.where(F.col(label).isNotNull()), features)
        right, out = (F.col("predicted") == F.col(label)).cast("double"), F.col(label) == negative
        found = said.agg(F.avg(F.when(out, right)).alias("a"), F.avg(F.when(~out, right)).alias("b"), F.avg(right).alias("c")).first()
        rows.append((fraction, n, found["a"], found["b"], found["c"]))
    return spark.createDataFrame(rows, "fraction double, negatives long, negative_recall double, other_recall double, accuracy double")

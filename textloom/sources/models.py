"""Models as Parquet folders: save, load, and find by name below a root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators.ner import Recognizer
from ..operators.pos import Tagger


@dataclass
class Model:
    name: str
    tagger: Tagger | None = None
    recognizer: Recognizer | None = None


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Writes the model's tables; fails if they exist."""
    if model.recognizer:
        r = model.recognizer
        rows = [(f, v, label, w) for (f, v), by in r.weights.items() for label, w in by.items()]
        spark.createDataFrame(rows, "fname string, fval string, label string, weight double").write.mode("errorifexists").parquet(f"{path}/Maxent/weights")
        spark.createDataFrame([(k, x) for k, x in enumerate(r.labels)], "ord int, label string").write.mode("errorifexists").parquet(f"{path}/Maxent/labels")
        spark.createDataFrame([(w,) for w in r.base_words], "word string").write.mode("errorifexists").parquet(f"{path}/Maxent/words")
    if model.tagger:
        t = model.tagger
        rows = [(f, c, w) for f, by in t.weights.items() for c, w in by.items()]
        spark.createDataFrame(rows, "feature string, class string, weight double").write.mode("errorifexists").parquet(f"{path}/Perceptron/weights")
        spark.createDataFrame(list(t.tags.items()), "word string, tag string").write.mode("errorifexists").parquet(f"{path}/Perceptron/tags")
        spark.createDataFrame([(c,) for c in t.classes], "class string").write.mode("errorifexists").parquet(f"{path}/Perceptron/classes")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> Model:
    """A model by its folder; its name is the folder's."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no model at {path}")
    model = Model(path.rstrip("/").rsplit("/", 1)[-1])
    if _exists(spark, f"{path}/Maxent/weights"):
        r = Recognizer([x.label for x in spark.read.parquet(f"{path}/Maxent/labels").orderBy("ord").collect()], {}, tuple(x.word for x in spark.read.parquet(f"{path}/Maxent/words").collect()))
        for x in spark.read.parquet(f"{path}/Maxent/weights").collect():
            r.weights.setdefault((x.fname, x.fval), {})[x.label] = x.weight
        model.recognizer = r
    if _exists(spark, f"{path}/Perceptron/weights"):
        t = Tagger(classes=sorted(x[0] for x in spark.read.parquet(f"{path}/Perceptron/classes").collect()))
        t.tags = {x.word: x.tag for x in spark.read.parquet(f"{path}/Perceptron/tags").collect()}
        for x in spark.read.parquet(f"{path}/Perceptron/weights").collect():
            t.weights.setdefault(x.feature, {})[x["class"]] = x.weight
        model.tagger = t
    return model


def find(spark: SparkSession, root: str, name: str) -> Model:
    """The first model folder of this name at any depth below root."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    open_ = [root]
    while open_:
        p = jvm.org.apache.hadoop.fs.Path(open_.pop(0))
        for s in sorted(p.getFileSystem(conf).listStatus(p), key=lambda s: s.getPath().getName()):
            if s.isDirectory():
                if s.getPath().getName() == name:
                    return load(spark, s.getPath().toString())
                open_.append(s.getPath().toString())
    raise FileNotFoundError(f"no model {name} below {root}")

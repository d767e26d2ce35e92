"""Boosted trees with leaf penalties (L4): fitted on all labelled rows, every row scored in the task that holds it.

The study's 551 rounds with L1 and L2 penalties and column samples are more than Spark's own boosting offers; a round of
that is several jobs. Here one barrier stage boosts the whole ensemble: each task keeps its share of the rows as binned
blocks, and the tasks add up the sums of a level (features x bins x nodes, some ten kB) before all of them make the same
splits. Draws follow a row's place in the order of ids and sums are exact, so the model does not depend on partitions.
"""

from __future__ import annotations

import base64
import math
import os
import pickle
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakscreen.operators import binned as bi
from peakscreen.operators import sampling as sm
from peakscreen.operators import trees as tr
from peakscreen.session import drop_tables, ensure_checkpoint_dir, ship_package

#: Rows that are worth a task of their own in a fit.
TASK_ROWS = 1 << 16
# The study's settings.
STUDY = {"rounds": 551, "eta": 0.125, "max_depth": 4, "subsample": 0.7, "columns": 0.5, "pos_weight": 2.0,
         "min_child_weight": 1.5, "gamma": 0.0, "reg_lambda": 0.0, "reg_alpha": 0.005}


@dataclass
class BoostedTrees:
    """A fitted ensemble: bin edges per feature and, per round, the columns and the tree."""
    features: list[str]
    edges: list[np.ndarray]
    eta: float
    rounds: list[tuple[np.ndarray, tr.Tree]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.ascontiguousarray(tr.binned(x, self.edges).T.astype(np.uint8))
        out = np.zeros(len(x))
        for cols, tree in self.rounds:
            out += self.eta * tr.predict_lines(tree, bins[cols])
        return out

    def score(self, df: DataFrame, out: str = "probas") -> DataFrame:
        """Append the probability of class 1; a null feature counts as 0."""
        spark = df.sparkSession
        ship_package(spark)
        model = spark.sparkContext.broadcast(self)               # trees of a fixed number and depth
        x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.features])
        boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), x.alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = model.value.margins(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(1 / (1 + np.exp(-m)))], names=["row", "p"])

        schema = T.StructType([boxed.schema["row"], T.StructField("p", T.DoubleType())])
        return boxed.mapInArrow(run, schema).select("row.*", F.col("p").alias(out))

    def importances(self) -> list[tuple[str, float]]:
        """Share of all splits that use each feature."""
        n = np.zeros(len(self.features))
        for cols, tree in self.rounds:
            np.add.at(n, cols[tree.feature[tree.feature >= 0]], 1)
        return list(zip(self.features, (n / max(n.sum(), 1)).tolist()))


def bounded_rows(df: DataFrame, label: str, id_col: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` labelled rows, classes in their proportion, the first of each in hash order."""
    labelled = df.where(F.col(f"`{label}`").isNotNull())
    cut = sm.hash_cuts(labelled, label, id_col, seed, lambda counts: sm.allocate(counts, min(rows, sum(counts.values()))))
    keep = F.lit(False)
    for c, upto in cut.items():
        keep = keep | ((F.col(f"`{label}`") == F.lit(c)) & (sm.hash_order(id_col, seed) <= F.lit(upto)))
    return labelled.where(keep)


class Sums:
    """Adds up arrays of whole numbers over the tasks of a barrier stage; every task gets the same sums.

    Spark's own gather answers once a second, and a fit asks 2,204 times. Where the tasks reach the folder of the staged tables as files
    (``folder``) they leave their arrays there; elsewhere they go through Spark's gather.
    """

    def __init__(self, folder: str | None, patience: float = 3600.0):
        self.context = BarrierTaskContext.get()
        self.me, self.tasks = self.context.partitionId(), len(self.context.getTaskInfos())
        # A stage that runs again must not find the files of its first attempt.
        attempt = self.context.allGather(uuid.uuid4().hex)[0]
        self.folder, self.patience, self.step = folder and f"{folder}/{attempt}", patience, 0
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)

    def _at(self, step: int, task: int) -> str:
        return f"{self.folder}/{step}-{task}"

    def _read(self, task: int) -> bytes:
        path, since, pause = self._at(self.step, task), time.monotonic(), 1e-4
        while True:
            try:
                with open(path, "rb") as f:
                    return f.read()
            except FileNotFoundError:
                if time.monotonic() - since > self.patience:
                    raise TimeoutError(f"no sums from task {task} in step {self.step}") from None
                time.sleep(pause)
                pause = min(2 * pause, 0.005)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        if not self.folder:
            said = [base64.b64decode(x) for x in self.context.allGather(base64.b64encode(own.tobytes()).decode())]
        else:
            path = self._at(self.step, self.me)
            with open(f"{path}.part", "wb") as f:
                f.write(own.tobytes())
            os.rename(f"{path}.part", path)
            said = [own.tobytes() if t == self.me else self._read(t) for t in range(self.tasks)]
            # Whoever has written this step has read the one before.
            if self.step:
                os.remove(self._at(self.step - 1, self.me))
            self.step += 1
        return np.sum([np.frombuffer(x) for x in said], axis=0).reshape(own.shape)


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at once; a barrier stage cannot have more, and none where executors come and go."""
    if (spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") or "").lower() == "true":
        return 1
    sc = spark.sparkContext._jsc.sc()
    return int(sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def fit_boosted(train: DataFrame, features: Sequence[str], label: str = "reported", id_col: str = "row_id", seed: int = 43,
                fit_rows: int | None = None, task_rows: int = TASK_ROWS, **settings) -> BoostedTrees:
    """The study's boosting on all labelled rows of ``train``, or on ``fit_rows`` at most if the caller names a number;
    ``settings`` replace those of ``STUDY``. Tasks run at once, so there are no more of them than cores."""
    how = {**STUDY, **settings}
    feats, spark = list(features), train.sparkSession
    ship_package(spark)
    labelled = train.where(F.col(f"`{label}`").isNotNull()) if fit_rows is None else bounded_rows(train, label, id_col, fit_rows, seed)
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), bi.vector(feats).alias("x"), F.col(f"`{label}`").cast("double").alias("y"),
                           F.lit(0).alias("fold"))
    [edges], [total] = bi.edges_without(rows, len(feats), [-1])
    if not total:
        raise ValueError("no labelled rows to fit on")
    blocks, path, starts = bi.stage_blocks(rows, edges, "boosting")
    growth = tr.Growth(**{k: how[k] for k in ("max_depth", "min_child_weight", "gamma", "reg_lambda", "reg_alpha")})
    where = f"{ensure_checkpoint_dir(spark)}/sums-{uuid.uuid4().hex}"
    folder = unquote(urlparse(where).path) if urlparse(where).scheme in ("", "file") else None
    tasks = max(1, min(_slots(spark), math.ceil(total / task_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(bi.read_blocks(batches, len(feats), starts))
        kept, _ = tr.boosted_parts(own, total, len(feats), max(map(len, edges)) + 1, how["rounds"], how["eta"], growth, seed, how["subsample"],
                                   how["columns"], how["pos_weight"], **({"summed": Sums(folder)} if tasks > 1 else {}))
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(kept)], pa.binary())], names=["model"])

    # Behind the last shuffle the barrier stage can run again if a task is lost.
    found = blocks.repartition(tasks).mapInArrow(run, "model binary", barrier=tasks > 1).repartition(1).collect()
    drop_tables(spark, path, where)
    return BoostedTrees(feats, edges, how["eta"], pickle.loads(bytes(found[0]["model"])))

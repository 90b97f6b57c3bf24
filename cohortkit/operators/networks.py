"""The networks of all folds score a row in one scan.

Each fold's scaler and layer weights are taken out of its fitted pipeline and
sent once; an Arrow batch goes through all folds' layers as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Network:
    """Scaler (mean, std) and layers (weights out x in, bias): sigmoid hidden layers, softmax output."""
    mean: np.ndarray
    std: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of every row."""
        a = (x - self.mean) / self.std
        for i, (w, b) in enumerate(self.layers):
            a = a @ w.T + b
            if i < len(self.layers) - 1:
                a = 1.0 / (1.0 + np.exp(-a))
        a = np.exp(a - a.max(axis=1, keepdims=True))
        return a[:, 1] / a.sum(axis=1)


def network(model: PipelineModel) -> Network:
    """The network of a fitted scaler + multilayer perceptron."""
    scaler, last = model.stages[0], model.stages[-1]
    sizes, flat, at, layers = last.getOrDefault(last.layers), last.weights.toArray(), 0, []
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        w = flat[at:at + n_in * n_out].reshape(n_out, n_in, order="F")
        at += n_in * n_out
        layers.append((w, flat[at:at + n_out]))
        at += n_out
    return Network(np.array(scaler.getOrDefault(scaler.means)), np.array(scaler.getOrDefault(scaler.stds)), layers)


def score_networks(df: DataFrame, models: dict[int, PipelineModel], features: Sequence[str], out: str = "prob",
                   keep: Sequence[str] = ()) -> DataFrame:
    """(``keep``, fold, ``out``): the probability of class 1 that every fold's network gives every row; one scan."""
    feats, keep = list(features), list(keep)
    sent = df.sparkSession.sparkContext.broadcast({f: network(m) for f, m in sorted(models.items())})
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("fold", T.LongType()), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = sent.value
        for b in batches:
            n = b.num_rows
            x = np.column_stack([b.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(feats))])
            for f, net in nets.items():
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(np.full(n, f, np.int64)), pa.array(net.probability(x))],
                                                 names=[*keep, "fold", out])

    return df.select(*keep, *feats).mapInArrow(run, schema)

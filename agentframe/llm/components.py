"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import discard, materialise

#: Links that a task contracts at a time.
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) links with the same components as the links a-b; the root of each is its smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        px, py = parent[x], parent[y]
        if (px == py).all():
            break
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    kept = parent != np.arange(len(nodes))
    return nodes[parent[kept]], nodes[kept]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(x.shape[1] for x in held) > CHUNK:
            held = [np.stack(forest(*np.concatenate(held, 1)))]
            if held[0].shape[1] > CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])
                held = []
    if held:
        a, b = forest(*np.concatenate(held, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b); label is the smallest node of the component.

    Tasks first contract their links to trees. Then labels pass along links and jump through labels of labels, so the rounds grow with the
    logarithm of a component's width; each round's labels are a written table, which goes when the next one is there.
    """
    links = materialise(links.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = materialise(hooked.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            discard(links)
            return labels

"""Exact sequential streams on executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from agentframe.functions.chacha import Stream


def first_draws(seeds: DataFrame, n: int) -> DataFrame:
    """(seed, k, word): the first n words of each seed's stream, as signed 64-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["seed"]:
                stream = Stream(int(seed))
                words = [stream.u64() for _ in range(n)]
                yield pd.DataFrame({"seed": seed, "k": range(n), "word": [w - (1 << 64) if w >> 63 else w for w in words]})

    return seeds.select("seed").mapInPandas(run, "seed long, k long, word long")

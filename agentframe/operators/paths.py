"""Paths as a table function: rows of a key, in order, move a walker that stops at the edges, which no window can say.

    SELECT * FROM follow_path(TABLE(moves) PARTITION BY (idx) ORDER BY (step), 1000, 1000)

The table has idx, step, dx and dy; analyze checks that and takes the key's type over. Spark deals the keys out; a key's rows pass one by one, so memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NEEDED = ("idx", "step", "dx", "dy")


class PathFollower:
    """Each move's place, the way gone so far, and how often the walker met an edge. The walk starts in the middle; null moves are none."""

    def __init__(self):
        self.x = self.y = None
        self.way, self.hits = 0.0, 0

    @staticmethod
    def analyze(moves: AnalyzeArgument, width: AnalyzeArgument, height: AnalyzeArgument) -> AnalyzeResult:
        if not moves.isTable:
            raise ValueError("follow_path takes a table: TABLE(...) PARTITION BY idx ORDER BY step")
        missing = [c for c in NEEDED if c not in moves.dataType.names]
        if missing:
            raise ValueError(f"follow_path needs columns {', '.join(missing)}")
        if min(width.value or 0, height.value or 0) <= 0:
            raise ValueError("follow_path needs a positive width and height")
        kinds = [moves.dataType["idx"], moves.dataType["step"]]
        return AnalyzeResult(StructType([*(StructField(k.name, k.dataType) for k in kinds), *(StructField(n, DoubleType()) for n in ("px", "py", "way")), StructField("hits", LongType())]))

    def eval(self, row: Row, width: float, height: float) -> Iterator[tuple]:
        width, height = float(width), float(height)
        if self.x is None:
            self.x, self.y = width / 2, height / 2
        x, y = self.x + (row["dx"] or 0.0), self.y + (row["dy"] or 0.0)
        nx, ny = min(max(x, 0.0), width), min(max(y, 0.0), height)
        self.hits += (nx, ny) != (x, y)
        self.way += abs(nx - self.x) + abs(ny - self.y)
        self.x, self.y = nx, ny
        yield row["idx"], row["step"], nx, ny, self.way, self.hits


def register(spark: SparkSession) -> None:
    """Makes follow_path known to SQL."""
    spark.udtf.register("follow_path", udtf(PathFollower))


def follow(moves: DataFrame, width: float, height: float) -> DataFrame:
    """(idx, step, px, py, way, hits) of moves (idx, step, dx, dy)."""
    spark = moves.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM follow_path(TABLE(SELECT idx, step, dx, dy FROM {moves}) PARTITION BY (idx) ORDER BY (step), {width}, {height})", moves=moves, width=float(width), height=float(height))

"""Draws over HTTP as a Spark data source, batch and streaming, and which draws are still to be fetched.

As a stream the offset is the next draw's number: a load begins after the largest stored
draw (or where the reach begins), each batch is at most `draws_per_batch` draws, planned
in tasks of `draws_per_task`, and Spark's checkpoint commits it. A draw that can't be
fetched fails its batch, which is then run again; nothing is passed over.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TIMEOUT = 15
#: Draws a year of each game, for the reach of a first load.
PER_YEAR = {"g6_60": 104, "g15_25": 156}


def fetch(base: str, path: str, number: int | None = None) -> str:
    """The JSON text of one draw, the latest without number; raises on an answer that isn't a success."""
    with urllib.request.urlopen(f"{base.rstrip('/')}/{path}" + (f"/{number}" if number is not None else ""), timeout=TIMEOUT) as r:
        return r.read().decode()


class Numbers(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class DrawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.path = options["base"], options.get("game_path", "")
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", -1))
        self.size, self.skip = int(options.get("draws_per_task", 50)), options.get("skip_errors", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [Numbers(a, min(self.last, a + self.size - 1)) for a in range(self.first, self.last + 1, self.size)] or [Numbers(0, -1)]

    def read(self, part: Numbers) -> Iterator[tuple]:
        for n in range(part.first, part.last + 1):
            try:
                yield n, fetch(self.base, self.path, n), None
            except Exception as e:
                if not self.skip:
                    raise
                yield n, None, str(e)[:200]


class DrawStream(DataSourceStreamReader):
    """Options besides those of a batch: `after`, the largest number that needs no fetching, and `draws_per_batch`."""

    def __init__(self, options: dict[str, str]):
        self.batch = DrawReader({**options, "skip_errors": "false"})
        self.many = int(options.get("draws_per_batch", 100))
        self.next = int(options.get("after", 0)) + 1

    def initialOffset(self) -> dict:
        return {"next": self.next}

    def latestOffset(self) -> dict:
        """At most `draws_per_batch` beyond what was planned last, as far as there are draws."""
        end = min(latest(self.batch.base, self.batch.path) + 1, self.next + self.many)
        return {"next": max(self.next, end)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.next = max(self.next, end["next"])
        return [Numbers(a, min(end["next"] - 1, a + self.batch.size - 1)) for a in range(start["next"], end["next"], self.batch.size)]

    def read(self, part: Numbers) -> Iterator[tuple]:
        return self.batch.read(part)

    def commit(self, end: dict) -> None:
        self.next = max(self.next, end["next"])


class DrawSource(DataSource):
    """spark.read.format("draws_http").option("base", url).option("first", 1).option("last", 9).load(): rows (numero, value, error)."""

    @classmethod
    def name(cls) -> str:
        return "draws_http"

    def schema(self) -> str:
        return "numero int, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return DrawReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DrawStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DrawSource)


def latest(base: str, path: str) -> int:
    return int(json.loads(fetch(base, path))["numero"])


def first_of_reach(latest: int, game: str, years: int = 5) -> int:
    """The smallest number that a first load fetches."""
    return max(1, latest - PER_YEAR[game] * years)


def planned(spark: SparkSession, checkpoint: str) -> int:
    """The largest number that a stream with that checkpoint has planned, 0 for none."""
    try:
        lines = spark.read.text(f"{checkpoint}/offsets")
    except Exception as e:  # the stream hasn't run yet
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise
    top = lines.select(F.max(F.get_json_object("value", "$.next").cast("int"))).head()[0]
    return (top or 1) - 1


def missing(stored: DataFrame, game: str, latest: int, years: int = 5) -> DataFrame:
    """Rows (numero) within reach that the store lacks: also gaps that an interrupted load left, not only those after the largest."""
    first = first_of_reach(latest, game, years)
    every = stored.sparkSession.range(first, latest + 1).select(F.col("id").cast("int").alias("numero"))
    return every.join(stored.where(F.col("game") == game).select(F.col("numero").cast("int").alias("numero")), "numero", "left_anti")

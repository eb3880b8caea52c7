"""Models refitted at every draw along time, from running moments instead of earlier rows.

All numbers of a game learn from the same features of a draw: its own (calendar, place,
shape) and every number's series, as one array; numbers differ only in what they
predict. So the sums of products of (1, features, labels) of all draws before are all
that a ridge regression of every number needs: tasks add them up for their draws, Spark
adds the tasks' sums row by row, and for each of the last draws one small system is
solved for all numbers together, after which that draw's products are added. The matrix
has a row for each feature and number, however long the log is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urnwise.cluster import cut, ship
from urnwise.operators.tickets import per_game

#: The penalty on squared weights of standardised features.
RIDGE = 10.0
#: Draws that are predicted, each from all before it, but none before this share of the log.
LAST, SHARE = 50, 0.6


def draw_rows(rows: DataFrame, of_draw: list[str], of_number: list[str]) -> DataFrame:
    """Rows (game, idx, numero, x, y): the features of each draw, those of all numbers among them, and what the numbers did (null in the coming draw), from the long frame."""
    own = F.array_sort(F.collect_list(F.struct("n", *of_number, "label")))  # a row for each number
    wide = rows.groupBy("game", "idx", "numero").agg(own.alias("own"), *(F.first(c).alias(c) for c in of_draw))
    series = F.flatten(F.transform("own", lambda r: F.array(*(r[c].cast("double") for c in of_number)))) if of_number else F.array().cast("array<double>")
    draw = F.array(*(F.col(c).cast("double") for c in of_draw)) if of_draw else F.array().cast("array<double>")
    y = F.transform("own", lambda r: r["label"])
    return wide.select("game", "idx", "numero", F.transform(F.concat(draw, series), lambda v: F.coalesce(v, F.lit(0.0))).alias("x"), F.when(F.get(y, F.lit(0)).isNotNull(), y).alias("y"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """(1, x, y) of each row; rows of one game are equally long."""
    x, y = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("x", "y"))
    return np.hstack([np.ones((len(x), 1)), x, y])


def products(known: DataFrame) -> DataFrame:
    """Rows (game, i, v): row i of the sum of products of (1, x, y) over all draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for game in batch.column("game").unique().to_pylist():
                z = _matrix(batch.filter(pc.equal(batch.column("game"), game)))
                sums[game] = sums.get(game, 0.0) + z.T @ z
        for game, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([game] * len(total)), pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["game", "i", "v"])

    def add(group: pa.Table) -> pa.Table:  # one row from each task
        total = group.column("v").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"game": group.column("game").slice(0, 1), "i": group.column("i").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    schema = "game string, i long, v array<double>"
    return known.mapInArrow(run, schema).groupBy("game", "i").applyInArrow(add, schema)


def fitted(moments: np.ndarray, m: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, weights) of m labels on the features, by the sums of products of (1, features, labels)."""
    n, p = moments[0, 0], len(moments) - 1 - m
    if n < 1:
        return np.zeros(m), np.zeros((p, m))
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov)[:p], 0.0))
    some = spread > 1e-9 * np.maximum(1.0, np.abs(mean[:p]))
    weights = np.zeros((p, m))
    if some.any():
        scale = spread[some]
        a = cov[:p, :p][np.ix_(some, some)] / np.outer(scale, scale) + ridge / n * np.eye(len(scale))
        b = cov[:p, p:][some] / scale[:, None]
        if ridge > 0:
            low = np.linalg.cholesky(a)
            solved = np.linalg.solve(low.T, np.linalg.solve(low, b))
        else:
            solved = np.linalg.lstsq(a, b, rcond=None)[0]
        weights[some] = solved / scale[:, None]
    return mean[p:] - mean[:p] @ weights, weights


def refits(rows: DataFrame, last: int = LAST, ridge: float = RIDGE) -> DataFrame:
    """Rows (game, numero, n, label, score) of the last draws of rows (game, idx, numero, x, y): each draw's scores from a fit on all draws before it."""
    ship(rows.sparkSession)
    known = cut(rows.where("y is not null"))
    first = known.groupBy("game").agg(F.greatest(F.max("idx") - last + 1, F.floor(F.max("idx") * SHARE)).alias("first"))
    marked = known.join(F.broadcast(first), "game")  # one row for each game
    before = products(marked.where("idx < first").select("game", "x", "y")).select("game", "i", F.lit(None).cast("long").alias("numero"), "v", F.lit(0).alias("m"))
    target = marked.where("idx >= first").select("game", F.col("idx").alias("i"), "numero", F.concat(F.array(F.lit(1.0)), "x", "y").alias("v"), F.size("y").alias("m"))

    def solve(group: pa.Table) -> pa.Table:  # a row for each feature and number, and one for each predicted draw
        names, i, v, m = (group.column(c).to_pylist() for c in ("numero", "i", "v", "m"))
        draws = sorted(j for j, x in enumerate(names) if x is not None)
        draws.sort(key=lambda j: i[j])
        if not draws:
            return schema.empty_table()
        width, own = len(v[draws[0]]), m[draws[0]]
        moments = np.zeros((width, width))
        for j, x in enumerate(names):
            if x is None:
                moments[i[j]] = v[j]
        out = []
        for j in draws:
            z = np.array(v[j])
            intercept, weights = fitted(moments, own, ridge)
            score = np.clip(intercept + z[1 : width - own] @ weights, 0.0, 1.0)
            out.append((names[j], z[width - own :], score))
            moments += np.outer(z, z)
        columns = [np.repeat([x[0] for x in out], own), np.tile(np.arange(1, own + 1, dtype=np.int32), len(out)), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])]
        return pa.table([pa.array([group.column("game")[0].as_py()] * len(columns[0])), *map(pa.array, columns)], schema=schema)

    schema = pa.schema([("game", pa.string()), ("numero", pa.int64()), ("n", pa.int32()), ("label", pa.float64()), ("score", pa.float64())])
    return before.unionByName(target).groupBy("game").applyInArrow(solve, "game string, numero long, n int, label double, score double")


def hits(scores: DataFrame) -> DataFrame:
    """Per draw: hits among the k numbers of highest score, and among twice as many; ties go to the smaller number."""
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("game", "numero").orderBy(F.desc("score"), "n")))  # a row for each number
    k = per_game(lambda g: F.lit(g.k))
    of = lambda x: F.sum(F.when(F.col("r") <= x, F.col("label")).otherwise(0.0)).cast("int")
    return ranked.groupBy("game", "numero").agg(of(k).alias("hits"), of(2 * k).alias("hits_wide"))

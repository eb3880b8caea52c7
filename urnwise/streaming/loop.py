"""Structured Streaming: landing of draws, the mining loop, and event windows.

Stored draws are an append-only log of batches: a batch writes (or rewrites) only its own
folder, so a batch that is run again after a failure leaves the same rows; reading takes
the latest version of each draw. What a new draw is merged with is keyed state, not the
store. `compact` turns many batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from urnwise.cluster import cut, path_of, ship
from urnwise.operators import bank as B
from urnwise.operators import hypotheses as H
from urnwise.operators import increments as I  # noqa: E741
from urnwise.sources import http
from urnwise.sources.draws import high_water, normalise

KEYS = ["game", "numero"]
#: The columns of a stored draw besides its key, and those that may come late.
DRAW = "data date, dezenas array<int>, local string, acumulado boolean, valor_acumulado double, valor_estimado double, valor_arrecadado double, ordem_sorteio array<int>"
NAMES = [c.split()[0] for c in DRAW.split(", ")]
#: Draws that count as recent in a round of mining.
RECENT = 50
LATE = ("valor_acumulado", "valor_estimado", "valor_arrecadado", "ordem_sorteio")


def stored(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The latest version of each stored draw; None before the first batch."""
    try:
        log = spark.read.parquet(path)
    except Exception as e:  # the folder isn't there before the first batch
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    latest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("batch")))
    return log.withColumn("_r", latest).where("_r = 1").drop("_r", "batch")


class Merge(StatefulProcessor):
    """What is stored of a draw: the first version, with late money and order as long as no accumulated value is known."""

    def init(self, handle) -> None:
        self.draw = handle.getValueState("draw", DRAW)

    def handleInputRows(self, key, rows, timerValues):
        old = self.draw.get() if self.draw.exists() else None
        now = None if old is None else dict(zip(NAMES, old, strict=True))
        before = dict(now) if now else None
        for row in rows:
            new = {c: row[c] for c in NAMES}
            if now is None:
                now = new
            elif not now["valor_acumulado"] and (new["valor_arrecadado"] or 0) > 0:
                now |= {c: new[c] for c in LATE}
        if now != before:
            self.draw.update(tuple(now[c] for c in NAMES))
            yield Row(game=key[0], numero=key[1], **now)

    def close(self) -> None:
        pass


def merged(draws: DataFrame) -> DataFrame:
    """A stream of normalised draws as a stream of new and corrected ones; what is stored is state by draw, so a batch's work is its own rows.

    Keeps its state in RocksDB, on the executors and in the query's checkpoint.
    """
    draws.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return draws.groupBy(*KEYS).transformWithState(Merge(), f"game string, numero int, {DRAW}", "append", "none")


def _store(rows: DataFrame, store: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return merged(rows).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str, game: str, **trigger) -> StreamingQuery:
    """Draws as JSON texts from a landing folder into the store: new ones inserted, late money corrected, stored ones left."""
    ship(spark)
    return _store(normalise(spark.readStream.format("text").load(landing), game), store, checkpoint, trigger or {"availableNow": True})


def ingest_http(spark: SparkSession, url: str, path: str, store: str, checkpoint: str, game: str, years: int = 5, per_batch: int = 100, per_task: int = 25, **trigger) -> StreamingQuery:
    """Draws from HTTP into the store, from the one after the largest that is stored or planned (or the beginning of the reach) on, committed every per_batch draws."""
    ship(spark)
    http.register(spark)
    old = stored(spark, store)
    mark = high_water(old, game).head()[0] if old is not None else 0
    after = max(mark, http.planned(spark, checkpoint), http.first_of_reach(http.latest(url, path), game, years) - 1)
    source = spark.readStream.format("draws_http").option("base", url).option("game_path", path).option("after", after).option("draws_per_batch", per_batch).option("draws_per_task", per_task).load()
    return _store(normalise(source, game), store, checkpoint, trigger or {"processingTime": "1 second"})


def load_http(spark: SparkSession, url: str, path: str, store: str, checkpoint: str, game: str, **options) -> None:
    """`ingest_http` up to the latest draw there is."""
    query = ingest_http(spark, url, path, store, checkpoint, game, **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def compact(spark: SparkSession, store: str) -> None:
    """All batches so far as one: the latest versions, under a number between the last batch and the next, and only then the old folders go.

    A run that fails in between leaves rows twice, of which reading takes the latest; so it may be run again.
    """
    rows = stored(spark, store)
    if rows is None:
        return
    last = spark.read.parquet(store).agg(F.max("batch")).head()[0]
    kept = int(last) + 0.5
    if last != kept:
        rows.write.mode("overwrite").parquet(f"{store}/batch={kept}")
    files, folder = path_of(spark, store)
    for entry in files.listStatus(folder):  # a folder for each batch
        name = entry.getPath().getName()
        if name.startswith("batch=") and float(name.removeprefix("batch=")) < kept:
            files.delete(entry.getPath(), True)


def prospect(ctx: DataFrame, bank: DataFrame, names: list[str], again: float = 0.15, seed: int = 0, tallied: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """One round of mining: tests names that the bank lacks and a share of those it has, scores, merges, invalidates, prunes.

    tallied(ctx, names) gives the names' tallies; where it is left out they are counted over the whole log.
    """
    spark = ctx.sparkSession
    games = ctx.select("game").distinct()
    every = games.join(spark.createDataFrame([(n,) for n in names], "nome string"))
    new = B.untested(every, bank)
    share = bank.where("ativo").where(F.pmod(F.xxhash64("nome", F.lit(seed)), F.lit(1000)) < int(again * 1000)).select("game", "nome")
    todo = new.unionByName(share)
    own = sorted({r["nome"] for r in todo.select("nome").distinct().collect()})  # names of one round
    if not own:
        return B.prune(bank)
    # a name is tested in every game; one of a share that only another game holds is tested again, harmlessly
    both = cut(tallied(ctx, own) if tallied else H.tallies_of(ctx, own, since=RECENT))
    overall = H.with_p(H.test(both)).where(F.col("p_valor") < B.threshold(len(own))).join(todo, ["game", "nome"], "left_semi")
    recent = H.with_p(H.test(both.select("game", "nome", *(F.col(f"{c}_recente").alias(c) for c in ("tentativas", "acertos", "previstos")))))
    scored = B.scored(overall, recent).where("score_confianca > 0.1")
    found = scored.select("game", "nome", F.lit("prog").alias("cat"), F.col("nome").alias("descr"), "p_valor", "lift", "taxa_obs", "taxa_esp", "tentativas", F.lit(True).alias("ativo"), "p_valor_recente", "lift_recente", "score_confianca")
    failed = share.join(scored.select("game", "nome"), ["game", "nome"], "left_anti")
    return B.prune(B.invalidate(B.merge(bank, found), failed))


def mine(spark: SparkSession, ctx: Callable[[], DataFrame], bank_path: str, checkpoint: str, names: Callable[[int], list[str]], every: str = "5 seconds") -> StreamingQuery:
    """The endless loop: each tick of a rate source is one round on the log as it is then; round r writes bank_path/round=r.

    Tallies are kept beside the bank, so a round counts the draws that came since the last one; round r writes them to bank_path-tallies/round=r.
    """

    def before(path: str, number: int) -> DataFrame | None:
        """The rows of the last round before that number; None in the first."""
        try:
            every = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        top = every.where(F.col("round") < number).agg(F.max("round")).head()[0]
        return every.where(F.col("round") == top).drop("round") if top is not None else None

    def step(batch: DataFrame, number: int) -> None:
        def tallied(rows: DataFrame, own: list[str]) -> DataFrame:
            at = f"{bank_path}-tallies/round={number}"
            I.advance(before(f"{bank_path}-tallies", number), rows, own, RECENT).write.mode("overwrite").parquet(at)
            return spark.read.parquet(at).where(F.col("nome").isin(own) & (F.col("tentativas") > 0)).drop("top")

        bank = before(bank_path, number)
        bank = bank if bank is not None else spark.createDataFrame([], B.BANK)
        prospect(ctx(), bank, names(number), seed=number, tallied=tallied).write.mode("overwrite").parquet(f"{bank_path}/round={number}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums of an event stream or table (ts, event_type, value), with a watermark on streams."""
    # a watermark needs a time with zone
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

"""Draw logs: mapped from order tables, from JSON documents, and kept up to date.

A draw is a row of `draws` (attributes) and its items are rows of `draw_items` (game,
numero, dezena, posicao). `ctx` joins both with the two draws before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from urnwise.cluster import cut
from urnwise.functions.scalar import date_of, mask
from urnwise.games import GAMES
from urnwise.operators.sequence import lagged, numbered

#: The JSON document of one draw.
DRAW_JSON = T.StructType(
    [
        T.StructField("numero", T.IntegerType()),
        T.StructField("dataApuracao", T.StringType()),
        T.StructField("listaDezenas", T.ArrayType(T.StringType())),
        T.StructField("nomeMunicipioUFSorteio", T.StringType()),
        T.StructField("acumulado", T.BooleanType()),
        T.StructField("valorAcumuladoProximoConcurso", T.DoubleType()),
        T.StructField("valorEstimadoProximoConcurso", T.DoubleType()),
        T.StructField("valorArrecadado", T.DoubleType()),
        T.StructField("dezenasSorteadasOrdemSorteio", T.ArrayType(T.StringType())),
    ]
)


def _games(per_game) -> F.Column:
    """One array of structs, an element for each game (a small number for its key), to be exploded: no join with a dimension."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("g"), *per_game(g)) for i, g in enumerate(GAMES.values()))))


def _key(f) -> F.Column:
    """f(game) of the row's game number."""
    return F.element_at(F.array(*(F.lit(f(g)) for g in GAMES.values())), F.col("g") + 1)


def draw_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (game, numero, dezenas, mask): k distinct numbers, sorted, and as bits, for each block of orders that has so many.

    One shuffle: a block's distinct numbers are bits of one word, whose partial
    aggregates are single longs, and choice and order happen inside the row.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    raw = lines.select(_games(lambda g: (F.expr(f"l_orderkey div {g.block}").alias("numero"), F.expr(f"shiftleft(1L, cast(l_partkey % {g.m} + 1 as int))").alias("bit"))).alias("x")).select("x.*")
    sets = raw.groupBy("g", "numero").agg(F.bit_or("bit").alias("all")).where(F.bit_count("all") >= _key(lambda g: g.k))
    held = F.filter(F.sequence(F.lit(1), _key(lambda g: g.m)), lambda d: F.getbit(F.col("all"), d) == 1)
    ranked = F.array_sort(F.transform(held, lambda d: F.struct(((d * 37 + F.col("numero") * 11) % 61).alias("r"), d.alias("d"))))
    rows = sets.select(_key(lambda g: g.key).alias("game"), "numero", F.array_sort(F.transform(F.slice(ranked, F.lit(1), _key(lambda g: g.k)), lambda x: x["d"])).alias("dezenas"))
    return rows.withColumn("mask", mask(F.col("dezenas")))


def items_of(drawn: DataFrame) -> DataFrame:
    """Rows (game, numero, dezena, posicao) of draws, posicao 0-based in sorted order."""
    return drawn.select("game", "numero", F.posexplode("dezenas").alias("posicao", "dezena")).select("game", "numero", "dezena", "posicao")


def draw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the mapped draws, which are written once: results that look at them more than once don't map them again."""
    return items_of(cut(draw_arrays(spark, sf_dir)))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (game, numero, data, local, acumulado, valor_arrecadado, valor_estimado, valor_acumulado): every block, also those with too few numbers.

    An order counts for its own block and, as the estimate, for the next one, so one
    aggregation gives both and the log needs no ordering.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice").alias("total"))
    customers = read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(read("nation").select("n_nationkey", "n_name"), "n_nationkey")
    blocks = [F.struct(F.lit(g.key).alias("game"), (F.expr(f"o_orderkey div {g.block}") + later).alias("numero"), F.lit(later == 0).alias("own")) for g in GAMES.values() for later in (0, 1)]
    per = orders.join(customers, "o_custkey").select(F.explode(F.array(*blocks)).alias("x"), "o_orderstatus", "total", "n_name")
    own = lambda c: F.when(F.col("x.own"), c)
    out = per.groupBy("x.game", "x.numero").agg(
        F.max(own((F.col("o_orderstatus") == "O").cast("int"))).alias("acumulado"),
        F.sum(own(F.col("total"))).alias("valor_arrecadado"),
        F.concat(F.lit("City, "), F.min(own(F.col("n_name")))).alias("local"),
        F.coalesce(F.sum(F.when(~F.col("x.own"), F.col("total"))), F.lit(0.0)).alias("valor_estimado"),
    )
    rows = out.where("acumulado is not null").withColumn("valor_acumulado", F.col("valor_estimado"))
    return rows.withColumn("data", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("numero") * 3).cast("int")))


def spread(rows: DataFrame) -> DataFrame:
    """rows of a log over as many tasks as the session shuffles into: what follows multiplies each of them, so their bytes say little about the work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "game", "numero")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each draw, without attributes: idx (0-based place in the game), dezenas, mask, prev and prev2 (sorted arrays); written once."""
    rows = numbered(cut(draw_arrays(spark, sf_dir)), "game", "numero")
    return cut(spread(lagged(rows, "game", {"prev": ("dezenas", 1), "prev2": ("dezenas", 2)})))


def ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the attributes of its draws; written once."""
    return cut(spread(log(spark, sf_dir).join(draws(spark, sf_dir), ["game", "numero"])))


def next_draw(rows: DataFrame, days: int = 3) -> DataFrame:
    """A row for each game's draw that is still to come, from a log with or without attributes.

    It has the next number and place and no numbers; the two last draws are its draws
    before. Attributes are the last draw's, as they are known by then, but for sales
    (0) and the date (`days` after the last one).
    """
    last = rows.groupBy("game").agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c != "game")), "idx").alias("x"))
    new = {
        "numero": F.col("x.numero") + 1, "idx": F.col("x.idx") + 1, "dezenas": F.array().cast("array<int>"), "mask": F.lit(0).cast("long"),
        "prev": F.col("x.dezenas"), "prev2": F.col("x.prev"), "ordem": F.array().cast("array<int>"), "valor_arrecadado": F.lit(0.0),
    }
    if "data" in rows.columns:
        new["data"] = F.date_add(F.col("x.data"), days)
    return last.select(*("game" if c == "game" else new.get(c, F.col(f"x.{c}")).alias(c) for c in rows.columns))


def order_drawn(spark: SparkSession, sf_dir: str, drawn: DataFrame | None = None) -> DataFrame:
    """Rows (game, numero, dezena, place): the order in which a draw's numbers came, by first line, then number; drawn: the draws, if they are at hand."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    each = _games(lambda g: (F.expr(f"l_orderkey div {g.block}").alias("numero"), (F.col("l_partkey") % g.m + 1).cast("int").alias("dezena")))
    raw = lines.select(each.alias("x"), "l_linenumber").groupBy("x.g", "x.numero", "x.dezena").agg(F.min("l_linenumber").alias("line")).withColumn("game", _key(lambda g: g.key))
    kept = raw.join(items_of(drawn if drawn is not None else draw_arrays(spark, sf_dir)), ["game", "numero", "dezena"])
    return kept.select("game", "numero", "dezena", F.row_number().over(Window.partitionBy("game", "numero").orderBy("line", "dezena")).alias("place"))


def with_order(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (a log with attributes) with `ordem`, each draw's numbers in order of draw."""
    ordered = order_drawn(spark, sf_dir, rows).groupBy("game", "numero").agg(F.sort_array(F.collect_list(F.struct("place", "dezena"))).alias("o"))
    return spread(rows.join(ordered.select("game", "numero", F.transform("o", lambda x: x["dezena"]).alias("ordem")), ["game", "numero"]))


def normalise(documents: DataFrame, game: str, column: str = "value") -> DataFrame:
    """Draws with their items from JSON texts: renamed, items cast, missing money as 0, dates parsed."""
    x = F.from_json(F.col(column), DRAW_JSON)
    own = documents.select(x.alias("x")).where("x.numero is not null")
    ints = lambda c: F.transform(c, lambda v: v.cast("int"))
    return own.select(
        F.lit(game).alias("game"),
        F.col("x.numero").alias("numero"),
        date_of(F.col("x.dataApuracao")).alias("data"),
        F.array_sort(ints(F.col("x.listaDezenas"))).alias("dezenas"),
        F.coalesce("x.nomeMunicipioUFSorteio", F.lit("")).alias("local"),
        F.coalesce("x.acumulado", F.lit(False)).alias("acumulado"),
        F.coalesce("x.valorAcumuladoProximoConcurso", F.lit(0.0)).alias("valor_acumulado"),
        F.coalesce("x.valorEstimadoProximoConcurso", F.lit(0.0)).alias("valor_estimado"),
        F.coalesce("x.valorArrecadado", F.lit(0.0)).alias("valor_arrecadado"),
        ints(F.coalesce("x.dezenasSorteadasOrdemSorteio", F.array().cast("array<string>"))).alias("ordem_sorteio"),
    )


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those rows of new whose key isn't stored yet (one row for each key)."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def correct_late(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored, with money and order from new where stored has no accumulated value and new has sales."""
    fields = ("valor_acumulado", "valor_estimado", "valor_arrecadado", "ordem_sorteio")
    own = [c for c in fields if c in stored.columns and c in new.columns]
    late = new.dropDuplicates(keys).select(*keys, *(F.col(c).alias(f"_{c}") for c in own))
    joined = stored.join(late, keys, "left")
    apply = (F.coalesce("valor_acumulado", F.lit(0.0)) == 0) & (F.col("_valor_arrecadado") > 0)
    return joined.select(*(F.when(apply, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in stored.columns))


def high_water(stored: DataFrame, game: str) -> DataFrame:
    """One row (numero): the largest stored number of a game, 0 for none."""
    return stored.where(F.col("game") == game).agg(F.coalesce(F.max("numero"), F.lit(0)).alias("numero"))


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union under the wider schema; columns that one side lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def write_draws(rows: DataFrame, path: str) -> None:
    """Parquet partitioned by game, so that a game's queries read its folder only."""
    rows.write.mode("overwrite").partitionBy("game").parquet(path)


def write_probabilities(rows: DataFrame, path: str) -> None:
    """Probabilities of numbers (game, dezena, prob, further columns), Parquet by game; a later run for some games replaces those alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("game").parquet(path)


def write_report(lines: DataFrame, path: str, column: str = "line") -> None:
    """A text report (Markdown) in order of `place`."""
    lines.orderBy("place").select(column).coalesce(1).write.mode("overwrite").text(path)

"""Command line: registered queries and groups of them, on a folder of tables.

    python -m urnwise                                list of commands and queries
    python -m urnwise NAME FOLDER [ROWS]             a command's queries, or one query
    python -m urnwise coletar URL PATH GAME OUT               draws from HTTP to Parquet, from the largest stored one on, committed as they come
    python -m urnwise coletar URL PATH GAME FIRST LAST OUT    the same for given numbers, those that OUT lacks
"""

from __future__ import annotations

import sys

from urnwise.plans.queries import QUERIES

#: What each command shows.
COMMANDS = {
    "descobrir": ["ml_probs", "ml_tickets", "ml_backtest"],
    "conferir": ["bet_check", "best_bet"],
    "perfil": ["profile_forecast", "profile_tickets"],
    "caos": ["hyp_handwritten"],
    "sugerir": ["score_fusion", "score_explained", "suggested_ticket", "optimised_tickets"],
    "prospectar": ["prospect_round", "bank_stats"],
    "avaliar": ["retro", "retro_verdict", "retro_tickets"],
    "coocorrencia": ["attracting_pairs", "anti_pairs"],
    "correlacoes": ["weekday_freq", "month_freq", "uf_freq", "deviations"],
    "gerador": ["hyp_unary", "hyp_binary", "hyp_sets", "hyp_window"],
    "backtesting": ["walk_forward", "ml_backtest"],
    "filtros": ["filter_ticket", "valid_tickets"],
    "wheel": ["greedy_cover", "wheel_simulation"],
    "diagnostico": ["diagnostic_report", "perm_entropy", "changepoints"],
    "roi": ["roi_branches", "roi_summary"],
}


def collect(spark, url: str, path: str, game: str, first: str, last: str, out: str) -> None:
    """Draws first..last that are not stored yet, fetched in tasks, normalised and added to the Parquet folder of the game."""
    from urnwise.sources import http
    from urnwise.sources.draws import normalise
    from urnwise.streaming.loop import stored

    http.register(spark)
    rows = spark.read.format("draws_http").option("base", url).option("game_path", path).option("first", first).option("last", last).load()
    new = normalise(rows.where("error is null"), game).dropDuplicates(["game", "numero"])
    old = stored(spark, out)
    if old is not None:
        new = new.join(old.select("game", "numero"), ["game", "numero"], "left_anti")
    batch = 0 if old is None else spark.read.parquet(out).selectExpr("max(batch) + 1").head()[0]
    new.write.parquet(f"{out}/batch={batch}")


def main(args: list[str]) -> int:
    known = args and (args[0] in COMMANDS or args[0] in QUERIES or args[0] == "coletar")
    if not known or len(args) not in (5, 7) and args[0] == "coletar" or len(args) < 2:
        print("\n".join(["coletar", *COMMANDS, *sorted(QUERIES)]))
        return int(bool(args))
    from pyspark.sql import SparkSession

    from urnwise.cluster import ship
    from urnwise.streaming.loop import load_http

    spark = SparkSession.builder.appName("urnwise").getOrCreate()
    if args[0] == "coletar":
        ship(spark)
        if len(args) == 5:
            url, path, game, out = args[1:]
            load_http(spark, url, path, out, f"{out.rstrip('/')}-offsets", game)
        else:
            collect(spark, *args[1:])
        return 0
    for name in COMMANDS.get(args[0], [args[0]]):
        print(name)
        QUERIES[name](spark, args[1]).show(int(args[2]) if len(args) > 2 else 20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

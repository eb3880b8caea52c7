"""What is made inside a draw's row is what rows for each number, ticket or pair of fields give."""

import numpy as np

from urnwise.operators import features as X
from urnwise.operators import hypotheses as H
from urnwise.operators import learning as L
from urnwise.operators import refits as W
from urnwise.operators import tickets as T
from urnwise.plans import queries as Q


def test_best_ticket_inside_a_row(spark, ctx):
    tickets = Q._played(spark)
    plan = T.best_of_tickets(tickets, ctx)
    cols = ["game", "numero", "ticket", "hits", "prize"]
    assert sorted(plan.select(cols).collect()) == sorted(T.best_of_group(T.check(tickets, ctx)).select(cols).collect())
    assert "max_by" not in plan._jdf.queryExecution().toString()


def test_wide_rows_are_those_of_the_long_frame(spark, ctx):
    of_draw, number = ["soma", "pares"], list(L.SERIES)
    shape = X.shape(ctx).select("game", "numero", "soma", "pares")
    own = {(r["game"], r["idx"]): r for r in L.wide(ctx, shape, of_draw, number).collect()}
    long = W.draw_rows(L.frame(ctx, shape), of_draw, number).collect()
    assert len(own) == len(long) > 100
    for r in long:
        x = own[r["game"], r["idx"]]
        assert x["numero"] == r["numero"] and x["y"] == r["y"] and np.allclose(x["x"], r["x"], atol=1e-12)


def test_pairs_counted_by_tasks(spark, ctx):
    cols = ["game", "nome", "tentativas", "acertos", "previstos"]
    cols += [f"{c}_recente" for c in cols[2:]]
    plain = H.tallies(H.binary_family(ctx), since=40).select(cols)
    assert sorted(map(tuple, H.binary_tallies(ctx, 40).select(cols).collect())) == sorted(map(tuple, plain.collect()))
    assert "posexplode" not in H.binary_tallies(ctx)._jdf.queryExecution().toString()

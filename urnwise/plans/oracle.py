"""DuckDB SQL that states the result of each registered query whose result is determined.

Every statement starts from the same common tables: `items` (mapped draws), `d` (a draw
with its list, place and the two draws before), `att` (attributes of all blocks) and
`ctx` (both).
"""

from __future__ import annotations

from itertools import combinations

from urnwise.functions.scalar import FIELDS
from urnwise.games import GAMES, PRIMES
from urnwise.operators import surrogates as U
from urnwise.operators.diagnostics import chi2_quantile
from urnwise.plans.queries import BASE, PLAYED, POOLS

_GAMES = ", ".join(f"('{g.key}', {g.block}, {g.k}, {g.m})" for g in GAMES.values())
COMMON = f"""
with games(game, block, k, m) as (values {_GAMES}),
raw as (select distinct game, k, l_orderkey // block as numero, cast(l_partkey % m + 1 as int) as dezena from lineitem, games),
ranked as (select *, count(*) over (partition by game, numero) as c, row_number() over (partition by game, numero order by (dezena * 37 + numero * 11) % 61, dezena) as r from raw),
items as (select game, numero, dezena, row_number() over (partition by game, numero order by dezena) - 1 as posicao from ranked where c >= k and r <= k),
lists as (select game, numero, list(dezena order by dezena) as dezenas from items group by all),
d as (select *, row_number() over w - 1 as idx, lag(dezenas) over w as prev, lag(dezenas, 2) over w as prev2 from lists window w as (partition by game order by numero)),
att0 as (select game, o_orderkey // block as numero, max(case when o_orderstatus = 'O' then 1 else 0 end) as acumulado, sum(round(o_totalprice)) as valor_arrecadado, 'City, ' || min(n_name) as local
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey, games group by all),
att as (select *, coalesce(lag(valor_arrecadado) over (partition by game order by numero), 0) as valor_estimado, cast(date '2000-01-01' + cast(3 * numero as int) as date) as data from att0),
ctx as (select d.*, acumulado, valor_arrecadado, local, valor_estimado, data, k, m from d join att using (game, numero) join games using (game)),
domain as (select game, unnest(range(1, m + 1)) as dezena from games),
tot as (select game, count(*) as t, max(numero) as top from d group by game)
"""
SQL: dict[str, str] = {}


def sql(name: str, body: str, longs: str = "", doubles: str = "", texts: str = "", more: str = "") -> None:
    """Register: columns cast as the query casts them; more: further common tables."""
    own = [*(f"cast({c} as bigint) as {c}" for c in longs.split()), *(f"round(cast({c} as double), 6) + 0.0::double as {c}" for c in doubles.split()), *texts.split()]
    SQL[name] = f"{COMMON}{', ' + more if more else ''}\nselect {', '.join(own)} from ({body})"


REC = "select game, dezena, coalesce(f, 0) as freq, top - coalesce(last, 0) as gap from domain left join (select game, dezena, count(*) as f, max(numero) as last from items group by all) using (game, dezena) join tot using (game)"
sql("item_frequency", REC, "dezena freq", "", "game")
sql("item_recency", REC, "dezena freq gap", "", "game")
sql("draw_log", "select game, numero, idx, strftime(data, '%Y-%m-%d') as data, local, acumulado, valor_arrecadado, valor_estimado, array_to_string(dezenas, ',') as dezenas, coalesce(array_to_string(prev, ','), '') as prev, coalesce(array_to_string(prev2, ','), '') as prev2 from ctx", "numero idx acumulado", "valor_arrecadado valor_estimado", "game data local dezenas prev prev2")
sql("order_drawn", "select game, numero, dezena, row_number() over (partition by game, numero order by line, dezena) as place from items join (select game, l_orderkey // block as numero, cast(l_partkey % m + 1 as int) as dezena, min(l_linenumber) as line from lineitem, games group by all) using (game, numero, dezena)", "numero dezena place", "", "game")
sql("high_water", "select coalesce(max(numero), 0) as numero from items where game = 'g6_60'", "numero")
sql("draw_count", "select game, t as draws from tot", "draws", "", "game")
sql("json_draws", "select game, numero, strftime(data, '%Y-%m-%d') as data, array_to_string(dezenas, ',') as dezenas, local, acumulado, 0.0 as valor_acumulado, valor_arrecadado, 0 as order_known from ctx where game = 'g6_60'", "numero acumulado order_known", "valor_acumulado valor_arrecadado", "game data dezenas local")
sql("insert_absent", "select game, numero, case when numero % 3 <> 0 then valor_arrecadado else -1 end as valor_arrecadado from att", "numero", "valor_arrecadado", "game")
sql(
    "late_correction",
    """select game, numero, case when fix then valor_estimado else old end as valor_acumulado, case when fix then fresh else valor_arrecadado end as valor_arrecadado from (
  select *, case when numero % 2 = 0 then 0 else valor_estimado end as old, case when numero % 4 = 0 then 0 else valor_arrecadado + 1 end as fresh,
  numero % 5 <> 0 and (case when numero % 2 = 0 then 0 else valor_estimado end) = 0 and (case when numero % 4 = 0 then 0 else valor_arrecadado + 1 end) > 0 as fix from att)""",
    "numero", "valor_acumulado valor_arrecadado", "game",
)
sql("schema_evolution", "select game, numero, case when numero % 2 = 1 then valor_arrecadado end as valor_arrecadado from att", "numero", "valor_arrecadado", "game")

PAIRS = "pairs as (select x.game, x.dezena as a, y.dezena as b, count(*) as obs from items x join items y on x.game = y.game and x.numero = y.numero and x.dezena < y.dezena group by all), fr as (select game, dezena, count(*) as f from items group by all), pt0 as (select p.*, p1.f * p2.f / t::double as expected, t from pairs p join fr p1 on p1.game = p.game and p1.dezena = a join fr p2 on p2.game = p.game and p2.dezena = b join tot on tot.game = p.game), pt as (select game, a, b, obs, expected, obs / expected as lift, (obs - expected) ** 2 / expected + case when t > expected then (obs - expected) ** 2 / (t - expected) else 0 end as chi2 from pt0)"
TOP_PAIRS = "select game, a, b, obs, row_number() over (partition by game order by obs desc, a, b) as rank from pairs qualify rank <= {}"
sql("top_pairs", TOP_PAIRS.format(20), "a b obs rank", "", "game", PAIRS)
sql("sum_stats", "select *, trunc(mean - std) as low, trunc(mean + std) as high from (select game, avg(s) as mean, median(s) as median, stddev_samp(s) as std from (select game, numero, sum(dezena) as s from items group by all) group by game)", "low high", "mean median std", "game")
sql("pair_lift", "select * from pt where expected >= 5", "a b obs", "expected lift chi2", "game", PAIRS)
sql("attracting_pairs", "select *, row_number() over (partition by game order by lift desc, a, b) as rank from pt where expected >= 5 and lift >= 1.05 and chi2 > 3.841458820694124 qualify rank <= 30", "a b obs rank", "lift chi2", "game", PAIRS)
sql("anti_pairs", "select *, row_number() over (partition by game order by lift, a, b) as rank from pt where expected >= 5 and lift <= 1 / 1.05 and chi2 > 3.841458820694124 qualify rank <= 30", "a b obs rank", "lift chi2", "game", PAIRS)
_BASE = ", ".join(f"('{g}', {n})" for g, ns in BASE.items() for n in ns)
sql(
    "cooc_bonus",
    "select game, dezena, sum(case when lift > 1.1 then (lift - 1) * 0.5 when lift < 0.9 then -(1 - lift) * 0.3 else 0 end) as bonus from sides where (game, x) in (select game, n from base) and (game, dezena) not in (select game, n from base) group by all having abs(bonus) > 0.01",
    "dezena", "bonus", "game", PAIRS + f", base(game, n) as (values {_BASE}), sides as (select game, a as x, b as dezena, lift from pt union all select game, b, a, lift from pt)",
)
_P = "(" + ", ".join(map(str, PRIMES)) + ")"
SHAPE = f"""shape as (select *, list_sum(dezenas) as soma, len(list_filter(dezenas, lambda x: x % 2 = 0)) as pares, len(list_filter(dezenas, lambda x: x % 2 = 1)) as impares, list_max(dezenas) - list_min(dezenas) as amplitude,
  len(list_filter(dezenas, lambda x: x in {_P})) as primos, len(list_filter(range(1, len(dezenas)), lambda i: dezenas[i + 1] - dezenas[i] = 1)) as consecutivos,
  len(list_filter(dezenas, lambda x: x <= m // 3)) as baixo, len(list_filter(dezenas, lambda x: x > m // 3 and x <= 2 * (m // 3))) as medio, len(list_filter(dezenas, lambda x: x > 2 * (m // 3))) as alto,
  list_min(dezenas) as menor, list_max(dezenas) as maior, list_avg(dezenas) as media, list_stddev_pop(dezenas) as desvio, coalesce(len(list_intersect(dezenas, prev)), 0) as repetidos from ctx)"""
sql("draw_features", "select * from shape", "numero idx soma pares impares amplitude primos consecutivos baixo medio alto menor maior repetidos", "media desvio", "game", SHAPE)
_FINAL = " ".join(f"final_{u}" for u in range(10))
sql("last_digit_hist", "select game, numero, " + ", ".join(f"count(*) filter (dezena % 10 = {u}) as final_{u}" for u in range(10)) + " from items group by all", f"numero {_FINAL}", "", "game")
_MOD = "((data - date '2000-01-06') % 29.53::double)"
MOON = f"(case when {_MOD} < 0 then ({_MOD} + 29.53::double) % 29.53::double else {_MOD} end)"
PHASE = f"case when {MOON} < 1.85 then 'nova' when {MOON} < 9.23 then 'crescente' when {MOON} < 16.61 then 'cheia' when {MOON} < 23.99 then 'minguante' else 'nova' end"
sql("calendar_parts", f"select game, numero, isodow(data) - 1 as dia_semana, day(data) as dia, month(data) as mes, year(data) as ano, weekofyear(data) as semana, coalesce(data - lag(data) over (partition by game order by numero), 0) as dias_desde, {PHASE} as fase, floor({MOON}) as lua, uf, dense_rank() over (partition by game order by uf) - 1 as uf_code from (select *, trim(split_part(local, ',', -1)) as uf from ctx)", "numero dia_semana dia mes ano semana dias_desde lua uf_code", "", "game fase uf")


def conditional(dim: str, top: str = "") -> str:
    return f"""select game, dim, dezena, coalesce(h, 0) / draws::double as rate, draws from (select game, {dim} as dim, count(*) as draws from ctx group by 1, 2 having count(*) >= 10 {top}) g join domain using (game)
  left join (select ctx.game, {dim} as dim, dezena, count(*) as h from ctx join items using (game, numero) group by all) h using (game, dim, dezena)"""


sql("weekday_freq", conditional("isodow(data) - 1"), "dim dezena draws", "rate", "game")
sql("month_freq", conditional("month(data)"), "dim dezena draws", "rate", "game")
sql("uf_freq", conditional("trim(split_part(local, ',', -1))", "qualify row_number() over (partition by game order by count(*) desc, dim) <= 10"), "dezena draws", "rate", "game dim")
sql(
    "deviations",
    f"""select game, kind, dim, dezena, rate, overall, rate - overall as diff, row_number() over (partition by game order by round(abs(rate - overall), 9) desc, kind, dim, dezena) as rank from (
  select game, 'month' as kind, cast(dim as varchar) as dim, dezena, rate from ({conditional('month(data)')}) union all select game, 'weekday', cast(dim as varchar), dezena, rate from ({conditional('isodow(data) - 1')}))
  join (select game, dezena, freq / t::double as overall from ({REC}) join tot using (game)) using (game, dezena) where abs(rate - overall) > 0.02 qualify rank <= 30""",
    "dezena rank", "rate overall diff", "game kind dim",
)
HITS = "hits as (select game, idx, numero, n, case when list_contains(dezenas, n) then 1 else 0 end as hit from (select game, idx, numero, dezenas, unnest(range(1, m + 1)) as n from ctx))"
_W = "(partition by game, n order by idx)"
sql(
    "number_series",
    "select *, freq5 - freq50 as trend from (select game, idx, numero, n, hit, " + ", ".join(f"coalesce(lag(hit, {k}) over {_W}, 0) as lag{k}" for k in (1, 2, 3, 5, 10)) + ", " + ", ".join(f"coalesce(avg(hit) over (partition by game, n order by idx rows between {k} preceding and 1 preceding), 0) as freq{k}" for k in (5, 10, 20, 50)) + f", idx - coalesce(max(case when hit = 1 then idx end) over {_W}, 0) as gap from hits)",
    "idx numero n hit lag1 lag2 lag3 lag5 lag10 gap", "freq5 freq10 freq20 freq50 trend", "game", HITS,
)
sql("rolling_share", "select game, idx, numero, n, sum(hit) over (partition by game, n order by idx rows between 30 preceding and 1 preceding) / 30.0::double as share from hits qualify idx >= 30", "idx numero n", "share", "game", HITS)
_L = "over (partition by game order by idx"
sql(
    "profile_lags",
    f"select game, numero, idx, lag(soma, 1) {_L}) as soma_lag1, lag(soma, 2) {_L}) as soma_lag2, lag(soma, 3) {_L}) as soma_lag3, avg(soma) {_L} rows between 5 preceding and 1 preceding) as soma_ma5, avg(soma) {_L} rows between 10 preceding and 1 preceding) as soma_ma10, lag(amplitude, 1) {_L}) as amplitude_lag1, avg(pares) {_L} rows between 5 preceding and 1 preceding) as pares_ma5, avg(primos) {_L} rows between 10 preceding and 1 preceding) as primos_ma10, lag(consecutivos, 2) {_L}) as consecutivos_lag2, lag(repetidos, 3) {_L}) as repetidos_lag3, avg(repetidos) {_L} rows between 5 preceding and 1 preceding) as repetidos_ma5 from shape qualify idx >= 3",
    "numero soma_lag1 soma_lag2 soma_lag3 amplitude_lag1 consecutivos_lag2 repetidos_lag3", "soma_ma5 soma_ma10 pares_ma5 primos_ma10 repetidos_ma5", "game", SHAPE,
)
LAST = "(select d.game, numero, unnest(dezenas) as dezena from d join tot using (game) where idx >= t - {})"
sql("bias50", f"select game, dezena, freq, (freq - e) / e as bias from (select game, dezena, coalesce(f, 0) as freq, 50 * k / m::double as e from domain join games using (game) left join (select game, dezena, count(*) as f from {LAST.format(50)} group by all) using (game, dezena)) where abs((freq - e) / e) > 0.3", "dezena freq", "bias", "game")
_POOL = " ".join(["case game", *(f"when '{g}' then {n}" for g, n in POOLS.items()), "end"])
POOL = f"pool as (select game, dezena, coalesce(f, 0) as freq, row_number() over (partition by game order by coalesce(f, 0) desc, dezena) as rank from domain left join (select game, dezena, count(*) as f from {LAST.format(30)} group by all) using (game, dezena) qualify rank <= {_POOL})"
sql("hot_pool", "select * from pool", "dezena freq rank", "", "game", POOL)

# -- hypotheses: fields, operations and sets as SQL expressions over ctx
INV = "cast(reverse(case when length(cast({0} as varchar)) < 2 then lpad(cast({0} as varchar), 2, '0') else cast({0} as varchar) end) as bigint)"
FIELD = {
    "dia": "day(data)", "mes": "month(data)", "ano2d": "year(data) % 100", "dia_ano": "dayofyear(data)", "semana": "weekofyear(data)", "conc": "numero", "conc100": "numero % 100",
    "soma_prev": "list_sum(prev)", "amp_prev": "list_max(prev) - list_min(prev)", "max_prev": "list_max(prev)", "min_prev": "list_min(prev)", "media_prev": "round_even(list_avg(prev), 0)", "pares_prev": "len(list_filter(prev, lambda x: x % 2 = 0))",
    "rep_count": "len(list_intersect(prev, prev2))", "lua": f"floor({MOON})", "premio_mag": "case when valor_estimado > 0 then trunc(log10(case when valor_estimado > 0 then valor_estimado end)) else 0 end",
}
UNARY = {
    "id": "v", "mod10": "v % 10", "mod7": "v % 7", "inv": INV.format("v"), "dsum": "cast(list_sum([cast(c as int) for c in string_split(cast(v as varchar), '')]) as bigint)",
    "sqrt": "case when v > 0 then floor(sqrt(v)) else 0 end", "log2": "case when v > 0 then length(bin(v)) - 1 else 0 end", "x2": "v * 2", "half": "v // 2",
}
BINARY = {"add": "a + b", "sub": "abs(a - b)", "mul": "a * b", "xor": "xor(a, b)", "mod": "case when b <> 0 then a % b else 0 end"}
WRAP = "case when ({0}) % m = 0 then m else ({0}) % m end"
FIELDS_SQL = "fields as (select game, numero, idx, dezenas, m, k, " + ", ".join(f"cast(coalesce({FIELD[f]}, 0) as bigint) as {f}" for f in FIELDS) + " from ctx), long as (unpivot fields on " + ", ".join(FIELDS) + " into name f value v)"
UN = FIELDS_SQL + ", preds as (" + " union all ".join(f"select game, numero, idx, dezenas, m, k, f || '.{op}' as nome, [{WRAP.format(f'cast({e} as bigint)')}] as pred from long" for op, e in UNARY.items()) + ")"
_ORDER = "case f " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(FIELDS)) + " end"
BIN = FIELDS_SQL + f", lo as (select *, {_ORDER} as i from long), two as (select x.game, x.numero, x.idx, x.dezenas, x.m, x.k, x.f || '+' || y.f as f, x.v as a, y.v as b from lo x join lo y on x.game = y.game and x.numero = y.numero and x.i < y.i), preds as (" + " union all ".join(f"select game, numero, idx, dezenas, m, k, f || '.{op}' as nome, [{WRAP.format(f'cast({e} as bigint)')}] as pred from two" for op, e in BINARY.items()) + ")"
STEPS = "[{} for i in range(1, len(prev))]"
SET = {
    "prev": "prev", "prev_viz": "list_filter(list_concat([x - 1 for x in prev], [x + 1 for x in prev]), lambda x: x >= 1 and x <= m and not list_contains(prev, x))",
    "prev_esp": f"list_filter([{INV.format('x')} for x in prev], lambda x: x >= 1 and x <= m)", "prev_comp": "[m + 1 - x for x in prev]",
    "prev_gaps": STEPS.format("prev[i + 1] - prev[i]"), "prev_xor": "list_filter(" + STEPS.format("xor(prev[i], prev[i + 1])") + ", lambda x: x >= 1 and x <= m)",
    "prev_soma2": STEPS.format("case when (prev[i] + prev[i + 1]) % m = 0 then m else (prev[i] + prev[i + 1]) % m end"),
    "ausentes2": "case when prev2 is not null then list_filter(range(1, m + 1), lambda x: not list_contains(prev, x) and not list_contains(prev2, x)) end", "prev2": "prev2",
}
SETS = "preds as (" + " union all ".join(f"select game, numero, idx, dezenas, m, k, 'set.{s}' as nome, list_distinct(coalesce(cast({e} as bigint[]), [])) as pred from ctx" for s, e in SET.items()) + ")"
HALF = {"baixos": "range(1, m // 2 + 1)", "altos": "range(m // 2 + 1, m + 1)", "pares": "range(2, m + 1, 2)", "impares": "range(1, m + 1, 2)"}
WINDOWS = "preds as (" + " union all ".join(f"select game, numero, idx, dezenas, m, k, 'window.soma_{t}→{h}' as nome, case when prev is not null and list_sum(prev) {c} m * 7.5 then {HALF[h]} else [] end as pred from ctx" for t, c in (("alta", ">"), ("baixa", "<=")) for h in ("baixos", "altos")) + ")"
_ONE = lambda e: f"[{WRAP.format(f'cast({e} as bigint)')}]"
_DSUM, _INV = (lambda v: UNARY["dsum"].replace("v as varchar", f"{v} as varchar")), INV.format
_S = {k: f"list_distinct(coalesce(cast({e} as bigint[]), []))" for k, e in SET.items()}
EVOLVED = {
    "dia.inv>dsum": _ONE(_DSUM("(" + _INV("dia") + ")")),
    "conc.mod10>x2>sqrt": _ONE("floor(sqrt(conc % 10 * 2))"),
    "set.prev@dia.add": f"list_distinct([{WRAP.format('x + dia')} for x in {_S['prev']}])",
    "set.prev_viz@soma_prev.xor": f"list_distinct([{WRAP.format('xor(x, soma_prev)')} for x in {_S['prev_viz']}])",
    "window.max_prev_alto→pares": "case when max_prev > m // 2 then range(2, m + 1, 2) else [] end",
    "setop.prev_union_prev2": f"list_distinct(list_concat({_S['prev']}, {_S['prev2']}))",
    "setop.ausentes2_diff_prev_comp": f"list_filter({_S['ausentes2']}, lambda x: not list_contains({_S['prev_comp']}, x))",
    "nest.(diaaddmes)mulconc100": _ONE("(dia + mes) * conc100"),
    "nest.(soma_prevmodamp_prev)xorlua": _ONE("xor(case when amp_prev <> 0 then soma_prev % amp_prev else 0 end, lua)"),
}
EVO = FIELDS_SQL + ", mixed as (select f.*, c.prev, c.prev2 from fields f join ctx c using (game, numero)), preds as (" + " union all ".join(f"select game, numero, idx, dezenas, m, k, '{n}' as nome, cast({e} as bigint[]) as pred from mixed" for n, e in EVOLVED.items()) + ")"
TALLY = "tally as (select game, nome, any_value(k) as k, any_value(m) as m, count(*) as tentativas, count(*) filter (list_has_any(pred, dezenas::bigint[])) as acertos, sum(len(pred)) as previstos from preds where idx > 0 and len(pred) > 0 group by game, nome)"


def tests(tally: str, out: str) -> str:
    return f"""{out} as (select game, nome, tentativas, acertos, previstos, acertos / tentativas::double as taxa_obs, e as taxa_esp, acertos / tentativas::double / e as lift,
  (acertos - tentativas * e) ** 2 / (tentativas * e) + (acertos - tentativas * e) ** 2 / (tentativas * (1 - e)) as chi2 from (
  select *, case when c <= 0 or c >= 1 then k / m::double else c end as e from (select *, 1 - ((m - k) / m::double) ** (previstos / tentativas::double) as c from {tally} where tentativas >= 30)) where tentativas * e >= 5 and tentativas * (1 - e) >= 5)"""


TEST = tests("tally", "test")
_T = ("tentativas acertos previstos", "taxa_obs taxa_esp lift chi2", "game nome")
sql("hyp_unary", "select * from test", *_T, f"{UN}, {TALLY}, {TEST}")
sql("hyp_binary", "select * from test", *_T, f"{BIN}, {TALLY}, {TEST}")
sql("hyp_sets", "select * from tally", _T[0], "", _T[2], f"{SETS}, {TALLY}")
sql("hyp_window", "select * from tally", _T[0], "", _T[2], f"{WINDOWS}, {TALLY}")
sql("hyp_evolved", "select * from tally", _T[0], "", _T[2], f"{EVO}, {TALLY}")
sql("hyp_top", "select game, nome, chi2, row_number() over (partition by game order by round(chi2, 6) desc, nome) as rank from test qualify rank <= 10", "rank", "chi2", "game nome", f"{UN}, {TALLY}, {TEST}")
_RECENT = "rp as (select preds.*, idx - greatest(0, t - {0}) as ridx from preds join tot using (game) where idx >= t - {0}), rtally as (select game, nome, any_value(k) as k, any_value(m) as m, count(*) as tentativas, count(*) filter (list_has_any(pred, dezenas::bigint[])) as acertos, sum(len(pred)) as previstos from rp where ridx > 0 and len(pred) > 0 group by game, nome)".format(500)
RECENT = f"{_RECENT}, {tests('rtally', 'rtest')}"
sql("recent_test", "select * from rtest", *_T, f"{UN}, {RECENT}")
EXACT = "select game, nome, e as taxa_esp, acertos / tentativas::double / e as lift, (acertos - tentativas * e) ** 2 / (tentativas * e) + (acertos - tentativas * e) ** 2 / (tentativas * (1 - e)) as chi2 from (select *, case when c <= 0 or c >= 1 then k / m::double else c end as e from (select *, 1 - list_product([greatest(0, m - cast(round(previstos / tentativas::double) as bigint) - i) / (m - i)::double for i in range(0, k)]) as c from tally where tentativas >= 30)) where tentativas * e >= 5 and tentativas * (1 - e) >= 5"
sql("hyp_exact", EXACT, "", "taxa_esp lift chi2", "game nome", f"{SETS}, {TALLY}")

_AS = lambda text, name: text.replace("preds as (", f"{name} as (", 1)
EVERY = f"{_AS(UN, 'pu')}{_AS(BIN[len(FIELDS_SQL) :], 'pb')}, {_AS(SETS, 'ps')}, {_AS(WINDOWS, 'pw')}, preds as (select * from pu union all select * from pb union all select * from ps union all select * from pw)"
#: Upper tail of chi-square with one degree of freedom: one less the regularised lower gamma function of 1/2, as a series of positive terms.
P = "case when chi2 <= 0 then 1.0::double when chi2 > 600 then 0.0 else greatest(0, 1 - list_sum([exp(-chi2 / 2 + (i + 0.5) * ln(chi2 / 2) - lgamma(i + 1.5)) for i in range(0, 400)])) end"
sql("hyp_p_values", f"select *, {P} as p_valor from test", _T[0], _T[1] + " p_valor", _T[2], f"{UN}, {TALLY}, {TEST}")

# -- the hand-written predictors
_IN_M = lambda *v: f"list_distinct(list_filter([{', '.join(f'cast({x} as bigint)' for x in v)}], lambda x: x is not null and x >= 1 and x <= m))"
_REV = lambda v: f"nullif({INV.format('(' + v + ')')}, 0)"
_DIGITS = lambda t: f"[cast(c as bigint) for c in string_split({t}, '')]"
_PAIRS_OF = lambda t: f"[cast(substr({t}, i, 2) as bigint) for i in range(1, length({t}))]"
_OF_M = lambda e: f"list_distinct(list_filter({e}, lambda x: x >= 1 and x <= m))"


def _money(c: str) -> str:
    t = f"cast(cast(trunc({c}) as bigint) as varchar)"
    return f"case when {c} > 0 then {_OF_M(f'list_concat({_DIGITS(t)}, {_PAIRS_OF(t)})')} else [] end"


def _const(of) -> str:
    return "case game " + " ".join(f"when '{g.key}' then {sorted(of(g.m))}" for g in GAMES.values()) + " end"


_DAY, _MONTH, _NUM = "day(data)", "month(data)", "cast(numero as varchar)"
_SMALL = f"{_DAY} < 10 and {_MONTH} < 10"
_SQUARES = _const(lambda m: [i * i for i in range(1, m) if i * i <= m])
_GOLD = (1 + 5**0.5) / 2
BY_HAND = {
    "dia_invertido": _IN_M(_REV(_DAY)), "mes_invertido": _IN_M(_REV(_MONTH)), "dia_mes_combo": _IN_M(_DAY, _MONTH, _REV(_DAY), _REV(_MONTH)),
    "soma_digitos_data": _IN_M(f"list_sum({_DIGITS(chr(115) + 'trftime(data, ' + repr('%d%m%Y') + ')')})"), "diff_dia_mes": _IN_M(f"abs({_DAY} - {_MONTH})"), "produto_dia_mes": _IN_M(f"{_DAY} * {_MONTH}"),
    "dia_mes_aritmetica": _IN_M(f"{_DAY} + {_MONTH}", f"abs({_DAY} - {_MONTH})", f"case when {_SMALL} then {_DAY} * 10 + {_MONTH} end", f"case when {_SMALL} then {_MONTH} * 10 + {_DAY} end"),
    "digitos_concurso": _OF_M(_DIGITS(_NUM)), "concurso_mod": _ONE("numero"), "soma_digitos_concurso": _IN_M(f"list_sum({_DIGITS(_NUM)})"), "pares_digitos_concurso": _OF_M(_PAIRS_OF(_NUM)),
    "dia_do_ano_mod": _ONE("dayofyear(data)"), "semana_do_ano": _ONE("weekofyear(data)"), "fase_lua": _IN_M(f"floor({MOON}) + 1"), "lua_metade": f"case when {PHASE} in ('nova', 'cheia') then {HALF['baixos']} else {HALF['altos']} end",
    "digitos_acumulado": _money("valor_estimado"), "digitos_estimado": _money("valor_estimado"), "digitos_arrecadado": _money("valor_arrecadado"),
    "magnitude_premio": f"case when valor_estimado > 0 then {_IN_M('trunc(log10(case when valor_estimado > 0 then valor_estimado end))')} else [] end",
    "repeticoes_anterior": _S["prev"], "complemento": _S["prev_comp"], "vizinhos_anterior": _S["prev_viz"], "espelho_anterior": _S["prev_esp"], "soma_pares_consecutivos": _S["prev_soma2"], "gaps_anterior": _S["prev_gaps"],
    "media_anterior": _IN_M("round_even(list_avg(prev), 0)"), "mediana_anterior": _IN_M("prev[len(prev) // 2 + 1]"), "dobro_max_anterior": _ONE("list_max(prev) * 2"),
    "fibonacci": _const(lambda m: [x for x in (1, 2, 3, 5, 8, 13, 21, 34, 55) if x <= m]), "golden_ratio": _const(lambda m: {round(m * i / _GOLD) % m or m for i in range(1, 10)}),
    "primos": _const(lambda m: [p for p in PRIMES if p <= m]), "quadrados_perfeitos": _SQUARES, "multiplos_7": _const(lambda m: range(7, m + 1, 7)),
    "vizinhos_primeira_bola": _IN_M("ordem[1] - 1", "ordem[1] + 1"), "quadrados_apos_quadrados": f"case when len(list_intersect(prev, {_SQUARES})) >= 2 then {_SQUARES} else [] end",
    "soma_anterior_mod": _ONE("list_sum(prev)"), "xor_anterior": _S["prev_xor"], "centesimos_concurso": _IN_M("numero % 100", _REV("numero % 100")), "amplitude_anterior": _IN_M("list_max(prev) - list_min(prev)"),
    "ausentes_2_pares": f"list_filter({_S['ausentes2']}, lambda x: x % 2 = 0)",
}
ORDERED = "od as (select game, numero, list(dezena order by line, dezena) as ordem from items join (select game, l_orderkey // block as numero, cast(l_partkey % m + 1 as int) as dezena, min(l_linenumber) as line from lineitem, games group by all) using (game, numero, dezena) group by all), cto as (select * from ctx join od using (game, numero) where idx > 0)"
HAND = ORDERED + ", preds as (" + " union all ".join(f"select game, numero, idx, dezenas, m, k, '{n}' as nome, cast({e} as bigint[]) as pred from cto" for n, e in BY_HAND.items()) + ")"
sql("hyp_handwritten", "select * from tally", _T[0], "", _T[2], f"{HAND}, {TALLY}")
_PAST = "over (partition by game, nome order by idx rows between unbounded preceding and 1 preceding)"
WALK = f"""{HAND}, past as (select *, coalesce(sum(case when len(pred) > 0 then 1 else 0 end) {_PAST}, 0) as tentativas, coalesce(sum(case when list_has_any(pred, dezenas::bigint[]) then 1 else 0 end) {_PAST}, 0) as acertos, coalesce(sum(len(pred)) {_PAST}, 0) as previstos from preds),
goal as (select past.* from past join tot using (game) where idx >= t - 50 and idx >= 30), wtally as (select game, nome || '@' || idx as nome, k, m, tentativas, acertos, previstos from goal), {tests('wtally', 'wtest')},
weight as (select game, split_part(nome, '@', 1) as nome, cast(split_part(nome, '@', 2) as bigint) as idx, (1 - p) * abs(lift - 1) * case when lift > 1 then 1 else -0.5 end as w from (select *, {P} as p from wtest) where p < 0.15),
voted as (select game, idx, dezena, sum(w) as s from (select game, nome, idx, unnest(pred) as dezena from goal) join weight using (game, nome, idx) group by all),
ranks as (select g.game, g.idx, numero, dezenas, dezena, k, m, row_number() over (partition by g.game, g.idx order by round(coalesce(s, 0), 9) desc, dezena) as rank from (select distinct game, idx, numero, dezenas, k, m from goal) g join domain using (game) left join voted using (game, idx, dezena))"""
sql("walk_forward", "select game, numero, count(*) filter (list_contains(dezenas, dezena)) as hits, any_value(k * k / m::double) as baseline from ranks where rank <= k group by game, numero", "numero hits", "baseline", "game", WALK)

BANK = f"""{EVERY}, {TALLY}, {TEST}, {RECENT},
bank as (select game, nome, p_valor, lift, taxa_obs, pr as p_valor_recente, lr as lift_recente, greatest(0, 1 - p_valor / 0.05) * 0.25 + greatest(0, 1 - pr / 0.1) * 0.35 + least(abs(lift - 1), 0.5) * 2 * 0.15 + least(abs(lr - 1), 0.5) * 2 * 0.25 as score_confianca, length(nome) % 3 as third
  from (select t.game, t.nome, exp(-t.chi2 / 2) as p_valor, t.lift, t.taxa_obs, coalesce(exp(-r.chi2 / 2), 1) as pr, coalesce(r.lift, 1) as lr from test t left join rtest r using (game, nome))),
merged as (select game, nome, p_valor, p_valor_recente, case when third = 1 then score_confianca / 2 else score_confianca end as score_confianca, third = 0 or third = 1 or score_confianca > 0.1 as ativo from bank),
pruned as (select *, ativo and not (score_confianca < 0.05 or (p_valor_recente > 0.3 and p_valor > 0.03)) as ok from merged)"""
sql("bank_score", "select * from bank", "", "p_valor p_valor_recente lift_recente score_confianca", "game nome", BANK)
sql("bank_merge", "select game, nome, score_confianca, ativo from merged", "ativo", "score_confianca", "game nome", BANK)
sql("bank_prune", "select game, nome, ok as ativo from pruned", "ativo", "", "game nome", BANK)
sql("bank_stats", "select game, count(*) as total, count(*) filter (ok) as ativos, min(p_valor) filter (ok) as melhor_p, max(score_confianca) filter (ok) as melhor_score from pruned group by game", "total ativos", "melhor_p melhor_score", "game", BANK)
sql("bank_active", "select game, nome, row_number() over (partition by game order by score_confianca desc, nome) as rank from pruned where ok qualify rank <= 5", "rank", "", "game nome", BANK)
sql("bank_invalidate", "select game, nome, lift >= 1 as ativo from bank", "ativo", "", "game nome", BANK)
sql("bank_untested", "select game, nome from bank where not lift > 1", "", "", "game nome", BANK)

# -- scores
PAIRED = f"paired as (select distinct game, unnest([a, b]) as dezena from ({TOP_PAIRS.format(30)})), rec as ({REC})"
WEIGHT = "select game, dezena, raw / sum(raw) over (partition by game) as weight from (select game, rec.dezena, freq / t::double * 0.5 + least(gap / 20.0::double, 1) * 0.35 + case when p.dezena is not null then 0.1 else 0 end + 0.05 as raw from rec join tot using (game) left join paired p using (game, dezena))"
sql("basic_weights", WEIGHT, "dezena", "weight", "game", f"{PAIRS}, {PAIRED}")
FG = f"select game, dezena, freq / t::double * 0.3 + least(gap / 15.0::double, 0.5) * 0.2 as score from ({REC}) join tot using (game)"
sql("frequency_gap", FG, "dezena", "score", "game")
NEXT = "nx as (select game, numero + 1 as numero, idx + 1 as idx, []::int[] as dezenas, dezenas as prev, prev as prev2, cast(data + 3 as date) as data, local, acumulado, 0.0::double as valor_arrecadado, valor_estimado, k, m from ctx join tot using (game) where idx = t - 1)"
sql("next_row", "select game, numero, idx, strftime(data, '%Y-%m-%d') as data, local, acumulado, valor_arrecadado, valor_estimado, '' as dezenas, array_to_string(prev, ',') as prev, array_to_string(prev2, ',') as prev2 from nx", "numero idx acumulado", "valor_arrecadado valor_estimado", "game data local dezenas prev prev2", NEXT)
NSETS = SETS.replace("from ctx", "from nx").replace("preds as (", "npreds as (", 1)
_NEVO = EVO.replace("from ctx", "from nx").replace("join ctx c", "join nx c").replace(", preds as (", ", epreds as (", 1)
sql("next_predictions", "select game, numero, nome, array_to_string(list_sort(pred), ',') as pred from (select * from npreds union all select * from epreds)", "numero", "", "game nome pred", f"{NEXT}, {NSETS}, {_NEVO}")
META = "select preds.game, nome, case when count(*) filter (len(pred) > 0) = 0 then 0.5 else count(*) filter (len(pred) > 0 and list_has_any(pred, dezenas::bigint[])) / count(*) filter (len(pred) > 0)::double end as meta from preds join tot using (game) where idx >= t - 10 group by all"
BOTH = SETS.replace("preds as (", "p1 as (", 1) + ", " + WINDOWS.replace("preds as (", "p2 as (", 1) + ", preds as (select * from p1 union all select * from p2)"
sql("meta_weights", META, "", "meta", "game nome", BOTH)
CROSS = f"select domain.game, dezena, bonus from domain join (select dezena, sum(bonus) as bonus from (select dezena, 0.02::double as bonus from {LAST.format(3)} where game = 'g15_25' union all select 61 - dezena, 0.01 from {LAST.format(3)} where game = 'g6_60') group by all) using (dezena)"
sql("cross_bonus", CROSS, "dezena", "bonus", "game")
SBANK = f"{SETS}, {TALLY}, {TEST}, meta as ({META}), {NEXT}, {NSETS}, parts as (select game, nome, unnest(pred) as dezena from npreds)"
_BONUS = "(1 - exp(-chi2 / 2)) * abs(lift - 1) * {} * case when lift > 1 then 1 else -0.5 end"
FUSED = f"fused as (select game, dezena, sum(score) as score from (select game, dezena, {_BONUS.format('(0.5 + coalesce(meta, 0.5))')} as score from parts join test using (game, nome) left join meta using (game, nome) union all select * from ({CROSS}) union all select * from ({FG})) group by all), ranking as (select *, row_number() over (partition by game order by round(score, 9) desc, dezena) as rank from fused)"
sql("score_fusion", "select * from ranking", "dezena rank", "score", "game", f"{SBANK}, {FUSED}")
sql("score_explained", f"select game, dezena, sum(b) as score, count(*) as patterns, string_agg(nome, ',' order by nome) as names from (select game, dezena, nome, {_BONUS.format('1')} as b from parts join test using (game, nome)) group by all", "dezena patterns", "score", "game names", SBANK)
sql("suggested_ticket", "select game, string_agg(dezena, ',' order by dezena) as nums from ranking join games using (game) where rank <= k group by game", "", "", "game nums", f"{SBANK}, {FUSED}")
PROFILE = f"{SHAPE}, profile as (select shape.game, avg(soma) as soma_media, stddev_pop(soma) as soma_std, avg(pares) as pares_media, avg(amplitude) as amplitude_media, stddev_pop(amplitude) as amplitude_std from shape join tot using (game) where idx >= t - 50 group by shape.game)"
sql("recent_profile", "select * from profile", "", "soma_media soma_std pares_media amplitude_media amplitude_std", "game", PROFILE)
sql("profile_fit", "select game, numero as ticket, greatest(0, 1 - least(abs(soma - soma_media) / greatest(soma_std, 1) * 0.15, 0.4) - abs(pares - pares_media) * 0.05 - least(abs(amplitude - amplitude_media) / greatest(amplitude_std, 1) * 0.1, 0.3)) as fit from shape join profile using (game)", "ticket", "fit", "game", PROFILE)
sql(
    "ticket_scores",
    "select game, numero as ticket, greatest(0, least(1, (1 - abs(s - mean) / std) * 0.3 + f * 0.3 + p * 0.2 + g * 0.2)) as score from (select game, numero, avg(freq / t::double) as f, avg(gap / 20.0::double) as g, avg(case when q.dezena is not null then 1 else 0 end) as p, sum(items.dezena) as s from items join rec using (game, dezena) join tot using (game) left join paired q using (game, dezena) group by all) join (select game, avg(s) as mean, stddev_samp(s) as std from (select game, numero, sum(dezena) as s from items group by all) group by game) using (game)",
    "ticket", "score", "game", f"{PAIRS}, {PAIRED}",
)
_LAST50 = f"(select game, dezena, count(*) as f from {LAST.format(50)} group by all)"
sql("integrated_scores", f"select game, dezena, score * 0.5 + coalesce(f, 0) / 50.0::double * 0.3 + greatest(0, case when abs((coalesce(f, 0) - 50 * k / m::double) / (50 * k / m::double)) > 0.3 then (coalesce(f, 0) - 50 * k / m::double) / (50 * k / m::double) else 0 end) * 0.2 as score from ({FG}) left join {_LAST50} using (game, dezena) join games using (game)", "dezena", "score", "game")

# -- tickets: every draw
RUNS = "isl as (select game, numero, dezena - row_number() over (partition by game, numero order by dezena) as g from items), runs as (select game, numero, g, count(*) as len from isl group by all), seq as (select game, numero, max(len) as run, sum(case when len >= 4 then len else 0 end) as long from runs group by all), pen as (select game, numero, run, long * 0.05::double + case when len(list_distinct([dezenas[i + 1] - dezenas[i] for i in range(1, len(dezenas))])) = 1 then 0.5 else 0 end as penalty from seq join d using (game, numero))"
_BANDS = "case game " + " ".join(f"when '{g.key}' then [" + ", ".join(f"len(list_filter(dezenas, lambda x: x between {a} and {b}))" for a, b in g.bands) + "]" for g in GAMES.values()) + " end"
_IN = lambda name, v: "case game " + " ".join(f"when '{g.key}' then {v} between {g.profile[name][2]} and {g.profile[name][3]}" for g in GAMES.values()) + " end"
_ALL = "case game " + " ".join(f"when '{g.key}' then list_min(faixas) >= {g.profile['band'][2]} and list_max(faixas) <= {g.profile['band'][3]}" for g in GAMES.values()) + " end"
CHECKS = f"{SHAPE}, {RUNS}, ev0 as (select game, numero as ticket, soma, impares, run as max_seq, repetidos, prev, {_BANDS} as faixas from shape join pen using (game, numero)), ev as (select *, cast({_IN('sum', 'soma')} as int) + cast({_IN('odd', 'impares')} as int) + cast({_IN('max_run', 'max_seq')} as int) + cast({_ALL} as int) as four, cast({_IN('repeats', 'repetidos')} as int) as rep from ev0)"
sql("filter_ticket", "select game, ticket, soma, impares, max_seq, repetidos, array_to_string(faixas, ',') as faixas, (four + rep) / 5.0::double as score, four + rep = 5 as passou from ev where prev is not null", "ticket soma impares max_seq repetidos passou", "score", "game faixas", CHECKS)
sql("valid_tickets", "select game, ticket from ev where four = 4", "ticket", "", "game", CHECKS)
_POP = "least(1, case when x <= 31 then 0.3::double else 0 end + case when x <= 12 then 0.2::double else 0 end + case when x % 10 = 0 then 0.15::double else 0 end + case when x % 5 = 0 then 0.1::double else 0 end + (1 - abs(x - m / 2.0::double) / (m / 2.0::double)) * 0.1::double + case when x >= 10 and x // 10 = x % 10 then 0.15::double else 0 end)"
sql("unpopularity", f"select *, row_number() over (partition by game order by round(impopularidade, 9) desc, dezenas, ticket) as rank from (select game, dezenas, numero as ticket, greatest(0, least(1, (1 - list_avg([{_POP} for x in dezenas])) - penalty + least(abs(list_sum(dezenas) - k * (m + 1) / 2.0::double) / (k * (m + 1) / 2.0::double) * 0.3, 0.15))) as impopularidade from ctx join pen using (game, numero))", "ticket rank", "impopularidade", "game", RUNS)
sql("sequence_penalty", "select game, numero as ticket, run, penalty from pen", "ticket run", "penalty", "game", RUNS)
sql("best_of_equal", "select game, max(numero) as ticket, nums from (select game, numero, array_to_string(dezenas[1:3], ',') as nums from d) group by game, nums", "ticket", "", "game nums")


def subsets(k: int) -> str:
    tables = ", ".join(f"p p{i}" for i in range(k))
    rising = " and ".join(f"p{i}.dezena < p{i + 1}.dezena" for i in range(k - 1))
    return f"select [{', '.join(f'p{i}.dezena' for i in range(k))}] as nums from {tables} where {rising}"


_PG = f"{POOL}, p as (select dezena from pool where game = 'g6_60'), c6 as ({subsets(6)}), c5 as ({subsets(5)})"
sql("combos_pool", "select 'g6_60' as game, array_to_string(nums, ',') as nums from c6", "", "", "game nums", _PG)
sql("wheel_simulation", "select game, numero, (select count(*) from c6 where list_sum(nums) % 10 = 0) as tickets, (select max(len(list_intersect(nums, dezenas))) from c6 where list_sum(nums) % 10 = 0) as best, (select count(*) from p where list_contains(dezenas, p.dezena)) as pool_hits from d where game = 'g6_60'", "numero tickets best pool_hits", "", "game", _PG)
sql("coverage", "select 'g6_60' as game, count(*) as targets, count(*) filter (hit) as covered, count(*) filter (hit) / count(*)::double as share from (select c5.nums, coalesce(max(len(list_intersect(c5.nums, c6.nums))), 0) >= 4 as hit from c5 left join c6 on list_sum(c6.nums) % 10 = 0 group by c5.nums)", "targets covered", "share", "game", _PG)
_PLAYED = ", ".join(f"('{g}', {i}, {n})" for g, ts in PLAYED.items() for i, n in enumerate(ts))
_PRIZE = "case " + " ".join(f"when game = '{g.key}' and hits = {h} then {p}" for g in GAMES.values() for h, p in g.prizes.items()) + " else 0 end"
_FROM = "case game " + " ".join(f"when '{g.key}' then {g.check_from}" for g in GAMES.values()) + " end"
_COST = "case game " + " ".join(f"when '{g.key}' then {g.ticket}" for g in GAMES.values()) + " end"
CHECKED = f"played(game, ticket, nums) as (values {_PLAYED}), checked as (select *, {_PRIZE} as prize, hits >= {_FROM} as won from (select game, ticket, numero, idx, len(list_intersect(nums, dezenas)) as hits from played join d using (game)))"
sql("bet_check", "select * from checked", "ticket numero hits won", "prize", "game", CHECKED)
sql("hit_distribution", "select game, hits, count(*) as draws from checked group by all", "hits draws", "", "game", CHECKED)
sql("best_bet", "select game, numero, min(ticket) as ticket, any_value(hits) as hits, any_value(prize) as prize from (select *, max(hits) over (partition by game, numero) as most from checked) where hits = most group by game, numero", "numero ticket hits", "prize", "game", CHECKED)
sql(
    "roi_summary",
    f"select *, won - cost as profit, (won / cost - 1) * 100 as roi_pct from (select game, branch, count(distinct numero) as draws, count(*) as tickets, avg(hits) as mean_hits, max(hits) as best, count(*) filter (prize > 0) as prizes, sum(prize)::double as won, sum({_COST})::double as cost from (select checked.game, 'played' as branch, numero, hits, prize from checked join tot using (game) where idx >= t - 20 union all select game, 'previous', numero, hits, {_PRIZE} from (select d.game, numero, len(list_intersect(prev, dezenas)) as hits from d join tot using (game) where idx >= t - 20)) group by all)",
    "draws tickets best prizes", "mean_hits won cost profit roi_pct", "game branch", CHECKED,
)
sql("prefix_scores", "select game, numero, n as dezena, f / idx::double * 0.6 + least((idx - 1 - coalesce(seen, -1)) / 20.0::double, 0.5) * 0.4 as score from (select hits.*, t, sum(hit) over w as f, max(case when hit = 1 then idx end) over w as seen from hits join tot using (game) window w as (partition by hits.game, n order by idx rows between unbounded preceding and 1 preceding)) where idx >= t - 20", "numero dezena", "score", "game", HITS)
RETRO = f"""{HITS}, rk0 as (select hits.*, t, sum(hit) over w as f, max(case when hit = 1 then numero end) over w as seen from hits join tot using (game) window w as (partition by hits.game, n order by idx rows between unbounded preceding and 1 preceding)),
former as (select game, idx, lag(numero) over (partition by game order by idx) as top from d),
rk as (select game, idx, n as dezena, row_number() over (partition by game, idx order by round(f / idx::double * 0.3 + least((top - coalesce(seen, 0)) / 15.0::double, 0.5) * 0.2, 9) desc, n) as rank from rk0 join former using (game, idx) where idx >= t - 10 and idx > 0),
tops as (select distinct game, unnest([k, 10, 15, 20]) as top, k, m from games),
retro as (select d.game, d.numero, tops.top, count(*) filter (rank <= tops.top and list_contains(dezenas, dezena)) as hits, any_value(tops.top * (k / m::double)) as expected from d join rk using (game, idx) join tops on tops.game = d.game group by all)"""
sql("retro", "select * from retro", "numero top hits", "expected", "game", RETRO)
sql("retro_verdict", "select *, case when mean > expected * 1.1 then 'above chance' when mean < expected * 0.9 then 'below chance' else 'at the level of chance' end as verdict from (select game, top, avg(hits) as mean, avg(expected) as expected from retro group by all)", "top", "mean expected", "game verdict", RETRO)

# -- diagnostics
sql(
    "perm_entropy",
    "select game, -sum(p * log2(p)) / log2(6) as entropy from (select game, count(*) / sum(count(*)) over (partition by game)::double as p from (select game, (b < a)::int + (c < a)::int as ra, (a <= b)::int + (c < b)::int as rb from (select game, dezena as a, lead(dezena, 1) over w as b, lead(dezena, 2) over w as c from items window w as (partition by game order by numero, posicao)) where c is not null) group by game, ra, rb) group by game",
    "", "entropy", "game",
)
CHANGE = f"{HITS}, ch as (select game, idx, sum((l - e) ** 2 / e + (r - e) ** 2 / e) as chi2 from (select *, case when l + r = 0 then 1e-10 else (l + r) / 2.0::double end as e from (select hits.*, t, sum(hit) over (partition by hits.game, n order by idx rows between 50 preceding and 1 preceding) as l, sum(hit) over (partition by hits.game, n order by idx rows between current row and 49 following) as r from hits join tot using (game)) where idx >= 50 and idx < t - 50) group by all)"
sql("changepoint_series", "select * from ch", "idx", "chi2", "game", CHANGE)
_LIMIT = "case game " + " ".join(f"when '{g.key}' then {chi2_quantile(0.9, g.m - 1)!r}" for g in GAMES.values()) + " end"
_LIMIT99 = "case game " + " ".join(f"when '{g.key}' then {chi2_quantile(0.99, g.m - 1)!r}" for g in GAMES.values()) + " end"
sql("changepoints", f"select game, arg_max(idx, chi2) as position, max(chi2) as chi2 from (select game, idx, chi2, idx - row_number() over (partition by game order by idx) as g from ch where chi2 > {_LIMIT}) group by game, g", "position", "chi2", "game", CHANGE)
CODES = f"""{HITS}, co as (select game, n, idx - 30 as i, c from (select game, n, idx, sum(hit) over (partition by game, n order by idx rows between 30 preceding and 1 preceding) as c from hits) where idx >= 30),
st as (select *, lead(c, 1) over v as x, lead(c, 2) over v as y, lead(c, 3) over v as z3, lead(c, 4) over v as z4, lag(c) over v as b, count(*) over (partition by game, n) as points from co window v as (partition by game, n order by i)),
mo as (select game, n, count(*) as points, stddev_pop(c) * 0.2 < 1 as fine from co group by all)"""
_PAIR = lambda cols, cond, name: f"{name} as (select game, n, sum(k * (k - 1) // 2) as {name} from (select game, n, count(*) as k from st where {cond} group by game, n, {cols}) group by all)"
sql("sample_entropy", "select game, n, case when fine and m2 > 0 and m3 > 0 then -ln(m3 / m2::double) end as sample_entropy from m2 join m3 using (game, n) join mo using (game, n)", "n", "sample_entropy", "game", f"{CODES}, {_PAIR('c, x', 'i + 2 < points', 'm2')}, {_PAIR('c, x, y', 'i + 3 < points', 'm3')}")
# points of vertical lines: for each point, the others with its three values that have such a one beside them (itself left out)
RECUR = f"""{CODES}, {_PAIR('c, x, y', 'y is not null', 'n3')}, {_PAIR('c, x, y, z3', 'z3 is not null', 'n4')}, {_PAIR('c, x, y, z3, z4', 'z4 is not null', 'n5')},
em as (select game, n, i, c, x, y, (b = c and c = x and x = y) as up, (c = x and x = y and y = z3) as down from st where y is not null),
cls as (select game, n, c, x, y, count(*) as k, count(*) filter (coalesce(up, false) or coalesce(down, false)) as lined from em group by all),
near as (select a.game, a.n, a.i, o.i as j, (coalesce(o.up, false) and o.i - 1 <> a.i) or (coalesce(o.down, false) and o.i + 1 <> a.i) as ok from em a join em o on a.game = o.game and a.n = o.n and a.c = o.c and a.x = o.x and a.y = o.y and o.i between a.i - 1 and a.i + 1),
fix as (select game, n, i, sum(case when j = i then 0 else ok::int end) as beside, sum((up_or_down)::int) as was from (select near.*, (select coalesce(e.up, false) or coalesce(e.down, false) from em e where e.game = near.game and e.n = near.n and e.i = near.j) as up_or_down from near) group by all),
ver as (select game, n, sum(lined - was + beside) as vertical from em join cls using (game, n, c, x, y) join fix using (game, n, i) group by all),
pe as (select game, n, -sum(p * log2(p)) / log2(6) as entropy from (select game, n, count(*) / sum(count(*)) over (partition by game, n)::double as p from em group by game, n, (c <= x), (x <= y), (c <= y)) group by all)"""
sql("recurrence", "select game, n, points, entropy, case when fine then case when n3 > 0 then 2.0::double * n3 / ((points - 2.0::double) * (points - 3)) else 0 end end as RR, case when fine then case when n3 > 0 then (2 * coalesce(n4, 0) - coalesce(n5, 0)) / n3::double else 0 end end as DET, case when fine then case when n3 > 0 then vertical / (2.0::double * n3) else 0 end end as LAM from mo join n3 using (game, n) join n4 using (game, n) join n5 using (game, n) join ver using (game, n) join pe using (game, n)", "n points", "entropy RR DET LAM", "game", RECUR)
# repeats, one value longer in each step, of the places that still have an equal one
LINES = f"""{CODES}, rep as (select game, n, i, hash(c) as h, 1 as len from co qualify count(*) over (partition by game, n, c) > 1
  union all select r.game, r.n, r.i, hash(r.h, co.c), r.len + 1 from rep r join co on co.game = r.game and co.n = r.n and co.i = r.i + r.len qualify count(*) over (partition by r.game, r.n, r.h, co.c) > 1),
prs as (select game, n, len, sum(k * (k - 1) // 2)::bigint as pairs from (select game, n, len, h, count(*) as k from rep group by all) group by all),
lns as (select game, n, l - 2 as len, sum(s * pairs) as k from (select game, n, pairs, unnest([len, len - 1, len - 2]) as l, unnest([1, -2, 1]) as s from prs) group by all having l >= 4 and k > 0)"""
sql("line_entropy", "select game, n, sum(k) as lines, max(longest) as longest, -sum(k / total * log2(k / total)) as ENTR from (select *, sum(k) over (partition by game, n)::double as total from lns) join (select game, n, max(len) - 2 as longest from prs group by all) using (game, n) join mo using (game, n) where fine group by all", "n lines longest", "ENTR", "game", LINES)
SQL["line_entropy"] = SQL["line_entropy"].replace("\nwith ", "\nwith recursive ", 1)


def _turn(name: str, after: str, seed: int) -> str:
    """Common tables of one pass of the places p of `after` through the network; the last is `name`."""
    out, last = [f"{name}_s as (select *, p // b as l, p % b as r from {after})"], f"{name}_s"
    for k in range(U.ROUNDS):
        side, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        a, b, c = U.SPREAD
        t = f"((copy * {a} + {k * b + seed * c}) % {U.PRIME})"
        out.append(f"{name}_k{k} as (select *, ({t} * {t} + {U.TIMES}) % {U.PRIME} as k from {last})")
        out.append(f"{name}_u{k} as (select *, ({other} * {U.TIMES} + k) % {U.PRIME} as u from {name}_k{k})")
        out.append(f"{name}_v{k} as (select *, (u * u + k) % {U.PRIME} as v from {name}_u{k})")
        out.append(f"{name}_{k} as (select * exclude (k, u, v) replace (({side} + (v * v + u) % {U.PRIME}) % {size} as {side}) from {name}_v{k})")
        last = f"{name}_{k}"
    walked = "l * b + r" if after == "q0" else "case when p >= size then l * b + r else p end"
    return ",\n".join([*out, f"{name} as (select * exclude (l, r) replace ({walked} as p) from {last})"])


def copies(n: int, seed: int) -> str:
    """Common tables up to `ms`, the measures of every series and its n copies."""
    w = {"c": "cs", "x": "lead(cs) over v", "y": "lead(cs, 2) over v", "z3": "lead(cs, 3) over v", "z4": "lead(cs, 4) over v", "b": "lag(cs) over v"}
    pairs = lambda name, cols, some: f"{name} as (select game, n, copy, sum(k * (k - 1) // 2)::bigint as {name} from (select game, n, copy, count(*) as k from un where {some} group by game, n, copy, {cols}) group by all)"
    return f"""{CODES}, cl as (select game, i, list(c::utinyint order by n) as cs from co group by all),
hv as (select game, size, a, (size + a - 1) // a as b from (select game, size, unnest(range(greatest(1, root // 4), root + 1)) as a from (select game, count(*) as size, greatest(1, floor(sqrt(count(*)))::bigint) as root from cl group by game))
  qualify row_number() over (partition by game order by (a - size % a) % a, a desc) = 1),
q0 as (select game, size, a, b, i, copy, i as p from hv join cl using (game), range({n + 1}) t(copy)),
{_turn('q1', 'q0', seed)},
{_turn('q2', 'q1', seed)},
{_turn('q3', 'q2', seed)},
pc as (select game, copy, case when copy = 0 then i else p end as p, cs from q3 join cl using (game, i)),
wi as (select game, copy, {', '.join(f'{x} as {k}' for k, x in w.items())} from pc window v as (partition by game, copy order by p)),
un as (select game, copy, unnest(range(1, len(c) + 1)) as n, {', '.join(f'unnest({k}) as {k}' for k in w)} from wi),
ce as (select game, n, copy, c, x, y, count(*) as k, count(*) filter (coalesce(b = c and c = x and x = y, false) or coalesce(c = x and x = y and y = z3, false)) as lined, count(*) filter (coalesce(c = x and x = y and y = z3, false) and not coalesce(b = c and c = x and x = y, false)) as starts
  from un where y is not null group by all),
n3 as (select game, n, copy, sum(k * (k - 1) // 2)::bigint as n3, (sum(k * lined) - sum(lined) - 2 * sum(starts))::bigint as vertical from ce group by all),
{pairs('n4', 'c, x, y, z3', 'z3 is not null')}, {pairs('n5', 'c, x, y, z3, z4', 'z4 is not null')},
pe as (select game, n, copy, -sum(p * log2(p)) / log2(6) as pe from (select game, n, copy, sum(k) / sum(sum(k)) over (partition by game, n, copy)::double as p from ce group by game, n, copy, (c <= x), (x <= y), (c <= y)) group by all),
ms as (select game, n, copy, pe, case when fine then case when n3 > 0 then (2 * coalesce(n4, 0) - coalesce(n5, 0)) / n3::double else 0 end end as det, case when fine then case when n3 > 0 then vertical / (2.0::double * n3) else 0 end end as lam
  from n3 join pe using (game, n, copy) left join n4 using (game, n, copy) left join n5 using (game, n, copy) join mo using (game, n))"""


sql(
    "surrogates",
    """select game, n, measure, any_value(v) filter (copy = 0) as real, quantile_cont(v, 0.025) filter (copy > 0) as low, quantile_cont(v, 0.975) filter (copy > 0) as high, real < low or real > high as outside
  from (select game, n, copy, unnest(['PE', 'DET', 'LAM']) as measure, unnest([pe, det, lam]) as v from ms) group by game, n, measure""",
    "n", "real low high", "game measure outside", copies(100, 7),
)
_Z = "select game, n, any_value(pe) filter (copy = 0) as pe, avg(pe) filter (copy > 0) as pe_mean, stddev_pop(pe) filter (copy > 0) as pe_std from ms group by all"
sql("entropy_z", f"select *, case when pe_std > 0 then (pe - pe_mean) / pe_std else 0 end as z, abs(z) > 1.96 as significant from ({_Z})", "n", "pe pe_mean pe_std z", "game significant", copies(30, 11))
# a point whose values recur farther away than 5 places has a neighbour at distance 0; of the others each has the nearest class of points, at its first or last place
NEIGHBOURS = f"""{CODES}, pt as (select game, n, i, c, x, y from st where y is not null),
sz as (select game, n, count(*) as size, least(count(*) // 4, 50) as steps from pt group by all),
kl as (select game, n, c, x, y, min(i) as first, max(i) as last from pt group by all),
ra as (select pt.*, size, steps from pt join kl using (game, n, c, x, y) join sz using (game, n) where i - first <= 5 and last - i <= 5 and i < size - steps and size >= 20),
nb as (select game, n, i, size, steps, min(struct_pack(d := d, j := j)).j as j from (
  select ra.game, ra.n, ra.i, size, steps, (ra.c - kl.c) ** 2 + (ra.x - kl.x) ** 2 + (ra.y - kl.y) ** 2 as d, case when abs(ra.i - first) > 5 then first when abs(ra.i - last) > 5 then last end as j
  from ra join kl on ra.game = kl.game and ra.n = kl.n) where d > 0 and j is not null group by all),
wk as (select game, n, k, i + k as a, j + k as b from (select game, n, i, j, unnest(range(0, least(steps, size - greatest(i, j)))) as k from nb)),
dv as (select wk.game, wk.n, k, avg(ln((p.c - q.c) ** 2 + (p.x - q.x) ** 2 + (p.y - q.y) ** 2) / 2) as m from wk join pt p on p.game = wk.game and p.n = wk.n and p.i = a join pt q on q.game = wk.game and q.n = wk.n and q.i = b
  where (p.c - q.c) ** 2 + (p.x - q.x) ** 2 + (p.y - q.y) ** 2 > 0 group by all),
sl as (select game, n, case when count(*) >= 5 then regr_slope(m, k) end as slope from (select * from dv qualify row_number() over (partition by game, n order by k) <= 20) group by all)"""
sql("divergence", "select game, n, coalesce(slope, 0) as lyapunov from sz left join sl using (game, n)", "n", "lyapunov", "game", NEIGHBOURS)
sql("_z30", f"select *, case when pe_std > 0 then (pe - pe_mean) / pe_std else 0 end as z, abs(z) > 1.96 as significant from ({_Z.replace('from ms', 'from ms where copy <= 30')})", "n", "pe pe_mean pe_std z", "game significant", copies(100, 7))
sql("_changes", "select game, count(*) as changepoints from (select game, idx, idx - row_number() over (partition by game order by idx) as g from ch where chi2 > " + _LIMIT99 + ") group by game, g", "changepoints", "", "game", CHANGE)
_HELD = "case when significant then 'entropy' end, case when outside then 'surrogate' end, case when DET > 0.05 then 'determinism' end, case when changepoints > 0 then 'changepoints' end, case when lyapunov > 0.01 then 'chaos' end"
SQL["diagnostic_report"] = f"""select game, n, points, RR, DET, LAM, sample_entropy, lyapunov, outside, pe, z, significant, coalesce(changepoints, 0) as changepoints, array_to_string(list_filter([{_HELD}], lambda x: x is not null), ',') as signals,
  case when signals = '' then 'compatible with chance' else 'structure' end as verdict
from ({SQL['recurrence']}) join ({SQL['sample_entropy']}) using (game, n) join ({SQL['divergence']}) using (game, n) join ({SQL.pop('_z30')}) using (game, n)
join (select game, n, coalesce(bool_or(outside), false) as outside from ({SQL['surrogates']}) group by all) using (game, n) left join (select game, count(*)::bigint as changepoints from ({SQL.pop('_changes')}) group by game) using (game)"""
sql(
    "ml_refit_sum",
    """select game, numero, n, greatest(0, least(1, coalesce(my - (case when vx > 1e-12 then cxy / vx else 0 end) * mx + (case when vx > 1e-12 then cxy / vx else 0 end) * x, my))) as score from (
  select *, avg(x) over w as mx, avg(y) over w as my, var_pop(x) over w as vx, covar_pop(x, y) over w as cxy, max(idx) over (partition by game) as top from (
    select a.game, b.numero, b.idx, n, list_sum(a.dezenas)::double as x, list_contains(b.dezenas, n)::int::double as y from d a join d b on a.game = b.game and b.idx = a.idx + 1 join (select game, dezena as n from domain) dm on dm.game = a.game)
  window w as (partition by game, n order by idx rows between unbounded preceding and 1 preceding)) where idx >= greatest(top - 49, floor(top * 0.6))""",
    "numero n", "score", "game",
)
SQL["event_windows"] = "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all"
_N25 = [f"n{i:02d}" for i in range(1, 26)]
sql("one_hot", "select game, numero, " + ", ".join(f"max(case when n = {i} then hit end) as n{i:02d}" for i in range(1, 26)) + " from hits where game = 'g15_25' group by all", " ".join(["numero", *_N25]), "", "game", HITS)
_CATS = {n: c for names, c in ((BY_HAND, None), ([f"{f}.{op}" for f in FIELDS for op in UNARY], "prog"), ([f"{a}+{b}.{op}" for a, b in combinations(FIELDS, 2) for op in BINARY], "prog"), ([f"set.{x}" for x in SET], "prog"), ([f"window.soma_{t}→{h}" for t in ("alta", "baixa") for h in ("baixos", "altos")], "prog"), (EVOLVED, "evo"), (["dia.id", "dia.mod10", "dia.mod7", "set.prev"], "evo")) for n in names}
_CATS |= {n: c for c, names in {"data": "dia_invertido mes_invertido dia_mes_combo soma_digitos_data diff_dia_mes produto_dia_mes dia_mes_aritmetica", "concurso": "digitos_concurso concurso_mod soma_digitos_concurso pares_digitos_concurso centesimos_concurso", "temporal": "dia_do_ano_mod semana_do_ano fase_lua lua_metade", "financeiro": "digitos_acumulado digitos_estimado digitos_arrecadado magnitude_premio", "inter-sorteio": "repeticoes_anterior complemento vizinhos_anterior espelho_anterior soma_pares_consecutivos gaps_anterior media_anterior mediana_anterior dobro_max_anterior", "matemática": "fibonacci golden_ratio primos quadrados_perfeitos multiplos_7", "ordem": "vizinhos_primeira_bola", "2a-ordem": "quadrados_apos_quadrados soma_anterior_mod xor_anterior amplitude_anterior ausentes_2_pares"}.items() for n in names.split()}
_HAND = " ".join(f"when '{n}' then '{_CATS[n]}'" for n in BY_HAND)
_FROM = lambda name, cat, where="true": f"select game, nome, {cat} as cat, tentativas, acertos, previstos from ({SQL[name]}) where {where}"
SQL["family_union"] = " union all ".join([_FROM("hyp_handwritten", f"case nome {_HAND} end"), _FROM("hyp_sets", "case when nome = 'set.prev' then 'evo' else 'prog' end"), _FROM("hyp_window", "'prog'"), _FROM("hyp_evolved", "'evo'", "nome <> 'set.prev'")])

"""Conversation and decontamination operators against brute force, and on odd input."""

import hashlib
import itertools
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from urnwise.llm import decontamination, order, prefix_trie, turn_repair
from urnwise.llm import queries as Q

CONV = "conv_id long, turn long, role string, text string"
ODD_TURNS = [
    (0, 0, "user", "Hi."), (0, 0, "user", "Hi."), (0, None, None, None), (0, 2, "system", ""), (100, 0, "user", "Hi."), (100, 1, "assistant", "Well"), (101, 5, "user", "Hi."), (101, 7, "assistant", "x" * 50_000),
    (250, 0, "", ""), (250, 1, "a", "b"), (251, 0, "user", " \t"), (999, -3, "assistant", "Yes!"), (999, 4, "assistant", "Yes!"), (999, 4, "assistant", "No?"), (None, 1, "user", "Lost."), (7, None, "user", "日本語。"),
]


@pytest.fixture(scope="module")
def odd_turns(spark):
    return spark.createDataFrame([(*r, "en", 1.0, 2) for r in ODD_TURNS], CONV + ", name string, c double, _part int")


def same_as_sql(df, sql, **views):
    con = duckdb.connect()
    for name, view in views.items():
        con.register(name, view.toArrow())
    cols = sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, con.sql(sql).project(", ".join(cols)).fetchall()))


# -- places and names


def test_placed_over_many_ranges(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 37 % 100).alias("at"), "id")
    got = order.placed(rows, ["at"], "pos").collect()
    assert len(got) == 4000
    for k in {r["k"] for r in got}:
        own = sorted((r["pos"], r["at"]) for r in got if r["k"] == k)
        assert [p for p, _ in own] == list(range(len(own))) and [a for _, a in own] == sorted(a for _, a in own)
    assert order.placed(rows.limit(0), ["at"], "pos").count() == 0


def test_names_are_dense(spark):
    a, after = order.named(spark.range(1000).repartition(7).withColumnRenamed("id", "x"), 5)
    assert after == 1005 and sorted(r["name"] for r in a.collect()) == list(range(5, 1005)) and a.distinct().count() == 1000
    assert order.named(spark.range(0), 9)[1] == 9


# -- 11


def brute_trie(members):
    """members: {conversation: list of turns}."""
    nodes = {}
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, cs in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = sorted(c for c in cs if len(members[c]) == len(p))
        out.append(
            (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in under), sum(map(leaf, under)), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=repr)


def in_order(rows):
    """{conv_id: [(role, text)]} by turn, nulls first, then digest."""
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_trie_against_brute_force(spark, odd_turns):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c, text in enumerate(["ab", "abc", "ab", "abcdefghi", "", "xy", "abcdefgh", "abcdezz", "x"], 96) for i, t in enumerate(text)]
    many = [(c, i, "user", "same" if i < 20 + c % 3 else f"t{c % 5}") for c in range(200, 240) for i in range(23 + c % 2)]
    for part in (rows, many, ODD_TURNS):
        df = odd_turns if part is ODD_TURNS else spark.createDataFrame(part, CONV)
        own = in_order(part)
        assert trie_rows(prefix_trie.prefix_trie(df)) == brute_trie(own)
        again = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df)))
        assert trie_rows(again) == brute_trie(rebuild(own))


def test_trie_of_one_long_conversation_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    long = spark.range(3000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    copies = spark.range(-20, 30).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")).where("conv_id <> 5")
    got = {r["depth"]: r for r in prefix_trie.prefix_trie(long.unionByName(copies)).collect()}
    assert len(got) == 3001 and got[0]["n_convs"] == got[1]["n_convs"] == 50 and got[0]["saved_tokens"] == 49 and got[1]["saved_tokens"] == 49 and got[2]["saved_tokens"] == 0
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(c) for c in range(-20, 30) if c != 5).encode()).hexdigest()
    assert got[3000]["n_children"] == 0 and {r["n_leaves"] for r in got.values()} == {1}


def test_trie_of_nothing(spark, odd_turns):
    assert prefix_trie.prefix_trie(odd_turns.limit(0)).count() == 0
    lost = prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame([(c, 0, "user", "a") for c in (104, 107)], CONV)))
    got = trie_rows(prefix_trie.trie(*lost))
    assert got == brute_trie(rebuild({104: [("user", "a")], 107: [("user", "a")]}))


def test_trie_same_as_sql(spark, sf):
    views = {"conversations": spark.read.parquet(f"{sf}/conversations.parquet")}
    same_as_sql(Q.QUERIES["op11_prefix_trie"](spark, sf), Q.ORACLE_SQL["op11_prefix_trie"], **views)


# -- 12


def brute_edits(initials, faults):
    """The cheapest edits of a short conversation, by trying every string of edits over an automaton."""
    best = None
    for choice in itertools.product("DKR", repeat=len(initials)):
        for gaps in itertools.product(range(3), repeat=len(initials) + 1):
            roles, cost, edits, options = [], 0, "", True
            for i in range(len(initials) + 1):
                for _ in range(gaps[i]):
                    roles.append("?")
                    cost, edits = cost + 3, edits + "I"
                if i == len(initials):
                    break
                edits += choice[i]
                if choice[i] == "D":
                    cost += 4
                elif faults[i] in (1, 2):
                    options = False
                else:
                    roles.append(initials[i] if choice[i] == "K" else "?")
                    cost += 3 * (choice[i] == "R") + 3 * (faults[i] == 3)
            if not options:
                continue
            body = roles[1:] if roles and roles[0] == "s" else roles
            fits = len(body) % 2 == 0 and all(r in ("?", "ua"[j % 2]) for j, r in enumerate(body)) and (body or not roles)
            if fits and (best is None or (cost, edits) < best):
                best = (cost, edits)
    return best


def test_solve_against_brute_force():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product((0, 1, 3), repeat=n) if n < 3 else ((0, 0, 0), (3, 0, 0), (0, 3, 3), (0, 1, 0), (3, 3, 3)):
                wanted = brute_edits(initials, faults)
                cost, parts, _ = turn_repair.ended(turn_repair.follow({"": (0, [], [])}, turn_repair.solve(list(initials), list(faults), [""])))
                assert (cost, "".join(parts)) == wanted, (initials, faults)


def plain_report(rows):
    """op12's columns from rows (conv_id, turn, role, text), conversation by conversation."""
    out = {r[0]: [] for r in rows}
    for c, turn, role, text in rows:
        role, text = role or (" " if role is None else role), text if text is not None else " "
        act = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out[c] += [(turn, "user" if act == 4 else role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    result = {}
    for c, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        at = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, parts, _ = turn_repair.ended(turn_repair.follow({"": (0, [], [])}, turn_repair.solve(initials, faults, [""])))
        kept, last, i = [], "", 0
        for e in "".join(parts):
            role = {"u": "assistant"}.get(last, "user")
            if e == "K":
                role = own[i][1]
            if e != "D":
                kept.append(role + ":" + ("" if e == "I" else own[i][2]))
                last = role[:1]
            i += e != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        result[c] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, "".join(parts), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return result


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [2048, 2, 3])
def test_repair_against_plain_version(spark, sf, odd_turns, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    long = [(3, i, "user" if i % 7 else "system", f"text {i % 41}" + "." * (i % 3)) for i in range(150)]
    for df in (table, odd_turns, spark.createDataFrame(long, CONV)):
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        got = {r["conv_id"]: tuple(r[x] for x in REPORT) for r in turn_repair.report(turn_repair.damaged(df), df.select("conv_id")).collect()}
        assert got == plain_report(rows)


def test_repaired_turns_are_the_digest(spark, odd_turns):
    rows = turn_repair.turns(turn_repair.damaged(odd_turns))
    found = turn_repair.plans(rows)
    texts = {}
    for r in sorted(turn_repair.repaired(rows, found).collect(), key=lambda r: (r["block"], r["place"])):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in turn_repair.digests(rows, found).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(texts.get(r["c"], [])).encode()).hexdigest()


def test_repair_of_nothing(spark, odd_turns):
    none = odd_turns.limit(0)
    assert turn_repair.report(turn_repair.damaged(none), none).count() == 0
    got = turn_repair.report(none, odd_turns.select("conv_id").where("conv_id = 7")).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# -- 13

BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Alpha beta GAMMA"), (3, None), (4, "…?"), (12, "two three four five six seven eight nine ten eleven twelve"), (2, "delta"), (None, "omega omega"), (20, "alpha-beta-gamma")]
TEXTS = [
    (1, "zero One, two three four five six seven eight nine TEN! eleven twelve thirteen."), (2, "alpha beta gamma; beta alpha beta gamma delta"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "omega omega omega"),
    (6, "omega omega omega"), (None, "delta é delta"), (8, "ÀLPHA beta gamma ALPHA BETA\nGAMMA alpha_beta2gamma"), (9, "word " * 5000 + "delta"), (10, "one two three four five six seven eight nine ten eleven " * 30),
]


@pytest.fixture(scope="module")
def tests_and_texts(spark):
    bench = spark.createDataFrame([(*b, 1, "x") for b in BENCH], "item_id long, text string, n int, window string")
    return bench, spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "doc_id long, text string, k int, _spans string")


def test_contamination_same_as_sql(spark, sf, tests_and_texts):
    bench, docs = tests_and_texts
    same_as_sql(decontamination.contamination(docs, bench), decontamination.OP13_SQL, documents=docs, benchmark=bench)
    views = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")}
    same_as_sql(Q.QUERIES["op13_decontamination"](spark, sf), Q.ORACLE_SQL["op13_decontamination"], **views)


def test_contamination_without_broadcast(spark, tests_and_texts, monkeypatch):
    bench, docs = tests_and_texts
    wanted = sorted(map(repr, decontamination.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "small", lambda df, rows=0: df)
    assert sorted(map(repr, decontamination.contamination(docs, bench).collect())) == wanted


def test_contamination_of_nothing(tests_and_texts):
    bench, docs = tests_and_texts
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    rows = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r["contaminated"] or r["n_hit"] for r in rows)


def test_removals(tests_and_texts):
    bench, docs = tests_and_texts
    clean = decontamination.remove_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5]
    got = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, bench).collect()}
    assert got[1] == "zero thirteen." and got[2] == "; beta" .replace("; ", "; ") and got[3] == TEXTS[2][1] and got[4] is None and got[6] == "" and got[None] == " é" and got[9] == ("word " * 5000).rstrip() and got[10] == " "
    again = {r["doc_id"]: r["n_hit"] for r in decontamination.contamination(decontamination.remove_spans(docs, bench), bench).collect()}
    assert not any(again.values())

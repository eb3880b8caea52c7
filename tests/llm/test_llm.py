"""The corpus operators against brute force, and on odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from urnwise.llm import bpe, common, fertility, line_dedup, near_vectors, ngram_join, packing, quality, shards, token_counts, url_filter, words  # noqa: E402
from urnwise.llm import queries as Q  # noqa: E402

BYTE = "byte_bpe_50k.json"
ODD = ["", " ", "\n\n", "a", "<|endoftext|>", "x<|endoftext|> y", "aaaaaaaaaaaaaaa", "don't I'll 12 345", "日本語 ｔｅｘｔ 🙂", "\t\x0b\x0c\r \x85\xa0 \u2028 é", "word " * 3000, "z" * 20_000, "a\n\nb\na\n\r\nb"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, nulls, repeated rows and keys, and extra columns with clashing names."""
    rows = [(i, t, "en", "s", 1, "k", 2.0, "f", 3, 4) for i, t in enumerate(ODD)] + [(100, *[None] * 9), (None, "some words of a text here", "de", "s", 1, "k", 2.0, "f", 3, 4), (3, "a", "en", "s", 1, "k", 2.0, "f", 3, 4), (3, "another text under the same key", "en", "s", 1, "k", 2.0, "f", 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, _score double, _fertility string, _lines int, c0 int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# -- 1


def test_bpe_equals_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(BYTE))
    for df in (docs.select("doc_id", "text"), odd):
        rows = bpe.encode_decode(df, P.path(BYTE)).collect()
        texts = defaultdict(list)
        for r in df.collect():
            texts[r["doc_id"]].append(r["text"] or "")
        assert len(rows) == df.count()
        for r in rows:
            wanted = [(t.encode(x, add_special_tokens=False).ids, x) for x in texts[r["doc_id"]]]
            got = (np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"])
            assert any(got[0] == ids and got[1] == t.decode(ids, skip_special_tokens=False) for ids, _ in wanted)


def test_bpe_digest_and_pair(spark, sf, odd, none):
    one = {r["doc_id"]: r for r in Q.QUERIES["op1_bpe"](spark, sf).limit(5).collect()}
    ids = {r["doc_id"]: r for r in bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"), P.path(BYTE)).collect()}
    for k, r in one.items():
        packed = np.array(ids[k]["ids"], "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(packed).hexdigest() and r["n_tokens"] == len(ids[k]["ids"])
    back = bpe.decode(bpe.encode(odd, P.path(BYTE)), P.path(BYTE))
    assert Counter(r["text"] for r in back.collect()) == Counter(t or "" for (t,) in odd.select("text").collect())
    assert bpe.encode_decode(none, P.path(BYTE)).count() == 0


# -- 2


def brute_links(rows, t=0.93):
    ok = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if v and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = Counter(), {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x, lab) in enumerate(ok):
        for j, y, lab2 in ok[:a]:
            if lab == lab2 and len(x) == len(y) and x @ y >= t:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (links[i], root(i)) for i, _, _ in rows}


@pytest.mark.parametrize("block", [8, 2048])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    v = [(i, (centers[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0.5)).tolist(), int(i % 12 < 7)) for i in range(150)]
    v += [(200 + i, v[0][1], v[0][2]) for i in range(20)]  # equal vectors
    v += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [1.0, None] + [0.0] * 6, 1), (304, v[0][1], None), (305, [1.0, 0.0], 1), (306, [1.0, 0.0], 1), (307, [], 1), (308, [float("inf")] * 8, 1), (309, (np.array(v[0][1]) * 1e-30).tolist(), v[0][2])]
    df = spark.createDataFrame([(*x, "s", 1) for x in v], "vec_id long, embedding array<double>, label int, rep string, w int")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, block=block).collect()}
    want = brute_links(v)
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.01, 0.12, 0.2])
def test_near_vectors_with_tight_groups(spark, spread):
    """Large groups of near copies, some of them near each other, beside loose vectors: cores, whole links and rings."""
    rng = np.random.default_rng(int(spread * 100))
    a = rng.normal(size=6)
    b = a / np.linalg.norm(a) + rng.normal(size=6) * 0.1
    rows = []
    for c, many in ((a, 90), (b * 3, 60), (rng.normal(size=6), 50)):
        c = c / np.linalg.norm(c)
        rows += [(c * rng.uniform(0.5, 2) + rng.normal(size=6) * spread * rng.choice([0.3, 1, 2])).tolist() for _ in range(many)]
    rows += rng.normal(size=(60, 6)).tolist() + [rows[0]] * 5 + [rows[100]] * 4
    v = [(i, x, int(i % 50 == 7)) for i, x in enumerate(rows)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df, block=16).collect()}
    assert got == brute_links(v)


def test_near_vectors_on_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df, 0.5, block=64).collect()}
    assert got == brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()], 0.5)


# -- 3


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op3_quality"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_odd_input(spark, docs, odd, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(odd, model)
    assert rows.count() == odd.count() and rows.where("_score_ is null or _score_ < 0 or _score_ > 1").count() == 0
    assert quality.filter_documents(odd, labels).columns == odd.columns
    assert quality.score(none, model).count() == 0
    strange = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert quality.train(docs, strange).score(*quality.encode(pa.array(["a"])))[0] == 0.5
    assert quality.train(none, labels).score(*quality.encode(pa.array(["a"])))[0] == 0.5
    scores = lambda df: {r["doc_id"]: round(r["_score"], 5) for r in quality.score(df, model).collect()}
    assert scores(docs) == scores(docs.repartition(3))


# -- 4


def brute_join(rows, t=0.8, n=5):
    sets = {}
    for i, x in rows:
        w = (x or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    links, up = Counter(), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    own = sorted(sets)
    of = defaultdict(list)
    for i in own:
        for s in sets[i]:
            of[s].append(i)
    common_ = Counter((a, b) for ids in of.values() for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), c in common_.items():
        if c >= t * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {i: (root(i), links[i]) for i in own}


@pytest.mark.parametrize("chunk", [4, 256])
def test_join_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 120))) for _ in range(40)]
    rows = list(enumerate(texts))
    for i in range(60):  # near copies of a few texts, many of one
        w = texts[0 if i % 2 else i % 7].split()
        for j in rng.integers(0, len(w), int(rng.integers(0, 5))):
            w[j] = "edit"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "  "), (203, texts[1].upper() + " "), (204, "one two"), (205, "one  TWO")]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, c string, n int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(df).collect()}
    assert got == brute_join(rows)
    stay = {r["doc_id"] for r in ngram_join.one_of_each(df).collect()}
    assert stay == {c for c, _ in got.values()}


def test_join_odd_input(odd, none, docs):
    rows = ngram_join.ngram_join(odd)
    assert rows.count() == odd.count() and rows.where("doc_id is null").head()["class_id"] is None
    assert ngram_join.ngram_join(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_forest_depth():
    assert ngram_join.shortened() == 4 and ngram_join.shortened(0.95) == 8 and ngram_join.shortened(0.1) == 1
    assert ngram_join.met(0.8, 4) >= ngram_join.RECALL > ngram_join.met(0.8, 5)


def test_join_of_pairs_of_tight_groups(spark):
    """Twenty pairs of tight groups, all linked, whose base texts share no whole label string: no link is lost."""
    rows, found, seed = [], 0, 0
    while found < 20:
        seed += 1
        rng = np.random.default_rng(seed)
        base = [f"s{seed}w{x}" for x in rng.integers(0, 10**6, 600)]
        other = base[:544] + [f"s{seed}v{x}" for x in rng.integers(0, 10**6, 56)]
        sets = ngram_join.window_sets(pa.array([" ".join(base), " ".join(other)]))
        a, b = ngram_join.signatures(sets, ngram_join.TREES * ngram_join.DEPTH).reshape(2, ngram_join.TREES, ngram_join.DEPTH)
        if (a == b).all(axis=1).any():
            continue
        rows += [(1000 * found + 100 * g + i, " ".join([*text, f"s{seed}x{g}y{i}"])) for g, text in enumerate((base, other)) for i in range(12)]
        found += 1
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i // 1000 * 1000, 23) for i, _ in rows}


@pytest.mark.parametrize("chunk", [8, 256])
def test_join_of_a_tight_group_and_looser_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(150):
        w = list(base)
        w[int(rng.integers(0, 400))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    for i in range(6):
        w = list(base)
        for j in range(0, 40 + i * 20, 20):
            w[j] = f"other{i}"
        rows.append((1000 + i, " ".join(w)))
    want = brute_join(rows)
    assert len({c for c, _ in want.values()}) < 8 and max(n for _, n in want.values()) > 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(df).collect()} == want


# -- 5


def test_lines_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000 + i, f"unique start {'y' * i} of its own kind\nReport from node alpha{i} at port {i} says that all is well today again\nshared line\n\nshared line\nend {'x' * i}") for i in range(5)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    masked = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    leaf, weight = defaultdict(set), defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            if w := masked(line):
                leaf[len(w), w[:3]].add(w)
                weight[w].add(i)
    template = {}
    for lines in leaf.values():  # clusters by pairwise agreement with the leader; leaders of equal weight are told apart by hash, so only sure cases are compared
        for w in lines:
            alike = [x for x in lines if sum(a == b for a, b in zip(w, x, strict=True)) >= 0.8 * len(w)]
            template[w] = alike
    for i, t in rows:
        lines = [masked(x) for x in t.split("\n")]
        left = [masked(x) for x in got[i]["text"].split("\n")]
        assert got[i]["_lines"] == sum(map(bool, lines)) and got[i]["_dropped"] == sum(map(bool, lines)) - sum(map(bool, left))
        for w in filter(None, lines):
            alone = len(template[w]) == 1
            if alone and len(weight[w]) < 3:
                assert w in left
            if alone and len(weight[w]) >= 3:
                assert (w in left) == (i == min(weight[w])) and left.count(w) <= 1
    assert all(got[1000 + i]["_dropped"] == 3 for i in range(1, 5)) and got[1000]["_dropped"] == 1
    assert got[1001]["text"] == "unique start y of its own kind\n\nend x"


@pytest.mark.parametrize("limit", [0, 10**6])
def test_lines_both_ways(spark, docs, odd, none, monkeypatch, limit):
    for m in (line_dedup, common):
        monkeypatch.setattr(m, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    rows = line_dedup.dedup_lines(docs)
    total = rows.agg(F.sum("_lines"), F.sum("_dropped"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).head()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 10**6)
    other = line_dedup.dedup_lines(docs).agg(F.sum("_lines"), F.sum("_dropped"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).head()
    assert limit == 0 or tuple(total) == tuple(other)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    out = line_dedup.dedup_lines(odd, min_docs=1)
    assert out.count() == odd.count() and out.where("text is null").count() == 1
    assert line_dedup.dedup_lines(none).count() == 0


def brute_templates(rows, min_docs=3):
    """{doc: (lines, dropped)} by the operator's rules, line by line; rows: (doc, text)."""
    parsed = []
    for i, t in rows:
        p = line_dedup.parse(pa.array([t]))
        short = (p["words"] >> np.uint64(32)).astype("<u4")
        parsed.append((i, [(int(leaf), int(np.uint64(line).view(np.int64)), tuple(short[a:b])) for leaf, line, a, b in zip(p["leaf"], p["line"], p["at"], p["at"][1:], strict=False)]))
    docs_of, leaves = defaultdict(set), defaultdict(dict)
    for i, lines in parsed:
        for leaf, line, w in lines:
            docs_of[line].add(i)
            leaves[leaf][line] = w
    template = {}
    for own in leaves.values():
        seeds = []
        for line in sorted(own, key=lambda x: (-len(docs_of[x]), x)):
            w = own[line]
            template[line] = next((s for s, x in seeds if sum(a == b for a, b in zip(w, x, strict=True)) / len(w) >= 0.8), line)
            if template[line] == line:
                seeds.append((line, w))
    merged = defaultdict(set)
    for line, t in template.items():
        merged[t] |= docs_of[line]
    out = {}
    for i, lines in parsed:
        seen, dropped = set(), 0
        for _, line, _ in lines:
            t = template[line]
            if len(merged[t]) >= min_docs:
                dropped += not (i == min(merged[t]) and t not in seen)
                seen.add(t)
        out[i] = (len(lines), dropped)
    return out


@pytest.mark.parametrize("crowd", [2, 16, 256])
def test_merged_templates_equal_brute_force(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = np.random.default_rng(9)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.limit(60).collect()]
    for n in (4, 5, 6, 9, 10, 12, 15, 21, 60):  # leaves of one word count and one start, some of whose words vary
        for i in range(60):
            w = ["all", "begin", "alike", *rng.choice(list("pqrs"), n - 3, p=(0.85, 0.05, 0.05, 0.05))]
            rows.append((10_000 + 100 * n + i, "\n".join([" ".join(w), f"also begin alike {'z' * (i % 11 + 1)} " + " ".join(rng.choice(list("pq"), n - 3, p=(0.9, 0.1)))])))
    got = {r["doc_id"]: (r["_lines"], r["_dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_templates(rows)


def test_keys_join_similar_lines():
    rng = np.random.default_rng(4)
    for n in (3, 4, 5, 8, 9, 10, 14, 15, 20, 33, 80, 200):
        base = rng.integers(1, 2**32, n, dtype=np.uint32)
        words_ = np.tile(base, (300, 1))
        for row in words_[1:]:
            row[3 + rng.choice(max(1, n - 3), min(n - 3, int(rng.integers(0, n // 5 + 2))), replace=False) if n > 3 else []] = rng.integers(1, 2**32)
        k = line_dedup.keys(words_)
        alike = (words_ == base).mean(axis=1) >= 0.8
        different = (words_ != base).any(axis=1)
        assert k.shape[1] <= max(line_dedup.KEYS, n // 5 + 1) and (k == k[0]).any(axis=1)[alike & different].all()


@pytest.mark.parametrize("names", [2_000, 20_000])
def test_short_lines_need_no_rounds(spark, monkeypatch, names):
    """Lines of four words that all begin alike are their own templates: no round, however many there are."""
    rounds = []
    whole = line_dedup.crowded
    monkeypatch.setattr(line_dedup, "crowded", lambda *a: rounds.append(1) or whole(*a))
    rows = spark.range(names).select(F.col("id").alias("doc_id"), F.concat(F.lit("posted by user "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    more = spark.createDataFrame([(names + i, f"Posted on our public board by member {'abcdefghij'[i % 10] * (1 + i // 10)} under general topics today") for i in range(300)], rows.schema)
    got = line_dedup.dedup_lines(rows.unionByName(more))
    assert got.where(f"_dropped > 0 and doc_id < {names}").count() == 0 and got.where("_dropped > 0").count() == 299 and len(rounds) == 1


def test_lines_at_any_crowd(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, f"Posted on our public board by member {'abcdefghij'[i % 10] * (1 + i // 10)} under general topics today") for i in range(60)]
    rows += [(100 + i, "Posted on our " + " ".join(rng.choice(list("pqr"), 10, p=(0.8, 0.1, 0.1)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    whole = sorted(line_dedup.dedup_lines(df).collect())
    assert [r["doc_id"] for r in whole if not r["_dropped"] and r["doc_id"] < 100] == [0]
    for crowd in (2, 30):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        assert sorted(line_dedup.dedup_lines(df).collect()) == whole


def test_passages_of_two_documents_go(spark, tmp_path):
    passage = " ".join(["the", "long", "passage", *(f"w{'x' * i}" for i in range(48))])
    short, other = " ".join(passage.split(" ")[:50]), f"{passage} end".replace("passage ", "", 1)
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    make((4, f"alpha\n{passage}\n{short}"), (2, f"beta two\n{passage}"), (7, f"gamma here now\n{short}")).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_dropped"] for r in Q.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()} == {4: 1, 2: 0, 7: 0}
    alike = f"{passage}z"  # a template with passage, in two documents only
    rows = make((1, f"alpha\n{passage}"), (2, f"{passage}\n{alike}\n{other}"), (None, passage))
    assert {(r["doc_id"], r["text"]) for r in line_dedup.filter_documents(rows).collect()} == {(1, f"alpha\n{passage}"), (2, f"{alike}\n{other}"), (None, passage)}
    assert {r["text"] for r in line_dedup.dedup_lines(rows).collect()} == {r["text"] for r in rows.collect()}


def test_nearest_seed():
    rng = np.random.default_rng(6)
    for n in (1, 4, 5, 13):
        seeds, lines = (rng.choice(3, (k, n), p=(0.8, 0.1, 0.1)).astype(np.uint32) for k in (30, 200))
        near = (lines[:, None] == seeds[None]).mean(axis=2) >= 0.8
        assert line_dedup.nearest(seeds, lines).tolist() == np.where(near.any(axis=1), near.argmax(axis=1), -1).tolist()


def test_templates():
    words_ = np.array([[1, 2, 3, 4, 5], [1, 2, 3, 4, 9], [1, 2, 8, 7, 5], [1, 2, 3, 6, 5]])
    assert line_dedup.templates(np.array([10, 11, 12, 13]), np.array([5, 1, 1, 1]), words_).tolist() == [10, 10, 12, 10]


# -- 6


@pytest.mark.parametrize("limit", [300, 5_000, 1 << 24])
def test_shards_equal_sql(spark, docs, sf, limit):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = shards.assign(docs, limit)
    cols = sorted(rows.columns)
    ours = sorted(tuple(r) for r in rows.select(*cols).collect())
    assert ours == sorted(con.sql(shards.OP6_SQL.replace(str(shards.LIMIT), str(limit))).project(", ".join(cols)).fetchall())
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.max("shard_bytes").alias("s"), F.count("*").alias("n"))
    assert sums.where(f"b <> s or b > {limit} and n > 1").count() == 0


def test_shards_odd_input(spark, odd, none):
    copies = odd.unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text in many rows").alias("text")), allowMissingColumns=True)
    rows = shards.assign(copies, 1000)
    assert rows.count() == copies.count()
    assert rows.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.max("shard_bytes").alias("s"), F.count("*").alias("n")).where("b <> s or b > 1000 and n > 1").count() == 0
    assert shards.assign(none).count() == 0


# -- 7


def test_token_counts_equal_plain_dynamic_programming(docs, odd, none):
    model = token_counts.Unigram.from_model(P.path("piece_bpe_32k.model"))

    def count(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[-1][0] + n * model.byte_score, -best[-1][1] - n)]
            options += [(model.scores[word[s:end]] + best[s][0], -best[s][1] - 1) for s in range(end) if word[s:end] in model.scores]
            s, t = max(options)
            best.append((s, -t))
        return best[-1][1]

    seen = {}
    for df in (docs.limit(60), odd):
        rows = token_counts.token_counts(df, P.path("piece_bpe_32k.model")).collect()
        assert len(rows) == df.count()
        wanted = defaultdict(list)
        for r in df.collect():
            own = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            if max(map(len, own), default=0) < 1000:
                wanted[r["doc_id"]].append((len(own), sum(seen[w] if w in seen else seen.setdefault(w, count(token_counts.MARK + w)) for w in own)))
        assert all((r["n_words"], r["n_tokens"]) in wanted[r["doc_id"]] for r in rows if wanted[r["doc_id"]])
    assert token_counts.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0


# -- 8


def test_urls_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    rows = Q.QUERIES["op8_url_filter"](spark, sf)
    cols = sorted(rows.columns)
    assert sorted(map(repr, map(tuple, rows.select(*cols).collect()))) == sorted(map(repr, con.sql(url_filter.OP8_SQL).project(", ".join(cols)).fetchall()))


def test_urls_odd_input(spark):
    urls = [None, "", "://", "no scheme", "http://", "http://COM/x", "http://xcom/", "http://a.EXAMPLE.com/en/1?x#y", "http://www.example.com/en/", "http://www.example.com/EN/", "x://b.www.example.com/en/", "http://net/es/", "http://net?/es/", "http://é.net/fr/ü", "http://com", "http://com/", "http://.com/", "http://a.b.c.d.net/es/es", "a://b://c.net/es/", "http://com./", "http://\n.com/\n?"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(5, "http://COM/x", "x", "y")], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(url_filter.RULES + [("", "/ban", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = defaultdict(list)
    for r in url_filter.judge(pages, rules).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert len(got[5]) == 2
    for i, u in enumerate(urls):
        m = re.search(r"(?s)^.*?://(.*)$", u or "")
        rest = m[1] if m else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, v) for h, p, v in [*url_filter.RULES, ("", "/ban", "block")] if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"), key=lambda x: x[0])
        assert got[i][0] == (host, path, rule, verdict), u
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


# -- 9


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(three)
    covered = {i + j for i, x in enumerate(three) if times[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_fertility(spark, sf, docs, odd, none):
    for df in (docs, odd):
        rows = fertility.judge(df, *fertility.paths()).collect()
        texts = defaultdict(list)
        for r in df.collect():
            texts[r["doc_id"]].append(base(r["text"]))
        assert len(rows) == df.count()
        for r in rows:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) in texts[r["doc_id"]]
            assert not (r["kept"] and r["base_failed"])
    assert fertility.judge(none, *fertility.paths()).count() == 0
    kept = {r["doc_id"] for r in fertility.judge(docs, *fertility.paths()).where("kept").collect()}
    assert {r["doc_id"] for r in fertility.filter_documents(docs, *fertility.paths()).collect()} == kept
    assert fertility.filter_documents(odd, *fertility.paths()).columns == odd.columns


def test_fertility_rejects_gibberish(spark, docs):
    rng = np.random.default_rng(2)
    noise = " ".join("".join(chr(int(c)) for c in rng.integers(0xE000, 0xE400, 8)) for _ in range(200))
    df = docs.unionByName(spark.createDataFrame([(-1, noise, "en", "s", 1)], docs.schema))
    assert fertility.judge(df, *fertility.paths()).where("doc_id = -1").head()["kept"] is False


# -- 10


def test_bucket_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(20):
        u = sorted(rng.choice(100, 8, replace=False).tolist())
        c = rng.integers(1, 20, 8).tolist()
        cost = lambda ends, u=u, c=c: sum(n * min(e for e in ends if e >= x) for x, n in zip(u, c, strict=True))
        got = packing.boundaries(u, c, 3)
        assert len(got) <= 3 and cost(got) == min(cost([*e, u[-1]]) for k in range(3) for e in combinations(u[:-1], k))
    assert packing.boundaries([], []) == [] and packing.boundaries([8], [3], 16) == [8]


def test_packing(spark, docs, odd, none, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(BYTE))
    t.encode_special_tokens = True
    ranks = P.path(BYTE.replace(".json", ".tiktoken"))  # the same vocabulary for both libraries
    monkeypatch.setattr(packing, "GROUP", 7)
    same = spark.range(60).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text in many rows").alias("text"))
    for df in (docs, odd, odd.unionByName(same, allowMissingColumns=True)):
        rows = packing.pack(df, ranks, budget=2000).collect()
        assert len(rows) == df.count()
        batches = defaultdict(list)
        for r in rows:
            assert r["n_tokens"] <= r["bucket_len"]
            batches[r["bucket"], r["batch"]].append(r)
        last = {b: max(k for x, k in batches if x == b) for b, _ in batches}
        for (b, k), own in batches.items():
            room = max(1, 2000 // own[0]["bucket_len"])
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert len(own) == room or k == last[b] and len(own) < room
    tokens = Counter(r["n_tokens"] for r in packing.pack(odd, ranks).collect())
    assert tokens == Counter(1 + len(t.encode(x or "", add_special_tokens=False).ids) for (x,) in odd.select("text").collect())
    assert packing.pack(none, ranks).count() == 0


def test_equal_rows_go_to_many_tasks(spark, monkeypatch):
    """100,000 equal rows: no group of the numbering window holds more than a few GROUP of them."""
    monkeypatch.setattr(packing, "GROUP", 5000)
    monkeypatch.setattr(shards, "GROUP", 5000)
    df = spark.range(0, 100_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    rows = packing.pack(df, packing.vocabulary(), budget=64)
    assert rows.count() == 100_000 and rows.select("batch", "slot").distinct().count() == 100_000 and rows.agg(F.max("batch")).head()[0] == 100_000 * 8 // 64 - 1
    rows = shards.assign(df, 9 * 1000)
    assert rows.groupBy("shard").count().where("count <> 1000").count() == 0 and rows.count() == 100_000


# -- shared parts


def swapped(n, parts=b"ab"):
    """Two strings of n bytes that differ by a swap 65,536 places apart."""
    one = bytearray(b"x" * n)
    one[5], one[5 + 65_536] = parts
    two = bytearray(one)
    two[5], two[5 + 65_536] = parts[::-1]
    return one.decode(), two.decode()


@pytest.mark.parametrize("n", [70_000, 200_000])
def test_long_words_and_lines_that_differ_by_a_swap(spark, n, monkeypatch):
    a, b = swapped(n)
    for step in (words.STEP, 1000):  # whole, and in blocks
        monkeypatch.setattr(words, "STEP", step)
        data, offsets = words.raw(pa.array([a, b, a]))
        h = words.hashes(data, offsets[:-1], offsets[1:])
        assert h[0] == h[2] != h[1]
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{own}\n{a}\n{b}"), (2, f"{own}\nu v {a} u v {b} u v"), (3, f"{own}\n{a}\n{a}")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in fertility.judge(df, *fertility.paths()).collect()}
    assert got == {i: base(t) for i, t in rows} and got[1][3] == 0 and got[3][3] == 1
    texts = [(1, " ".join([a, *"cdefg"])), (2, " ".join([b, *"cdefg"])), (3, " ".join([a, *"cdefg"]))]
    links = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert links == brute_join(texts)
    model = token_counts.load(P.path("piece_bpe_32k.model"))
    data, offsets = words.raw(pa.array([a, b]))
    model.of_words(data, offsets[:-1], offsets[1:])
    assert len({int(x) for x in words.hashes(data, offsets[:-1], offsets[1:])} & set(model.known)) == 2


def test_long_lines_that_differ_by_swapped_words():
    line = [f"w{'x' * (i % 7)}{chr(97 + i % 26)}" for i in range(70_000)]
    other = list(line)
    line[9], line[9 + 32_768], other[9], other[9 + 32_768] = "left", "right", "right", "left"
    one, two, three = (line_dedup.parse(pa.array([" ".join(x)])) for x in (line, other, line))
    assert one["line"] == three["line"] != two["line"] and one["leaf"] == two["leaf"]


def test_word_hashes_agree_with_words():
    texts = ODD + [None]
    data, offsets = words.raw(pa.array(texts))
    begin, end, rows = words.word_spans(data, offsets)
    h = words.hashes(data, begin, end)
    of = {}
    for i, t in enumerate(texts):
        own = (t or "").encode().split()
        assert [bytes(data[a:b]) for a, b in zip(begin[rows[i] : rows[i + 1]], end[rows[i] : rows[i + 1]], strict=True)] == own
        for w, x in zip(own, h[rows[i] : rows[i + 1]].tolist(), strict=True):
            assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 260)] + [(None, 1), (2, None)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {i: root(i) for i in up}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in c.STAGES:
        out = common.cut(stage(spark, docs, sf))
        n = out.count()
        assert n <= before, name
        if name != "packing":
            assert out.columns == columns
            assert stage(spark, docs.limit(0), sf).count() == 0
        docs, before = out, n
    assert c.run(spark, sf).count() == before > 0
    assert max(l for _, l in brute_join([(r["doc_id"], r["text"]) for r in c.stage_near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()]).values()) == 0  # noqa: E741


def test_pipeline_stages_on_odd_rows(spark, sf, odd):
    """Nulls, ties, repeated rows and clashing names in every stage: the stated results."""
    import corpus_pipeline as c

    rows = odd.drop("key", "c0").unionByName(odd.drop("key", "c0"))
    for name, stage in c.STAGES:
        out = stage(spark, rows, sf).collect()
        keys = Counter(r["doc_id"] for r in out)
        if name == "rules":
            assert all(len((r["text"] or "").split()) >= 50 for r in out)
        if name == "lines":
            assert keys[100] == 2 and {r["text"] for r in out if r["doc_id"] is None} == {"some words of a text here"}
        if name == "near_duplicates":
            assert all(n == 1 for k, n in keys.items() if k is not None) and keys[None] == 2 and keys[100] == 1 and keys[0] == 1
        if name == "packing":
            assert keys[100] == 2 and {r["n_tokens"] for r in out if r["doc_id"] == 100} == {1}
        else:
            assert not out or list(out[0].asDict()) == rows.columns


def test_join_recall_on_a_larger_table(spark):
    """Queries divisible by 20 against all rows of the middle table: no link is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(docs).collect()}
    want = brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])
    own = [i for i in want if i % 20 == 0]
    assert sum(got[i] for i in own) >= 0.9 * sum(want[i][1] for i in own) and all(got[i] <= want[i][1] for i in own)


def test_cuts_can_be_deleted(spark):
    import os

    df = common.cut(spark.range(5))
    at = df.inputFiles()[0]
    assert df.count() == 5
    common.discard(df)
    assert not os.path.exists(at.removeprefix("file://"))


def test_training_takes_bounded_passages(spark, docs, sf, monkeypatch):
    """Texts beyond the bound are left out before anything is collected."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(quality, "MAX_PASSAGES", 40)
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", classmethod(lambda cls, x, first, y: seen.append((len(x), np.diff(first).max(), len(y))) or quality.Constant(0.5)))
    quality.train(docs, labels)
    assert seen[0][0] <= 40 and seen[0][1] <= 4 and seen[0][2] > 1

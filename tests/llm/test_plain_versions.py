"""Quality scores and fertility metrics against plain versions, document by document."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from urnwise.llm import fertility, quality  # noqa: E402
from urnwise.llm.common import byte_level  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", "a", " \n ", "word " * 200, "日本語 テキスト. " * 40, "x" * 3000, "One line.\nOne line.\n\nNo? Yes! #1 | 2,3;", "é" * 700 + " end"]


def plain_metrics(text, tokens, pieces):
    """(characters per token, share of fallback bytes, entropy over the largest possible) of a text's words."""
    words = WORD.findall(text)
    if not words:
        return (None, None, None)
    ids = [i for w in words for i in pieces.encode(w)]
    count = Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in count.values())
    return sum(map(len, words)) / sum(len(tokens.encode_ordinary(" " + w)) for w in words), sum(pieces.is_byte(i) for i in ids) / len(ids), entropy / math.log2(min(max(len(ids), 2), pieces.get_piece_size()))


def test_fertility_equals_a_plain_version(spark, sf):
    """Metrics of every document, and the verdicts that follow from bands around the medians of all documents of a language."""
    import sentencepiece

    ranks, model = fertility.paths()
    tokens, pieces = byte_level(ranks), sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()] + [(10_000 + i, t, "xx" if i % 2 else None) for i, t in enumerate(ODD)]
    rows = [(i, t, lang) for i, t, lang in rows if len(t or "") < 30_000]
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, docs.schema), ranks, model).collect()}
    own = {i: plain_metrics(t or "", tokens, pieces) for i, t, _ in rows}
    for i, want in own.items():
        for name, x in zip(fertility.METRICS, want, strict=True):
            assert (got[i][name] is None) == (x is None) and (x is None or abs(got[i][name] - x) < 1e-9), (i, name)

    def latin(text):
        data, chars = text.encode(), sum(map(len, WORD.findall(text)))
        return 2 * sum(65 <= b <= 90 or 97 <= b <= 122 or 0xC3 <= b <= 0xC9 for b in data) >= chars

    keys = {i: [f"lang:{lang}"] * (lang is not None) + ["script:latin" if latin(t or "") else "script:other", "all"] for i, t, lang in rows}
    of = defaultdict(list)
    for i, k in keys.items():
        if not got[i]["base_failed"]:
            for x in k:
                of[x].append(own[i])
    band = {}
    for k, values in of.items():
        if len(values) >= fertility.LEAST_DOCS:
            band[k] = []
            for m, name in enumerate(fertility.METRICS):
                x = sorted(v[m] for v in values)
                mid, upper = (x[math.ceil(p * len(x)) - 1] for p in (0.5, 0.75))
                width = max(fertility.WIDTH * (upper - mid), fertility.FLOOR * mid)
                band[k].append((-1, max(fertility.FREE_FALLBACK, mid + width)) if name == "fallback_share" else (mid - width, mid + width))
    assert any(k.startswith("script") for k in band)
    for i, k in keys.items():
        first = next((x for x in k if x in band), None)
        want = not got[i]["base_failed"] and (first is None or all(low - 1e-9 <= v <= high + 1e-9 for v, (low, high) in zip(own[i], band[first], strict=True)))
        assert got[i]["kept"] == want, i


def plain_score(model, text):
    """The score of a text by the formulas of the class, passage by passage and unit by unit."""
    data = text.encode()
    parts = [data[i : i + quality.PASSAGE] for i in range(0, len(data), quality.PASSAGE)] or [b""]
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    three = [tuple(w for _, w in words[i : i + 3]) for i in range(len(words) - 2)]
    bags = []
    for j, part in enumerate(parts):
        kind = [int(quality.CLASS[b]) for b in part]
        n, own = max(1, len(part)), [w for at, w in words if at // quality.PASSAGE == j]
        x = [kind.count(c) / n for c in range(quality.CLASSES)]
        pairs = Counter(zip(kind, kind[1:]))
        x += [pairs[a, b] / n for a in range(quality.CLASSES) for b in range(quality.CLASSES)]
        x += [math.log1p(n), math.log1p(n / max(1, len(own))), len(set(own)) / max(1, len(own)), len(set(three)) / max(1, len(three)), math.log1p(len(parts)), float(not own)]
        bags.append(x)
    p = model.p
    x = np.clip((np.array(bags, np.float32) - model.mean) / model.scale, -6, 6).astype(np.float64)
    h = np.tanh(x @ p["W"] + p["w0"])
    energy = [sum(float(np.tanh(row @ p["V"])[k] / (1 + math.exp(-float((row @ p["U"])[k])))) * float(p["a"][k]) for k in range(quality.ATTENTION)) for row in h]
    weight = [math.exp(e - max(energy)) for e in energy]
    z = sum(w / sum(weight) * row for w, row in zip(weight, h, strict=True))
    return 1 / (1 + math.exp(-float(np.clip(z @ p["c"] + p["c0"][0], -30, 30))))


def test_quality_equals_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert isinstance(model, quality.Attention)
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").limit(80).collect()] + ODD
    got = model.score(*quality.encode(pa.array(texts)))
    for t, s in zip(texts, got, strict=True):
        assert abs(plain_score(model, t) - s) < 1e-4, t[:60]

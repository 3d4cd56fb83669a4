"""The language model against a plain one, and components against union-find."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemill.llm")


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney over lower-cased bytes: probability of a byte behind a context of order - 1 bytes."""
    grams = collections.Counter()
    for t in texts:
        raw = b"\0" * (order - 1) + bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
        grams.update(raw[k : k + order] for k in range(len(raw) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cut, context = {}, {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        d = [0.5, 1.0, 1.5]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        cut[k] = [min(max(x, 0.05), j + 0.95) for j, x in enumerate(d)]
        for g, v in c.items():
            total, mass = context.get((k, g[:-1]), (0, 0.0))
            context[k, g[:-1]] = total + v, mass + cut[k][min(v, 3) - 1]

    def p(k, before, byte):
        if not k:
            return 1 / 256
        if (k, before) not in context:
            return p(k - 1, before[1:], byte)
        total, mass = context[k, before]
        c = counts[k].get(before + byte, 0)
        return (max(0.0, c - cut[k][min(c, 3) - 1]) / total if c else 0.0) + mass / total * p(k - 1, before[1:], byte)

    return p


def test_language_model_against_a_plain_one(spark):
    from tidemill.llm.quality import ORDER, lang_code, probabilities, train, write_shards

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aabcdeé") for _ in range(rng.randint(1, 5)))
    texts = {lang: [" ".join(rng.choice(["The", word(), "of", word()]) for _ in range(rng.randint(0, 40))) for _ in range(25)] + ["", "x", "The of"] * 2 for lang in ("en", "de")}
    rows = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts] + [(None, "en")], "text string, lang string")
    shards = write_shards(train(rows.select("text", lang_code(F.col("lang")).alias("code"))))
    for lang, ts in texts.items():
        code = rows.select(lang_code(F.lit(lang))).first()[0]
        p = plain_model(ts, ORDER)
        seen = "".join(ts).lower().encode()
        asked = [(b"\0" * (ORDER - 1), b"t"), (b"\0\0\0t", b"h"), (b"zzzz", b"q"), (b"zzza", b"b"), (b"\xff\xfe\0\0", b"\x80")]
        for _ in range(300):
            k = rng.randrange(len(seen) - ORDER)
            asked.append((seen[k : k + ORDER - 1], bytes([rng.choice([seen[k + ORDER - 1], rng.randrange(256)])])))
        keys = np.array([(code << 8 * ORDER) | int.from_bytes(c + b, "big") for c, b in asked], np.uint64)
        want = np.array([p(ORDER, c, b) for c, b in asked])
        assert np.abs(probabilities(keys, shards) / want - 1).max() < 1e-4


@pytest.mark.parametrize("shape", ["random", "chain", "star", "pairs", "none"])
def test_components(spark, shape):
    from tidemill.llm.components import components

    rng = random.Random(7)
    edges = {"random": [(rng.randrange(400), rng.randrange(400)) for _ in range(330)], "chain": [(k, k + 1) for k in range(3_000)], "star": [(5_000, k) for k in range(2_000)], "pairs": [(2 * k, 2 * k + 1) for k in range(500)], "none": []}[shape]
    rng.shuffle(edges)
    odd = [(None, 3), (4, None), (9, 9)] if shape != "none" else [(None, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    rows = spark.createDataFrame(edges + edges[:50] + odd, "x long, y long").repartition(6)
    got = {r["id"]: r["component"] for r in components(rows).collect()}
    assert got == want

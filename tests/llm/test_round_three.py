"""Chat formatting, filter audit and whitening against brute force, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("tidemill.llm")

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[END][/ROLE] [ROLE] x", "", " ", "é\U0001f600\n<s", "[[INST]]", "q", "z", "qz"]


def talk(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["user", "assistant", "assistant", "system", "tool", "", "a[/ROLE]\\"]), rng.choice(HOSTILE) + rng.choice(HOSTILE)) for _ in range(n)]


# ---------------------------------------------------------------- chat formatting


def test_template_is_reversible():
    from tidemill.llm import chat_format as C

    for seed in range(300):
        turns = talk(seed, seed % 9)
        text = C.render(turns)
        assert C.read(text) == turns
        assert not any(c in C.escape(t) for _, t in turns for c in C.CONTROL)


def test_spans_of_a_black_box():
    """Appending, closing and rewriting templates, some of which refuse an empty conversation."""
    from tidemill.llm.chat_format import render, spans, unescape

    for seed in range(60):
        turns = talk(seed, 7)
        text, found = spans(render, turns, ("assistant",))
        assert text == render(turns) and [unescape(text[s["from"] : s["to"]]) for s in found if s["from"] is not None] == [t for r, t in turns if r == "assistant"]
        assert "".join([text[:3], *[text[s["start"] : s["end"]] for s in found]]) == text

    def closed(turns):
        return "".join(f"<{r}>{t}</{r}>" for r, t in turns) + "<end>"

    turns = [("user", "a"), ("assistant", "<end>"), ("user", ""), ("assistant", "b")]
    text, found = spans(closed, turns, ("assistant",))
    assert [text[s["start"] : s["end"]] for s in found] == [f"<{r}>{t}</{r}>" for r, t in turns]
    assert [text[s["from"] : s["to"]] for s in found if s["from"] is not None] == ["<end>", "b"]

    def forgetful(turns):  # keeps the thoughts of the last reply only
        if not turns:
            raise ValueError("no turns")
        cut = [t if k == len(turns) - 1 else re.sub(r"\(.*?\) ", "", t) for k, (_, t) in enumerate(turns)]
        return "".join(f"<{r}>{t}</{r}>" for (r, _), t in zip(turns, cut))

    turns = [("user", "1"), ("assistant", "(think) 2"), ("user", "3"), ("assistant", "(more) 4"), ("user", "5")]
    text, found = spans(forgetful, turns, ("assistant",))
    assert [s["first_change"] for s in found] == [None, 2, None, 4, None]
    assert found[1]["from"] is None and found[3]["from"] is None
    text, found = spans(forgetful, turns[:4], ("assistant",))
    assert text[found[3]["from"] : found[3]["to"]] == "(more) 4" and found[1]["from"] is None

    loud = lambda turns: "".join(f"<{r}>{t.upper()}</{r}>" for r, t in turns)
    assert all(s["from"] is None and s["start"] is not None for s in spans(loud, [("assistant", "a"), ("user", "b")], ("assistant",))[1])


def conversations(spark):
    rows = []
    for conv, n in [(1, 1), (2, 5), (3, 31), (4, 32), (5, 33), (6, 63), (7, 64), (8, 65), (9, 400), (10, 40), (None, 45)]:
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(talk(conv or 99, n))]
    rows += [(11, None, "user", "no turn"), (11, 0, None, None), (11, 0, "assistant", None), (11, 0, "assistant", None), (11, 0, "assistant", "tie"), (12, 0, "assistant", "long " * 50_000)]
    return rows, spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, piece string, index int").repartition(7)


def test_conversations_against_brute_force(spark):
    from tidemill.llm.chat_format import digests, format_conversations, render

    rows, turns = conversations(spark)
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    formatted = format_conversations(turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in digests(formatted).collect()}
    pieces = collections.defaultdict(list)
    for r in formatted.collect():
        pieces[r["conv_id"]].append((r["piece"], r["text"], r["whole"], r["n_turns"]))
    assert set(got) == set(by) == set(pieces)
    for conv, said in by.items():
        said = [(r, t) for _, r, t in sorted(said)]
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[conv] == (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(render(said)), 0)
        assert "".join(t for _, t, _, _ in sorted(pieces[conv])) == render(said)
        assert [w for _, _, w, _ in pieces[conv]] == ([True] if len(said) <= 32 else [False] * len(pieces[conv])) and sum(n for *_, n in pieces[conv]) == len(said)
    assert digests(format_conversations(turns.limit(0))).count() == 0


def test_rewritten_turns_are_reported(spark):
    from tidemill.llm.chat_format import format_conversations

    def last_only(turns):
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t[:1]}</{r}>" for k, (r, t) in enumerate(turns))

    turns = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"{k} text") for k in range(70)] + [(2, 0, "assistant", "one")], "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["piece"]): r for r in format_conversations(turns, last_only).collect()}
    assert {k: (r["rewritten_at"], sum(s["rewritten"] for s in r["spans"])) for k, r in out.items()} == {(1, 0): (1, 32), (1, 1): (33, 32), (1, 2): (65, 5), (2, 0): (None, 0)}
    assert sum(s["from"] is not None for r in out.values() for s in r["spans"]) == 2  # the last turns of both conversations


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = space.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((lang or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                early = [r for r in mine if f in r[1] and r[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(early), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    from tidemill.llm.filter_audit import audit, interactions, mask_counts

    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é", "a#b", "X", "delta", "eps"] + [f"w{k}" for k in range(400)]
    texts = ["", " ", "x", "X#", " ".join(words), "a " * 300, "same begin " * 40 + "A", "same begin " * 40 + "B", "é" * 300, "é" * 299 + "e"]
    texts += [" ".join(rng.choice(words[: rng.choice([4, 8, 300])]) for _ in range(rng.choice([5, 150, 250, 900]))) for _ in range(25)]
    texts += ["y" * 5_000 + "1", "y" * 5_000 + "2", "long " * 30_000]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None])) for k in range(180)] + [(None, texts[3], "en"), (None, "null id only", "en"), (None, "null id only", "en"), (200, None, None), (201, "", "fr"), (50, texts[4], "en"), (50, texts[4], "en"), (500, texts[-1], "en"), (501, texts[-1], "en")]
    docs += [(1_000 + k, "hot text", "en") for k in range(150)]
    labels = [(k, k % 3 == 0, k % 7 == 0) for k in range(0, 180, 2)] + [(6, 0, 1), (None, 1, 1), (1_003, None, 1)]
    labels = [(i, None if q is None else int(q), int(t)) for i, q, t in labels]
    frame = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, lang string, mask string, n_chars int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r[:3]): tuple(r[3:]) for r in audit(frame, marks).collect()}
    assert got == brute_audit(docs, labels)
    assert audit(frame.limit(0), marks).count() == 0
    assert {tuple(r[:3]): tuple(r[3:]) for r in audit(frame, marks.limit(0)).collect()} == brute_audit(docs, [])
    assert interactions(mask_counts(frame.limit(1), marks)).count() == 600


def test_equal_block_hashes_are_told_apart(spark, monkeypatch):
    """With hashes that say nothing, full texts decide alone."""
    from pyspark.sql import functions as F
    from tidemill.llm import filter_audit as A

    monkeypatch.setattr(A, "_keys", lambda text: {"n_chars": F.length(text), "block_1": F.lit(1).cast("long")})
    docs = [(1, "aa", "x"), (2, "ab", "x"), (3, "aa", "x"), (4, "ac", "x"), (5, "ab", "y"), (6, "abc", "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {tuple(r[:3]): tuple(r[3:]) for r in A.audit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == brute_audit(docs, [])


# ---------------------------------------------------------------- whitening


def exact(rows):
    """n, sums and n * X'X - S S' of distinct integer vectors, by plain Python."""
    fit = sorted({tuple(r) for r in rows})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    return n, s, [[n * sum(x[i] * x[j] for x in fit) - s[i] * s[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("top", [300, 1 << 30, 1 << 50, (1 << 63) - 1])
def test_products_are_exact(top):
    from tidemill.llm.whitening import exact_gram

    rng = random.Random(top)
    rows = [[rng.randint(-top, top) for _ in range(5)] for _ in range(700)] + [[-top] * 5, [top] * 5, [0] * 5]
    got = exact_gram(np.array(rows, np.int64))
    assert got.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


@pytest.mark.parametrize("far", [0.0, 1e6, 3e12])
def test_whitening_against_exact_numbers(spark, far):
    from tidemill.llm.whitening import whiten

    rng = np.random.default_rng(int(far) % 97)
    base = (rng.standard_normal((180, 6)) @ np.diag([3, 2, 1, 0.7, 0.3, 0.1]) + far).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(None, base[0]), (3, base[3]), (900, None), (901, [float("nan")] * 6), (902, [None, *base[0][1:]]), (903, [float("inf")] * 6), (904, [])] + [(1_000 + k, base[7]) for k in range(90)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, n string").repartition(5)
    got = whiten(frame).collect()
    assert len(got) == 4 * (180 + 2 + 90)
    whole = [[int(np.floor(256 * c)) for c in v] for _, v in rows if v and None not in v and np.isfinite(v).all()]
    n, s, m = exact(whole)
    v = np.array([[float(Fraction(x, n * n)) for x in r] for r in m])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-4
    by = collections.defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    seen = collections.Counter()
    for c, mine in sorted(by.items()):
        assert all(abs(r["explained"] / (e[c - 1] / np.trace(v)) - 1) < 1e-6 for r in mine)
        signs = set()
        for r in mine:
            if r["vec_id"] is None or r["vec_id"] >= 1_000:
                continue
            x = [int(np.floor(256 * q)) for q in base[r["vec_id"]]]
            left = [n * a - b for a, b in zip(x, s)]
            assert r["deviation"] == sum(q * q for q in left)
            want = float(np.array([float(Fraction(q, n)) for q in left]) @ u[:, c - 1]) / np.sqrt(e[c - 1])
            if abs(want) > 1e-3:
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-6 * max(1, abs(want))
                signs.add(np.sign(want * r["whitened"]))
            seen[r["vec_id"]] += 1
        assert len(signs) == 1
    assert seen[3] == 8 and seen[4] == 4


def test_whitening_of_degenerate_tables(spark):
    from tidemill.llm.whitening import whiten

    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    rows = [(k, [float(k), 5.0, 2.0 * k]) for k in range(10)] + [(20 + k, [float(k)]) for k in range(4)] + [(30, [1e30, -1e30, 0.0])]
    got = collections.defaultdict(dict)
    for r in whiten(spark.createDataFrame(rows, schema)).collect():
        got[r["vec_id"]][r["component"]] = r
    assert {k: len(v) for k, v in got.items()} == {**{k: 3 for k in range(10)}, **{20 + k: 1 for k in range(4)}, 30: 3}
    assert got[0][1]["n"] == 11 and got[21][1]["n"] == 4 and got[21][1]["explained"] == 1.0
    flat = whiten(spark.createDataFrame(rows[:10], schema)).where("component = 1").collect()
    assert abs(np.var([r["whitened"] for r in flat]) - 1) < 1e-9 and all(r["explained"] > 1 - 1e-12 for r in flat)
    assert whiten(spark.createDataFrame(rows[:10], schema)).where("component > 1 and whitened is not null").count() == 0


def test_exchanges_go_once_a_table_is_stored(spark, tmp_path):
    """What a stored table was shuffled through leaves the disk with the write; the setting is as before then."""
    from pathlib import Path

    from tidemill.llm.common import Scratch, stored
    from tidemill.runtime import _CLEANUP

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in local.rglob("shuffle_*.data")}
    before = files()
    table = stored(spark.range(5_000).repartition(3, "id"), "exchanged")
    again = Scratch(spark).store(table.repartition(3, "id"), "exchanged-again")
    assert again.count() == table.count() == 5_000
    for _ in range(50):
        if not {f for f in files() - before if f.startswith("shuffle_")} or spark.conf.get(_CLEANUP, None) is not None:
            break
        __import__("time").sleep(0.1)
    counts = {f.split("_")[1] for f in files() - before}
    assert len(counts) <= 2 and spark.conf.get(_CLEANUP, None) is None  # those of the two counts alone

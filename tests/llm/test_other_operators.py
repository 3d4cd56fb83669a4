"""Token files, packing, archives, neighbours, toxicity, quality and the pipeline's contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tidemill.llm")
P = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "\n", "a  b", " a", "a ", "a \n b\n\n c  ", "it's  \n", "x\xa0 y", "a <|endoftext|> b", "\x00a b", "tab\tq \t", "É É", "don't 12 3!! ..  ?", "a.b.c., x.,", "A\x01b \x01 c", "Σας ΣΑΣ", "\r\n\r\nx", "été, là.", "word " * 3000]


def docs_of(spark):
    rows = [(k if k else None, t, "x") for k, t in enumerate(TEXTS)] + [(5, " a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)


def reference_ids(name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(name))
    return lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark):
    from tidemill.llm.token_files import read_token_files, write_token_files

    ids, before, want = reference_ids("byte_bpe_50k.json", 2), 0, []
    rows = sorted([((k if k else None), t) for k, t in enumerate(TEXTS)] + [(5, " a")], key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        x = ids(t)
        want.append((i, before, len(x), zlib.crc32(x)))
        before += len(x)
    got = read_token_files(write_token_files(docs_of(spark), P.path("byte_bpe_50k.json"), 2)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    none = docs_of(spark).limit(0)
    assert read_token_files(write_token_files(none, P.path("byte_bpe_50k.json"), 2)).count() == 0


def test_files_are_rolled_and_read_by_header(spark):
    from tidemill.llm.token_files import header, read_token_files, write_token_files

    docs = spark.createDataFrame([(7, f"word {k} of many") for k in range(300)] + [(None, "none")] * 3, "doc_id long, text string")
    files = write_token_files(docs, P.path("byte_bpe_50k.json"), 2, roll=1)
    listed = files.collect()
    assert sum(r["docs"] for r in listed) == 303 and all(header(r["path"])["ids"] == r["tokens"] for r in listed)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in read_token_files(files).collect())
    assert [g[0] for g in got] == np.append(0, np.cumsum([g[1] for g in got])[:-1]).tolist()
    assert [g[2] for g in got] == [None] * 3 + [7] * 300


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_on_random_texts(name, kind):
    """Ids of 20,000 random texts of white space of all kinds, letters, marks and signs equal those of direct calls."""
    import pyarrow as pa

    from tidemill.llm.common import text_slices
    from tidemill.llm.tokens import Encoder

    space = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\xa0", "\u2003", "\u2028", "\x85", "\u3000", "\u202f", "\u200b", "\ufeff", "\x1c", "\x1f", "\x00", "\x01", "\u1680", " \n", "\n\n", " \xa0"]
    letters = [*"abzAZ019_", "é", "É", "ß", "İ", "ж", "中", "ا", "क", "ि", "\u0301", "\u0338", "ﬁ", "½", "the", "Hello", "don't", "I'M", "'s", "'", "’", "×", "÷", "à"]
    signs = [*"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "…", "—", "😀", "€"]
    rng = random.Random(11)
    texts = ["".join(rng.choice(rng.choice((space, letters, letters, signs))) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["Intro:\n\xa0 text", "para.\n\n\xa0\xa0Next", "a <|endoftext|> b"]
    made = Encoder(P.path(name), kind)
    for k in range(0, len(texts), 700):
        part = texts[k : k + 700]
        for i, j, buf, off in text_slices(pa.array(part)):
            ids, first = made.encode(buf, off)
            for d, want in enumerate(made.tok.encode_batch(part[i:j], add_special_tokens=False)):
                assert ids[first[d] : first[d + 1]].tolist() == want.ids, part[i + d]


def test_codes_give_random_access():
    from tidemill.llm.token_files import Codes, write_codes

    rng = np.random.default_rng(3)
    for ids in (np.empty(0, np.uint32), np.array([0], np.uint32), (rng.pareto(0.5, 4000) * 20).clip(0, 2**31).astype(np.uint32)):
        codes = Codes(write_codes(ids, [1, None], np.array([0, len(ids) // 2, len(ids)])))
        assert (codes.all_ids() == ids).all()
        assert all(codes.token(i) == ids[i] for i in range(0, len(ids), 7))
        assert codes.doc_ids == [1, None]


def test_packing(spark):
    from tidemill.llm.packing import pack

    ids = reference_ids("word_bpe_49k.json", 1)
    rows = pack(docs_of(spark).where("doc_id is not null and doc_id <> 5"), P.path("word_bpe_49k.json"), 1, window=64).collect()
    for i, t in enumerate(TEXTS):
        if i in (0, 5):
            continue
        x, at = ids(t), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            part = x[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], r["ids"]) == (at, len(x), zlib.crc32(part), part.tolist())
            at += r["length"]
        assert at == len(x)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_of_repeated_and_missing_ids(spark):
    """Every row is a document of its own; little padding; no row from an empty table."""
    from tidemill.llm.packing import pack

    ids = reference_ids("word_bpe_49k.json", 1)
    rows = [(k % 3 or None, t) for k, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = pack(docs, P.path("word_bpe_49k.json"), 1, window=64).collect()
    assert sum(r["length"] for r in got) == sum(len(ids(t)) for _, t in rows)
    ends = [r["doc_tokens"] for r in got if r["start"] + r["length"] == r["doc_tokens"]]
    assert sorted(ends) == sorted(len(ids(t)) for _, t in rows)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= 16 * len(seqs) and padding < 0.05 * sum(r["length"] for r in got)
    assert pack(docs.limit(0), P.path("word_bpe_49k.json"), 1).count() == 0


def test_best_fit_takes_the_tightest_window():
    from tidemill.llm.packing import RoomTree, best_fit

    tree = RoomTree(100)
    for room in (5, 17, 60):
        tree.add(room, room)
    assert [tree.tightest(n) for n in (1, 5, 6, 17, 18, 60, 61)] == [5, 5, 17, 17, 60, 60, None]
    rng = random.Random(1)
    sizes = [rng.randint(1, 99) for _ in range(300)]
    done = [0] * 300
    for w in best_fit(sizes, 100):
        assert sum(n for _, _, n in w) <= 100
        for k, _, n in w:
            done[k] += n
    assert done == sizes and best_fit([], 100) == []


def test_warc(spark):
    from tidemill.llm.warc import fetch, read, write

    long, other = "é" * 600, "b" * 999
    rows = [(1, "http://a/ b\n", long), (2, None, long), (9, "u", long), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", ""), (None, "u", long), (9, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, name string").repartition(2)
    index = write(pages)
    got = sorted(map(tuple, read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = 9 if h == long and i != 9 else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    for row in index.collect():
        head, payload = fetch(row)
        assert head["WARC-Type"] == row["record_type"] and (payload is None) == (row["record_type"] == "revisit")
    assert read(write(pages.limit(0))).count() == 0


def test_nearest(spark):
    from tidemill.llm.ann import nearest

    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[300:900] = x[0]  # a common vector
    rows = [(k, v.tolist(), "z") for k, v in enumerate(x)]
    rows += [(5000, None, "z"), (5020, [0.0] * 16, "z"), (5040, [float("nan")] * 16, "z"), (5060, [1.0], "z"), (None, x[1].tolist(), "z"), (5080, [None, *x[1].tolist()[1:]], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = nearest(df, k=10, every=20).collect()
    hit = total = 0
    for q in range(0, 1500, 20):
        s = np.array([np.cumsum(x[q] * v)[-1] for v in x])
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == s[r["vec_id"]] for r in mine)
        assert sorted(mine, key=lambda r: (-r["score"], r["vec_id"])) == mine
        hit += len({r["vec_id"] for r in mine} & set(best.tolist()))
        total += 10
    assert hit >= 0.9 * total and {r["query_id"] for r in got} == set(range(0, 1500, 20))
    assert nearest(df.limit(0)).count() == 0
    assert {r["vec_id"] for r in nearest(df.where("vec_id < 4"), k=10, every=20).collect()} == {1, 2, 3}


def test_nearest_recall_through_lists(spark, monkeypatch):
    """A table six times the sample: recall of the lists alone, and ranks of rows that share an id."""
    from tidemill.llm import ann

    monkeypatch.setattr(ann, "PER_LIST", 2)
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((200, 24))[rng.integers(0, 200, 9_600)] + 0.8 * rng.standard_normal((9_600, 24))).round(6)
    assert len(x) > 6 * ann.PER_LIST * int(8 * len(x) ** 0.5)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200, (x[7] * 3).tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), k=20, every=200).collect()
    every = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    hit = total = 0
    for q in range(0, 9_600, 200):
        mine = [r for r in got if r["query_id"] == q]
        for at in np.flatnonzero(ids == q) if q != 200 else []:
            s = every @ every[at]
            s[at] = -np.inf
            hit += len({r["vec_id"] for r in mine} & set(ids[np.argsort(-s)[:20]].tolist()))
            total += 20
    assert hit >= 0.9 * total
    assert sorted(r["rank"] for r in got if r["query_id"] == 200) == sorted([*range(1, 21)] * 2)


def test_nearest_answers_every_length(spark, monkeypatch):
    """Queries of a rarer length get their exact neighbours of that length; several blocks of them meet."""
    from tidemill.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(6)
    vectors = {d: {1000 * d + i: rng.standard_normal(d) for i in range(n)} for d, n in ((8, 200), (5, 50), (3, 7))}
    rows = [(i, v.tolist()) for group in vectors.values() for i, v in group.items()]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=9, every=5).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in rows if i % 5 == 0}
    for d in (5, 3):
        for q in (i for i in vectors[d] if i % 5 == 0):
            score = {i: float(np.cumsum(v * vectors[d][q])[-1]) for i, v in vectors[d].items() if i != q}
            want = sorted(score, key=lambda i: (-score[i], i))[:9]
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [(r["rank"], r["vec_id"], r["score"]) for r in mine] == [(k + 1, i, score[i]) for k, i in enumerate(want)]


def labelled(spark, n=600):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioust") for _ in range(rng.randint(2, 5)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zzidiot", "zzmoron", "zzscum", "zztrash"])
        if i % 7 == 3:
            w = ["".join(rng.choice("QXZ#$%9") for _ in range(6)) for _ in w]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 7 != 3), int(toxic)))
    rows += [(n, None, "en"), (n + 1, "", None), (None, "zzidiot zzmoron zzscum", "xx")]
    labels += [(None, 1, 1), (n + 7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    from tidemill.llm.registry import held_out
    from tidemill.llm.toxicity import Model, drop_toxic, fit, score

    docs, labels = labelled(spark)
    model = fit(docs, labels, usable=~held_out())
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1 and i % 7 != 3]
    wrong = sum((got[i]["predicted"] == 1) != (i % 5 == 0) for i in held)
    assert wrong <= 0.05 * len(held) and len(got) == 603
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[600]["predicted"] == 0
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 0}
    blank = fit(docs, labels.limit(0))
    assert isinstance(blank, Model) and score(docs.limit(0), model).count() == 0


def test_isotonic_is_monotone():
    from tidemill.llm.toxicity import isotonic

    x, y = isotonic(np.array([3.0, 1, 2, 2, 5, 4]), np.array([1.0, 0, 1, 0, 1, 0]))
    assert list(x) == sorted(x) and list(y) == sorted(y) and isotonic(np.empty(0), np.empty(0)) == ((), ())


def test_quality(spark):
    from tidemill.llm.quality import classify

    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    good, bad = [i for i in range(600) if i % 7 != 3], [i for i in range(600) if i % 7 == 3]
    assert sum(got[i]["keep"] for i in good) >= 0.99 * len(good) and sum(got[i]["keep"] for i in bad) == 0
    assert got[600]["perplexity"] is None and not got[600]["keep"] and not got[601]["keep"]
    assert got[None]["threshold"] is None and got[None]["keep"]


def test_kneser_ney_sums_to_one(spark):
    """Probabilities of all bytes after any context, seen or not, add up to one."""
    from tidemill.llm.quality import LANG_BITS, ORDER, lang_code, probabilities, train, write_shards
    from pyspark.sql import functions as F

    del LANG_BITS
    rows = spark.createDataFrame([("abracadabra abracadabra",), ("a bar a cab",)], "text string").select("text", lang_code(F.lit("en")).alias("code"))
    shards = write_shards(train(rows))
    code = rows.first()["code"]
    for context in (b"\0\0\0\0", b"abra", b"zzzz", b"zzza", b"cada"):
        g = int.from_bytes(context, "big") << 8
        keys = np.array([(code << 8 * ORDER) | g | b for b in range(256)], np.uint64)
        assert abs(probabilities(keys, shards).sum() - 1) < 1e-4


def test_pipeline_contract(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_leaks", "packing"]
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g h", "en", "s", 15), (4, "other words stand here", "en", "s", 22), (None, "a b c d e f g", None, None, None), (5, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    assert cp.repeated_passages(spark, docs, "").schema.names == docs.columns
    assert cp.packing(spark, docs, "").count() >= 6


def test_pipeline_stages_against_brute_force(spark, tmp_path, monkeypatch):
    """run() over a folder: the documents after each stage, and the ids of its windows."""
    import collections

    import corpus_pipeline as cp
    from test_text_operators import SPACE, LOW, brute_hits

    docs, labels = labelled(spark, 300)
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("aeioust") for _ in range(6)) for _ in range(n))
    leak, passage, near = text(60), text(50), text(90)
    planted = [(1000, " ".join(leak.split()[:30])), (1001, f"{text(30)} {' '.join(leak.split()[30:])}"), (1002, f"{text(20)} {passage}"), (1003, f"{passage} {text(20)}"), (1004, near), (1005, near + " more"), (1006, near + " more words"), (None, text(40)), (1007, text(40)), (1007, text(40))]
    rows = [(r["doc_id"], r["text"], r["lang"], "s", len(r["text"] or "")) for r in docs.collect()] + [(i, t, "en", "s", len(t)) for i, t in planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, leak)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    after, plain = {}, cp.stored

    def recorded(df, name):
        out = plain(df, name)
        after[name.removeprefix("pipeline-")] = [tuple(r) for r in out.collect()]
        return out

    monkeypatch.setattr(cp, "stored", recorded)
    windows = cp.run(spark, str(tmp_path)).collect()
    bag = collections.Counter

    clean = after["toxicity"]
    toxic = lambda r: "zz" in (r[1] or "")
    assert not bag(clean) - bag(rows) and sum(map(toxic, clean)) <= 0.05 * sum(map(toxic, rows))
    assert sum(not toxic(r) for r in clean) >= 0.97 * sum(not toxic(r) for r in rows)

    words = [SPACE.findall((r[1] or "").encode().translate(LOW)) for r in clean]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    group = list(range(len(clean)))
    for a in range(len(clean)):
        for b in range(a):
            if sets[a] and group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for g, r in zip(group, clean):
        if r[0] is not None and (g not in first or r[0] < first[g][0]):
            first[g] = r
    assert bag(after["near_duplicates"]) == bag(first.values()) + bag(r for r in clean if r[0] is None)

    before = [(r, SPACE.findall((r[1] or "").encode())) for r in after["near_duplicates"]]
    seen = bag(tuple(w[k : k + 35]) for _, w in before for k in range(len(w) - 34))
    want = []
    for r, w in before:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        t = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else r[1] or ""
        want.append((r[0], t, *r[2:4], len(t)))
    fixed = lambda r: (r[0], r[1] or "", *r[2:4], r[4] or 0)
    assert bag(map(fixed, after["repeated_passages"])) == bag(want)

    assert len(first) < len(clean) and sum(r[1] != w[1] for r, w in zip(after["near_duplicates"], want)) >= 2
    bad = {k[0] for k in brute_hits([(j, r[1]) for j, r in enumerate(after["repeated_passages"])], items) if k[4]}
    assert len(bad) == 2
    assert bag(after["benchmark_leaks"]) == bag(r for j, r in enumerate(after["repeated_passages"]) if j not in bad)

    pieces, ids = collections.defaultdict(list), reference_ids("word_bpe_49k.json", 1)
    for r in windows:
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    for i, t, *_ in after["benchmark_leaks"]:
        if i not in (None, 1007):
            assert sum((p for _, p in sorted(pieces[i])), []) == ids(t).tolist()
    assert set(pieces) == {r[0] for r in after["benchmark_leaks"]}

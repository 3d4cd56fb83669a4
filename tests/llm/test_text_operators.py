"""Every operator on texts against brute force, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("tidemill.llm")

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, chunk int, n_words string, words string, kept string, score string, bucket string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = text(60), [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "One"), (6, "two words"), (7, shared), (8, shared), (8, shared)]
    rows += [(10 + k, f"{text(20)} {shared} {text(rng.randint(0, 30))}") for k in range(6)]
    for k in range(12):
        near = list(base)
        for _ in range(k // 3):
            near[rng.randrange(120)] = word()
        rows.append((30 + k, " ".join(near)))
    rows += [(50, "x " * 200), (51, "ab cd " * 90), (52, "ab cd " * 40), (53, text(20_000)), (None, "no id here"), (54, text(34)), (55, " ".join(base[:35]))]
    rows += [(60, "w w w w\xa0w\x00w　w"), (61, "All Rights Reserved. Licensed under CC BY 4.0, all rights reserved"), (62, "This work is licensed under the GNU General Public License, version 3.")]
    return [(i, t, 7, "a", "b", "c", "d", "e") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows=()):
    return collections.Counter(rows)


def test_substring_dedup(docs, empty):
    from tidemill.llm.substring_dedup import dedup_substrings

    W = 35
    rows = [(r[0], SPACE.findall((r[1] or "").encode())) for r in corpus()]
    seen = collections.Counter(tuple(w[k : k + W]) for _, w in rows for k in range(len(w) - W + 1))
    want = bag()
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - W + 1):
            if seen[tuple(w[k : k + W])] > 1:
                gone[k : k + W] = [True] * W
        want[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    got = dedup_substrings(docs, window=W).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert bag(map(tuple, got)) == want
    kept = dedup_substrings(docs, window=W, keep=["bucket", "words"], verbatim=True).where("doc_id = 60").first()
    assert kept["kept_text"] == "w w w w\xa0w\x00w　w" and tuple(kept["kept"]) == ("e", "b")
    assert dedup_substrings(empty, window=W).count() == 0


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(docs, empty, n, num, den):
    from tidemill.llm.jaccard_join import jaccard_components

    rows = []
    for i, t, *_ in corpus():
        w = SPACE.findall((t or "").encode().translate(LOW))
        rows.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    comp = list(range(len(rows)))

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                comp[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = bag((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(rows))
    assert bag(map(tuple, jaccard_components(docs, n=n, threshold=(num, den)).collect())) == want
    assert jaccard_components(empty, n=n, threshold=(num, den)).count() == 0


def test_large_groups_are_split_into_blocks(spark):
    """More near copies than two places hold: places must lose no link."""
    from tidemill.llm.jaccard_join import PLACE, jaccard_components

    rng = random.Random(2)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(2 * PLACE + 60):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    comp = list(range(len(rows)))

    def find(k):
        while comp[k] != k:
            comp[k] = comp[comp[k]]
            k = comp[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in range(len(rows))}


def test_keep_first_compares_rows_of_one_group(spark, monkeypatch):
    """Rows that share an id and nothing else stay; of a group of near copies one row stays, also where the bitmap clears no row."""
    from tidemill.llm import jaccard_join
    from tidemill.llm.jaccard_join import keep_first

    text = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    kept = [(1, text("a"), "first of its group"), (2, text("b"), "b"), (2, text("c"), "c"), (3, text("d"), "d"), (None, text("a"), "no id"), (5, None, "null"), (5, "", "empty")]
    gone = [(2, text("a") + " more", "near copy of 1"), (4, text("d") + " more", "near copy of 3"), (4, text("d") + " more words", "near copy of 3")]
    # ids 6 and 7 are shared by near copies of one text and by texts of their own
    kept += [(6, text("e"), "e"), (6, text("f"), "f"), (7, text("g"), "g")]
    gone += [(7, text("e") + " more", "near copy of 6"), (9, text("g") + " more", "near copy of 7")]
    docs = spark.createDataFrame(kept + gone, "doc_id long, text string, number string").repartition(3)
    got = keep_first(docs)
    assert got.columns == docs.columns and bag(map(tuple, got.collect())) == bag(kept)
    same = spark.createDataFrame([(8, text("h"), "x")] * 3 + [(8, text("h") + " more", "x")], docs.schema)
    assert keep_first(same).count() == 1 and keep_first(docs.limit(0)).count() == 0
    full = spark.sparkContext.broadcast(np.full(4096, 255, np.uint8))
    monkeypatch.setattr(jaccard_join, "_bitmap", lambda table, key, n_rows: (1 << 15, full))
    assert bag(map(tuple, keep_first(docs).collect())) == bag(kept)


def brute_hits(rows, items, size=13):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").encode().translate(LOW))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    out = bag()
    for i, t in rows:
        w = ALNUM.findall((t or "").encode().translate(LOW))
        hit, found = set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out[(i, len(w), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


@pytest.mark.parametrize("block", [20_000, 40])
def test_decontamination(spark, docs, empty, block):
    from pyspark.sql import functions as F

    from tidemill.llm.decontamination import drop_contaminated, mark

    texts = {r[0]: r[1] for r in corpus()}
    items = [(1, " ".join(texts[12].split()[15:40])), (2, texts[7]), (10, "two WORDS"), (11, "one"), (12, None), (13, "..."), (14, texts[54].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in corpus()]
    got = mark(docs, bench, block=block).select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
    want = brute_hits(rows, items)
    assert bag(map(tuple, got)) == want
    clean = bag(w[0] for w in want.elements() if not w[4])
    assert bag(r["doc_id"] for r in drop_contaminated(docs, bench, block=block).collect()) == clean
    assert drop_contaminated(docs, bench, block=block).columns == docs.columns
    assert mark(empty, bench, block=block).count() == 0 and mark(docs, bench.limit(0), block=block).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [40, 20_000])
def test_decontamination_judges_rows_not_ids(spark, block):
    """Rows without an id and rows that share one are judged each by its own hits, in blocks as in one scan."""
    from tidemill.llm.decontamination import drop_contaminated, windows

    leak = " ".join(f"leak{k}" for k in range(80))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert 40 < windows(bench).count() < 20_000
    rows = [(None, leak, "bad"), (None, "clean words", "good"), (7, leak, "bad"), (7, "other clean words", "good"), (8, leak, "bad"), (9, None, "good")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string").repartition(3)
    got = drop_contaminated(docs, bench, block=block)
    assert got.columns == docs.columns and bag(map(tuple, got.collect())) == bag(r for r in rows if r[2] == "good")


def test_license_scan(docs, empty):
    from tidemill.llm.license_scan import BASE, scan

    want = bag()
    for i, t, *_ in corpus():
        w = ALNUM.findall((t or "").encode().translate(LOW))
        hits = [(k, label) for label, phrase in BASE for p in [phrase.encode().split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        want[(i, len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits})))] += 1
    got = scan(docs)
    assert bag(map(tuple, got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())) == want
    assert got.where("doc_id = 62").first()["labels"] == "gpl,gpl-3.0"
    assert scan(empty).count() == 0


def test_licence_labels_and_scores(spark):
    """Labels and scores by brute force, with texts that lack words of a notice, cut ones, and a word or phrase a million times."""
    import math

    from tidemill.llm.license_scan import BASE, NOTICES, TEXTS, scan

    rng = random.Random(11)
    texts = [None, "", "licence", "mit " * 3, "Released under the MIT License.", "the mit license", "license " * 200_000, "cc by " * 100_000, "mit license " * 50_000]
    for _, notice, key in (*NOTICES, *TEXTS):
        words = notice.split()
        texts += [notice.upper(), " ".join(words[1:]), "x y " + " ".join(w for w in words if rng.random() < 0.8 or w in key.split()) + " z", " ".join(w if rng.random() < 0.7 else "other" for w in words), f"{notice} and {rng.choice(NOTICES)[1]}"]
    rows = list(enumerate(texts)) + [(None, texts[9]), (3, texts[10])]
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["labels"], round(r["score"], 9)) for r in scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    docs = [[w.decode() for w in ALNUM.findall((t or "").encode().translate(LOW))] for _, t in rows]
    vocab = {w for _, phrase in BASE for w in phrase.split()} | {w for _, t, _ in (*NOTICES, *TEXTS) for w in t.split()}
    count = collections.Counter(w for d in docs for w in set(d) & vocab)
    idf = {w: math.log(1 + len(docs) / (1 + count[w])) for w in vocab}
    want = collections.Counter()
    for (i, _), w in zip(rows, docs):
        labels, score, n_base, at = set(), 0.0, 0, collections.defaultdict(list)
        for k, x in enumerate(w):
            at[x].append(k)
        for label, phrase in BASE:
            p = phrase.split()
            here = sum(w[k : k + len(p)] == p for k in at[p[0]])
            n_base += here
            if here:
                labels.add(label)
                score = 1.0
        for label, text, key in (*NOTICES, *TEXTS):
            t, p = text.split(), key.split()
            off = next(k for k in range(len(t)) if t[k : k + len(p)] == p)
            seen = set()
            for k in at[p[0]]:
                if w[k : k + len(p)] == p and (near := tuple(w[max(0, k - off) : k - off + len(t)])) not in seen:
                    seen.add(near)
                    share = sum(idf[x] for j, x in enumerate(t) if 0 <= k - off + j < len(w) and w[k - off + j] == x) / sum(idf[x] for x in t)
                    if share >= 0.6:
                        labels.add(label)
                        score = max(score, min(share, 1.0))
        want[i, len(w), n_base, ",".join(sorted(labels)), round(score, 9)] += 1
    assert got == want


def test_queries_of_groups_name_each_pair_and_few_twice():
    import numpy as np
    import pyarrow as pa

    from tidemill.llm import jaccard_join as J

    rng = np.random.default_rng(1)
    named = distinct = 0
    for _ in range(100):
        m, vocab = int(rng.integers(2, 60)), int(rng.integers(3, 60))
        shingles = rng.integers(1, 2**63, vocab).astype(np.uint64)  # their places are the global order
        sets = [shingles[np.sort(rng.choice(vocab, rng.integers(0, min(vocab, 14)), replace=False))] for _ in range(m)]
        grp, comp = rng.integers(0, 8, m), rng.integers(0, 5, m)
        weight = np.bincount(grp)[grp]
        batch = pa.RecordBatch.from_pydict({"sid": np.arange(m), "grp": grp, "comp": comp, "weight": weight, "band": np.ones(m, np.int64), "rare": pa.array([s.tobytes() for s in sets], pa.binary())})
        buckets = collections.defaultdict(lambda: collections.defaultdict(list))
        for out in J._offer_rare(5)([batch]):
            for r in out.to_pylist():
                for c in out.schema.names:
                    buckets[r["bucket"]][c].append(r[c])
        got = [p for held in buckets.values() for out in J._queries(held) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        asks = lambda x, y: (weight[x], grp[x]) <= (weight[y], grp[y])
        want = {(x, int(grp[y])) for x in range(m) for y in range(m) if comp[x] != comp[y] and asks(x, y) and set(sets[x].tolist()) & set(sets[y].tolist())}
        assert set(got) == want
        named, distinct = named + len(got), distinct + len(want)
    assert named < 2 * distinct


def test_a_set_and_a_group_are_named_once():
    """Two sets with many common shingles behind others that only one of them has: one bucket names them, not that of each shingle."""
    import pyarrow as pa

    from tidemill.llm import jaccard_join as J

    rare = [np.append(np.arange(1, 13) + 20 * k, np.arange(100, 140)).astype(np.uint64).tobytes() for k in range(2)]
    sets = pa.RecordBatch.from_pydict({"sid": [1, 2], "grp": [1, 2], "comp": [1, 2], "weight": [1, 2], "band": [3, 3], "rare": rare})
    held = {}
    for row in (r for b in J._offer_rare(997)(iter([sets])) for r in b.to_pylist()):
        for name, v in row.items():
            held.setdefault(row["bucket"], {}).setdefault(name, []).append(v)
    named = [tuple(p.values()) for h in held.values() for b in J._queries(h) for p in b.to_pylist()]
    assert named == [(1, 2)]


def in_buckets(batches):
    """The rows of packed batches as their bucket's reader gets them."""
    out = collections.defaultdict(lambda: collections.defaultdict(list))
    for b in batches:
        for r in b.to_pylist():
            for c, v in r.items():
                out[r["bucket"]][c].append(v)
    return out.values()


@pytest.mark.parametrize("num,den", [(4, 5), (9, 10), (1, 3)])
def test_queries_in_reach_lose_no_link(num, den):
    """Families around the threshold: any two sets of different components that link are named, by either of them."""
    import pyarrow as pa

    from tidemill.llm import jaccard_join as J

    measure, rng, links, named, distinct = J.Measure(num, den), np.random.default_rng(3), 0, 0, 0
    for _ in range(60):
        m, vocab = int(rng.integers(2, 50)), int(rng.integers(4, 90))
        shingles = np.unique(rng.integers(1, 2**63, vocab).astype(np.uint64))
        base, sets = rng.random(len(shingles)) < 0.8, []
        for _ in range(m):
            own = base ^ (rng.random(len(base)) < rng.choice([0.02, 0.06, 0.2, 0.6]))
            own[rng.integers(len(own))] = True
            sets.append(shingles[own])
        comp, chunk, size = rng.integers(0, 1 + m // 2, m), rng.integers(0, 3, m).astype(np.int32), np.array([len(s) for s in sets])
        packed = pa.array([s.tobytes() for s in sets], pa.binary())
        offers = J._offer_owned(5)([pa.RecordBatch.from_pydict({"size": size, "chunk": chunk, "comp": comp, "shingles": packed})])
        replies = pa.Table.from_batches([b for held in in_buckets(offers) for b in J._mixed(held)], J._MIXED)
        scarce = {}
        for c in range(3):
            mine = pa.table({"sid": np.flatnonzero(chunk == c), "shingles": packed.take(pa.array(np.flatnonzero(chunk == c)))})
            for r in J._scarce_shingles(measure)(mine, replies.filter(pa.compute.equal(replies["chunk"], c))).to_pylist():
                scarce[r["sid"]] = r
                others = {x for k in range(m) if comp[k] != comp[r["sid"]] for x in sets[k].tolist()}
                assert r["known"] == len(others.intersection(sets[r["sid"]].tolist()))
        left = np.array(sorted(scarce), np.int64)
        got = []
        if len(left):
            band = np.array([(measure.bands(200) <= size[k]).sum() for k in left])
            grp = 10 * band + rng.integers(0, 4, len(left))
            weight, smallest = np.array([(grp == g).sum() for g in grp]), np.array([size[left[grp == g]].min() for g in grp])
            batch = pa.RecordBatch.from_pydict({"sid": left, "grp": grp, "comp": comp[left], "weight": weight, "band": band, "smallest": smallest, "size": size[left], "known": [scarce[k]["known"] for k in left], "rare": pa.array([scarce[k]["rare"] for k in left], pa.binary())})
            got = [p for held in in_buckets(J._offer_rare(5, measure)([batch])) for out in J._queries(held) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
            of = dict(zip(left.tolist(), grp.tolist()))
        for x in range(m):
            for y in range(x):
                if comp[x] != comp[y] and measure.links(len(np.intersect1d(sets[x], sets[y])), size[x], size[y]):
                    assert x in of and y in of and ((x, of[y]) in got or (y, of[x]) in got)
                    links += 1
        named, distinct = named + len(got), distinct + len(set(got))
    assert links > 100 and named < 2 * distinct


def test_family_below_the_threshold_asks_few_groups(spark, monkeypatch):
    """Copies that are too different to link asked every group of their family; the few that link are still found."""
    from tidemill.llm import jaccard_join as J

    rng = random.Random(7)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(700):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 3, 4, 5, 6, 7, 8])):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) for w in (t.split() for _, t in rows)]
    comp = list(range(len(rows)))

    def find(k):
        while comp[k] != k:
            comp[k] = comp[comp[k]]
            k = comp[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    asked, store = [], J.Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        if name == "asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(J.Scratch, "store", counted)
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, threshold=(4, 5)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert 1 < len(set(got.values())) < len(rows) and sum(asked) < len(rows)

import random
import re

import numpy as np

from tracefold.llm import groups, ngram_join
from tracefold.llm.ngram_join import keep_one_per_group, ngram_components, t_occurrences

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, b long"


def brute(rows, size=5, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in sets}


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.randint(1, 90))
        if rng.random() < 0.4:
            words[:0] = passage
        rows.append(words)
    for _ in range(80):
        words = list(rng.choice(rows))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(words)
    texts = [" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper() for w in rows] + [None, "", " \t\n", "one", "ONE", "ünï\x85cod x y"]
    ids = rng.sample(range(-50, 1000), len(texts))
    return list(zip(ids, texts))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in rows], DOCS)
    return {tuple(r) for r in ngram_components(df).collect()}


def test_against_brute_force(spark):
    rows = made(1)
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies_and_long_text(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000, " ".join(f"u{i}" for i in range(60_000))), (1001, " ".join(f"u{i}" for i in range(59_000)))]
    got = run(spark, rows)
    assert {c for i, _, c in got if i < 1000} == {0} and {c for i, _, c in got if i >= 1000} == {1000}


def test_empty_repeated_and_null_ids(spark):
    assert run(spark, []) == set()
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "x"), (7, None)]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)
    got = sorted((str(x) for x in map(tuple, ngram_components(df).collect())))
    assert got == sorted(map(str, [(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (7, 0, 7)]))
    kept = [r.doc_id for r in keep_one_per_group(df).collect()]
    assert sorted(map(str, kept)) == ["5", "7", "None", "None"]


def test_divide_skip_counts():
    rng = random.Random(5)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 8)
        counts = {x: sum(x in y for y in lists) for x in range(30)}
        for mu in (0.0085, 1.0, 100.0):
            assert t_occurrences(lists, least, mu) == {x: c for x, c in counts.items() if c >= least}


def loose(seed, n=90):
    """Copies of one text with many changes each: near to some others only."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(160)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(160)] = f"w{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    return rows


def test_loose_groups_in_several_parts(spark, monkeypatch):
    """Groups of many parts, hot keys among them, against all pairs."""
    rows = loose(8) + [(1000 + i, t) for i, t in loose(9)] + [(2000 + i, t) for i, t in made(4) if i >= 0]
    monkeypatch.setattr(groups, "BLOCK", 15)
    monkeypatch.setattr(groups, "HEAVY", 40)
    want = brute(rows)
    assert run(spark, rows) == want and 5 < len({c for i, _, c in want if i < 90}) < 90


def test_links_come_from_the_search(spark, monkeypatch):
    """Without what the T-occurrence search returns, no two different sets link."""
    rows = [(i, t) for i, t in made(1)]
    assert any(i != c for i, _, c in run(spark, rows))
    monkeypatch.setattr(ngram_join, "t_occurrences", lambda *_: {})
    sets = {}
    for i, n, c in run(spark, rows):
        sets.setdefault(c, set()).add(n)
    assert all(len(x) == 1 for x in sets.values())


def test_blocks_link_what_all_pairs_link():
    rng = random.Random(12)
    for _ in range(30):
        base = [rng.sample(range(60), 30) for _ in range(3)]
        rows = []
        for i in range(25):
            own = set(rng.choice(base)) ^ set(rng.sample(range(60), rng.randint(0, 6)))
            rows.append((i, i if rng.random() < 0.8 else 0, len(own), np.array(sorted(own), np.uint64).tobytes()))
        root = {r[1]: r[1] for r in rows}

        def find(held, x):
            while held[x] != x:
                x = held[x]
            return x

        def join(held, a, b):
            x, y = find(held, a), find(held, b)
            held[max(x, y)] = min(x, y)

        got, sets = dict(root), [set(np.frombuffer(r[3], np.uint64).tolist()) for r in rows]
        for i in range(25):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    join(root, rows[i][1], rows[j][1])
        for a, b in ngram_join.search_block(rows, 75):
            join(got, rows[a][1], rows[b][1])
        assert {x: find(got, x) for x in got} == {x: find(root, x) for x in root}


def test_large_blocks_of_near_copies_are_searched_fast():
    import time

    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        words = np.arange(1, 401)
        for at in rng.choice(360, 25, replace=False):  # 25 changed words in 400, each in one place of its own
            words[at] = rng.integers(1000, 1 << 40)
        own = np.unique(words).astype(np.uint64)
        rows.append((i, i, len(own), own.tobytes()))
    sets = [frozenset(np.frombuffer(r[3], np.uint64).tolist()) for r in rows]
    began = time.process_time()
    links = ngram_join.search_block(rows, 90)
    took = time.process_time() - began
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    assert len(links) == len(rows) - len({find(i) for i in range(len(rows))})
    assert took < 2.5

import random

import numpy as np

from tracefold.llm import groups, line_dedup

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_blocks_decide_all_pairs():
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        line = list("".join(rng.choices(LETTERS, k=120)))
        for _ in range(3):
            rows.append((len(rows), len(rows), "".join(line)))
            line[rng.randrange(120)] = rng.choice(LETTERS)
            line[rng.randrange(120)] = rng.choice(LETTERS)
    root = {r[0]: r[0] for r in rows}
    want = dict(root)

    def join(held, a, b):
        x, y = held[a], held[b]
        for k in held:
            if held[k] == max(x, y):
                held[k] = min(x, y)

    sets = [line_dedup.shingles(r[2]) for r in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 75 * len(x | y):
                join(want, rows[i][0], rows[j][0])
    for a, b in line_dedup.block_links(rows, 75):
        join(root, a, b)
    assert root == want and len(set(root.values())) < len(rows)


def test_pairs_of_a_band_that_no_centre_joins_go(spark, monkeypatch):
    """Loose lines of one template, in several blocks: near lines that share a band still meet."""
    rng = random.Random(6)
    head = "".join(rng.choices(LETTERS, k=160))
    rows = [(i, head + "".join(rng.choices(LETTERS, k=30))) for i in range(600)]
    rows += [(1000 + i, t[:180] + "".join(rng.choices(LETTERS, k=10))) for i, t in rows[:20]]
    monkeypatch.setattr(groups, "BLOCK", 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: line_dedup.shingles(t) for i, t in rows}
    bands = dict(zip(sets, map(set, line_dedup.band_keys([t for _, t in rows]).tolist())))
    near = [(i, j) for i in sets for j in sets if j < i and bands[i] & bands[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()}
    assert len(near) >= 15 and {i for i, _ in near} == gone


def all_pairs(rows):
    """Documents that lose a line, each of one line: all pairs compared."""
    sets = {i: line_dedup.shingles(line_dedup.normal(t)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) != i}


def test_loose_groups_with_hot_bands_against_all_pairs(spark, monkeypatch):
    """Loose groups of 120 near lines, bands of over half of HEAVY lines among them."""
    rng = random.Random(11)
    rows = []
    for _ in range(3):
        base = rng.choices(LETTERS, k=150)
        for _ in range(120):
            line = list(base)
            for _ in range(2):
                line[rng.randrange(150)] = rng.choice(LETTERS)
            rows.append((len(rows), "".join(line)))
    monkeypatch.setattr(groups, "HEAVY", 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()}
    assert gone == all_pairs(rows) and len(gone) > 300


def test_edge_rows_and_clashing_names(spark):
    """Nulls, blanks, repeated rows, a very long line, columns of the names used inside, and an empty table."""
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, "one line that is here twice\r\n\n  one  line\tthat is here twice", 9), (2, None, 9), (3, "", 9), (None, "one line that is here twice", 9)]
    rows += [(4, "only here, once\nx", 9), (4, "only here, once\nx", 9), (5, long, 9), (6, long + " end", 9), (7, "\n \n", 9)]
    names = "_doc_id long, text string, _gone int, gone int, `row` int, k1 int, `a b` int, component int, doc_id long, n_chars int"
    df = spark.createDataFrame([(i, t, g, g, g, g, g, g, i, None) for i, t, g in rows], names)
    got = sorted(line_dedup.clean_lines(df).collect(), key=str)
    assert len(got) == len(rows) and all(r["_gone"] == r["a b"] == r["row"] == 9 and r["_doc_id"] == r.doc_id for r in got)
    texts = sorted((str(r.doc_id), str(r.text)) for r in got)
    assert texts == sorted([("1", "one line that is here twice\r\n"), ("2", "None"), ("3", ""), ("None", "one line that is here twice"), ("4", "only here, once\nx"), ("4", "only here, once\nx"), ("5", long), ("6", ""), ("7", "\n \n")])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert line_dedup.clean_lines(df.limit(0)).count() == 0 == line_dedup.dedup_lines(df.limit(0)).count()


def test_numbers_of_shingles():
    """Equal numbers for equal shingles only: Latin text, other scripts, very many characters, and zero characters."""
    wide = "".join(map(chr, range(0x4E00, 0x4F80)))
    for lines in (["abcdefghij", "xbcdefghij", "abc", ""], ["Straße „eins“ und zwei", "Straße „eins“ und drei", "日本"], [wide, wide[3:], "x"], ["abc", "abc\0\0\0\0\0", "abc\0\0\0\0\0d"]):
        got, want = line_dedup.numbered(lines), [line_dedup.shingles(x) for x in lines]
        for x, p in zip(got, want):
            for y, q in zip(got, want):
                assert len(np.intersect1d(x, y)) == len(p & q) and len(x) == len(p)

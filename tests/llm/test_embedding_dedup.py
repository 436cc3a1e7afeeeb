import numpy as np

from tracefold.llm import embedding_dedup
from tracefold.llm.common import components


def test_parts_of_a_tight_group_hold_together(spark):
    """One group that falls whole into one bucket of several parts, at rounding-level noise."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal(64)
    rows = [(i, "x", [float(x) for x in base + rng.standard_normal(64) * 1e-4]) for i in range(1000)]
    reps = spark.createDataFrame(rows, "id long, label string, vec array<float>")
    comp = components(embedding_dedup.search(reps, 4, 0, embedding_dedup.THRESHOLD))
    assert comp.count() == 1000 and comp.select("component").distinct().count() == 1


def test_rows_are_compared_when_recall_stays_short(spark, monkeypatch):
    """Searches that find nothing: the audits see it and all rows of a label are compared, in several blocks."""
    rng = np.random.default_rng(8)
    base = np.repeat(rng.standard_normal((60, 16)), 2, axis=0)
    rows = [(i, [float(x) for x in v + rng.standard_normal(16) * 0.01], "x") for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(embedding_dedup, "search", lambda *_: none)
    monkeypatch.setattr(embedding_dedup, "AUDIT", 4)
    monkeypatch.setattr(embedding_dedup, "AUDITS", 2, raising=False)
    monkeypatch.setattr(embedding_dedup, "WHOLE", 50, raising=False)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (1, i - i % 2) for i in range(120)}


def test_isolated_pairs_in_a_strong_common_direction(spark):
    """Background at cosine 0.94, pairs at 0.99: every pair is found."""
    rng = np.random.default_rng(9)
    common = rng.standard_normal(64)
    common /= np.linalg.norm(common)
    own = rng.standard_normal((1500, 64))
    own -= np.outer(own @ common, common)
    own /= np.linalg.norm(own, axis=1)[:, None]
    base = np.sqrt(0.94) * common + np.sqrt(0.06) * own
    pairs = np.concatenate([base, base[:100] + rng.standard_normal((100, 64)) * 0.01])
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(pairs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    m = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    near = embedding_dedup.cosines(m, m) >= embedding_dedup.THRESHOLD
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(m))}


def test_dense_groups_joined_by_one_bridge(spark):
    """20 pairs of dense groups, each joined by one link: ids, counts and components against brute force."""
    rng = np.random.default_rng(10)
    vecs = []
    for _ in range(20):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        side = rng.standard_normal(64)
        side -= (side @ a) * a
        side /= np.linalg.norm(side)
        turn = [np.cos(x) * a + np.sin(x) * side for x in (0.0, 0.14, 0.32, 0.46)]  # 0.18 lies within the threshold, 0.32 doesn't
        vecs += [turn[1], turn[2]]
        for c in (turn[0], turn[3]):
            vecs += [c + rng.standard_normal(64) * 0.002 for _ in range(60)]
    vecs += [rng.standard_normal(64) for _ in range(300)]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    m = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    near = embedding_dedup.cosines(m, m) >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    comp = np.arange(len(m))
    while True:
        least = np.minimum(comp, np.where(near, comp[None, :], len(m)).min(axis=1))
        if (least == comp).all():
            break
        comp = least
    assert len(set(comp.tolist())) == 320
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(m))}


def test_rows_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.5]
    rows = [(1, one, "x"), (2, one, "x"), (2, one, "x"), (3, one, None), (4, None, "x"), (5, [], "x"), (6, [0.0, 0.0, 0.0], "x"), (7, [nan, 1.0, 1.0], "x"), (8, [inf, 1.0, 1.0], "x")]
    rows += [(9, [None, 1.0, 1.0], "x"), (None, one, "x"), (10, one, "y"), (11, [1.0, 0.0], "x"), (12, [-1.0, 0.0, -0.5], "x")]
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], "vec_id long, embedding array<float>, label string, id int, component int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12))]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0

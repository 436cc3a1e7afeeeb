import collections
import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from test_ngram_join import brute
from test_operators import WORD, repeats

from tracefold.llm import line_dedup, mixing, sentencepiece_nbest

SF = "/root/testdata/sf0.001"


def lines_left(rows):
    """All pairs of lines compared; of each component the first line stays."""
    places = collections.defaultdict(list)
    for i, t in sorted(rows.items()):
        for k, line in enumerate((t or "").split("\n")):
            if line_dedup.normal(line):
                places[line_dedup.normal(line)].append((i, k))
    names = list(places)
    sets = [line_dedup.shingles(x) for x in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= 75 * (len(x) + len(y) - same):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    members = collections.defaultdict(list)
    for a, name in enumerate(names):
        members[find(a)] += places[name]
    gone = {p for m in members.values() for p in m if p != min(m)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows.items()}


def test_stages_against_brute_force(spark):
    """Each stage on its own input, over the documents of the smallest table that are short enough to compare all lines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 6000)
    stages = dict(corpus_pipeline.STAGES)
    names, frames, rows = list(stages), [docs], [docs.collect()]
    for name in names:
        frames.append(stages[name](spark, frames[-1], SF))
        rows.append(frames[-1].collect())
        if name != names[-1]:
            frames[-1] = spark.createDataFrame(rows[-1], docs.schema)
            assert frames[-1].columns == docs.columns
    source, good, lines, groups, mixed, coded = rows

    kept = {r.doc_id for r in good}
    for r in source:
        w = WORD.findall(r.text or "")
        assert r.doc_id not in kept or not (len(w) < 50 or 100 * repeats(w) > 50 * len(w))
    assert len(kept) > len(source) / 3 and all(r in source for r in good)

    want = lines_left({r.doc_id: r.text for r in good})
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines if r.text)

    heads = {i for i, _, c in brute([(r.doc_id, r.text) for r in lines]) if i == c}
    assert sorted(r.doc_id for r in groups) == sorted(heads)

    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in groups}
    reads = collections.Counter(r.doc_id for r in mixed)
    plan = {r.doc_id: r for r in mixing.mix_plan(frames[3]).collect()}
    taken = collections.Counter()
    for r in groups:
        assert reads[r.doc_id] <= 3 and reads[r.doc_id] * size[r.doc_id] == plan[r.doc_id].taken
        taken[r.source] += reads[r.doc_id] * size[r.doc_id]
    for r in groups:
        assert abs(taken[r.source] - plan[r.doc_id].target) <= 2 * max(size.values())

    lattice = sentencepiece_nbest.lattice(sentencepiece_nbest.MODEL)
    model, _ = sentencepiece_nbest.coder(sentencepiece_nbest.MODEL, 4)
    texts = {r.doc_id: r.text for r in mixed}
    assert collections.Counter(r.doc_id for r in coded) == reads
    for r in coded:
        assert r.round_trip and r.ids_sha256 == hashlib.sha256(model.encode(texts[r.doc_id])[0]).hexdigest()
    for r in coded[:10]:  # the best N of all paths through the lattice of the whole text, words not split
        word, into = " " + texts[r.doc_id], collections.defaultdict(list)
        pieces = []
        for m in sentencepiece_nbest.CHUNKS.finditer(word):
            pieces += [(m.start() + a, m.start() + b, s) for a, b, s, _ in lattice.edges(m[0])]
        for a, b, s in pieces:
            into[b].append((a, s))
        best = [[0.0]]
        for b in range(1, len(word) + 1):
            best.append(sorted((x + s for a, s in into[b] for x in best[a]), reverse=True)[:4])
        assert len(r.scores) == len(best[-1]) and all(abs(x - y) < 1e-6 for x, y in zip(r.scores, best[-1]))


def test_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

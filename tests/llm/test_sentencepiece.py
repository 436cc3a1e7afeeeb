import hashlib
import itertools
import random

import numpy as np

from tracefold.llm import sentencepiece_nbest

TEXTS = ["hello big world", "a b", "aa aa aa", "x\n\ty ▁ é☃", "  two  spaces ", "", None, "the same word the same word", "abcd"]


def test_all_n_segmentations_come_out(spark):
    lattice = sentencepiece_nbest.lattice(sentencepiece_nbest.MODEL)
    _, back = sentencepiece_nbest.coder(sentencepiece_nbest.MODEL, 4)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    coded = {r.doc_id: r for r in sentencepiece_nbest.encode_docs(docs).collect()}
    digest = {r.doc_id: r for r in sentencepiece_nbest.digests(docs).collect()}
    for i, text in enumerate(TEXTS):
        r, d = coded[i], digest[i]
        raw = [np.array(x, "<i4").tobytes() for x in r.nbest_ids]
        assert len(raw) == len(r.scores) == len(set(raw)) and r.ids == r.nbest_ids[0] and list(d.scores) == list(r.scores)
        assert d.nbest_sha256 == [hashlib.sha256(x).hexdigest() for x in raw] and d.ids_sha256 == d.nbest_sha256[0]
        assert d.nbest_pieces == [len(x) for x in r.nbest_ids] and d.round_trip
        assert all(back.decode(x) == (text or "") for x in raw)
        if text:
            score = {}
            for m in sentencepiece_nbest.CHUNKS.finditer(" " + text):
                for _, _, s, ids in lattice.edges(m[0]):
                    score[(ids,) if type(ids) is int else tuple(ids)] = s
            for ids, total in zip(r.nbest_ids, r.scores):  # the ids have the score that stands beside them
                best = [0.0] + [-np.inf] * len(ids)
                for a, b in itertools.combinations(range(len(ids) + 1), 2):
                    best[b] = max(best[b], best[a] + score.get(tuple(ids[a:b]), -np.inf))
                assert abs(best[-1] - total) < 1e-9
    assert len(coded[0].nbest_ids) == 4


def test_ties_and_long_runs():
    """Runs of one character have very many equal paths; memory stays linear, and the order of equals is fixed."""
    model, back = sentencepiece_nbest.coder(sentencepiece_nbest.MODEL, 4)
    for text in ("a" * 100_000, "ab" * 20_000, "é☃" * 5_000, "a b " * 20_000):
        found, scores = model.encode_all(text)
        whole = [b"".join(x) for x in found]
        assert len(set(whole)) == len(whole) and scores == sorted(scores, reverse=True)
        assert all(back.decode(x) == text for x in whole)
        model.forget()
        assert [b"".join(x) for x in model.encode_all(text)[0]] == whole


def test_nbest_against_all_paths():
    """All paths of short words: the N best scores, and exactly equal sums for paths of equal pieces."""
    lattice = sentencepiece_nbest.lattice(sentencepiece_nbest.MODEL)
    for word in (" aaaaaa", " theother", "☃a▁b", " a", "\n", "      x"):
        paths = [[(0.0, ())]] + [[] for _ in word]
        for a, b, s, ids in lattice.edges(word):
            paths[b] += [(x + s, (*p, *ids)) for x, p in paths[a]]
        want = sorted((x for x, _ in paths[-1]), reverse=True)
        got = lattice.nbest(word, 6)
        assert [x for x, _ in got] == want[:6] and len({p for _, p in got}) == len(got)
        assert all(dict((p, x) for x, p in paths[-1])[p] == x for x, p in got)
        first, gap, ids = lattice.best_and_gap(word)
        assert first == want[0] and tuple(ids) == got[0][1] and gap == (want[0] - want[1] if len(want) > 1 else np.inf)


def test_edge_rows(spark):
    rows = [(1, "x y", 1), (1, "x y", 1), (None, "x y", 1), (2, None, 1), (3, "", 1), (4, "word " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("scores", sentencepiece_nbest.F.lit(1))
    got = sorted(sentencepiece_nbest.digests(df).collect(), key=str)
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "None"] and all(r.round_trip for r in got)
    assert len({r.ids_sha256 for r in got}) == 3 and {r.n_pieces for r in got if r.doc_id in (2, 3)} == {0}
    assert sentencepiece_nbest.digests(df.limit(0)).count() == 0 == sentencepiece_nbest.encode_docs(df.limit(0)).count()


def test_new_words_are_solved_together(monkeypatch):
    """Common words go through the passes together, a few rests and long words alone; the results are those of one at a time."""
    lattice = sentencepiece_nbest.lattice(sentencepiece_nbest.MODEL)
    rng = random.Random(7)
    signs = ["a", "b", "th", "ing", "e", "S", "▁", "é", "☃", "日", "𝔘", "\ud800", "\0"]
    words = sorted({" " * rng.randrange(3) + "".join(rng.choices(signs, k=rng.randrange(1, 20))) for _ in range(3_000)}, key=len, reverse=True)
    alone, calls = lattice.best_and_gap, []
    first, gap, ends, ids = lattice.best_and_gap_all(words)
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        assert (first[k], gap[k], ids[a:b].tolist()) == alone(words[k])

    monkeypatch.setattr(lattice, "best_and_gap", lambda w: calls.append(w) or alone(w))
    code = sentencepiece_nbest.Coder(lattice, 4)
    text = " ".join(f"w{i}x" for i in range(5_000)) + " " + "ab" * 200
    got = b"".join(code.encode_all(text)[0][0])
    assert len(calls) < 100 and " " + "ab" * 200 in calls
    split = [x for w in sentencepiece_nbest.CHUNKS.findall(" " + text) for x in alone(w)[2]]
    assert np.frombuffer(got, "<i4").tolist() == split
    calls.clear()
    texts = ["", "z y x", *(f"q{i} q{i}" for i in range(500)), ""]
    many = list(code.encode_texts(texts))
    assert len(calls) < 100 and many == [sentencepiece_nbest.Coder(lattice, 4).encode_all(t) for t in texts]

import collections
import hashlib
import random
import re

import numpy as np

from tracefold.llm import chat, embedding_dedup, html_text, line_dedup, mixing, quality, sentencepiece_nbest, substring_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words long, line_no long, key long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "x " * 30_000)]


def docs(spark, rows, source=lambda i: f"s{i % 3}" if i % 7 else None):
    return spark.createDataFrame([(i, t, "en", source(i or 0), None, 1, 2, 3) for i, t in rows], DOCS)


def random_texts(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    return [(i, "\n".join([" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))), *([passage] if rng.random() < 0.4 else []), " ".join(rng.choices(vocabulary, k=9))])) for i in range(n)]


def repeats(w):
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    return len({i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)})


def test_quality_counts(spark):
    rows = random_texts(1) + EDGE + [(7, "a b c d a b c # $ a b c\na b c # $ a b c"), (None, "same\nsame\n\n")]
    got = quality.quality(docs(spark, rows)).collect()
    want = {}
    for (i, t), r in zip(rows, sorted(got, key=lambda r: [k for k, x in enumerate(rows) if x[0] == r.doc_id and len(WORD.findall(x[1] or "")) == r.n_words][0])):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * want[4] > 50 * len(w)) and not (r.kept and r.base_failed)


def test_mixing_meets_targets(spark):
    rows = random_texts(2, 200) + EDGE[:4]
    got = mixing.mix_plan(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 150 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in got)) < 1e-6
    assert mixing.mix_plan(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, rows)).count() == sum(r.taken // r["size"] for r in got if r["size"])


def test_substrings_against_brute_force(spark):
    rows = random_texts(3) + EDGE + [(50, random_texts(3)[0][1])]
    first, want = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first.get(tuple(w[k : k + 13]), i) < i for j in range(13)}
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs(spark, rows)).collect()}
    assert got == want and substring_dedup.digests(docs(spark, [])).count() == 0


def test_near_lines_go(spark):
    line = "the quick brown fox jumps over the lazy dog again and again until the evening"
    rows = [(2, line.replace("quick", "quack") + "\nother words entirely"), (1, f"{line}\n\n{line}"), (3, line), *EDGE]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1] == (3, 1, f"{line}\n") and got[2] == (2, 1, "other words entirely") and got[3] == (1, 1, "") and got[900] == (0, 0, None) and got[904][1] == 0
    assert line_dedup.clean_lines(docs(spark, rows)).columns == docs(spark, []).columns


def test_near_lines_of_a_loose_group_go(spark):
    """Copies of one line that differ from each other more than from it: most are near to few others."""
    from test_pipeline import lines_left

    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(2000)]
    rows = []
    for g in range(3):
        base = rng.choices(vocabulary, k=60)
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == lines_left(dict(rows))


def test_links_of_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + rng.standard_normal(16) * 0.05], i % 2 if i % 9 else None) for i in range(200)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], 0), (504, rows[0][1], 0), (505, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vec = {r.vec_id: (np.array(r.embedding, float), r.label) for r in df.collect() if r.embedding and None not in r.embedding and r.label is not None and np.isfinite(r.embedding).all() and any(r.embedding)}
    n = {i: sum(1 for j, (y, m) in vec.items() if j != i and m == k and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98) for i, (x, k) in vec.items()}
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: n.get(i, 0) for i, *_ in rows}


def test_n_best_is_exact_and_decodes():
    lattice = sentencepiece_nbest.lattice(sentencepiece_nbest.MODEL)
    code, back = sentencepiece_nbest.coder(sentencepiece_nbest.MODEL, 4)
    for text in ("hello big world", "a b", "x\n\ty ▁ é☃", "  two  spaces ", "", "퟿" * 3):
        ids, scores = code.encode(text)
        assert back.decode(ids) == text
        paths = {0: [0.0]}
        word = " " + text
        for b in range(1, len(word) + 1):
            paths[b] = sorted((s + e[2] for e in lattice.edges(word) if e[1] == b for s in paths[e[0]]), reverse=True)[:4]
        if text:
            assert np.allclose(scores, paths[len(word)][: len(scores)])


def test_main_text():
    page = '<html><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>two<br>three &lt;x&gt;<p>Four\n five<script>var p="</p>"</script></article><div id=comments><p>nice</div><footer>x</footer>'
    assert html_text.main_text(page) == "A & B\nOne two three <x>\nFour five"
    plain = "<body><div class=menu><a href=1>x</a><a href=2>y</a></div><div><p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p></div></body>"
    assert html_text.main_text(plain).count("\n") == 1 and "x" not in html_text.main_text(plain).split("\n")[0][:4]
    assert [html_text.main_text(x) for x in (None, "", "<script>x")] == ["", "", ""] and html_text.main_text("just text") == "just text"


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|im_end|>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", None), (None, None, None, "x"), (1, 2, "assistant", "b" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert got[1].loss_chars == len(said) + 200_000 and got[1].loss_sha256 == hashlib.sha256((said + "b" * 200_000).encode()).hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/é", big), (2, None, big), (3, "u", "small"), (4, "v", "small"), (5, "w", None), (9, "u", big)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].record_type for i in (1, 2, 3, 4, 5, 9)] == ["revisit", "revisit", "response", "response", "response", "response"]
    assert got[1].refers_to == got[2].refers_to == 9 and got[1].payload_bytes == 1400 and got[5].payload_digest == hashlib.sha1(b"").hexdigest()


def test_chat_ids_are_those_of_the_whole_text(spark):
    enc = chat.encoder(chat.RANKS)
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choices([" ", "  ", "\n", "\t ", "a", "bc", "1", "'s", "!", "\xa0", "\u3000", "é"], k=rng.randint(0, 30)))
        assert chat.encode(enc, text, 2) == enc.encode_ordinary(text)
    for text in (" " * 300_000, "x" + "\n \t" * 100_000 + "y", "a" * 300_000, "a " * 100_000):
        assert enc.decode(chat.encode(enc, text)) == text
    rows = [(1, 0, "user", " " * 200_000), (1, 1, "assistant", "a" * 200_000), (None, 0, None, None), (2, None, "assistant", ""), (2, None, "assistant", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.chat_digests(df).collect()}
    assert got == {1: (2, 200_000), None: (1, 0), 2: (2, 0)} and chat.chat_digests(df.limit(0)).count() == 0


def test_warc_rows_of_all_kinds(spark):
    long = "<p>" + "x" * 40_000
    rows = [(1, "u", long, 3), (2, "u", long, 3), (2, "u", long, 3), (5, None, None, 3), (6, "v", "", 3), (None, "w", long, 3), (1 << 60, "far", "é", 3), (7, "s", "same", 3), (8, "s", "same", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, size int").withColumn("digest", html_text.F.lit("d")).withColumn("shard", html_text.F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    n = len(long)
    want = [(1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (5, 0, "response", None), (6, 0, "response", None), (None, n, "revisit", 2), (1 << 60, 2, "response", None), (7, 4, "response", None), (8, 4, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    rows = random_texts(6, 30) + [(None, "one two"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", 7, 7, 7, 7, 7) for i, t in rows], "doc_id long, text string, source string, _ int, row int, reads int, size int, `a.b` int")
    got = mixing.mix(df).collect()
    assert got and all(r["_"] == r["row"] == r["reads"] == r["size"] == r["a.b"] == 7 for r in got) and {(r.doc_id, r.text) for r in got} <= set(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_substrings_with_clashing_hashes(spark):
    """Hashes of eight bits: nearly all windows clash, and words decide."""
    rows = random_texts(3, 25) + [(50, random_texts(3)[0][1])]
    first, want = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t)
        want[i] = {k + j for k in range(len(w) - 12) if first.get(tuple(w[k : k + 13]), i) < i for j in range(13)}
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {i: set() for i, _ in rows}
    for r in substring_dedup.removed_spans(docs(spark, rows), hash_bits=8).collect():
        got[r.doc_id].update(x for a, b in zip(r.spans[::2], r.spans[1::2]) for x in range(a, b))
    assert got == want and any(want.values())


def test_shards_follow_the_bytes_whatever_the_ids(spark):
    """A far id, negative ones and rows without an id: shards stay near their size, and a far id is in no way of others."""
    rows = [(i, 1000) for i in range(3000)] + [(1 << 62, 10), (-(1 << 62), 10)]
    slim = spark.createDataFrame(rows, "place long, size long").repartition(5)
    kept = warc.SHARD_BYTES, warc.SLICES
    try:
        warc.SHARD_BYTES, warc.SLICES = 100_000, 64
        starts = warc.shard_starts(slim, -(1 << 62), 1 << 62, sum(s + 400 for _, s in rows))
    finally:
        warc.SHARD_BYTES, warc.SLICES = kept
    at = np.searchsorted(starts, np.array([i for i, _ in rows]), side="right") - 1
    sizes = np.bincount(at, [s + 400 for _, s in rows])
    assert sizes.max() < 2.1 * 100_000 and len(sizes) >= 40 and list(starts) == sorted(set(starts))

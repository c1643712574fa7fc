"""The operators against brute force, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bytehash, imi, langid, line_runs, mixing, oddsketch, piece_bpe, prefix_free, shards, toxicity
from gleaner.llm.components import connected_components

SPACE = "[\\x20\\x09-\\x0D]"
rng = random.Random(5)
VOCAB = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(30_000)
BASE = prose(120)
EDITED = " ".join(x if i % 40 else "changed" for i, x in enumerate(BASE.split()))
DOCS = [
    (1, BASE, "b", 0), (2, EDITED, "a", 0), (3, BASE, None, 1), (4, None, "a", 1), (5, "", "a", None), (6, "one two", "b", 1), (7, "ONE  two", "b", 1),
    (8, LONG, "c", 2), (9, LONG + " tail", "c", 2), (10, "É ü 中文 " + prose(50), "é", 2), (11, " \t\n\x0b\r", "z", 2), (12, BASE + "\n" + prose(80), "a", 3),
    (12, prose(60), "a", 3), (None, BASE, "a", 3), (None, prose(40), "q", 3), (20, "a repeated line here\nshort\nother " + prose(9), "a", 0),
    (21, "x\n A Repeated LINE here \nshort\nshort", "a", 0), (22, "a repeated line here", "a", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names the operators use inside
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string, h int").withColumns({c: F.lit("x") for c in ("doc", "slot", "id", "key", "c", "batch", "mix_u", "kept")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall("[^\\x20\\x09-\\x0D]+", t or "")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1, 2


def vectors(seed=3, n=120, dim=6):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, dim))
    x = np.concatenate([base + 0.03 * r.normal(size=base.shape) * (i > 0) for i in range(4)])
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(n)]
    rows += [(500 + i, rows[20][1], 2) for i in range(30)]  # copies
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] + [1.0] * (dim - 1), 1), (903, [None] + [1.0] * (dim - 1), 1), (904, rows[3][1], None), (905, [2 * v for v in rows[7][1]], 7 % 3)]
    rows += [(906, [float("inf")] * dim, 1), (907, [], 1)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_search(rows, step, k):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and usable(v)}
    out = {}
    for i in {i for i, _ in good if i % step == 0}:
        score = {}
        for own in (np.array(v) for j, v in good if j == i):
            for j, w in good:
                if j != i:
                    score[j] = max(score.get(j, -np.inf), float(np.add.accumulate(own * np.array(w))[-1]))
        out[i] = [(j, x) for x, j in sorted((-x, j) for j, x in score.items())[:k]]
    return {i: [(j, -x) for j, x in v] for i, v in out.items()}


def test_search_equals_brute_force(spark):
    """With all of the index visited."""
    rows = vectors() + [(20, vectors()[20][1], 2)] * 30 + [(40, [1.0] * 6, 0)]  # a repeated row; an id of two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1))
    got = {}
    for r in sorted(imi.search(df, F.col("id") % 20 == 0, k=7, recall=1.0, per_cell=10_000).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_search(rows, 20, 7)


def test_search_of_a_repeated_query(spark):
    rows = [(20, [1.0, 2.0])] * 30 + [(1, [0.5, 0.5]), (2, [3.0, 0.0]), (3, [0.0, 3.0])]
    got = imi.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, recall=1.0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 3, 6.0), (2, 2, 3.0), (3, 1, 1.5)]


def test_search_recall_with_blocks_and_hot_cells(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 16))
    x[:1000] = x[0] + 0.001 * r.normal(size=(1000, 16))  # one hot cell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = imi.search(df, F.col("id") % 50 == 0, k=10, block_rows=200).collect()
    s = x[::50] @ x.T
    s[np.arange(len(s)), np.arange(0, 3000, 50)] = -np.inf
    want = {(50 * i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for j in row}
    assert len(want & {(g.query_id, g.vec_id) for g in got}) / len(want) >= 0.9
    assert Counter(g.query_id for g in got) == {50 * i: 10 for i in range(60)}


def test_search_and_link_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert imi.search(none, F.col("id") % 20 == 0).count() == 0
    assert imi.link(none).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in imi.search(few, F.col("id") % 20 == 0, recall=1.0).collect()] == [(20, 1, 0.5)]


@pytest.mark.parametrize("block", [8192, 16])
def test_link_equals_brute_force(spark, block):
    rows = vectors() + [(1000, [1.0, 2.0], 1), (1001, [2.0, 4.001], 1), (1002, [1.0, 2.0, 0.1], 1)]  # other lengths
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("g", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in imi.link(df, 0.98, per_cell=2, block_rows=block).collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    pairs = [(a, b) for a, (i, v, g) in enumerate(rows) for b, (j, w, h) in enumerate(rows) if a < b and g is not None and g == h and usable(v) and usable(w) and len(v) == len(w) and cos(v, w) >= 0.98]
    n = Counter(x for p in pairs for x in p)
    up = roots(len(rows), pairs)
    smallest = {}
    for k, (i, _, _) in enumerate(rows):
        smallest[up[k]] = min(i, smallest.get(up[k], i))
    assert got == {i: (n[k], smallest[up[k]], i == smallest[up[k]]) for k, (i, _, _) in enumerate(rows)}


def test_multi_sequence_is_in_order():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    sums = [s for s, _, _ in imi.multi_sequence(a, b)]
    assert sums == sorted(sums) and len(sums) == 6


@pytest.mark.parametrize("one_task", [0, 50_000])
def test_components(spark, one_task):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.root for x in connected_components(df, "a", "b", one_task=one_task).collect()}
    up = roots(500, [(a, b) for a, b in edges if a is not None])
    assert got == {i: u for i, u in enumerate(up) if u != i}
    assert connected_components(df.limit(0), "a", "b", one_task=one_task).count() == 0


# 3


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_piece_codec_equals_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=model()), piece_bpe.PieceCodec(piece_bpe.PieceTable(model()), memo=50)
    r = random.Random(2)
    pieces = list(own.t.normal)
    texts = [t or "" for _, t, _, _ in DOCS if t is None or len(t) < 5000]
    texts += ["".join(r.choice("  ▁\n\tabcdeé中文😀<s></s>12.,Ж\x00") for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(1500)] + [" " * n + "a" for n in range(70)] + ["a" * 5000, "ab" * 3000]
    for t in texts:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t).tolist() == ids
        assert own.decode(ids) == lib.decode(ids)
    for _ in range(1500):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(5)]) for _ in range(r.randint(0, 10))]
        assert own.decode(ids) == lib.decode(ids)


def test_piece_memo_keeps_what_is_asked_for():
    """Frequent units outlast any number of rare ones, and no more than two generations are held."""
    made = Counter()

    def make(unit):
        made[unit] += 1
        return unit.encode()

    memo = piece_bpe.Memo(make, 10)
    for i in range(200):
        assert memo["the"] == b"the" and memo[f"rare{i}"] == f"rare{i}".encode() and len(memo) + len(memo.old) <= 20
    assert made["the"] == 1 and memo["x" * 65] == b"x" * 65 and "x" * 65 not in memo


def test_piece_backtracking_from_any_place():
    """Units where the longest match is given up, unknown characters and long ones give what the pass over all places gives."""
    codec, r = piece_bpe.PieceCodec(piece_bpe.PieceTable(model())), random.Random(5)
    pieces, back = [p for p in codec.t.text if not p.startswith("▁")], 0
    for i in range(4000):
        unit = "▁" + "".join(r.choice(pieces) for _ in range(r.randint(1, 6))) + ("\U0001f9ff" if i % 50 == 0 else "")
        whole, ranks = codec._backtrack(unit), codec._ranks(unit)
        assert codec._unit(unit) == np.array(whole, "<u4").tobytes()
        assert ranks is None if i % 50 == 0 else [codec.t.ids[x] for x in ranks] == whole
        back += ranks != [x for _, (x, _) in codec.auto.iter_long(unit)]
    assert back > 500


def test_piece_documents(spark, docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.encode_documents(docs, model(), digest=True).collect())
    want = Counter()
    for i, t, _, _ in DOCS:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    full = {r.doc_id: r for r in piece_bpe.encode_documents(docs.where("doc_id = 6"), model()).collect()}
    assert list(full[6].ids) == lib.encode("one two", add_bos=True, add_eos=True) and full[6].decoded == "one two"
    assert piece_bpe.encode_documents(empty, model()).count() == 0


# 4


def mixed(docs):
    return mixing.mix(docs, mixing.word_count(F.col("text")))


def test_mixing(spark, docs, empty):
    rows = mixed(docs).collect()
    assert len(rows) == len(DOCS) and rows[0].asDict().keys() == {*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"}
    sizes = Counter()
    for _, t, s, _ in DOCS:
        sizes[s] += len(words(t))
    total = sum(sizes.values())
    seen = {}
    for r in rows:
        assert r.mix_size == len(words(r.text)) and r.mix_source_size == sizes[r.source] and 0 <= r.mix_copies <= 2
        seen[r.source] = r.mix_target
    # what is shared again goes by weight, until nothing is above
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, rest, target = set(order), 1.5 * total, {}
    while free:
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) >= 2 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest, free = rest - sum(2 * sizes[s] for s in over), free - over
    assert seen == pytest.approx(target)
    assert Counter((r.doc_id, r.mix_copies) for r in mixed(docs.repartition(7)).collect()) == Counter((r.doc_id, r.mix_copies) for r in rows)
    assert mixed(empty).count() == 0


def test_mixing_of_ids_that_draw_alike(spark):
    """Null ids, repeated ids and equal rows end within a row of the target; sort_rows makes all digits count."""
    rows = [(None, "a", 10, f"t{i}") for i in range(400)] + [(None, "b", 10, "t") for i in range(400)] + [(7, "c", 1 + i % 50, "t") for i in range(400)] + [(i, "d", 20, "t") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, text string").repartition(5)
    for sort_rows in (100_000, 0):
        out = mixing.mix(df, F.col("size"), text_col="text", sort_rows=sort_rows).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("size")).alias("taken"), F.first("mix_target").alias("target")).collect()
        assert len(out) == 4 and all(abs(x.taken - x.target) <= 50 for x in out)


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(4)
    rows = [(i, f"s{min(i % 9, 5)}", r.choice([1, 10, 300])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(df, F.col("size"), sort_rows=10).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.first("mix_target").alias("target")).collect()
    for x in out:
        assert abs(x.taken - x.target) <= 300


# 5


def shingles(t, k=4):
    w = words(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(spark, empty):
    r = random.Random(9)
    rows = [(i, t) for i, t, _, _ in DOCS if i is not None]
    tight = prose(60, r).split()  # many near copies that don't all link
    for i in range(60):
        w = list(tight)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(1)).withColumn("n", F.lit(2))
    sets = [shingles(t) for _, t in rows]
    same = {i: [k for k, x in enumerate(rows) if x[0] == i] for i, _ in rows}
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = roots(len(rows), links)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[up[k]] = min(i, low.get(up[k], i))
    want = Counter((i, len(sets[k]), low[up[k]], i == low[up[k]]) for k, (i, _) in enumerate(rows))
    assert Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in oddsketch.near_duplicates(df).collect()) == want
    assert len(same) < len(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert oddsketch.near_duplicates(none).count() == 0


def test_words_that_polynomials_confuse_are_no_copies(spark):
    """A Thue-Morse word and its complement collide in every polynomial modulo 2**64."""
    word = lambda n, x, y: "".join((x, y)[bin(i).count("1") % 2] for i in range(n))
    rows = [(1, word(1024, "a", "b")), (2, word(1024, "b", "a")), (3, word(2048, "a", "b") + " q"), (4, word(2048, "b", "a") + " q"), (5, word(1024, "A", "b"))]
    got = {x.doc_id: x.component_id for x in oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_shingle_sets_hold_what_they_should():
    import pyarrow as pa

    texts, known = [t for _, t, _, _ in DOCS], oddsketch.WordHashes()
    own = [oddsketch.words_of(x) for x in pa.array(texts, pa.string())]
    assert [len(oddsketch.shingle_hashes(w, 4, known)) for w in own] == [len(oddsketch.shingle_set(w, 4)) for w in own] == [len(shingles(t)) for t in texts]
    a, b = (np.unique(bytehash.mix(np.arange(k, k + 900, dtype=np.uint64))) for k in (1, 101))
    sketches = oddsketch.odd_sketch(np.stack([oddsketch.minhash(a), oddsketch.minhash(b)]))
    assert abs(oddsketch.estimate(int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())) - 0.8) < 0.15
    full = [np.frombuffer(oddsketch.full_sketch(x), np.uint8) for x in (a, b)]
    assert np.bitwise_count(full[0] ^ full[1]).sum() <= 200


# 6


@pytest.mark.parametrize(("length", "reach", "most"), [(40, 20, 20_000), (40, 20, 1), (25, 8, 3)])
def test_repeats_equal_brute_force(spark, docs, length, reach, most):
    r = random.Random(length)
    rows = [(i, t) for i, t, _, _ in DOCS if t is None or len(t) < 3000] + [(50, "a" * 300), (51, "ab" * 90), (52, "é" * 60), (53, "x" * length), (54, "y" * (length - 1))]
    passage = prose(30, r)
    rows += [(60 + i, prose(8, r) + passage[i : 150 + 3 * i] + prose(8, r)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("b", F.lit(1))
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    want = Counter()
    for (doc, _), x in zip(rows, raw, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        want[doc, len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    got = prefix_free.remove_repeats(df, length=length, reach=reach, most=most, digest=True).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want


def test_places_are_those_of_the_corpus_order():
    """Numbers of windows are equal where the windows are, and follow the suffix arrays of both sides."""
    r = random.Random(21)
    text = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    core, length = b"TRIGGER!", 14
    rows = [(lambda a, b: (a + core + b, 0, len(a)))(text(r.randrange(6)), text(6)) for _ in range(60)]
    raw, dmin, dmax = [x[0] for x in rows], np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    order, shared = prefix_free.suffix_array(raw)
    assert [raw[i] for i in order] == sorted(raw)
    assert all(raw[a][:n] == raw[b][:n] and raw[a][n : n + 1] != raw[b][n : n + 1] or raw[a] == raw[b] for a, b, n in zip(order, order[1:], shared, strict=False))
    offsets, place = prefix_free.corpus_places(raw, dmin, dmax, length)
    for d, own in zip(offsets.tolist(), place, strict=True):
        windows = [x[h - d : h - d + length] if h >= d else None for x, h in zip(raw, dmax.tolist(), strict=True)]
        assert all((own[i] == own[j]) == (windows[i] == windows[j]) for i in range(60) for j in range(60) if windows[i] and windows[j])
        assert all((x is None) == (y == -1) for x, y in zip(windows, own, strict=True))


def test_repeats_of_a_long_text_and_of_nothing(spark, empty):
    r = random.Random(8)
    head = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, head), (2, "z" * 10 + head[100:5000]), (3, head[390_000:])]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in prefix_free.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (14_900, 2), 2: (4900, 1), 3: (10_000, 1)}
    assert prefix_free.remove_repeats(empty).count() == 0


# 7


def sentences(lang, n, r):
    parts = {"xx": ["ka", "lo", "mi", "tu", "ra"], "yy": ["sch", "ung", "ber", "eit", "zu"], "zz": ["ción", "que", "ñar", "los", "ado"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_id(spark, empty):
    r = random.Random(6)
    train = [(i, sentences(x, 60, r), x) for i, x in enumerate(["xx", "yy", "zz"] * 40)] + [(900, None, "xx"), (901, "", "yy"), (902, "text", None)]
    rows = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.train_dictionaries(rows, "lang", "text", "doc_id", docs_per_lang=30, chars_per_doc=200)
    assert set(model) == {"xx", "yy", "zz"} and all(len(v.decode()) <= 30 * 201 for v in model.values())
    held = [(i, sentences(x, 40, r), x) for i, x in enumerate(["xx", "yy", "zz"] * 20)]
    held += [(100, None, "und"), (101, "", "und"), (102, "12 !? \n", "und"), (103, sentences("zz", 20_000, r), "zz")]
    df = spark.createDataFrame(held, "doc_id long, text string, want string").withColumn("lang_pred", F.lit("?"))
    got = langid.identify(df, model).collect()
    assert len(got) == len(held) and sum(g.lang_pred == g.want for g in got) >= 0.97 * len(held)
    assert all(0 <= g.lang_score <= 1 for g in got) and all(g.lang_rejected for g in got if g.want == "und") and all(g.lang_pred == "und" for g in got if g.want == "und")
    assert langid.train_dictionaries(rows.limit(0), "lang", "text", "doc_id") == {}
    assert langid.identify(df, {}).where("lang_pred != 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.train_dictionaries(rows, "lang", "text", "doc_id", docs_per_lang=2, max_langs=1)


# 8


def test_sharding(spark, docs, empty):
    rows = spark.range(0, 10_001, numPartitions=7).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))
    out = shards.shuffle_into_shards(rows, 8, rows_per_bucket=300).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert sorted(len(v) for v in by.values()) == [1250] * 7 + [1251]
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values()) and sorted(i for v in by.values() for _, i in v) == list(range(10_001))
    # uniform: every shard takes about as many of each input partition, and order in a shard says nothing
    for v in by.values():
        share = np.bincount([i * 7 // 10_001 for _, i in v], minlength=7)
        assert ((share > 120) & (share < 240)).all()
        order = [i for _, i in sorted(v)]
        assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.1
    few = shards.shuffle_into_shards(rows, 8, groups=2).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in few) == [1250] * 7 + [1251]
    again = {(r.doc_id, r.shard, r.slot) for r in shards.shuffle_into_shards(rows, 8, rows_per_bucket=300).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out}
    assert sorted((r.shard, r.slot) for r in shards.shuffle_into_shards(docs, 8).collect()) == sorted((j, s) for j in range(8) for s in range(len(DOCS) // 8 + (j < len(DOCS) % 8)))
    assert shards.shuffle_into_shards(empty, 8).count() == 0


def test_communication_matrix():
    m = np.array(shards.communication_matrix([5, 0, 100, 7], [28, 28, 28, 28], 1))
    assert m.sum(0).tolist() == [28] * 4 and m.sum(1).tolist() == [5, 0, 100, 7]
    r = np.random.default_rng(5)
    for good, bad, n in ((30, 50, 20), (5, 400, 300), (1000, 1000, 7)):
        got = np.bincount([shards.draw(r, good, bad, n) for _ in range(20_000)], minlength=n + 1)[: n + 1]
        law = np.array([math.comb(good, k) * math.comb(bad, n - k) if k <= good and n - k <= bad else 0 for k in range(n + 1)], object)
        law = np.array([float(x / sum(law)) for x in law])
        assert np.abs(got / 20_000 - law).max() < 0.015
    big = [shards.draw(r, 4 * 10**12, 28 * 10**12, 10**9) for _ in range(400)]  # mean 1.25e8, deviation 10,458
    assert abs(np.mean(big) - 1.25e8) < 3000 and 9000 < np.std(big) < 12_000
    m = np.array(shards.communication_matrix([3_000_000_000, 5_000_000_000], [4_000_000_000] * 2, 1))
    assert m.sum(0).tolist() == [4_000_000_000] * 2 and m.sum(1).tolist() == [3_000_000_000, 5_000_000_000]


# 9


def test_folding():
    assert fold("ÏDI0T, ｉｄｉｏｔ іdiоt! id1ot### 1d10t i.d.i-o.t 2024 4 you e.g. so") == " idiot idiot idiot idiot idiot idiot you e g so "


def fold(t):
    return toxicity.fold(t)


def test_toxicity(spark, empty):
    r = random.Random(3)
    bad = ["clod", "dolt", "oaf"]
    docs, labels = [], []
    for i in range(400):
        w = [r.choice(VOCAB) for _ in range(80)]
        y = i % 4 == 0
        if y:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice([*bad, "D0lt", "сlod"]))  # a digit, a Cyrillic letter
        elif i % 3 == 0:
            w += ["oaf", "tree"]  # harmless beside this word
        docs.append((i, " ".join(w)))
        labels.append((i, int(y)))
    docs += [(1000, None), (1001, ""), (1002, prose(20_000, r)), (1003, "oaf tree"), (1004, "you DOLT, you ｃｌｏｄ")]
    labels += [(1000, None), (2000, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab, per_class=150)
    assert {"clod", "dolt"} <= set(model.weights)
    got = {x.doc_id: x for x in toxicity.score_toxicity(d.withColumn("toxic_pred", F.lit(7)), model).collect()}
    assert sum(got[i].toxic_pred == y for i, y in labels if i < 400) >= 390
    assert got[1000].toxic_pred == got[1001].toxic_pred == got[1002].toxic_pred == got[1003].toxic_pred == 0 and got[1004].toxic_pred == 1
    assert all(0 <= x.toxic_score <= 1 for x in got.values())
    blank = toxicity.train(d, lab.limit(0))
    assert toxicity.score_toxicity(d, blank).where("toxic_pred = 1").count() == 0
    assert toxicity.score_toxicity(d.limit(0), model).count() == 0


# 10


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_equals_brute_force(spark, docs, empty, batches):
    got = Counter((r.doc_id, r.line_count, r.lines_dropped, r.kept_sha256) for r in line_runs.dedup_lines(docs, batches=batches, digest=True).collect())
    strip = lambda x: re.sub(f"^{SPACE}+|{SPACE}+$", "", x)
    place = lambda i: float("inf") if i is None else i
    holders = {}
    for i, t, _, _ in DOCS:
        for x in (t or "").split("\n"):
            holders.setdefault(lower(strip(x)), set()).add(place(i))
    want = Counter()
    for i, t, _, _ in DOCS:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(lower(strip(x))) < 10 or min(holders[lower(strip(x))]) == place(i)]
        want[i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert got == want
    full = line_runs.dedup_lines(docs, batches=batches)
    assert full.columns == [*docs.columns, "line_count", "lines_dropped"] and full.where("doc_id = 22").first().text == ""
    assert full.where("doc_id = 4").first().text is None
    assert line_runs.dedup_lines(empty).count() == 0


def test_runs_stay_few_and_merge_in_place(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(bytes([i, j]),) for j in range(3)], "h binary"))
    assert sum(len(x) for x in runs.levels.values()) == 2 and sum(t.count() for t in runs.tables()) == 15
    asked = spark.createDataFrame([(bytes([i, 1]),) for i in range(9)], "h binary")
    marked = runs.mark_known(asked)
    assert sorted((r.h[0], r.known) for r in marked.collect()) == [(i, i < 5) for i in range(9)]

    def above_runs(df):
        """Exchanges with a run below them."""
        text = df._jdf.queryExecution().executedPlan().toString()
        depth, found = [], 0
        for line in text.split("\n"):
            at = len(line) - len(line.lstrip(" :+-*()0123456789"))
            depth = [x for x in depth if x < at]
            if "Exchange" in line:
                depth.append(at)
            found += "Scan parquet" in line and bool(depth)
        return found

    assert above_runs(marked) == 0 and above_runs(runs.merged([t for x in runs.levels.values() for t in x])) == 0
    assert "SortMergeJoin" in marked._jdf.queryExecution().executedPlan().toString()
    runs.drop()
    assert not spark.catalog.listTables()


def test_null_ids_in_line_dedup(spark):
    rows = [(1, "a line of its own here")] + [(None, f"text number {i} it is\na line of its own here\nsaid by all nulls") for i in range(300)]
    out = line_runs.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).collect()
    assert sorted(r.text for r in out) == sorted([rows[0][1]] + [f"text number {i} it is\nsaid by all nulls" for i in range(300)])


def test_held_out_rows(spark):
    from gleaner.llm.common import held_out

    got = {r.doc_id: r.h for r in spark.range(200).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}

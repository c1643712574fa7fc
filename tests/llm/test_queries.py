"""The registered queries over a folder of small tables, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gleaner.llm import langid, queries, toxicity
from gleaner.llm.common import table

r = random.Random(17)
PARTS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ber", "keit"]}
SPACE = "[\\x20\\x09-\\x0D]"


def prose(lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents():
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 3 == 0]
        text = prose(lang, r.randint(1, 90)) + "\n" + prose(lang, 20)
        if i % 5 == 0:
            text += " clod and dolt, you cl0d"
        rows.append((i, text, lang, f"s{i % 3}" if i % 7 else None))
    shared = prose("aa", 120)
    rows += [(200 + i, f"{prose('aa', 5)}\n{shared}\n  A LINE of all {'x' * i}", "aa", "s1") for i in range(6)]
    rows += [(300 + i, rows[i][1], rows[i][2], "s2") for i in range(0, 12)]
    rows += [(400, None, None, None), (401, "", "aa", "s0"), (402, "12 !?", "bb", "s0"), (403, prose("bb", 20_000), "bb", "s0"), (404, prose("bb", 30).upper(), None, "s9")]
    return rows


DOCS = documents()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*x, len(x[1] or "")) for x in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(160)] + [(i, 0, None) for i in range(200, 206)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    g = np.random.default_rng(1)
    x = g.normal(size=(600, 8))
    x[300:] = x[:300] + 0.02 * g.normal(size=(300, 8))
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(700, None, 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def words(t):
    return re.findall("[^\\x20\\x09-\\x0D]+", t or "")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def sha(x):
    return hashlib.sha256(x).hexdigest()


def groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_search_recall(spark, folder):
    rows = {x.vec_id: np.array(x.embedding) for x in table(spark, folder, "embeddings").collect() if x.embedding}
    got = run(spark, folder, "op1_multi_index_search")
    hits = 0
    for q in [i for i in rows if i % 20 == 0]:
        own = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [k for k, _, _ in own] == list(range(1, 21)) and all(s == float(np.add.accumulate(rows[q] * rows[i])[-1]) for _, i, s in own)
        assert [(i, s) for _, i, s in own] == sorted(((i, s) for _, i, s in own), key=lambda x: (-x[1], x[0]))
        best = sorted((i for i in rows if i != q), key=lambda i: (-float(rows[q] @ rows[i]), i))[:20]
        hits += len(set(best) & {i for _, i, _ in own})
    assert hits >= 0.9 * 20 * len([i for i in rows if i % 20 == 0])


def test_embedding_dedup(spark, folder):
    rows = [(x.vec_id, x.embedding and np.array(x.embedding), x.label) for x in table(spark, folder, "embeddings").collect()]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    links = [(i, j) for i, (_, v, g) in enumerate(rows) for j, (_, w, h) in enumerate(rows) if i < j and g == h and v is not None and w is not None and cos(v, w) >= 0.98]
    up, n = groups(len(rows), links), Counter(x for p in links for x in p)
    low = {}
    for k, x in enumerate(rows):
        low[up[k]] = min(x[0], low.get(up[k], x[0]))
    assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in run(spark, folder, "op2_embedding_dedup")} == {(x[0], n[k], low[up[k]], x[0] == low[up[k]]) for k, x in enumerate(rows)}


def test_pieces(spark, folder):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    want = set()
    for i, t, _, _ in DOCS:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode())))
    assert {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in run(spark, folder, "op3_piece_bpe")} == want


def test_mix(spark, folder):
    sizes, taken = Counter(), Counter()
    got = {x.doc_id: x for x in run(spark, folder, "op4_mix_sources")}
    for i, t, _, s in DOCS:
        sizes[s] += len(words(t))
        assert got[i].size == len(words(t)) and got[i].taken in (0, got[i].size, 2 * got[i].size)
        taken[s] += got[i].taken
    for i, _, _, s in DOCS:
        assert got[i].source_size == sizes[s] and abs(taken[s] - got[i].target) <= 20_000 / 2
    assert sum({x.source_size: x.target for x in got.values()}.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_near_dedup(spark, folder):
    def shingles(t):
        w = words(lower(t))
        return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()

    sets = [shingles(t) for _, t, _, _ in DOCS]
    links = [(a, b) for a in range(len(DOCS)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up, low = groups(len(DOCS), links), {}
    for k, x in enumerate(DOCS):
        low[up[k]] = min(x[0], low.get(up[k], x[0]))
    assert {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in run(spark, folder, "op5_odd_sketch_dedup")} == {(x[0], len(sets[k]), low[up[k]], x[0] == low[up[k]]) for k, x in enumerate(DOCS)}


def test_repeats(spark, folder):
    raw = [(t or "").encode() for _, t, _, _ in DOCS]
    seen = Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    want = set()
    for (doc, *_), x in zip(DOCS, raw, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        want.add((doc, len(x), int(gone.sum()), runs, sha(np.frombuffer(x, np.uint8)[~gone].tobytes())))
    assert sum(x[2] > 0 for x in want) >= 6
    assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in run(spark, folder, "op6_prefix_free_dedup")} == want


def test_language(spark, folder):
    """A plain loop over the languages: the smallest size by the quick search, or by the deep one where sizes are close."""
    docs = table(spark, folder, "documents")
    content = langid.train_dictionaries(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "lang", "text", "doc_id")
    assert set(content) == {"aa", "bb"}
    model = langid.CompressionClassifier(content)

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und"
        raw = text.lower().encode()
        for coders in (model.quick, model.deep):
            size = {x: sum(len(c.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for x, c in zip(model.langs, coders, strict=True)}
            best, other = sorted(size, key=lambda x: (size[x], model.langs.index(x)))
            if size[other] - size[best] > 0.03 * size[other]:
                break
        return best

    got = {x.doc_id: x for x in run(spark, folder, "op7_language_id")}
    assert {i: got[i].lang_pred for i in got} == {i: plain(t) for i, t, _, _ in DOCS}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    held = [(got[i].lang_pred, g) for i, t, g, _ in DOCS if g and got[i].held_out and any(c.isalpha() for c in t or "")]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert zstandard.__version__


def test_shards(spark, folder):
    got = run(spark, folder, "op8_shuffle_shards")
    texts = {i: (t or "").encode() for i, t, _, _ in DOCS}
    assert {x.doc_id: (x.size, x.text_crc32, x.law, x.grown_shard) for x in got} == {i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in texts.items()}
    n = len(DOCS)
    assert sorted((x.shard, x.slot) for x in got) == sorted((j, s) for j in range(8) for s in range(n // 8 + (j < n % 8)))


def test_toxicity(spark, folder):
    """A plain scan of the folded words, with the same weights."""
    docs, labels = (table(spark, folder, x) for x in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).where("toxic IS NOT NULL"))
    assert {"clod", "dolt"} <= set(model.weights)

    def plain(text):
        w = toxicity.fold(text or "").split()
        total = 0.0
        for k, x in enumerate(w):
            if x in model.weights and not any(" ".join(w[a:b]) in model.exceptions for a, b in ((k - 1, k + 1), (k, k + 2)) if a >= 0):
                total += model.weights[x]
        a, b, c = model.curve
        z = a + b * math.log1p(total) + c * math.log1p(100 * total / max(20, len(w)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    got = {x.doc_id: x for x in run(spark, folder, "op9_toxicity")}
    for i, t, _, _ in DOCS:
        assert got[i].score == pytest.approx(plain(t), abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(160))


def test_lines(spark, folder):
    strip = lambda x: re.sub(f"^{SPACE}+|{SPACE}+$", "", x)
    first = {}
    for i, t, _, _ in DOCS:
        for x in (t or "").split("\n"):
            k = lower(strip(x))
            first[k] = min(i, first.get(k, i))
    want = set()
    for i, t, _, _ in DOCS:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(lower(strip(x))) < 10 or first[lower(strip(x))] == i]
        want.add((i, len(parts), len(parts) - len(kept), sha("\n".join(kept).encode())))
    assert {(x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in run(spark, folder, "op10_line_dedup")} == want

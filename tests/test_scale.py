"""Operators that hold bounded parts of their input, against plain ones."""

import math
import random

import numpy as np
import pyarrow as pa

from gleaner.operators import extract, relevance


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_tags_holds_few_words_as_objects(spark):
    rows = [(d, w + 1, f"W{w}" if w % 3 else f"x{w}", w, w + 2) for d in (1, 2, None) for w in range(100 * 90 if d == 1 else 130)]
    words = spark.createDataFrame(rows, "doc_id long, word_no int, text string, start_off int, end_off int")

    def tag(texts):
        if "x102" in texts:
            raise ValueError
        return [2] * len(texts), [x for t in texts for x in ("O", "B" if t[0] == "W" else "O")]

    out = extract.word_tags(words, tag, max_pieces=120)
    assert "MapInArrow" in plan(out) and "MapInPandas" not in plan(out)
    want = {(d, n, t, s, e, "B" if t[0] == "W" and (n - 1) % 100 < 60 and (n - 1) // 100 != 1 else "O") for d, n, t, s, e in rows}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(rows)


def test_cosines_of_odd_vectors():
    r = random.Random(3)
    vecs = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(9)] + [None, [], [0.0] * 5, [1.0, None, 2.0, 3.0, 4.0], [1.0] * 4, [float("nan")] * 5]
    wanted = [*vecs[:3], None, [0.0] * 5, [1.0] * 4]
    got = relevance.cosines(pa.array([[9.0], *vecs], pa.list_(pa.float64())).slice(1), wanted)

    def cos(a, b):
        if a is None or b is None or len(a) != len(b) or None in a:
            return 0.0
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return dot(a, b) / norm if norm else 0.0

    assert np.allclose(got, [[cos(a, b) for b in wanted] for a in vecs], equal_nan=True, rtol=1e-9, atol=1e-12)


def test_relevance_by_vectors_sends_the_best_lines_only(spark):
    r = random.Random(4)
    vecs = [[float(r.choice([-1, 0, 1])) for _ in range(3)] for _ in range(12)]
    lines = [(d, n, f"some line {n}", r.choice(vecs)) for d in (1, 2, 3) for n in range(1, 40)]
    own = spark.createDataFrame(lines, "doc_id long, line_no int, stripped string, v array<float>").repartition(3, "line_no")
    req = spark.createDataFrame([(1, k + 1, f"r{k}", vecs[k]) for k in range(4)], "jd_id int, req_no int, requirement string, v array<float>")
    out = relevance.relevance(own, req, 0.2, vectors="v")
    assert "MapInArrow" in plan(out)
    cos = lambda a, b: float(relevance.cosines(pa.array([a], pa.list_(pa.float64())), [b])[0, 0])
    want = set()
    for d in (1, 2, 3):
        for k in range(4):
            s, n = max((cos(v, vecs[k]), -n) for x, n, _, v in lines if x == d)
            want.add((d, 1, k + 1, round(s, 4), s >= 0.2, f"some line {-n}" if s >= 0.2 else None))
    assert {(x.doc_id, x.jd_id, x.req_no, x.similarity, x.matched, x.matched_text) for x in out.collect()} == want
    assert "matched_text" not in relevance.relevance(own, req, texts=False).columns

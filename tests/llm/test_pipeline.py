"""The pipeline's stages on a small corpus, each against its own input."""

import random
import re

import pytest

import corpus_pipeline as cp

r = random.Random(11)
PARTS = {"en": ["the", "ing", "tion", "er", "and"], "de": ["sch", "ung", "ber", "keit", "zu"]}


def prose(lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 3 == 0]
        rows.append((i, prose(lang, 60) + "\n" + prose(lang, 30), lang, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(5)]  # exact copies
    rows += [(300 + i, rows[i][1].replace("\n", " extra words ", 1), rows[i][2], None) for i in range(10, 15)]  # near copies
    rows += [(400, None, None, "s0"), (401, "123 456", "en", "s0"), (402, "", "de", "s2")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs, seen = cp.table(spark, folder, "documents"), {}
    for name, stage in cp.STAGES:
        before = {x.doc_id: x for x in docs.collect()}
        docs = cp.stash(stage(spark, docs, folder), name)
        seen[name] = (before, docs.collect())
        assert name == "encode" or docs.columns == cp.COLUMNS
    before, after = seen["language_id"]
    kept = {x.doc_id for x in after}
    assert not kept & {400, 401, 402} and len(kept) >= 128 and all(x.text == before[x.doc_id].text for x in after)
    before, after = seen["line_dedup"]
    lines = [x for d in after for x in d.text.split("\n") if len(x) >= 10]
    assert len(lines) == len(set(lines)) and {x.doc_id for x in after} >= set(range(120)) & set(before)
    before, after = seen["near_dedup"]
    sets = {x.doc_id: {tuple(w[i : i + 5]) for w in [re.findall(r"\S+", x.text)] for i in range(len(w) - 4)} for x in after}
    ids = sorted(sets)
    assert not any(sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
    assert len(after) >= 118
    before, after = seen["mix_sources"]
    times = [x.doc_id for x in after]
    assert max(times.count(i) for i in set(times)) <= 2 and set(times) <= set(before)
    total = sum(len(x.text.split()) for x in before.values())
    assert abs(sum(len(x.text.split()) for x in after) - 1.5 * total) < 0.05 * total
    before, after = seen["encode"]
    assert sorted(x.doc_id for x in after) == sorted(times) and all(len(x.ids) == x.n_tokens and x.ids[0] == 1 for x in after)


def test_run(spark, folder):
    out = cp.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 100


def test_nothing_and_repeated_ids(spark, folder, tmp_path):
    docs = cp.table(spark, folder, "documents")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    # a repeated id, null ids and columns that clash with names used inside
    odd = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id < 3").withColumn("doc_id", cp.F.lit(None).cast("long")))
    odd = odd.withColumns({c: cp.F.lit("x") for c in ("doc", "kept", "h", "size", "mix_size", "copies", "ids", "lang_pred")})
    for name, stage in cp.STAGES:
        odd = cp.stash(stage(spark, odd, folder), name)
        assert odd.count() > 90 and (name == "encode" or odd.columns == cp.COLUMNS)


def test_encode_decodes(spark, folder):
    """The stage runs the operator whole, decoding with it, though it returns the ids only."""
    docs = cp.table(spark, folder, "documents")
    out = cp.encode(spark, docs, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    ran = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in x]
    assert len(ran) == 1 and "decoded" in ran[0]

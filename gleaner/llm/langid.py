"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample texts. A text is
cut into chunks, each chunk is compressed against every dictionary, and the
language with the smallest total wins: its dictionary holds the most of the
text's substrings. Where the second language comes close, the decision is
marked as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, slices, trimmed

UNKNOWN = "und"
LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text)) or any(c.isalpha() for c in text)


def train_dictionaries(rows: DataFrame, lang_col: str, text_col: str, id_col: str, docs_per_lang: int = 400, chars_per_doc: int = 400, max_langs: int = 200) -> dict[str, bytes]:
    """language -> dictionary content, of a bounded sample of ``rows``.

    For each non-null language the ``docs_per_lang`` distinct texts of lowest
    hash give ``chars_per_doc`` characters each, from a place that the hash
    picks. The sample's bound is docs_per_lang * chars_per_doc characters a
    language and ``max_langs`` languages; more languages raise an error.
    """
    usable = rows.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    key = F.xxhash64(F.lit("langid"), F.col(text_col))
    d = usable.select(F.col(lang_col).alias("lang"), key.alias("k"), F.col(id_col).alias("id"))
    # copies share their hash: one of them stays
    d = d.groupBy("lang", "k").agg(F.min("id").alias("id"))
    # first within parts of a language, so that one with most rows is no task of its own
    for part in (["lang", F.pmod("k", F.lit(64))], ["lang"]):
        d = d.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("k", "id"))).where(F.col("r") <= docs_per_lang)
    picked = d.limit(docs_per_lang * max_langs + 1).collect()
    if len(picked) > docs_per_lang * max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not picked:
        return {}
    at = F.pmod(F.shiftright("k", 7), F.greatest(F.length(text_col) - chars_per_doc + 1, F.lit(1))).cast("int") + 1
    keys = rows.sparkSession.createDataFrame([(r["lang"], int(r["k"])) for r in picked], "_lang string, _k long")
    # at most docs_per_lang * max_langs short rows are broadcast
    chosen = usable.withColumn("k", key).join(F.broadcast(keys), (F.col("k") == F.col("_k")) & (F.col(lang_col) == F.col("_lang")))
    got = chosen.select(F.col(lang_col).alias("lang"), "k", F.expr("1").alias("one"), F.substring(F.col(text_col), at, F.lit(chars_per_doc)).alias("piece"))
    got = got.groupBy("lang", "k").agg(F.min("piece").alias("piece")).collect()
    out: dict[str, list[tuple[int, str]]] = {}
    for r in got:
        out.setdefault(r["lang"], []).append((r["k"], r["piece"]))
    rows_of = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    order = sorted(out, key=lambda x: (-rows_of[x], x))  # equal sizes go to the language with more rows
    return {lang: "\n".join(x for _, x in sorted(out[lang])).lower().encode() for lang in order}


class CompressionClassifier:
    """Greedy matching first; where the two smallest lie within ``close`` of each other, a deeper search decides."""

    def __init__(self, dictionaries: dict[str, bytes], chunk: int = 2048, close: float = 0.03):
        self.langs, self.chunk, self.close = list(dictionaries), chunk, close
        quick = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=16, search_log=2, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False
        )
        deep = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False)
        self.quick, self.deep = ([self._coder(dictionaries[x], p) for x in self.langs] for p in (quick, deep))

    @staticmethod
    def _coder(content: bytes, params: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=params)

    def ranked(self, text: str) -> list[tuple[int, str]]:
        """Compressed size and language, smallest first; ties in the order of the dictionaries."""
        raw = text.lower().encode("utf-8", "replace")
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        for coders in (self.quick, self.deep):
            sizes = [(sum(len(c.compress(x)) for x in chunks), lang) for lang, c in zip(self.langs, coders, strict=True)]
            out = sorted(sizes, key=lambda x: x[0])  # stable: ties in the order of the dictionaries
            if len(out) < 2 or out[1][0] - out[0][0] > self.close * out[1][0]:
                break
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """language, score, margin: how much smaller the best is than the second, as a part of the second."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        ranked = self.ranked(text)
        if len(ranked) == 1:
            return ranked[0][1], 1.0, 1.0
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], 1 / (1 + math.exp(-40 * margin)), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.002) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1), lang_margin and lang_rejected.

    lang_pred is ``und`` if the text is null or has no letter, or if there is
    no dictionary. lang_rejected marks such rows and margins under
    ``min_margin``; lang_pred keeps the best guess. Whole texts are read. Other
    columns pass through; columns with these four names are replaced.
    """
    shared = Shared(docs.sparkSession, dictionaries, CompressionClassifier)  # bounded by train_dictionaries
    new = ("lang_pred", "lang_score", "lang_margin", "lang_rejected")
    keep = [c for c in docs.columns if c not in new]
    at = keep.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, lang_score double, lang_margin double, lang_rejected boolean"

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.get()
        for b in (piece for whole in batches for piece in slices(whole, at)):
            got = [model.predict(x.as_py()) for x in b.column(at)]
            langs, scores, margins = ([g[i] for g in got] for i in range(3))
            arrays = [b.column(i) for i in range(len(keep))]
            arrays += [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
            arrays.append(pa.array([x == UNKNOWN or m < min_margin for x, m in zip(langs, margins, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])

    return docs.select(*keep).mapInArrow(trimmed(classify), schema)

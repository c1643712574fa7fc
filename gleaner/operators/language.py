"""English, Indonesian or mixed, by word lists; and the mix of a document's lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column) -> Column:
    return tx.tokens(text, "[A-Za-z]+")


def lang_scores(text: Column) -> Column:
    """(en, id, n): parts of the tokens that speak for a language, and their number."""
    en, indo = _list(lx.EN_WORDS), _list(lx.ID_WORDS)
    affixed = f"^(?:{'|'.join(lx.ID_PREFIXES)}).*(?:{'|'.join(lx.ID_SUFFIXES)})$"

    def hit(w: Column) -> Column:
        return F.array_contains(indo, w) | (~F.array_contains(en, w) & (F.length(w) > 5) & w.rlike(affixed))

    def scores(t: Column) -> Column:
        part = lambda k: F.coalesce(F.try_divide(F.size(k), F.size(t)), F.lit(0.0))
        return F.struct(part(F.filter(t, lambda w: F.array_contains(en, w))).alias("en"), part(F.filter(t, hit)).alias("id"), F.size(t).alias("n"))

    return tx.let(tokens(text), scores)


def wordlist_label(scores: Column) -> Column:
    """(lang, confidence): mixed only at an exact split of the shares, other without any hit."""
    total = scores["en"] + scores["id"]
    en, indo = scores["en"] / total, scores["id"] / total
    high, low = 1 - lx.MIXED_SHARE, lx.MIXED_SHARE
    mixed = ((en >= high) & (indo >= low)) | ((indo >= high) & (en >= low))
    lang = F.when(total == 0, "other").when(mixed, "mixed").when(en > indo, "en").otherwise("id")
    return F.struct(lang.alias("lang"), F.when(total != 0, F.round(F.abs(en - indo), 3)).alias("confidence"))


def classify(scored: DataFrame, detector: tuple[str, str] | None = None) -> DataFrame:
    """Adds lang, confidence and method to rows with stripped and scores.

    ``detector`` names two columns with a statistical detector's language and
    probability; without one its answer is other, without confidence.
    """
    label = wordlist_label(F.col("scores"))
    d = scored.withColumn("_w", label)
    found = F.col(detector[0]) if detector else F.lit("other")
    long_lang = F.when(found.isin("en", "id"), found).otherwise("other")
    long_conf = F.col(detector[1]) if detector else F.lit(None).cast("double")
    w, c = F.col("_w.lang"), F.col("_w.confidence")
    short = F.col("scores.n") < lx.SHORT_LINE_TOKENS
    blank = F.col("stripped") == ""
    across = ((long_lang == "en") & (w == "id")) | ((long_lang == "id") & (w == "en"))
    by_detector = (long_lang == w) | (F.coalesce(long_conf, F.lit(0.0)) >= F.coalesce(c, F.lit(0.0)))
    d = d.withColumn("lang", F.when(blank, "other").when(short, w).when(across, "mixed").when(by_detector, long_lang).otherwise(w))
    mixed_conf = F.least(F.coalesce(long_conf, F.lit(0.5)), F.lit(0.9))
    d = d.withColumn("confidence", F.when(blank, F.lit(None)).when(short, c).when(across, mixed_conf).when(by_detector, long_conf).otherwise(c).cast("double"))
    d = d.withColumn("method", F.when(blank, "combined").when(short, "wordlist").when(across, "combined").when(by_detector, "langdetect").otherwise("wordlist"))
    return d.drop("_w")


def line_languages(lines: DataFrame, detector: Callable[[str], tuple[str, float]] | None = None) -> DataFrame:
    """Lines with lang, confidence and method, by the word lists and ``detector``, if there is one."""
    found = detect(lines, detector) if detector else lines
    out = classify(found.withColumn("scores", lang_scores(F.col("stripped"))), ("found_lang", "found_prob") if detector else None)
    return out.drop("found_lang", "found_prob")


def lang_mix(lines: DataFrame) -> DataFrame:
    """doc_id, lang, n over lines that aren't blank."""
    labelled = line_languages(lines.where(F.col("stripped") != ""))
    return labelled.groupBy("doc_id", "lang").agg(F.count("*").alias("n"))


def report_lang(lines: DataFrame) -> DataFrame:
    """doc_id, lang: id if more lines are Indonesian than English, else en."""
    labelled = line_languages(lines)
    more = F.count_if((F.col("lang") == "id") & (F.col("stripped") != "")) > F.count_if((F.col("lang") == "en") & (F.col("stripped") != ""))
    return labelled.groupBy("doc_id").agg(F.when(more, "id").otherwise("en").alias("lang"))


def detect(lines: DataFrame, detector: Callable[[str], tuple[str, float]]) -> DataFrame:
    """Adds found_lang and found_prob of a statistical detector, in Arrow batches; where it fails, other without a probability.

    Only lines long enough to be asked about are sent to it.
    """
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for text in b["stripped"]:
                try:
                    got.append(detector(text))
                except Exception:
                    got.append(("other", None))
            yield b.assign(found_lang=[g[0] for g in got], found_prob=[g[1] for g in got])

    asked = lines.where(F.size(tokens(F.col("stripped"))) >= lx.SHORT_LINE_TOKENS)
    rest = lines.where(F.size(tokens(F.col("stripped"))) < lx.SHORT_LINE_TOKENS)
    none = rest.withColumns({"found_lang": F.lit(None).cast("string"), "found_prob": F.lit(None).cast("double")})
    return asked.mapInPandas(run, shape + ", found_lang string, found_prob double").unionByName(none)

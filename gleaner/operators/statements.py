"""What kind of statement a line makes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def quant_score(text: Column, strict_currency: bool = False) -> Column:
    """2 each for a percentage, money and a multiple, 1 for a number of three digits.

    Money is any letter of Rp before a digit too, unless ``strict_currency``.
    """
    money = lx.CURRENCY_STRICT if strict_currency else lx.CURRENCY
    return sum((text.rlike(p).cast("int") * w for p, w in ((lx.PERCENT, 2), (money, 2), (lx.MULTIPLIER, 2), (lx.BIG_NUMBER, 1))), F.lit(0))


def vague_cues(text: Column) -> Column:
    """The cue phrases in it, in the lists' order."""
    return tx.present(F.lower(text), lx.CUES)


def statement_class(text: Column, strict_currency: bool = False, whole_words: bool = False) -> Column:
    """(label, confidence, cues): achievement, responsibility, duty or other.

    Verbs and leadership words count inside other words too, unless
    ``whole_words``.
    """
    low = F.lower(text)
    inside = (lambda words: low.rlike(rf"\b(?:{'|'.join(words)})\b")) if whole_words else (lambda words: tx.any_of(low, words))
    seen = F.struct(quant_score(text, strict_currency).alias("quant"), vague_cues(text).alias("cues"), inside(lx.OUTCOME_VERBS).alias("verb"), inside(lx.LEADERSHIP).alias("leads"))
    return tx.let(seen, _decide)


def _decide(seen: Column) -> Column:
    quant, cues, verb, leads = (seen[k] for k in ("quant", "cues", "verb", "leads"))
    done = (quant >= 2) | ((quant >= 1) & verb)
    duty = (F.size(cues) > 0) | (verb & (quant == 0))
    label = F.when(done, "achievement").when(leads, "responsibility").when(duty, "duty").otherwise("other")
    sure = F.when(done, F.round(F.least(F.lit(0.6) + F.lit(0.1) * quant, F.lit(0.95)), 3)).when(leads, 0.7).when(duty, 0.65).otherwise(0.5)
    one = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    listed = F.concat(one(~done & leads, F.lit("leadership cue")), cues, one(verb, F.lit("outcome verb")), one(quant > 0, F.concat(F.lit("quantification="), quant.cast("string"))))
    return F.struct(label.alias("label"), sure.alias("confidence"), listed.alias("cues"))

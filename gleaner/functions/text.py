"""Column functions on text. Offsets are code points, from 0, half open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

SPACES = r"[ \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAKS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
LINE = rf"[^{BREAKS}]*(?:\r\n|[{BREAKS}])|[^{BREAKS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines with their line ends; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase is a substring; phrases hold no pattern characters but the hyphen."""
    return text.rlike("|".join(phrases))


def present(text: Column, phrases: list[str]) -> Column:
    """The phrases that are substrings, in their own order."""
    return let(text, lambda t: F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(t, p)))


def light_stem(token: Column) -> Column:
    """Takes one ending off: ies (to y), es, s, ing, ed if 3 characters stay; then a last e of 4 or more."""
    cut = token
    for suffix, put in reversed([("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ed", "")]):
        n = len(suffix)
        here = F.endswith(token, F.lit(suffix)) & (F.length(token) >= n + 3)
        cut = F.when(here, F.concat(F.substring(token, F.lit(1), F.length(token) - n), F.lit(put))).otherwise(cut)
    return F.when(F.endswith(cut, F.lit("e")) & (F.length(cut) >= 4), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def tokens(text: Column, pattern: str = lx.WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def content_words(text: Column, stop: list[str] | None = None) -> Column:
    """The set of stemmed words that are no stop words."""
    stop_words = F.array(*[F.lit(w) for w in (lx.STOP_WORDS if stop is None else stop)])
    kept = F.filter(tokens(text), lambda w: ~F.array_contains(stop_words, w))
    return F.array_distinct(F.transform(kept, light_stem))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of the union of two sets; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sums_before(sizes: Column, block: int = 64) -> Column:
    """For each element the sum of those before it. Summed by blocks first, so that long arrays don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def blocks(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), lambda b: F.slice(s, b * block + 1, F.lit(block)))
        return F.when(F.size(s) > 0, cut).otherwise(F.array().cast("array<array<int>>"))

    def inside(cut: Column, totals: Column) -> Column:
        one = lambda x, b: let(total(F.slice(totals, F.lit(1), b)), lambda before: F.transform(x, lambda _, j: before + total(F.slice(x, F.lit(1), j))))
        return F.flatten(F.transform(cut, one))

    return let(let(sizes, blocks), lambda cut: let(F.transform(cut, total), lambda totals: inside(cut, totals)))


def matches(text: Column, pattern: Column) -> Column:
    """All matches of a pattern that matches no empty text: array of (match, start_off, end_off).

    A match starts behind all matches and gaps before it.
    """
    empty = F.array().cast("array<struct<match:string,start_off:int,end_off:int>>")

    def zipped(p: Column) -> Column:
        gaps = F.slice(p["gaps"], F.lit(1), F.size(p["found"]))
        return F.zip_with(p["found"], gaps, lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"), F.length(m).alias("n")))

    def place(z: Column, before: Column) -> Column:
        at = lambda x, i: F.get(before, i) + x["gap"]
        return F.transform(z, lambda x, i: F.struct(x["match"].alias("match"), at(x, i).alias("start_off"), (at(x, i) + x["n"]).alias("end_off")))

    pieces = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    placed = let(let(pieces, zipped), lambda z: let(sums_before(F.transform(z, lambda x: x["gap"] + x["n"])), lambda before: place(z, before)))
    return F.coalesce(F.when(text.isNotNull(), placed), empty)


def starts(text: Column, ahead: str) -> Column:
    """(found, at) of a pattern of no width that holds one group: the groups and their places.

    Parted at such places, a text's pieces start at them, but for one before
    the first place if that isn't the text's start.
    """

    def place(p: Column) -> Column:
        sizes = F.transform(p["pieces"], lambda x: F.length(x))
        lead = F.size(p["pieces"]) - F.size(p["found"])
        at = let(sums_before(sizes), lambda before: F.slice(before, lead + 1, F.size(p["found"])))
        return F.arrays_zip(p["found"].alias("match"), at.alias("start_off"))

    pieces = F.struct(F.regexp_extract_all(text, F.lit(ahead), F.lit(1)).alias("found"), F.split(text, ahead, -1).alias("pieces"))
    empty = F.array().cast("array<struct<match:string,start_off:int>>")
    return F.coalesce(F.when(text.isNotNull(), let(pieces, lambda p: F.when(F.size(p["found"]) > 0, place(p)))), empty)


def occurrences(text: Column, phrase: Column) -> Column:
    """Starts of the occurrences of a phrase, from the left, without overlaps."""
    parts = F.split(text, F.concat(F.lit("\\Q"), phrase, F.lit("\\E")), -1)
    heads = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.length(x))
    return let(heads, lambda h: let(sums_before(F.transform(h, lambda n: n + F.length(phrase))), lambda before: F.transform(h, lambda n, i: F.get(before, i) + n)))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_pattern(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9 ])", r"\\$1")


def redact(text: Column) -> Column:
    """(text, n_emails, n_urls, n_phones, name): mail addresses, URLs, phone numbers and a name line replaced, in this order.

    Each pattern parts the text once: the pieces give the text and the count.
    """

    def name_line(t: Column, m: Column, u: Column, p: Column) -> Column:
        def replaced(head: Column, k: Column) -> Column:  # k: the first line that isn't blank, from 1, or 0
            line = F.get(head, k - 1)
            off = F.aggregate(F.slice(head, F.lit(1), F.greatest(k - 1, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x) + 1)
            named = F.coalesce(line.rlike(lx.NAME_LINE), F.lit(False))
            out = F.when(named, F.concat(F.substring(t, F.lit(1), off), F.lit("[NAME]"), F.substring(t, off + F.length(line) + 1, F.length(t)))).otherwise(t)
            return F.struct(out.alias("text"), (F.size(m) - 1).alias("n_emails"), (F.size(u) - 1).alias("n_urls"), (F.size(p) - 1).alias("n_phones"), named.alias("name"))

        first = lambda head: F.array_position(F.transform(head, lambda x: strip(x) != ""), True).cast("int")
        return let(F.slice(F.split(t, "\n", 6), 1, 5), lambda head: let(first(head), lambda k: replaced(head, k)))

    def phones(m: Column, u: Column) -> Column:
        return let(F.split(F.array_join(u, "[URL]"), lx.PHONE, -1), lambda p: let(F.array_join(p, "[PHONE]"), lambda t: name_line(t, m, u, p)))

    return let(F.split(text, lx.EMAIL, -1), lambda m: let(F.split(F.array_join(m, "[EMAIL]"), lx.URL, -1), lambda u: phones(m, u)))

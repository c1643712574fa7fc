"""The whole report of a document in one reading, in Python: no row leaves its task.

Each part is what the column operators beside this module make of it (lines,
extract, findings, language, relevance), whose joins and aggregations by
document would each shuffle the texts' lines. Patterns are read with ASCII
classes and boundaries, as the SQL does.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import lexicon as lx
from .extract import ahead, alias_forms, skills_at
from .render import MESSAGES

SPAN = "start_off int, end_off int"
PLACED = "text string, segment string, extractor string"
EVIDENCE = "array<struct<text:string,start:int,end:int,source_segment:string,line_number:int>>"
DETAILS = "struct<cue:string,score:string,missing:string,found:string>"
PARTS = (
    f"skills array<struct<{SPAN}, canonical string, {PLACED}>>, experiences array<struct<{SPAN}, title string, company string, start_date string, end_date string, {PLACED}>>, "
    f"education array<struct<{SPAN}, degree string, field_of_study string, institution string, gpa string, {PLACED}>>, "
    f"findings array<struct<finding_no int, kind string, message string, confidence double, evidence {EVIDENCE}, details {DETAILS}>>, "
    f"segs array<struct<name string, {SPAN}>>, lang string, n_en long, n_id long, n_mixed long, n_other long"
)
#: A batch is handed on at so many documents, or characters of texts and results.
DOCUMENTS, CHARACTERS = 256, 1_000_000
#: So many words' stems and languages are remembered.
REMEMBERED = 200_000

_pattern = lambda p: re.compile(p, re.ASCII)
LETTERS, WORD, NOT_LETTERS = _pattern("[a-z]+"), _pattern(lx.WORD), _pattern("[0-9+#]")
NOT_NAMED, DECIMAL = re.compile(r"[^\w \t\n\x0b\f\r/&]"), re.compile(r"\d")
AFFIXED = re.compile(f"(?:{'|'.join(lx.ID_PREFIXES)}).*(?:{'|'.join(lx.ID_SUFFIXES)})")
QUANTITIES = [(_pattern(p), w) for p, w in ((lx.PERCENT, 2), (lx.CURRENCY, 2), (lx.MULTIPLIER, 2), (lx.BIG_NUMBER, 1))]
DATE_RANGE, PRESENT, START_DATE, DEGREE, GPA = (_pattern(p) for p in (lx.DATE_RANGE, lx.PRESENT, lx.START_DATE, lx.DEGREE, lx.GPA))
TITLE_COMPANY = _pattern(lx.TITLE_COMPANY.removesuffix("$") + "(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)")
#: What every date range has behind its first four digits.
YEAR = _pattern(r"(?i)[0-9]{4}(?=\s*(?:-|–|—|to|until|s\.?d|hingga|sampai))")
MONTH = 9  # letters of the longest
#: The letters that a degree or grade begins with, up to what isn't one.
DEGREES = frozenset("bachelor master ph phd doctor doctorate b bs bsc m ms msc ba ma beng meng mtech sarjana s d diploma magister doktor".split())
GRADES = frozenset(["gpa", "ipk"])
EN, ID, STOP = frozenset(lx.EN_WORDS), frozenset(lx.ID_WORDS), frozenset(lx.STOP_WORDS)
HEADINGS = lx.heading_names()
ONE_ID = 1 << 32
#: Letters whose lower case holds an ASCII one.
FOLDED = ("\u212a", "\u0130")


def _skill_tables() -> list[tuple[frozenset[str], re.Pattern, dict, bool]]:
    """First words, pattern, (canonical, length) by match, and whether the match is lowered, of long and of short aliases."""
    long, short = alias_forms()
    return [(frozenset(WORD.search(a.lower())[0] for a in table), _pattern(ahead(list(table), flags)), skills_at(table), low) for table, flags, low in ((long, "(?i)", True), (short, "", False))]


SKILLS = _skill_tables()


class _Remembered(dict):
    """Results of a function of words, made where they are asked for."""

    def __init__(self, make: Callable[[str], object]):
        self.make = make

    def __missing__(self, word: str) -> object:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.make(word)
        return out


def _speaks(w: str) -> int:
    """1 for an English word, ONE_ID for an Indonesian one."""
    return (w in EN) + ONE_ID * (w in ID or (w not in EN and len(w) > 5 and AFFIXED.fullmatch(w) is not None))


def _stem(w: str) -> str | None:
    """None for stop words."""
    if w in STOP:
        return None
    for suffix, put in (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ed", "")):
        if w.endswith(suffix) and len(w) >= len(suffix) + 3:
            w = w[: len(w) - len(suffix)] + put
            break
    return w[:-1] if w.endswith("e") and len(w) >= 4 else w


SPEAKS, STEMS = _Remembered(_speaks), _Remembered(_stem)


def content_words(words: list[str]) -> set[str]:
    out = set(map(STEMS.__getitem__, words))
    out.discard(None)
    return out


@lru_cache(4096)
def half_up(x: float, places: int) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def language(letters: list[str]) -> str:
    """Of a line that isn't blank; without a detector, whose answer for long lines is other."""
    n, both = len(letters), sum(map(SPEAKS.__getitem__, letters))
    if not both:
        return "other"
    en, indo = (both % ONE_ID) / n, (both // ONE_ID) / n
    total = en + indo
    en, indo = en / total, indo / total
    high, low = 1 - lx.MIXED_SHARE, lx.MIXED_SHARE
    found = "mixed" if (en >= high and indo >= low) or (indo >= high and en >= low) else "en" if en > indo else "id"
    return found if n < lx.SHORT_LINE_TOKENS or half_up(abs(en - indo), 3) > 0 else "other"


def heading(line: str, stripped: str) -> str | None:
    bare = stripped.rstrip(":")
    if not bare or len(bare) > 40 or "\t" in line or bare[-1] in ".!?," or DECIMAL.search(bare) or not 1 <= len(bare.split()) <= 4:
        return None
    return HEADINGS.get(NOT_NAMED.sub("", bare.lower()).strip())


def duty_cue(stripped: str, low: str) -> str | None:
    """The first cue of a line that tells a duty, else None."""
    holds = low.__contains__
    cue, verb = next(filter(holds, lx.CUES), None), any(map(holds, lx.OUTCOME_VERBS))
    if (cue is None and not verb) or any(map(holds, lx.LEADERSHIP)):
        return None
    quant = sum(w for p, w in QUANTITIES if p.search(stripped))
    if quant >= 2 or (quant >= 1 and verb) or (cue is None and quant):
        return None
    return cue or "outcome verb"


def claim_span(low: str) -> tuple[int, int] | None:
    spans = []
    for c in filter(low.__contains__, lx.CLAIMS):
        at = low.find(c)
        while at >= 0:
            spans.append((at, at + len(c)))
            at = low.find(c, at + len(c))
    return (min(spans)[0], max(spans)[1]) if spans else None


def date_ranges(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of all matches of lx.DATE_RANGE, which is tried only where one can begin: before four digits and what joins two dates."""
    done = at = 0
    while year := YEAR.search(text, at):
        at = year.start() + 1
        if at <= done:
            continue
        d = w = year.start()
        while w and text[w - 1] in " \t\n\x0b\f\r":
            w -= 1
        places = sorted({*range(max(done, w - MONTH), w), *range(max(done, d - 3), d + 1)})
        m = next((m for m in (DATE_RANGE.match(text, s) for s in places) if m), None)
        if m:
            done = m.end()
            yield m.span()


def experience(text: str, start: int, end: int) -> dict:
    ls, le = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    le = len(text) if le < 0 else le
    head = text[ls:start].strip(" -–—:|•") or (text[text.rfind("\n", 0, ls - 1) + 1 : ls - 1].strip() if ls else "")
    two, match = TITLE_COMPANY.search(head), text[start:end]
    said = START_DATE.search(match)
    last = max(match.rfind(c) for c in "-–—")
    return {
        "start_off": ls, "end_off": le, "title": (two[1].strip() if two else head) or None, "company": (two and two[2].strip()) or None, "start_date": said[0] if said else "",
        "end_date": "present" if PRESENT.search(match) else match[last + 1 :].strip(), "text": text[ls:le],
    }


def degree(line: str, start: int) -> dict:
    own = line.rstrip("\r\n")
    d, g = DEGREE.search(own), GPA.search(own)
    return {
        "start_off": start, "end_off": start + len(own), "degree": (d and d[1]) or None, "field_of_study": (d and d[2]) or None, "institution": None,
        "gpa": (g and g[1] and g[1].replace(",", ".")) or None, "text": own,
    }


def skill_hits(line: str, start: int, words: list[str], folded: bool) -> Iterator[tuple[str, int, int, str]]:
    """canonical, start_off, minus end_off, text of every mention in a line of these words."""
    for first, pattern, table, low in SKILLS:
        for m in pattern.finditer(line) if folded or not first.isdisjoint(words) else ():
            for canonical, n in table[m[1].lower() if low else m[1]]:
                yield canonical, start + m.start(), -(start + m.start() + n), m[1][:n]


def redundant(classes: dict[frozenset[str], list[int]], threshold: float = 0.85) -> list[tuple[int, int, float]]:
    """Pairs of lines (by number, the lesser first) whose words mostly agree, with the score.

    Classes meet on the first of their words, those of fewest classes first, as in
    findings.redundant_pairs.
    """
    seen = Counter(chain.from_iterable(classes))
    shared_words = {w for w, n in seen.items() if n > 1}
    at: dict[str, list[frozenset[str]]] = defaultdict(list)
    out = [(a, b, 1.0) for own in classes.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    for c, own in classes.items():
        common = c & shared_words
        n = len(common) - math.ceil(threshold * len(c) - 1e-9) + 1
        if n <= 0:
            continue
        head = sorted(common, key=lambda w: (seen[w], w))[:n]
        met = {o for w in head for o in at[w] if min(len(o), len(c)) >= threshold * max(len(o), len(c)) - 1e-9}
        for o in met:
            shared = len(c & o)
            score = shared / (len(c) + len(o) - shared)
            if score >= threshold:
                out += [(min(a, b), max(a, b), score) for a in own for b in classes[o]]
        for w in head:
            at[w].append(c)
    return out


def read(text: str | None, asked: list[dict], index: dict[str, list[int]], threshold: float) -> dict:
    """A document's PARTS, and relevance for the requirements ``asked``, of whose words ``index`` tells."""
    text = text or ""
    folded = any(c in text for c in FOLDED)
    lines, segs, said, told, claims, vague, edu, mentions = [], [], Counter(), [], [], [], [], defaultdict(list)
    classes: dict[frozenset[str], list[int]] = {}
    best: list[tuple[float, str]] | None = None
    segment, off = "other", 0
    for no, line in enumerate(text.splitlines(True), 1):
        stripped = line.strip()
        start = off + len(line) - len(line.lstrip())
        named = heading(line, stripped)
        segment = named or segment
        if segs and segs[-1]["name"] == segment:
            segs[-1]["end_off"] = off + len(line)
        else:
            segs.append({"name": segment, "start_off": off, "end_off": off + len(line)})
        lines.append((stripped, start, segment))
        if stripped:
            low = stripped.lower()
            letters = LETTERS.findall(low)
            words = WORD.findall(low) if NOT_LETTERS.search(low) else letters
            n_words = len(stripped.split())
            said[language(letters)] += 1
            own = content_words(words)
            if len(own) >= 4:
                classes.setdefault(frozenset(own), []).append(no)
            if asked and n_words >= 3:
                best = best or [(0.0, stripped)] * len(asked)
                for k, n in Counter(k for w in own & index.keys() for k in index[w]).items():
                    if n / asked[k]["n"] > best[k][0]:
                        best[k] = (n / asked[k]["n"], stripped)
            if n_words >= 5 and (cue := duty_cue(stripped, low)):
                vague.append((no, cue))
            if segment in ("experience", "education"):
                if named is None:
                    told.append(low)
            elif n_words >= 4 and (span := claim_span(low)):
                claims.append((no, span))
            for canonical, *hit in skill_hits(line, off, words, folded):
                mentions[canonical].append(hit)
            if ((folded or not DEGREES.isdisjoint(letters)) and DEGREE.search(line)) or ((folded or not GRADES.isdisjoint(letters)) and GPA.search(line)):
                edu.append(degree(line, off))
        off += len(line)

    starts = [s["start_off"] for s in segs]
    place = lambda x: x | {"segment": segs[bisect_right(starts, x["start_off"]) - 1]["name"], "extractor": "rules"}
    skills = []
    for canonical, hits in mentions.items():
        last = -1
        for s, e, t in sorted(hits):
            if s >= last:
                last = -e
                skills.append(place({"start_off": s, "end_off": -e, "canonical": canonical, "text": t}))
    listed = lambda rows: sorted(rows, key=lambda x: [(v is not None, v) for v in x.values()])

    lang = "id" if said["id"] > said["en"] else "en"
    piece = lambda no, words=None, start=None: {
        "text": lines[no - 1][0] if words is None else words, "start": lines[no - 1][1] if start is None else start,
        "end": (lines[no - 1][1] if start is None else start) + len(lines[no - 1][0] if words is None else words), "source_segment": lines[no - 1][2], "line_number": no,
    }
    findings: list[dict] = []

    def find(kind: str, confidence: float | None, evidence: list[dict], cue: str | None = None, score: str | None = None, missing: str | None = None, found: str | None = None) -> None:
        slots = {"line_no": evidence[0]["line_number"], "line_a": evidence[0]["line_number"], "line_b": evidence[-1]["line_number"], "evidence": evidence[0]["text"], "evidence_b": evidence[-1]["text"]}
        message = MESSAGES[kind][lang].format(**slots, cue=cue, score=score, missing=missing, found=found)
        details = {"cue": cue, "score": score, "missing": missing, "found": found}
        findings.append({"finding_no": len(findings) + 1, "kind": kind, "message": message, "confidence": confidence, "evidence": evidence, "details": details})

    have = {s["name"] for s in segs}
    missing, head = [s for s in lx.SECTIONS if s not in have], text[:80]
    if missing and head.strip():
        lead = len(head) - len(head.lstrip())
        shown = {"text": head.strip(), "start": lead, "end": lead + len(head.strip()), "source_segment": "document", "line_number": None}
        find("missing_section", None, [shown], missing=", ".join(missing), found=", ".join(sorted(have)))
    for no, cue in vague:
        find("vague_bullet", 0.65, [piece(no)], cue=cue)
    for a, b, score in sorted(redundant(classes)):
        sure = half_up(score, 3)
        find("redundant_pair", float(sure), [piece(a), piece(b)], score=str(half_up(float(sure), 2)))
    support = " ".join(told)
    for no, (first, last) in claims:
        claim = lines[no - 1][0][first:last]
        if not any(len(w) > 3 and w in support for w in claim.lower().split()):
            find("unsupported_claim", 0.6, [piece(no, claim, lines[no - 1][1] + first)])

    areas = best and [
        {"jd_id": r["jd_id"], "req_no": r["req_no"], "requirement": r["requirement"], "matched_text": line if s >= threshold else None, "similarity": float(half_up(s, 4)), "matched": s >= threshold}
        for r, (s, line) in zip(asked, best, strict=True)
    ]
    experiences = [place(experience(text, *span)) for span in date_ranges(text)]
    return {
        "skills": listed(skills), "experiences": listed(experiences), "education": listed(map(place, edu)), "findings": findings, "segs": segs, "lang": lang,
        **{f"n_{x}": said[x] for x in ("en", "id", "mixed", "other")}, "relevance": areas,
    }


def parts(docs: DataFrame, requirements: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, PARTS and relevance of each document (doc_id, text); ``requirements`` are few and go to every task. Nothing is shuffled."""
    kind = lambda c: requirements.schema[c].dataType.simpleString() if requirements is not None else "int"
    area = f"relevance array<struct<jd_id {kind('jd_id')}, req_no {kind('req_no')}, requirement string, matched_text string, similarity double, matched boolean>>"
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PARTS}, {area}"
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(shape)])
    asked, index = [], defaultdict(list)
    if requirements is not None:
        wanted = [r.asDict() for r in requirements.select("jd_id", "req_no", "requirement").collect()]
        asked = sorted(wanted, key=lambda r: [(v is not None, v) for v in r.values()])
    for k, r in enumerate(asked):
        own = content_words(WORD.findall((r["requirement"] or "").lower()))
        r["n"] = len(own)
        for w in own:
            index[w].append(k)
    shared = docs.sparkSession.sparkContext.broadcast((asked, dict(index)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:]]
            return pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)).cast(arrow.field(0).type), *columns], schema=arrow)

        for b in batches:
            rows, size, first = [], 0, 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                rows.append(read(text, *shared.value, threshold))
                size += len(text or "") + sum(len(f["message"]) * 2 for f in rows[-1]["findings"])
                if len(rows) >= DOCUMENTS or size >= CHARACTERS:
                    yield made()
                    rows, size, first = [], 0, i + 1
            if rows:
                yield made()

    return docs.select("doc_id", "text").mapInArrow(run, shape)

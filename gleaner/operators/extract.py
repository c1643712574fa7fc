"""Skills, date ranges, experience and education entries, entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .lines import span_segment


def ahead(aliases: list[str], flags: str) -> str:
    """A pattern of no width before the longest alias at a place, between an alias's boundaries."""
    quoted = {a: "".join(c if c.isalnum() or c == " " else "\\" + c for c in a) for a in aliases}
    heads = "".join("\\" + c if c in "[]^-&\\" else c for c in sorted({a[0] for a in aliases}))
    longest = "|".join(quoted[a] for a in sorted(aliases, key=lambda a: (-len(a), a)))
    return rf"{flags}(?<![A-Za-z0-9+#.])(?=[{heads}])(?=({longest})(?![A-Za-z0-9+#]))"


def skills_at(aliases: dict[str, list[str]]) -> dict[str, list[tuple[str, int]]]:
    """Longest alias at a place -> (canonical, length) of all aliases there: those that start it and end at a boundary."""
    out = {}
    for long in aliases:
        here = [a for a in aliases if long.startswith(a) and (a == long or not (long[len(a)].isalnum() or long[len(a)] in "+#"))]
        out[long] = [(c, len(a)) for a in here for c in aliases[a]]
    return out


def alias_forms() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Canonicals by alias: lower-case aliases of three characters and more; shorter ones in their own and upper case."""
    long: dict[str, list[str]] = {}
    short: dict[str, list[str]] = {}
    for _, canonical, alias in lx.skill_rules():
        if len(alias) > 2:
            long.setdefault(alias.lower(), []).append(canonical)
        else:
            for form in dict.fromkeys((alias, alias.upper())):
                short.setdefault(form, []).append(canonical)
    return long, short


def skill_hits(text: F.Column) -> F.Column:
    """All matches of all aliases in a text, overlapping ones too: array of (canonical, text, start_off, end_off).

    The text is read twice, whatever the number of aliases: once for aliases of
    three characters and more, whatever their case, once for shorter ones in
    their own or upper case. The longest alias at a place tells the others.
    """
    long, short = alias_forms()

    def found(aliases: dict[str, list[str]], flags: str, form) -> F.Column:
        table = F.create_map(*[x for a, at in skills_at(aliases).items() for x in (F.lit(a), F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(n).alias("n")) for c, n in at]))])
        mention = lambda h, s: F.struct(s["canonical"].alias("canonical"), F.substring(h["match"], F.lit(1), s["n"]).alias("text"), h["start_off"].alias("start_off"), (h["start_off"] + s["n"]).alias("end_off"))
        return F.flatten(F.transform(tx.starts(text, ahead(list(aliases), flags)), lambda h: F.transform(F.element_at(table, form(h["match"])), lambda s: mention(h, s))))

    return F.concat(found(long, "(?i)", F.lower), found(short, "", lambda m: m))


def skill_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, canonical, text, start_off, end_off: a row for each match; nothing is shuffled."""
    return docs.select("doc_id", F.explode(skill_hits(F.col("text"))).alias("m")).select("doc_id", "m.canonical", "m.text", "m.start_off", "m.end_off")


def skill_dedup(mentions: DataFrame) -> DataFrame:
    """Of overlapping mentions of one canonical the first and longest; the kept ones are apart.

    A mention that starts behind all before it is kept and opens an island;
    within an island of overlapping ones each is held against the last kept, in
    order. Islands are short whatever a document's length.
    """
    order = Window.partitionBy("doc_id", "canonical").orderBy("start_off", F.col("end_off").desc(), "text")
    reach = F.max("end_off").over(order.rowsBetween(Window.unboundedPreceding, -1))
    m = mentions.withColumn("new", F.coalesce((F.col("start_off") >= reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    spans = m.groupBy("doc_id", "canonical", "island").agg(F.sort_array(F.collect_list(F.struct("start_off", (-F.col("end_off")).alias("neg"), "text"))).alias("spans"))
    empty = F.array().cast("array<struct<start_off:int,neg:int,text:string>>")
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(-1).alias("last"), empty.alias("kept")),
        lambda acc, x: F.when(x["start_off"] >= acc["last"], F.struct((-x["neg"]).alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc),
    )["kept"]
    out = spans.select("doc_id", "canonical", F.explode(kept).alias("m"))
    return out.select("doc_id", "canonical", "m.text", "m.start_off", (-F.col("m.neg")).alias("end_off"))


def skill_set(mentions: DataFrame) -> DataFrame:
    """doc_id, canonical, without repeats."""
    return mentions.select("doc_id", "canonical").distinct()


def date_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, start_off, end_off of every date range."""
    found = docs.select("doc_id", F.explode(tx.matches(F.col("text"), F.lit(lx.DATE_RANGE))).alias("m"))
    return found.select("doc_id", F.col("m.match").alias("text"), "m.start_off", "m.end_off")


def experiences(docs: DataFrame, whole_separators: bool = False) -> DataFrame:
    """doc_id, title, company, start_date, end_date, start_off, end_off (of the date's line), text (the line).

    The head is what stands before the date, or else the line above. With
    ``whole_separators`` the words 'at' and 'di' part title and company only as
    words of their own.
    """
    d = docs.select("doc_id", "text", F.explode(tx.matches(F.col("text"), F.lit(lx.DATE_RANGE))).alias("m")).select("doc_id", "text", "m.*")
    before = F.substring(F.col("text"), F.lit(1), F.col("start_off"))
    d = d.withColumn("ls", F.col("start_off") - F.length(F.substring_index(before, "\n", -1)))
    d = d.withColumn("le", F.col("end_off") + F.length(F.substring_index(F.substring(F.col("text"), F.col("end_off") + 1, F.length("text")), "\n", 1)))
    d = d.withColumn("line", F.substring(F.col("text"), F.col("ls") + 1, F.col("le") - F.col("ls")))
    above = F.when(F.col("ls") > 0, tx.strip(F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("ls") - 1), "\n", -1))).otherwise("")
    own = F.btrim(F.substring(F.col("line"), F.lit(1), F.col("start_off") - F.col("ls")), F.lit(" -–—:|•"))
    d = d.withColumn("head", F.when(own != "", own).otherwise(above))
    pattern = lx.TITLE_COMPANY.replace("|at|di)", r"|\bat\b|\bdi\b)") if whole_separators else lx.TITLE_COMPANY
    two = F.col("head").rlike(pattern)
    title = F.when(two, tx.strip(F.regexp_extract("head", pattern, 1))).otherwise(F.col("head"))
    company = F.when(two, tx.strip(F.regexp_extract("head", pattern, 2)))
    after_dash = tx.strip(F.regexp_replace("match", r"(?s)^.*[-–—]", ""))
    return d.select(
        "doc_id",
        F.nullif(title, F.lit("")).alias("title"),
        F.nullif(company, F.lit("")).alias("company"),
        F.regexp_extract("match", lx.START_DATE, 0).alias("start_date"),
        F.when(F.col("match").rlike(lx.PRESENT), F.lit("present")).otherwise(after_dash).alias("end_date"),
        F.col("ls").cast("int").alias("start_off"),
        F.col("le").cast("int").alias("end_off"),
        F.col("line").alias("text"),
    )


def education(lines: DataFrame) -> DataFrame:
    """doc_id, degree, field_of_study, institution (never found), gpa, start_off, end_off, text of lines with a degree or grade."""
    line = F.regexp_replace("text", r"[\r\n]+$", "")
    part = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    gpa = F.replace(part(lx.GPA, 1), F.lit(","), F.lit("."))
    return lines.where(F.col("text").rlike(lx.DEGREE) | F.col("text").rlike(lx.GPA)).select(
        "doc_id", part(lx.DEGREE, 1).alias("degree"), part(lx.DEGREE, 2).alias("field_of_study"), F.lit(None).cast("string").alias("institution"),
        gpa.alias("gpa"), "start_off", (F.col("start_off") + F.length(line)).cast("int").alias("end_off"), line.alias("text"),
    )


def word_spans(docs: DataFrame) -> DataFrame:
    """doc_id, word_no (from 1), text, start_off, end_off: words of letters and digits, joined by single . ' + # / -"""
    found = docs.select("doc_id", F.posexplode(tx.matches(F.col("text"), F.lit(r"[A-Za-z0-9]+(?:[.'+#/\-][A-Za-z0-9]+)*"))).alias("i", "m"))
    return found.select("doc_id", (F.col("i") + 1).alias("word_no"), F.col("m.match").alias("text"), "m.start_off", "m.end_off")


#: So many chunks of words at a time are held as Python objects.
CHUNKS = 64

ENTITY_KINDS = {"PER": "name", "ORG": "org", "LOC": "misc", "DATE": "date"}


def bio_spans(labelled: DataFrame, docs: DataFrame, chunk: int = 100) -> DataFrame:
    """doc_id, label, canonical, text, start_off, end_off of entities.

    ``labelled`` has word_spans' columns and tag (B-X, I-X or O), from any
    model. B opens an entity, I of the same kind goes on, all else closes; an I
    that goes on with nothing is dropped. Chunks of ``chunk`` words are apart.
    """
    w = labelled.withColumn("chunk", F.floor((F.col("word_no") - 1) / chunk)).withColumn("kind", F.substring("tag", 3, 20))
    order = Window.partitionBy("doc_id", "chunk").orderBy("word_no")
    broken = F.col("tag").startswith("B-") | ~F.col("tag").startswith("I-") | F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True))
    w = w.withColumn("new", broken.cast("int")).withColumn("island", F.sum("new").over(order))
    spans = w.groupBy("doc_id", "chunk", "island").agg(
        F.min_by("tag", "word_no").alias("tag"), F.min_by("kind", "word_no").alias("kind"), F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off")
    )
    spans = spans.where(F.col("tag").startswith("B-")).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    label = F.lit("misc")
    for kind, name in ENTITY_KINDS.items():
        label = F.when(F.col("kind") == kind, F.lit(name)).otherwise(label)
    text = F.substring(F.col("whole"), F.col("start_off") + 1, F.col("end_off") - F.col("start_off"))
    return spans.select("doc_id", label.alias("label"), F.substring(F.upper(tx.strip(text)), 1, 80).alias("canonical"), text.alias("text"), "start_off", "end_off")


def entity_skills(entities: DataFrame) -> DataFrame:
    """doc_id, canonical, text, start_off, end_off: organisations and other entities that are a skill's name; a broadcast join with the dictionary."""
    names = entities.sparkSession.createDataFrame(list(lx.alias_lookup().items()), "_alias string, _skill string")
    e = entities.where(F.col("label").isin("org", "misc")).withColumn("_key", F.lower(tx.strip(F.col("text"))))
    return e.join(F.broadcast(names), F.col("_key") == F.col("_alias")).select("doc_id", F.col("_skill").alias("canonical"), "text", "start_off", "end_off")


def merge_skills(rules: DataFrame, nlp: DataFrame) -> DataFrame:
    """All mentions of the rules, and those of the model that overlap none of the same canonical; exact repeats go, the rules' first."""
    r = rules.select(F.col("doc_id").alias("_d"), F.col("canonical").alias("_c"), F.col("start_off").alias("_s"), F.col("end_off").alias("_e"))
    new = nlp.join(r, (F.col("doc_id") == F.col("_d")) & (F.col("canonical") == F.col("_c")) & (F.col("start_off") < F.col("_e")) & (F.col("_s") < F.col("end_off")), "left_anti")
    cols = ["doc_id", "canonical", "text", "start_off", "end_off"]
    both = rules.select(*cols, F.lit("rules").alias("extractor")).unionByName(new.select(*cols, F.lit("rules+nlp").alias("extractor")))
    first = Window.partitionBy("doc_id", "start_off", "end_off", "canonical").orderBy("extractor", "text")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def rules_extraction(docs: DataFrame, lines: DataFrame, segs: DataFrame) -> dict[str, DataFrame]:
    """The rules' whole result: skills, experiences and education, each with the segment that holds its start, and extractor."""
    found = {"skills": skill_dedup(skill_mentions(docs)), "experiences": experiences(docs), "education": education(lines)}
    return {k: span_segment(v, segs).withColumn("extractor", F.lit("rules")) for k, v in found.items()}


def pseudo_gold(docs: DataFrame) -> DataFrame:
    """doc_id, canonical of which an English alias stands alone, in all lower case and with a dot allowed before it.

    A looser reading than the rules': what it finds is no annotation.
    """
    d = docs.select("doc_id", F.lower("text").alias("low"))
    aliases = F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(a).alias("alias")) for c, forms in lx.SKILLS_EN.items() for a in forms])
    held = d.select("doc_id", "low", F.explode(F.filter(aliases, lambda r: F.contains("low", r["alias"]))).alias("r"))
    alone = F.expr("low rlike concat('(?<![a-z0-9+#])', regexp_replace(r.alias, '([^A-Za-z0-9 ])', '\\\\\\\\$1'), '(?![a-z0-9+#])')")
    return held.where(alone).select("doc_id", "r.canonical").distinct()


def word_tags(words: DataFrame, tag: Callable[[list[str]], tuple[list[int], list[str]]], chunk: int = 100, max_pieces: int = 510) -> DataFrame:
    """``words`` (of word_spans) with tag, from a model that reads pieces.

    ``tag`` gets the words of a chunk and gives the number of pieces of each
    word and the label of each piece. A word's tag is the first of its pieces'
    labels that isn't O; what lies behind ``max_pieces`` pieces is O, as is all
    of a chunk whose call fails.
    """
    w = words.withColumn("chunk", F.floor((F.col("word_no") - 1) / chunk))
    lists = w.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("word_no", "text", "start_off", "end_off"))).alias("words"))

    def tags_of(texts: list[str]) -> list[str]:
        tags, at = ["O"] * len(texts), 0
        try:
            counts, labels = tag(texts)
            for i, n in enumerate(counts):
                tags[i] = next((x for x in labels[at : min(at + n, max_pieces)] if x != "O"), "O")
                at += n
        except Exception:
            tags = ["O"] * len(texts)
        return tags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, CHUNKS) for whole in batches for i in range(0, whole.num_rows, CHUNKS)):  # only these chunks' words become Python objects
            own, sizes = b.column(1).flatten(), b.column(1).value_lengths().to_numpy()
            texts, ends = own.field("text").to_pylist(), np.cumsum(sizes)
            tags = [x for end, n in zip(ends, sizes, strict=True) for x in tags_of(texts[end - n : end])]
            docs = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([docs, *[own.field(c) for c in names], pa.array(tags, pa.string())], names=["doc_id", *names, "tag"])

    names = ["word_no", "text", "start_off", "end_off"]
    shape = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in ["doc_id", *names])
    return lists.select("doc_id", "words").mapInArrow(run, f"{shape}, tag string")

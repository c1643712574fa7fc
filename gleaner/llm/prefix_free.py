"""Removal of long repeated byte strings by prefix-free parsing.

Triggers are rolling-hash minima: a 16-byte gram is a trigger of every window of
``length`` bytes in whose first ``reach`` bytes it has the smallest hash (the
last of equals). Triggers depend on bytes inside the window alone, so equal
windows have theirs at the same place wherever they lie, and every window has
one. They cut a text into phrases: a phrase is a trigger with all windows it
rules, that is, the bytes from the first of them to the end of the last.

The parse is the sequence of these phrases, the dictionary the distinct ones.
Where a phrase is in the dictionary twice, all its windows repeat, and only its
count is needed. What is left are the edges of repeats: phrases that differ but
share the bytes behind their trigger. Two suffix arrays order them, trigger by
trigger: the parse's, of what follows each trigger, and the dictionary's, of
what phrases hold before it. Their neighbours' common prefixes give, for every
offset, the classes of equal bytes on either side; a window's two classes
together are its place in the corpus order, and windows of one place are equal.
Phrases that share nothing behind their trigger with another hold no repeated
window, and are never looked at again, so the order is made where repeats can
be, not for the whole corpus.

All of this compares bytes. Dictionary entries, and windows of a trigger that
too many phrases share for one task, go by 128-bit BLAKE2b digests of theirs;
rolling hashes only choose triggers and bring candidates together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Prefix, raw_texts
from .common import drop, slices, stash
from .imi import by_key

GRAM, BUFFER, PLACE = 16, 1 << 18, np.uint64((1 << 20) - 1)
PHRASES = "id long, th long, t int, dmin int, dmax int, b long, c binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def phrases(data: np.ndarray, ends: list[tuple[int, int]], length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Trigger, first and last window start, and hash of the bytes behind the trigger, of each phrase of texts ``ends`` in a buffer."""
    prefix = Prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    key = (prefix.of(at, at + GRAM) & ~PLACE) | (PLACE - at.astype(np.uint64))
    low = sliding_min(key, reach)
    trigger = (PLACE - (low & PLACE)).astype(np.int64)
    p = np.concatenate([np.arange(s, e - length + 1) for s, e in ends])
    t = trigger[p]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)]))
    lo, hi, t = p[new], p[np.concatenate([new[1:] - 1, [len(p) - 1]])], t[new]
    return t, lo, hi, prefix.of(t, t + length - reach + 1)


def digest_of(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def parse(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """The phrases of all texts: place, offsets dmin..dmax from window starts to the trigger, hash b of what all its windows hold behind it, digest c."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, 2)):
            data, offsets = raw_texts(batch.column(2))
            pieces: list[tuple[int, int, int]] = []  # row, start, end; pieces of a long text overlap by length - 1
            for row, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                while e - s >= length:
                    pieces.append((row, s, min(e, s + BUFFER)))
                    if e - s <= BUFFER:
                        break
                    s += BUFFER - length + 1
            i = 0
            while i < len(pieces):
                j, total = i, 0
                while j < len(pieces) and (j == i or total + pieces[j][2] - pieces[j][1] <= BUFFER):
                    total += pieces[j][2] - pieces[j][1]
                    j += 1
                group = pieces[i:j]
                i = j
                buffer = np.concatenate([data[s:e] for _, s, e in group])
                sizes = np.array([e - s for _, s, e in group])
                starts = np.cumsum(sizes) - sizes
                t, lo, hi, b = phrases(buffer, list(zip(starts.tolist(), (starts + sizes).tolist(), strict=True)), length, reach)
                which = np.searchsorted(starts, lo, side="right") - 1
                rows = np.array([g[0] for g in group])[which]
                origin = np.array([g[1] - int(offsets[g[0]]) for g in group])[which] - starts[which]
                take, raw = pa.array(rows), buffer.data
                c = [digest_of(raw[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((t + origin).astype(np.int32)), pa.array((t - hi).astype(np.int32)),
                     pa.array((t - lo).astype(np.int32)), pa.array(b.view(np.int64)), pa.array(c, pa.binary())],
                    names=["id", "th", "t", "dmin", "dmax", "b", "c"],
                )

    return docs.select("id", "th", "text").mapInArrow(cut, PHRASES)


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings, and the length of the prefix that each shares with the one before it in that order."""
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__))
    size = np.array([len(x) for x in texts])
    width = max(1, int(size.max(initial=1)))
    at = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)[order]
    differ = at[1:] != at[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.minimum(shared, np.minimum(size[order][1:], size[order][:-1]))


def classes(texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """For each of ``lengths``, a row of numbers that are equal for strings that agree in that many bytes; shorter strings count for nothing."""
    order, shared = suffix_array(texts)
    out = np.zeros((len(lengths), len(texts)), np.int64)
    out[:, order[1:]] = np.cumsum(shared[None, :] < lengths[:, None], axis=1)
    return out


def corpus_places(phrases: list[bytes], dmin: np.ndarray, dmax: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, and for each offset and phrase the number of the window's bytes; -1 where the phrase has no such window.

    Phrases share their trigger, which lies dmax bytes from their starts. The
    parse's suffixes begin at it, the dictionary's end at it and are compared
    from their ends.
    """
    offsets = np.arange(int(dmin.min()), int(dmax.max()) + 1)
    after = classes([x[d:] for x, d in zip(phrases, dmax.tolist(), strict=True)], length - offsets)
    before = classes([x[:d][::-1] for x, d in zip(phrases, dmax.tolist(), strict=True)], offsets)
    has = (offsets[:, None] >= dmin) & (offsets[:, None] <= dmax)
    return offsets, np.where(has, before * len(phrases) + after, -1)


def _edges(edges: DataFrame, length: int, most: int) -> DataFrame:
    """id, th, s, e: the repeated windows of phrases that occur once, among phrases of the same group b."""
    sizes = stash(edges.groupBy("b").agg(F.count("*").alias("size")), "edge-sizes")
    sized = edges.join(sizes, "b")
    small = sized.where((F.col("size") > 1) & (F.col("size") <= most)).drop("size").repartition("b").sortWithinPartitions("b")

    def order(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = pa.Table.from_batches(rows)
        t, dmin, dmax, n = (x.column(k).to_numpy().astype(np.int64) for k in ("t", "dmin", "dmax", "n"))
        offsets, place = corpus_places(x.column("bytes").to_pylist(), dmin, dmax, length)
        along = np.argsort(place, axis=1, kind="stable")
        sorted_place = np.take_along_axis(place, along, 1)
        same = (sorted_place[:, 1:] == sorted_place[:, :-1]) & (sorted_place[:, 1:] >= 0)
        twice = np.zeros(place.shape, bool)
        np.put_along_axis(twice, along, np.pad(same, ((0, 0), (1, 0))) | np.pad(same, ((0, 0), (0, 1))), 1)
        # by phrase, its windows in the order of the text
        twice = twice.T[:, ::-1] & (n == 1)[:, None]
        edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        which, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        if len(which):
            high = offsets[::-1]
            s, e = t[which] - high[first], t[which] - high[last - 1] + length
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [x.column("id").combine_chunks().take(take), x.column("th").combine_chunks().take(take), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["id", "th", "s", "e"]
            )

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for (b,), part in by_key(batches, ["b"]):
            if b != now:
                out += order(rows) if rows else []
                now, rows = b, []
                if len(out) >= 64:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
            rows.append(part)
        out += order(rows) if rows else []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    found = small.mapInArrow(by_group, "id long, th long, s int, e int")
    # a group too large for one task: its windows are counted one by one
    large = sized.where(F.col("size") > most).drop("size")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (piece for whole in batches for piece in slices(whole, 7, 1 << 17)):
            rows, d, h = [], [], []
            for i, (raw, low, high) in enumerate(zip(*(x.column(k).to_pylist() for k in ("bytes", "dmin", "dmax")), strict=True)):
                rows += [i] * (high - low + 1)
                d += range(high, low - 1, -1)
                h += [digest_of(raw[k : k + length]) for k in range(high - low + 1)]
            take, off = pa.array(rows, pa.int64()), np.array(d, np.int32)
            s = x.column("t").take(take).to_numpy() - off
            columns = [x.column("id").take(take), x.column("th").take(take), pa.array(s.astype(np.int32)), pa.array((s + length).astype(np.int32)), pa.array(h, pa.binary()), x.column("n").take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "s", "e", "h", "n"])

    order_of = ["id", "th", "t", "dmin", "dmax", "b", "n", "bytes"]
    windows = large.select(*order_of).mapInArrow(explode, "id long, th long, s int, e int, h binary, n long")
    # a phrase that occurs more than once is in the dictionary once, so its windows count with it
    twice = windows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return found.unionByName(windows.where("n = 1").join(twice, "h").select("id", "th", "s", "e"))


def repeated_spans(docs: DataFrame, length: int, reach: int, most: int) -> DataFrame:
    """id, th, spans (array of s, e): byte ranges that repeated windows cover, of rows id, th, text."""
    parsed = stash(parse(docs, length, reach), "phrases")
    # what joins on b is written first: then a hot b is split where it is joined
    shared = stash(parsed.groupBy("b").agg(F.count("*").alias("k")).where("k > 1").select("b"), "shared")
    every, parsed = parsed, stash(parsed.join(shared, "b", "left_semi"), "shared-phrases")
    drop(every, shared)
    # the dictionary: distinct phrases with their counts and one place of each
    entry = ["b", "dmin", "dmax", "c"]
    dictionary = stash(parsed.groupBy(*entry).agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "t")).alias("at")), "dictionary")
    whole = parsed.join(dictionary.where("n > 1").select(*entry), entry, "left_semi")
    whole = whole.select("id", "th", (F.col("t") - F.col("dmax")).alias("s"), (F.col("t") - F.col("dmin") + length).alias("e"))
    mixed = stash(dictionary.groupBy("b").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("b"), "mixed")
    needed = dictionary.join(mixed, "b", "left_semi").select("at.*", "b", "dmin", "dmax", "n")
    needed = needed.groupBy("id", "th").agg(F.collect_list(F.struct("t", "dmin", "dmax", "b", "n")).alias("phrases"))  # a text's own

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in slices(whole, 2)):
            out: dict[str, list] = {k: [] for k in ("id", "th", "t", "dmin", "dmax", "b", "n", "bytes")}
            for i, th, text, own in zip(*(b.column(k) for k in ("id", "th", "text", "phrases")), strict=True):
                raw = text.as_buffer().to_pybytes()
                for x in own.as_py():
                    out["id"].append(i.as_py())
                    out["th"].append(th.as_py())
                    for k in ("t", "dmin", "dmax", "b", "n"):
                        out[k].append(x[k])
                    out["bytes"].append(raw[x["t"] - x["dmax"] : x["t"] - x["dmin"] + length])
            types = {"id": pa.int64(), "th": pa.int64(), "t": pa.int32(), "dmin": pa.int32(), "dmax": pa.int32(), "b": pa.int64(), "n": pa.int64(), "bytes": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in out], names=list(out))

    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    held = docs.select("id", "th", "text").join(needed.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "phrases"), same)
    edges = stash(held.select("id", "th", "text", "phrases").mapInArrow(read, "id long, th long, t int, dmin int, dmax int, b long, n long, bytes binary"), "edges")
    # equal rows (id and text) read their phrases twice; those phrases repeat and are no edges of their own
    spans = whole.unionByName(_edges(edges.dropDuplicates(["b", "dmin", "dmax", "id", "th", "t"]), length, most))
    out = stash(spans.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")  # a text's own
    drop(parsed, dictionary, mixed, edges)
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, reach: int = 200, digest: bool = False, most: int = 20_000
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, and the text that is left or its digest.

    Every byte that a ``length``-byte string covers which also starts anywhere
    else, in this text or another, is removed; overlaps count, texts are UTF-8
    and matches end with them. n_spans counts maximal removed runs. With
    ``digest`` the last column is kept_sha256, else kept (binary: a cut may
    part a character). Null texts count as empty. Repeated rows repeat each
    other. Columns other than id and text are not read. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(d, length, reach, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in slices(whole, 1)):
            size, removed, runs, kept = [], [], [], []
            for text, own in zip(b.column("text"), b.column("spans"), strict=True):
                raw = text.as_buffer().to_pybytes()
                left, at, gone, n = [], 0, 0, 0
                for x in sorted((x["s"], x["e"]) for x in own.as_py()) if own.is_valid else ():
                    if x[0] > at or n == 0:
                        left.append(raw[at : x[0]])
                        at, n = x[0], n + 1
                    if x[1] > at:
                        gone, at = gone + x[1] - at, x[1]
                left.append(raw[at:])
                out = b"".join(left)
                size.append(len(raw))
                removed.append(gone)
                runs.append(n)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", last],
            )

    last = "kept_sha256" if digest else "kept"
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    joined = d.join(spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans"), same, "left").select("id", "text", "spans")
    return joined.mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")

"""Near-duplicate documents: MinHash bands, odd sketches, and exact confirmation.

A document is the set of its word shingles. Its MinHash samples give band keys
for the candidate search and are folded into an odd sketch: a bitmap in which
each sample flips one bit. The population count of two sketches' XOR estimates
how many samples differ, precisely where similarities are high, so candidates
that can't reach the threshold go before any text is moved. What remains is
confirmed on the full sets of the words themselves, computed anew from the
texts; only sets that agree in all hashes, 64 bits of a cryptographic digest a
word, are taken as equal without that.

Documents with equal sets are one class. A bucket of a band is never expanded
into pairs. Each class is tried against the class that leads most of its
buckets, and confirmed links are joined into components. Then, in buckets that
hold several components, members outside the largest one are compared with all,
sketch by sketch, in blocks: for a few rounds the nearest partner of each is
tried, and at last every pair across components that its sketches allow. So no
link between components is lost, and a group of near copies costs about one
confirmation for each. A second odd sketch, of the whole set, makes this last
step small: sets can't be more alike than it says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix
from .common import drop, slices, stash, trimmed
from .components import connected_components
from .imi import by_key

SAMPLES, ROWS, SKETCH_BITS, FULL_BITS = 128, 5, 512, 2048  # 25 bands of 5 samples: a pair at 0.8 shares none once in 20,000
BANDS = SAMPLES // ROWS


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_A = _odd(1, SAMPLES)
_W = _odd(2, 64)
_S = _odd(3, SAMPLES)


class WordHashes(dict):
    """Word -> 64 bits of its BLAKE2b digest; words seen lately are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = got
        return got


def words_of(text: pa.Scalar) -> list[bytes]:
    """The words of a whole text; bytes.lower() changes A-Z only, bytes.split() parts at ASCII white space only."""
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def shingle_hashes(own: list[bytes], words: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words."""
    n = len(own)
    w = np.fromiter(map(known.__getitem__, own), np.uint64, n)
    if n >= words:
        h = w[: n - words + 1] * _W[0]
        for k in range(1, words):
            h = h + w[k : n - words + 1 + k] * _W[k]
        return np.unique(mix(h))
    if n:
        return mix(np.array([(w * _W[:n]).sum() + np.uint64(n)], np.uint64))
    return w


def shingle_set(own: list[bytes], words: int) -> set[bytes]:
    """The shingles themselves; a word holds no space, so the joint text tells its words."""
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[i : i + 2048, None] * _A).min(0), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Rows of samples to rows of bitmaps: a bit is the parity of the samples that fall on it."""
    bit = (mix(samples ^ _S) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(samples))[:, None] * SKETCH_BITS
    parity = np.bincount(bit.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(parity.reshape(len(samples), SKETCH_BITS).astype(np.uint8), axis=1)


def most_differing(similarity: float, deviations: float = 5.0) -> int:
    """XOR population count that a pair of this similarity stays under but for ``deviations`` standard deviations."""
    low = similarity - deviations * (similarity * (1 - similarity) / SAMPLES) ** 0.5
    apart = 2 * SAMPLES * (1 - max(0.0, low))
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * apart / SKETCH_BITS))) + 1


def estimate(differing: int) -> float:
    """Similarity from a XOR population count."""
    return 1 - (-SKETCH_BITS / 2 * np.log(max(1e-9, 1 - 2 * differing / SKETCH_BITS))) / (2 * SAMPLES)


def full_sketch(s: np.ndarray) -> bytes:
    """The odd sketch of a whole set: two of them never differ in more bits than their sets do in elements."""
    bit = (mix(s ^ _S[0]) % np.uint64(FULL_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=FULL_BITS) & 1).astype(np.uint8)).tobytes()


def most_apart(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """How many elements two sets of these sizes may differ in: 100 * shared >= percent * union, solved for the rest."""
    return (100 - percent) * (na + nb) // (100 + percent)


def words64(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n (size of the set), c (hash of the set, null if it is empty), bands and sketch, per row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in (piece for whole in batches for piece in slices(whole, 1)):
            n, c, rows, at, full = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                s = shingle_hashes(words_of(text), words, known)
                n.append(len(s))
                c.append(set_hash(s) if len(s) else None)
                full.append(full_sketch(s) if len(s) else None)
                if len(s):
                    rows.append(minhash(s))
                    at.append(i)
            bands, sketches = [None] * len(n), [None] * len(n)
            if rows:
                m = np.stack(rows)
                keys = np.zeros((len(m), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys + m[:, r * BANDS : (r + 1) * BANDS]) + np.arange(1, BANDS + 1, dtype=np.uint64) * _W[r]
                odd = odd_sketch(m)
                for k, i in enumerate(at):
                    bands[i], sketches[i] = keys[k].view(np.int64), odd[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(full, pa.binary())],
                names=["id", "n", "c", "bands", "sketch", "full"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        trimmed(sign), "id long, n long, c binary, bands array<long>, sketch binary, full binary"
    )


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose sizes and sketches allow ``percent``."""
    info = classes.select("c", "n", "sketch", "full")
    d = pairs.join(info.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("full").alias("fa")), "a")
    d = d.join(info.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("full").alias("fb")), "b")
    d = d.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    most = most_differing(percent / 100)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = np.bitwise_count(words64(b.column("sa")) ^ words64(b.column("sb"))).sum(1) <= most
                apart = np.bitwise_count(words64(b.column("fa")) ^ words64(b.column("fb"))).sum(1)
                keep &= apart <= most_apart(b.column("na").to_numpy(), b.column("nb").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return d.select("a", "b", "na", "nb", "sa", "sb", "fa", "fb").mapInArrow(close, "a binary, b binary")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, chunks: int = 64) -> DataFrame:
    """Those pairs a, b whose full sets, from the whole texts, reach ``percent``."""
    needed = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    needed = stash(needed.join(classes.select("c", "id"), "c"), "needed")
    few = needed.count() <= 50_000  # then 2 MB at most
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = stash(texts.join(F.broadcast(needed) if few else needed, F.col("_id").eqNullSafe(F.col("id"))).select("c", "text"), "texts")
    # a class with many partners is dealt in up to ``chunks`` groups, each with its text
    p = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(chunks)).cast("int"))
    first = p.select("a", "chunk").distinct().join(texts.withColumnRenamed("c", "a"), "a").select("a", "chunk", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rest = p.select("a", "chunk", "b").join(texts.withColumnRenamed("c", "b"), "b").select("a", "chunk", F.lit(1).alias("kind"), "b", "text")
    dealt = first.unionByName(rest).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "kind")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, known = None, None, WordHashes()
        for key, b in by_key((piece for whole in batches for piece in slices(whole, 4)), ["a", "chunk", "kind"]):
            if key[:2] != now:
                now, own = key[:2], None
            out = []
            for c, text in zip(b.column("b").to_pylist(), b.column("text"), strict=True):
                mine = words_of(text)
                if set_hash(shingle_hashes(mine, words, known)) != c:
                    continue  # another row of the same id
                if key[2] == 0:
                    own = shingle_set(mine, words)
                elif own is not None:
                    s = shingle_set(mine, words)
                    both = len(own & s)
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        out.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.binary()), pa.array(out, pa.binary())], names=["a", "b"])

    out = stash(dealt.mapInArrow(trimmed(confirm), "a binary, b binary"), "confirmed")
    drop(needed, texts)
    return out


def _grow(pairs: DataFrame, links: DataFrame | None, tried: DataFrame | None, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, ...]:
    """links, components and tried pairs with those of ``pairs``."""
    new = _confirm(pairs, classes, docs, id_col, text_col, words, percent)
    links = new if links is None else links.unionByName(new)
    tried = pairs if tried is None else tried.unionByName(pairs)
    return links, stash(connected_components(links, "a", "b"), "components"), tried


def _leaders(members: DataFrame) -> DataFrame:
    """One pair a, b for each class b that is not its buckets' smallest: the one that leads most of them, the smaller of equals."""
    lead = members.groupBy("key").agg(F.min("c").alias("a"))
    led = members.join(lead, "key").where(F.col("a") != F.col("c")).groupBy("c", "a").agg(F.count("*").alias("n"))
    best = led.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "a")).alias("top"))
    return best.select("top.a", F.col("c").alias("b"))


def _across(members: DataFrame, comps: DataFrame, classes: DataFrame, tried: DataFrame, percent: int, nearest: bool, block: int = 2048) -> DataFrame:
    """Pairs of a bucket, not tried yet, that lie in different components and whose sketches allow ``percent``.

    With ``nearest`` only the one of most similar sketches for each class
    outside its bucket's largest component.
    """
    m = members.join(comps.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    per = m.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("size"), F.count("*").alias("roots"))
    chunks = lambda n: F.ceil(n / block).cast("int")
    per = per.where("roots > 1").select("key", F.col("top.root").alias("main"), chunks(F.col("size")).alias("blocks"), chunks(F.col("size") - F.col("top.k")).alias("probes"))
    m = held_rows = stash(m.join(per, "key"), "mixed")
    m = m.join(classes.select("c", "n", "sketch", "full"), "c")
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    alone = F.pmod(F.xxhash64("c", F.lit(7)), F.col("probes")).cast("int")
    names = ["key", "x", "y", "kind", "c", "root", "n", "sketch", "full"]
    held = m.withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("probes") - 1))).withColumn("kind", F.lit(0))
    asked = m.where(F.col("root") != F.col("main")).withColumn("y", alone).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(1))
    dealt = held.select(*names).unionByName(asked.select(*names)).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "kind")
    most = most_differing(percent / 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buffer, ready = None, [], None
        out: list[list] = [[], [], []]

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64())], names=["p", "o", "apart"])
            for x in out:
                x.clear()
            return b

        for key, b in by_key(batches, ["key", "x", "y", "kind"]):
            if key[:3] != now:
                now, buffer, ready = key[:3], [], None
            if key[3] == 0:
                buffer.append(b)
                continue
            if not buffer:
                continue
            if ready is None:
                t = pa.Table.from_batches(buffer).combine_chunks()
                cs, roots = t.column("c").to_pylist(), t.column("root").to_pylist()
                ready = cs, roots, t.column("n").to_numpy(), words64(t.column("sketch")), words64(t.column("full"))
            cs, roots, n, x, full = ready
            own_n, own_x, own_full = b.column("n").to_numpy(), words64(b.column("sketch")), words64(b.column("full"))
            for i, (c, root) in enumerate(zip(b.column("c").to_pylist(), b.column("root").to_pylist(), strict=True)):
                near = np.flatnonzero(np.bitwise_count(x ^ own_x[i]).sum(1) <= most)
                apart = np.bitwise_count(full[near] ^ own_full[i]).sum(1)
                fits = apart <= most_apart(n[near], own_n[i], percent)
                near, share = near[fits], apart[fits] / (n[near[fits]] + own_n[i])
                for j in np.argsort(share, kind="stable").tolist():
                    if roots[near[j]] != root:
                        out[0].append(c)
                        out[1].append(cs[near[j]])
                        out[2].append(float(share[j]))
                        if nearest:
                            break
            if len(out[0]) > 10_000:
                yield flush()
        yield flush()

    found = dealt.mapInArrow(trimmed(compare), "p binary, o binary, apart double")
    if nearest:
        found = found.groupBy("p").agg(F.min(F.struct("apart", "o")).alias("top")).select("p", "top.o")
    out = stash(found.select(F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    drop(held_rows)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80, rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents link if ``percent`` of the union of their shingle sets is shared.
    With fewer than ``words`` words the whole sequence is the one shingle; null
    and empty texts have none and link with nothing. component_id is the
    smallest id reachable by links. Rows of one id are one document. Null ids
    link like others and are never the smallest unless all are null. Columns
    other than id and text are not read.
    """
    sigs = stash(signatures(docs, id_col, text_col, words), "signatures")
    filled = sigs.where(F.col("c").isNotNull())
    classes = stash(filled.groupBy("c").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("full").alias("full")), "classes")
    in_bands = classes.select(F.explode("bands").alias("key"), "c")
    crowded = in_bands.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z")).where(F.col("a") < F.col("z")).select("key")
    members = stash(in_bands.join(crowded, "key"), "members")  # of buckets with two classes or more
    pairs, tried, links = stash(_near(_leaders(members), classes, percent), "pairs"), None, None
    # nearest partners across components, and at last all pairs that are left
    for nearest in [*[True] * rounds, False]:
        if links is None or pairs.limit(1).count():
            links, comps, tried = _grow(pairs, links, tried, classes, docs, id_col, text_col, words, percent)
        elif nearest:
            continue
        pairs = _across(members, comps, classes, tried, percent, nearest)
    if pairs.limit(1).count():
        links, comps, tried = _grow(pairs, links, tried, classes, docs, id_col, text_col, words, percent)
    drop(members)
    placed = classes.select("c", "id").join(comps, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    info = placed.join(smallest, "root").select("c", "component_id")
    out = sigs.select("id", "n", "c").join(info, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

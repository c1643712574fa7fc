"""SentencePiece BPE encoding by backtracking, and decoding.

A text's encoding by merging is found without merging it. At each position the
longest piece is tried first (one Aho-Corasick pass gives the longest match at
every start). A piece may follow another only if the two would not have merged
across their border: the pair is taken apart along the merges that made the
pieces, and stands if no step finds a merge across the border that would have
come first. Where no piece fits, the last one is given up for a shorter one,
and a bitfield keeps positions that lead nowhere, so none is tried twice. Of
a unit without unknown characters only the longest matches at places that the
backtracking comes to are asked for.

Runs of the space mark are the one place where merges tie in score; there the
leftmost pair merges first, which is done as such.

The vocabulary is read from the model file on the driver and broadcast (its
size is the vocabulary's, 32,000 pieces here); executors need no file.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, slices, trimmed

SPACE = "▁"
UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class PieceTable:
    """What encoding and decoding need of a model; plain data, so that it can be broadcast."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.byte_id, self.normal = {}, {}
        self.surface: list[bytes | None] = []  # None: one raw byte, see raw
        self.raw: dict[int, int] = {}
        self.control = frozenset(i for i in range(n) if sp.is_control(i))
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.raw[i] = int(p[3:5], 16)
                self.byte_id[self.raw[i]] = i
                self.surface.append(None)
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.normal[p] = i
                self.surface.append(p.replace(SPACE, " ").encode())
        self._derive()

    def _derive(self) -> None:
        """Order of merges, and for each piece the two pieces of its last merge."""
        chars = [p for p in self.normal if len(p) == 1]
        merged = sorted((p for p in self.normal if len(p) > 1 and p.strip(SPACE)), key=lambda p: -self.scores[self.normal[p]])
        order = chars + merged
        self.rank = {p: r for r, p in enumerate(order)}
        self.ids = [self.normal[p] for p in order]
        self.text = order
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.join: dict[tuple[int, int], int] = {}
        self.reachable = [True] * len(order)
        for r in range(len(chars), len(order)):
            p = order[r]
            # the piece's own encoding by merges that come before it must be two pieces
            parts = self._merge(p, r)
            if len(parts) != 2:
                self.reachable[r] = False
                continue
            self.left[r], self.right[r] = parts
            self.join[parts[0], parts[1]] = r
        self.shorter: list[int] = []
        for p in order:
            self.shorter.append(next((self.rank[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.rank and self.reachable[self.rank[p[:k]]]), -1))

    def _merge(self, text: str, below: int) -> list[int]:
        parts = [self.rank.get(c, -1) for c in text]
        if -1 in parts:
            return parts
        while len(parts) > 1:
            best = min((self.rank.get(self.text[a] + self.text[b], below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts


class Memo(dict):
    """Results of ``make`` for short units: the last ``size`` of them, and of those before them the ones asked for since."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size = make, size
        self.old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        out = self.old.get(unit)
        if out is None:
            out = self.make(unit)
        if len(unit) <= 64:
            if len(self) >= self.size:
                self.old = self.copy()
                self.clear()
            self[unit] = out
        return out


class PieceCodec:
    """Encodes and decodes with a PieceTable. Memoises units of text, twice ``memo`` of them at most."""

    def __init__(self, table: PieceTable, memo: int = 60_000):
        self.t, self.memo_size = table, memo
        self.memo = Memo(self._unit, memo)
        self.pairs: dict[int, bool] = {}  # by a * 2**32 + b, up to 4 * memo of them
        self.bytes_of = [i.to_bytes(4, "little") for i in table.ids]  # by rank
        self.auto = ahocorasick.Automaton()
        for r, p in enumerate(table.text):
            if table.reachable[r]:
                self.auto.add_word(p, (r, len(p)))
        self.auto.make_automaton()
        self.surface = [s if s is not None else bytes([table.raw[i]]) for i, s in enumerate(table.surface)]

    def encode(self, text: str) -> np.ndarray:
        """Ids with begin and end."""
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def encode_bytes(self, text: str) -> bytes:
        t = self.t
        begin, end = t.bos.to_bytes(4, "little"), t.eos.to_bytes(4, "little")
        if not text:
            return begin + end
        units = UNITS.findall(SPACE + text.replace(" ", SPACE))
        return b"".join([begin, *map(self.memo.__getitem__, units), end])

    def _unit(self, unit: str) -> bytes:
        """Merges never cross the border of a unit: no piece holds a space mark after another character, nor a newline."""
        if unit[0] != SPACE or (len(unit) > 1 and unit[1] != SPACE):  # no mark or one, and then text
            ranks = self._ranks(unit)
            return b"".join(map(self.bytes_of.__getitem__, ranks)) if ranks else np.array(self._backtrack(unit), "<u4").tobytes()
        marks = len(unit) - len(unit.lstrip(SPACE))
        if marks == len(unit):
            ids = self._spaces(marks)
        else:
            head = self._backtrack(unit[marks - 1 :])
            if self.t.pieces[head[0]] == SPACE:  # the last mark stayed alone: it belongs to the run
                ids = self._spaces(marks) + head[1:]
            else:
                ids = self._spaces(marks - 1) + head
        return np.array(ids, "<u4").tobytes()

    def _ranks(self, s: str) -> list[int] | None:
        """Pieces (by rank) of a unit; None if a character is unknown.

        The search gives longest match after longest match; where one doesn't
        fit, it goes on from the places that backtracking comes to.
        """
        tokens, pos, pairs = [], 0, self.pairs
        for end, (r, k) in self.auto.iter_long(s):
            if end - k + 1 != pos:
                return None
            if tokens:
                fits = pairs.get(tokens[-1] << 32 | r)
                if not (self._fits(tokens[-1], r) if fits is None else fits):
                    return self._back(s, tokens, pos, r)
            tokens.append(r)
            pos = end + 1
        return tokens if pos == len(s) else None

    def _back(self, s: str, tokens: list[int], pos: int, nxt: int) -> list[int] | None:
        """_ranks from where ``nxt`` is to be tried behind ``tokens``, which end at ``pos``."""
        text, shorter, search, pairs, stop = self.t.text, self.t.shorter, self.auto.iter_long, self.pairs, len(s)
        failed = bytearray(stop + 1)
        while True:
            end = pos + len(text[nxt])
            fits = not failed[end]
            if fits and tokens:
                fits = pairs.get(tokens[-1] << 32 | nxt)
                if fits is None:
                    fits = self._fits(tokens[-1], nxt)
            if fits:
                tokens.append(nxt)
                pos = end
                if pos == stop:
                    return tokens
                last, (nxt, k) = next(search(s, pos), (-1, (0, 0)))
                if last - k + 1 != pos:
                    return None
            elif shorter[nxt] >= 0:
                nxt = shorter[nxt]
            else:
                failed[pos] = 1
                nxt = tokens.pop()
                pos -= len(text[nxt])

    def _spaces(self, n: int) -> list[int]:
        """A run of n marks: all merges tie, the leftmost goes first."""
        t = self.t
        if n <= 1:
            return [t.normal[SPACE]] * n
        score = {k: t.scores[t.normal[SPACE * k]] for k in range(1, 65) if SPACE * k in t.normal}
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[2], i, i + 1, 2) for i in range(n - 1)] if 2 in score else []
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not size[i] or not (j < n and size[j]) or after[i] != j or size[i] + size[j] != k:
                continue
            size[i], size[j] = k, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if k + size[after[i]] in score:
                    heapq.heappush(heap, (-score[k + size[after[i]]], i, after[i], k + size[after[i]]))
            if before[i] >= 0 and size[before[i]] + k in score:
                heapq.heappush(heap, (-score[size[before[i]] + k], before[i], i, size[before[i]] + k))
        return [t.normal[SPACE * k] for k in size if k]

    def _fits(self, a: int, b: int) -> bool:
        """Whether pieces a, b (by rank) stay apart when their joint text is merged."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is not None:
            return got
        t, limit, fits = self.t, 1 << 60, True
        while True:
            joined = t.join.get((a, b))
            if joined is not None and joined < limit:
                fits = False
                break
            if a > b:
                limit, a = a, t.right[a]
                if a == limit:  # a is a character
                    limit, b = b + 1, t.left[b]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, t.left[b]
                if b + 1 == limit:
                    limit, a = a, t.right[a]
                    if a == limit:
                        break
        if len(self.pairs) > 4 * self.memo_size:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def _backtrack(self, s: str) -> list[int]:
        """Ids of a unit, its unknown characters as bytes."""
        t = self.t
        longest = [-1] * len(s)
        for end, (r, k) in self.auto.iter(s):  # of matches with one start the longest ends last
            longest[end - k + 1] = r
        out: list[int] = []
        i = 0
        while i < len(s):
            if longest[i] < 0:
                out += [t.byte_id[b] for b in s[i].encode("utf-8", "surrogatepass")] if t.byte_id else [t.unk]
                i += 1
                continue
            j = i  # up to the next unknown character: nothing merges across one
            while j < len(s) and longest[j] >= 0:
                j += 1
            out += self._stretch(s, i, j, longest)
            i = j
        return out

    def _stretch(self, s: str, start: int, stop: int, longest: list[int]) -> list[int]:
        t = self.t
        text, shorter = t.text, t.shorter
        failed = bytearray(stop - start + 1)
        tokens: list[int] = []
        pos, nxt = start, longest[start]
        while pos < stop:
            end = pos + len(text[nxt])
            if not failed[end - start] and (not tokens or self._fits(tokens[-1], nxt)):
                tokens.append(nxt)
                pos = end
                if pos < stop:
                    nxt = longest[pos]
            elif shorter[nxt] >= 0:
                nxt = shorter[nxt]
            else:
                failed[pos - start] = 1
                nxt = tokens.pop()
                pos -= len(text[nxt])
        return [t.ids[r] for r in tokens]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text, the space of the first mark taken off; bytes that are no UTF-8 become U+FFFD each."""
        surface, k = self.surface, 0
        while k < len(ids) and not surface[ids[k]]:
            k += 1
        if not self.t.control.isdisjoint(ids[k:-1]):  # they part runs of byte pieces
            return self._repair(ids)
        out = b"".join(map(surface.__getitem__, ids[k:]))
        if k < len(ids) and self.t.pieces[ids[k]].startswith(SPACE):
            out = out[1:]
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return self._repair(ids)

    def _repair(self, ids: list[int]) -> bytes:
        t, out, run, first = self.t, [], bytearray(), True

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + k]).decode().encode())
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    i += 1
            run.clear()

        for i in ids:
            if i in t.raw:
                run.append(t.raw[i])
                first = False
                continue
            flush()
            s = self.surface[i]
            if s:
                out.append(s[1:] if first and t.pieces[i].startswith(SPACE) else s)
                first = False
        flush()
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(list(ids)).decode()


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: the id, n_tokens, and ids with the decoded text, or their digests.

    With ``digest`` the columns are ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the decoded text in
    UTF-8); else ids (array of int) and decoded. Every text is decoded from its
    ids. A null text counts as empty: begin and end ids only. Rows are independent; repeated rows give repeated results, null ids stay null and
    extra columns are left out. An empty table gives an empty result.
    """
    shared = Shared(docs.sparkSession, PieceTable(model_file), PieceCodec)  # the vocabulary's size
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    kinds = {"ids_sha256": "string", "decoded_sha256": "string"} if digest else {"ids": "array<int>", "decoded": "string"}
    schema = f"`{id_col}` {id_type}, n_tokens long, " + ", ".join(f"{k} {v}" for k, v in kinds.items())
    names = [id_col, "n_tokens", *kinds]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for b in (piece for whole in batches for piece in slices(whole, 1, 1 << 19)):
            raws = [codec.encode_bytes(text.as_py() or "") for text in b.column(1)]
            n = np.array([len(raw) // 4 for raw in raws], np.int64)
            if digest:
                columns = [pa.array([hashlib.sha256(raw).hexdigest() for raw in raws], pa.string())]
            else:
                ids = np.frombuffer(b"".join(raws), "<u4").astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))]
            texts = (codec.decode_bytes(np.frombuffer(raw, "<u4").tolist()) for raw in raws)
            columns.append(pa.array([hashlib.sha256(t).hexdigest() if digest else t.decode() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *columns], names=names)
        codec.memo.old = {}

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(encode), schema)

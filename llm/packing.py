"""Order-preserving packing of token streams by dynamic programming.

Each partition packs its own rows, in the order it holds them, so nothing is
shuffled. The stream of a partition is cut into windows of at most ``size`` tokens at
document ends and sentence ends (and, where a sentence is longer than ``STEP``
tokens, also inside it). With cost(window) = padding and a penalty for the place of
the cut (0 at a document's end, SENTENCE at a sentence's, INSIDE elsewhere),

    best[j] = min over i with j - size <= i < j of best[i] + size - (j - i) + penalty(j)

is a sliding-window minimum of best[i] + i, kept in a monotone queue; windows whose
length is in POWERS need no padding and are three more transitions; each window costs
OPEN, so that padding is not saved by many short ones. The stream
is handled in blocks of about BLOCK tokens: all windows but the last of a block are
final, and the last one's tokens start the next block, so memory does not grow.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SENTENCE, INSIDE, OPEN, STEP, BLOCK, WORDS_KEPT = 2, 16, 16, 128, 262_144, 800_000
RESULTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
POWERS = (256, 512, 1024)  # lengths without padding that are worth a sequence of their own
_ENDS, _INK = np.isin(np.arange(256), list(b".!?")), ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
# Chunks that are cut here (letters, then anything of ASCII and Latin-1 letters), and the tokenizer's own
# pattern over them: contractions, letters, single digits, other signs.
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_WORD = re.compile(rb"(" + _LETTERS + rb"*)((?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)").fullmatch
_MIXED = re.compile(rb"['0-9A-Za-z\xc3]").search
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3.)+|[0-9]|[^a-z0-9\xc3]+", re.DOTALL).findall
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 128 <= b <= 158 else b for b in range(256))  # of ASCII, and of Latin-1 letters in UTF-8
#: Bytes as the byte-level models show them: printable ones as they are, the others from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SHOWN = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
_tokenizers: dict[str, Words] = {}


def _plain(spec: dict) -> bool:
    """Whether a tokenizer composes, lower-cases and cuts as ``_PIECES`` does, and then only shows bytes."""
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": _PATTERN}
            and cut[0]["invert"] and cut[0]["behavior"] == "Removed" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"])


class Words(dict):
    """White-space-free chunk (bytes) -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space before anything else, so a text's ids are those of
    its chunks in turn. A chunk of ASCII signs and Latin-1 letters is cut here as the
    tokenizer cuts it (it is its own composed form), and its model, which is most of a new
    chunk's cost, gets the pieces; any other chunk goes through the whole tokenizer.
    The map is emptied when full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if _plain(json.loads(self.tokenizer.to_str())) else None
        self.signs: dict[bytes, bytes] = {}

    def __missing__(self, c: bytes) -> bytes:
        """Letters and then signs mostly, else pieces; signs and digits are met again and again."""
        if len(self) > WORDS_KEPT:
            self.clear()
            self.signs.clear()
        core = c.rstrip(b".,!?")
        if core.isalpha() and self.model:  # ASCII
            end = c[len(core) :]
        else:
            word = _WORD(c) if self.model else None
            if word is None or b"<|" in c:  # special tokens
                ids = self[c] = array("I", self.tokenizer.encode(c.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
                return ids
            core, end = word.groups()
        if core == c:
            core = core.translate(_LOWER)
            ids = self[c] = array("I", [t.id for t in self.model.tokenize(core.decode() if core.isascii() else charmap_decode(core, "strict", _SHOWN)[0])]).tobytes()
            return ids
        ids = self[core] if core else b""
        for p in _PIECES(end.translate(_LOWER)) if _MIXED(end) else (end,):
            got = self.signs.get(p)
            if got is None:
                got = self.signs[p] = self[p] if p.isalpha() else array("I", [t.id for t in self.model.tokenize(charmap_decode(p, "strict", _SHOWN)[0])]).tobytes()
            ids += got
        self[c] = ids
        return ids

    def ids(self, text: str | None, end: int) -> tuple[bytes, np.ndarray]:
        """Ids of the text and ``end``; the places after a sentence, in tokens."""
        data = (text or "").encode("utf-8", "replace")
        data = data if b"<|" in data else data.lower()  # special tokens are matched before lower-casing
        parts = list(map(self.__getitem__, data.split()))
        parts.append(end.to_bytes(4, "little"))
        d = np.frombuffer(data, np.uint8)
        ink = _INK[d]
        last = d[ink & ~np.append(ink[1:], False)]  # of each chunk
        stops = np.flatnonzero(_ENDS[last])
        at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[stops] // 4
        return b"".join(parts), at


def cuts(places: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices of the places (ascending, from 0, steps of at most ``size``) of the cheapest cuts; first and last included."""
    at, pen = places.tolist(), penalty.tolist()
    where = dict(zip(at, range(len(at)), strict=True))
    powers = [p for p in POWERS if p < size]
    best, back, queue = [0] * len(at), [0] * len(at), deque([0])
    worth = [0] * len(at)  # best[i] + at[i]
    for j in range(1, len(at)):
        x = at[j]
        while at[queue[0]] < x - size:
            queue.popleft()
        i = queue[0]
        cost = worth[i] + size - x
        for p in powers:
            k = where.get(x - p)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        best[j], back[j] = cost + pen[j] + OPEN, i
        worth[j] = w = best[j] + x
        while queue and worth[queue[-1]] >= w:
            queue.pop()
        queue.append(j)
    out, j = [len(at) - 1], len(at) - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


class _Packer:
    def __init__(self, size: int, base: int):
        self.size, self.next, self.docs, self.held = size, base, [], 0

    def add(self, doc: object, ids: bytes, stops: np.ndarray, first: int = 0) -> None:
        self.docs.append((doc, ids, stops, first))
        self.held += len(ids) // 4 - first

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of all windows (of all but the last one, unless ``last``)."""
        if not self.docs:
            return []
        places, pens, base, starts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0, []
        for _, ids, stops, first in self.docs:
            n = len(ids) // 4
            starts.append(base)
            marks = np.concatenate([[first], stops[np.searchsorted(stops, first, "right") :], [n]])
            gaps = np.diff(marks)
            x, pen = marks[1:], np.full(len(marks) - 1, SENTENCE)
            pen[-1] = 0
            if gaps.min() == 0:  # signs that are no tokens
                x, pen = x[gaps > 0], pen[gaps > 0]
            wide = np.flatnonzero(gaps > STEP)
            if len(wide):
                inner = np.concatenate([np.arange(marks[w] + STEP, marks[w + 1], STEP) for w in wide])
                both = np.concatenate([x, inner])
                order = np.argsort(both, kind="stable")
                x, pen = both[order], np.concatenate([pen, np.full(len(inner), INSIDE)])[order]
            places.append(x - first + base)
            pens.append(pen)
            base += n - first
        at = np.concatenate(places)
        chosen = at[cuts(at, np.concatenate(pens), self.size)]
        ends = np.array([*starts[1:], base])
        upto = len(chosen) - 1 if last or len(chosen) < 3 else len(chosen) - 2
        out: list[tuple] = []
        d = 0
        for w in range(upto):
            lo, hi = int(chosen[w]), int(chosen[w + 1])
            offset = 0
            while lo < hi:
                while ends[d] <= lo:
                    d += 1
                doc, ids, _, first = self.docs[d]
                n = min(hi, int(ends[d])) - lo
                s = lo - starts[d] + first
                out.append((doc, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), len(ids) // 4, self.next, offset))
                offset += n
                lo += n
            self.next += 1
        end = int(chosen[upto])
        rest = [(doc, ids, stops, max(first, first + end - s)) for (doc, ids, stops, first), s, e in zip(self.docs, starts, ends.tolist(), strict=True) if e > end]
        self.docs, self.held = rest, base - end
        return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of ``docs`` (text string and any other columns, which pass): start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's tokens are the text's ids and ``end_id``; null and empty texts are that one
    id. Every token lies in exactly one piece. Sequences are unique over all partitions
    (the partition's number times 2^33 and a counter). Repeated rows are packed as often
    as they occur; columns of ``docs`` with the name of a result are replaced by it; an
    empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != "text" and c.lower() not in RESULTS]
    renamed = docs.select(*[docs[c].alias(f"in_{c}") for c in keep], docs["text"].alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema if f.name != "text"]
    names = list(RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, TaskContext.get().partitionId() << 33)
        schema, words = None, _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, Words(tokenizer_path))

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            own = pa.array(cols[0], pa.struct(schema)) if schema else None
            left = own.flatten() if own is not None else []
            return pa.RecordBatch.from_arrays([*left, *(pa.array(c, pa.int64()) for c in cols[1:])], [*(f.name for f in schema), *names])

        for b in batches:
            schema = [f for f in b.schema if f.name != "text"]
            texts, rows = b.column("text"), b.select([f.name for f in schema])
            for i in range(b.num_rows):
                ids, stops = words.ids(texts[i].as_py(), end_id)
                packer.add({f.name: rows.column(k)[i].as_py() for k, f in enumerate(schema)}, ids, stops)
                if packer.held >= BLOCK and (pieces := packer.pack(False)):
                    yield batch(pieces)
        while packer.docs and (pieces := packer.pack(True)):
            yield batch(pieces)

    out = renamed.mapInArrow(run, ", ".join([*kinds, *(f"{n} long" for n in names)]))
    return out.select(*[out[f"in_{c}"].alias(c) for c in keep], *names)

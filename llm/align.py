"""Alignment of two tokenizers' tokens over the same text.

Both token lists are lists of byte ends over " " + text. The shorter list drives: each of
its ends is looked up in the longer one by galloping (steps that double, from where the
end would lie if tokens were even, then halving between the last two), all ends of some
documents at once. Ends that both lists have cut the tokens into groups. The rank of
a token's end and that of the end before it are the first and last token of the longer list
that it overlaps, so links come from differences of ranks, never from comparing tokens.

How many documents hold a linked pair of ids is counted over the whole corpus without
a row for each document and pair: a chunk of documents keeps its own table of
distinct pairs, chunk tables are added up and joined back to their chunk, and documents
look up places in their chunk's table. What a task holds is a chunk (CHUNK bytes of text,
or one longer text), whatever the corpus holds, and a pair that every document
holds is one row a chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks_for, written

BATCH, CHUNK = 2 << 20, 16 << 20  # bytes of text: aligned at once; sharing a table of pairs
KEPT = 64 << 20  # size of the words whose ids a task remembers
_UNSAFE = re.compile(r"[\s\u180e\u200b] | [\s\u180e\u200b]|\A[\s\u180e\u200b]|[\s\u180e\u200b]\Z")  # white space beside a blank or an end
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_encoders: dict[tuple[str, str], Encoders] = {}


class Encoders:
    """Tokenizer A (byte-level, of ``tokenizers``) and B (pieces, of ``sentencepiece``) and the bytes of each of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are shown as themselves, the others from U+0100 on
        hidden = [x for x in range(256) if x not in plain]
        shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(hidden)}
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=True).items()}
        decoded = lambda n: bytes(shown[c] for c in n) if all(c in shown for c in n) else n.encode()
        self.bytes_a = [decoded(names.get(i, "")) for i in range(max(names) + 1)]
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[1:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # decimal ids with what follows them inside a side and at its end
        self.inner_a, self.last_a = (np.array([f"{i}{end}" for i in range(len(self.bytes_a))], object) for end in ",|")
        self.inner_b, self.last_b = (np.array([f"{i}{end}" for i in range(len(self.bytes_b))], object) for end in ",;")
        spec = json.loads(self.a.to_str())
        cut = spec["pre_tokenizer"] or {}
        plain_cut = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"] and not spec["normalizer"]
        self.model = self.a.model if plain_cut else None
        self.show = {x: c for c, x in shown.items()}
        self.tails: dict[str, list[int]] = {}
        # where a blank stands between two signs, A's pattern and, if none of B's pieces goes on after one, B cut in any case
        self.cut = not any("▁" in piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.size = 0

    def words(self, text: str) -> list[str]:
        """Parts of a text between which both tokenizers cut; a blank before each is left out."""
        if not self.cut:
            return [text]
        parts = text.split(" ")
        if not _UNSAFE.search(text):
            return parts
        out = parts[:1]
        for before, part in zip(parts, parts[1:], strict=False):
            if before and part and not _UNSAFE.search(before) and not _UNSAFE.search(part):
                out.append(part)
            else:
                out[-1] = f"{out[-1]} {part}"
        return out

    def ids_a(self, words: list[str]) -> list[list[int]]:
        """Ids of A for " " + each word. Letters and then marks are two pieces to A's pattern: the first needs its model alone, the second is known."""
        out: list[list[int]] = [[]] * len(words)
        rest = []
        for i, w in enumerate(words):
            core = w.rstrip(".,!?")
            if not (self.model and core.isalpha() and (core.isascii() or max(core) < "\u0180")):
                rest.append(i)
                continue
            ids = [t.id for t in self.model.tokenize(f" {core}".encode().decode("latin-1").translate(self.show))]
            if tail := w[len(core) :]:
                if tail not in self.tails:
                    self.tails[tail] = self.a.encode(tail, add_special_tokens=False).ids
                ids += self.tails[tail]
            out[i] = ids
        for i, e in zip(rest, self.a.encode_batch_fast([f" {words[i]}" for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def learn(self, words: list[str]) -> None:
        """Ids of both for new words, and whether their joined bytes are the word's."""
        for w, a, b in zip(words, self.ids_a(words), self.b.encode(words, num_threads=1), strict=True):
            self.known[w] = array("i", a).tobytes(), array("i", b).tobytes(), self.same(f" {w}", a, b)
            self.size += len(w) + 8 * len(a) + 200

    def same(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return raw != b" " and b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none where the joined bytes of either are not those of " " + text."""
        words = [self.words(t) if t else [] for t in texts]
        if self.size > KEPT:
            self.known.clear()
            self.tails.clear()
            self.size = 0
        if new := list({w for own in words for w in own if w not in self.known}):
            self.learn(new)
        none, a, b = np.zeros(0, np.int32), [], []
        for t, own in zip(texts, words, strict=True):
            one, two, sound = zip(*map(self.known.__getitem__, own), strict=True) if own else ((), (), (False,))
            x, y = (np.frombuffer(b"".join(side), np.int32) for side in (one, two))
            if not all(sound) and not (t and self.same(f" {t}", x.tolist(), y.tolist())):
                x = y = none
            a.append(x)
            b.append(y)
        return a, b


def gallop(values: np.ndarray, ends: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each value the first place in low..high (of it) whose end is at least the value; ends[high] must be."""
    below = ends[guess] < values
    lo, hi = np.where(below, guess, low - 1), np.where(below, high, guess)
    for right in (True, False):
        on, step = np.flatnonzero(below == right), 1
        while len(on):
            at = np.minimum(guess[on] + step, high[on]) if right else np.maximum(guess[on] - step, low[on] - 1)
            small = ends[at] < values[on]
            small |= at < low[on]
            lo[on[small]] = at[small]
            hi[on[~small]] = at[~small]
            on, step = on[small if right else ~small], step * 2
    on = np.flatnonzero(hi - lo > 1)
    while len(on):
        mid = (lo[on] + hi[on]) >> 1
        small = ends[mid] < values[on]
        lo[on[small]] = mid[small]
        hi[on[~small]] = mid[~small]
        on = on[hi[on] - lo[on] > 1]
    return hi


def _flat(ids: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of some documents in a row, the byte ends of all of them, and where each document begins."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids).astype(np.int64)
    return flat, np.cumsum(size[flat]), np.concatenate([[0], np.cumsum(n)])


def overlaps(short: list[np.ndarray], long: list[np.ndarray], size_short: np.ndarray, size_long: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both lists of some documents (none empty) flat: ids, first places; and for each short token: the range of long tokens it overlaps, and whether its end is common."""
    s, s_ends, s_at = _flat(short, size_short)
    t, t_ends, t_at = _flat(long, size_long)
    doc = np.repeat(np.arange(len(short)), np.diff(s_at))
    low, high = t_at[doc], t_at[doc + 1] - 1
    even = low + (np.arange(len(s)) - s_at[doc]) * (high - low + 1) // np.diff(s_at)[doc]
    last = gallop(s_ends, t_ends, even, low, high)
    common = t_ends[last] == s_ends
    first = np.empty_like(last)
    first[0] = 0
    first[1:] = last[:-1] + common[:-1]  # a document's last end is common, so the next one starts at its own first token
    return s, s_at, t, t_at, first, last, common


def _aligned(a: list[np.ndarray], b: list[np.ndarray], e: Encoders, driver: str) -> Iterator[tuple]:
    """For each document (``driver`` has no more tokens than the other): n_groups, n_links, groups text, linked pairs (a << 32 | b), how often each."""
    if driver == "a":
        s, s_at, t, t_at, first, last, common = overlaps(a, b, e.size_a, e.size_b)
    else:
        s, s_at, t, t_at, first, last, common = overlaps(b, a, e.size_b, e.size_a)
    n = last - first + 1
    own = np.repeat(np.arange(len(s)), n)
    other = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
    pair = (s[own] << 32 | t[other]) if driver == "a" else (t[other] << 32 | s[own])
    link_at = np.concatenate([[0], np.cumsum(n)])[s_at]
    ends_s, ends_t = np.flatnonzero(common), last[common]  # last tokens of each group
    (a_ids, a_end), (b_ids, b_end) = ((s, ends_s), (t, ends_t)) if driver == "a" else ((t, ends_t), (s, ends_s))
    text = np.empty(len(s) + len(t), object)
    before_a = np.concatenate([[0], b_end + 1])[np.searchsorted(a_end, np.arange(len(a_ids)))]  # tokens of the other side in earlier groups
    before_b = (a_end + 1)[np.searchsorted(b_end, np.arange(len(b_ids)))]
    shown_a, shown_b = e.inner_a[a_ids], e.inner_b[b_ids]
    shown_a[a_end], shown_b[b_end] = e.last_a[a_ids[a_end]], e.last_b[b_ids[b_end]]
    text[np.arange(len(a_ids)) + before_a], text[np.arange(len(b_ids)) + before_b] = shown_a, shown_b
    group_at = np.concatenate([[0], np.cumsum(common)])[s_at]
    for d in range(len(s_at) - 1):
        pairs, times = np.unique(pair[link_at[d] : link_at[d + 1]], return_counts=True)
        groups = "".join(text[s_at[d] + t_at[d] : s_at[d + 1] + t_at[d + 1]])[:-1]
        yield int(group_at[d + 1] - group_at[d]), int(link_at[d + 1] - link_at[d]), groups, pairs, times


def _batches(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts of about BATCH characters together."""
    own, size = [], 0
    for i, t in enumerate(texts):
        own.append(i)
        size += len(t)
        if size >= BATCH:
            yield own
            own, size = [], 0
    if own:
        yield own


class _Chunk:
    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.docs: list[dict] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def row(self) -> dict:
        """The chunk as one row: its documents, its pairs with the number of documents that hold each, and each document's places among them."""
        n = [len(p) for p in self.pairs]
        table, place, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        place = place.astype(np.int32)
        steps = np.diff(place, prepend=np.int32(0))
        places = zlib.compress(steps.tobytes(), 1)
        times = zlib.compress(np.concatenate(self.times).astype(np.int32).tobytes(), 1)
        return {"chunk": self.number, "docs": self.docs, "sizes": n, "places": places, "times": times, "pairs": table, "held": held.astype(np.int64)}


def _chunks(byte_level: str, pieces: str, texts_too: bool, key: pa.DataType):
    """A function of Arrow batches (doc_id, text) to chunk rows."""
    doc = pa.struct([("doc_id", key), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("groups", pa.string())])
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(doc)), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])
    none = {**dict.fromkeys(COUNTS, 0), "groups_sha256": "", "groups": "" if texts_too else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (byte_level, pieces)
        e = _encoders.get(at) or _encoders.setdefault(at, Encoders(*at))
        chunk = _Chunk(TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for own in _batches(texts):
                a, b = e.encode([texts[i] for i in own])
                found: dict[int, tuple] = {}
                for driver in "ab":
                    some = [k for k in range(len(own)) if len(a[k]) and (len(a[k]) <= len(b[k])) == (driver == "a")]
                    if some:
                        found |= zip(some, _aligned([a[k] for k in some], [b[k] for k in some], e, driver), strict=True)
                for k, i in enumerate(own):
                    if k in found:
                        n_groups, n_links, groups, pairs, times = found[k]
                        sha = hashlib.sha256(groups.encode()).hexdigest()
                        chunk.docs.append({"doc_id": ids[i], "n_a": len(a[k]), "n_b": len(b[k]), "n_groups": n_groups, "n_links": n_links,
                                           "groups_sha256": sha, "groups": groups if texts_too else None})
                    else:
                        pairs = times = np.zeros(0, np.int64)
                        chunk.docs.append({"doc_id": ids[i], **none})
                    chunk.pairs.append(pairs)
                    chunk.times.append(times)
                    chunk.size += len(texts[i])
                if chunk.size >= CHUNK:
                    yield pa.RecordBatch.from_pylist([chunk.row()], schema)
                    chunk = _Chunk(chunk.number + 1)
        if chunk.docs:
            yield pa.RecordBatch.from_pylist([chunk.row()], schema)

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each document of a chunk: links whose pair is a best one of its A id, and counts over all links."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            sizes = row["sizes"].values.to_numpy()
            places = np.cumsum(np.frombuffer(zlib.decompress(row["places"].as_py()), np.int32))
            times = np.frombuffer(zlib.decompress(row["times"].as_py()), np.int32).astype(np.int64)
            counts = row["counts"].values
            if counts is None or not len(counts):
                value = best = np.zeros(1, np.int64)
            else:  # in the order of the chunk's pairs
                order = np.argsort(counts.field("pair").to_numpy())
                value, best = (counts.field(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("count", "best"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[places] * times)])[ends]) for v in (best, value)]
            yield pa.RecordBatch.from_arrays([pa.array([row["docs"].as_py()], batch.schema.field("docs").type), *(pa.array([s.tolist()], pa.list_(pa.int64())) for s in sums)], ["docs", "n_best", "count_sum"])


def align(docs: DataFrame, byte_level: str, pieces: str, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs`` (doc_id, text), and with ``groups`` the groups' text.

    ``byte_level`` and ``pieces`` are paths of the two tokenizers' files. A text that is null or empty, or that
    either tokenizer does not give back byte by byte, has no tokens: zeros and empty groups. Repeated
    rows and rows of one or no doc_id are documents of their own; other columns are ignored,
    whatever they are called; an empty table gives no rows.
    """
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    key = d.schema["doc_id"].dataType
    doc = f"struct<doc_id:{key.simpleString()},{','.join(f'{c}:bigint' for c in COUNTS)},groups_sha256:string,groups:string>"
    arrow = pa.int64() if key.simpleString() == "bigint" else pa.int32() if key.simpleString() == "int" else pa.string()
    kind = f"chunk long, docs array<{doc}>, sizes array<int>, places binary, times binary, pairs array<long>, held array<long>"
    chunks = written(d.mapInArrow(_chunks(byte_level, pieces, groups, arrow), kind), "chunks")
    held = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = written(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")
    tables = held.select("chunk", "pair").join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("counts"))
    both = chunks.select("chunk", "docs", "sizes", "places", "times").repartition(tasks_for(d), "chunk").join(tables, "chunk", "left").drop("chunk")
    out = both.mapInArrow(_looked_up, f"docs array<{doc}>, n_best array<long>, count_sum array<long>")
    out = out.select(F.explode(F.arrays_zip("docs", "n_best", "count_sum")).alias("x"))
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"] + ["groups"] * groups
    return out.select(*[F.col(f"x.{c}" if c in ("n_best", "count_sum") else f"x.docs.{c}").alias(c) for c in names])

"""Removal of long repeated byte strings, by suffix sampling with a content-chosen difference cover.

A byte goes if a string of ``length`` bytes (LENGTH unless given) that covers it also starts anywhere else.

The classical difference-cover suffix sort samples two of three suffixes, which at
eight or more bytes a record is many times the text. Here the cover is chosen by
content: anchors are the positions whose gram (about a third of length bytes) has the least hash of some window, so
every string of length bytes holds an anchor, and equal strings hold it at the same
place. That is what a difference cover is for, with one sampled suffix in about
(length - gram) / 2 bytes. Then, as in that algorithm: the sampled suffixes get names
(equal names, equal grams) and those of a unique name are out, since no string over
them repeats; the remaining suffixes, those of the starts that an anchor stands for,
are merged into the order of its group as (bytes up to the anchor, anchor's suffix), cut
to length bytes; and neighbours in the sorted order are compared. Equal neighbours are
repeats. Equal strings have equal anchors, so the sort is local to a group. Places whose
bytes are the same all along are taken together, so a passage of many copies counts
once; anchors of one name that follow each other, as in periodic text, are one entry.
The starts of groups over HOT starts are dealt by their own hash, each in a thin row.

Texts are read in blocks of BLOCK starts, many short texts or a part of a long one, so memory does not grow
with the sampled places of a long text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tasks_for, tidy, written

LENGTH, HOT, BLOCK, PIECE, HELD = 400, 400_000, 1 << 16, 4_096, 4_000_000
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept_text")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PRIME = _U(2**31 - 1)
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOW = _BYTE >> _U(34)


def gram(length: int) -> int:
    """Bytes that an anchor's hash is of: 128 for 400."""
    return max(1, length * 8 // 25)


def _table(base: int, n: int, modulus: int) -> np.ndarray:
    """The first n powers of a base, by doubling."""
    out = np.ones(1, _U)
    while len(out) < n:
        more = out * _U(pow(base, len(out), modulus))
        out = np.concatenate([out, more if modulus == 2**64 else more % _U(modulus)])
    return out[:n]


@cache
def _powers(n: int, base: int = _BASE, modulus: int = 2**64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash's base, and of its inverse, that n bytes need."""
    return _table(base, n, modulus), _table(pow(base, -1, modulus), n, modulus)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grams(data: np.ndarray, size: int, at: np.ndarray | slice | None = None) -> np.ndarray:
    """Polynomial hash of each ``size`` bytes, or of those at some places (unmixed): differences of running sums, brought to one power."""
    if len(data) < size:
        return np.empty(0, _U)
    power, inverse = _powers(1 << len(data).bit_length())
    c = np.zeros(len(data) + 1, _U)
    terms = _BYTE[data]
    terms *= inverse[: len(data)]
    np.cumsum(terms, out=c[1:])
    if at is None:
        h = c[size:] - c[:-size]
        h *= power[: len(h)]
        return h
    return (c[at + size] - c[at]) * power[at]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w entries, by doubling."""
    n, m, out = len(x) - w + 1, 1, x
    while 2 * m <= w:
        out = np.minimum(out[:-m], out[m:])
        m *= 2
    return np.minimum(out[:n], out[w - m : w - m + n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: name (hash of the gram), number of anchors in a row, first and last start of the strings they stand for.

    A string of ``length`` bytes is stood for by the leftmost least hash in it, which only its
    own bytes decide. Anchors of one name in a row are one entry. Texts under ``length``
    bytes have no anchors.
    """
    return _entries(data, np.array([0, len(data)]), length)[1:]


def _entries(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of texts that lie one after the other in ``data``, text i from bounds[i] to bounds[i + 1]; first each entry's text."""
    parts = [_anchors(data[at : at + BLOCK + length - 1], bounds - at, length, at) for at in range(0, len(data) - length + 1, BLOCK)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    text, h, k, lo, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    k[1:] -= first[1:] == last[:-1]  # what goes on in the next block is no other anchor
    apart = text[1:] != text[:-1]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), apart | (h[1:] != h[:-1])]))
    text, lo, k = text[new], lo[new], np.add.reduceat(k, new) if len(new) else k
    ends = bounds[text + 1] - length
    hi = np.append(np.where(text[1:] == text[:-1], lo[1:] - 1, ends[:-1]), ends[-1:])
    return text, h[new], k, lo - bounds[text], hi - bounds[text]


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, base: int) -> tuple[np.ndarray, ...]:
    """Text, name, number of anchors in a row, first start, first and last anchor of a block's entries.

    The order of the grams is that of the upper bits of their hashes, then of their places in the block: the leftmost of the least.
    The number of those bits is the same for all blocks, so equal strings have equal anchors.
    """
    size = gram(length)
    h = _grams(data, size)
    kind, bits = (np.uint32, 17) if BLOCK + length <= 1 << 17 else (np.uint64, 40)
    key = (h >> _U(32 if kind is np.uint32 else 0)).astype(kind)
    key &= ~kind((1 << bits) - 1)
    key |= np.arange(len(key), dtype=kind)
    least = _least(key, length - size + 1)
    new, whole = np.ones(len(least), bool), np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    for t in range(max(0, np.searchsorted(bounds, 0, "right") - 1), np.searchsorted(bounds, len(least))):
        new[max(0, bounds[t])] = True
        whole[max(0, bounds[t + 1] - length + 1) : bounds[t + 1]] = False
    lo = np.flatnonzero(new & whole)
    at = (least[lo] & kind((1 << bits) - 1)).astype(np.int64)
    name, text = _mix(h[at]), np.searchsorted(bounds, lo, "right") - 1
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(lo)), bool), (text[1:] != text[:-1]) | (name[1:] != name[:-1])]))
    ends = np.append(new[1:], len(lo))[: len(new)]
    return text[new], name[new], ends - new, lo[new] + base, at[new] + base, at[ends - 1] + base


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values, one after the other, and their bounds."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _fields(column: pa.ListArray) -> tuple[list, list[list]]:
    """Where each row's structs begin, and all rows' values of each field, one after the other."""
    own = column.flatten()  # of these rows only, without what null lists may hold
    at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return at.tolist(), [f.to_numpy(zero_copy_only=False).tolist() for f in own.flatten()]


def _lots(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Values in turn, first and last (exclusive), of at most ``most`` bytes together, or one."""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


_ENTRY = pa.struct([("name", pa.int64()), ("times", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _sampled(length: int):
    """The anchors of each text (columns data, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = _flat(b.column("data"))
            for lo, hi in _lots(bounds, HELD):
                text, h, *rest = _entries(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], length)
                ends = np.searchsorted(text, np.arange(hi - lo + 1))
                cols = [pa.array(c, f.type) for c, f in zip((h.view(np.int64), *rest), _ENTRY, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, [f.name for f in _ENTRY]))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo), lists], ["key", "anchors"])

    return run


def _contexts(length: int):
    """For each entry with a repeated name: the bytes of all its strings, in pieces of at most PIECE starts.

    What a text holds several times comes once; its other places come without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              ["name", "hot", "content", "key", "lo", "hi", "bytes"])

        for b in batches:
            rows, some = [], 0
            data, bounds = _flat(b.column("data"))
            at, own = _fields(b.column("own"))
            for i, key in enumerate(b.column("key").to_pylist()):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                first: dict[bytes, tuple[int, int]] = {}
                again: list[tuple[int, int]] = []
                for name, hot, lo, end in zip(*(f[at[i] : at[i + 1]] for f in own), strict=True):
                    for lo in range(lo, end + 1, PIECE):  # noqa: B020
                        hi = min(end, lo + PIECE - 1)
                        part = text[lo : hi + length]
                        content = xxhash.xxh3_128_digest(part, name & 0xFFFFFFFFFFFFFFFF)
                        if content in first:
                            again += [first[content], (lo, hi)]
                            continue
                        first[content] = lo, hi
                        rows.append((name, hot, content, key, lo, hi, part))
                        some += len(part)
                        if some > HELD:
                            yield batch(rows)
                            rows, some = [], 0
                rows += [(0, False, None, key, lo, hi - length, None) for lo, hi in _union((lo, hi + length) for lo, hi in again)]
            if rows:
                yield batch(rows)

    return run


def _union(spans) -> list[tuple[int, int]]:
    """Spans (lo, hi) that touch or overlap, as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2^31 - 1, or somewhat more."""
    return (x & _PRIME) + (x >> _U(31))


def _second(data: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Another hash of the ``length`` bytes at some places, modulo a prime: strings equal in both are taken as equal."""
    power, inverse = _powers(1 << len(data).bit_length(), 1_000_003, int(_PRIME))
    c = np.zeros(len(data) + 1, _U)
    np.cumsum(_fold(_LOW[data] * inverse[: len(data)]), out=c[1:])
    g = _fold(_fold(_fold(c[at + length] - c[at]) * power[at]))
    return np.where(g >= _PRIME, g - _PRIME, g)


def _hashed(rows: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes, row number and place of each start of some rows (lo, bytes)."""
    data, bounds = _flat(rows.column("bytes"))
    first, parts = rows.column("lo").to_numpy(), []
    for lo, hi in _lots(bounds, BLOCK):
        part, own = data[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        n = np.diff(bounds[lo : hi + 1]) - length + 1
        row = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(row)) + (own - np.cumsum(n) + n)[row]
        parts.append((_mix(_grams(part, length, at)), _second(part, length, at), row + lo, at + (first[lo:hi] - own)[row]))
    h, g, row, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, g, row, s


def _spans(row: np.ndarray, s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last byte (exclusive) of what strings at repeated starts s, in order in each row, cover."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] - s[:-1] > length)])
    return row[new], s[new], np.append(s[:-1][new[1:]], s[-1:]) + length


def _repeated(h: np.ndarray, g: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which starts equal another of their group in both hashes."""
    h = _mix(h + _mix(group.astype(_U) + _U(_BASE)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    order = order[np.append(same, False) | np.insert(same, 0, False)]
    a, b = order[1:], order[:-1]
    same = h[a] == h[b]
    if (same & ((g[a] != g[b]) | (group[a] != group[b]))).any():  # the first hash does not tell them apart
        order = order[np.lexsort((group[order], g[order], h[order]))]
        a, b = order[1:], order[:-1]
        same = (h[a] == h[b]) & (g[a] == g[b]) & (group[a] == group[b])
    out = np.zeros(len(h), bool)
    out[a[same]] = True
    out[b[same]] = True
    return out


_SPAN = ["key", "lo", "hi"]


def _compare(rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Compare the starts of whole groups (rows in order of names), keep what repeated strings cover."""
    name = rows.column("name").to_numpy()
    group = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]]))
    single = rows.column("single").to_numpy(zero_copy_only=False)
    asked = (np.bincount(group, single) > 0)[group]  # where every row is one of several equal ones, all is known
    if not asked.all():
        rows, single, group = rows.filter(pa.array(asked)), single[asked], group[asked]
    none = pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.binary(), pa.int64(), pa.int64())], _SPAN)
    if not len(group):
        return none
    h, g, row, s = _hashed(rows, length)
    rep = _repeated(h, g, group[row]) & single[row]
    if not rep.any():
        return none
    at, lo, hi = _spans(row[rep], s[rep], length)
    return pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(at)), pa.array(lo), pa.array(hi)], _SPAN)


def _slices(rows: pa.RecordBatch, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows in turn, of about ``most`` starts at a time."""
    which = np.cumsum(rows.column("hi").to_numpy() - rows.column("lo").to_numpy() + 1) // most
    ends = [*np.flatnonzero(which[1:] != which[:-1]) + 1, len(which)] if len(which) else []
    for lo, hi in zip([0, *ends], ends, strict=False):
        yield rows.slice(lo, hi - lo)


def _merge(length: int):
    """Rows come sorted by name; what is held is one group, of HOT starts at most, or some small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in _slices(batch):
                held = part if held is None or not held.num_rows else pa.concat_batches([held, part])
                name = held.column("name").to_numpy()
                end = int(np.searchsorted(name, name[-1]))
                if end:
                    yield _compare(held.slice(0, end), length)
                    held = held.slice(end)
        if held is not None and held.num_rows:
            yield _compare(held, length)

    return run


def _thin(length: int):
    """Each start of rows as a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                h, g, row, s = _hashed(part, length)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.int64)), part.column("key").take(row), pa.array(s), part.column("single").take(row)], ["h", "g", "key", "s", "single"])

    return run


def _covers(column: pa.ListArray) -> list[list[tuple[int, int]]]:
    """The spans (lo, hi) of each row's list, as ``_union`` joins them; none for null."""
    at, (lo, hi) = _fields(column)
    return [_union(zip(lo[a:b], hi[a:b], strict=True)) for a, b in zip(at, at[1:], strict=False)]


def _drop(whole: bool, short: bool):
    """Cut the spans; texts out if ``whole``, the bytes of the spans of column short if ``short``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                n, removed, runs, sha, kept = [], [], [], [], []
                repeated = [sum(hi - lo for lo, hi in x) for x in _covers(part.column("short"))] if short else []
                for value, cover in zip(part.column("data"), _covers(part.column("cover")), strict=True):
                    data = value.as_py() or b""
                    ends = [0, *(hi for _, hi in cover)]
                    rest = b"".join(data[end:lo] for end, lo in zip(ends, [*(lo for lo, _ in cover), len(data)], strict=True))
                    n.append(len(data))
                    removed.append(len(data) - len(rest))
                    runs.append(len(cover))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    if whole:
                        kept.append(rest.decode("utf-8", "ignore") if value.is_valid else None)
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_repeated"] * short + ["kept_text"] * whole
                cols = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
                cols += [pa.array(repeated, pa.int64())] * short + [pa.array(kept, pa.string())] * whole
                keep = [c for c in part.schema.names if c not in ("data", "cover", "short")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], [*keep, *names])

    return run


def _key(data: str) -> Column:
    """The first 16 bytes of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """key and cover (list of spans (lo, hi) to remove) of those of ``texts`` (key, data: the same key for the same bytes) with any."""
    long = texts.select("key", "data").where(F.length("data") >= length)
    kind = "array<struct<name:long,times:int,lo:int,hi:int>>"
    sampled = written(long.select("data", "key").mapInArrow(_sampled(length), f"key binary, anchors {kind}"), "anchors")
    flat = sampled.select("key", F.explode("anchors").alias("a")).select("key", "a.*")
    starts = F.sum(F.col("hi") - F.col("lo") + 1)
    dup = flat.groupBy("name").agg(F.sum("times").alias("size"), starts.alias("starts")).where("size > 1")
    dup = written(dup.select("name", (F.col("starts") > HOT).alias("hot")), "names")
    own = flat.join(dup, "name").groupBy("key").agg(F.collect_set(F.struct("name", "hot", "lo", "hi")).alias("own"))
    own = written(own, "lists")
    tidy(sampled, dup)
    ctx = written(long.join(own, "key").select("data", "key", "own").mapInArrow(
        _contexts(length), "name long, hot boolean, content binary, key binary, lo long, hi long, bytes binary"), "contexts")
    tidy(own)
    # what stands in several places as a whole repeats as a whole, and is compared with the rest of its group once
    many = written(ctx.where("content is not null").groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content"), "many")
    span = ["key", "lo", (F.col("hi") + length).alias("hi")]
    whole = ctx.select("content", "key", "lo", "hi").join(many, "content").select(*span).unionAll(ctx.where("content is null").select(*span))

    def once(rows: str) -> DataFrame:
        """Each content with one of its places; contents are of one name, so what is asked of names is asked before bytes are sent."""
        found = ctx.where("content is not null").where(rows).groupBy("content").agg(
            F.first("bytes").alias("bytes"), F.first("name").alias("name"), F.min(F.struct("key", "lo", "hi")).alias("at"), (F.count("*") == 1).alias("single"))
        return found.select("name", "bytes", "at.*", "single")

    met = once("not hot").repartition(tasks_for(ctx), "name").sortWithinPartitions("name").mapInArrow(_merge(length), "key binary, lo long, hi long")
    hot = written(once("hot").drop("name").mapInArrow(_thin(length), "h long, g long, key binary, s long, single boolean"), "starts")
    equal = written(hot.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "equal")
    met = met.unionAll(hot.where("single").join(equal, ["h", "g"]).groupBy("key", F.expr(f"s div {length}")).agg(F.min("s").alias("lo"), (F.max("s") + length).alias("hi")).select("key", "lo", "hi"))
    cover = written(whole.unionAll(met).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("cover")), "cover")
    tidy(ctx, many, hot, equal)
    return cover


def _runs(length: int):
    """Of texts and their covers: the runs of at least ``length`` bytes (key, lo, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, some = [], 0
            data, bounds = _flat(b.column("data"))
            for i, (key, cover) in enumerate(zip(b.column("key").to_pylist(), _covers(b.column("cover")), strict=True)):
                for lo, hi in cover:
                    if hi - lo >= length:
                        rows.append((key, lo, data[bounds[i] + lo : bounds[i] + hi].tobytes()))
                        some += hi - lo
                if some > HELD or i == b.num_rows - 1 and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["origin", "at", "data"])
                    rows, some = [], 0

    return run


def longer_spans(texts: DataFrame, cover: DataFrame, length: int = LENGTH) -> DataFrame:
    """``repeated_spans`` of a greater length than ``cover`` is of: only inside the runs that are covered, where all its repeats lie."""
    runs = texts.join(cover, "key").select("data", "key", "cover").mapInArrow(_runs(length), "origin binary, at long, data binary")
    runs = written(runs.withColumn("key", _key("data")), "runs")
    found = repeated_spans(runs, length)
    places = runs.select("key", "origin", "at").join(found, "key").select("origin", "at", F.explode("cover").alias("c"))
    out = places.groupBy(F.col("origin").alias("key")).agg(F.collect_set(F.struct((F.col("at") + F.col("c.lo")).alias("lo"), (F.col("at") + F.col("c.hi")).alias("hi"))).alias("cover"))
    out = written(out, "cover")
    tidy(runs, found)
    return out


def remove_repeats(docs: DataFrame, texts: bool = False, length: int = LENGTH, also: int | None = None) -> DataFrame:
    """Rows of ``docs`` (text string; other columns pass) with n_bytes, n_removed, n_spans, kept_sha256 in place of text.

    With ``texts`` also kept_text: the remaining bytes as UTF-8, without the bytes of a
    character that a cut went through. With ``also``, a smaller length, also n_repeated:
    the bytes that strings of that length would remove. Null texts count as empty
    (kept_text stays null). Every row counts, so a text of ``length`` bytes or more that occurs in two rows goes
    whole. Columns of ``docs`` with the name of a result are replaced by it. An empty
    table gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    least = also or length
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    all_texts = docs.select(data.alias("data")).where(F.length("data") >= least).withColumn("key", _key("data"))
    cover = repeated_spans(all_texts, least)
    spans = ["cover"] + ["short"] * bool(also)
    if also:
        cover = cover.withColumnRenamed("cover", "short").join(longer_spans(all_texts, cover, length), "key", "left")
    keep = [F.col(c).alias(f"in_{c}") for c in docs.columns if c != "text"]
    rows = docs.select(*keep, F.encode("text", "UTF-8").alias("data"))
    rows = rows.withColumn("key", F.when(F.length("data") >= least, _key("data")))
    # texts without a key meet nothing: they are dealt by their row's own hash, not as one null key
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("key", F.coalesce("key", F.unhex(F.substring(F.sha2(own, 256), 1, 32))))
    both = rows.join(cover, "key", "left").select(*[f"in_{c}" for c in docs.columns if c != "text"], "data", *spans)
    kinds = ", ".join(f"`in_{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_repeated"] * bool(also), *["kept_text"] * texts]
    out = both.mapInArrow(_drop(texts, bool(also)), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(also) + ", kept_text string" * texts)
    return out.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns if c != "text"], *names)

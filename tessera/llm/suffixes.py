"""Exact substring dedup: sampled splitters range-partition suffixes, buckets sort them locally.

A string of LENGTH bytes counts as repeated if it also starts earlier (smaller doc_id, or the same
document before). Sorting a suffix for every byte would multiply the corpus, so suffixes start at
anchors only: positions whose hash of the next GRAM bytes is least within some window. Any two equal
strings of LENGTH bytes have an anchor at the same place inside them, so the contexts of anchors
(LENGTH - GRAM bytes before, LENGTH bytes from it on) decide about every string.

1. Anchors whose gram occurs once in the corpus go: hashes meet in buckets, as packed arrays.
2. Contexts of the others are dealt out by the range of the leading bytes from the anchor on,
   between splitters sampled from the corpus. A bucket sorts the parts after the anchor, and the
   reversed parts before it, by multikey quicksort, eight bytes a key. Common prefixes of neighbours
   then tell which strings across an anchor are equal; all but the earliest of equals are repeats.
3. Grams met more than HOT times (or by over a millionth of all anchors) would fill one bucket.
   Their strings are compared by a 128-bit hash instead, spread over all buckets. In every task,
   equal contexts first shrink to their earliest.
4. The repeats of a document meet its text again, and the bytes left are hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

LENGTH, GRAM = 100, 32
#: Bytes of a context before its anchor.
BEFORE = LENGTH - GRAM
HOT = 50_000
#: Documents the splitters are sampled from, and grams taken of each.
SAMPLE_DOCS, SAMPLE_GRAMS = 2000, 64
#: Anchors, bytes of text, or contexts that a task gathers before it passes packed arrays on.
GATHER, TEXT_BYTES, CONTEXTS = 2_000_000, 32 << 20, 150_000

ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
PLACE = np.dtype([("doc", "<i8"), ("at", "<u4")])
CONTEXT = np.dtype([("doc", "<i8"), ("at", "<u4"), ("before", "u1"), ("after", "u1"), ("left", "u1", 72), ("right", "u1", 104)])
SEEN = np.dtype([("h", "<u8", 2), ("doc", "<i8"), ("at", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("a", "<u4"), ("b", "<u4")])
ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
ROW_DDL = "bucket int, kind int, data binary"


def packed(bucket: int, kind: int, data: bytes) -> tuple:
    return bucket, kind, zstandard.ZstdCompressor(1).compress(data)


def table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW, strict=True)], schema=ROW)


def columns_first(x: np.ndarray) -> bytes:
    """Fields one after another, in which form they compress well."""
    return b"".join(np.ascontiguousarray(x[n]).tobytes() for n in x.dtype.names)


def rows_first(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = np.empty(len(raw) // kind.itemsize, kind), 0
    for name in kind.names:
        field = kind[name]
        size = len(out) * field.itemsize
        out[name] = np.frombuffer(raw[at : at + size], field.base).reshape((len(out), *field.shape))
        at += size
    return out


def spread(kind: int, groups: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """Packed rows, one for each bucket that `groups` names."""
    if not len(groups):
        return
    order = np.argsort(groups, kind="stable")
    groups, data = groups[order], data[order]
    cuts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(groups)], strict=True):
        yield packed(int(groups[a]), kind, columns_first(data[a:b]))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)


def window(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least or greatest of each `size` neighbours, by doubling."""
    pick, have = np.minimum if least else np.maximum, 1
    while have < size:
        step = min(have, size - have)
        x, have = pick(x[:-step], x[step:]), have + step
    return x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a text of LENGTH bytes or more, and hashes of their grams."""
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:  # hashes of ever longer stretches
        h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:])
        size *= 2
    reach = LENGTH - GRAM + 1
    low = window(h, reach, True)  # of each string of LENGTH bytes
    pad = np.zeros(reach - 1, np.uint64)
    top = window(np.concatenate([pad, low, pad]), reach, False)
    at = np.flatnonzero(top == h)
    return at, h[at]


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            yield doc.as_py(), bytes_of(text.as_py())


def anchor_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Grams of a task, each once for its bucket with its number; further places of a gram that the
    task has met twice ride along in any bucket (kind 0), since they are known to be repeated."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        x = np.concatenate(held)
        order = np.argsort(x["key"], kind="stable")
        key = x["key"][order]
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        first = x[order[start]]
        first["n"] = np.diff(np.append(start, len(x)))
        more = np.zeros(len(x), bool)
        more[order[~new]] = True
        group = bucket_of(first["key"], buckets)  # mixed again: anchors have small hashes
        by = np.lexsort((first["at"], first["doc"]))
        rest = x[np.flatnonzero(more)]
        return table([*spread(1, group[by], first[by]), *spread(0, bucket_of(rest["doc"], buckets), rest)])

    for doc, data in text_rows(batches):
        if len(data) >= LENGTH:
            at, key = anchors(np.frombuffer(data, np.uint8))
            x = np.zeros(len(at), ANCHOR)
            x["key"], x["doc"], x["at"], x["n"] = key, doc, at, 1
            held.append(x)
            n += len(at)
            if n >= GATHER:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def places_of(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), PLACE)
    out["doc"], out["at"] = x["doc"], x["at"]
    return out


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def gathered(batches: Iterator[pa.RecordBatch], held: tuple[int, ...]) -> Iterator[tuple[int, dict[int, list[bytes]], bytes | None, int]]:
    """Rows come by bucket, then kind. Kinds in `held` are gathered; any other row comes out at
    once with what its bucket has gathered; each bucket ends with (bucket, gathered, None, -1)."""
    now, own = None, {k: [] for k in held}
    for bucket, kind, data in by_bucket(batches):
        if bucket != now:
            if now is not None:
                yield now, own, None, -1
            now, own = bucket, {k: [] for k in held}
        if kind in own:
            own[kind].append(data)
        else:
            yield bucket, own, data, kind
    if now is not None:
        yield now, own, None, -1


def repeated_rows(batches: Iterator[pa.RecordBatch], buckets: int, often_met: int) -> Iterator[pa.RecordBatch]:
    """Places of grams met twice or more (kind 1, by document bucket), the number of anchors
    (kind 8) and grams that may be hot (kind 9)."""
    for bucket, own, data, _ in gathered(batches, (1,)):
        if data is not None:
            x = rows_first(data, ANCHOR)
            yield table([*spread(1, bucket_of(x["doc"], buckets), places_of(x)), (bucket, 8, len(x).to_bytes(8, "little"))])
        elif own[1]:
            x = np.concatenate([rows_first(d, ANCHOR) for d in own[1]])
            x = x[np.argsort(x["key"], kind="stable")]
            start = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1]))
            total = np.add.reduceat(x["n"].astype(np.int64), start)
            often = np.repeat(total > 1, np.diff(np.append(start, len(x))))
            y = x[often]
            y = y[np.lexsort((y["at"], y["doc"]))]
            hot = np.stack([x["key"][start], total.astype(np.uint64)], 1)[total > often_met]
            rows = [*spread(1, bucket_of(y["doc"], buckets), places_of(y)), (bucket, 8, len(x).to_bytes(8, "little"))]
            yield table([*rows, (bucket, 9, hot.tobytes())] if len(hot) else rows)


def text_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts by document bucket, packed: number, ids, lengths, bytes (kind 2)."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = []
        for bucket, docs in held.items():
            head = [np.array([len(docs)], np.int64), np.array([d for d, _ in docs], np.int64), np.array([len(t) for _, t in docs], np.int64)]
            rows.append(packed(bucket, 2, b"".join([*(h.tobytes() for h in head), *(t for _, t in docs)])))
        held.clear()
        return table(rows)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for doc, bucket, text in zip(ids.tolist(), bucket_of(ids, buckets).tolist(), batch.column(1).to_pylist(), strict=True):
            data = bytes_of(text)
            held.setdefault(bucket, []).append((doc, data))
            size += len(data) + 16
            if size > TEXT_BYTES:
                yield out()
                size = 0
    if held:
        yield out()


def texts_in(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and the bytes of a block of texts."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    return head[0], head[1], np.frombuffer(raw, np.uint8, offset=8 + 16 * n)


def contexts(block: bytes, places: np.ndarray) -> Iterator[np.ndarray]:
    """Contexts of the places that lie in a block's texts, in order of document and place."""
    ids, sizes, data = texts_in(block)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], places["doc"])
    at[at == len(ids)] = 0
    doc = order[at]
    here = ids[doc] == places["doc"]
    places, doc = places[here], doc[here]
    for k in range(0, len(places), 1 << 15):
        p, d = places[k : k + (1 << 15)], doc[k : k + (1 << 15)]
        spot = starts[d] + p["at"]
        out = np.zeros(len(p), CONTEXT)
        out["doc"], out["at"] = p["doc"], p["at"]
        out["before"] = np.minimum(p["at"], BEFORE)
        out["after"] = np.minimum(sizes[d] - p["at"], LENGTH)
        for name, step, size, limit in (("left", -1, BEFORE, "before"), ("right", 1, LENGTH, "after")):
            j = np.arange(size)
            index = spot[:, None] + (j if step > 0 else -1 - j)
            inside = j < out[limit][:, None]
            out[name][:, :size] = np.where(inside, data[np.where(inside, index, 0)], 0)
        yield out


def words_in(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(">u8").astype(np.uint64)


def gram_keys(x: np.ndarray) -> np.ndarray:
    """The anchors' hashes again, from the bytes after them."""
    h = x["right"][:, :GRAM].astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:
        h = mix(h[:, :-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[:, size:])
        size *= 2
    return h[:, 0]


def earliest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts without later copies, and the spans of those copies. x is in order of place."""
    word = np.concatenate([words_in(x["left"]), words_in(x["right"]), x["before"][:, None].astype(np.uint64) * np.uint64(256) + x["after"][:, None]], 1)
    h = np.zeros(len(x), np.uint64)
    for k in range(word.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[:, k] + np.uint64(k))
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    copy = np.zeros(len(x), bool)
    copy[order] = (order != head) & (word[order] == word[head]).all(1)
    gone = x[copy & (x["before"].astype(int) + x["after"] >= LENGTH)]
    return x[~copy], united(gone["doc"], gone["at"].astype(np.int64) - gone["before"], gone["at"].astype(np.int64) + gone["after"])


def united(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spans without overlaps: those that touch become one."""
    if not len(doc):
        return np.empty(0, SPAN)
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order].astype(np.int64), b[order].astype(np.int64)
    number = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    wide = int(b.max()) + 1
    top = np.maximum.accumulate(b + number * wide) - number * wide  # ends never pass into the next document
    new = np.append(True, (doc[1:] != doc[:-1]) | (a[1:] > top[:-1]))
    start = np.flatnonzero(new)
    out = np.empty(len(start), SPAN)
    out["doc"], out["a"], out["b"] = doc[start], a[start], top[np.append(start[1:], len(doc)) - 1]
    return out


def suffix_order(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort with eight bytes a key: rows in order, and the bytes that each shares
    with the one before. Only rows equal so far are compared by the next key."""
    n = len(word)
    order = np.argsort(word[:, 0], kind="stable")
    shared = np.full(n, 8 * word.shape[1], np.int64)
    shared[:1] = 0
    cut = np.append(True, np.zeros(max(0, n - 1), bool))[:n]
    at = np.arange(n)
    for k in range(word.shape[1]):
        value = word[order[at], k]
        if k:
            group = np.cumsum(cut)[at]
            sub = np.lexsort((value, group))
            order[at], value = order[at][sub], value[sub]
            near = (at[1:] == at[:-1] + 1) & ~cut[at[1:]]
        else:
            near = np.ones(max(0, n - 1), bool)
        differ = np.flatnonzero(near & (value[1:] != value[:-1]))
        x = value[1:][differ] ^ value[:-1][differ]
        shared[at[1:][differ]] = 8 * k + sum((x >> np.uint64(s) == 0).astype(np.int64) for s in range(56, 0, -8))
        cut[at[1:][differ]] = True
        alone = cut & np.append(cut[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
    return order, shared


def classes(order: np.ndarray, shared: np.ndarray, size: int) -> np.ndarray:
    """Rows with equal first `size` bytes have equal numbers."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < size)
    return out


def resolved(x: np.ndarray) -> np.ndarray:
    """Spans of all strings of LENGTH bytes across the anchors that are not the earliest of equals."""
    x = x[np.lexsort((x["at"], x["doc"]))]
    order, shared = suffix_order(words_in(x["right"]))
    gram = classes(order, shared, GRAM)
    keep = np.bincount(gram)[gram] > 1
    if not keep.any():
        return np.empty(0, SPAN)
    x = x[keep]
    n, right = len(x), suffix_order(words_in(x["right"]))
    left = suffix_order(words_in(x["left"]))
    repeat = np.zeros((n, BEFORE + 2), bool)
    for back in range(BEFORE + 1):
        own = np.flatnonzero((x["before"] >= back) & (x["after"] >= LENGTH - back))
        key = classes(*right, LENGTH - back)[own] * (n + 1) + classes(*left, back)[own]
        first = np.unique(key, return_index=True)[1]
        repeat[own, back] = True
        repeat[own[first], back] = False
    change = np.diff(repeat.astype(np.int8), axis=1, prepend=0)
    row, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)  # one past the longest reach back of a run
    at = x["at"][row].astype(np.int64)
    return united(x["doc"][row], at - (high - 1), at - low + LENGTH)


def strings(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All strings across the anchors by hash, each where it is first met, and spans of the rest."""
    first: dict[bytes, tuple[int, int]] = {}
    gone = []
    for doc, at, before, after, left, right in x:
        whole = left[:before][::-1].tobytes() + right[:after].tobytes()
        for k in range(len(whole) - LENGTH + 1):
            h = xxhash.xxh3_128_digest(whole[k : k + LENGTH])
            start = (int(doc), int(at) - int(before) + k)
            old = first.setdefault(h, start)
            if old != start:
                first[h] = min(old, start)
                gone.append(max(old, start))
    seen = np.zeros(len(first), SEEN)
    if first:
        seen["h"] = np.frombuffer(b"".join(first), "<u8").reshape(-1, 2)
        seen["doc"], seen["at"] = np.array(list(first.values())).T
    spans = np.array(gone, np.int64).reshape(-1, 2)
    return seen, united(spans[:, 0], spans[:, 1], spans[:, 1] + LENGTH)


def context_rows(batches: Iterator[pa.RecordBatch], buckets: int, splitters: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Contexts by range of their leading bytes (kind 3), strings of hot grams by hash (kind 4), and
    spans that are settled here (kind 5)."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        x = np.concatenate(held)
        x, spans = earliest(x[np.lexsort((x["at"], x["doc"]))])
        often = np.isin(gram_keys(x), hot)
        some = x[~often]
        lead = np.ascontiguousarray(some["right"][:, :GRAM]).view(f"S{GRAM}").ravel()
        rows = [*spread(3, np.searchsorted(splitters, lead, "right").astype(np.int32), some)]
        if often.any():
            seen, more = strings(x[often])
            spans = np.concatenate([spans, more])
            rows += spread(4, (seen["h"][:, 0] % np.uint64(buckets)).astype(np.int32), seen)
        rows += spread(5, bucket_of(spans["doc"], buckets), spans)
        held.clear()
        return table(rows)

    for _, own, data, _ in gathered(batches, (1,)):
        if data is None or not own[1]:
            continue
        if isinstance(own[1][0], bytes):
            places = np.concatenate([rows_first(d, PLACE) for d in own[1]])
            own[1][:] = [places[np.lexsort((places["at"], places["doc"]))]]
        for x in contexts(data, own[1][0]):
            held.append(x)
            size += len(x)
            if size > CONTEXTS:
                yield out()
                size = 0
    if held:
        yield out()


def span_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove (kind 1) by document bucket."""
    for _, own, data, _ in gathered(batches, (3, 4)):
        found = []
        if data is not None:
            found.append(rows_first(data, SPAN))
        else:
            if own[3]:
                found.append(resolved(np.concatenate([rows_first(d, CONTEXT) for d in own[3]])))
            if own[4]:
                x = np.concatenate([rows_first(d, SEEN) for d in own[4]])
                x = x[np.lexsort((x["at"], x["doc"], x["h"][:, 1], x["h"][:, 0]))]
                x = later(x, np.append(False, (x["h"][1:] == x["h"][:-1]).all(1)))
                found.append(united(x["doc"], x["at"], x["at"].astype(np.int64) + LENGTH))
        for spans in found:
            if len(spans):
                yield table([*spread(1, bucket_of(spans["doc"], buckets), spans)])


def later(x: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Entries of a hash other than its earliest place, which several anchors may have named."""
    head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    return x[(x["doc"] != x["doc"][head]) | (x["at"] != x["at"][head])]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def result_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, own, data, _ in gathered(batches, (1,)):
        if data is None:
            continue
        if own[1] and isinstance(own[1][0], bytes):
            spans = np.concatenate([rows_first(d, SPAN) for d in own[1]])
            own[1][:] = [united(spans["doc"], spans["a"], spans["b"])]
        spans = own[1][0] if own[1] else np.empty(0, SPAN)
        ids, sizes, text = texts_in(data)
        first, last = np.searchsorted(spans["doc"], ids), np.searchsorted(spans["doc"], ids, "right")
        rows, at = [], 0
        for doc, size, a, b in zip(ids.tolist(), sizes.tolist(), first.tolist(), last.tolist(), strict=True):
            own_text, at = text[at : at + size], at + size
            cut = spans[a:b]
            ends = [0, *(int(y) for s in cut for y in (s["a"], s["b"])), size]
            digest = hashlib.sha256()
            for k in range(0, len(ends), 2):
                digest.update(own_text[ends[k] : ends[k + 1]])
            rows.append((doc, size, int((cut["b"].astype(np.int64) - cut["a"]).sum()), len(cut), digest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)


def sampled_splitters(docs: DataFrame, count: int, buckets: int) -> np.ndarray:
    """Up to buckets - 1 strings of GRAM bytes between which the leading bytes are dealt out."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in text_rows(batches):
            if len(data) >= LENGTH:
                at, _ = anchors(np.frombuffer(data, np.uint8))
                some = at[:: max(1, -(-len(at) // SAMPLE_GRAMS))]
                yield pa.RecordBatch.from_arrays([pa.array([data[a : a + GRAM] for a in some], pa.binary())], names=["gram"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, count // SAMPLE_DOCS))) == 0)
    found = np.sort(np.array([bytes(r.gram) for r in some.mapInArrow(grams, "gram binary").collect()], f"S{GRAM}"))
    return np.unique(found[np.linspace(0, len(found) - 1, buckets + 1).astype(int)[1:-1]]) if len(found) else found


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts are empty. Rows that repeat a doc_id, or have none, stand in order of text, null ids
    last; a copy of a row is repeated by the first. An empty table gives no rows; columns other than
    doc_id and text don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    count = rows.count()
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    names = None
    if not odd.isEmpty():
        ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
        names = written(ordered.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text"), "ordered")
        rows = names.select(F.col("at").alias("doc_id"), "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts
    dealt = lambda x: x.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    met = dealt(rows.mapInArrow(lambda b: anchor_rows(b, buckets), ROW_DDL)).mapInArrow(lambda b: repeated_rows(b, buckets, hot), ROW_DDL)
    met = written(met, "places")
    total = sum(int.from_bytes(r.n, "little") * r.times for r in met.where("kind = 8").groupBy(F.col("data").alias("n")).agg(F.count("*").alias("times")).collect())
    limit = max(hot, total // 1_000_000)
    hottest = [np.frombuffer(bytes(r.data), np.uint64).reshape(-1, 2) for r in met.where("kind = 9").select("data").toLocalIterator()]
    hot_keys = np.concatenate([h[h[:, 1] > limit][:, 0] for h in hottest]) if hottest else np.empty(0, np.uint64)
    splitters = sampled_splitters(rows, count, buckets)
    blocks = rows.mapInArrow(lambda b: text_blocks(b, buckets), ROW_DDL)
    texts = dealt(met.where("kind = 1").unionByName(blocks)).mapInArrow(lambda b: context_rows(b, buckets, splitters, hot_keys), ROW_DDL)
    spans = written(dealt(texts).mapInArrow(lambda b: span_rows(b, buckets), ROW_DDL), "spans")
    out = dealt(spans.unionByName(blocks)).mapInArrow(result_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if names is None:
        return out
    back = names.select("at", F.col("doc_id").alias("own"))
    return out.join(back, out["doc_id"] == back["at"]).select(F.col("own").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What of every document is repeated. Null, empty and very long texts, repeated rows and ids, null
    ids, empty tables, further columns: see `deduplicated`."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))

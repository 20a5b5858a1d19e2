"""SimHash near-duplicates: fingerprints, and an exact Hamming search over a Gray-ordered hierarchy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE, connected_components, mapped, small_enough, written

SHINGLE, SEED, BITS = 3, 42, 64
#: Near copies: words of a shingle, least similarity, words of the sketch that rules pairs out.
WIDE_SHINGLE, SIMILARITY, SKETCH = 5, 0.8, 4
#: Candidates agree in all ROWS least hashes of one of BANDS bands: sets that are 0.8 alike do but
#: for one pair in 300,000. The bits beyond `bits_apart` are over five standard deviations.
BANDS, ROWS, MARGIN = 32, 5, 40
#: Codes below a lowest node, nodes below a higher one, queries searched at a time, and pairs of query
#: and node held at a time.
LEAF, FAN, CHUNK, WIDTH = 16, 8, 4096, 1 << 17
#: Codes meant for a task, codes of the sample in a range of the Gray order, and followers in a band
#: that are compared in all bands at once.
CELL, SAMPLE, NEIGHBOURS = 500_000, 64, 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles; without words 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return int.from_bytes(majority(b"".join([digest(s, SEED) for s in shingles]), 8), "big")


def majority(digests: bytes, size: int) -> bytes:
    """The bits that over half of the digests of `size` bytes have set."""
    bits = np.frombuffer(digests, np.uint8).reshape(-1, size)
    ones = sum((np.unpackbits(bits[k : k + 4096], axis=1).sum(0, dtype=np.int64) for k in range(0, len(bits), 4096)), np.zeros(8 * size, np.int64))
    return np.packbits(ones * 2 > len(bits)).tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def wide_shingles(words: list[bytes]) -> set[bytes]:
    """The set of five-word shingles; all words are one shingle if they are fewer."""
    size = min(len(words), WIDE_SHINGLE)
    return set(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def signature(text: str | None) -> tuple[int, ...]:
    """SimHash of the set of words, 64 bits, and of the set of five-word shingles, 256 bits in four
    numbers. The second tells roughly how similar two texts are."""
    return signed_set(words_of(text))[0]


def signed_set(words: list[bytes]) -> tuple[tuple[int, ...], np.ndarray]:
    """The signature, and a hash of each five-word shingle."""
    if not words:
        return (0,) * (1 + SKETCH), np.empty(0, np.uint64)
    one, two = xxhash.xxh64_digest, xxhash.xxh3_128_digest
    code = majority(b"".join([one(w, SEED) for w in set(words)]), 8)
    digests = b"".join([two(s, k) for s in wide_shingles(words) for k in (1, 2)])
    return tuple(np.frombuffer(code + majority(digests, 32), ">i8").tolist()), np.frombuffer(digests, np.uint64)[::SKETCH].copy()


def bands(hashes: np.ndarray) -> list[int]:
    """A number for each band of least hashes; equal sets have equal bands."""
    rng = np.random.default_rng(SEED)
    mix, factor = rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[k : k + 1024] ^ mix) * (factor | np.uint64(1))).min(1))
    return [signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in least.reshape(BANDS, ROWS)]


def near_copy_keys(text: str | None) -> tuple:
    """The signature, the sum of the shingles' hashes, and the bands."""
    known, hashes = signed_set(words_of(text))
    return *known, signed(int(hashes.sum(dtype=np.uint64))), bands(hashes)


def bits_apart(similarity: float) -> int:
    """Differing bits of two sketches of sets of equal size with this share of common members: the
    angle between them, as a part of half a turn."""
    return round(SKETCH * BITS * acos(2 * similarity / (1 + similarity)) / pi)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence: the prefix-xor of its bits."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """Codes in Gray order; a node knows the bits that all codes below it share (mask, pattern). The
    search goes from the root down and drops a node with all below it once the differences from the
    bits that it shares exceed what is allowed, or all below belong to the query's group already."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.root = codes, np.arange(len(codes))
        ones, zeros, size, self.levels = codes, ~codes, LEAF, []
        while len(codes):
            cut = np.arange(0, len(ones), size)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            self.levels.append((ones | zeros, ones))  # shared bits, and which of them are 1
            if len(ones) == 1:
                break
            size = FAN
        self.spans = [LEAF * FAN**k for k in range(len(self.levels))]
        self.visited = self.pruned = self.compared = 0  # nodes met, nodes dropped, pairs compared

    def _groups(self) -> list[np.ndarray]:
        """For each node of each level the group that all codes below are in, or -1."""
        low, high, out, size = self.root, self.root, [], LEAF
        for _ in self.levels:
            cut = np.arange(0, len(low), size)
            low, high, size = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), FAN
            out.append(np.where(low == high, low, -1))
        return out

    def join(self, most: int, others: np.ndarray | None = None) -> np.ndarray:
        """Unites the groups of codes that differ in `most` bits or fewer, and in half of that in the
        upper half: the codes with each other, or with `others`. Returns the group of each query."""
        n = len(self.codes)
        asked = self.codes if others is None else others
        place = np.arange(len(asked)) if others is None else np.arange(n, n + len(asked))
        codes = self.codes if others is None else np.concatenate([self.codes, others])
        root = self.root if others is None else np.concatenate([self.root, place])
        start, size = 0, 64
        while start < len(asked) and n:
            groups = self._groups()
            todo = [(len(self.levels) - 1, place[start : start + size], np.zeros(len(place[start : start + size]), np.int64))]
            start, size = start + size, min(2 * size, CHUNK)  # small at first: a large group is soon known
            while todo:
                level, q, node = todo.pop()
                if len(q) > WIDTH:
                    todo += [(level, q[WIDTH:], node[WIDTH:]), (level, q[:WIDTH], node[:WIDTH])]
                    continue
                mask, ones = self.levels[level]
                differ = (codes[q] ^ ones[node]) & mask[node]
                keep = (np.bitwise_count(differ) <= most) & (np.bitwise_count(differ >> np.uint64(BITS // 2)) <= most // 2) & (groups[level][node] != root[q])
                if others is None:  # the other end of a pair comes later
                    keep &= np.minimum(n, (node + 1) * self.spans[level]) > q + 1
                self.visited += len(q)
                q, node = q[keep], node[keep]
                self.pruned += int(len(keep) - len(q))
                if level:
                    below = len(self.levels[level - 1][0])
                    q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                    todo.append((level - 1, q[node < below], node[node < below]))
                    continue
                i, j = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                inside = (j < n) & ((j > i) if others is None else True)
                i, j = i[inside], j[inside]
                self.compared += len(i)
                near = np.bitwise_count(codes[i] ^ codes[j]) <= most
                unite(root, i[near], j[near])
            if others is not None:
                self.root[:] = root[:n]
        return root if others is None else root[n:]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of linked members; a group's root is its least member."""
    while len(a):
        a, b = root[a], root[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        a, b = a[a != b], b[a != b]
        np.minimum.at(root, b, a)
        while (root != root[root]).any():
            root[:] = root[root]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each member's group, after joining all linked pairs."""
    root = np.arange(n)
    for a, b in links:
        unite(root, a, b)
    return root


def group_links(n: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within one group; their closure is that of all pairs that are `alike`. A component grows:
    its members are compared with those in no component yet, so near copies need few comparisons."""
    loose, todo = np.arange(n), []
    while len(loose):
        if not todo:
            todo, loose = [loose[0]], loose[1:]
        own = todo.pop()
        near = alike(np.full(len(loose), own), loose)
        found, loose = loose[near], loose[~near]
        yield np.full(len(found), own), found
        todo.extend(found.tolist())


def near_links(groups: np.ndarray, sketch: np.ndarray, apart: int) -> np.ndarray:
    """Roots after linking sketches at `apart` differing bits or fewer within groups; rows come sorted by
    group. The first NEIGHBOURS followers are compared in all groups at once, what then isn't settled
    in its group by growing components."""
    ends = np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) + 1
    starts = np.append(0, ends[:-1])
    alike = lambda i, j: np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= apart

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for d in range(1, NEIGHBOURS):
            i = np.flatnonzero(groups[d:] == groups[:-d])
            if not len(i):
                break
            i = i[alike(i, i + d)]
            yield i, i + d
        for a, b in zip(starts, ends, strict=True):
            if b - a > NEIGHBOURS:
                for i, j in group_links(b - a, lambda i, j, a=a: alike(i + a, j + a)):
                    yield i + a, j + a

    return forest(len(groups), links())


def cells(sample: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(bits, prefix) of the ranges of Gray ranks that halve, again and again, until none holds more
    than `most` of the sampled ranks; in order."""
    out, todo, sample = [], [(0, 0)], np.sort(sample)
    while todo:
        bits, prefix = todo.pop()
        low, high = prefix << (BITS - bits) if bits else 0, (prefix + 1 << (BITS - bits)) - 1
        n = np.searchsorted(sample, np.uint64(high), "right") - np.searchsorted(sample, np.uint64(low), "left")
        if n > most and bits < BITS:
            todo += [(bits + 1, 2 * prefix + 1), (bits + 1, 2 * prefix)]
        else:
            out.append((bits, prefix))
    return out


def turned(code: Column, order: int) -> Column:
    """The code with its halves exchanged in the second order."""
    return F.shiftleft(code, BITS // 2).bitwiseOR(F.shiftrightunsigned(code, BITS // 2)) if order else code


def ranked(code: Column) -> Column:
    """The Gray rank as a signed number of the same order."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def linked(codes: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between rows of `codes` (code and node, long, codes distinct), by node, whose closure
    is that of all pairs at `most` differing bits or fewer.

    Codes lie in two Gray orders, the second with their halves exchanged: in one of them a pair
    differs in half of `most` at most in the upper half, so few ranges of that order can hold both
    ends. A range (cell) is a node that shares its leading bits; each code goes to its own cell and,
    as a query, to later cells whose bits don't rule it out. A cell's `GrayIndex` finds the groups.
    Crowded ranges are halved further, so many codes close together are many cells.
    """
    spark = codes.sparkSession
    count, tasks = codes.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-count // CELL))
    both = [_searched(codes, order, most, parts, max(1, count // (SAMPLE * parts))) for order in (0, 1)]
    return both[0].unionByName(both[1])


def _searched(codes: DataFrame, order: int, most: int, parts: int, every: int) -> DataFrame:
    rows = codes.select(turned(F.col("code"), order).alias("code"), "node")
    sample = rows.where(F.pmod(F.xxhash64("code"), F.lit(every)) == 0).select("code").toArrow()["code"].to_numpy().astype(np.int64).view(np.uint64)  # some SAMPLE a part
    ranges = cells(gray_rank(sample), SAMPLE)
    bits = np.array([b for b, _ in ranges])
    first = np.array([p << (BITS - b) if b else 0 for b, p in ranges], np.uint64)
    mask = np.array([((1 << b) - 1) << (BITS - b) for b in bits.tolist()], np.uint64)
    pattern = (first ^ first >> np.uint64(1)) & mask
    schema = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("code", pa.int64()), ("node", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                code, node = (batch.column(c).slice(at, 256).to_numpy(zero_copy_only=False) for c in ("code", "node"))
                own = np.searchsorted(first, gray_rank(code.view(np.uint64)), "right") - 1
                differ = (code.view(np.uint64)[:, None] ^ pattern) & mask
                near = (np.bitwise_count(differ) <= most) & (np.bitwise_count(differ >> np.uint64(BITS // 2)) <= most // 2)
                near &= np.arange(len(first)) >= own[:, None]
                i, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell.astype(np.int32), (cell != own[i]).astype(np.int32), code[i], node[i])], schema=schema)

    dealt = rows.mapInArrow(deal, "cell int, kind int, code long, node long")
    dealt = dealt.repartitionById(parts, (F.col("cell").cast("long") * parts / F.lit(len(ranges))).cast("int")).sortWithinPartitions("cell", "kind", ranked(F.col("code")))
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, index, nodes, own = -1, None, None, []

        def edges(of: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            other = np.flatnonzero(nodes[root] != of) if len(root) else root
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(of[other]), pa.array(nodes[root[other]])], schema=edge)

        def indexed() -> None:
            nonlocal index, nodes
            if index is None:  # the cell's own codes have come
                code = np.concatenate([x[0] for x in own]) if own else np.empty(0, np.int64)
                nodes = np.concatenate([x[1] for x in own]) if own else np.empty(0, np.int64)
                index = GrayIndex(code.view(np.uint64))
                index.join(most)

        def ended() -> Iterator[pa.RecordBatch]:
            if cell >= 0:
                indexed()
                yield from edges(nodes, index.root)

        for batch in batches:
            at, kind, code, node = (batch.column(k).to_numpy() for k in range(4))
            key = at.astype(np.int64) * 2 + kind
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at[a] != cell:
                    yield from ended()
                    cell, index, nodes, own = int(at[a]), None, None, []
                if kind[a] == 0:
                    own.append((code[a:b], node[a:b]))
                    continue
                indexed()
                if len(nodes):
                    root = index.join(most, code[a:b].view(np.uint64).copy())
                    linked = root < len(nodes)
                    yield from edges(node[a:b][linked], root[linked])
        yield from ended()

    return dealt.mapInArrow(search, "a long, b long")


def banded(rows: DataFrame, apart: int) -> DataFrame:
    """Edges (a, b), a spanning forest of each group of `rows` (part, key, node, sketch s0 to s3) whose
    pairs are sketches at `apart` differing bits or fewer."""
    wanted = ["part", "key", "node", *(f"s{k}" for k in range(SKETCH))]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in wanted], 1)
            last = np.flatnonzero((new[1:, :2] != new[:-1, :2]).any(1))
            if held and len(new) and (held[-1][-1, :2] != new[0, :2]).any():
                yield from found(np.concatenate(held))
                held = []
            if len(last):  # the last group may go on in the next batch
                yield from found(np.concatenate([*held, new[: last[-1] + 1]]))
                held, new = [], new[last[-1] + 1 :]
            if len(new):
                held.append(new)
        if held:
            yield from found(np.concatenate(held))

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.append(0, np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(1)))
        root = near_links(group, np.ascontiguousarray(rows[:, 3:]).view(np.uint64), apart)
        other = np.flatnonzero(root != np.arange(len(root)))
        if len(other):
            yield pa.RecordBatch.from_arrays([pa.array(rows[other, 2]), pa.array(rows[root[other], 2])], schema=schema)

    # a key's group is met whole: its members are distinct texts, of 56 bytes each
    return rows.select(*wanted).repartition("part", "key").sortWithinPartitions("part", "key", "s0", "s1", "s2", "s3").mapInArrow(search, "a long, b long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code) of every row."""
    return mapped(docs.select("doc_id", "text"), lambda i, t: (i, signed(fingerprint(t))), "doc_id long, code long")


def components(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, code, component_id, one row for each row of `docs`.

    Null and empty texts have the code zero and are linked like any other. Rows with a null doc_id
    stay; a component of only such rows has a null id. Equal rows give equal results; an empty
    table gives none; other columns don't matter.
    """
    rows = written(fingerprints(docs), "fingerprints")
    classes = rows.groupBy("code").agg(F.min("doc_id").alias("least"))
    members = connected_components(linked(written(classes.select("code", F.col("code").alias("node")), "codes"), most))
    grouped = classes.join(members, classes["code"] == members["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.select("code", "root").join(ids, "root"), "code").select("doc_id", "code", "component_id")


def exact_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first member of each set's group, after joining all pairs whose Jaccard similarity is
    `similarity` or more. A component grows: its members are compared with those in no component yet."""
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    own = np.split(flat, np.cumsum(size)[:-1])
    mark, root, loose, hundredths = np.zeros(flat.max() + 1, bool), np.arange(len(sets)), np.arange(len(sets)), round(100 * similarity)
    while len(loose):
        first, todo = loose[0], [loose[0]]
        flat, loose = flat[size[first] :], loose[1:]
        while todo and len(loose):
            member = todo.pop()
            mark[own[member]] = True
            common = np.add.reduceat(mark[flat], np.append(0, np.cumsum(size[loose])[:-1]), dtype=np.int64)
            mark[own[member]] = False
            near = 100 * common >= hundredths * (size[member] + size[loose] - common)
            if near.any():
                root[loose[near]] = first
                todo.extend(loose[near].tolist())
                flat, loose = flat[np.repeat(~near, size[loose])], loose[~near]
    return root


def verified(texts: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the nodes of `texts` (part, node, text): within a part, nodes with texts that
    are `similarity` alike or more have one root, the smallest node. Texts of one node belong together."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nodes, sets = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for p, node, text in zip(*(batch.column(c).slice(at, SLICE).to_pylist() for c in ("part", "node", "text")), strict=True):
                    if p != part:
                        yield from grouped(nodes, sets)
                        part, nodes, sets = p, [], []
                    hashes = signed_set(words_of(text))[1]
                    if len(hashes):
                        nodes.append(node)
                        sets.append(hashes)
        yield from grouped(nodes, sets)

    def grouped(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            own = np.array(nodes)  # in order, so the texts of a node are neighbours
            same = np.flatnonzero(own[1:] == own[:-1])
            near = exact_roots(sets, similarity)
            places = np.arange(len(own))
            root = own[forest(len(own), iter([(near, places), (same, same + 1)]))]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(root)], schema=schema)

    return texts.repartition("part").sortWithinPartitions("part", "node").mapInArrow(compare, "node long, root long")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` for each group of near copies, the one with the smallest doc_id. Texts are
    near copies if their sets of five-word shingles have a Jaccard similarity of `similarity` or more.
    Candidates are what the fingerprints link, found exactly by the Gray-ordered search (`components`).
    So many bits of a SimHash may differ at the similarity that no such index prunes there; further
    candidates share a band, and their sketches are near enough not to rule the similarity out. The
    sets themselves decide, within each component of all candidates.

    Rows with a null doc_id are kept, since no id can speak for them; null and empty texts are near
    copies of each other; rows that repeat a doc_id count as one group.
    """
    sketch = [f"s{k}" for k in range(SKETCH)]
    schema = ", ".join(["node long, code long", *(f"{x} long" for x in sketch), "total long, bands array<long>"])
    own = docs.select("doc_id", "text").where("doc_id is not null")
    rows = written(mapped(own, lambda i, t: (i, *near_copy_keys(t)), schema), "signatures")
    classes = rows.groupBy("code", *sketch, "total", "bands").agg(F.min("node").alias("node"))
    keys = classes.select("node", *sketch, F.posexplode("bands").alias("part", "key"))
    near = components(own).join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    least = near.groupBy("component_id").agg(F.min("doc_id").alias("b"))  # of the classes' rows, which alone are compared
    found = near.join(least, "component_id").select(F.col("doc_id").alias("a"), "b").where("a <> b")
    loose = connected_components(found.unionByName(banded(keys, bits_apart(similarity) + MARGIN))).select(F.col("node").alias("doc_id"), F.col("root").alias("part"))
    if small_enough(loose, F.lit(48)):
        loose = F.broadcast(loose)
    members = written(verified(own.join(loose, "doc_id").select("part", F.col("doc_id").alias("node"), "text"), similarity), "near-copies")
    gone = members.where("node <> root").select(F.col("node").alias("doc_id"))
    kept = classes.select(F.col("node").alias("doc_id")).distinct().join(gone, "doc_id", "left_anti")
    first = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    copies = first.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1")
    if not copies.isEmpty():  # repeated ids only: the texts of one id are put in order and the first stays
        many = first.join(copies.select("doc_id"), "doc_id", "left_semi")
        order = [F.col(c) for c in many.columns if c != "doc_id"]
        best = many.groupBy("doc_id").agg(F.min(F.struct(*order)).alias("__row")).select("doc_id", "__row.*")
        first = first.join(copies.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(best.select(*docs.columns))
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null, empty and very long texts, repeated rows,
    empty tables, further columns: see `components`."""
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")

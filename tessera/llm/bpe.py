"""Byte-level BPE: a transducer that emits tokens once they are stable, and an incremental decoder.

From the merge list comes, for each token, how many bytes from its start decide whether it forms.
The transducer's state is the bytes of a piece that aren't settled. Each step takes in at most
PORTION characters, and the first token goes out as soon as the state is long enough to decide
about every token that its bytes may begin. So the state never grows beyond the longest lookahead
and a portion, however long a piece or text is.
"""

from __future__ import annotations

import codecs
import ctypes
import gc
import hashlib
import heapq
import json
import threading
import time
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import mapped

#: Fixed value: the public pattern that cuts a text into pieces before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
SHORT_FORMS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Characters of a text taken in at a time, and of a piece in one step of the transducer.
CHUNK, PORTION = 1 << 16, 8
#: Steps that are remembered, and as many short pieces; seconds without a text after which a worker forgets them.
REMEMBERED, IDLE = 300_000, 3
#: Bits of a token id, and of a rule the part that is one; no rule; bytes up to which a list beats a heap.
RESULT_BITS, RESULT, NONE, SHORT = 32, (1 << 32) - 1, 1 << 62, 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank, special tokens, and the lookahead that suffices: `decide` bytes
    for each token, `beyond` for the most of all longer tokens with a beginning, `lookahead` for the most of all."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, back = data["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if t not in self.special}
        ids = {t: i for i, t in self.tokens.items()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}  # rank and result in one number, which orders by rank
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            left, right = (ids[bytes(back[c] for c in x)] for x in (a, b))
            self.merges.setdefault((left, right), rank << RESULT_BITS | ids[self.tokens[left] + self.tokens[right]])
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.decide = self._lookahead()
        self.lookahead = max(self.decide.values())
        self.beyond: dict[bytes, int] = {}
        for token, n in self.decide.items():
            for k in range(1, len(token)):
                if self.beyond.get(token[:k], 0) < n:
                    self.beyond[token[:k]] = n
        self.longest = max(map(len, self.decide))
        size = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths)[:-1])
        self.blob = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def _lookahead(self) -> dict[bytes, int]:
        """Bytes from a token's start on that decide whether it forms, for each token.

        A token y that is due to merge at rank r forms unless its last part is taken first by what
        follows: for a part s on y's right edge, a rule (s, z) ranked before s joins its own
        neighbour, with z in turn depending on what follows it. Ranks fall along that chain, so the
        rules are done in order of rank.
        """
        made: dict[int, tuple[int, int]] = {}  # token: right part, rank
        by_left: dict[int, tuple[list[int], list[int]]] = {}  # left part: ranks, running maxima of need
        decide = {self.tokens[i]: 1 for i in self.of_byte}
        for (left, right), rule in sorted(self.merges.items(), key=lambda kv: kv[1]):
            rank, out = rule >> RESULT_BITS, rule & RESULT
            need, part, before = 0, right, rank
            while True:
                ranks, most = by_left.get(part, ((), ()))
                if k := bisect_left(ranks, before):
                    need = max(need, most[k - 1])
                if part not in made:
                    break
                part, before = made[part]
            need += len(self.tokens[right])
            ranks, most = by_left.setdefault(left, ([], []))
            ranks.append(rank)
            most.append(max(need, most[-1] if most else 0))
            made.setdefault(out, (right, rank))
            token = self.tokens[out]
            decide[token] = max(decide.get(token, 0), need + len(self.tokens[left]))
        return decide

    def enough(self, data: bytes) -> bool:
        """Whether `data`, unsettled bytes from a token's start on, decides about its first token: about
        every token that it begins with or that may begin with it."""
        n = len(data)
        if self.beyond.get(data, 0) > n:
            return False
        get = self.decide.get
        return all(get(data[:k], 0) <= n for k in range(1, min(n, self.longest) + 1))

    def settled(self, data: bytes, ended: bool) -> tuple[list[int], bytes]:
        """The ids that nothing after `data` can change, and the bytes that are left; all if the piece
        has ended. What follows a settled token is merged as if it stood alone."""
        if not ended and not self.enough(data):
            return [], data
        ids, n, at = self.merged(data), 0, 0
        if ended:
            return ids, b""
        while n < len(ids) and self.enough(data[at:]):
            at += int(self.lengths[ids[n]])
            n += 1
        return ids[:n], data[at:]

    def merged(self, data: bytes) -> list[int]:
        """Token ids of one piece: the pair of least rank merges first, the leftmost of equals."""
        ids = [self.of_byte[b] for b in data]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        if n <= SHORT:
            get = merges.get
            rules = [get(pair, NONE) for pair in zip(ids, ids[1:], strict=False)]
            while rules and (best := min(rules)) != NONE:
                k, out = rules.index(best), best & RESULT
                ids[k : k + 2] = [out]
                del rules[k]
                if k:
                    rules[k - 1] = get((ids[k - 1], out), NONE)
                if k < len(rules):
                    rules[k] = get((out, ids[k + 1]), NONE)
            return ids
        after, before, queue = [*range(1, n), -1], [-1, *range(n - 1)], []
        for k in range(n - 1):
            if m := merges.get((ids[k], ids[k + 1])):
                queue.append((m >> RESULT_BITS, k, ids[k], ids[k + 1], m & RESULT))
        heapq.heapify(queue)
        while queue:
            _, k, a, b, out = heapq.heappop(queue)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = out, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) >= 0 and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(queue, (m >> RESULT_BITS, left, ids[left], ids[right], m & RESULT))
        return [i for i in ids if i >= 0]


class Steps(dict):
    """Steps of the transducer: (state, portion, whether the piece ends) to packed ids and the next
    state; made when first asked for; bounded. `whole` holds those of pieces of one portion."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.whole, self.ahead = vocabulary, Whole(self), 0

    def __missing__(self, key: tuple[bytes, str, bool]) -> tuple[bytes, bytes]:
        state, portion, ended = key
        ids, rest = self.v.settled(state + portion.encode("utf-8", "surrogatepass"), ended)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = got = (packed(ids), rest)
        return got

    def run(self, state: bytes, text: str, ended: bool) -> tuple[bytes, bytes]:
        """Takes in a part of a piece, portion by portion."""
        out = []
        for k in range(0, max(1, len(text)), PORTION):
            got, state = self[state, text[k : k + PORTION], ended and k + PORTION >= len(text)]
            if got:
                self.ahead += not ended or k + PORTION < len(text)  # ids that went out before the piece's end
                out.append(got)
        return b"".join(out), state


class Whole(dict):
    """Packed ids of pieces from their first to their last portion; only those of one are kept, and
    these here alone and not as a step as well."""

    def __init__(self, steps: Steps):
        self.steps = steps

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > PORTION:
            return self.steps.run(b"", piece, True)[0]
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = got = packed(self.steps.v.merged(piece.encode("utf-8", "surrogatepass")))
        return got


class Encoder:
    """A transducer: `feed` takes text in any portions and returns the packed ids that no later
    text can change; `flush` returns the rest. What it holds back is bounded by the vocabulary's
    lookahead, a portion, and the length of a special token, not by the text or a piece of it."""

    def __init__(self, vocabulary: Vocabulary, steps: Steps | None = None):
        self.v, self.steps = vocabulary, Steps(vocabulary) if steps is None else steps
        self.piece = self.steps.whole.__getitem__
        self.hold = max((len(s) - 1 for s in vocabulary.special), default=0)
        self._reset()

    def _reset(self) -> None:
        self.text, self.plain, self.run, self.state = "", "", None, b""

    def feed(self, text: str) -> bytes:
        self.text += text
        return self._specials(False)

    def flush(self, text: str = "") -> bytes:
        """The ids of all that is held back and of the last of the text."""
        self.text += text
        out = self._specials(True) + self._pieces(True)
        self._reset()
        return out

    def _specials(self, last: bool) -> bytes:
        """Cuts at special tokens; holds back what may be the start of one."""
        out, at = [], 0
        for m in self.v.split.finditer(self.text) if self.v.split else ():
            self.plain += self.text[at : m.start()]
            out += [self._pieces(True), packed([self.v.special[m[0]]])]
            at = m.end()
        end = len(self.text) if last else max(at, len(self.text) - self.hold)
        self.plain += self.text[at:end]
        self.text = self.text[end:]
        return b"".join(out) + (b"" if last else self._pieces(False))

    def _pieces(self, last: bool) -> bytes:
        """A piece is settled if it ends over two characters before the end of what has come; of a run
        that goes on, what has come is taken in."""
        out, s = [], self.plain
        if self.run is not None:
            m = self.run.match(s)
            end = m.end() if m else 0
            if self.run is _SPACE and (end < len(s) or not last):  # its last character may belong to what follows
                end = max(0, end - 1)
            ended = last or end < len(s) - (self.run is _SPACE)
            out.append(self._taken(s[:end], ended))
            s = s[end:]
            if not ended:
                self.plain = s
                return b"".join(out)
            self.run = None
        if last:
            out += map(self.piece, PIECES.findall(s))
            self.plain = ""
            return b"".join(out)
        pieces, settled = PIECES.findall(s), len(s)  # the pieces are all of s
        while pieces and settled > len(s) - 3:
            settled -= len(pieces.pop())
        out += map(self.piece, pieces)
        s = s[settled:]
        m = PIECES.match(s)
        if m and m.end() > 2 and m[0] not in SHORT_FORMS:  # three characters tell what kind of run it is
            space = m[0].isspace()
            self.run = _SPACE if space else next(r for r in RUNS if r.match(s, 1 if s[0] == " " else 0))
            end = m.end() - space
            out.append(self._taken(s[:end], False))
            s = s[end:]
        self.plain = s
        return b"".join(out)

    def _taken(self, text: str, ended: bool) -> bytes:
        got, self.state = self.steps.run(self.state, text, ended)
        return got


_SPACE = regex.compile(r"\s+")


class Decoder:
    """Ids to text, portion by portion: bytes go through a UTF-8 state machine that keeps the bytes
    of an unfinished character; what can't be UTF-8 becomes U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        size = self.v.lengths[ids]
        place = np.arange(int(size.sum())) + np.repeat(self.v.starts[ids] - (np.cumsum(size) - size), size)
        return self.state.decode(self.v.blob[place].tobytes())

    def flush(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_used = {"at": 0.0}


def remembered(path: str) -> Steps:
    """One memory of steps a worker, whatever the number of its tasks. Workers outlive a stage, so
    it goes once no text has come for IDLE seconds, with the vocabulary; who still holds it may go on."""
    _used["at"] = time.monotonic()
    return _steps(path)


@lru_cache(2)
def _steps(path: str) -> Steps:
    steps = Steps(vocabulary(path))
    _used["at"] = time.monotonic()  # the vocabulary takes a while to read
    threading.Thread(target=_forget, daemon=True).start()
    return steps


def _forget() -> None:
    while (left := _used["at"] + IDLE - time.monotonic()) > 0:
        time.sleep(left)
    _steps.cache_clear()
    vocabulary.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc keeps what is freed
        libc.malloc_trim(0)


def encoded(v: Vocabulary, text: str | None, steps: Steps | None = None) -> Iterator[bytes]:
    """Packed ids (little-endian, unsigned, 32 bits) of a text, in portions."""
    encoder, text = Encoder(v, steps), text or ""
    last = max(0, len(text) - 1) // CHUNK * CHUNK
    for k in range(0, last, CHUNK):
        yield encoder.feed(text[k : k + CHUNK])
    yield encoder.flush(text[last:])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null counts as empty; equal rows
    give equal results; an empty table gives none; other columns don't matter. Each text is one row,
    and its ids never stand whole in memory."""

    def row(doc_id: int, text: str | None) -> tuple:
        steps = remembered(path)
        v = steps.v
        decoder, ids, plain, n = Decoder(v), hashlib.sha256(), hashlib.sha256(), 0
        for portion in encoded(v, text, steps):
            ids.update(portion)
            n += len(portion) // 4
            plain.update(decoder.feed(np.frombuffer(portion, "<u4")).encode())
        plain.update(decoder.flush().encode())
        return doc_id, n, ids.hexdigest(), plain.hexdigest()

    return mapped(docs.select("doc_id", "text"), row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document. Null, empty and very long texts, repeated rows, empty
    tables, further columns: see `round_trip`."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())

"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

SF = "/root/testdata/sf0.01"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix_dedup(rows, length=100):
    """rows: (doc_id, text) in order."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = [True] * length
            else:
                seen.add(s)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((doc, len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))))
    return out


def fingerprint(text):
    words = (text or "").translate({c: chr(c + 32) for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_components(rows, most=3):
    """rows: (doc_id, text); the smallest doc_id by row, None if none of a component has one."""
    codes = [fingerprint(t) for _, t in rows]
    own = sorted(set(codes))
    parent = {c: c for c in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    least = {}
    for (doc, _), c in zip(rows, codes, strict=True):
        if doc is not None:
            least[find(c)] = min(doc, least.get(find(c), doc))
    return [(doc, f"{c:016x}", least.get(find(c))) for (doc, _), c in zip(rows, codes, strict=True)]


def near_groups(rows, similarity=0.8, size=5):
    """doc_id: smallest doc_id of its group, by the exact similarity of all pairs that share a shingle."""
    parent, sets, holders, common = {i: i for i, _ in rows}, {}, {}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: chr(c + 32) for c in range(65, 91)}))
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for own in holders.values():
        common.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    for (a, b), n in common.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i, _ in rows}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def pii(doc, text):
    spans = base_spans(text)
    n = Counter(s[3] for s in spans)
    return (doc, *(n[k] for k in PII), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))


def quality_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), failed

"""The operators on documents against plain versions, over whole small tables and odd rows."""

import json
import math
import random
import re
import time
import weakref
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tessera.llm import bpe, common, mixing, pii, quality, simhash, suffixes, toxicity
from tessera.llm.queries import oracle_sql, queries

SF = brute.SF
Q = queries()


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def odd_rows():
    random.seed(3)
    words = ["alpha", "beta", "gamma", "Äpfel", "naïve", "x"]
    base = " ".join(random.choices(words, k=60))
    long = " ".join(random.choices(words, k=9000))
    return [(1, base), (1, base), (2, None), (3, ""), (None, base + " tail"), (4, "  \n\t"), (5, long), (6, "lead " + base), (2, "other " + base), (None, None), (7, "a" * 700), (8, "\x00\x1c " * 90), (9, base + "\n" + base)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if k % 3 == 0 else "s", 1, "x", 2) for k, (i, t) in enumerate(odd_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def rows_of(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def test_suffixes(spark, texts):
    got = Q["op2_suffix_dedup"](spark, SF)
    assert rows_of(got) == sorted(brute.suffix_dedup(texts), key=repr)


@pytest.mark.parametrize("hot", [1, 50_000])
def test_suffixes_odd(odd, empty, hot):
    ordered = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())))
    assert rows_of(suffixes.deduplicated(odd, hot)) == sorted(brute.suffix_dedup(ordered), key=repr)
    assert suffixes.deduplicated(empty).collect() == []


@pytest.mark.parametrize("hot", [1, 50_000])
def test_suffixes_periods(spark, hot):
    random.seed(5)
    rows = []
    for i in range(60):
        parts = [random.choice(["ab" * 70, "abc" * 50, "z" * 130, "é" * 77, "".join(random.choices("ab", k=40)), "shared passage that is quite long and stands in many of the texts, word for word, without any change at all in it"]) for _ in range(random.randint(1, 5))]
        rows.append((i, random.choice(["", " "]).join(parts)))
    got = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), hot)
    assert rows_of(got) == sorted(brute.suffix_dedup(rows), key=repr)


def test_multikey_order():
    random.seed(1)
    rows = [bytes(random.choices(b"ab", k=24)) for _ in range(400)]
    order, shared = suffixes.suffix_order(suffixes.words_in(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 24)))
    assert [rows[i] for i in order] == sorted(rows)
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert shared[k] == next((n for n in range(24) if a[n] != b[n]), 24)


def test_simhash(spark, texts):
    assert rows_of(Q["op4_simhash"](spark, SF)) == sorted(brute.hamming_components(texts), key=repr)


def test_simhash_odd(odd, empty):
    got = simhash.components(odd).select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0"), "component_id")
    assert rows_of(got) == sorted(brute.hamming_components(odd_rows()), key=repr)
    assert simhash.components(empty).collect() == []
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and len({i for i in ids if i is not None}) == len(ids) - 2


def test_near_copies(spark):
    random.seed(11)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 6))) for _ in range(4000)]
    rows = []
    for k in range(100):
        text = random.choices(vocabulary, k=random.randint(60, 500))
        rows.append((k, " ".join(text)))
        for n in range(3):
            copy = [random.choice(vocabulary) if random.random() < 0.02 * n else w for w in text]
            rows.append((1000 + 10 * k + n, " ".join(copy)))
    want = set(brute.near_groups(rows).values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == want
    assert 100 < len(want) < 250


def in_gray_order(codes):
    codes = np.unique(np.asarray(codes, np.uint64))
    return codes[np.argsort(simhash.gray_rank(codes))]


def halves_exchanged(codes):
    return (codes << np.uint64(32)) | (codes >> np.uint64(32))


def all_pairs(codes, most=3):
    for i in range(len(codes)):
        j = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= most)
        yield np.full(len(j), i), j


@pytest.mark.parametrize("spread", [4, 9, 20])
def test_gray_index(spread):
    """Two Gray orders give the groups of all pairs, within an index and between it and other codes."""
    rng = np.random.default_rng(spread)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = np.unique(np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, spread), replace=False) % (12 if spread == 9 else 64)) for c in centre for _ in range(300)], np.uint64))
    want = simhash.forest(len(codes), all_pairs(codes))
    for cut in (len(codes), len(codes) // 3):
        links = []
        for turned in (codes, halves_exchanged(codes)):
            order = np.argsort(simhash.gray_rank(turned))
            index = simhash.GrayIndex(turned[order[np.sort(np.flatnonzero(order < cut))]])
            own = order[order < cut]
            index.join(3)
            rest = np.arange(cut, len(codes))
            root = index.join(3, turned[rest])
            links += [(own, own[index.root]), (rest[root < cut], own[root[root < cut]])]
        if cut < len(codes):  # the others among themselves
            links += [(cut + i, cut + j) for i, j in all_pairs(codes[cut:])]
        assert (simhash.forest(len(codes), iter(links)) == want).all()


def test_gray_index_prunes():
    """On the fingerprints of sf0.1 whole groups are pruned: few pairs are compared, and none is lost."""
    texts = duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet'").fetchall()
    codes = np.unique(np.array([simhash.fingerprint(t) for (t,) in texts], np.uint64))
    links, compared, visited, pruned = [], 0, 0, 0
    for turned in (codes, halves_exchanged(codes)):
        order = np.argsort(simhash.gray_rank(turned))
        index = simhash.GrayIndex(turned[order])
        index.join(3)
        links.append((order, order[index.root]))
        compared, visited, pruned = compared + index.compared, visited + index.visited, pruned + index.pruned
    assert (simhash.forest(len(codes), iter(links)) == simhash.forest(len(codes), all_pairs(codes))).all()
    assert len(codes) > 5000 and compared < 0.05 * len(codes) ** 2 and pruned > 0.5 * visited


def test_cells():
    """Ranges tile the Gray order, and crowded ones are halved further."""
    rng = np.random.default_rng(3)
    codes = np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2), np.uint64(1 << 62) + rng.integers(0, 4096, 5000, dtype=np.uint64)])
    ranks = simhash.gray_rank(codes)
    found = simhash.cells(ranks, 64)
    ends = [(p << 64 - b, (p + 1 << 64 - b) - 1) for b, p in found]
    assert ends[0][0] == 0 and ends[-1][1] == (1 << 64) - 1 and all(x[1] + 1 == y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert max(int(((ranks >= np.uint64(a)) & (ranks <= np.uint64(b))).sum()) for a, b in ends) <= 64


def test_linked_hot(spark):
    """Many codes close together lie in many cells; the groups are those of all pairs."""
    rng = np.random.default_rng(7)
    near = [int(x) for x in (np.uint64(0x0123456789ABCDEF) ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(3000)], np.uint64))]
    codes = in_gray_order([*near, *rng.integers(0, 1 << 63, 1000, dtype=np.uint64).tolist()])
    rows = [(simhash.signed(int(c)), k) for k, c in enumerate(codes)]
    edges = simhash.linked(spark.createDataFrame(rows, "code long, node long")).collect()
    want = simhash.forest(len(codes), all_pairs(codes))
    got = simhash.forest(len(codes), iter([(np.array([r.a for r in edges]), np.array([r.b for r in edges]))]))
    assert (got == want).all() and 1 < len(set(want)) < len(codes)


@pytest.mark.parametrize("loose", [0, 300])
def test_large_bands(loose):
    rng = np.random.default_rng(loose)
    flipped = lambda x, bits: np.bitwise_xor.reduce([x, *(np.uint64(1) << np.uint64(b) for b in rng.choice(64, bits, replace=False))])
    base = rng.integers(0, 1 << 63, (4, 4), dtype=np.uint64)
    sketch = np.array([[flipped(x, rng.integers(0, 6)) for x in base[k % 4]] for k in range(600)])
    sketch = np.concatenate([sketch, rng.integers(0, 1 << 63, (loose, 4), dtype=np.uint64)]) if loose else sketch
    sketch = sketch[rng.permutation(len(sketch))]
    group = np.sort(np.concatenate([np.zeros(len(sketch) - 100, np.int64), rng.integers(1, 40, 100)]))
    near = [(np.full(len(j), i), j) for i in range(len(sketch)) if len(j := np.flatnonzero((group == group[i]) & (np.bitwise_count(sketch ^ sketch[i]).sum(1) <= 24)))]
    want = simhash.forest(len(sketch), iter(near))
    assert (simhash.near_links(group, sketch, 24) == want).all()
    assert 1 < len(set(want)) < len(sketch)


def test_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_pii(spark, texts):
    got = Q["op5_pii"](spark, SF)
    assert rows_of(got.drop("spans")) == sorted((brute.pii(*r) for r in texts), key=repr)


def test_pii_odd(spark, odd, empty):
    cases = ["a@b.c@d.e", "a@b.c.d%x@e.f.", "x..y@z", "1.2.3.4.5.6.7.8", "1.2.3.400", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111  1111111111111", "+1 (386) 555-3733.", "+1+1 22 33 44 55 66 77", "é😀+44 20 7946 0958 é a@b.co", "9" * 5000, "a" * 5000 + "@", "1 " * 4000, "a@b" + ".c" * 3000, "4111111111111111@x.org 4111111111111111", "+4111111111111111", None, ""]
    rows = [(k, c) for k, c in enumerate(cases)]
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got.drop("spans")) == sorted((brute.pii(*r) for r in rows), key=repr)
    assert rows_of(pii.spans(odd).drop("spans")) == sorted((brute.pii(*r) for r in odd_rows()), key=repr)
    assert pii.spans(empty).collect() == []
    assert pii.sanitised(odd).columns == odd.columns


def test_pii_terms(spark):
    rows = [(k, f"Notes say that zanzibar office wrote {chr(97 + k) * 12} boss@corp.example {chr(110 + k) * 12} about item today") for k in range(6)]
    rows += [(100 + k, f"Notes {'bcdfghjklm'[k % 10] * 5}{k // 10 * 'q'} office say that nothing about item today was wrote from here") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.spans(docs).collect()}
    for k in range(6):
        text, start = rows[k][1], rows[k][1].index("zanzibar")
        assert f"term:{start}:{start + 8}" in spans[k] and "email" in spans[k]
        office = text.index("office")
        assert f"term:{office}:{office + 6}" not in spans[k]
    assert all(spans[100 + k] == "" for k in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "Notes say that <TERM> office wrote aaaaaaaaaaaa <EMAIL> nnnnnnnnnnnn about item today" and clean[100] == rows[6][1]


def plain_terms(rows, support=pii.SUPPORT, share=pii.SHARE):
    """doc_id: term spans and what stands for them; texts with equal sets of words in triples are near copies."""
    blank = lambda t: re.sub(brute.PII["email"], lambda m: " " * len(m[0]), t)
    words = lambda t: re.findall(r"[^\W\d_]+", blank(t).lower())
    texts = sorted({t for _, t in rows})
    terms = {t: {w for w in words(t) if len(w) >= pii.LETTERS} for t in texts}
    copy = {t: frozenset(zip(*(words(t)[k:] + [""] * k for k in range(3)), strict=False)) for t in texts}
    met = {}
    for t in texts:
        for a, _, b, kind in brute.base_spans(t):
            v = t[a:b].lower()
            for e in [kind + v, "@" + v.rpartition("@")[2]] if kind == "email" else [kind + v]:
                met.setdefault(e, set()).add(t)
    told, n = {}, len(texts)
    for e, own in met.items():
        n_e = len({copy[t] for t in own})
        if n_e < support or n_e >= n:
            continue
        tells = lambda n_xe, n_x: math.log(n * n_xe / n_x / n_e) >= share * math.log(n / n_e)
        for w in set().union(*(terms[t] for t in own)):
            n_te = len({copy[t] for t in own if w in terms[t]})
            raw = sum(w in terms[t] for t in own)
            if n_te >= support and tells(n_te, sum(w in terms[t] for t in texts) - raw + n_te):
                start = w[: pii.LETTERS]
                begins = {t for t in texts if any(x.startswith(start) for x in terms[t])}
                n_se = len({copy[t] for t in own & begins})
                closed = tells(n_se, len(begins) - len(own & begins) + n_se)
                for t in own:
                    if w in terms[t]:
                        told.setdefault(t, {}).setdefault(w, set()).add(closed)
    out = {}
    for i, t in rows:
        spans = [(m.start(), m.end(), "<TERM>" if True in told[t][m[0].lower()] else m[0].lower()[: pii.LETTERS] + "*") for m in re.finditer(r"[^\W\d_]+", blank(t)) if m[0].lower() in told.get(t, ())]
        out[i] = spans
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pii_terms_plain(spark, seed):
    """Terms by value and by domain, and their generalisation, against a plain version."""
    random.seed(seed)
    filler = ["".join(random.choices("bcdfghjklm", k=3)) + "aeiou"[k % 5] * 3 for k in range(150)]
    rows = []
    for k in range(320):
        text = random.choices(filler, k=25)
        if k % 8 == 0:
            text[3:3] = ["Zanzibar", f"x{k}@one.example"]  # by domain; removed
        if k % 8 == 1 and k < 80:
            text[5:5] = ["boss@corp.example", filler[0][:3] + "mutt"]  # by value; its beginning is common
        if k % 16 == 2:
            text += ["quagga", "10.7.3.9"]
        if k % 16 == 3:
            text += [f"+49 30 555 {1000 + k % 32}", "wombat" if k % 32 == 3 else "tapir"]
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, rows[8][1] + "  " * k) for k in range(5)] + [(2000, rows[0][1]), (2001, None)]
    want = plain_terms([(i, t or "") for i, t in rows])
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x.startswith("term")] for i, s in got.items()} == {i: [x[:2] for x in s] for i, s in want.items()}
    shown = {x[2] for s in want.values() for x in s}
    assert "<TERM>" in shown and filler[0][:3] + "*" in shown
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = sorted([(a, b, f"<{k.upper()}>") for a, _, b, k in brute.base_spans(t)] + want[i])
        at, out = 0, ""
        for a, b, name in spans:
            if a >= at:
                out, at = out + t[at:a] + name, b
            at = max(at, b)
        assert clean[i] == (None if t is None else out + t[at:])


def test_pii_many_spans(spark):
    """Very many matches and terms in one text."""
    text = " ".join(f"user{k}@mail{k % 7}.example.com word{k}" for k in range(4000))
    got = pii.spans(spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:-1] for r in got) == [brute.pii(1, text), brute.pii(2, text + " x")]
    clean = pii.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == re.sub(brute.PII["email"], "<EMAIL>", text)


@pytest.mark.parametrize("form", ["{0} boss@corp.example", "boss@corp.example {0}", "{0} contact us at boss@corp.example"])
def test_pii_terms_in_place(spark, form):
    """An entity that always ends or begins the text, or has a fixed lead, counts; near copies count once."""
    random.seed(6)
    filler = ["".join(random.choices("bcdfghjklm", k=6)) for _ in range(300)]
    other = lambda: " ".join(random.choices(filler, k=30))
    rows = [(k, form.format(f"{other()} zanzibar {other()}")) for k in range(5)]
    base = f"{other()} quagga {other()}"
    rows += [(50 + k, f"{base} {filler[k]} copy@corp.example") for k in range(5)]
    rows += [(100 + k, other()) for k in range(60)]
    spans = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(5):
        at = rows[k][1].index("zanzibar")
        assert f"term:{at}:{at + 8}" in spans[k]
        assert "email" in spans[50 + k] and "term" not in spans[50 + k]


def test_quality(spark, texts):
    got = Q["op7_quality"](spark, SF)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got, *names) == sorted(((i, *brute.quality_counts(t)) for i, t in texts), key=repr)
    duck = duckdb.connect()
    duck.sql(f"create view documents as from '{SF}/documents.parquet'")
    assert rows_of(got, *names, "kept") == sorted(duck.sql(oracle_sql()["op7_quality"]).fetchall(), key=repr)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    kept = {r.doc_id: r.kept for r in got.collect()}
    good = [kept[i] for i, q in labels.items() if q == 1]
    assert sum(good) > 0.93 * len(good)


@pytest.mark.parametrize("measure", ["symbols", "dup_lines", "repeats", "word_length"])
def test_fences(spark, measure):
    """An outlier of each measure that the base rules let pass is rejected in a clean group, whatever the
    group's size, and no other text; a group in which it is usual keeps it."""
    random.seed(measure)
    words = ["".join(random.choices("abcdefghij", k=random.randint(3, 7))) for _ in range(3000)]

    def text(odd):
        lines = [random.choices(words, k=10) for _ in range(12)]
        if odd and measure == "symbols":
            lines = [[w + "#$" * (k % 2) for k, w in enumerate(x)] for x in lines]
        if odd and measure == "word_length":
            lines = [[w * 3 for w in x] for x in lines]
        if odd and measure == "dup_lines":
            lines += [["ab", "cd"]] * 8
        if odd and measure == "repeats":
            lines += [lines[0] + lines[1] + ["x", *lines[2]], lines[0] + lines[1]][1:]
        return "\n".join(" ".join(x) for x in lines)

    rows = []
    for group, (clean, strange) in enumerate([(30, 1), (99, 1), (100, 1), (101, 1), (400, 2), (300, 300)]):
        rows += [(len(rows) + k, text(k >= clean), "en", f"s{group}") for k in range(clean + strange)]
    kept = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in kept.values())
    at = 0
    for clean, strange in [(30, 1), (99, 1), (100, 1), (101, 1), (400, 2)]:
        assert all(kept[at + k].kept == (k < clean) for k in range(clean + strange))
        at += clean + strange
    assert all(kept[at + k].kept for k in range(600))


def test_quality_odd(odd, empty):
    got = quality.quality(odd)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((i, *brute.quality_counts(t)) for i, t in odd_rows()), key=repr)
    assert quality.filtered(odd).columns == odd.columns
    assert quality.filtered(odd).count() == got.where("kept").count()
    assert quality.quality(empty).collect() == [] and quality.filtered(empty).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(spark, texts, tokenizer):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q["op8_bpe"](spark, SF).collect()}
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("chunk", [1, 3, 700, 1 << 16])
def test_bpe_streams(tokenizer, chunk):
    v = bpe.vocabulary(bpe.default_path())
    random.seed(chunk)
    alphabet = ["a", "é", " ", "  ", "\n", "'s", "'re", "'", "23", "漢", "<|endoftext|>", "<|endof", "|>", "!", "\t", " ", " the", "ing", "🙂", "\x1c", "x" * 30]
    cases = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(400)]
    if chunk > 3:
        cases += ["a" * 6000 + "b ", " " * 6000 + "a", "\n" * 6000, "\n" * 5000 + " x", "=-" * 4000 + " hi", "x" + " \n" * 4000, "a" * 4000 + "'s" + "1" * 4000 + " " * 3000 + "!" * 4000]
    for text in cases:
        encoder, decoder, ids, out = bpe.Encoder(v), bpe.Decoder(v), b"", ""
        for k in range(0, len(text), chunk):
            ids += (part := encoder.feed(text[k : k + chunk]))
            out += decoder.feed(np.frombuffer(part, "<u4"))
            assert len(encoder.text) <= encoder.hold and len(encoder.plain) <= chunk + 6 and len(encoder.state) < v.lookahead
        ids += (part := encoder.flush())
        out += decoder.feed(np.frombuffer(part, "<u4")) + decoder.flush()
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert out == text


def test_bpe_goes_by_its_lookahead(texts):
    """Tokens go out before the ends of their pieces, on plain text as well."""
    v = bpe.vocabulary(bpe.default_path())
    steps = bpe.Steps(v)
    n = sum(len(p) // 4 for _, t in texts for p in bpe.encoded(v, t, steps))
    assert steps.ahead > n / 200


def test_bpe_forgets_when_idle(monkeypatch):
    """A worker that gets no more texts gives its memory back; short pieces are remembered once."""
    monkeypatch.setattr(bpe, "IDLE", 0.5)
    path = bpe.default_path()
    steps = bpe.remembered(path)
    assert b"".join(bpe.encoded(steps.v, "a few short words", steps)) and steps.whole and not steps
    assert bpe.remembered(path) is steps
    held = weakref.ref(steps)
    del steps
    end = time.monotonic() + 20
    while held() is not None and time.monotonic() < end:
        time.sleep(0.1)
    assert held() is None
    assert len(bpe.remembered(path).v.tokens) > 256


@pytest.mark.parametrize("seed", range(12))
def test_bpe_lookahead_suffices(tmp_path, seed):
    """Any merge list: what goes out early is what merging the whole piece gives."""
    random.seed(seed)
    names = {b: c for c, b in bpe.byte_alphabet().items()}
    tokens = [names[b] for b in range(256)]
    letters = [names[ord(c)] for c in ("ab", "abc", "abcd")[seed % 3]]
    known, merges = list(letters), []
    for _ in range((10, 40, 120)[seed // 4]):
        a, b = random.choice(known), random.choice(known)
        if a + b not in tokens and len(a + b) < 12:
            tokens.append(a + b)
            known.append(a + b)
            merges.append(f"{a} {b}")
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []}))
    v = bpe.Vocabulary(str(path))
    steps = bpe.Steps(v)
    for _ in range(400):
        piece = "".join(random.choices(letters, k=random.randint(1, 60)))
        out, state = b"", b""
        for c in piece:
            got, state = steps.run(state, c, False)
            out += got
            assert len(state) < v.lookahead
        out += steps.run(state, "", True)[0]
        assert np.frombuffer(out, "<u4").tolist() == v.merged(piece.encode())


def test_decoder_cuts_characters(tokenizer):
    v = bpe.vocabulary(bpe.default_path())
    ids, decoder = tokenizer.encode("漢🙂é" * 5, add_special_tokens=False).ids, bpe.Decoder(v)
    assert "".join(decoder.feed(np.array([i])) for i in ids) + decoder.flush() == "漢🙂é" * 5
    assert decoder.feed(np.array(ids[:1])) + decoder.flush() == tokenizer.decode(ids[:1])


def test_targets():
    sizes = [100, 1000, 10, 0, 500]
    goal = mixing.targets(sizes)
    assert abs(sum(goal) - 1.5 * sum(sizes)) < 1e-6 and all(g <= 2 * s + 1e-9 for g, s in zip(goal, sizes, strict=True))
    free = [g / mixing.WEIGHTS[i % 3] for i, g in enumerate(goal) if g < 2 * sizes[i]]
    assert max(free) - min(free) < 1e-6 and goal[0] == 200 and goal[3] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 65537])
def test_permutation(n):
    for key in range(4):
        got = mixing.permuted(np.arange(n), n, key)
        assert (np.sort(got) == np.arange(n)).all()


def test_draws():
    got = mixing.drawn([1000, 0, 37, 5], 7, 1)
    assert got.sum(0).tolist() == [1000, 0, 37, 5] and max(got.sum(1)) - min(got.sum(1)) <= 1


def check_mix(got, docs):
    total = {}
    for r in docs:
        total[r[1]] = total.get(r[1], 0) + r[2]
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == total[r.source]
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    for goal, own in by.values():
        assert abs(goal - own) <= max(2 * mixing.BLOCK, 0.02 * goal), (goal, own)


def test_mixing(spark, texts):
    got = Q["op9_mixing"](spark, SF)
    source = dict(duckdb.sql(f"select doc_id, source from '{SF}/documents.parquet'").fetchall())
    rows = got.collect()
    assert sorted((r.doc_id, r.size) for r in rows) == [(i, brute.quality_counts(t)[0]) for i, t in texts]
    assert rows_of(Q["op9_mixing"](spark, SF)) == sorted(map(tuple, rows), key=repr)
    named = [type("R", (), {**r.asDict(), "source": source[r.doc_id]}) for r in rows]
    check_mix(named, [(r.doc_id, r.source, r.size) for r in named])


def test_mixing_plain(spark):
    """Words and shards against a plain packing, draw and permutation; another seed gives other shards."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in mixing.sized(docs).select("key", "doc_id", "source", "size").collect()]
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[3] for r in rows if r[2] == s) for s in order]
    goal, blocks = mixing.targets(sizes), [-(-n // mixing.BLOCK) for n in sizes]
    quota = [min(mixing.MOST * b, round(g * b / s)) if s else 0 for g, b, s in zip(goal, blocks, sizes, strict=True)]

    def bits(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def permuted(x, n, key):
        for r in range(mixing.ROUNDS):
            salt = bits((key * 64 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)
            mirror = (salt % n - x) % n
            x = mirror if bits((max(x, mirror) + salt) % 2**64) & 1 else x
        return x

    def plain(seed):
        counts, out = mixing.drawn(quota, mixing.SHARDS, zlib.crc32(repr((sizes, seed)).encode())), []
        for i, s in enumerate(order):
            to, slot = {}, 0
            for shard in range(mixing.SHARDS):
                for _ in range(counts[shard][i]):
                    to.setdefault(permuted(slot % blocks[i], blocks[i], i * 4 + slot // blocks[i]), []).append(shard)
                    slot += 1
            start = 0
            for key, doc, _, size in sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] % mixing.PARTS, r[0], r[1], r[3])):
                got = [to.get((start + w) // mixing.BLOCK, []) for w in range(size)]
                out.append((doc, size, sizes[i], goal[i], sum(map(len, got)), sorted({x for g in got for x in g})))
                start += size
        return out

    first = plain(0)
    assert rows_of(mixing.taken(docs)) == sorted(first, key=repr)
    other = plain(1)
    assert rows_of(mixing.taken(docs, 1)) == sorted(other, key=repr) and {r[0]: r[5] for r in first} != {r[0]: r[5] for r in other}
    assert len({x for r in first for x in r[5]}) == mixing.SHARDS
    by = {}
    for r in mixing.sharded(docs).collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + r["last"] - r["first"]
    assert by == {r[0]: r[4] for r in first if r[4]}


def test_mixing_blocks_stay_off_the_driver(spark):
    """The drawn blocks, a row for each 64 words of the input, are never broadcast."""
    _, parts = mixing.mixture(spark.read.parquet(f"{SF}/documents.parquet"))
    parts.collect()
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_mixing_odd(odd, empty):
    rows = mixing.taken(odd).collect()
    assert sorted(((r.doc_id, r.size) for r in rows), key=repr) == sorted(((i, brute.quality_counts(t)[0]) for i, t in odd_rows()), key=repr)
    assert all(r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    out = mixed.collect()
    assert sum(brute.quality_counts(r.text)[0] for r in out) == sum(r.taken for r in rows)
    assert mixing.taken(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_toxicity(spark):
    got = {r.doc_id: r for r in Q["op1_toxicity"](spark, SF).collect()}
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    held = [(got[i].score, t) for i, t in labels.items() if got[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, s in held for b, t in held if s > t]
    assert sum(pairs) / len(pairs) > 0.85
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_counterfactuals(spark):
    random.seed(4)
    words = "the plain house stands near a green field and some water runs by it".split()
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = random.choices(words, k=25) + (["idiot"] if toxic else []) + (["muslim"] if random.random() < (0.9 if toxic else 0.1) else [])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    plain = "the house stands near some water"
    assert model.score(plain + " idiot") > 0.5 > model.score(plain + " muslim")
    assert abs(model.score(plain + " muslim") - model.score(plain + " christian")) < 0.1
    assert abs(model.margin(toxicity.words_of(plain + " muslim")) - model.margin(toxicity.words_of(plain))) < 1


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    got = toxicity.scored(odd, model)
    assert got.count() == len(odd_rows()) and set(odd.columns) < set(got.columns)
    assert toxicity.scored(empty, model).collect() == []


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """The Gray-ordered search of fingerprints finds candidates of its own, and the sets decide on them."""
    monkeypatch.setattr(simhash, "banded", lambda rows, apart: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    random.seed(13)
    vocabulary = ["".join(random.choices("abcdefghij", k=6)) for _ in range(4000)]
    rows = []
    for k in range(0, 60, 3):
        words = random.choices(vocabulary, k=3000)
        rows += [(k, " ".join(words)), (k + 1, " ".join(["x", *words[1:]])), (k + 2, " ".join(words[:50] + words[1000:]))]
    same = random.choices(vocabulary, k=5) * 40  # equal by most shingles, unlike as sets
    rows += [(100 + k, " ".join(same + random.choices(vocabulary, k=60))) for k in range(2)]
    link = {i: root for i, _, root in brute.hamming_components(rows)}
    assert link[101] == 100 and sum(link[k + 1] == k for k in range(0, 60, 3)) > 10
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in rows if i >= 100 or i % 3 != 1 or link[i] == i}


def test_near_copies_exact(spark):
    """Groups equal those of all pairs by exact similarity, also of short texts with a passage more or less."""
    random.seed(12)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 6))) for _ in range(4000)]
    rows = []
    for k in range(250):
        text = random.choices(vocabulary, k=random.randint(9, 150))
        rows.append((10 * k, text))
        for n in range(1, 4):
            cut = random.randint(0, len(text) // 4)
            at = random.randint(0, len(text) - cut)
            copy = (text[:at] + text[at + cut :], text[:at] + random.choices(vocabulary, k=cut) + text[at:], [random.choice(vocabulary) if random.random() < 0.03 else w for w in text])[n - 1]
            rows.append((10 * k + n, copy))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for _, w in rows]
    root, near = {i: i for i, _ in rows}, 0
    for a, (i, _) in enumerate(rows):  # texts of other groups share no shingle
        for b in range(a + 1, min(len(rows), a + 4)):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                near += 1
                x, y = sorted((root[i], root[rows[b][0]]))
                root = {d: x if r == y else r for d, r in root.items()}
    assert 300 < near < 1200
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root.values()))

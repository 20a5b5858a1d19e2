"""Toxicity: a linear classifier trained with a counterfactual penalty on identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, mapped

WORD = re.compile(r"\w+")
#: Identity terms by kind; terms of one kind replace each other in counterfactuals.
IDENTITY = {
    "gender": "woman man women men girl boy female male transgender frau mann femme homme mujer hombre".split(),
    "faith": "muslim christian jewish hindu buddhist atheist muslime christ jude musulman chrétien juif musulmán cristiano judío".split(),
    "origin": "african asian european american mexican arab turkish german french spanish afrikaner asiate araber africain asiatique arabe africano asiático árabe".split(),
    "orientation": "gay lesbian straight bisexual heterosexual homosexual schwul lesbisch lesbienne gais lesbiana".split(),
    "ability": "blind deaf disabled autistic behindert taub aveugle sourd ciego sordo".split(),
}
KIND_OF = {term: kind for kind, terms in IDENTITY.items() for term in terms}
#: Bounds of the labelled sample the classifier is fitted on, of its features, and their rarity.
SAMPLE_PER_CLASS, FEATURES, LEAST_DOCS = 3000, 3000, 3
#: Lengths of the word beginnings that count as features beside whole words.
STEMS = (3, 4, 5, 6)
L2, COUNTERFACTUAL, STEPS = 1e-4, 1.0, 400


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> set[int]:
    """Hashes of the word itself and of its beginnings."""
    return {xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), k) >> 1 for k, x in [(0, word), *((n, word[:n]) for n in STEMS if len(word) >= n)]}


def swapped(words: set[str]) -> tuple[set[str], set[str]]:
    """The words that a counterfactual takes out and puts in: each identity term gives way to the
    next of its kind; a text without any gets one term of each kind, as a neutral mention."""
    out = {w for w in words if w in KIND_OF}
    if not out:
        return set(), {IDENTITY[kind][(len(words) + i) % len(IDENTITY[kind])] for i, kind in enumerate(IDENTITY)}
    into = set()
    for w in out:
        terms = IDENTITY[KIND_OF[w]]
        into.add(next((t for k in range(1, len(terms)) if (t := terms[(terms.index(w) + k) % len(terms)]) not in out), w))
    return out - into, into - words


class Model:
    """Weights by feature hash, and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-self.margin(words_of(text)))))

    def margin(self, words: set[str]) -> float:
        found: set[int] = set()
        for w in words:
            own = self.known.get(w)
            if own is None:
                if len(self.known) > 300_000:
                    self.known.clear()
                own = self.known[w] = tuple(f for f in features_of(w) if f in self.weights)
            if own:
                found.update(own)
        return max(-30.0, min(30.0, self.bias + sum(self.weights[f] for f in sorted(found))))


def fit(rows: pa.Table) -> Model:
    """Columns of rows: toxic, own, less, more, gone: the label, features of the text, features that the swap removes and adds, and features
    that go if the identity terms just go. Both changes to a text should leave its score alone."""
    labels = rows["toxic"].to_numpy().astype(np.float64)
    lists = {c: rows[c].combine_chunks() for c in ("own", "less", "more", "gone")}
    flat = {c: x.flatten().to_numpy() for c, x in lists.items()}
    owners = {c: np.repeat(np.arange(len(rows)), np.diff(x.offsets.to_numpy())) for c, x in lists.items()}
    if not len(rows) or labels.min() == labels.max():
        return Model({}, 0.0 if not len(rows) else 4.0 * (2 * labels[0] - 1))
    ids, where = np.unique(flat["own"], return_inverse=True)
    owner = owners["own"]
    toxic = np.bincount(where, labels[owner], len(ids))
    total = np.bincount(where, minlength=len(ids))
    gap = np.abs(toxic / labels.sum() - (total - toxic) / (len(rows) - labels.sum()))
    best = np.argsort(-np.where(total >= LEAST_DOCS, gap, -1), kind="stable")[:FEATURES]
    named = np.array(sorted({f for w in KIND_OF for f in features_of(w)}))
    chosen = np.union1d(ids[best[total[best] >= LEAST_DOCS]], named)
    x, d = np.zeros((len(rows), len(chosen)), np.float32), np.zeros((2 * len(rows), len(named)), np.float32)
    for matrix, column, names, value, below in ((x, "own", chosen, 1, 0), (d, "less", named, -1, 0), (d, "more", named, 1, 0), (d, "gone", named, -1, len(rows))):
        place = np.minimum(np.searchsorted(names, flat[column]), len(names) - 1)
        known = names[place] == flat[column]
        matrix[below + owners[column][known], place[known]] = value
    pick = np.searchsorted(chosen, named)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(rows) - labels.sum()))
    w = v = np.zeros(len(chosen) + 1)
    step = 4.0 / (float((weight @ x.sum(1)) + 1) + 4 * COUNTERFACTUAL * max(1.0, float((d**2).sum(1).mean())) * 2)
    for k in range(STEPS):  # accelerated gradient descent
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1].astype(np.float32) + v[-1], -30, 30)))
        e = weight * (p - labels)
        g = np.append(x.T @ e.astype(np.float32) + L2 * v[:-1], e.sum())
        np.add.at(g, pick, 2 * COUNTERFACTUAL * (d.T @ (d @ v[pick].astype(np.float32))) / len(rows))
        w, old = v - step * g, w
        v = w + k / (k + 3) * (w - old)
    return Model({int(f): float(v) for f, v in zip(chosen, w[:-1], strict=True) if v}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most `per_class` labelled texts of each class, taken by hash of doc_id, outside
    the held-out fold (crc32 of doc_id mod 5 = 0). A doc_id with several labels counts as toxic if
    one is; null labels are left out; without both classes the score is constant."""
    label = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [label.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # 2 * per_class ids

    def example(doc_id: int, text: str | None, toxic: int) -> tuple:
        words = words_of(text)
        out, into = swapped(words)
        own = {f for w in words for f in features_of(w)}
        kept = {f for w in words - out for f in features_of(w)}
        after = kept | {f for w in into for f in features_of(w)}
        return doc_id, toxic, sorted(own), sorted(own - after), sorted(after - own), sorted(own - kept)

    rows = mapped(texts, example, "doc_id long, toxic int, own array<long>, less array<long>, more array<long>, gone array<long>")
    return fit(rows.toArrow().sort_by("doc_id"))


def scored(docs: DataFrame, model: Model, *, column: str = "text") -> DataFrame:
    """`docs` with the columns score and predicted, which take the place of such columns in `docs`; null
    and empty texts get the score of no words, equal texts equal scores, an empty table no rows."""
    target = arrow_schema(docs.sparkSession, "score double, predicted int")
    names = [c for c in docs.columns if c not in target.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t) for t in batch.column(column).to_pylist()]
            arrays = [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], names=[*names, *target.names])

    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document. Null, empty and very long texts, repeated rows, null and repeated
    labels, one class only, empty tables, further columns: see `train` and `scored`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")

"""Quality rules: fixed base rules, and fences taken from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, arrow_schema, small_enough, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Significant bits of a sketch's buckets: a bucket is at most 1/32 of its value wide.
SIGNIFICANT = 6
#: Texts for which a language's quartiles count in those of its sources, and those of all in a language's.
WEIGHT = 100
#: Fence: upper quartile + REACH * max(interquartile range, floor); floors by measure, in its unit. In a
#: group without any, a fifth of repeated words or duplicate lines is over the fence, and 2 % of symbols.
REACH = 4
#: Millionths, but word_length in thousandths.
FLOORS = {"symbols": 5_000, "dup_lines": 50_000, "repeats": 50_000, "word_length": 500}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def repeated(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    step = 1
    while step < size:  # ranks of ever longer windows, exact
        pair = rank[:-step] * len(words) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        if rank.max() + 1 == len(pair):
            return 0
        step *= 2
    counts = np.bincount(rank)
    start = np.flatnonzero(counts[rank] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at just these six
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated(words)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` and the counts of its text, which are named with two underscores in front."""
    target = arrow_schema(docs.sparkSession, COUNTS)
    names = [f"__{n}" for n in target.names]
    schema = docs.select(*keep).schema
    for n in names:
        schema = schema.add(n, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column("__text")]
            arrays = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *names])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))


def measures() -> dict[str, Column]:
    """Whole numbers, so that sums, buckets and fences are the same on every run."""
    parts = {"symbols": (1_000_000, "__n_symbols", "__word_chars"), "dup_lines": (1_000_000, "__n_dup_lines", "__n_lines"), "repeats": (1_000_000, "__n_repeat_words", "__n_words"), "word_length": (1000, "__word_chars", "__n_words")}
    return {k: F.expr(f"coalesce({unit} * {a} div nullif({b}, 0), 0L)") for k, (unit, a, b) in parts.items()}


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket: the value cut to SIGNIFICANT leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - SIGNIFICANT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by lang, source, measure and bucket of the texts that pass the base rules; sketches
    merge by adding counts."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures().items())))
    passed = rows.where(~base_failed()).select("lang", "source", pairs.alias("p"))
    return passed.groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Quarter points of each measure, for each value of `by`, and the number of texts."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")  # a sketch has some hundreds of buckets, at any number of texts
    summed = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 3)]
    return summed.groupBy(*by, "measure").agg(*at, F.max("total").alias("total"))


def fences(rows: DataFrame) -> DataFrame:
    """lang, source and the highest allowed value of each measure: __max_<measure>. A group's quartiles
    are blended with its language's, and these with those of all texts, so a small group has little
    say of its own and there is no size at which the rule changes."""
    sketch = written(sketches(rows), "sketch")
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.struct("q1", "q3", "total").alias("of_lang"))
    every = quartiles(sketch, []).select(F.col("measure").alias("e"), F.struct("q1", "q3").alias("of_all"))
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["measure"] == lang["m"])).join(F.broadcast(every), F.col("measure") == F.col("e"))  # one row a measure
    blend = lambda n, q, wide: F.expr(f"({n} * {q} + {WEIGHT} * {wide}) div ({n} + {WEIGHT})")
    joined = joined.withColumns({f"w{k}": blend("of_lang.total", f"of_lang.q{k}", f"of_all.q{k}") for k in (1, 3)})
    q = F.struct(*(blend("total", f"q{k}", f"w{k}").alias(f"q{k}") for k in (1, 3)))
    floor = F.create_map(*(F.lit(x) for kv in FLOORS.items() for x in kv))[F.col("measure")]
    fence = joined.select("lang", "source", "measure", q.alias("q")).withColumn("top", F.col("q.q3") + REACH * F.greatest(F.col("q.q3") - F.col("q.q1"), floor))
    return fence.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == k, F.col("top"))).alias(f"__max_{k}") for k in FLOORS))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` with __kept: rows that pass the base rules and no measure of which is over the fence."""
    side = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    if small_enough(side, F.lit(96) + F.coalesce(F.length("__lang"), F.lit(0)) + F.coalesce(F.length("__source"), F.lit(0))):
        side = F.broadcast(side)
    joined = rows.join(side, rows["lang"].eqNullSafe(F.col("__lang")) & rows["source"].eqNullSafe(F.col("__source")), "left")
    within = [F.coalesce(v <= F.col(f"__max_{k}"), F.lit(True)) for k, v in measures().items()]
    return joined.withColumn("__kept", ~base_failed() & within[0] & within[1] & within[2] & within[3])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row.

    Null texts have no words and fail; null languages and sources are groups of their own; rows
    that repeat are judged alike; a table without a passing text has no fences and keeps none; an
    empty table gives no rows; texts count whole; other columns don't matter.
    """
    rows = written(measured(docs, ["doc_id", "lang", "source"]), "measures")
    out = judged(rows, written(fences(rows), "fences"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *(F.col(f"__{n}").alias(n) for n in names), base_failed().alias("base_failed"), F.col("__kept").alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their columns. Texts are counted once for the
    sketches and once more for the verdict, which spares a shuffle of all texts."""
    limits = written(fences(measured(docs, ["lang", "source"])), "fences")
    return judged(measured(docs, docs.columns), limits).where("__kept").select(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Null, empty and very long texts, null groups, repeated rows,
    empty tables, further columns: see `quality`."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _bucket_sql(v: str) -> str:
    return f"(({v}) >> greatest(length(bin({v})) - {SIGNIFICANT}, 0)) << greatest(length(bin({v})) - {SIGNIFICANT}, 0)"


def _quartile_sql(name: str, by: str) -> str:
    on = f"partition by {by}measure"
    return f"""{name} as (select {by}measure, min(bucket) filter (where upto * 4 >= total) as q1, min(bucket) filter (where upto * 4 >= total * 3) as q3, max(total) as total
  from (select {by}measure, bucket, sum(n) over ({on} order by bucket) as upto, sum(n) over ({on}) as total
    from (select {by}measure, bucket, sum(n) as n from sketch group by all)) group by all)"""


_MEASURE_SQL = {"symbols": "1000000 * n_symbols // nullif(word_chars, 0)", "dup_lines": "1000000 * n_dup_lines // nullif(n_lines, 0)", "repeats": "1000000 * n_repeat_words // nullif(n_words, 0)", "word_length": "1000 * word_chars // nullif(n_words, 0)"}
ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
words as (select r, unnest(ws) as w, unnest(range(len(ws))) as i, len(ws) as n from (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)),
grams as (select r, i, n, lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o || ' ' || lead(w, 5) over o || ' ' || lead(w, 6) over o || ' ' || lead(w, 7) over o as g7, w || ' ' as g1
  from words window o as (partition by r order by i)),
twice as (select r, i, n, g7 is not null and count(*) over (partition by r, g1 || g7) > 1 as hit from grams),
covered as (select r, count(*) filter (where c) as n_repeat_words from (select r, bool_or(hit) over (partition by r order by i rows between 7 preceding and current row) as c from twice) group by r),
lines as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
m0 as (select d.doc_id, lang, source, cast(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join covered using (r) left join lines using (r)),
m as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {", ".join(f"cast(coalesce({v}, 0) as bigint) as m_{k}" for k, v in _MEASURE_SQL.items())} from m0),
long as ({" union all ".join(f"select lang, source, '{k}' as measure, {_bucket_sql(f'm_{k}')} as bucket from m where not base_failed" for k in FLOORS)}),
sketch as (select lang, source, measure, bucket, count(*) as n from long group by all),
{_quartile_sql("own", "lang, source, ")}, {_quartile_sql("bylang", "lang, ")}, {_quartile_sql("every", "")},
wide as (select l.lang, l.measure, (l.total * l.q1 + {WEIGHT} * e.q1) // (l.total + {WEIGHT}) as q1, (l.total * l.q3 + {WEIGHT} * e.q3) // (l.total + {WEIGHT}) as q3 from bylang l join every e on l.measure = e.measure),
pick as (select o.lang, o.source, o.measure, (o.total * o.q1 + {WEIGHT} * l.q1) // (o.total + {WEIGHT}) as q1, (o.total * o.q3 + {WEIGHT} * l.q3) // (o.total + {WEIGHT}) as q3
  from own o join wide l on o.lang is not distinct from l.lang and o.measure = l.measure),
fence as (select lang, source, {", ".join(f"max(q3 + {REACH} * greatest(q3 - q1, {v})) filter (where measure = '{k}') as f_{k}" for k, v in FLOORS.items())} from pick group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(f"coalesce(m_{k} <= f_{k}, true)" for k in FLOORS)} as kept
from m left join fence f on m.lang is not distinct from f.lang and m.source is not distinct from f.source
"""

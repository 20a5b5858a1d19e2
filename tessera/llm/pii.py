"""Personal data: pattern spans, and terms that disclose a protected entity by co-occurrence.

Entities are met by value, and emails by their domain as well. A term that tells too much of an entity of its text
is generalised to its beginning if that is told by enough other words, and otherwise removed.
Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, small_enough, written

#: The kinds in their order. Each pattern finds what the plain one finds leftmost, one after the
#: other: a match starts where a run starts or the last match ended (\G), and runs are possessive,
#: so long runs cost no retries and no stack. A card starts where no digits lead up to it, and shorter chains, which fail
#: anyway, aren't matched.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}+"
#: A term of at least LETTERS letters is sanitised beside an entity if it was met with it in
#: SUPPORT texts or more and tells at least SHARE of the entity's information.
LETTERS, SUPPORT, SHARE = 3, 3, 0.9
#: Texts are near copies if they agree in all ROWS least hashes of one of BANDS bands, over triples
#: of words: at a similarity of 0.8 all but one pair in 2000, at 0.3 one in 140.
BANDS, ROWS = 32, 7

SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
#: Matches that are summed up one after another.
STRETCH = 128


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches as spans: the pieces between matches give their places in code points. They are
    summed in stretches of STRETCH and the stretches one after another, so many matches cost no
    more than a little each."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(pieces.alias("0"), hits.alias("1"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["0"])
        e = s + F.length(x["1"])
        span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["1"].alias("v"))
        return F.when(x["1"].isNull(), a).otherwise(F.struct(e.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    def moved(x: Column, by: Column) -> Column:
        return F.struct((x["s"] + by).alias("s"), x["k"].alias("k"), (x["e"] + by).alias("e"), x["v"].alias("v"))

    def after(a: Column, x: Column) -> Column:
        own = F.transform(x["out"], lambda y: moved(y, a["at"]))
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(own)).alias("out"))

    stretch = lambda k: F.aggregate(F.slice(both, k * STRETCH + 1, F.lit(STRETCH)), F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STRETCH).cast("int")), stretch)
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), after, lambda a: F.flatten(a["out"]))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right counts twice, with the sum of its own digits."""
    places = F.sequence(F.lit(1), F.length(number))
    at = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(places, F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(x)).between(14, 19) & F.when(F.length(digits(x)) <= 19, luhn(digits(x)))
    if kind == "phone":
        return F.length(digits(x)).between(10, 15)
    return F.lit(True)


def _passing(kind: str, x: Column) -> Column:
    return passes(kind, x["v"])


def _of(k: int, x: Column) -> Column:
    return x["k"] == k


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, ordered by start, then kind."""
    none = F.array().cast(SPAN)
    lists = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike(r"[0-9]\.[0-9]++\.[0-9]" if kind == "ip" else "[0-9]")
        lists.append(F.when(hint, F.filter(found(text, pattern, k), partial(_passing, kind))).otherwise(none))
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*lists))).otherwise(none)


def masked(text: Column) -> Column:
    """The text with blanks for the addresses in it, at equal length; other kinds hold no letters."""
    pieces, hits = F.split(text, PATTERNS["email"], -1), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    blank = F.transform(F.arrays_zip(pieces.alias("0"), hits.alias("1")), lambda x: F.concat(x["0"], F.rpad(F.lit(""), F.coalesce(F.length(x["1"]), F.lit(0)), " ")))
    return F.when(text.contains("@"), F.array_join(blank, "")).otherwise(text)


def text_key() -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64("__text").alias("__h1"), F.hash("__text", F.length("__text")).alias("__h2")]


def terms_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))), lambda w: F.length(w) >= LETTERS)


def triples(text: Column) -> Column:
    """A hash of each three words in a row, without the entities; the last ones are of fewer words."""
    words = F.regexp_extract_all(F.lower(masked(text)), F.lit(TERM), F.lit(0))
    return F.transform(F.arrays_zip(words, F.slice(words, 2, 1 << 30), F.slice(words, 3, 1 << 30)), lambda x: F.xxhash64(x))


def bands(hashes: Column) -> Column:
    """A number for each band of least hashes; texts without words have equal ones."""
    places = lambda b: F.sequence(b * ROWS, b * ROWS + ROWS - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.transform(places(b), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))))


def entities_of(x: Column) -> Column:
    """The entities that a span stands for: its value, and of an email the domain as well. What other
    kinds share (a network, an issuer, an area) names nobody."""
    value = F.concat(x["k"].cast("string"), F.lit(":"), F.lower(x["v"]))
    domain = F.concat(F.lit("@"), F.substring_index(F.lower(x["v"]), "@", -1))
    return F.when(x["k"] == KINDS.index("email"), F.array(value, domain)).otherwise(F.array(value))


def supported(protected: DataFrame, entities: DataFrame, support: int) -> DataFrame:
    """The rows of `entities` (__h1, __h2, entity) whose entity stands in `support` texts or more, near
    copies among them counted once; `one` is the same for texts of an entity that are near copies."""
    often = entities.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("entity")
    met = written(entities.join(often, "entity").withColumn("node", F.xxhash64("entity", "__h1", "__h2")), "met")
    hashes = protected.join(met.select("__h1", "__h2").distinct(), ["__h1", "__h2"]).select("__h1", "__h2", triples(F.col("__text")).alias("hashes"))
    # written, so that no lambda takes the triples anew; in many parts, since the bands are the costly step
    parts = int(protected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = written(hashes.repartition(parts, "__h1"), "triples").select("__h1", "__h2", bands(F.col("hashes")).alias("bands"))
    rows = written(keys, "bands").select("__h1", "__h2", F.posexplode("bands").alias("part", "key")).join(met, ["__h1", "__h2"]).select("entity", "part", "key", "node")
    least = rows.groupBy("entity", "part", "key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = connected_components(rows.join(least, ["entity", "part", "key"]).select(F.col("node").alias("a"), "b"))
    known = written(met.join(copies, "node", "left").select("__h1", "__h2", "entity", F.coalesce("root", "node").alias("one")), "known")
    counted = known.groupBy("entity").agg(F.count_distinct("one").alias("n")).where(F.col("n") >= support)
    return known.join(counted.select("entity"), "entity").select("__h1", "__h2", "entity", "one")


def counted(texts: DataFrame, wanted: DataFrame, found: Callable[[Column], Column], name: str) -> DataFrame:
    """How many different texts hold each of `wanted` (a column `name`), by what `found` takes from a text.
    Where `wanted` is small, only what it names is shuffled."""
    side = F.broadcast(wanted) if small_enough(wanted, F.length(name) * 4 + 16) else wanted
    each = texts.select(*text_key(), F.explode(found(masked(F.col("__text")))).alias(name)).join(side, name, "left_semi")
    return each.distinct().groupBy(name).agg(F.count("*").alias(f"n_{name}"))


def beginnings(text: Column) -> Column:
    return F.array_distinct(F.transform(terms_of(text), lambda w: F.substring(w, 1, LETTERS)))


def disclosing(texts: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame | None:
    """(__h1, __h2, terms): for each text with a protected entity, the terms that disclose one of
    its entities, each with what stands for it; None if no entity is met often enough to tell.

    Corpus statistics count all different texts. Entity e has the information ln(N / n_e); term t
    tells ln(N n_te / (n_t n_e)) of it, and discloses it from `share` of the information on. Near
    copies among an entity's texts count once, n_te from `support` on, wherever e and t stand
    in them. The first letters of a term stand for it unless they as well disclose
    the entity; then TERM does. `texts` has __text.
    """
    protected = texts.select(*text_key(), "__text", base_spans(F.col("__text")).alias("__spans")).where("size(__spans) > 0")
    protected = written(protected.dropDuplicates(["__h1", "__h2"]), "protected")
    each = protected.select("__h1", "__h2", F.explode(F.flatten(F.transform("__spans", entities_of))).alias("entity"))
    chosen = written(supported(protected, written(each.distinct(), "entities"), support), "entities")
    if chosen.isEmpty():
        return None
    total = texts.select(*text_key()).distinct().count()
    n_e = chosen.groupBy("entity").agg(F.count_distinct("one").alias("n_e"), F.count("*").alias("texts")).where(F.col("n_e") < total)
    # a pair needs n_t - raw + n_te <= n_te (N / n_e) ** (1 - share); protected texts alone show that most terms are met too often
    room = f"1.000001 * pow({total} / cast(n_e as double), 1 - {share})"
    marked = chosen.join(n_e.select("entity", "n_e", F.expr(f"texts + ({room} - 1) * n_e").alias("most")), "entity")
    words = written(protected.select("__h1", "__h2", F.explode(terms_of(masked(F.col("__text")))).alias("term")), "terms")
    least = words.groupBy("term").agg(F.count("*").alias("least")).where(F.col("least") >= support)
    held = words.join(least, "term").alias("w").join(marked.alias("m"), F.expr("w.__h1 = m.__h1 and w.__h2 = m.__h2 and w.least <= m.most")).select("w.__h1", "w.__h2", "term", "entity", "one", "n_e", "least")
    held = written(held, "held")
    pairs = held.groupBy("entity", "term", "n_e", "least").agg(F.count_distinct("one").alias("n_te"), F.count("*").alias("raw")).where(F.col("n_te") >= support)
    pairs = written(pairs.where(f"least - raw + n_te <= n_te * {room}").drop("least"), "pairs")
    if pairs.isEmpty():
        return None
    tells = f"ln({total} * cast({{0}} as double) / ({{1}} - raw + {{0}}) / n_e) >= {share} * ln({total} / cast(n_e as double))"
    n_t = counted(texts, pairs.select("term").distinct(), terms_of, "term")
    told = written(pairs.join(n_t, "term").where(tells.format("n_te", "n_term")).select("entity", "term", "n_e", F.substring("term", 1, LETTERS).alias("start")), "told")
    if told.isEmpty():
        return None
    starts = told.select("entity", "start").distinct()
    # only the words of texts with a told entity are looked at
    theirs = written(chosen.join(starts.select("entity").distinct(), "entity", "left_semi"), "theirs")
    begun = words.join(theirs.select("__h1", "__h2").distinct(), ["__h1", "__h2"], "left_semi").select("__h1", "__h2", F.substring("term", 1, LETTERS).alias("start")).distinct()
    mine = begun.join(theirs, ["__h1", "__h2"]).join(starts, ["entity", "start"])
    n_se = mine.groupBy("entity", "start").agg(F.count_distinct("one").alias("n_se"), F.count("*").alias("raw"))
    n_s = counted(texts, told.select("start").distinct(), beginnings, "start")
    shown = told.join(n_se, ["entity", "start"]).join(n_s, "start").select("entity", "term", F.expr(tells.format("n_se", "n_start")).alias("closed"))
    hits = held.join(shown, ["entity", "term"]).groupBy("__h1", "__h2", "term").agg(F.bool_or("closed").alias("closed"))
    stand = F.when(F.col("closed"), "<TERM>").otherwise(F.concat(F.substring("term", 1, LETTERS), F.lit("*")))
    pair = F.struct("term", stand.alias("shown"))
    return written(hits.groupBy("__h1", "__h2").agg(F.sort_array(F.collect_list(pair)).alias("terms")), "disclosing")  # a text's own terms


def with_spans(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """`columns`, __text, __terms, __base and __all: spans of the base kinds, and with the terms."""
    texts = docs.select(*columns, F.coalesce("text", F.lit("")).alias("__text"))
    told = disclosing(texts.select("__text"))
    spans = texts.withColumn("__base", base_spans(F.col("__text")))
    if told is None:
        return spans.withColumns({"__all": F.col("__base"), "__terms": F.lit(None).cast("array<struct<term:string,shown:string>>")})
    side = told.withColumnsRenamed({"__h1": "__k1", "__h2": "__k2", "terms": "__terms"})
    if small_enough(side, F.size("__terms") * 64 + 32):
        side = F.broadcast(side)
    h1, h2 = text_key()
    keyed = spans.select("*", h1, h2)
    joined = keyed.join(side, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left")
    kind = KINDS.index("term")
    words = F.filter(found(masked(F.col("__text")), TERM, kind), lambda x: F.array_contains(F.transform("__terms", lambda t: t["term"]), F.lower(x["v"])))
    every = F.when(F.col("__terms").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", words)))
    return joined.withColumn("__all", every).drop("__h1", "__h2", "__k1", "__k2")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, base_sha256 and spans of every row; null counts as empty,
    equal rows give equal results; an empty table gives none; other columns don't matter."""
    rows = with_spans(docs, [F.col("doc_id")])
    counts = [F.size(F.filter("__base", partial(_of, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__all")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with a name of its kind, like <EMAIL>, for each span, and for a term its first letters or
    <TERM>: a span that begins inside an earlier one goes with it. n_chars, if there, follows the text;
    null texts stay null; an empty table stays one."""
    rows = with_spans(docs, [F.col(c) for c in docs.columns])
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,v:string>>").alias("out"))

    def outer(a: Column, x: Column) -> Column:
        more = F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(x)).alias("out"))
        wider = F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.transform(a["out"], lambda y, k: F.when(k == F.size(a["out"]) - 1, F.struct(y["s"].alias("s"), y["k"].alias("k"), F.greatest(y["e"], x["e"]).alias("e"), y["v"].alias("v"))).otherwise(y)).alias("out"))
        return F.when(x["s"] >= a["at"], more).otherwise(wider)

    def shown(x: Column) -> Column:
        term = F.get(F.filter("__terms", lambda t: t["term"] == F.lower(x["v"])), F.lit(0))["shown"]
        return F.when(x["k"] == KINDS.index("term"), term).otherwise(F.element_at(name, x["k"] + 1))

    cuts = F.aggregate("__all", start, outer, lambda a: a["out"])
    ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["e"]))
    gaps = F.transform(F.arrays_zip(ends.alias("a"), cuts.alias("x")), lambda y: F.concat(F.substring("__text", y["a"] + 1, F.coalesce(y["x"]["s"], F.length("__text")) - y["a"]), F.when(y["x"].isNull(), "").otherwise(shown(y["x"]))))
    text = F.when(F.size("__all") == 0, F.col("text")).otherwise(F.array_join(gaps, ""))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__all") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of every document. Null, empty and very long texts, repeated rows, empty tables,
    further columns: see `spans`."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

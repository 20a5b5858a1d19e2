"""URL rules, with block decisions that spread over redirects and canonical links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, small_enough, written

#: (verdict, host, path) of the rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link or meta tag, and its attributes; possessive, so long tags cost no stack.
TAG = r"""(?i)<(?:link|meta)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""[^\s=/"'<>]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
#: What hides tags from a reader.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\b|\z)"
#: Character references of the characters that matter in an address, & last.
REFERENCES = {"/": ("&#47;", "&#x2f;", "&#x2F;", "&sol;"), ":": ("&#58;", "&#x3a;", "&#x3A;", "&colon;"), '"': ("&quot;", "&#34;"), "'": ("&#39;", "&apos;"), "<": ("&lt;",), ">": ("&gt;",), "&": ("&#38;", "&#x26;", "&amp;")}


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in longest]
    pairs = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in longest]
    return reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), reversed(list(zip(fits, pairs, strict=True))), F.lit(None))


def lowered(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, without quotes; null if there is none."""
    named = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda x: lowered(F.regexp_extract(x, r"\A([^\s=]+)", 1)) == name)
    value = F.regexp_replace(F.get(named, F.lit(0)), r"\A[^=]*=\s*", "")
    return F.regexp_replace(value, r"""(?s)\A(["'])(.*)\1\z""", "$2")


def decoded(x: Column) -> Column:
    """Character references of REFERENCES give way to their characters."""
    for plain, names in REFERENCES.items():
        for name in names:
            x = F.replace(x, F.lit(name), F.lit(plain))
    return x


def node_of(url: Column) -> Column:
    """One form for an address: scheme and host in lower case, / for an empty path, no fragment;
    null without ://."""
    scheme, query = F.regexp_extract(url, r"(?s)\A(.*?)://", 1), F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    path = path_of(url)
    return F.when(url.contains("://"), F.concat(lowered(scheme), F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query))


def dotless(path: Column) -> Column:
    """The path without . and .. segments."""
    parts, none = F.split(path, "/"), F.array().cast("array<string>")
    whole = F.concat(parts, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))  # a directory keeps its slash
    kept = F.aggregate(F.slice(whole, F.lit(2), F.size(whole)), none, lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(target: Column, url: Column) -> Column:
    """The node that a link on the page `url` names, absolute or relative; null if it is no address
    of the form scheme://."""
    target = F.regexp_replace(target, r"\A[\x00-\x20]+|[\x00-\x20]+\z|(?s)#.*", "")
    scheme, origin, path = F.regexp_extract(url, r"(?s)\A(.*?)://", 1), F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)\A(.*/)", 1))
    whole = (
        F.when(target == "", None)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(origin, folder, target))
    )
    clean = node_of(whole)
    head, tail = F.regexp_extract(clean, r"(?s)\A(.*?://[^/?#]*)", 1), F.regexp_extract(clean, r"(?s)\A[^?]*(.*)", 1)
    return F.when(path_of(clean).rlike(r"/\.\.?(?:/|\z)"), F.concat(head, dotless(path_of(clean)), tail)).otherwise(clean)


def targets(html: Column) -> Column:
    """The targets of all canonical links and refreshes of a page, as written."""
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(TAG), F.lit(0))
    canonical = lambda x: attribute(x, "rel").rlike(r"(?i)(?:\A|\s)canonical(?:\s|\z)")
    refresh = lambda x: F.trim(attribute(x, "http-equiv")).rlike(r"(?i)\Arefresh\z")
    place = lambda x: F.regexp_extract(decoded(attribute(x, "content")), r"""(?is)\A\s*[0-9.]*[\s;,]*(?:url\s*=\s*)?["']?([^"']*)""", 1)
    link = lambda x: x.rlike("(?i)^<link")
    return F.transform(F.filter(tags, lambda x: F.coalesce(F.when(link(x), canonical(x)).otherwise(refresh(x)), F.lit(False))), lambda x: F.when(link(x), decoded(attribute(x, "href"))).otherwise(place(x)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the node of a page's own address and one that a canonical link or a refresh names."""
    some = pages.where("html is not null and url like '%://%'").where(F.col("html").rlike("(?i)canonical|refresh"))
    links = some.select("url", F.explode(targets(F.col("html"))).alias("target"))
    return links.select(node_of(F.col("url")).alias("a"), resolved(F.col("target"), F.col("url")).alias("b")).where("b is not null and a <> b")


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of `pages` (page_id, url, html).

    A rule that fits decides alone. Other pages take the decision of their component over redirect
    and canonical edges: block if a member is blocked by a rule and none is allowed by one (an
    explicit allow wins), else allow. Null addresses and those without :// have empty parts, no
    rule and no aliases; repeated addresses are one node, and so are those that differ in the case
    of scheme and host or in the fragment; nothing is dropped; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("own", ruled(F.col("host"), F.col("path"), rules))
    edges = written(alias_edges(pages), "aliases")
    if edges.isEmpty():
        return rows.select("page_id", "url", "host", "path", "own.rule", F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    members = connected_components(edges)
    rule = ruled(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    spread = members.groupBy("root").agg(F.bool_or(rule == "block").alias("blocked"), F.bool_or(rule == "allow").alias("allowed")).where("blocked and not coalesce(allowed, false)")
    # only nodes of blocked components come back, each once, so no row of pages multiplies
    blocked = written(members.join(spread.select("root"), "root").select(F.col("node").alias("__at"), F.lit("block").alias("spread")), "blocked")
    side = F.broadcast(blocked) if small_enough(blocked, F.length("__at") + 32) else blocked
    key = F.coalesce(node_of(F.col("url")), F.xxhash64("page_id").cast("string"))  # rows without a node don't meet in one task
    return rows.join(side, key == F.col("__at"), "left").select("page_id", "url", "host", "path", "own.rule", F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url. Null urls and html, long ones, repeated rows and further
    columns: see `filtered`."""
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


_HOST = "coalesce(translate(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
_PARTS = f"select page_id, url, {_HOST.format('url')} as host, {_PATH.format('url')} as path from {{0}}"
_RULED = """case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end"""


def _node_sql(url: str) -> str:
    scheme = f"translate(regexp_extract({url}, '^((?s:.*?))://', 1), '{UPPER}', '{LOWER}')"
    return f"case when contains({url}, '://') then {scheme} || '://' || {_HOST.format(url)} || case when {_PATH.format(url)} = '' then '/' else {_PATH.format(url)} end || regexp_extract({url}, '^(?s:.*?)://[^/?#]*[^?#]*(\\?[^#]*)?', 1) end"


def _attribute_sql(name: str) -> str:
    pattern = ATTRIBUTE.replace("'", "''")
    value = rf"regexp_replace(list_filter(regexp_extract_all(tag, '{pattern}'), lambda x: regexp_matches(x, '(?i)^{name}\s*='))[1], '^[^=]*=\s*', '')"
    return rf"""(case when left({value}, 1) in ('"', '''') then {value}[2:-2] else {value} end)"""


def _decoded_sql(x: str) -> str:
    for plain, names in REFERENCES.items():
        for name in names:
            x = "replace({0}, '{1}', '{2}')".format(x, name, plain.replace("'", "''"))
    return x


def _plain_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$|(?s:#.*)', '', 'g')"


_TAG_SQL = TAG.replace("'", "''").replace("++", "+").replace("*+", "*").replace(r"(?=[\s/>])", r"\b")
_HIDDEN_SQL = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{x}\b.*?(?:</{x}\b|$)" for x in ("script", "style", "textarea", "title"))
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
ORACLE_SQL = rf"""
with recursive tags as (
  select url, unnest(regexp_extract_all(regexp_replace(html, '{_HIDDEN_SQL}', '', 'g'), '{_TAG_SQL}')) as tag from pages where url like '%://%'),
links as (
  select url as a, case when regexp_matches(tag, '(?i)^<link') then case when regexp_matches({_attribute_sql("rel")}, '(?i)(?:^|\s)canonical(?:\s|$)') then {_decoded_sql(_attribute_sql("href"))} end
    when regexp_matches(trim({_attribute_sql("http-equiv")}), '(?i)^refresh$') then regexp_extract({_decoded_sql(_attribute_sql("content"))}, '(?is)^\s*[0-9.]*[\s;,]*(?:url\s*=\s*)?["'']?([^"'']*)', 1) end as t from tags),
plain as (select a, {_plain_sql("t")} as t, regexp_extract(a, '^((?s:.*?))://', 1) as scheme, regexp_extract(a, '^(?s:.*?)://[^/?#]*') as origin, {_PATH.format("a")} as path from links where t is not null),
whole as (
  select a, case when t = '' then null when regexp_matches(t, '^{_SCHEME}') then case when regexp_matches(t, '^{_SCHEME}//') then t end
    when starts_with(t, '//') then scheme || ':' || t when starts_with(t, '?') then origin || case when path = '' then '/' else path end || t
    when starts_with(t, '/') then origin || t
    else origin || case when path = '' then '/' else regexp_extract(path, '^(?s:.*/)') end || t end as b from plain),
nodes as (select {_node_sql("a")} as a, {_node_sql("b")} as b from whole where b is not null),
split as (select a, regexp_extract(b, '^(?s:.*?)://[^/?#]*') as head, string_split({_PATH.format("b")}, '/') as parts, regexp_extract(b, '^[^?]*((?s:.*))', 1) as tail from nodes),
edges as (
  select distinct a, b from (select a, head || '/' || array_to_string(list_reduce(list_prepend(cast([] as varchar[]), list_transform((case when parts[-1] in ('.', '..') then list_append(parts, '') else parts end)[2:], lambda x: [x])),
    lambda acc, x: case when x[1] = '.' then acc when x[1] = '..' then acc[:greatest(len(acc) - 1, 0)] else list_concat(acc, x) end), '/') || tail as b from split) where a <> b),
reach as (
  select a as x, a as y from edges union select b, b from edges
  union select r.x, case when e.a = r.y then e.b else e.a end from reach r join edges e on e.a = r.y or e.b = r.y),
seen as (select x, y as url, 0 as page_id from reach),
verdicts as (select p.url as y, {_RULED} as rule from ({_PARTS.format("(select distinct url, 0 as page_id from seen)")}) p),
spread as (select r.x as url from reach r join verdicts v on v.y = r.y group by r.x
  having bool_or(v.rule in ('net/', 'example.com/de/')) and not coalesce(bool_or(v.rule in ('example.net/en/', 'org/fr/')), false)),
own as (select *, {_RULED} as rule from ({_PARTS.format("pages")}))
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when {_node_sql("url")} in (select url from spread) then 'block' else 'allow' end as verdict from own
"""

"""URL filters by redirect equivalence (native: DataFrame expressions only).

A rule decides the urls of its host and all subdomains whose path starts with
the rule's path; the longest rule wins. Pages that name another url as their
canonical form (link rel=canonical) or redirect to it (meta refresh) are linked
with it, and distributed connected components over these links make classes of
aliases. A url that no rule decides takes its class's verdict: allow if a rule
allows a member (an explicit allow has precedence), else block if a rule blocks
one, else allow. A rule's verdict on the url itself always stands.

Defined results: a null url, or one without ://, has an empty host and path, no
rule and no aliases, and is allowed. Repeated rows and null ids are judged row by
row. A null html has no links. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._tables import LOWER, UPPER
from kinfold.operators.graph import connected_components

#: (verdict, host, path), as given for the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """A url's identity among aliases: host, path and query, without scheme and fragment; null where there is no host."""
    return F.when(host(url) != "", F.concat(host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def rule_of(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits the columns host and path, as struct(size, rule, verdict); null if none does.

    The rules are a map from host to (path, verdict), looked up once for each
    dot-separated suffix of the url's host.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, at, start in rules:
        by_host.setdefault(at, []).append((start, verdict))
    entry = lambda at, start, verdict: F.struct(F.lit(len(at + start)).alias("size"), F.lit(at + start).alias("rule"), F.lit(start).alias("start"), F.lit(verdict).alias("verdict"))
    known = F.create_map(*[x for at, some in by_host.items() for x in (F.lit(at), F.array(*[entry(at, *s) for s in some]))])
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: known[s]), lambda x: x.isNotNull())), lambda r: F.col("path").startswith(r["start"]))
    return F.array_max(fitting)


def unescaped(text: Column) -> Column:
    """Numeric character references and the five named ones of XML replaced by what they stand for."""
    known = F.create_map(*[F.lit(x) for x in ("&amp;", "&", "&lt;", "<", "&gt;", ">", "&quot;", '"', "&apos;", "'")])

    def read(piece: Column) -> Column:
        code = F.when(piece.rlike(r"^&#[xX]"), F.conv(F.regexp_extract(piece, r"^&#[xX](.*);$", 1), 16, 10)).otherwise(F.regexp_extract(piece, r"^&#(.*);$", 1)).try_cast("long")
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(piece.startswith("&#") & piece.endswith(";"), F.when(valid, letter).otherwise(piece)).otherwise(F.coalesce(F.try_element_at(known, F.lower(piece)), piece))

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, read), "")).otherwise(text)


def without_dots(of: Column) -> Column:
    """A path that starts with a slash, without its segments . and .. (RFC 3986, 5.2.4)."""
    segments = F.split(of, "/", -1)
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), step)
    last = F.when(of.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(of.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(last, "/"))).otherwise(of)


def resolved(target: Column, base: Column) -> Column:
    """What a target names on the page base, as an absolute url (RFC 3986, 5.2); null for the page itself and for schemes without //."""
    site, at = F.concat(F.lit("http://"), host(base)), path(base)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(at == "", "/").otherwise(F.regexp_extract(at, r"(?s)^(.*/)", 1))
    whole = F.when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(target)
    absolute = F.concat(F.lit("http://"), host(whole), without_dots(path(whole)), F.regexp_extract(whole, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://") | target.startswith("//"), absolute)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | target.startswith("#") | (target == ""), None)
        .when(target.startswith("?"), F.concat(site, at, target))
        .when(target.startswith("/"), F.concat(site, without_dots(own), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's url and what its canonical links and redirects name, as nodes. Relative targets are resolved against the page's url."""
    own = F.col(url)
    marked = F.col(html).rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh")
    targets = F.concat(F.regexp_extract_all(html, F.lit(LINK), 1), F.regexp_extract_all(html, F.lit(REFRESH), 1))
    found = pages.filter(marked & own.isNotNull()).select(own.alias("u"), F.explode(targets).alias("t"))
    # each step an explode, so that the optimizer doesn't write it out wherever its result is used
    found = found.select("u", F.explode(F.array(unescaped(F.col("t")))).alias("t"))
    found = found.select("u", F.explode(F.array(resolved(F.col("t"), F.col("u")))).alias("f"))
    return found.select(node(F.col("u")).alias("a"), node(F.col("f")).alias("b")).filter("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, host, path, rule (null if none), verdict, alias_class (null without links) for every row."""
    own = pages.select(F.col(key), F.col(url).alias("_url")).select(key, host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), node(F.col("_url")).alias("_node")).withColumn("_rule", rule_of(rules))
    edges = links(pages, url, html)
    classes = connected_components(edges, "a", "b").withColumnRenamed("node", "_node").withColumnRenamed("component", "alias_class")
    # verdicts of the members that a rule decides, whether or not the member is itself a row
    decided = (
        classes.withColumn("_u", F.concat(F.lit("x://"), "_node"))
        .select("alias_class", host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"))
        .withColumn("r", rule_of(rules))
        .groupBy("alias_class")
        .agg(F.max((F.col("r.verdict") == "allow").cast("int")).alias("_allowed"), F.max((F.col("r.verdict") == "block").cast("int")).alias("_blocked"))
    )
    inherited = classes.join(decided, "alias_class")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when((F.col("_blocked") == 1) & (F.coalesce("_allowed", F.lit(0)) == 0), "block").otherwise("allow"))
    return own.join(inherited, "_node", "left").select(key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "alias_class")


ORACLE = r"""
with recursive p as (select row_number() over () as i, page_id, coalesce(url, '') as url, html from pages),
-- targets of canonical links and refreshes
tags as (
  select url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) as raw
  from p where url <> '' and html is not null),
-- character references
targets as (
  select url, array_to_string(list_transform(regexp_extract_all(raw, '(?s)&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);|[^&]+|&'), lambda x: case lower(x)
    when '&amp;' then '&' when '&lt;' then '<' when '&gt;' then '>' when '&quot;' then '"' when '&apos;' then ''''
    else case when regexp_matches(x, '(?i)^&#x.*;$') then chr(('0x' || regexp_extract(x, '(?i)^&#x(.*);$', 1))::int) when regexp_matches(x, '^&#[0-9]+;$') then chr(regexp_extract(x, '^&#(.*);$', 1)::int) else x end end), '') as t
  from tags where raw <> ''),
-- what a target names, before dot segments go
parts as (
  select url, t, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) as own_host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as own_path,
    regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') or starts_with(t, '//') as whole, case when starts_with(t, '//') then 'http:' || t else t end as w from targets),
named as (
  select url, case when whole then lower(regexp_extract(w, '(?s)^.*?://([^/?#]*)', 1)) else own_host end as host,
    case when whole then regexp_extract(w, '(?s)^.*?://[^/?#]*([^?#]*)', 1) when starts_with(t, '?') then own_path when starts_with(t, '/') then regexp_extract(t, '(?s)^([^?#]*)', 1)
      else case when own_path = '' then '/' else regexp_extract(own_path, '(?s)^(.*/)', 1) end || regexp_extract(t, '(?s)^([^?#]*)', 1) end as path,
    case when whole then regexp_extract(w, '(?s)^.*?://[^?#]*([^#]*)', 1) else regexp_extract(t, '(?s)^[^?#]*([^#]*)', 1) end as query, starts_with(t, '?') as kept
  from parts where whole or not (regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') or starts_with(t, '#') or t = '')),
plain as (
  select url, host, query, case when kept or not regexp_matches(path, '/\.\.?(/|$)') then path else '/' || array_to_string(list_reduce(
      list_concat([['']], list_transform(list_concat(string_split(path, '/')[2:], case when regexp_matches(path, '/\.\.?$') then [''] else [] end), lambda x: [x])),
      lambda a, x: case when x[1] = '.' then a when x[1] = '..' then (case when len(a) > 1 then a[:-2] else a end) else list_concat(a, x) end)[2:], '/') end as path from named),
links as (
  select lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) as a, host || path || query as b
  from plain where host <> '' and regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) <> ''),
both_ways as (select a, b from links where a <> b union select b, a from links where a <> b),
reach(node, other) as (select a, a from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
seen as (select node, regexp_extract(node, '(?s)^([^/?#]*)', 1) as host, regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) as path from (select distinct node from reach)),
decided as (select node, arg_max(verdict, length(rhost || rpath)) as verdict from seen join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by node),
classes as (select reach.node, bool_or(verdict = 'allow') as allowed, bool_or(verdict = 'block') as blocked from reach left join decided on decided.node = reach.other group by reach.node),
u as (select i, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) as rest from p),
fit as (
  select u.*, rhost || rpath as rule, verdict, row_number() over (partition by i order by length(rhost || rpath) desc nulls last) as k
  from u left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(fit.verdict, case when blocked and not coalesce(allowed, false) then 'block' else 'allow' end) as verdict
from fit left join classes on host <> '' and classes.node = host || rest where k = 1
"""

"""URL verdicts: explicit rules, and block decisions that travel along redirects and canonical links.

Pages name other addresses of themselves: a canonical link, or a refresh that redirects. Addresses joined by such
links are aliases, whatever the case of their hosts and whatever part of a page they point to. An address that a block rule fits blocks its aliases too; an address that an allow rule fits stays
allowed whatever its aliases are. The alias classes are connected components, found over links alone, so pages without
links cost one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, components

#: Verdict, host and path prefix. Fixed values.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: A tag that may hold a link, and an attribute of it (name, value with its quotes). Neither gives back what it has taken, so tags and
#: attributes of any number and length are read in one go.
TAG = r"""<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""([^\s"'<>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
#: What is no markup although it may look so: comments, and the text of scripts and styles; each to its end, or to that of the page.
HIDDEN = r"<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
#: What a refresh leads to: after the seconds, with or without a name and quotes of its own.
REFRESH = r"""(?is)^\s*[^;,\s]*(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|([^"'].*))"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path (from the slash on) of an address; both empty if it is null or names no scheme."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://(?s:(.*))$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ruled(frame: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """frame (with url) and its host, path, rule (host and path of the longest rule that fits, or null) and own verdict.

    Rules are a short list in the plan; of two rules of one length the later in sorted order wins.
    """
    host, path = parts(F.col("url"))
    out = frame.withColumn("host", host).withColumn("path", path)
    rule, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fit = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(start)
        rule, own = F.when(fit, at + start).otherwise(rule), F.when(fit, verdict).otherwise(own)
    return out.withColumn("rule", rule).withColumn("own", own)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, without quotes; null if there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    value = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), F.array_position(names, name).cast("int") - 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def resolved(target: Column, url: Column) -> Column:
    """The address that target names on the page url; null if it is the page itself, or neither is an address of a host."""
    home = F.nullif(F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)", 1), F.lit(""))
    scheme = F.regexp_extract(url, r"^((?s:.*?):)//", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = F.when(own.startswith("/"), own).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")), own))
    parts_ = F.split(F.substr(full, F.lit(2)), "/")
    last = F.element_at(parts_, -1)
    none = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    plain = F.aggregate(parts_, none, step)
    tail = F.when(last.isin(".", "..") & (F.size(plain) > 0), "/").otherwise("")
    placed = F.concat(home, F.lit("/"), F.array_join(plain, "/"), tail, rest)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#") | (target == ""), None)
        .when(target.startswith("//"), F.concat(F.nullif(scheme, F.lit("")), target))
        .when(target.startswith("?"), F.concat(home, path, target))
        .otherwise(placed)
    )


def address(url: Column) -> Column:
    """What names a page: scheme and host in lower case, no part of the page."""
    whole = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(ascii_lower(head), F.substr(whole, F.length(head) + 1))


def links(pages: DataFrame) -> DataFrame:
    """Edges a, b between different addresses that pages declare to be one: all canonical links and refreshes of a page, whatever
    the number and order of attributes and quotes, but not those in comments, scripts and styles. Relative targets are taken from the
    page's address; a base that a page names is not looked at."""
    seen = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).where(F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = seen.select("url", F.explode(F.regexp_extract_all("html", F.lit(f"(?is){HIDDEN}|{TAG}"), F.lit(0))).alias("tag")).where(F.col("tag").rlike("(?i)^<(?:link|meta)") & F.col("tag").rlike("(?i)canonical|http-equiv"))
    tag = F.col("tag")
    canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = tag.rlike("(?i)^<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
    led = F.concat(*[F.regexp_extract(attribute(tag, "content"), REFRESH, k) for k in (1, 2, 3)])
    target = F.regexp_replace(F.when(canonical, attribute(tag, "href")).when(refresh, led), r"^\s+|\s+$", "")
    target = F.regexp_replace(target, "(?i)&(?:amp|#38|#x26);", "&")
    found = tags.select("url", target.alias("target")).where("target IS NOT NULL")
    ends = found.select(address(F.col("url")).alias("a"), address(resolved(F.col("target"), F.col("url"))).alias("b"))
    return ends.where("b IS NOT NULL AND a != b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, and alias_blocked (an alias' block decided).

    A rule of its own decides first, so an explicit allow stands against blocked aliases; then a block of any alias,
    be it a page or only the target of a link; else allow. Addresses are aliases whatever the case of their hosts and whatever follows
    a #. Html of any length is searched whole. Null addresses have empty host and path, no rule, no aliases
    and are allowed; null html declares no links; repeated addresses are one node; empty tables give no rows; other
    columns are not looked at.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    roots = scratch.keep(components(links(pages), scratch))
    blocked = (
        ruled(roots.withColumnRenamed("node", "url"), rules)
        .where("own = 'block'")
        .select("root")
        .distinct()
        .join(roots, "root")
        .select("node", F.lit(True).alias("alias_blocked"))
    )
    out = ruled(pages.select("page_id", "url"), rules).join(blocked, address(F.col("url")) == F.col("node"), "left")
    alias = F.coalesce("alias_blocked", F.lit(False)) & F.col("own").isNull()
    verdict = F.coalesce("own", F.when(alias, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), alias.alias("alias_blocked"))


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same for DuckDB, with links, relative targets and components in its own way."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"""SELECT *, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"""
    rest = "regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest"
    fit = lambda t: f"({t}.host = r.host OR ends_with({t}.host, '.' || r.host)) AND starts_with({t}.path, r.path)"
    node = lambda x: f"{lower(f"regexp_extract({x}, '(?s)^([^#]*?://[^/?#]*)', 1)")} || substr(split_part({x}, '#', 1), length(regexp_extract({x}, '(?s)^([^#]*?://[^/?#]*)', 1)) + 1)"
    attribute = lambda name: rf"""list_extract(list_transform(list_filter(own, lambda x: lower(regexp_extract(x, '(?s)^([^\s=]+)', 1)) = '{name}'),
      lambda x: regexp_replace(regexp_replace(x, '(?s)^[^\s=]+\s*=\s*', ''), '(?s)^["''](.*)["'']$', '\1')), 1)"""  # noqa: E731
    return rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {values}),
tag AS (
  SELECT url, lower(substr(tag, 2, 4)) AS kind, regexp_extract_all(tag, '[^\s"''<>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)') AS own
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)
  WHERE regexp_matches(tag, '(?i)^<(link|meta)')
), named AS (
  SELECT url, regexp_replace(trim(CASE
      WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower({attribute("rel")}), '\s+'), 'canonical') THEN {attribute("href")}
      WHEN kind = 'meta' AND lower(trim({attribute("http-equiv")})) = 'refresh' THEN
        regexp_replace(regexp_replace({attribute("content")}, '(?is)^\s*[^;,\s]*(\s*[;,]\s*|\s+)(url\s*=\s*)?', ''), '(?s)^["'']([^"'']*).*$', '\1')
    END), '(?i)&(amp|#38|#x26);', '&', 'g') AS t
  FROM tag
), placed AS (
  SELECT url, t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS home, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(t, '^([^?#]*)', 1) AS own, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS tail
  FROM named WHERE t IS NOT NULL AND t != '' AND NOT starts_with(t, '#')
), walked AS (
  SELECT *, string_split(CASE WHEN starts_with(own, '/') THEN own ELSE CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || own END, '/')[2:] AS steps
  FROM placed
), link AS (
  SELECT DISTINCT a, b FROM (
    SELECT {node("url")} AS a, {node("b")} AS b FROM (
      SELECT url, CASE
          WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
          WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
          WHEN starts_with(t, '//') THEN nullif(regexp_extract(url, '(?s)^(.*?:)//', 1), '') || t
          WHEN starts_with(t, '?') THEN nullif(home, '') || path || t
          ELSE nullif(home, '') || '/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(steps, lambda x: [x])),
                 lambda kept, x: CASE x[1] WHEN '..' THEN kept[1:greatest(len(kept) - 1, 0)] WHEN '.' THEN kept ELSE list_concat(kept, x) END), '/')
               || CASE WHEN steps[-1] IN ('.', '..') AND len(list_filter(steps, lambda x: x NOT IN ('.', '..'))) > 0 THEN '/' ELSE '' END || tail
        END AS b
      FROM walked
    ) WHERE b IS NOT NULL
  ) WHERE a != b
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
known AS ({split} FROM (SELECT url, {rest} FROM (SELECT DISTINCT b AS url FROM reach))),
bad AS (
  SELECT url FROM (SELECT p.url, arg_max(r.verdict, length(r.host || r.path)) AS own FROM known p JOIN rules r ON {fit("p")} GROUP BY p.url) WHERE own = 'block'
), caught AS (SELECT DISTINCT a AS node FROM reach WHERE b IN (SELECT url FROM bad)),
page AS ({split} FROM (SELECT page_id, url, {node("url")} AS node, row_number() OVER () AS n, {rest} FROM pages)),
own AS (
  SELECT p.n, arg_max(r.verdict, length(r.host || r.path)) AS own, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
  FROM page p JOIN rules r ON {fit("p")} GROUP BY p.n
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN caught.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       own IS NULL AND caught.node IS NOT NULL AS alias_blocked
FROM page LEFT JOIN own USING (n) LEFT JOIN caught USING (node)"""

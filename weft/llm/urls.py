"""URL filters: block and allow rules, spread over redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.operators.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; null or no "://": empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null.

    A rule fits its host and that host's subdomains where the path starts with the rule's. Rules are
    a list in the plan (hundreds, not millions): one pass without a join. Of equal lengths the rule
    that allows comes first, then the order of code points.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    chain = None
    for verdict, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    if chain is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return chain


def url_key(url: Column) -> Column:
    """What names a page: the URL without its fragment, scheme lower-cased and host by ``url_host``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    plain = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), url_host(url), url_path(url), query)).otherwise(plain)


def _unescaped(text: Column) -> Column:
    """``text`` with its character references read: numbers, and the five names that attributes need."""
    parts = F.split(text, "&#")
    number = r"^(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));?"

    def read(part: Column) -> Column:
        as_hex, decimal = F.regexp_extract(part, number, 1), F.regexp_extract(part, number, 2)
        code = F.when(as_hex != "", as_hex).when(decimal != "", F.conv(decimal, 10, 16))
        known = code.isNotNull() & (F.conv(code, 16, 10).cast("long").between(1, 0x10FFFF)) & ~F.conv(code, 16, 10).cast("long").between(0xD800, 0xDFFF)
        return F.when(known, F.concat(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), F.regexp_replace(part, number, ""))).otherwise(
            F.concat(F.lit("&#"), part)
        )

    out = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), read), ""))
    for name, char in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in quotes or without; empty if it has none."""
    pattern = rf"""(?is)(?<=[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(_unescaped(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])))


def _without_dots(path: Column) -> Column:
    """A path that begins with "/" less its "." and ".." segments; one of these at the end leaves a "/"."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, none,
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def _absolute(link: Column, base: Column) -> Column:
    """``link`` as an absolute URL, resolved against the page's own by the rules of RFC 3986, section 5.2."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own_path, own_query = url_path(base), F.regexp_extract(base, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(own_path, r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .when(link.startswith("?"), F.concat(origin, own_path, link))
        .when(link.startswith("#"), F.concat(origin, own_path, own_query, link))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) URL keys of each page's canonical link and of its meta-refresh redirect, if any."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.col("url")
    canonical = F.transform(
        F.filter(
            F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1)),
            lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"),
        ),
        lambda t: _attribute(t, "href"),
    )
    refresh = F.transform(
        F.filter(
            F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1)),
            lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh",
        ),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)^[^;,]*[;,]\s*url\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    linked = pages.filter(url.isNotNull()).select(url.alias("url"), F.explode(F.concat(canonical, refresh)).alias("link"))
    linked = linked.filter(F.col("link") != "")
    return linked.select(url_key(F.col("url")).alias("src"), url_key(_absolute(F.col("link"), F.col("url"))).alias("dst"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    A URL that a rule fits has that rule's verdict. For another, the method decides: pages, their
    canonical links and their redirects (``redirects``: src, dst URLs from a crawl log, beside the
    meta-refresh ones) form components of equivalent URLs. If a member of the component is allowed by
    a rule, the page is allowed; else if one is blocked, it is blocked; else it has ``default``. A null
    or empty URL has empty host and path, no rule, no aliases and the default. Repeated rows are judged
    alike. Link targets that aren't pages count as members. Only rows with links meet in the component
    search; verdicts come back by a join on the URL's key of the linked URLs alone.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    url = F.col("url")
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("src")).alias("src"), url_key(F.col("dst")).alias("dst")))
    groups = connected_components(edges)
    member = match_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"]
    votes = groups.withColumn("vote", member)
    by_group = votes.groupBy("component").agg(
        F.max((F.col("vote") == "allow").cast("int")).alias("allows"), F.max((F.col("vote") == "block").cast("int")).alias("blocks")
    )
    spread = groups.join(by_group, "component").select(
        F.col("node").alias("url_node"),
        F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").alias("spread_verdict"),
    )
    judged = pages.select(F.struct(*pages.columns).alias("url_page"), url_host(url).alias("host"), url_path(url).alias("path"), url_key(url).alias("own_key"))
    judged = judged.withColumn("own_match", match_rule(F.col("host"), F.col("path"), rules))
    return judged.join(spread, judged["own_key"] == spread["url_node"], "left").select(
        *[F.col("url_page").getField(c).alias(c) for c in pages.columns], "host", "path",
        F.col("own_match.rule").alias("rule"),
        F.coalesce(F.col("own_match.verdict"), F.col("spread_verdict"), F.lit(default)).alias("verdict"),
    )

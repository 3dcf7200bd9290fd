"""URL filters with redirect equivalence: block decisions reach aliases, allow rules come first."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize
from .components import connected_components, to_least

#: (verdict, host, path prefix): fixed values of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Query parameters that name no content, and host prefixes of the same site.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+|igshid)"
ALIAS_HOSTS = r"^(?:www|m|mobile|amp)\."


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z folded; empty for null or without ://."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def path_of(url: Column) -> Column:
    """From the host up to ?, # or the end; empty for null or without ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path prefix as one text; the first listed of equal ones) that fits, and its verdict.
    A rule fits its host and subdomains of it, if the path begins with the rule's. null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, *_ in ordered])


def url_node(url: Column) -> Column:
    """A url as a node: scheme and host in lower case, / for an empty path, its query, no fragment. null without ://."""
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(F.instr(url, "://") > 0, F.concat(_scheme(url), F.lit("://"), host_of(url), path, query))


def _scheme(url: Column) -> Column:
    return F.lower(F.substring_index(url, "://", 1))


def canonical_key(url: Column) -> Column:
    """What many sites' redirects lead to, as a guess that judge takes only with guess_aliases: no scheme, fragment, tracking parameters, alias host, index page,
    .html or slash at the end. null for null or without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), ALIAS_HOSTS, "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?i)/(?:index)?\.?(?:html?|php)?$", ""), r"(?i)\.html?$", "")
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)"))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("~"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescaped(text: Column) -> Column:
    """text with its character references (named ones with a semicolon, decimal and hexadecimal ones) replaced, once each."""
    names = F.str_to_map(F.lit("\x02".join(f"{k[:-1]}\x01{v}" for k, v in html5.items() if k.endswith(";"))), F.lit("\x02"), F.lit("\x01"))
    # References and what stands between them, in turn, so that what a reference gives is never read again.
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#[xX][0-9A-Fa-f]{1,6};?|&#[0-9]{1,7};?|&[A-Za-z][A-Za-z0-9]*;|&|[^&]+"), F.lit(0))

    def plain(p: Column) -> Column:
        number = F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(p, "^&#([0-9]+)", 1)).cast("int")
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        letter = F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(p)
        name = F.coalesce(F.try_element_at(names, F.regexp_extract(p, "^&([A-Za-z0-9]+);$", 1)), p)
        return F.when(p.rlike("^&#[0-9xX]"), letter).when(p.rlike("^&[A-Za-z0-9]+;$"), name).otherwise(p)

    return F.when(F.instr(text, "&") > 0, F.array_join(F.transform(parts, plain), "")).otherwise(text)


def resolved(target: Column, url: Column) -> Column:
    """The absolute url of a target in the page url: by scheme, // (host), / (path), ? (query), # (the page itself), or
    else from the directory of the page's path; . and .. are folded. null for targets of other kinds, as mailto:."""
    site, path = F.concat(_scheme(url), F.lit("://"), host_of(url)), path_of(url)
    folder = F.concat(site, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")))
    whole = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(_scheme(url), F.lit(":"), target)).when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path, target)).when(target.startswith("#"), F.regexp_replace(url, "(?s)#.*$", ""))
        .when(~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, target))
    )
    return _once(whole, lambda w: F.when(w.rlike(r"^[^:]*://[^/?#]*[^?#]*/\.\.?(?:[/?#]|$)"), _folded(w)).otherwise(w))


def _folded(url: Column) -> Column:
    """An absolute url without . and .. in its path."""
    parts = lambda k: F.regexp_extract(url, r"(?s)^([^:]*://[^/?#]*)/?([^?#]*)(.*)$", k)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.split(parts(2), "/", -1), F.array().cast("array<string>"), step)
    ends = F.when(parts(2).rlike(r"(?:^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(parts(1), F.lit("/"), F.array_join(kept, "/"), ends, parts(3))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of pages(url, html): the node of a page's url and that of each canonical link and each redirect by meta
    refresh in the page. Targets are unescaped and resolved; pages without such a link give no row."""
    html = F.when(F.col("html").rlike(r"(?i)canonical|http-equiv"), F.col("html"))
    link = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    meta = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    href = F.transform(link, lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to = F.transform(meta, lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    targets = F.coalesce(F.concat(href, to), F.array().cast("array<string>"))
    linked = pages.where(F.instr("url", "://") > 0).select("url", F.explode(F.filter(targets, lambda t: t != "")).alias("t"))
    absolute = _once(unescaped(F.col("t")), lambda t: resolved(t, F.col("url")))
    return linked.select(url_node(F.col("url")).alias("a"), _once(absolute, url_node).alias("b")).where("b IS NOT NULL")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, guess_aliases: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every row of pages(page_id, url, html).

    A url's own rule decides, allow or block. A url without one is blocked if a url that is equivalent to it is blocked:
    equivalence is connected components over redirect and canonical-link edges (page_edges, and rows (a, b) of urls in
    redirects, if given; with guess_aliases, urls of one canonical_key are equivalent, too). Urls that are targets only
    count as well. Within a component an explicit allow of any alias comes before blocks. All others are allowed.
    component: the least node of the component; null if no edge meets the url. Null and malformed urls have empty host
    and path and are allowed; repeated rows are judged each; extra columns are ignored. Host, path and rule are the
    row's own. Only urls with an edge take part in components, and only their verdicts are joined to pages, by broadcast
    where they are few (checked); pages without a url are never keys of a join.
    """
    url = F.col("url")
    pages = pages.selectExpr("CAST(page_id AS long) page_id", "CAST(url AS string) url", "CAST(html AS string) html")
    edges = page_edges(pages)
    if redirects is not None:
        a, b = F.col("a"), F.col("b")
        edges = edges.union(redirects.select(url_node(a).alias("a"), url_node(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    if guess_aliases:
        edges = materialize(edges, "links")
        both = edges.select("a").union(edges.select("b")).union(pages.select(url_node(url)).where(F.instr("url", "://") > 0))
        edges = edges.union(both.distinct().select("a", canonical_key(F.col("a")).alias("b")))
    parts = materialize(connected_components(edges, "a", "b").withColumn("own", rule_and_verdict(host_of(F.col("node")), path_of(F.col("node")), rules)[1]), "aliases")
    blocked = F.coalesce(F.bool_or(F.col("own") == "block") & ~F.coalesce(F.bool_or(F.col("own") == "allow"), F.lit(False)), F.lit(False))
    whole = parts.groupBy(F.col("component").alias("u")).agg(blocked.alias("m"), F.count("*").alias("c"))
    known = bounded(to_least(parts, "component", whole, parts.count()).select("node", "component", F.when(F.col("m"), F.lit("block")).alias("passed")), "passed")
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_node(url).alias("at")).withColumns({"rule": rule, "own": verdict})
    met = rows.where("at IS NOT NULL").join(known, F.col("at") == F.col("node"), "left")
    none = F.lit(None).cast("string")
    rest = rows.where("at IS NULL").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), none.alias("component"))
    return met.select("page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"), "component").union(rest)

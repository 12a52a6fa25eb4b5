"""URL filter with redirect equivalence, in DataFrame functions only.

Longest-rule matching decides pages that a rule fits.  For the others, URLs that
redirect or canonical-link to each other form classes (connected components over
the edges found in the pages); a class that holds a blocked page passes the
block to its other pages, unless some page of it is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path)
DEFAULT_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Rule lists up to this length become one expression; longer ones are joined, with the same result.
MAX_INLINE_RULES = 16

#: Query parameters that only track visitors, from where a parameter starts.
TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty when there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, null where none does.
    Of rules of one length an allowing one goes first, then the last by text."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        action = F.when(fits, F.lit(verb)).otherwise(action)
    return text, action


def with_matching_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Add ``rule`` and ``action`` of :func:`matching_rule` to rows with ``host, path``.

    Long lists, and tables ``action, host, path``, are joined: a host is looked up
    by each of its suffixes, and its path by the prefixes of the lengths that rules of
    that suffix have, so that rows meet rules that fit only.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_INLINE_RULES:
            rule, action = matching_rule(F.col("host"), F.col("path"), rules)
            return pages.withColumns({"rule": rule, "action": action})
        rules = pages.sparkSession.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
    table = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("prefix")).agg(F.min("action").alias("action"))  # allow before block
    lengths = table.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.withColumn("suffix", F.explode(suffixes)).join(lengths, "suffix").withColumn("long", F.explode("lengths"))
    asked = asked.filter(F.length("path") >= F.col("long")).withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("long")))
    text = F.concat("suffix", "prefix")
    longest = F.max_by(F.struct(text.alias("rule"), "action"), F.struct(F.length(text), F.col("action") == "allow", text)).alias("best")
    best = asked.join(table, ["suffix", "prefix"]).groupBy("host", "path").agg(longest).select("host", "path", "best.*")
    return pages.join(best, ["host", "path"], "left")


def canonical_form(url: Column) -> Column:
    """One spelling for URLs that name the same resource whatever the page says:
    no scheme, ``www.``, fragment, tracking parameters or trailing slash."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"&{2,}", "&")
    kept = F.regexp_replace(kept, r"^&|&$", "")
    base = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*([^\s\"'>]+)", 1))


def _resolved(target: Column, url: Column) -> Column:
    """Absolute URL of a link found on the page ``url``; null for an empty link."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)?", 0)
    return (
        F.when(target == "", None)
        .when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """``url, target`` for the first canonical link and the first refresh redirect in ``html``."""
    html, url = F.col("html"), F.col("url")
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    jump = F.regexp_extract(refresh, r"(?is)\burl\s*=\s*['\"]?([^\"'>\s]+)", 1)
    found = pages.filter(F.instr(url, "://") > 0).select(url, F.explode(F.array(_resolved(_attribute(link, "href"), url), _resolved(jump, url))).alias("target"))
    return found.filter("target is not null")


def classify_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = DEFAULT_RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Verdict for every page.

    ``pages`` has ``page_id, url, html``; ``rules`` lists action, host and path;
    ``redirects`` may add ``url, target`` edges.  Returns ``page_id, url, host, path,
    rule, verdict, alias_class``, one row per input row.  A null url or one without
    ``://`` has empty host and path, fits no rule, has no aliases and is allowed.
    Null or empty html gives no edges; of several canonical links or refresh
    redirects in a page the first counts, and html is searched as a whole, however
    long.  Of rules of one length an allowing one goes first; a class with both
    allowed and blocked pages passes nothing on.  Null ids and repeated rows are
    kept and judged by their url alone.  An empty table gives an empty one, and further
    columns are ignored, whatever their names.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    node_edges = edges.select(F.xxhash64(canonical_form(F.col("url"))).alias("src"), F.xxhash64(canonical_form(F.col("target"))).alias("dst"))
    classes = connected_components(node_edges)

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.when(F.instr("url", "://") > 0, F.xxhash64(canonical_form(F.col("url")))).alias("node"))
    judged = with_matching_rule(judged, rules)
    judged = judged.join(classes, "node", "left").withColumn("alias_class", F.coalesce("component", "node"))
    ruled = judged.filter("action is not null and alias_class is not null").groupBy("alias_class")
    status = ruled.agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    passed = F.when(F.col("blocked") & ~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(status, "alias_class", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("action", passed).alias("verdict"), "alias_class")

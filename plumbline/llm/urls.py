"""URL filters: allow and block rules by host and path, carried to aliases of a page.

Redirects and canonical links join addresses that stand for one page. Connected components over
these edges propagate block decisions to addresses without a rule of their own. An explicit allow
takes precedence: a component that holds an allowed address passes no block on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import joined_by
from plumbline.llm.components import components
from plumbline.session import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_VALUE = r"""\s*=\s*["']?\s*([^"'>\s]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query: what is left when scheme and fragment are dropped."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit("")))


def canonical_targets(html: Column, url: Column) -> Column:
    """Absolute URLs of the canonical links and refresh redirects in ``html``."""
    tags = F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?\s*canonical\b""")),
        lambda t: F.regexp_extract(t, r"(?is)\bhref" + _VALUE, 1),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b""")),
        lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*'?\s*([^\"'>\s]+)", 1),
    )
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)

    def absolute(t: Column) -> Column:
        root = F.concat(scheme, F.lit("://"), host_of(url))
        return (
            F.when(t.contains("://"), t)
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("/"), F.concat(root, t))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), t))
        )

    return F.transform(F.filter(F.concat(canonical, refresh), lambda t: t != ""), absolute)


def matched_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, decided`` of the distinct addresses that a rule fits.

    A rule ``(host, path, verdict)`` fits its host and all subdomains if the address's path starts
    with its own. The longest wins; of equally long ones that with the longer host, then allow.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."),
    )
    known = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    )
    fitting = joined_by(
        addresses.where(F.col("host") != "").select("host", "path", F.explode(suffixes).alias("rule_host")),
        known,
        "rule_host",
        rules.count(),
    ).where(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    longest = F.max(
        F.struct(
            F.length(rule),
            F.length("rule_host"),
            (F.col("verdict") == "allow").alias("allows"),
            rule.alias("rule"),
            F.col("verdict").alias("decided"),
        )
    )
    return fitting.groupBy("host", "path").agg(longest.alias("best")).select(
        "host", "path", "best.rule", "best.decided"
    )


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``redirects`` may add edges ``(source, target)`` between URLs to those found in ``html``. The
    verdict is that of the page's own rule; without one, that of its component: allow if any
    address in it is explicitly allowed, else block if any is blocked, else allow.

    Null URLs and those without ``://`` have an empty host and path, no rule and no edges, and are
    allowed; a null ``html`` has no links; repeated rows are judged alike and all returned; an
    empty table gives no rows. Other columns are ignored.
    """
    url = F.col("url").cast("string")
    seen = stored(
        pages.select(
            "page_id",
            host_of(url).alias("host"),
            path_of(url).alias("path"),
            address_of(url).alias("address"),
            F.array_distinct(canonical_targets(F.col("html").cast("string"), url)).alias("targets"),
        ),
        "pages",
    )
    links = seen.where(F.col("host") != "").select("address", F.explode("targets").alias("target"))
    if redirects is not None:
        links = links.unionByName(
            redirects.select(address_of(F.col("source")).alias("address"), "target").where("address != ''")
        )
    links = stored(
        links.select(
            "address",
            address_of(F.col("target")).alias("other"),
            host_of(F.col("target")).alias("host"),
            path_of(F.col("target")).alias("path"),
        )
        .where((F.col("other") != "") & (F.col("host") != ""))
        .distinct(),
        "links",
    )
    addresses = seen.select("host", "path").unionByName(links.select("host", "path")).distinct()
    if redirects is not None:
        own = redirects.select(host_of(F.col("source")).alias("host"), path_of(F.col("source")).alias("path"))
        addresses = addresses.unionByName(own).distinct()
    ruled = stored(matched_rules(addresses, rules), "ruled")
    groups = stored(components(links, "address", "other"), "components")
    group_rules = (
        groups.select("component", F.regexp_extract("id", r"^[^/?]*", 0).alias("host"),
                      F.regexp_extract("id", r"^[^/?]*([^?]*)", 1).alias("path"))
        .join(ruled, ["host", "path"])
        .groupBy("component")
        .agg(F.max(F.col("decided") == "allow").alias("allows"), F.max(F.col("decided") == "block").alias("blocks"))
        .where("blocks AND NOT allows")
    )
    blocked = stored(
        groups.join(group_rules, "component").select(F.col("id").alias("address"), F.lit(True).alias("by_alias")),
        "blocked",
    )
    return (
        seen.drop("targets")
        .join(ruled, ["host", "path"], "left")
        .join(blocked, "address", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce(
                "decided", F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit("allow"))
            ).alias("verdict"),
        )
    )

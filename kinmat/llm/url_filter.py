"""URL filters: rules on host and path, carried over redirects and canonical links.

Pages that redirect to one another or name one another as canonical are one resource under several
addresses. Components over those links let a decision on one address reach its aliases. A rule that fits an address
itself goes first, and an allowed address among the aliases goes before blocked ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmat.llm.components import components
from kinmat.llm.frames import let
from kinmat.operators.skew import join_grouped
from kinmat.session import settle

#: The rules of the registered query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: First labels of hosts that lead to the same site, and parameters that only track a visit.
ALIAS_LABELS = ("www", "m")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

#: Rows of one host that a task joins, unless one in ten thousand of all rows is more.
HOST_ROWS = 2_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if url is null or has no ://."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if url is null or has no ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What names a resource: host, path and query without scheme, fragment and tracking parameters; null without a host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    told = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)"))
    whole = F.concat(host_of(url), path_of(url), F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(told, "&"))).otherwise(""))
    return F.when(host_of(url) != "", whole)


def plain_address(known: Column) -> Column:
    """The address without the first label of its host if that is an alias label of a longer host."""
    return F.regexp_replace(known, rf"^(?:{'|'.join(ALIAS_LABELS)})\.(?=[^./?#]+\.[^/?#])", "")


def resolve(link: Column, url: Column) -> Column:
    """The absolute form of a link found in the page ``url``."""
    given = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(url, "^([^/?#]*)://", 1)
    folder = F.regexp_extract(path_of(url), "^(.*/)", 1)
    return let(given, lambda given: _absolute(given, url, scheme, folder))


def _absolute(given: Column, url: Column, scheme: Column, folder: Column) -> Column:
    return (
        F.when(given == "", None)
        .when(given.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), given)
        .when(given.startswith("//"), F.concat(scheme, F.lit(":"), given))
        .when(given.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(given.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), given))
        .when(given.rlike("^[?#]"), F.concat(scheme, F.lit("://"), host_of(url), path_of(url), given))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(url), F.when(folder == "", "/").otherwise(folder), given))
    )


_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\s{name}{_VALUE}"
    return let(tag, lambda tag: F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def canonical_link(html: Column) -> Column:
    """The target of the page's first canonical link; null without one."""
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\srel\s*=\s*["']?canonical\b[^>]*>""", 0)
    return F.nullif(_attribute(tag, "href"), F.lit(""))


def refresh_target(html: Column) -> Column:
    """The target of the page's first immediate or timed redirect by a refresh tag; null without one."""
    tag = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\shttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    target = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    return F.nullif(F.trim(target), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """rule_verdict, rule_host, rule_path, rule; of rules for the same host and path, allow goes first."""
    table = spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")
    return (
        table.groupBy("rule_host", "rule_path")
        .agg(F.min("rule_verdict").alias("rule_verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
    )


def match_rules(addressed: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule and rule_verdict: of the rules that fit host and path, the longest; null where none fits.

    A rule fits its host and all subdomains if the path starts with its own. Each different host meets the rules of its
    endings once; rows then pick from their host's rules. A host with many rows is split by their paths.
    """
    labels = F.split("host", r"\.")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    sizes = addressed.groupBy("host").agg(F.count(F.lit(1)).alias("n_rows"))
    choices = F.sort_array(
        F.collect_list(
            F.struct(
                F.length("rule").alias("length"), F.col("rule").alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict")
            )
        ),
        asc=False,
    )
    by_host = (
        sizes.where("host <> ''").select("host", "n_rows", F.explode(endings).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host", "n_rows")
        .agg(choices.alias("choices"))
    )
    fitting = F.filter("choices", lambda c: F.startswith(F.col("path"), c["path"]))
    best = F.get(fitting, F.lit(0))
    return (
        join_grouped(addressed, settle(by_host), "host", "n_rows", "path", "left", HOST_ROWS)
        .withColumn("best", best)
        .withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.verdict")})
        .drop("choices", "best", "n_rows")
    )


def alias_links(addressed: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b, b_url): links from addresses to what they redirect to, name as canonical or stand for.

    ``addressed`` has url, address and targets (array of urls); ``redirects``, if known from a crawl, source and target urls.
    """
    found = addressed.select(F.col("address").alias("a"), F.explode("targets").alias("b_url"))
    if redirects is not None:
        known = redirects.select(address(F.col("source")).alias("a"), resolve(F.col("target"), F.col("source")).alias("b_url"))
        found = found.union(known)
    linked = found.select("a", address(F.col("b_url")).alias("b"), "b_url")
    plain = plain_address(F.col("address"))
    # The plain spelling is a node like others; its rules are those of its own host and path.
    spelt = addressed.select(F.col("address").alias("a"), plain.alias("b"), F.concat(F.lit("http://"), plain).alias("b_url"))
    return linked.union(spelt).where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page.

    The verdict is the rule's where one fits. Else it is that of the page's aliases: allow if a rule allows one
    of them, block if a rule blocks one; without either it is allow. Addresses that are only linked to count, too. A
    null url, or one without a host, has empty host and path, no rule and the verdict allow; null
    html has no links. Repeated pages are judged each; other columns are left out. An empty table gives no rows.
    """
    url = F.col("url")
    targets = F.array_compact(F.array(resolve(canonical_link(F.col("html")), url), resolve(refresh_target(F.col("html")), url)))
    addressed = settle(
        pages.select(
            "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"), targets.alias("targets")
        )
    )
    links = settle(alias_links(addressed, redirects))
    found = components(links)
    target = F.col("b_url")
    nodes = addressed.select("address", "host", "path").union(
        links.select(F.col("b").alias("address"), host_of(target).alias("host"), path_of(target).alias("path"))
    )
    ruled = match_rules(nodes.where("address is not null").distinct(), rules).where("rule is not null")
    told = (
        ruled.join(found, F.col("address") == F.col("node"))
        .groupBy("label")
        .agg(F.min("rule_verdict").alias("alias_verdict"))
    )
    by_alias = found.join(told, "label").select(F.col("node").alias("address"), "alias_verdict")
    judged = match_rules(addressed.select("page_id", "host", "path", "address"), rules)
    verdict = F.coalesce("rule_verdict", "alias_verdict", F.lit("allow"))
    return judged.join(by_alias, "address", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def judge_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same for DuckDB over the table pages, with components by recursion."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"

    def after(url: str) -> str:
        return f"case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) end"

    def host(url: str) -> str:
        return f"coalesce(translate(regexp_extract({after(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"

    def path(url: str) -> str:
        return f"coalesce(regexp_extract({after(url)}, '^[^/?#]*([^?#]*)', 1), '')"

    def query(url: str) -> str:
        told = f"list_filter(string_split(regexp_extract({after(url)}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(?:{TRACKING})(?:=|$)'))"
        return f"case when len({told}) > 0 then '?' || array_to_string({told}, '&') else '' end"

    def known(url: str) -> str:
        return f"case when {host(url)} <> '' then {host(url)} || {path(url)} || {query(url)} end"

    def attribute(tag: str, name: str) -> str:
        pattern = quote(rf"(?is)\s{name}{_VALUE}")
        return " || ".join(f"regexp_extract({tag}, {pattern}, {i})" for i in (1, 2, 3))

    canonical = "regexp_extract(html, " + quote(r"""(?is)<link\b[^>]*\srel\s*=\s*["']?canonical\b[^>]*>""") + ")"
    refresh = "regexp_extract(html, " + quote(r"""(?is)<meta\b[^>]*\shttp-equiv\s*=\s*["']?refresh\b[^>]*>""") + ")"
    content = f"regexp_extract({attribute(refresh, 'content')}, " + quote(r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)") + ", 1)"
    scheme, folder = "regexp_extract(url, '^([^/?#]*)://', 1)", f"regexp_extract({path('url')}, '^(.*/)', 1)"
    whole = f"""case when link = '' then null when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
      when starts_with(link, '//') then {scheme} || ':' || link when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
      when starts_with(link, '/') then {scheme} || '://' || {host("url")} || link
      when regexp_matches(link, '^[?#]') then {scheme} || '://' || {host("url")} || {path("url")} || link
      else {scheme} || '://' || {host("url")} || case when {folder} = '' then '/' else {folder} end || link end"""
    values = ", ".join(f"({', '.join(map(quote, r))})" for r in rules)
    labels = "|".join(ALIAS_LABELS)
    return f"""
        WITH RECURSIVE rules AS (SELECT *, host || path AS rule FROM (VALUES {values}) AS r(verdict, host, path)),
        given AS (SELECT page_id, url, html, {host("url")} AS host, {path("url")} AS path, {known("url")} AS a FROM pages),
        raw AS (
            SELECT url, a, trim(replace({attribute(canonical, "href")}, '&amp;', '&')) AS link FROM given
            UNION ALL SELECT url, a, trim(replace({content}, '&amp;', '&')) FROM given
        ), targets AS (SELECT a, {whole} AS b_url FROM raw),
        plain AS (
            SELECT DISTINCT a, CASE WHEN regexp_matches(a, '^(?:{labels})\\.[^./?#]+\\.[^/?#]') THEN regexp_replace(a, '^(?:{labels})\\.', '') ELSE a END AS b FROM given
        ), links AS (
            SELECT DISTINCT a, b, b_url FROM (
                SELECT a, {known("b_url")} AS b, b_url FROM targets UNION ALL SELECT a, b, 'http://' || b FROM plain
            ) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b
        ), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON r.b = e.a),
        nodes AS (
            SELECT a, host, path FROM given WHERE a IS NOT NULL
            UNION SELECT b, {host("b_url")}, {path("b_url")} FROM links
        ), fits AS (
            SELECT n.a, n.host, n.path, r.rule, r.verdict,
                row_number() OVER (PARTITION BY n.a, n.host, n.path ORDER BY length(r.rule) DESC, r.rule DESC) AS place
            FROM nodes n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
        ), told AS (
            SELECT reach.a, min(f.verdict) AS verdict FROM reach JOIN fits f ON f.a = reach.b AND f.place = 1 GROUP BY reach.a
        )
        SELECT page_id, g.host, g.path, f.rule, coalesce(f.verdict, t.verdict, 'allow') AS verdict
        FROM given g LEFT JOIN fits f ON f.a = g.a AND f.host = g.host AND f.path = g.path AND f.place = 1
        LEFT JOIN told t ON t.a = g.a
    """

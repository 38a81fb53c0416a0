"""URL filters: pattern rules fetched by their rarest literal token, all native.

A rule is a regular expression over the canonical URL (lower-case host, then
path). The literal tokens that every URL it matches must contain are read off
the expression (:func:`literal_tokens`), and the rule is filed under the one that
is rarest among the URLs. A URL is cut into tokens; those that are keys of the
index fetch candidate rules, and only candidates run their regular expression.
A rule without such a token is a candidate for every URL.

Two ways to fetch, chosen by the number of rules (a checked bound):
 * up to ``MAX_INLINE`` rules the index is a literal and the whole operator is
   one projection: no shuffle, and a hot URL or host costs nothing extra;
 * beyond it the index is a table, joined on the token over distinct URLs.

Defined cases: a null URL, or one without ``://``, has empty host and path,
fits no rule and is allowed; an empty rule list gives null rules and allows
all; of rules that fit, base rules come before pattern rules, the longest
first, ties by position in the list; repeated rows are judged alike; an empty
table gives an empty result; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as re_parts
from re import _parser as re_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INLINE = 2_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A regular expression over host and path; ``name`` is reported."""

    name: str
    pattern: str
    block: bool
    base: bool = False

    @property
    def rank(self) -> int:
        return self.base * 1_000_000 + len(self.name)

    @property
    def tokens(self) -> tuple[str, ...]:
        return literal_tokens(self.pattern)


def _separates(node: tuple) -> bool:
    """Whether all that a node matches is one character that is in no token."""
    kind, value = node
    if kind is re_parts.LITERAL:
        return not chr(value).isalnum()
    if kind is re_parts.IN:
        return all(k is re_parts.LITERAL and not chr(v).isalnum() for k, v in value)
    return False


def _apart(nodes: list[tuple], end: bool) -> bool:
    """Whether what ``nodes`` match always ends (or begins) with a character that
    is in no token, or at an end of the URL; an optional node may be absent."""
    for node in reversed(nodes) if end else nodes:
        kind, value = node
        if kind is re_parts.AT:
            return value in (re_parts.AT_BEGINNING, re_parts.AT_END)
        if kind is re_parts.SUBPATTERN:
            return _apart(list(value[3]), end)
        if kind is not re_parts.MAX_REPEAT:
            return _separates(node)
        least, _, inner = value
        if not _apart(list(inner), end):
            return False
        if least:
            return True
    return False


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Lower-case tokens that every URL that the expression fits must contain.

    Runs of literal characters at its top level, cut at characters that are in no
    token; the first and the last piece of a run count only where what stands
    beside them cannot go on with the token. Alternatives and optional parts
    give none, and an expression that cannot be read has none.
    """
    try:
        nodes = list(re_parser.parse(pattern))
    except (re.error, OverflowError):
        return ()
    found, i = [], 0
    while i < len(nodes):
        j = i
        while j < len(nodes) and nodes[j][0] is re_parts.LITERAL:
            j += 1
        if j > i:
            run = "".join(chr(v) for _, v in nodes[i:j])
            pieces = re.split(r"[^a-z0-9]+", run.lower())
            if not _apart(nodes[:i], True):
                pieces[0] = ""
            if not _apart(nodes[j:], False):
                pieces[-1] = ""
            found += [t for t in pieces if t and run.isascii()]
        i = max(j, i + 1)
    return tuple(dict.fromkeys(found))


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table of name, pattern, block and base, in order of name.

    A rule list is read to the driver whole: it is a parameter, not data.
    """
    rows = table.select("name", "pattern", "block", F.coalesce("base", F.lit(False)).alias("base")).orderBy("name", "pattern").collect()
    return tuple(Rule(r["name"], r["pattern"], r["block"], r["base"]) for r in rows)


def site_rule(text: str, block: bool) -> Rule:
    """``host/path``: the host with its subdomains, and paths that begin so."""
    host, _, path = text.partition("/")
    return Rule(text, rf"^([^/?#]*\.)?{_quote(host)}{_quote('/' + path)}", block, True)


def label_rule(name: str, words: tuple[str, ...], block: bool = True) -> Rule:
    """Hosts that have these words, one after the other, as parts of labels."""
    return Rule(name, rf"^([^/?#]*[.-])?{'[.-]'.join(map(_quote, words))}([.-][^/?#]*)?(/.*)?$", block)


def path_rule(name: str, word: str, block: bool = True) -> Rule:
    """Paths that have the word as a whole segment."""
    return Rule(name, rf"^[^/?#]*/([^?#]*/)?{_quote(word)}(/.*)?$", block)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


BASE_RULES = (site_rule("net/", True), site_rule("example.net/en/", False), site_rule("example.com/de/", True), site_rule("org/fr/", False))
PATTERN_RULES = (
    label_rule("cheap-pills", ("cheap", "pills")),
    label_rule("spam-farm", ("spam", "farm")),
    label_rule("casino", ("casino",)),
    label_rule("porn", ("porn",)),
    label_rule("adult", ("adult",)),
    label_rule("warez", ("warez",)),
    label_rule("malware", ("malware",)),
    path_rule("login", "login"),
    path_rule("cart", "cart"),
    path_rule("checkout", "checkout"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"))


def index(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """Rarest token of each rule -> positions of rules ("": rules without one).

    Counts are of the rules' own tokens only, so at most as many rows as the
    rules have tokens reach the driver.
    """
    needed = [r.tokens for r in rules]
    known = sorted({t for found in needed for t in found})
    counted = urls.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, known)))).alias("t")) if known else None
    seen = {r["t"]: r["n"] for r in counted.groupBy("t").agg(F.count("*").alias("n")).collect()} if known else {}
    filed: dict[str, list[int]] = {}
    for k, found in enumerate(needed):
        filed.setdefault(min(found, key=lambda t: (seen.get(t, 0), -len(t), t), default=""), []).append(k)
    return filed


def _best_inline(filed: dict[str, list[int]], rules: tuple[Rule, ...]) -> Column:
    """(rank, -k) of the rule that wins, or null."""
    fetched = F.array(*(F.lit(k) for k in filed.get("", ()))).cast("array<int>")
    keys = sorted(filed.keys() - {""})
    if keys:
        lists = F.create_map(*(x for t in keys for x in (F.lit(t), F.array(*map(F.lit, filed[t])))))
        found = F.transform(F.array_intersect("tokens", F.array(*map(F.lit, keys))), lambda t: F.element_at(lists, t))
        fetched = F.concat(fetched, F.flatten(found))
    patterns = F.array(*(F.lit(r.pattern) for r in rules)).cast("array<string>")
    ranks = F.array(*(F.lit(r.rank) for r in rules)).cast("array<int>")
    fits = F.filter(fetched, lambda k: F.regexp(F.col("canonical"), F.get(patterns, k)))
    return F.array_max(F.transform(fits, lambda k: F.struct(F.get(ranks, k).alias("rank"), (-k).alias("k"))))


def _best_joined(urls: DataFrame, filed: dict[str, list[int]], rules: tuple[Rule, ...]) -> DataFrame:
    """The same over an index table, for rule lists of any length."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(t, k, rules[k].pattern, rules[k].rank) for t, ks in filed.items() if t for k in ks], "t string, k int, pattern string, rank int")
    distinct = urls.select("canonical", "tokens").distinct()
    hit = distinct.select("canonical", F.explode("tokens").alias("t")).join(table, "t").where(F.regexp("canonical", F.col("pattern")))
    best = hit.groupBy("canonical").agg(F.max(F.struct("rank", (-F.col("k")).alias("k"))).alias("fetched"))
    always = _best_inline({"": filed.get("", [])}, rules)
    return urls.join(best, "canonical", "left").withColumn("best", F.array_max(F.array("fetched", always)))


def url_filter(pages: DataFrame, base: tuple[Rule, ...] = BASE_RULES, patterns: tuple[Rule, ...] = PATTERN_RULES, max_inline: int = MAX_INLINE) -> DataFrame:
    """page_id, host, path, rule, verdict and ``pattern_rule`` per input row."""
    rules = (*base, *patterns)
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = split.select("*", F.concat("host", "path").alias("canonical"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    filed = index(urls, rules)
    if len(rules) <= max_inline:
        judged = urls.withColumn("best", _best_inline(filed, rules))
    else:
        judged = _best_joined(urls, filed, rules)
    judged = judged.withColumn("best", -F.col("best.k"))
    if len(rules) == 0:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern_rule"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("best"))
    is_base = F.col("best") < len(base)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(is_base, pick([r.name for r in rules])).alias("rule"),
        F.when(pick([r.block for r in rules]), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        F.when(~is_base, pick([r.name for r in rules])).alias("pattern_rule"),
    )


def oracle(base: tuple[Rule, ...] = BASE_RULES, patterns: tuple[Rule, ...] = PATTERN_RULES) -> str:
    """DuckDB SQL: every rule against every URL, the best by rank."""
    values = ", ".join(f"({k}, '{r.name}', '{r.pattern}', {r.rank}, {str(r.block).lower()}, {str(r.base).lower()})" for k, r in enumerate((*base, *patterns)))
    return rf"""
WITH rules(k, name, pattern, rank, block, base) AS (VALUES {values}), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), b AS (
  SELECT c, arg_max(struct_pack(name := name, block := block, base := base), (rank, -k)) AS r
  FROM (SELECT DISTINCT host || path AS c FROM h) JOIN rules ON regexp_matches(c, pattern) GROUP BY c
)
SELECT page_id, host, path, CASE WHEN r.base THEN r.name END AS rule,
       CASE WHEN r.block THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN NOT r.base THEN r.name END AS pattern_rule
FROM h LEFT JOIN b ON c = host || path
"""

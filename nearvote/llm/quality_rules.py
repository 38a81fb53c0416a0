"""Quality rules: text statistics and a learned decision list, all native.

``text_stats`` computes its statistics inside each row with array functions:
no explode, no shuffle, and a row's memory is its own text. Repeated 3-word
windows are found by the 64-bit hashes of windows: where all are distinct (a
hash set tells), nothing is repeated; else (hash, place) pairs are sorted, so
a text of n words costs n log n however often its windows repeat.

``learn_rules`` fits an ordered decision list by sequential covering on
labelled statistics: a rule is a conjunction of thresholds, grown on two
thirds of the examples by information gain, pruned on the rest, and accepted
only with high precision on both; the examples it covers go and the next rule
is grown. ``decide`` turns the list into one CASE expression, so that applying
it is a projection. The fit reads at most ``MAX_LABELLED`` labelled rows (those
with the smallest md5 of their id); everything else covers all rows.

Defined cases: a null text counts as empty (no words, base_failed); a null
doc_id is kept as it is and never labelled; repeated rows are judged alike;
without labels, or with one class of them only, the list is empty and the
verdict is kept; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import WORD, text_or_empty, whole_row

#: Bound of the labelled sample that the rules are learned from.
MAX_LABELLED = 20_000
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"

FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "mean_line")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words in windows whose hash occurs at least twice, each word once."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        h = lambda at: F.get(s, at)["h"]
        repeated = lambda j: F.coalesce(h(j) == h(j - 1), F.lit(False)) | F.coalesce(h(j) == h(j + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), repeated), lambda j: F.get(s, j)["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    covered = lambda p: F.aggregate(
        p, start, lambda a, x: F.struct((a["n"] + 3 - F.greatest(a["until"] - x, F.lit(0))).alias("n"), (x + 3).alias("until")), lambda a: a["n"]
    )
    return _let(_let(pairs, places), covered)


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the whole text's statistics (all long) and ``row`` with every
    input column, one row per row; what a plan does not use is never read."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), whole_row(docs))
    split = base.select("doc_id", "row", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("words")
    w = lambda i: F.element_at(F.col("words"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(w(i), w(i + 1), w(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        "doc_id",
        "row",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        "words",
        windows.alias("hashes"),
    )
    repeats = F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0)).otherwise(_repeat_words(F.col("words"), F.col("hashes")))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct")
    # A column of row numbers is not deterministic, so no filter on the statistics
    # moves below this projection, where it would compute them over and over.
    return hashed.select("doc_id", "row", *(F.col(c).cast("long") for c in names), repeats.cast("long").alias("n_repeat_words"), F.monotonically_increasing_id().alias("at"))


def where(stats: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``text_stats`` that meet a condition on its columns."""
    return stats.where(condition & (F.col("at") >= 0))


def features() -> dict[str, Column]:
    c = F.col
    words, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    return {
        "n_words": c("n_words").cast("double"),
        "mean_word": c("word_chars") / words,
        "symbol_ratio": c("n_symbols") / words,
        "dup_line_ratio": c("n_dup_lines") / lines,
        "repeat_ratio": c("n_repeat_words") / words,
        "distinct_ratio": c("n_distinct") / words,
        "mean_line": c("n_words") / lines,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, above, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def covers(self, row: dict) -> bool:
        return all(row[f] > t if above else row[f] <= t for f, above, t in self.tests)

    def expression(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.tests:
            value = features()[name]
            out = out & ((value > F.lit(t)) if above else (value <= F.lit(t)))
        return out


def _precision(rows: list[dict], rule: Rule) -> tuple[float, int]:
    hit = [r["bad"] for r in rows if rule.covers(r)]
    return (sum(hit) / len(hit) if hit else 0.0), len(hit)


def _grow(rows: list[dict], max_tests: int, cuts: int) -> Rule:
    rule = Rule((), 0.0, 0)
    for _ in range(max_tests):
        p0, n0 = _precision(rows, rule)
        if p0 in (0.0, 1.0):
            break
        best, gain = None, 1e-9
        inside = [r for r in rows if rule.covers(r)]
        for name in FEATURES:
            ordered = sorted((r[name], r["bad"]) for r in inside)
            total_bad, bad = sum(b for _, b in ordered), 0
            step = max(1, len(ordered) // cuts)
            for k, (value, b) in enumerate(ordered[:-1], 1):
                bad += b
                if ordered[k][0] == value or (k % step and ordered[k][1] == b):
                    continue
                cut = (value + ordered[k][0]) / 2
                for above, pos, size in ((False, bad, k), (True, total_bad - bad, len(ordered) - k)):
                    if pos:
                        g = pos * (math.log2(pos / size) - math.log2(p0))
                        if g > gain:
                            gain, best = g, (name, above, cut)
        if best is None:
            break
        rule = Rule((*rule.tests, best), 0.0, n0)
    return rule


def _prune(rows: list[dict], rule: Rule) -> Rule:
    def worth(r: Rule) -> float:
        p, n = _precision(rows, r)
        return n * (2 * p - 1)

    while len(rule.tests) > 1:
        shorter = max((Rule(rule.tests[:i] + rule.tests[i + 1 :], 0.0, 0) for i in range(len(rule.tests))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def learn_list(rows: list[dict], max_rules: int = 8, max_tests: int = 3, cuts: int = 64, min_precision: float = 0.97, min_cover: int = 5) -> list[Rule]:
    """Sequential covering over rows of FEATURES and ``bad`` (0 or 1)."""
    rules: list[Rule] = []
    left = list(rows)
    for _ in range(max_rules):
        grow = [r for i, r in enumerate(left) if i % 3]
        check = [r for i, r in enumerate(left) if not i % 3]
        if sum(r["bad"] for r in grow) < min_cover:
            break
        rule = _prune(check, _grow(grow, max_tests, cuts))
        p, n = _precision(left, rule)
        pc, nc = _precision(check, rule)
        if not rule.tests or n < min_cover or p < min_precision or (nc and pc < min_precision):
            break
        rules.append(Rule(rule.tests, p, n))
        left = [r for r in left if not rule.covers(r)]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Decision list learned from at most ``max_labelled`` labelled rows."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("bad"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "bad")
        .limit(max_labelled)
    )
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    stats = where(text_stats(mine), ~base_failed())
    one = F.min(F.struct(F.col("row.bad").alias("bad"), *(v.alias(k) for k, v in features().items()))).alias("one")
    rows = stats.groupBy("doc_id").agg(one).select("doc_id", "one.*").collect()  # a doc_id may have several rows
    return learn_list(sorted((r.asDict() for r in rows), key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["bad"], r["n_words"])))


def decide(rules: list[Rule]) -> Column:
    """The list as an ordered CASE: number of the first rule that fits, else 0."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.expression(), F.lit(k)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def quality_rules(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Statistics, ``rule`` (0: none fits), ``base_failed``, ``kept`` and the
    input ``row``, per input row: one projection over the documents."""
    rules = learn_rules(docs, labels) if labels is not None else []
    return text_stats(docs).select("*", base_failed().alias("base_failed"), decide(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


#: Base columns; ``kept`` is the learned list's, so the query has no SQL twin.
ORACLE_BASE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       (len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words)) AS base_failed
FROM w LEFT JOIN r USING (doc_id)
"""

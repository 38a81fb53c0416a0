"""Operators and pipeline on awkward tables, and against brute force at sf0.01."""

import collections
import hashlib
import math
import re
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearvote.llm import exact_dedup, hmm, html_text, jaccard_join, mixing, packing, pii, quality_rules, queries, substring_dedup, url_filters
from tests.conftest import SF, rows_of, rows_of_sql

LONG = " ".join(f"w{i % 977} v{i % 31}" for i in range(60_000))
PROSE = " ".join(f"alpha{i} beta{i * i % 89} gamma" for i in range(80))
#: Names that the operators' own plans use.
CLASHING = ("row", "size", "hash", "kept", "words", "n", "cls", "at", "key", "a", "b", "token", "uid", "len", "spans", "copies", "length", "rank")
ROWS = [
    (1, "Hello  world\n again", "en", "web"),
    (2, "Hello world again", "en", "web"),
    (2, "Hello world again", "en", "web"),
    (3, None, None, None),
    (4, "", "en", "web"),
    (5, " \t\n", "en", "é"),
    (None, PROSE, "en", "books"),
    (6, PROSE, "en", "books"),
    (7, PROSE + " tail", "en", None),
    (8, LONG, "en", "books"),
    (9, "pay 4111 1111 1111 1111 a@b.co \U0001f600 é", None, "web"),
    (10, "one two three four five " * 40, "en", "web"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    data = [(*r, len(r[1] or ""), *["x"] * len(CLASHING)) for r in ROWS]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(data, ddl).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, wanted = rows_of(queries.QUERIES[name](spark, SF)), rows_of_sql(duck, queries.ORACLES[name])
    assert got == wanted


def test_pii(spark, awkward, texts):
    for r in queries.op1_pii(spark, SF).collect():
        counts, digest = pii.brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest
    found = {r.doc_id: [x["kind"] for x in r.spans] for r in pii.find_pii(awkward).collect()}
    assert found[9] == ["email", "card"] and found[3] == [] and len(found) == len({r[0] for r in ROWS})
    assert pii.find_pii(awkward.limit(0)).count() == 0


def packed_whole(rows, wanted, capacity=packing.CAPACITY):
    """wanted: list of (doc_id, ids); every piece once, gapless, in few sequences."""
    pieces, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = collections.Counter()
    for doc_id, ids in wanted:
        n, at, k = len(ids), 0, 0
        while at < n:
            to = at + ((n % capacity or capacity) if at == 0 else capacity)
            expected[doc_id, k, at, to - at, zlib.crc32(array("I", ids[at:to]).tobytes())] += 1
            at, k = to, k + 1
    assert pieces == expected
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, awkward, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode
    ids = lambda t: [*encode(t or "", add_special_tokens=False).ids, 0]
    whole = [(k, ids(t)) for k, t in texts.items()]
    used = packed_whole(queries.op2_packing(spark, SF).collect(), whole)
    assert used <= -(-sum(len(i) for _, i in whole) // packing.CAPACITY) + 1
    packed_whole(packing.pack(awkward).collect(), [(r[0], ids(r[1])) for r in ROWS])
    assert packing.pack(awkward.limit(0)).count() == 0


def test_packing_ranks_in_many_buckets(awkward, spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    same = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    rows = packing.pack(same, capacity=16).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 40 and len({s for s, _ in places}) == 10


def test_mixing(awkward):
    rows = mixing.mix(awkward).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in rows) == sorted((d if d is not None else -1, size(t)) for d, t, *_ in ROWS)
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.target <= 3 * r.source_size + 1e-6
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(r.size for r in rows if r.source == s)
    assert sorted(map(repr, mixing.mix(awkward).collect())) == sorted(map(repr, rows))
    assert mixing.mix(awkward.limit(0)).count() == 0
    again = collections.Counter(r.doc_id for r in mixing.take(awkward).collect())
    copies = collections.Counter()
    for r in rows:
        copies[r.doc_id] += r.copies
    assert again == +copies and mixing.take(awkward).columns == awkward.columns


def test_quality_base_equals_sql(spark, duck):
    rel = duck.sql(quality_rules.ORACLE_BASE)
    columns = list(rel.columns)
    got = queries.op4_quality_rules(spark, SF).cache()
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(rel.fetchall())
    assert got.where("base_failed and kept").count() == 0
    judged = {r.doc_id: r.kept for r in got.collect()}
    labels = duck.sql("SELECT doc_id, quality FROM labels").fetchall()
    passed = [judged[d] for d, q in labels if q == 1 and not dict((r.doc_id, r.base_failed) for r in got.collect())[d]] if len(labels) < 5 else None
    good = [d for d, q in labels if q == 1]
    base = {r.doc_id for r in got.where("base_failed").collect()}
    assert passed is None and sum(judged[d] for d in good if d not in base) >= 0.99 * len([d for d in good if d not in base])


def test_quality_on_awkward_rows(spark, awkward):
    rows = quality_rules.quality_rules(awkward, None).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed
    assert by[8].n_words == 120_000 and by[10].base_failed and by[10].n_repeat_words == 200
    assert by[6].kept and by[6].row.text == PROSE and by[6].row.size == "x"
    labels = spark.createDataFrame([(6, 1), (2, 0), (None, 1), (8, None)], "doc_id long, quality int")
    assert quality_rules.quality_rules(awkward, labels).count() == len(ROWS)
    assert quality_rules.quality_rules(awkward.limit(0), labels).count() == 0


def test_exact_dedup(awkward):
    for local_bytes in (1, 1 << 20):
        rows = exact_dedup.exact_dedup(awkward, local_bytes).collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups = collections.defaultdict(list)
        for d, t, *_ in ROWS:
            groups[norm(t)].append(d)
        wanted = collections.Counter()
        for t, ids in groups.items():
            low = min((d for d in ids if d is not None), default=None)
            for d in ids:
                wanted[d, low, len(ids), d == low, hashlib.sha256(t.encode()).hexdigest()] += 1
        assert collections.Counter(map(tuple, rows)) == wanted
    assert exact_dedup.exact_dedup(awkward.limit(0)).count() == 0


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    inverted, parent = collections.defaultdict(list), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = collections.Counter()
        for s in sets[i]:
            shared.update(inverted[s])
            inverted[s].append(i)
        for j, both in shared.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("light", [None, 0, 30])
def test_jaccard_join(spark, texts, light):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, light=light).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("part, bridges", [(jaccard_join.PART, jaccard_join.BRIDGES), (1, 0), (3, 0)])
def test_jaccard_join_of_chains(spark, monkeypatch, part, bridges):
    """Each text is near its neighbours only: the component goes all along,
    also where the closing join has all the work and deals lists in parts."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "BRIDGES", bridges)
    words = [f"u{i}" for i in range(400)]
    rows = [(100 + i, " ".join(words[4 * i : 4 * i + 110])) for i in range(60)] + [(7, "x y"), (8, "X  y"), (9, None)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), counters=8).collect()}
    assert got == {i: c for i, (_, c) in brute_components(dict(rows)).items()}


def test_jaccard_join_on_awkward_rows(awkward):
    rows = jaccard_join.jaccard_components(awkward).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[None][1] == got[6][1] == got[7][1] == 6 and got[1][1] == got[2][1] == 1 and got[3] == (0, 3) and got[4] == (0, 4)
    assert jaccard_join.jaccard_components(awkward.limit(0)).count() == 0


def test_substring_dedup_finds_exact_runs(spark, texts):
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    first, runs = {}, collections.defaultdict(set)
    for d in sorted(words):
        grams = [tuple(words[d][i : i + 50]) for i in range(len(words[d]) - 49)]
        for i, g in enumerate(grams):
            if first.get(g, d) != d:
                runs[d].update(range(i, i + 50))
        for g in grams:
            first.setdefault(g, d)
    covered = collections.defaultdict(set)
    for r in queries.op5_substring_dedup(spark, SF).collect():
        assert r.owner_id < r.doc_id and r.n_words >= 50 and r.identity >= 0.8 and r.owner_id in r.owner_ids
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    assert runs and all(runs[d] <= covered[d] for d in runs)


def test_substring_dedup_of_fuzzy_passages(spark, awkward):
    passage = [f"p{i}" for i in range(120)]
    fuzzy = [w for i, w in enumerate(passage) if i % 30 != 7]
    fuzzy[60] = "changed"
    fill = lambda k, n: [f"f{k}x{i}" for i in range(n)]
    halves = fill(5, 30) + passage[:70] + fill(6, 900) + passage[70:] + fill(7, 20)
    rows = [(1, fill(1, 40) + passage + fill(2, 50)), (2, fill(3, 200) + fuzzy), (3, fill(4, 90) + passage[:30]), (4, halves), (5, [])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.owner_id, r.start_word // 10) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(2, 1, 20), (4, 1, 3), (4, 1, 100)}
    found = substring_dedup.repeated_passages(awkward).collect()
    assert {(r.doc_id, r.owner_id) for r in found} >= {(6, None), (7, None)} and not {1, 2, 3, 4, 5} & {r.doc_id for r in found}
    assert substring_dedup.repeated_passages(awkward.limit(0)).count() == 0


def test_substring_dedup_of_rows_that_share_an_id(spark):
    fill = lambda k, n: [f"f{k}x{i}" for i in range(n)]
    passage = [f"p{i}" for i in range(80)]
    for shared in (None, 1):
        rows = [(shared, fill(k, 150)) for k in range(12)] + [(shared, fill(20, 30) + passage), (shared, fill(21, 150))]
        rows += [(5, fill(30, 20) + passage + fill(31, 9)), (9, fill(32, 70) + passage), (9, fill(33, 400))]
        docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
        got = sorted((r.doc_id, r.start_word, r.end_word, r.owner_id) for r in substring_dedup.repeated_passages(docs).collect())
        assert got == [(5, 20, 100, shared), (9, 70, 150, shared)]


def test_hmm_scores(spark, texts):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    words = {d: [*(t or "").encode().lower().split(), None] for d, t in texts.items()}
    counts = collections.Counter(w for d in texts if not held[d] for w in words[d])
    total, distinct = sum(counts.values()), len(counts)
    rows = queries.op7_hmm(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words[r.doc_id]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in counts for x in w), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)  # scores are negative: nearer 0 is better


def test_score_of_one_state(spark):
    """With one state the model is a unigram that can be written down; one text is longer than a group."""
    long = hmm.GROUP + 1_000
    docs = {1: "a b a", 2: "Zz b\tzz", 3: "never seen b", 4: "a " * long, 5: "b é é"}
    train = [d for d in docs if zlib.crc32(str(d).encode()) % 10]
    assert 4 in train
    tokens = {d: [*x.encode().lower().split(), None] for d, x in docs.items()}
    counts = collections.Counter(w for d in train for w in tokens[d])
    symbol = {w: k for k, w in enumerate(counts)}
    n = [*counts.values(), *[0] * (hmm.SYMBOLS - len(counts))]
    prior = [(x + 1) / (sum(n) + len(n)) for x in n]
    emit = [x + 10 * y for x, y in zip(n, prior, strict=True)]
    rows = hmm.hmm_scores(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), rounds=1, states=1).collect()
    for r in rows:
        wanted = sum(math.log10(emit[symbol.get(w, -1)] / sum(emit)) for w in tokens[r.doc_id])
        assert abs(r.score - wanted) < 1e-6 * abs(wanted)
    assert len(rows) == len(docs)


def test_dedup_of_long_texts_with_one_prefix(spark):
    """What a task holds is bounded by the texts' bytes, not by the trie's labels."""
    text = "p " * 10_000
    rows = [(i, f"{text}{i // 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, local_bytes=1 << 20).collect()}
    assert got == {(i, i - i % 2, 2) for i in range(400)}


def test_hmm_on_awkward_rows(awkward, spark):
    rows = hmm.hmm_scores(awkward, rounds=1).collect()
    assert len(rows) == len(ROWS) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert hmm.hmm_scores(awkward.limit(0), rounds=1).count() == 0
    lone = spark.createDataFrame([(3, "all held out")], "doc_id long, text string")
    untrained = hmm.hmm_scores(lone.where(hmm.held_out_column()) if lone.where(hmm.held_out_column()).count() else lone, rounds=1).collect()
    assert all(math.isfinite(r.score) for r in untrained)


def test_html(spark):
    rows = [(1, "<p>a<p>b", "x"), (None, None, "x"), (2, "", "x"), (1, "<p>a<p>b", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_text.html_text(pages).collect())
    assert got == {(1, "a\n\nb", 4): 2, (None, "", 0): 1, (2, "", 0): 1}
    assert html_text.html_text(pages.limit(0)).count() == 0


URLS = [
    (1, "http://A.Example.NET/en/x"), (2, "http://example.net/de/"), (3, "http://example.net"), (4, "https://x.org/fr/a?b"), (5, "https://example.com/de/1"), (6, "https://example.com/de"),
    (7, "no scheme"), (8, None), (9, "http://www.cheap-pills.example.com/en/"), (10, "http://example.net/en/login"), (11, "ftp://a.com/checkout#x"), (11, "ftp://a.com/checkout#x"), (None, "http://a://b.net/"),
]


@pytest.mark.parametrize("inline", [0, 100])
def test_url_filters(spark, inline):
    pages = spark.createDataFrame([(*r, "x", "x") for r in URLS], "page_id long, url string, host string, tokens string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern_rule) for r in url_filters.url_filter(pages, max_inline=inline).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow", None),
        2: ("example.net", "/de/", "net/", "block", None),
        3: ("example.net", "", None, "allow", None),
        4: ("x.org", "/fr/a", "org/fr/", "allow", None),
        5: ("example.com", "/de/1", "example.com/de/", "block", None),
        6: ("example.com", "/de", None, "allow", None),
        7: ("", "", None, "allow", None),
        8: ("", "", None, "allow", None),
        9: ("www.cheap-pills.example.com", "/en/", None, "block", "cheap-pills"),
        10: ("example.net", "/en/login", "example.net/en/", "allow", None),
        11: ("a.com", "/checkout", None, "block", "checkout"),
        None: ("a:", "//b.net/", None, "allow", None),
    }
    assert url_filters.url_filter(pages, max_inline=inline).count() == len(URLS)
    assert url_filters.url_filter(pages.limit(0), max_inline=inline).count() == 0
    assert {r.verdict for r in url_filters.url_filter(pages, (), ()).collect()} == {"allow"}


@pytest.mark.parametrize("inline", [0, 100])
def test_url_rules_from_a_table(spark, inline):
    """Rules without a token are tried on every URL; a long URL and a hot one are judged whole."""
    rows = [("any-mp3", "mp3$", True, None), ("track", r"/track/\w+", True, False), ("dots", r"\.\.\.", True, False), ("site", "^a[.]com/", False, True)]
    rules = url_filters.read_rules(spark.createDataFrame(rows, "name string, pattern string, block boolean, base boolean"))
    assert [r.tokens for r in rules] == [(), (), ("a", "com"), ("track",)]
    long = "http://b.com/" + "x/" * 50_000 + "track/1"
    pages = spark.createDataFrame([(1, "http://b.com/s.mp3"), (2, "http://b.com/a...b"), (3, long), (4, "http://a.com/s.mp3")] + [(5, "http://b.com/")] * 300, "page_id long, url string")
    got = collections.Counter((r.page_id, r.rule, r.verdict, r.pattern_rule) for r in url_filters.url_filter(pages, rules[2:3], rules[:2] + rules[3:], max_inline=inline).collect())
    assert got == {(1, None, "block", "any-mp3"): 1, (2, None, "block", "dots"): 1, (3, None, "block", "track"): 1, (4, "site", "allow", None): 1, (5, None, "allow", None): 300}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version on the documents it is given."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    by, last = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, last, SF)
        if k < 4:
            assert result.columns == docs.columns
        result.write.parquet(str(tmp_path / str(k)))
        by[name] = (last.collect(), (last := spark.read.parquet(str(tmp_path / str(k)))).collect())
    names = list(stages)
    judged = {r.doc_id: r.kept for r in queries.op4_quality_rules(spark, SF).collect()}
    assert {r.doc_id for r in by[names[0]][1]} == {d for d, k in judged.items() if k}
    first = {}
    for r in sorted(by[names[1]][0], key=lambda r: r.doc_id):
        first.setdefault(" ".join(re.split(r"[\x20\x09-\x0D]+", r.text)), r.doc_id)
    assert sorted(r.doc_id for r in by[names[1]][1]) == sorted(first.values())
    comps = brute_components({r.doc_id: r.text for r in by[names[2]][0]})
    assert sorted(r.doc_id for r in by[names[2]][1]) == sorted({c for _, c in comps.values()})
    given = spark.createDataFrame(by[names[3]][0], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(given).collect()}
    assert collections.Counter(r.doc_id for r in by[names[3]][1]) == {d: c for d, c in copies.items() if c}
    encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode
    packed_whole(by[names[4]][1], [(r.doc_id, [*encode(r.text, add_special_tokens=False).ids, 0]) for r in by[names[4]][0]])


def test_pipeline_on_awkward_rows(spark, awkward):
    data = awkward.select("doc_id", "text", "lang", "source", "n_chars", *CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        for table in (data, data.limit(0)):
            rows = stage(spark, table, SF).collect()
            assert rows or table is not data, name
    kept = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, data, SF).collect())
    assert max(kept.values()) == 1 and {d for d, _ in kept} == {1, 3, 5, 6, 7, 8, 9, 10}
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, data, SF).collect()}
    assert near == {1, 3, 4, 5, 6, 8, 9, 10}


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_both_ways(spark, monkeypatch, small):
    import random

    from nearvote.llm import components as cc

    monkeypatch.setattr(cc, "SMALL", small)
    rng = random.Random(2)
    edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(55)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(510, 540)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.comp for r in cc.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    alone = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: root(x) for x in parent if x not in alone}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Pieces without Spark: against plain versions and random inputs."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearvote.llm import exact_dedup, hmm, html_text, packing, pii, quality_rules, substring_dedup, url_filters, words
from nearvote.llm import jaccard_join as jj

TEXT = st.text(alphabet="ab9 .@+-\n\té:/()", max_size=60)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_pii_base_spans_equal_plain_expressions(text):
    import hashlib

    found = [x for x in pii.find(text) if x[0] in pii.BASE]
    counts = [sum(x[0] == k for x in found) for k in pii.BASE]
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found).encode()).hexdigest()
    assert (counts, digest) == pii.brute(text)


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("pay by card 4111 1111 1111 1111 now", ["card"]),
        ("card 4111 1111 1111 1112", []),
        ("IBAN GB82 WEST 1234 5698 7654 32.", ["iban"]),
        ("IBAN GB82 WEST 1234 5698 7654 33.", []),
        ("my ssn is 078-05-1120", ["ssn"]),
        ("part 078-05-1120", []),
        ("at 10.0.0.256 and 10.0.0.255", ["ip"]),
        ("a@b a@b.c x..y@z.co.uk", ["email", "email"]),
        ("call +1 (555) 123-4567", ["phone"]),
        ("", []),
        (None, []),
    ],
)
def test_pii_kinds(text, kinds):
    assert [x[0] for x in pii.find(text) if x[0] in kinds or not kinds] == kinds


def test_pii_context_moves_the_score():
    near, far = pii.find("my card 4111111111111111")[0], pii.find("serial 4111111111111111")[0]
    assert near[3] > far[3]
    assert pii.redact("mail a@b.co now") == "mail <EMAIL> now"


def test_pii_is_linear_on_long_runs():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+" * 100_000, "1.1." * 80_000):
        pii.find(text)


@given(st.lists(st.binary(max_size=8), max_size=40))
@settings(max_examples=200, deadline=None)
def test_trie_holds_every_string_once(keys):
    trie = exact_dedup.Patricia()
    for key in keys:
        node = trie.node(key)
        node[2] = (node[2] or 0) + 1
    found = {}

    def walk(node, prefix):
        prefix += node[0]
        if node[2]:
            found[prefix] = node[2]
        firsts = [c[0][0] for c in node[1].values()]
        assert len(set(firsts)) == len(firsts)
        for child in node[1].values():
            walk(child, prefix)

    walk(trie.root, b"")
    assert found == collections.Counter(keys)


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 5, 60, 700, 20_000])
    histogram = collections.Counter(min(2048, max(1, int(rng.lognormvariate(rng.uniform(4, 7), 1)))) for _ in range(n))
    bins = packing.pack_histogram(dict(histogram))
    got = collections.Counter()
    for times, pieces in bins:
        assert times > 0 and sum(x * k for x, k in pieces) <= 2048
        for x, k in pieces:
            got[x] += times * k
    assert got == histogram
    bound = -(-sum(x * c for x, c in histogram.items()) // 2048)
    assert sum(t for t, _ in bins) <= max(bound + 1, bound * 1.02)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_packing_against_all_partitions(sizes):
    def best(left, bins):
        if not left:
            return len(bins)
        x, found = left[0], 99
        for i, room in enumerate(bins):
            if room >= x:
                found = min(found, best(left[1:], bins[:i] + [room - x] + bins[i + 1 :]))
        return min(found, best(left[1:], [*bins, 20 - x]))

    exact = best(sorted(sizes, reverse=True), [])
    got = sum(t for t, _ in packing.pack_histogram(dict(collections.Counter(sizes)), capacity=20))
    assert got == exact


@given(st.integers(1, 16), st.lists(st.integers(1, 12), min_size=1, max_size=7))
@settings(max_examples=200, deadline=None)
def test_fillings_are_the_undominated_ones(rest, sizes):
    import itertools

    def fits(small, large):  # the pieces of small go into bins the sizes of large
        if not small:
            return True
        return any(r >= small[0] and fits(small[1:], large[:i] + (r - small[0],) + large[i + 1 :]) for i, r in enumerate(large))

    every = {c for n in range(len(sizes) + 1) for c in itertools.combinations(sorted(sizes, reverse=True), n) if sum(c) <= rest}
    best = {c for c in every if not any(d != c and fits(c, d) for d in every)}
    counts = np.bincount(sizes, minlength=17)
    got = [tuple(x for x, k in f for _ in range(k)) for f in packing.fillings(rest, counts)]
    assert set(got) == best and len(got) == len(best)
    assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    fast = packing.token_bytes(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    slow = packing.token_bytes(public_tokenizers.path(packing.TOKENIZER))
    for text in ("", " ", "a b  c\n\n d", "don't 12　x é​ 😀", "x" * 5_000, " " * 12_000 + "y", "".join(map(chr, range(32, 0x500)))):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert fast(text) == ids == slow(text)


@given(st.text(alphabet="aB \t\n\x0bé .", max_size=80))
@settings(max_examples=300, deadline=None)
def test_word_hashes_follow_the_words(text):
    wanted = text.encode().lower().split()
    got = words.word_hashes(text).tolist()
    assert len(got) == len(wanted)
    table = {}
    assert all(table.setdefault(w, h) == h for w, h in zip(wanted, got, strict=True)) and len(set(table.values())) == len(table)


def test_long_texts_hash_in_parts(monkeypatch):
    text = "one two  three\nfour " * 500
    whole = words.word_hashes(text)
    monkeypatch.setattr(words, "PART", 37)
    assert (words.word_hashes(text) == whole).all()


def test_shingles():
    assert len(words.shingles(None)) == len(words.shingles(" \n")) == 0
    assert len(words.shingles("a b")) == 1 and len(words.shingles("a b c d e f")) == 2 and len(words.shingles("a " * 50)) == 1


@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=900))
@settings(max_examples=100, deadline=None)
def test_sketches_never_overstate_the_difference(a, b, both):
    x, y = (np.array(sorted(s | both), dtype=np.uint64) for s in (a, b))
    assert jj.differing(np.frombuffer(jj.sketch(x), np.uint8), np.frombuffer(jj.sketch(y), np.uint8)) <= len(set(x.tolist()) ^ set(y.tolist()))


@pytest.mark.parametrize("light", [0, 6, 40])
def test_linked_sets_share_a_key(light):
    rng = np.random.default_rng(light)
    known = np.array([], dtype=np.uint64)
    for _ in range(400):
        n = int(rng.integers(2, 60))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: max(1, int(len(x) * rng.uniform(0.75, 1)))], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both) and jj.class_of(x) != jj.class_of(y):
            a, b = (set(jj.keys(jj.ordered(s, known, known), light, 80)[0].tolist()) for s in (x, y))
            assert a & b


@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
@settings(max_examples=300, deadline=None)
def test_common_words_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert substring_dedup.common_words(a, b, 99) == table[-1][-1]


@pytest.mark.parametrize("seed", range(30))
def test_best_chain_against_all_predecessors(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 25)
    x = np.array(sorted(rng.randint(0, 60) for _ in range(n)))
    y = np.array([rng.randint(0, 60) for _ in range(n)])
    k, gap = substring_dedup.K, substring_dedup.GAP
    order = sorted(range(n), key=lambda i: (x[i], -y[i]))
    f = {}
    for j in order:
        before = [f[i] - gap * (x[j] - x[i] + y[j] - y[i]) for i in f if x[i] < x[j] and y[i] < y[j]]
        gained = max(before, default=0)
        f[j] = k if gained <= 0 else None
        if f[j] is None:
            f[j] = max(f[i] - gap * (x[j] - x[i] + y[j] - y[i]) + min(k, x[j] - x[i], y[j] - y[i]) for i in f if f.get(i) is not None and i != j and x[i] < x[j] and y[i] < y[j] and abs(f[i] - gap * (x[j] - x[i] + y[j] - y[i]) - gained) < 1e-9)
    found = substring_dedup.chains(x, y)
    assert found and all(a < b and c < d for a, b, c, d in found)
    assert {(int(x[i]), int(y[i])) for i in range(n)} >= {(a, c) for a, _, c, _ in found}


def test_a_collinear_run_is_one_chain():
    at, end = np.arange(0, 200, 5), 195 + substring_dedup.K
    assert substring_dedup.chains(at, at + 40) == [(0, end, 40, end + 40)]
    far = np.concatenate([at, at + 1_000])
    assert sorted(substring_dedup.chains(far, far)) == [(0, end, 0, end), (1_000, 1_000 + end, 1_000, 1_000 + end)]


def test_forward_equals_the_sum_over_paths():
    import itertools

    rng = np.random.default_rng(3)
    start, move, emit = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 3, 2)
    texts = [np.array(s) for s in ([0], [1, 2, 0], [2, 2], [0, 1, 1, 2, 0])]
    batch = hmm.Batch(texts)
    got = hmm.forward(batch, start, move, np.ascontiguousarray(emit.T))[0]
    for place, i in enumerate(batch.order):
        s = texts[i]
        total = sum(start[p[0]] * emit[p[0], s[0]] * np.prod([move[p[t - 1], p[t]] * emit[p[t], s[t]] for t in range(1, len(s))]) for p in itertools.product(range(2), repeat=len(s)))
        assert abs(got[place] - np.log10(total)) < 1e-9
    first, moves, emits, _ = hmm.expected(hmm.Batch(texts), start, move, np.ascontiguousarray(emit.T))
    assert abs(first.sum() - 4) < 1e-9 and abs(moves.sum() - sum(len(s) - 1 for s in texts)) < 1e-9 and abs(emits.sum() - sum(map(len, texts))) < 1e-9
    assert np.allclose(emits.sum(0), np.bincount(np.concatenate(texts), minlength=3))


def test_long_sequences_have_the_same_counts():
    rng = np.random.default_rng(5)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 7, 3)
    emit_t = np.ascontiguousarray(emit.T)
    for n, stretch in ((1, 4), (4, 4), (5, 4), (203, 10), (200, 10), (50, 60), (9, 1)):
        text = rng.integers(0, 7, n)
        wanted = hmm.expected(hmm.Batch([text]), start, move, emit_t)
        for x, y in zip(hmm.expected_of_long(text, start, move, emit_t, stretch), wanted, strict=True):
            assert np.allclose(x, y, rtol=1e-9, atol=1e-12)


@given(st.text(alphabet="aB é\n\x0b\x1c\u2003", max_size=40), st.integers(1, 9))
def test_words_of_stretches(text, stretch):
    wanted = [w for w in re.split(r"[\x20\x09-\x0D]+", text.replace("B", "b")) if w]
    assert [w.decode() for part in hmm.words(text, stretch) for w in part] == wanted


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    texts = [np.repeat(rng.integers(0, 2), 40) * 3 + rng.integers(0, 3, 40) for _ in range(40)]
    counts = np.bincount(np.concatenate(texts), minlength=6).astype(float)
    model, seen = hmm.start_model(counts, 2), []
    for _ in range(6):
        s, m, e, total = hmm.expected(hmm.Batch(texts), model[0], model[1], np.ascontiguousarray(model[2].T))
        seen.append(total)
        model = (s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True))
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>w", "- x\n- y\n  - z\n\nw"),
        ("<ol><li>x<li>y</ol>", "1. x\n2. y"),
        ("<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>a<td>22</table>", "Name  N\nab    1\na     22"),
        ("<table><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("a<script>x<b></script>b<!-- c -->d<style>e</style>", "abd"),
        ("a<!-- never closed <p>b", "a"),
        ("<div hidden>a<div>b</div></div>c", "c"),
        ("<p style='color:red; display : NONE'>a</p>b", "b"),
        ("1 < 2 &amp; 3 &gt; 2", "1 < 2 & 3 > 2"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<td>no table</td> x", "no table x"),
        ("<a href='>'>q</a></p></div>", "q"),
        ("<title>t</title>a", "a"),
        ("a <b> b</b>\n c", "a b c"),
    ],
)
def test_pages(page, text):
    assert html_text.render(page) == text


@given(st.text(alphabet="<>/abp!-\"'= &;\n", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_rendered(page):
    html_text.render(page)


def test_deep_pages():
    html_text.render("<div>" * 20_000 + "x")
    html_text.render("<table><tr><td>" * 300 + "x")
    html_text.render("<ul><li>" * 3_000 + "x")


def test_rules_are_learned_in_order():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        row = {f: rng.random() for f in quality_rules.FEATURES}
        row["bad"] = int(row["symbol_ratio"] > 0.7 or row["mean_word"] <= 0.1 and row["n_words"] > 0.5)
        rows.append(row)
    rules = quality_rules.learn_list(rows)
    hit = [any(r.covers(row) for r in rules) for row in rows]
    assert rules and all(r.precision >= 0.97 for r in rules)
    assert sum(h == bool(r["bad"]) for h, r in zip(hit, rows, strict=True)) > 0.95 * len(rows)
    assert quality_rules.learn_list([]) == [] == quality_rules.learn_list([dict(r, bad=0) for r in rows])


def test_rules_of_urls():
    rule = url_filters.site_rule("example.com/de/", True)
    assert rule.tokens == ("example", "com", "de") and re.search(rule.pattern, "a.example.com/de/x") and not re.search(rule.pattern, "badexample.com/de/")
    assert url_filters.site_rule("net/ab", True).tokens == ("net",)


def test_seeds_of_a_shared_run_meet():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 2**63, substring_dedup.REACH - 1, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 2**63, 40, dtype=np.uint64), shared, rng.integers(0, 2**63, 40, dtype=np.uint64)]) for _ in range(2))
        assert set(substring_dedup.minimizers(a)[0].tolist()) & set(substring_dedup.minimizers(b)[0].tolist())


def test_anchors_pass_between_batches():
    rows = [(1, 5, 0), (1, 7, 3), (2, 1, 1), (2, 2, 4), (2, 2, 9), (3, 4, 4)]
    want = [(7, 3, 5, 0), (2, 4, 1, 1), (2, 9, 1, 1)]
    for cut in range(len(rows) + 1):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(3)], names=["h", "doc", "at"]) for part in (rows[:cut], rows[cut:])]
        got = [tuple(b.column(i)[j].as_py() for i in range(4)) for b in substring_dedup._anchors(iter(batches)) for j in range(b.num_rows)]
        assert got == want


@pytest.mark.parametrize("gap, line", [(16, 12), (20, 8), (20, 16), (16, 16)])
def test_exact_runs_survive_short_shared_lines(gap, line):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
        run, before, after = new(51), new(line), new(line)
        a, b = (np.concatenate([new(30), before, new(gap), run, new(gap), after, new(30)]) for _ in range(2))
        (ha, pa_), (hb, pb) = substring_dedup.minimizers(a), substring_dedup.minimizers(b)
        owned = dict(zip(hb.tolist(), pb.tolist(), strict=True))
        pairs = [(int(x), owned[h]) for h, x in zip(ha.tolist(), pa_.tolist(), strict=True) if h in owned]
        start = 30 + line + gap
        rows = []
        for n, (xs, ys) in enumerate(substring_dedup.linked(*np.array(pairs).T)):
            rows += [(x0, x1, 1, y0, y1, same, n) for x0, x1, y0, y1, same in substring_dedup.parts(a.tolist(), xs, b.tolist(), ys, 0.8)]
        found = substring_dedup.passages(2, rows, 50)
        assert any(f[1] <= start and f[2] >= start + 51 for f in found)


def test_parts_of_one_chain_join_only_where_they_touch():
    row = lambda s, e, chain: (s, e, 1, s, e, e - s, chain)
    assert substring_dedup.passages(2, [row(0, 30, 1), row(33, 60, 1)], 50) == []
    assert [f[1:3] for f in substring_dedup.passages(2, [row(0, 30, 1), row(33, 60, 2)], 50)] == [(0, 60)]
    assert [f[1:3] for f in substring_dedup.passages(2, [row(0, 30, 1), row(25, 45, 2), row(44, 70, 1)], 50)] == [(0, 70)]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><p>text", "text"),
        ("<head><title>t</title> text", "text"),
        ("<head><meta charset=x><style>s</style><div>a</div>b", "a\nb"),
        ("<ul><li hidden>a<li>b</ul>more", "- b\n\nmore"),
        ("<div><p hidden>a</div><p>b</p>more", "b\n\nmore"),
        ("<dl><dt hidden>a<dd>b</dl>c", "b\n\nc"),
        ("<table><tr hidden><td>a<tr><td>b</table>c", "b\n\nc"),
        ("<table><tr><td hidden>a<td>b<tr><td>c</table>", "b\nc"),
        ("<p><span hidden>a</p>b", "b"),
        ("<a href=x>a<span hidden>b</a>c", "ac"),
        ("<span hidden><span>a</span>b</span>c", "c"),
        ("<div hidden><p>a<br><ul><li>b</div>c", "c"),
        ("<p>a<b hidden>b<p>c</b>d", "a\n\nd"),
        ("<div>x<template></div>a</template>b</div>c", "xb\nc"),
        ("<svg/>a<svg><path d=1 /><g></svg>b<svg><g><p>c", "ab\n\nc"),
        ("<div hidden>a</body>b", ""),
    ],
)
def test_unseen_elements_end_where_the_tree_ends_them(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n" + " " * 12_000, "<|endoftext |>"])
def test_added_tokens_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    ids = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert packing.token_bytes(path, public_tokenizers.path(packing.RANKS))(text) == ids == packing.token_bytes(path)(text)


@pytest.mark.parametrize("step, size", [(10, 60), (12, 60), (8, 100), (10, 200)])
def test_passages_with_edits_at_a_fixed_step_are_found(step, size):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
        run = new(size)
        other = run.copy()
        other[step - 1 :: step] = new(len(other[step - 1 :: step]))
        a, b = np.concatenate([new(70), other, new(70)]), np.concatenate([new(90), run, new(70)])
        (ha, xa), (hb, xb) = substring_dedup.minimizers(a), substring_dedup.minimizers(b)
        owned = dict(zip(hb.tolist(), xb.tolist(), strict=True))
        pairs = [(int(x), owned[h]) for h, x in zip(ha.tolist(), xa.tolist(), strict=True) if h in owned]
        rows = [(x0, x1, 1, y0, y1, same, n) for n, (xs, ys) in enumerate(substring_dedup.linked(*np.array(pairs).T)) for x0, x1, y0, y1, same in substring_dedup.parts(a.tolist(), xs, b.tolist(), ys, 0.8)]
        found = substring_dedup.passages(2, rows, 50)
        assert any(f[2] - f[1] >= 0.9 * size and f[8] >= 0.8 for f in found)


def test_chunks_resolve_seeds_like_one():
    rng = np.random.default_rng(5)
    shared = [" ".join(f"s{k}w{i}" for i in range(30)) for k in range(3)]
    texts = [(int(d), 0, " ".join([shared[rng.integers(3)], *(f"r{rng.integers(99)}" for _ in range(20)), shared[rng.integers(3)]])) for d in rng.permutation(40)]
    columns = [pa.array(c) for c in zip(*texts, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc", "part", "text"])
    found = []
    for chunk in (1 << 40, 100):
        seeds = pa.Table.from_batches(substring_dedup._seeds(iter([batch]), chunk)).sort_by([("h", "ascending"), ("doc", "ascending"), ("at", "ascending")])
        anchors = pa.Table.from_batches(substring_dedup._anchors(iter(seeds.to_batches(max_chunksize=97))))
        found.append({(r["doc"], r["at"]) for r in anchors.to_pylist()})
        assert all(r["owner"] < r["doc"] for r in anchors.to_pylist())
    assert found[0] == found[1]
    hot = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array([0] * 900), pa.array([shared[0]] * 900)], names=["doc", "part", "text"])
    sent = pa.Table.from_batches(substring_dedup._seeds(iter([hot])))
    assert sent["owner"].null_count == len(substring_dedup.minimizers(substring_dedup.word_hashes(shared[0]))[0])


def test_words_that_were_not_fetched():
    rng = np.random.default_rng(1)
    for _ in range(50):
        new = lambda n: rng.integers(0, 2**31, n)
        run = new(400)
        other = np.concatenate([run[:150], new(int(rng.integers(0, 9))), run[int(rng.integers(150, 160)) :]])
        a, b = np.concatenate([new(70), run, new(70)]), np.concatenate([new(33), other, new(70)])
        (ha, xa), (hb, xb) = (substring_dedup.minimizers(t.astype(np.uint64)) for t in (a, b))
        owned = dict(zip(hb.tolist(), xb.tolist(), strict=True))
        pairs = np.array([(int(x), owned[h]) for h, x in zip(ha.tolist(), xa.tolist(), strict=True) if h in owned])
        for xs, ys in substring_dedup.linked(*pairs.T):
            gaps, size = substring_dedup.gaps_of(xs, ys), substring_dedup.BLOCK
            blocks = tuple({n: t[n * size : (n + 1) * size].astype(np.uint32).tobytes() for n in substring_dedup.wanted_blocks(s, gaps) if n * size < len(t)} for t, s in ((a, xs), (b, ys)))
            text, base = substring_dedup.sides_of(blocks, xs, ys)
            got = substring_dedup.parts(text[0], [x - base[0] for x in xs], text[1], [y - base[1] for y in ys], 0.8)
            whole = substring_dedup.parts(a.tolist(), xs, b.tolist(), ys, 0.8)
            assert [(p[0] + base[0], p[1] + base[0], p[2] + base[1], p[3] + base[1], p[4]) for p in got] == whole
            assert len(blocks[0]) < len(a) / size


@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=300, deadline=None)
def test_extensions_keep_the_identity(a, b):
    x, y, same = substring_dedup.extension(a, b, 0.8)
    exact = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    assert x + y >= 2 * exact and 2 * same >= 0.8 * (x + y) - 1e-9
    assert same <= substring_dedup.common_words(a[:x], b[:y], 99)


@pytest.mark.parametrize(
    "pattern, tokens",
    [
        (r"^([^/?#]*[.-])?cheap[.-]pills([.-][^/?#]*)?(/.*)?$", ("cheap", "pills")),
        (r"^[^/?#]*/([^?#]*/)?cart(/.*)?$", ("cart",)),
        (r"ads\d+\.example\.com/", ("example", "com")),
        (r"/track/v", ("track",)),
        (r"^x(yz)?/", ()),
        (r"^(foo|bar)\.com/", ("com",)),
        (r"(?:/a)+b", ()),
        (r".*", ()),
        (r"[", ()),
    ],
)
def test_tokens_come_from_the_expression(pattern, tokens):
    assert url_filters.literal_tokens(pattern) == tokens


@given(st.lists(st.sampled_from(["a", "b", "/", ".", "-", "(a)?", "(/b)*", "[./]", "[ab]", "(-|a)", "^", "$"]), max_size=7), st.text(alphabet="ab/.-", max_size=12))
@settings(max_examples=500, deadline=None)
def test_tokens_stand_in_all_that_the_expression_fits(parts, url):
    import re

    pattern = "".join(parts)
    if re.search(pattern, url):
        assert set(url_filters.literal_tokens(pattern)) <= set(re.split("[^a-z0-9]+", url))

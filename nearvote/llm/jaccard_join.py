"""N-gram Jaccard join: size-aware, light sets by subsets, heavy by lists.

Documents are sets of distinct 5-word shingles (64-bit hashes); two link when
100 * |intersection| >= 80 * |union|. Then the intersection holds at least
``ceil(0.8 n)`` of either set of size n, so under any one order of shingles
the first ``n - ceil(0.8 n) + c`` of both sets share at least c.

 * light sets (n <= boundary): the 2-subsets of that prefix (c = 2) are the
   keys; a pair must agree on one, and pairs of shingles are rarely shared by
   chance.
 * heavy sets: each shingle of the prefix (c = 1) is a key, and its inverted
   list is scanned. Light sets within reach of a heavy one (n >= 0.8 *
   boundary) stand in the lists too.
 * the boundary minimises the cost of both ways, taken from the histogram of
   set sizes and the mean length of lists.

The order puts rare shingles first: a first pass over all documents counts how
long the lists would be in hash order, and the (at most ``COUNTERS``) shingles
with the longest lists, a broadcast of a proven size, come last by length. The
order decides cost only, never the result.

Without expanding groups into pairs:
 1. Equal sets are one class; all the rest works on classes.
 2. Each list links its members to a centre only, and, where these are still
    apart, to their predecessor; then one member of each component to one of
    another. These pairs are verified and give components.
 3. Pairs that share a list and whose components differ are then all verified,
    whatever their number, so no link between components is missed; pairs
    within a component cannot change it. Lists are split by size band, and a
    pair is made at the first key that it shares, not at every one.

Before whole sets are compared, sizes, positions and a parity sketch of each set
(a bit or two per shingle) bound what a pair can share; they drop only pairs that cannot link.

Hashes: shingles and classes are 64-bit (class identity also holds the size);
two different texts collide with probability about 2**-64 a pair.

Defined cases: a null or empty text has no shingles and links with nothing; a
null doc_id is a document of its own whose component is that of its class (the
smallest id that is not null, else null); rows with the same doc_id are judged
each; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearvote.llm.common import BROADCAST_IDS, discard, gives_back, materialize, most_frequent
from nearvote.llm.components import components
from nearvote.llm.words import mix, shingles

PERCENT = 80
COUNTERS = 1 << 18
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def frequent(keyed: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The (at most ``limit``) shingles in the longest lists, sorted, and the
    log2 of the lists' lengths; ``keyed`` has an array of shingles per set."""
    lengths = keyed.select(F.explode("keys").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    lengths = materialize(lengths)
    top = most_frequent(lengths, limit).toPandas()
    discard(lengths)
    tokens = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.ceil(4 * np.log2(top["n"].to_numpy(dtype=np.float64)))[order].astype(np.uint8)


def ordered(tokens: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Tokens by rising count, then hash: one order for all sets."""
    if not len(known):
        return tokens
    at = np.searchsorted(known, tokens)
    at[at == len(known)] = 0
    common = known[at] == tokens
    if not common.any():
        return tokens
    often = tokens[common]
    return np.concatenate([tokens[~common], often[np.argsort(ranks[at[common]], kind="stable")]])


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash bucket, a bit or two per token. Where two
    sketches differ the sets differ: |x ^ y| is at least the number of such bits."""
    m = 512
    while m < len(tokens):
        m *= 2
    bits = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ, the longer sketch folded to the length of the shorter."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def coarse(sketch_: bytes) -> np.ndarray:
    """A sketch folded to 512 bits, as 8 longs."""
    bits = np.frombuffer(sketch_, np.uint8)
    while len(bits) > 64:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits.view(np.int64)


def class_of(tokens: np.ndarray) -> int:
    """Signed 64-bit id of a set, the size worked in."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).view(np.int64))


def front(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that a prefix can reach when common ones give way."""
    n = len(tokens)
    return tokens[: 5 * (n - _least(n, percent) + 1) // 4 + 1]


@gives_back
def _fronts(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        texts = batch.column(0)
        for lo in range(0, batch.num_rows, 500):
            out = []
            for text in texts[lo : lo + 500]:
                s = shingles(text.as_py())
                c = class_of(s) if len(s) else None
                if c is not None and c not in seen:
                    seen.add(c)
                    out.append(front(s, percent).view(np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["keys"])


def keys(tokens: np.ndarray, light: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of an ordered set, and their positions (-1: a subset)."""
    n = len(tokens)
    need = _least(n, percent)
    out, at = [], []
    if n <= light and need >= 2:
        p = tokens[: n - need + 2]
        i, j = np.triu_indices(len(p), 1)
        out.append(mix(mix(p[i]) * _PAIR + p[j]))
        at.append(np.full(len(i), -1, dtype=np.int64))
    if n > light or n >= percent * light / 100:
        p = tokens[: n - need + 1]
        out.append(p)
        at.append(np.arange(len(p), dtype=np.int64))
    if not out:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(at)


LOCAL_DDL = "doc_id long, n long, cls long, keys array<long>, at array<long>, sketch binary, coarse array<long>"


@gives_back
def _local(batches: Iterator[pa.RecordBatch], known: np.ndarray, ranks: np.ndarray, light: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo in range(0, len(ids), 500):
            n, cls, k, at, sk, co = [], [], [], [], [], []
            for text in texts[lo : lo + 500]:
                s = shingles(text.as_py())
                c = class_of(s) if len(s) else None
                n.append(len(s))
                cls.append(c)
                if c is None or c in seen:  # of equal sets in a task, one stands in the lists
                    k.append(None)
                    at.append(None)
                    sk.append(None)
                    co.append(None)
                    continue
                seen.add(c)
                a, b = keys(ordered(s, known, ranks), light, percent)
                k.append(a.view(np.int64))
                at.append(b)
                sk.append(sketch(s))
                co.append(coarse(sk[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo : lo + 500], pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(k, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64())), pa.array(sk, pa.binary()), pa.array(co, pa.list_(pa.int64()))],
                names=["doc_id", "n", "cls", "keys", "at", "sketch", "coarse"],
            )


SHARED_DDL = "key long, cls long, n long, at long, prev long, centre long"


@gives_back
def _scan(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of lists with several classes, with predecessor and centre.

    Input is sorted by (key, n, cls). The centre is the first member whose size
    is still within reach; one row of state passes from batch to batch.
    """
    last: tuple | None = None  # (key, cls, n, at, prev, centre, centre_n, sent)
    for batch in batches:
        rows: list[tuple] = []
        # Only members of lists with company are looked at one by one; the
        # first and the last row of a batch may have theirs in another batch.
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        near = np.ones(len(key), dtype=bool)
        near[1:-1] = same[1:] | same[:-1]
        batch = batch.filter(pa.array(near))
        for key, n, cls, at in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "cls", "at")), strict=True):
            if last is None or last[0] != key:
                last = (key, cls, n, at, None, cls, n, False)
                continue
            if last[1] == cls:
                continue
            _, pcls, pn, pat, pprev, centre, cn, sent = last
            if not sent:
                rows.append((key, pcls, pn, pat, pprev, None if centre == pcls else centre))
            prev = pcls if 100 * pn >= percent * n else None
            if 100 * cn < percent * n:
                centre, cn = cls, n
            rows.append((key, cls, n, at, prev, None if centre == cls else centre))
            last = (key, cls, n, at, prev, centre, cn, True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "cls", "n", "at", "prev", "centre"])


def boundary(sizes: dict[int, int], mean_list: float, percent: int = PERCENT, scan: float = 0.25) -> int:
    """Largest size that is cheaper by 2-subsets than by inverted lists.

    A subset costs the row it makes; a list entry costs its row and the scan of
    the list it stands in. ``sizes``: number of classes by set size.
    """
    best, cost, spent, rest = 0, None, 0.0, 0.0
    each = {n: (c * (n - _least(n, percent) + 2) * (n - _least(n, percent) + 1) / 2, c * (n - _least(n, percent) + 1) * (1 + scan * mean_list)) for n, c in sizes.items()}
    rest = sum(heavy for _, heavy in each.values())
    for n in [0, *sorted(each)]:
        if n:
            spent += each[n][0]
            rest -= each[n][1]
        if cost is None or spent + rest < cost:
            cost, best = spent + rest, n
    return best


def band(n: Column, percent: int, most: int = 1 << 40) -> Column:
    """Number of a size band; sizes that can link are at most one band apart."""
    steps, at = [], 1
    while at < most:
        steps.append(at)
        at = at * 100 // percent + 1
    return F.size(F.filter(F.array(*(F.lit(t).cast("long") for t in steps)), lambda t: t <= n))


GROUP = 2_000
#: Keys before a shared one that tell whether a pair has met already.
PRIOR = 8
#: Members of a list (and size band) that the closing join deals to one task.
PART = 512
#: Before all pairs are tried: rounds that try to join components by a few pairs
#: of each list, how many, and of how long lists.
BRIDGES, PICKS, LONG = 2, 8, 16


@gives_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the whole set for each comparison group that a class is in."""
    for batch in batches:
        want, parts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        rows: list[tuple] = []
        held = 0
        for c, groups, text in zip(want, parts, texts, strict=True):
            s = shingles(text.as_py())
            if not len(s) or class_of(s) != c:  # another row with the same doc_id
                continue
            raw = s.tobytes()
            for g in groups:
                rows.append((g["a"], g["salt"], g["a"] != c, c, raw))
                held += len(raw)
                if held > 8 << 20:
                    yield _set_batch(rows)
                    rows, held = [], 0
        if rows:
            yield _set_batch(rows)


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["a", "salt", "member", "cls", "tokens"])


@gives_back
def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members against the head of their group; sorted by (a, salt, member)."""
    at, head = None, None
    for batch in batches:
        a, salt, member, cls = (batch.column(c).to_pylist() for c in range(4))
        tokens = batch.column(4)
        good: list[tuple[int, int]] = []
        for i, key in enumerate(zip(a, salt, strict=True)):
            s = np.frombuffer(tokens[i].as_buffer(), dtype=np.uint64)
            if not member[i]:
                at, head = key, s.copy()
            elif key == at:
                both = _common(s, head)
                if 100 * both >= percent * (len(s) + len(head) - both):
                    good.append((a[i], cls[i]))
        if good:
            x, y = zip(*good, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _common(s: np.ndarray, t: np.ndarray) -> int:
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int(np.count_nonzero(t[at] == s))


def _cards(local: DataFrame) -> DataFrame:
    """cls, n and sketches, one row per class."""
    return local.where(F.col("sketch").isNotNull()).groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "sketch", "coarse")))


def _room(percent: int, n1: str, n2: str, coarse1: str, coarse2: str) -> Column:
    """Whether sizes and coarse sketches leave room for a link (never a false no)."""
    apart = sum((F.bit_count(F.col(coarse1)[i].bitwiseXOR(F.col(coarse2)[i])) for i in range(8)), F.lit(0))
    total = F.col(n1) + F.col(n2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((total - apart) * (100 + percent) >= 2 * percent * total)


@gives_back
def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches leave room for a link (never a false no)."""
    for batch in batches:
        n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        k1, k2 = batch.column(4), batch.column(5)
        apart = np.array([differing(np.frombuffer(k1[i].as_buffer(), np.uint8), np.frombuffer(k2[i].as_buffer(), np.uint8)) for i in range(batch.num_rows)], dtype=np.int64)
        both = (n1 + n2 - apart) / 2
        keep = pa.array(both * (100 + percent) >= percent * (n1 + n2))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _links(pairs: DataFrame, base: DataFrame, local: DataFrame, percent: int) -> DataFrame | None:
    """Pairs of ``pairs`` (a, b) that link, by their whole sets; None for none.

    Each set is made where its text is read, once for each group it stands in:
    with the b's of an a, in groups of about ``GROUP``, the a at their head.
    """
    pairs = materialize(pairs)
    total = pairs.count()
    if not total:
        return None
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    members = pairs.join(heads, "a").select(F.col("b").alias("cls"), "a", F.pmod("b", "salts").alias("salt"))
    leading = heads.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    parts = members.union(leading).groupBy("cls").agg(F.collect_list(F.struct("a", "salt")).alias("parts"))
    first = local.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("id"))
    owners = materialize(first.join(parts, "cls").select("id", "cls", "parts"))
    texts = base.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "text").join(F.broadcast(owners) if total <= BROADCAST_IDS else owners, "id").select("cls", "parts", "text")
    sets = texts.mapInArrow(_sets, "a long, salt long, member boolean, cls long, tokens binary")
    grouped = sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    links = materialize(grouped.mapInArrow(lambda it: _verify(it, percent), "a long, b long"))
    discard(pairs)
    discard(owners)
    return links


def jaccard_components(docs: DataFrame, percent: int = PERCENT, light: int | None = None, counters: int = COUNTERS) -> DataFrame:
    """doc_id, n_shingles, component_id per input row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known, ranks = frequent(base.select("text").mapInArrow(lambda it: _fronts(it, percent), "keys array<long>"), counters)
    if light is None:
        # Sizes as the planner guesses them: a word is about six characters.
        guess = base.where(F.length("text") > 0).groupBy(F.least(F.ceil(F.length("text") / 6), F.lit(4_096)).cast("int").alias("n")).agg(F.count("*").alias("c"))
        sizes = {r["n"]: r["c"] for r in guess.collect()}
        light = boundary(sizes, 1.0 + np.exp2(ranks / 4).sum() / max(1, sum(n * c for n, c in sizes.items())), percent)
    local = materialize(base.mapInArrow(lambda it: _local(it, known, ranks, light, percent), LOCAL_DDL))

    lists = local.where(F.col("keys").isNotNull()).select("cls", "n", F.explode(F.arrays_zip("keys", "at")).alias("k")).select(F.col("k.keys").alias("key"), "n", "cls", F.col("k.at").alias("at"))
    shared = materialize(lists.repartition("key").sortWithinPartitions("key", "n", "cls").mapInArrow(lambda it: _scan(it, percent), SHARED_DDL))
    slim = materialize(local.select("doc_id", "n", "cls", "sketch", "coarse"))
    discard(local)
    local = slim
    cards = materialize(_cards(local).join(shared.select("cls").distinct(), "cls", "left_semi"))
    one = cards.select(*(F.col(c).alias(f"{c}1") for c in cards.columns))
    two = cards.select(*(F.col(c).alias(f"{c}2") for c in cards.columns))
    fits = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")

    def likely(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(one, F.col("a") == F.col("cls1")).join(two, F.col("b") == F.col("cls2")).where(fits)
        return sized.select("a", "b", "n1", "n2", "sketch1", "sketch2").mapInArrow(lambda it: _near(it, percent), "a long, b long")

    comps: DataFrame | None = None  # (id, comp) so far; classes of their own are left out

    def merge(links: DataFrame | None) -> None:
        nonlocal comps
        if links is not None:
            before = comps
            old = before.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")) if before is not None else None
            comps = components(links if old is None else old.union(links))
            if before is not None:
                discard(before)

    def placed(rows: DataFrame, cls: str, name: str) -> DataFrame:
        if comps is None:
            return rows.withColumn(name, F.col(cls))
        named = comps.select(F.col("id").alias(f"{name}_of"), F.col("comp").alias(f"{name}_is"))
        return rows.join(named, F.col(cls) == F.col(f"{name}_of"), "left").withColumn(name, F.coalesce(f"{name}_is", cls)).drop(f"{name}_of", f"{name}_is")

    def ordered_pairs(other: str) -> DataFrame:
        return shared.where(F.col(other).isNotNull()).select(F.col(other).alias("a"), F.col("cls").alias("b")).distinct()

    # Members and centres; then members and predecessors still apart.
    merge(_links(likely(ordered_pairs("centre")), base, local, percent))
    apart = placed(placed(ordered_pairs("prev"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    merge(_links(likely(apart), base, local, percent))

    def apart_still(lists: DataFrame) -> DataFrame:
        """Members of lists that have several components."""
        member = placed(lists.select("key", "cls", "n", "at"), "cls", "comp")
        mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        return materialize(member.join(mixed, "key", "left_semi").join(cards.select("cls", "coarse"), "cls"))

    # In each longer list, a few members of a component with some of the next
    # component; of these pairs, a few for each two components.
    long_keys = shared.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= LONG).select("key")
    longer = materialize(shared.join(long_keys, "key", "left_semi"))
    for turn in range(BRIDGES):
        open_ = apart_still(longer)
        by_list = F.array(*(F.min(F.struct(F.xxhash64("cls", "key", F.lit(PICKS * turn + i)).alias("h"), F.struct("cls", "n", "coarse").alias("m")))["m"] for i in range(PICKS)))
        chosen = open_.groupBy("key", "comp").agg(by_list.alias("picks")).select("key", "comp", F.posexplode(F.array_distinct("picks")).alias("pick", "p"))
        order = W.partitionBy("key", "pick").orderBy(F.xxhash64("comp", "key", "pick", F.lit(turn)))
        steps = chosen.select("p", F.lead("p").over(order).alias("q")).where(F.col("q").isNotNull() & _room(percent, "p.n", "q.n", "p.coarse", "q.coarse"))
        pairs = steps.select(F.least("p.cls", "q.cls").alias("a"), F.greatest("p.cls", "q.cls").alias("b")).distinct()
        sides = placed(placed(likely(pairs), "a", "ca"), "b", "cb")
        few = sides.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.array(*(F.min(F.struct(F.xxhash64("a", "b", F.lit(8 * turn + i)).alias("h"), "a", "b")) for i in range(8))).alias("few"))
        links = _links(few.select(F.explode("few").alias("p")).select("p.a", "p.b").distinct(), base, local, percent)
        discard(open_)
        merge(links)
        if links is None or links.isEmpty():
            break

    # All pairs that share a list and are still apart, once each: a pair is left
    # out where one of the ``PRIOR`` keys before this one is shared as well. At
    # the first key that the pair shares there is none, so no pair is lost.
    discard(longer)
    open_ = apart_still(shared)
    before = F.collect_list("key").over(W.partitionBy("cls").orderBy("at", "key").rowsBetween(-PRIOR, -1))
    members = materialize(open_.select("*", before.alias("prior"), band(F.col("n"), percent).alias("band")))
    names = ("cls", "n", "at", "comp", "coarse", "prior")
    x, y = (members.select("key", *(F.col(c).alias(f"{c}{i}") for c in names), own.alias("band")) for i, own in ((1, F.explode(F.array(F.col("band"), F.col("band") + 1))), (2, F.col("band"))))
    # A long list is one task's only in parts of about ``PART`` members, each met by all.
    crowds = materialize(members.groupBy("key", "band").agg(F.ceil(F.count("*") / PART).alias("salts")).where("salts > 1"))
    x = x.join(crowds, ["key", "band"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1))).drop("salts")
    y = y.join(crowds, ["key", "band"], "left").withColumn("salt", F.coalesce(F.pmod("cls2", "salts"), F.lit(0).cast("long"))).drop("salts")
    # What sets can share at most from the shared position on, and must share.
    most = F.when((F.col("at1") < 0) | (F.col("at2") < 0), F.least("n1", "n2")).otherwise(F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")))
    enough = most * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))
    ordered_ = (F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("cls1") < F.col("cls2"))
    rest = x.join(y, ["key", "band", "salt"]).where(ordered_ & (F.col("comp1") != F.col("comp2")) & enough & _room(percent, "n1", "n2", "coarse1", "coarse2") & ~F.arrays_overlap("prior1", "prior2"))
    merge(_links(likely(rest.select(F.col("cls1").alias("a"), F.col("cls2").alias("b")).distinct()), base, local, percent))

    for done in (open_, members, crowds, shared, cards):
        discard(done)
    named = placed(local.select("doc_id", F.col("n").alias("n_shingles"), "cls"), "cls", "comp")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

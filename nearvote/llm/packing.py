"""Best-fit packing of documents into training sequences by bin completion.

A document is its token ids and one end id. Documents longer than a sequence
are cut into full pieces (the first piece may be shorter); shorter ones stay
whole. Pieces are integers from 1 to ``capacity``, so all that packing depends
on is how many pieces there are of each length: a histogram of at most
``capacity`` rows, which is all that reaches the driver, at any corpus size.

Bin completion runs on that histogram. A bin is built around the largest piece
left, with each of the undominated fillings of the rest in turn, the least waste
first: those where no piece left out could be added, or take the place of some
that waste more. They are made one at a time, so none is left out and few
are made. Choosing a filling sets as many equal bins at once as the counts
allow, then fewer. Depth-first branch and bound starts from best-fit decreasing
as incumbent, and cuts off a branch when its bins and the lower bound of the
rest reach the incumbent. It ends when the lower bound is reached, when all is
searched, or after ``nodes`` nodes (a parameter: every piece is packed either
way, only optimality may be given up).

The patterns become slots by length: the r-th piece of a length goes to a place
that arithmetic gives. Pieces of one length are ranked within buckets of about
``BUCKET`` rows and offset by the counts of buckets before, so a length with a
third of all pieces is ranked in parallel.

Defined cases: a null or empty text is one end id; rows with the same doc_id
are packed each; a null doc_id is kept; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearvote.llm.common import gives_back, materialize

CAPACITY = 2048
END = 0
NODES, STEPS = 2_000, 200
BUCKET = 50_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: White space this long is left to the tokenizer, which does not backtrack on it.
_BLANK = re.compile(r"\s{10000}")


@lru_cache(maxsize=2)
def token_bytes(path: str, ranks: str | None = None) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian unsigned 32-bit bytes.

    ``path`` is a file of the ``tokenizers`` library and decides the ids.
    ``ranks`` may name a file of the same vocabulary for ``tiktoken``, which
    gives the same ids (compared for every code point) in a third of the time.
    Texts that contain an added token of the file are left to ``tokenizers``.
    A worker builds the function once for all its tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def slow(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return lambda text: slow(text) if _BLANK.search(text) or any(t in text for t in added) else array("I", fast(text)).tobytes()


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


@gives_back
def _cut(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, end = token_bytes(path, ranks), array("I", [END]).tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            ids = (encode(text) if text else b"") + end
            n = len(ids) // 4
            at, piece = 0, 0
            while at < n:
                to = at + (n % capacity or capacity) if at == 0 else at + capacity
                rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                at, piece = to, piece + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)


def cut(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document, of at most ``capacity`` ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _cut(it, path, ranks, capacity), PIECES_DDL)


Filling = tuple[tuple[int, int], ...]  # (length, how many) beside the largest


def _fit(counts: np.ndarray) -> np.ndarray:
    """fit[r]: the largest length left of at most r, 0 where none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _complete(first: tuple[int, ...], rest: int, counts: np.ndarray, fit: np.ndarray) -> Filling:
    """Add the largest that fits until nothing fits: a maximal filling."""
    used: dict[int, int] = {}
    for x in first:
        used[x] = used.get(x, 0) + 1
        rest -= x
    r = rest
    while r > 0:
        x = int(fit[r])
        free = int(counts[x]) - used.get(x, 0) if x else 0
        if not x:
            break
        if free > 0:
            k = min(free, rest // x)
            used[x] = used.get(x, 0) + k
            rest -= k * x
            r = min(rest, x - 1) if free == k else rest
        else:
            r = x - 1
        r = min(r, rest)
    return tuple(sorted(used.items(), reverse=True))


def _filled(filling: Filling) -> int:
    return sum(x * k for x, k in filling)


def _swaps(one: int, several: int, waste: int) -> int:
    """Lengths that could take the place of some pieces of a filling: more than a
    sum of pieces by at most ``waste``, or equal to a sum of several. Bit n of an
    integer stands for the length n."""
    reach, width = one << 1 if waste else 0, 1
    while width < waste:  # one << d for every d from 1 to waste
        step = min(width, waste - width)
        reach |= reach << step
        width += step
    return reach | several


def fillings(rest: int, counts: np.ndarray, work: list[int] | None = None) -> Iterator[Filling]:
    """All undominated fillings of ``rest``, the least waste first, one at a time.

    A filling is dominated where a piece left out could be added, or could take
    the place of some of its pieces without wasting more. Pieces are added
    from the largest on; what a piece could be swapped for is larger, so its
    count is settled, and a dominated beginning is given up at once. ``work``
    holds the steps that may still be made; none are made beyond.
    """
    work = [1 << 62] if work is None else work
    lengths = np.flatnonzero(counts[: rest + 1])[::-1].tolist()
    many = counts[lengths].tolist()
    sums, full = [1], (2 << rest) - 1
    for x, n in zip(reversed(lengths), reversed(many), strict=True):  # sums[i]: sums that lengths[i:] can make
        made, more, step = sums[-1], min(n, rest // x), 1
        while more:
            step = min(step, more)
            made |= made << step * x & full
            more -= step
            step *= 2
        sums.append(made)
    sums.reverse()

    def exact(i: int, r: int, one: int, several: int, free: int, waste: int) -> Iterator[Filling]:
        if not r:
            if not free & (2 << waste) - 1:
                yield ()
            return
        while i < len(lengths) and sums[i] >> r & 1 and work[0] > 0:
            work[0] -= 1
            x = lengths[i]
            if x <= r:
                with_one, with_several = one, several
                for k in range(1, min(many[i], r // x) + 1):
                    with_several |= with_several << x | with_one << x
                    with_one |= with_one << x | 1 << x
                    left = free if k < many[i] else free & ~(1 << x)
                    if left & _swaps(with_one, with_several, waste):
                        break
                    if sums[i + 1] >> r - k * x & 1:
                        for tail in exact(i + 1, r - k * x, with_one, with_several, left, waste):
                            yield ((x, k), *tail)
            i += 1

    free = sum(1 << x for x in lengths)
    for waste in range(rest + 1):
        if sums[0] >> rest - waste & 1 and work[0] > 0:
            yield from exact(0, rest - waste, 0, 0, free, waste)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that the pieces need at least: for every threshold a, pieces over
    ``capacity - a`` stand alone, those over half a bin apart, and those of a or
    more must fit what these leave."""
    x = np.arange(len(counts))
    many, size = (np.concatenate([[0], np.cumsum(v)]) for v in (counts, counts * x))  # of lengths under n
    half, a = capacity // 2, np.arange(capacity // 2 + 1)
    alone, apart = many[-1] - many[half + 1], many[capacity - a + 1] - many[half + 1]
    room = apart * capacity - (size[capacity - a + 1] - size[half + 1])
    rest = size[half + 1] - size[a]
    return int((alone + np.maximum(0, -((room - rest) // capacity))).max())


def _times(largest: int, filling: Filling, counts: np.ndarray) -> int:
    need = dict(filling)
    need[largest] = need.get(largest, 0) + 1
    return min(int(counts[x]) // k for x, k in need.items())


Bin = tuple[int, Filling]  # how many equal bins, and the pieces of each


@dataclass
class _Node:
    """A bin around ``largest``: fillings seen so far, and the one that is set."""

    largest: int
    barred: frozenset[Filling]  # tried for the same largest piece above
    tried: list[Filling] = field(default_factory=list)
    seen: int = 0
    filling: Filling | None = None
    times: int = 0


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Bin]:
    """Bins for ``{length: count}``, few as the search finds.

    Depth first: a node sets bins around the largest piece left with one
    filling, as many equal ones as there can be, later fewer. Bins around the
    same piece take fillings in the order in which these were tried, so no
    combination comes twice. A branch ends when its bins and the
    lower bound of the rest reach the incumbent, which starts from best fit and
    is renewed by it at every 16th node. The search is complete unless it
    has used ``nodes`` nodes (or twice the number of lengths, if that is more, so
    that it comes down to a whole packing), or ``STEPS`` steps for each of
    these in making fillings.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in histogram.items():
        counts[x] = n
    bound = lower_bound(counts, capacity)
    best, best_n = _best_fit(counts.copy(), capacity)
    path: list[_Node] = []
    used, spent, budget = 0, 0, max(nodes, 2 * len(histogram))
    work = [STEPS * budget]

    def change(node: _Node, sign: int) -> None:
        nonlocal used
        used += sign * node.times
        counts[node.largest] -= sign * node.times
        for x, k in node.filling:
            counts[x] -= sign * k * node.times

    def following(node: _Node) -> bool:
        """Set the node's next filling, or the last one in fewer bins."""
        if node.filling is not None:
            change(node, -1)
            node.times -= 1
            if node.times:
                change(node, 1)
                return True
        counts[node.largest] -= 1
        for filling in islice(fillings(capacity - node.largest, counts, work), node.seen, None):
            node.seen += 1
            if filling not in node.barred:
                break
        else:
            filling = None
        counts[node.largest] += 1
        if filling is None:
            return False
        node.filling, node.times = filling, _times(node.largest, filling, counts)
        node.tried.append(filling)
        change(node, 1)
        return True

    def down() -> None:
        largest = int(np.flatnonzero(counts)[-1])
        above = path[-1] if path and path[-1].largest == largest else None
        path.append(_Node(largest, above.barred.union(above.tried) if above else frozenset()))

    if best_n > bound:
        down()
    while path and best_n > bound and spent < budget and work[0] > 0:
        if not following(path[-1]):
            path.pop()
            continue
        spent += 1
        if used + lower_bound(counts, capacity) >= best_n:
            continue
        if not counts.any():
            best, best_n = [(n.times, _whole(n.largest, n.filling)) for n in path], used
            continue
        if spent % 16 == 0:
            rest, n = _best_fit(counts.copy(), capacity)
            if used + n < best_n:
                best, best_n = [(n.times, _whole(n.largest, n.filling)) for n in path] + rest, used + n
        down()
    return best


def _whole(largest: int, filling: Filling) -> Filling:
    need = dict(filling)
    need[largest] = need.get(largest, 0) + 1
    return tuple(sorted(need.items(), reverse=True))


def _best_fit(counts: np.ndarray, capacity: int) -> tuple[list[Bin], int]:
    """Best-fit decreasing: around the largest, always the largest that fits."""
    bins: list[Bin] = []
    n = 0
    while counts.any():
        largest = int(np.nonzero(counts)[0][-1])
        counts[largest] -= 1
        f = _complete((), capacity - largest, counts, _fit(counts))
        counts[largest] += 1
        times = _times(largest, f, counts)
        counts[largest] -= times
        for x, k in f:
            counts[x] -= k * times
        bins.append((times, _whole(largest, f)))
        n += times
    return bins, n


def slots(bins: list[Bin]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by their rank: one row per run of ranks.

    Sorted by (length, start); a piece of rank r in a run goes to sequence
    ``base + (r - start) // many`` at ``off + (r - start) % many * length``.
    """
    rows, start, base = [], {}, 0
    for times, pieces in bins:
        off = 0
        for x, k in pieces:
            rows.append((x, start.get(x, 0), k, base, off))
            start[x] = start.get(x, 0) + times * k
            off += x * k
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "many", "base", "off"), table.T, strict=True))


@gives_back
def _place(batches: Iterator[pa.RecordBatch], runs: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    first = {int(x): i for i, x in reversed(list(enumerate(runs["length"])))}
    last: dict[int, int] = {int(x): i + 1 for i, x in enumerate(runs["length"])}
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        at = np.empty(len(length), dtype=np.int64)
        for x in np.unique(length):
            mine = length == x
            lo, hi = first[int(x)], last[int(x)]
            at[mine] = lo + np.searchsorted(runs["start"][lo:hi], rank[mine], side="right") - 1
        k = rank - runs["start"][at]
        sequence = runs["base"][at] + k // runs["many"][at]
        offset = runs["off"][at] + k % runs["many"][at] * length
        kept = [batch.column(c) for c in PIECES.names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    if path is None:
        import public_tokenizers

        path, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    pieces = materialize(cut(docs, str(path), ranks and str(ranks), capacity))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.select(*PIECES.names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = slots(pack_histogram(histogram, capacity, nodes))
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("ranked"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(offsets, ["length", "bucket"]).select(*PIECES.names, (F.col("within") + F.col("ranked")).cast("long").alias("rank"))
    return ranked.mapInArrow(lambda it: _place(it, runs), PIECES_DDL + ", sequence_id long, offset long")

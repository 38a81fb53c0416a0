"""Fuzzy repeated passages by collinear chaining of shared seeds.

 1. Seeds: of every window of ``WINDOW`` k-mers of ``K`` words, the one with
    the least hash. Two texts that share a run of ``K + WINDOW - 1`` words
    share a seed, at a third of the positions.
 2. Seeds meet by hash, sorted by document. The first occurrence (smallest
    doc_id) owns the seed, and every occurrence in another document is one
    anchor (place, owner's place): a seed in n documents gives n - 1 anchors,
    never pairs of all with all. Seeds are first resolved within each task, in
    chunks of ``CHUNK``: occurrences become anchors of the chunk's first document
    that has the seed, and only that document's occurrences travel on. So the
    task that a hot seed is dealt to gets a few rows a chunk, not all of them.
 3. Chaining: anchors of a document and one owner are chained in order in both
    texts. A chain's score is the words its anchors cover less ``GAP`` for each
    word passed in either text; a Fenwick tree over the owner's places gives
    the best predecessor in log time. A chain goes on if
    ``MARGIN`` words more on either side make it long enough, or if it lies in
    a run of anchors, to whichever owners, that leaves no words out and is (and
    not within a chain that is long enough alone).
 4. Alignment: where anchors follow one another by the same step of at most
    ``K`` words, the words are known to be equal. Only the words in the gaps of
    a chain and ``REACH`` beyond its ends are fetched (in blocks of ``BLOCK``
    words, each block once), and the greedy O(ND) algorithm aligns each gap. A
    chain below ``IDENTITY`` is split between the anchors with the most edits
    until each part reaches it, so an exact run is kept whatever stands around
    it. Ends are extended over edits while that does not lower the identity
    below ``IDENTITY``, until the score falls ``DROP`` under its best or
    ``REACH`` words are passed.
 5. A document's aligned chains that touch or overlap (to whichever owner) form
    one passage, so a passage known from several places is not lost (parts of
    one split chain join only where they touch or overlap). Passages
    of ``MIN_WORDS`` words or more are reported; the first document that has
    one is its owner and keeps it. ``owner_id`` is the earlier document with
    the most words of the passage among those that its seeds were resolved with.

Words are lower-cased runs of non-space; places count words from 0, end
exclusive. Words are compared by hash (64 bits in seeds, 32 in alignment).

Defined cases: a null or empty text has no passage; rows with the same doc_id
are one document (repeats among them are not reported, and each text is
searched for itself); rows with a null doc_id are one document that sorts
before all others; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import BROADCAST_IDS, gives_back, materialize
from nearvote.llm.words import mix, windows, word_hashes

K, WINDOW = 5, 5
GAP = 0.1
BLOCK = 32
REACH = 48
#: Words on either side of a chain, less than ``REACH``, that may still make it a passage.
MARGIN = 16
DROP = 5.0
MIN_WORDS = 50
IDENTITY = 0.8
JOIN_GAP = 4
NO_ID = -(1 << 63)
CHUNK = 500_000
#: Bytes of block lists that a join broadcasts at most.
BROADCAST_BYTES = 64 << 20


def minimizers(words: np.ndarray, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the seeds of a text; of equal hashes in a window the
    last, so a word that goes on and on gives one seed a window."""
    h = windows(words, k)
    if not len(h):
        return h, np.empty(0, dtype=np.int64)
    if len(h) <= w:
        at = np.array([len(h) - 1 - int(h[::-1].argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        at = np.unique(w - 1 - view[:, ::-1].argmin(axis=1) + np.arange(len(view)))
    return h[at], at.astype(np.int64)


SEEDS_DDL = "h long, doc long, at long, part long, owner long, place long, owner_part long"
SEEDS = pa.schema([(c, pa.int64()) for c in ("h", "doc", "at", "part", "owner", "place", "owner_part")])


def _resolved(h: np.ndarray, doc: np.ndarray, at: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Occurrences of a chunk: those in the first document of their seed go on
    as seeds, the others are anchors (dealt by document, not by seed)."""
    order = np.lexsort((at, part, doc, h))
    h, doc, at, part = (v[order] for v in (h, doc, at, part))
    first = np.searchsorted(h, h, side="left") if len(h) else order
    anchor = doc != doc[first]
    place = lambda v: pa.array(v[first], mask=~anchor)
    key = np.where(anchor, mix((doc ^ part).view(np.uint64)).view(np.int64), h)
    return pa.RecordBatch.from_arrays([*(pa.array(v) for v in (key, doc, at, part)), place(doc), place(at), place(part)], schema=SEEDS)


@gives_back
def _seeds(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        ids, texts_of = (batch.column(c).to_numpy() for c in (0, 1))
        texts = batch.column(2)
        for i, text in enumerate(texts):
            h, at = minimizers(word_hashes(text.as_py()))
            held.append((h.view(np.int64), np.full(len(h), ids[i]), at, np.full(len(h), texts_of[i])))
            size += len(h)
            if size >= chunk:
                yield _resolved(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield _resolved(*(np.concatenate(v) for v in zip(*held, strict=True)))


@gives_back
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences against the first of their seed; input sorted by (h, doc,
    part, at), where a part tells the texts under one doc_id apart. Rows that
    have an owner already are anchors and pass through."""
    seed = owner = place = owner_part = None
    for batch in batches:
        if batch.num_columns > 4:
            ready = batch.column("owner").is_valid()
            done = batch.filter(ready)
            if done.num_rows:
                yield done.select(["doc", "at", "owner", "place", "part", "owner_part"])
                batch = batch.filter(pc.invert(ready))
        h, doc, at = (batch.column(c).to_numpy() for c in range(3))
        part = batch.column(3).to_numpy() if batch.num_columns > 3 else np.zeros(len(h), dtype=np.int64)
        if not len(h):
            continue
        new = np.concatenate([[seed is None or h[0] != seed], h[1:] != h[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        carried = first < 0  # the seed began in a batch before
        o = np.where(carried, owner if owner is not None else 0, doc[first])
        p = np.where(carried, place if place is not None else 0, at[first])
        q = np.where(carried, owner_part if owner_part is not None else 0, part[first])
        keep = doc != o
        seed, owner, place, owner_part = h[-1], o[-1], p[-1], q[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, at, o, p, part, q)], names=["doc", "at", "owner", "place", "part", "owner_part"])


def chains(x: np.ndarray, y: np.ndarray, k: int = K, gap: float = GAP) -> list[tuple[int, int, int, int]]:
    """Chains (x0, x1, y0, y1) of anchors, sharing none."""
    return [(xs[0], xs[-1] + k, ys[0], ys[-1] + k) for xs, ys in linked(x, y, k, gap)]


def linked(x: np.ndarray, y: np.ndarray, k: int = K, gap: float = GAP) -> list[tuple[list[int], list[int]]]:
    """The anchors of each chain, sharing none.

    f(j) = k + max(0, f(i) - gap * (x_j - x_i + y_j - y_i)) over anchors before
    j in both texts; f(i) + gap * (x_i + y_i) stands in the tree at y_i. A chain
    is cut where one step costs more than an anchor is worth: what lies between
    is no part of the passage, however long both sides are.
    """
    n = len(x)
    steps_x, steps_y = np.diff(x), np.diff(y)
    if n == 1 or (steps_x == steps_y).all() and (2 * gap * steps_x).max() < k:
        return [(x.tolist(), y.tolist())]
    order = np.lexsort((-y, x))
    xs, ys = x[order].tolist(), y[order].tolist()
    rank = {v: i + 1 for i, v in enumerate(sorted(set(ys)))}
    m = len(rank)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (m + 1)
    score, back = [0.0] * n, [-1] * n
    j, ready = 0, 0
    while j < n:
        end = j  # anchors of one x are asked before any of them is put in
        while end < n and xs[end] == xs[j]:
            i, best = rank[ys[end]] - 1, (-1e18, -1)
            while i:
                best = max(best, tree[i])
                i -= i & -i
            gained = best[0] - gap * (xs[end] + ys[end])
            if best[1] >= 0 and gained > 0:
                overlap = max(0, k - min(xs[end] - xs[best[1]], ys[end] - ys[best[1]]))
                score[end], back[end] = gained + k - overlap, best[1]
            else:
                score[end] = float(k)
            end += 1
        for ready in range(j, end):
            entry, i = (score[ready] + gap * (xs[ready] + ys[ready]), ready), rank[ys[ready]]
            while i <= m:
                if entry > tree[i]:
                    tree[i] = entry
                i += i & -i
        j = end
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda i: -score[i]):
        if used[j]:
            continue
        i, chain = j, []
        while i >= 0 and not used[i]:
            if chain and gap * (xs[chain[-1]] - xs[i] + ys[chain[-1]] - ys[i]) > k:
                out.append(chain)
                chain = []
            used[i] = True
            chain.append(i)
            i = back[i]
        out.append(chain)
    return [([xs[i] for i in reversed(c)], [ys[i] for i in reversed(c)]) for c in out]


def steps(xs: list[int], ys: list[int]) -> bytes:
    """A chain's steps in both texts, two bytes each (no step is over 60 words)."""
    return np.diff(np.array([xs, ys]), axis=1).astype(np.uint8).T.tobytes()


CHAIN_DDL = "chain long, doc long, part long, x0 long, owner long, owner_part long, y0 long, steps binary, x_blocks array<long>, y_blocks array<long>"
CHAINS = pa.schema([(c, pa.int64()) for c in ("chain", "doc", "part", "x0", "owner", "owner_part", "y0")] + [("steps", pa.binary()), ("x_blocks", pa.list_(pa.int64())), ("y_blocks", pa.list_(pa.int64()))])


def wanted_blocks(at: list[int], gaps: np.ndarray) -> list[int]:
    """Blocks with the first and the last word of a side of a chain, the words
    beyond its ends, and those from anchor to anchor over each gap."""
    spans = [(max(0, at[0] - REACH), at[0]), (at[-1] + K - 1, at[-1] + K + REACH - 1), *((at[i], at[i + 1] + K - 1) for i in gaps)]
    return sorted({b for lo, hi in spans for b in range(lo // BLOCK, hi // BLOCK + 1)})


def gaps_of(xs: list[int], ys: list[int]) -> np.ndarray:
    """Steps of a chain over words that are not known to be equal."""
    dx, dy = np.diff(xs), np.diff(ys)
    return np.flatnonzero((dx != dy) | (dx > K))


def dense_spans(at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of anchors, to whichever owner, that leave no
    more than ``JOIN_GAP`` words out and may be a passage. An exact passage is
    one, since its seeds leave out no word but up to ``WINDOW - 1`` at its ends."""
    at = np.sort(at)
    cuts = np.flatnonzero(np.diff(at) > K + JOIN_GAP)
    starts, ends = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])] + K
    dense = ends - starts + 2 * (WINDOW - 1) >= min_words
    return starts[dense], ends[dense]


def long_alone(low: np.ndarray | int, high: np.ndarray | int, min_words: int) -> np.ndarray | bool:
    """Whether a chain is long enough with ``MARGIN`` words more on either side."""
    return high - low + 2 * MARGIN >= min_words


def spans(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    starts, ends = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return starts, ends


def covers(spans: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray, whole: bool = True) -> np.ndarray:
    """Whether a span holds all from low to high, or else a word of it."""
    if not len(spans[0]):
        return np.zeros(len(low), dtype=bool)
    i = np.searchsorted(spans[0], low, side="right") - 1 if whole else np.searchsorted(spans[0], high, side="left") - 1
    return (i >= 0) & (spans[1][i] >= high if whole else spans[1][i] > low)


@gives_back
def _chain(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Chains of each text; input sorted by (doc, part, owner, owner_part).
    A chain stays if it is long enough alone, or if it is in a run of
    :func:`dense_spans` and not within a chain that is."""
    number = TaskContext.get().partitionId() << 33
    held: list[np.ndarray] = []
    rows: list[tuple] = []

    def finish() -> None:
        nonlocal number
        table = np.concatenate(held)
        held.clear()
        doc, text = int(table[0, 0]), int(table[0, 4])
        dense = dense_spans(table[:, 1], min_words)
        # A place of the owner that repeats here: once in ``MARGIN`` words.
        order = np.lexsort((table[:, 1], table[:, 3], table[:, 5], table[:, 2]))
        table = table[order]
        group = np.column_stack([table[:, [2, 5, 3]], table[:, 1] // MARGIN])
        table = table[np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)])]
        cuts = np.concatenate([[0], np.flatnonzero((table[1:, [2, 5]] != table[:-1, [2, 5]]).any(axis=1)) + 1])
        low, high = (f.reduceat(table[:, 1], cuts) for f in (np.minimum, np.maximum))
        ends = [*cuts[1:], len(table)]
        # Chains that are long enough alone, then short ones where none of these is.
        short: list[tuple] = []
        alone: list[tuple[int, int]] = []

        def keep(owner: int, owner_text: int, xs: list[int], ys: list[int]) -> None:
            nonlocal number
            gaps = gaps_of(xs, ys)
            rows.append((number, doc, text, xs[0], owner, owner_text, ys[0], steps(xs, ys), wanted_blocks(xs, gaps), wanted_blocks(ys, gaps)))
            number += 1

        def chains_of(i: int) -> list[tuple]:
            part = table[cuts[i] : ends[i]]
            part = part[np.argsort(part[:, 1], kind="stable")]
            return [(int(part[0, 2]), int(part[0, 5]), xs, ys) for xs, ys in linked(part[:, 1], part[:, 3])]

        wide = long_alone(low, high + K, min_words)
        for i in np.flatnonzero(wide):
            for chain in chains_of(i):
                if long_alone(chain[2][0], chain[2][-1] + K, min_words):
                    keep(*chain)
                    alone.append((chain[2][0], chain[2][-1] + K))
                else:
                    short.append(chain)
        inside = covers(dense, low, high + K, whole=False) & ~covers(spans(alone), low, high + K) & ~wide
        short += [chain for i in np.flatnonzero(inside) for chain in chains_of(i)]
        if short:
            low, high = (np.array([chain[2][e] for chain in short]) for e in (0, -1))
            for i in np.flatnonzero(covers(dense, low, high + K, whole=False) & ~covers(spans(alone), low, high + K)):
                keep(*short[i])

    for batch in batches:
        table = np.stack([batch.column(c).to_numpy() for c in ("doc", "at", "owner", "place", "part", "owner_part")], axis=1)
        if not len(table):
            continue
        for part in np.split(table, np.nonzero((table[1:, [0, 4]] != table[:-1, [0, 4]]).any(axis=1))[0] + 1):
            if held and (held[0][0, [0, 4]] != part[0, [0, 4]]).any():
                finish()
            held.append(part)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHAINS, strict=True)], schema=CHAINS)
            rows = []
    if held:
        finish()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHAINS, strict=True)], schema=CHAINS)


@gives_back
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, part, block, words = [], [], [], []
        for d, q, want, text in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
            h = word_hashes(text.as_py()).astype(np.uint32)
            for b in want:
                if b * BLOCK < len(h):
                    doc.append(d)
                    part.append(q)
                    block.append(b)
                    words.append(h[b * BLOCK : (b + 1) * BLOCK].tobytes())
            if len(doc) > 20_000:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, part, block)), pa.array(words, pa.binary())], names=["doc", "part", "block", "words"])
                doc, part, block, words = [], [], [], []
        if doc:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, part, block)), pa.array(words, pa.binary())], names=["doc", "part", "block", "words"])


def common_words(a: list[int], b: list[int], most: int) -> int | None:
    """Longest common subsequence by Myers' O(ND); None beyond ``most`` edits."""
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return head + tail if n + m <= most else None
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            if k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1):
                x = reach[k + 1]
            else:
                x = reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return head + tail + (n + m - d) // 2
    return None


def extension(a: list[int], b: list[int], identity: float, drop: float = DROP) -> tuple[int, int, int]:
    """How many words of both sides to add, and how many of them align.

    Greedy O(ND) from the start of both. With d words left out of n, the score
    ``(1 - identity) * n - d`` is not negative where the identity is reached;
    the end with the best score is taken, and paths ``drop`` under it are left.
    """
    n, m = len(a), len(b)
    x = 0
    while x < n and x < m and a[x] == b[x]:
        x += 1
    gain = 1 - identity
    best, end = 2 * gain * x, (x, x, x)
    reach = {0: x}
    d = 0
    while reach:
        d += 1
        found: dict[int, int] = {}
        for k0, x0 in reach.items():
            for k, x in ((k0 + 1, x0 + 1), (k0 - 1, x0)):
                if x <= n and x - k <= m and x > found.get(k, -1):
                    found[k] = x
        reach = {}
        for k, x in found.items():
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            score = gain * (x + y) - d
            if score > best - drop:
                reach[k] = x
                if score > best or score == best and x + y > end[0] + end[1]:
                    best, end = score, (x, y, (x + y - d) // 2)
    return end


def parts(x: list[int], xs: list[int], y: list[int], ys: list[int], identity: float, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """The parts of :func:`whole_parts` with their ends extended over edits."""
    out = []
    for x0, x1, y0, y1, same in whole_parts(x, xs, y, ys, identity, k):
        before = extension(x[max(0, x0 - REACH) : x0][::-1], y[max(0, y0 - REACH) : y0][::-1], identity)
        after = extension(x[x1 : x1 + REACH], y[y1 : y1 + REACH], identity)
        out.append((x0 - before[0], x1 + after[0], y0 - before[1], y1 + after[1], same + before[2] + after[2]))
    return out


def whole_parts(x: list[int], xs: list[int], y: list[int], ys: list[int], identity: float, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """(x0, x1, y0, y1, words that align) of the chain of anchors, whole or,
    where it is too different, split between the anchors with the most edits;
    ends extended over equal words."""
    dx, dy = np.diff(xs), np.diff(ys)
    size, same = dx + dy, dx.copy()
    for i in np.flatnonzero((dx != dy) | (dx > k)):
        same[i] = common_words(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], int(size[i]))
    edits = size - 2 * same
    size, same = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(same)])
    out, todo = [], [(0, len(xs) - 1)]
    while todo:
        i, j = todo.pop()
        words = int(same[j] - same[i]) + k
        if 2 * words < identity * (int(size[j] - size[i]) + 2 * k):
            at = i + int(edits[i:j].argmax())
            todo += [(i, at), (at + 1, j)]
            continue
        x0, x1, y0, y1 = xs[i], xs[j] + k, ys[i], ys[j] + k
        while x0 > 0 and y0 > 0 and x[x0 - 1] == y[y0 - 1]:
            x0, y0, words = x0 - 1, y0 - 1, words + 1
        while x1 < len(x) and y1 < len(y) and x[x1] == y[y1]:
            x1, y1, words = x1 + 1, y1 + 1, words + 1
        out.append((x0, x1, y0, y1, words))
    return out


def sides_of(blocks: tuple[dict[int, bytes], dict[int, bytes]], xs: list[int], ys: list[int]) -> tuple[list[list[int]], list[int]]:
    """Words of both sides from the first block of each, and where these begin.

    Words that were not fetched stand in runs known to be equal: they take the
    word of the other side, or, where neither was fetched, a number of their own.
    """
    words, base = [], []
    for n, (side, at) in enumerate(zip(blocks, (xs, ys), strict=True)):
        lo = min(side) * BLOCK
        row = np.full(max(at[-1] + K, max(b * BLOCK + len(raw) // 4 for b, raw in side.items())) - lo, -1 - n, dtype=np.int64)
        for b, raw in side.items():
            row[b * BLOCK - lo : b * BLOCK - lo + len(raw) // 4] = np.frombuffer(raw, dtype=np.uint32)
        words.append(row)
        base.append(lo)
    gaps = gaps_of(xs, ys)
    for i, j in zip([0, *(gaps + 1)], [*gaps, len(xs) - 1], strict=True):
        x, y = words[0][xs[i] - base[0] : xs[j] + K - base[0]], words[1][ys[i] - base[1] : ys[j] + K - base[1]]
        known = np.where(x >= 0, x, y)
        known = np.where(known >= 0, known, (1 << 32) + np.arange(xs[i], xs[j] + K))
        x[x < 0] = known[x < 0]
        y[y < 0] = known[y < 0]
    return [row.tolist() for row in words], base


ALIGNED_DDL = "doc long, part long, x0 long, x1 long, owner long, y0 long, y1 long, same long, chain long"


@gives_back
def _align(batches: Iterator[pa.RecordBatch], identity: float) -> Iterator[pa.RecordBatch]:
    """Input sorted by (chain, side, block): each chain's words on both sides."""
    now: tuple | None = None
    sides: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
    rows: list[tuple] = []

    def finish() -> None:
        chain, doc, part, x0, owner, y0, between = now
        if not sides[0] or not sides[1]:
            return
        dx, dy = np.frombuffer(between, dtype=np.uint8).reshape(-1, 2).T.astype(np.int64)
        xs, ys = ([at, *(at + np.cumsum(d)).tolist()] for at, d in ((x0, dx), (y0, dy)))
        text, base = sides_of(sides, xs, ys)
        xs, ys = ([v - at for v in side] for side, at in zip((xs, ys), base, strict=True))
        for a0, a1, b0, b1, same in parts(text[0], xs, text[1], ys, identity):
            rows.append((doc, part, a0 + base[0], a1 + base[0], owner, b0 + base[1], b1 + base[1], same, chain))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("chain", "doc", "part", "x0", "owner", "y0", "steps", "side", "block", "words")]
        for *head, side, block, words in zip(*columns, strict=True):
            head = tuple(head)
            if now is None or head[0] != now[0]:
                if now is not None:
                    finish()
                now, sides = head, ({}, {})
            sides[side].setdefault(block, words)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc", "part", "x0", "x1", "owner", "y0", "y1", "same", "chain"])
            rows = []
    if now is not None:
        finish()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc", "part", "x0", "x1", "owner", "y0", "y1", "same", "chain"])


PASSAGES = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start_word", "end_word", "n_words", "owner_id", "owner_start", "owner_end", "matched_words")] + [("identity", pa.float64()), ("owner_ids", pa.list_(pa.int64()))]
)
PASSAGES_DDL = "doc_id long, start_word long, end_word long, n_words long, owner_id long, owner_start long, owner_end long, matched_words long, identity double, owner_ids array<long>"


def _joined(aligned: list[tuple]) -> list[tuple[int, int]]:
    """Spans of aligned parts that touch, overlap or stand ``JOIN_GAP`` apart;
    parts of one chain were split for what lies between, so never over a gap."""
    out: list[tuple[int, int]] = []
    ending: set[int] = set()  # chains of the parts that end where the last span ends
    for s, e, *_, chain in sorted(aligned, key=lambda a: a[:2]):
        if out and s <= out[-1][1] + (JOIN_GAP if ending - {chain} else 0):
            if e >= out[-1][1]:
                ending = {chain} | (ending if e == out[-1][1] else set())
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
            ending = {chain}
    return out


def passages(doc: int, aligned: list[tuple[int, int, int, int, int, int, int]], min_words: int) -> list[tuple]:
    """Passages of one document from (x0, x1, owner, y0, y1, same, chain) rows."""
    plain = lambda v: None if v == NO_ID else v
    out = []
    merged = _joined(aligned)
    starts = [s for s, _ in merged]
    inside: list[list[tuple]] = [[] for _ in merged]
    for a in aligned:
        inside[int(np.searchsorted(starts, a[0], side="right")) - 1].append(a)
    for (s, e), members in zip(merged, inside, strict=True):
        if e - s >= min_words:
            x0, x1, owner, y0, y1, same, _ = max(members, key=lambda a: (a[5], -a[2]))
            out.append((plain(doc), s, e, e - s, plain(owner), y0, y1, same, round(2 * same / (x1 - x0 + y1 - y0), 4), sorted({m[2] for m in members} - {NO_ID})))
    return out


@gives_back
def _passages(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    doc, held = None, []
    rows: list[tuple] = []
    for batch in batches:
        for d, q, *rest in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
            if (d, q) != doc and held:
                rows += passages(doc[0], held, min_words)
                held = []
            doc = (d, q)
            held.append(tuple(rest))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PASSAGES, strict=True)], schema=PASSAGES)
            rows = []
    if held:
        rows += passages(doc[0], held, min_words)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PASSAGES, strict=True)], schema=PASSAGES)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """One row per passage of a document that an earlier document has."""
    base = _parts(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text")))
    seeds = base.mapInArrow(_seeds, SEEDS_DDL)
    anchors = seeds.repartition("h").sortWithinPartitions("h", "doc", "part", "at").mapInArrow(_anchors, "doc long, at long, owner long, place long, part long, owner_part long")
    chained = materialize(anchors.repartition("doc", "part").sortWithinPartitions("doc", "part", "owner", "owner_part").mapInArrow(lambda it: _chain(it, min_words), CHAIN_DDL))

    head = ("chain", "doc", "part", "x0", "owner", "y0", "steps")

    def asked(side: int, doc: str, part: str, blocks: str) -> DataFrame:
        return chained.select(*head, F.lit(side).alias("side"), F.col(doc).alias("from"), F.col(part).alias("from_part"), F.explode(blocks).alias("block"))

    wanted = asked(0, "doc", "part", "x_blocks").union(asked(1, "owner", "owner_part", "y_blocks"))
    lists = materialize(wanted.select(F.col("from").alias("doc"), F.col("from_part").alias("part"), "block").distinct().groupBy("doc", "part").agg(F.collect_list("block").alias("blocks")))
    size = lists.agg(F.sum(32 + 8 * F.size("blocks"))).first()[0] or 0
    few = size <= BROADCAST_BYTES
    found = base.join(F.broadcast(lists) if few else lists, ["doc", "part"]).select("doc", "part", "blocks", "text")
    blocks = found.mapInArrow(_blocks, "doc long, part long, block long, words binary").withColumnsRenamed({"doc": "from", "part": "from_part"})
    together = wanted.join(blocks, ["from", "from_part", "block"]).select(*head, "side", "block", "words")
    aligned = together.repartition("chain").sortWithinPartitions("chain", "side", "block").mapInArrow(lambda it: _align(it, identity), ALIGNED_DDL)
    return aligned.repartition("doc", "part").sortWithinPartitions("doc", "part").mapInArrow(lambda it: _passages(it, min_words), PASSAGES_DDL)


def _parts(base: DataFrame) -> DataFrame:
    """``base`` with ``part``: which text it is, where rows share a doc_id (0 where none does)."""
    shared = materialize(base.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(True).alias("shared")))
    n = shared.count()
    if not n:
        return base.select("doc", F.lit(0).cast("long").alias("part"), "text")
    if n > BROADCAST_IDS:
        return base.select("doc", F.xxhash64("text").alias("part"), "text")
    return base.join(F.broadcast(shared), "doc", "left").select("doc", F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("part"), "text")

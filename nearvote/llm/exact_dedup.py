"""Exact deduplication with Patricia-trie owners.

Texts are equal when they are the same after each run of white space has
become one space. Equal texts have the same length and content hash, so
``(length, hash)`` partitions the problem. Within a partition the full UTF-8
strings go into a compressed radix trie whose terminal nodes hold the smallest
``doc_id`` and a count: the hash only routes, the bytes decide.

Plan
 1. Every input task puts its rows into a trie of its own (a map-side combine:
    thousands of copies of one text leave a task as one row). When the trie
    holds ``local_bytes``, its terminals are sent on and a new trie begins.
    Rows go to a written table: each document with the id of its terminal, and
    the text once per terminal.
 2. The texts are dealt by ``(length, hash)`` and sorted by it. Because the key
    leads the sort order, each subtree of the second trie comes as one run:
    it is finished, sent on and freed before the next begins, and everything
    not yet reached is spilled by Spark's own external sort, subtree by
    subtree. A trie in memory never exceeds the texts of one (length, hash).
 3. Documents meet their owner over the id of their first terminal. These ids
    are spread evenly however large a group of copies is.

Defined cases: a null text counts as empty; rows with the same ``doc_id`` are
rows of their own, and of these all with the smallest id among equals are
``kept`` only once per row with that id (they tie, so each is kept); a null
``doc_id`` sorts after all others and is kept only if no other equal text has
an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import SPACE, gives_back, materialize, text_or_empty

LOCAL_BYTES = 48 << 20
NO_ID = (1 << 63) - 1


class Patricia:
    """Compressed radix trie over byte strings.

    A node is ``[label, children, value]``: children by first byte, value the
    terminal's payload or None. Insertion walks whole labels, so its cost is
    the length of the string plus the number of branchings.
    """

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0

    def node(self, key: bytes) -> list:
        """The terminal node of ``key``, made where absent."""
        at, i, n = self.root, 0, len(key)
        while i < n:
            below = at[1].get(key[i])
            if below is None:
                leaf = [key[i:], {}, None]
                at[1][key[i]] = leaf
                self.size += n - i
                return leaf
            label = below[0]
            if key.startswith(label, i):
                at, i = below, i + len(label)
                continue
            k = _common(label, key, i)
            middle = [label[:k], {label[k]: below}, None]
            below[0] = label[k:]
            at[1][key[i]] = middle
            at, i = middle, i + k
        return at


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]`` by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


LOCAL = pa.schema(
    [("doc_id", pa.int64()), ("uid", pa.int64()), ("text_sha256", pa.string()), ("len", pa.int64()), ("h", pa.int64()), ("bytes", pa.binary()), ("low", pa.int64()), ("n", pa.int64())]
)
LOCAL_DDL = "doc_id long, uid long, text_sha256 string, len long, h long, bytes binary, low long, n long"


@gives_back
def _combine(batches: Iterator[pa.RecordBatch], local_bytes: int) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    trie, waiting = Patricia(), []

    def flush() -> Iterator[pa.RecordBatch]:
        # A terminal: [uid, low, n, len, h, bytes]; its first row carries the text.
        first = set()
        rows: list[tuple] = []
        held = 0
        for doc_id, sha, t in waiting:
            if t[0] in first:
                rows.append((doc_id, t[0], sha, None, None, None, None, None))
            else:
                first.add(t[0])
                rows.append((doc_id, t[0], sha, t[3], t[4], t[5], t[1], t[2]))
                held += len(t[5])
            if held > 8 << 20 or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    for batch in batches:
        for doc_id, raw, sha, h in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            node = trie.node(raw)
            low = NO_ID if doc_id is None else doc_id
            if node[2] is None:
                node[2] = [uid, low, 0, len(raw), h, raw]
                trie.size += len(raw)  # the terminal holds the whole text, too
                uid += 1
            t = node[2]
            t[1] = min(t[1], low)
            t[2] += 1
            waiting.append((doc_id, sha, t))
            if trie.size > local_bytes or len(waiting) > 200_000:
                yield from flush()
                trie, waiting = Patricia(), []
    yield from flush()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LOCAL, strict=True)], schema=LOCAL)


OWNERS = pa.schema([("uid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


@gives_back
def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, trie, found = None, Patricia(), []
    out: list[tuple] = []

    def finish() -> None:
        for low, n, uids in found:
            keep = None if low == NO_ID else low
            out.extend((uid, keep, n) for uid in uids)

    for batch in batches:
        for uid, length, h, raw, low, n in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (length, h) != key:  # the subtree of the key before is complete
                finish()
                key, trie, found = (length, h), Patricia(), []
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=OWNERS)
                    out = []
            node = trie.node(raw)
            if node[2] is None:
                node[2] = [low, 0, []]
                found.append(node[2])
            t = node[2]
            t[0] = min(t[0], low)
            t[1] += n
            t[2].append(uid)
    finish()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=OWNERS)


def exact_dedup(docs: DataFrame, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(text_or_empty(), SPACE, " ").alias("norm"))
    keyed = norm.select("doc_id", F.encode("norm", "UTF-8").alias("raw"), F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("h"))
    local = materialize(keyed.mapInArrow(lambda it: _combine(it, local_bytes), LOCAL_DDL))
    texts = local.where(F.col("bytes").isNotNull()).select("uid", "len", "h", "bytes", "low", "n")
    owners = texts.repartition("len", "h").sortWithinPartitions("len", "h").mapInArrow(_owners, "uid long, keep_id long, group_size long")
    members = local.select("doc_id", "uid", "text_sha256")
    result = members.join(owners, "uid").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
    result._nearvote_parts = [local]
    return result


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

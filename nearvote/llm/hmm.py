"""Language-model scoring with a hidden Markov model over word classes.

A text is the sequence of its lower-cased words and an end token. The model is
a class-based HMM: latent states emit one of ``SYMBOLS`` symbols, and a symbol
emits a token. The most frequent ``TOP`` tokens are symbols of their own; all
others share ``TAILS`` symbols by their last two bytes. So

    P(text) = sum over state paths of prod a(s, s') b(s', symbol) * prod P(token | symbol)

and P(token | symbol) = (c + 0.1) / (N_symbol + 0.1 * (V_symbol + 1)), which
leaves room for words that training has not seen.

 1. Tokens are counted over all training documents: summed per task, then by
    token. The vocabulary is a table; it is never collected or broadcast.
    Only its ``HELD`` most frequent tokens and the sums by symbol are (both of
    fixed size).
 2. Documents become sequences of 16-bit symbols, written once, with the tokens
    that are not held as 64-bit hashes and how often each occurs in the
    document, for a join with the counts.
 3. Baum-Welch: every task runs the scaled forward and backward recursions over
    its training sequences and adds up expected counts; the sums of the tasks
    (a fixed number of cells each) are aggregated in the cluster by cell and
    give the next parameters. ``ROUNDS`` passes over all training documents.
 4. Scaled forward recursion gives each whole text's exact log-likelihood.

Recursions are vectorised over the documents of a batch, longest first, so one
step advances every text that still has tokens. Long texts are split into words
a stretch at a time, and a sequence longer than ``GROUP`` tokens has the alphas
of as many tokens held at once, so a task holds little beyond the text itself.

Defined cases: a null or empty text is one end token; a null doc_id counts as
the text "" for the split, and is scored; rows with the same doc_id are scored
each; without training tokens all counts are 0 and scores come from the
smoothed uniform model; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import gives_back, materialize, most_frequent

TOP, TAILS, STATES, ROUNDS = 4_096, 1_024, 6, 3
#: Start of training: how likely a state is kept, and how far states differ.
STAY, SPREAD = 0.98, 1.5
#: Tokens whose counts the tasks hold; those of all others come from a join.
HELD = 65_536
SYMBOLS = TOP + TAILS
ALPHA = 0.1
FLUSH = 200_000
#: Bytes of a text that are split at a time, tokens of a group of sequences, and
#: tokens of a longer sequence whose alphas are held at once.
STRETCH, GROUP = 1 << 20, 500_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def held_out_column():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def token_key(word: bytes) -> int:
    """Signed 64-bit id of a token."""
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


END_KEY = xxhash.xxh3_64_intdigest(b"end", seed=1) >> 1


def tail(word: bytes) -> int:
    return TOP + xxhash.xxh32_intdigest(word[-2:]) % TAILS


def words(text: str | None, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text, those of some ``stretch`` bytes at a time."""
    raw, at = text.encode() if text else b"", 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + stretch)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].lower().split()
        at = end


@gives_back
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    ends = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found = list(counts.items())
        for i in range(0, len(found), 50_000):
            w, n = zip(*found[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(map(token_key, w), pa.int64()), pa.array(map(tail, w), pa.int32()), pa.array(n, pa.int64())], names=["token", "tail", "n"])
        counts.clear()

    for batch in batches:
        for text in batch.column(0):
            for w in words(text.as_py()):
                counts.update(w)
                if len(counts) > FLUSH:
                    yield from flush()
            ends += 1
    yield from flush()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END_KEY], pa.int64()), pa.array([TOP], pa.int32()), pa.array([ends], pa.int64())], names=["token", "tail", "n"])


def vocabulary(train: DataFrame) -> DataFrame:
    """token, tail, n: every distinct training token with its count."""
    return train.select("text").mapInArrow(_count, "token long, tail int, n long").groupBy("token", "tail").agg(F.sum("n").alias("n"))


NUMBERED_DDL = "doc_id long, held_out boolean, row long, symbols binary, rare map<long, long>, held_sum double, held_known long"


class _Places(dict):
    """Number of a word, bounded: its place among the held tokens, or ``HELD``
    and the number of its tail."""

    def __init__(self, held: dict[int, int]) -> None:
        super().__init__()
        self.held = held

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        place = self.held.get(token_key(word), -1)
        found = self[word] = place if place >= 0 else HELD + tail(word) - TOP
        return found


@gives_back
def _encode(batches: Iterator[pa.RecordBatch], held: dict[int, int], symbol: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    places, row = _Places(held), TaskContext.get().partitionId() << 33
    end = held.get(END_KEY, HELD)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1_000):
            part = batch.slice(lo, 1_000)
            sequences, rare, sums, known = [], [], [], []
            for text in part.column(2):
                times, found, sum_, n_known = Counter([END_KEY] if end >= HELD else ()), [], float(value[end]), int(end < HELD)
                for w in words(text.as_py()):
                    at = np.fromiter(map(places.__getitem__, w), dtype=np.int64, count=len(w))
                    out = np.flatnonzero(at >= HELD).tolist()
                    times.update(token_key(w[i]) for i in out)
                    found.append(symbol[at].tobytes())
                    sum_ += float(value[at].sum())
                    n_known += len(at) - len(out)
                rare.append(list(times.items()))
                sequences.append(b"".join([*found, symbol[end].tobytes()]))
                sums.append(sum_)
                known.append(n_known)
            n = len(sequences)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.arange(row, row + n)), pa.array(sequences, pa.binary()), pa.array(rare, pa.map_(pa.int64(), pa.int64())), pa.array(sums, pa.float64()), pa.array(known, pa.int64())],
                names=["doc_id", "held_out", "row", "symbols", "rare", "held_sum", "held_known"],
            )
            row += n


def start_model(counts: np.ndarray, states: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities: states that last, and
    emit the class unigram with a fixed disturbance that tells them apart."""
    base = (counts + 1.0) / (counts + 1.0).sum()
    emit = base * np.exp(SPREAD * np.random.default_rng(7).standard_normal((states, len(counts))))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return np.full(states, 1.0 / states), move, emit / emit.sum(1, keepdims=True)


class Batch:
    """Sequences in one flat array, longest first."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        ordered = [sequences[i] for i in self.order]
        self.lengths = np.array([len(s) for s in ordered], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.flat = np.concatenate(ordered).astype(np.int64)
        steps = int(self.lengths[0])
        # active[t]: how many sequences have a token at t.
        self.active = np.searchsorted(-self.lengths, -np.arange(steps), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t


def forward(batch: Batch, start: np.ndarray, move: np.ndarray, emit_t: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """log10 likelihood of each sequence; with keep, scaled alphas and scales."""
    total = np.zeros(len(batch.lengths))
    alphas = np.empty((len(batch.flat), len(start))) if keep else None
    scales = np.empty(len(batch.flat)) if keep else None
    a = None
    for t in range(len(batch.active)):
        at = batch.at(t)
        e = emit_t[batch.flat[at]]
        a = start * e if t == 0 else (a[: len(at)] @ move) * e
        c = a.sum(1)
        a /= c[:, None]
        total[: len(at)] += np.log10(c)
        if keep:
            alphas[at], scales[at] = a, c
    return total, alphas, scales


def expected(batch: Batch, start: np.ndarray, move: np.ndarray, emit_t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of one Baum-Welch pass, and the log10 likelihood."""
    total, alphas, scales = forward(batch, start, move, emit_t, keep=True)
    k = len(start)
    moves, gammas = np.zeros((k, k)), alphas  # gamma takes alpha's place
    b = np.ones((len(batch.lengths), k))
    for t in range(len(batch.active) - 2, -1, -1):
        after = batch.at(t + 1)
        n = len(after)
        weight = emit_t[batch.flat[after]] * b[:n] / scales[after][:, None]
        at = batch.at(t)[:n]
        moves += move * (alphas[at].T @ weight)
        gammas[after] = alphas[after] * b[:n]
        b[:n] = weight @ move.T
    at = batch.at(0)
    gammas[at] = alphas[at] * b
    emits = np.stack([np.bincount(batch.flat, weights=gammas[:, s], minlength=emit_t.shape[0]) for s in range(k)])
    return gammas[at].sum(0), moves, emits, float(total.sum())


def expected_of_long(symbols: np.ndarray, start: np.ndarray, move: np.ndarray, emit_t: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same for one long sequence, with the alphas of one stretch at a time.

    The way there keeps the alpha and scale that each stretch begins with; the
    way back makes those within a stretch again.
    """
    k, kept, total, a = len(start), [], 0.0, None
    edges = [*range(0, len(symbols), stretch), len(symbols)]

    def step(a: np.ndarray | None, symbol: int) -> tuple[np.ndarray, float]:
        a = (start if a is None else a @ move) * emit_t[symbol]
        c = a.sum()
        return a / c, c

    for t, symbol in enumerate(symbols):
        a, c = step(a, symbol)
        total += np.log10(c)
        if t % stretch == 0:
            kept.append((a, c))
    moves, emits, b, weight = np.zeros((k, k)), np.zeros((k, len(emit_t))), np.ones(k), None
    for lo, hi in reversed(list(zip(edges, edges[1:], strict=False))):
        part = symbols[lo:hi]
        alphas, scales = np.empty((hi - lo, k)), np.empty(hi - lo)
        alphas[0], scales[0] = kept.pop()
        for i in range(1, hi - lo):
            alphas[i], scales[i] = step(alphas[i - 1], part[i])
        for i in range(hi - lo - 1, -1, -1):
            if weight is not None:
                moves += move * np.outer(alphas[i], weight)
                b = move @ weight
            weight = emit_t[part[i]] * b / scales[i]
            alphas[i] *= b  # gamma takes alpha's place
        emits += [np.bincount(part, weights=alphas[:, s], minlength=len(emit_t)) for s in range(k)]
    return alphas[0], moves, emits, float(total)


def _groups(sequences: list[np.ndarray], tokens: int = GROUP) -> Iterator[list[int]]:
    """Indices in groups of like length and bounded total."""
    group, size = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        if group and size + len(sequences[i]) > tokens:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(sequences[i])
    if group:
        yield group


def _decode(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in column]


@gives_back
def _gather(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per cell: start s; move (s, s'); emission (s, symbol); likelihood."""
    start, move, emit = model
    emit_t = np.ascontiguousarray(emit.T)
    sums = None
    for batch in batches:
        sequences = _decode(batch.column(0))
        for group in _groups(sequences):
            lone = sequences[group[0]]
            long = len(lone) > GROUP  # then it is the whole group
            part = expected_of_long(lone, start, move, emit_t, GROUP) if long else expected(Batch([sequences[i] for i in group]), start, move, emit_t)
            sums = part if sums is None else tuple(x + y for x, y in zip(sums, part, strict=True))
    if sums is None:
        return
    flat = np.concatenate([sums[0], sums[1].ravel(), sums[2].ravel(), [sums[3]]])
    cells = np.nonzero(flat)[0]
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(flat[cells], pa.float64())], names=["cell", "v"])


def train(sequences: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[float]]:
    """The model after ``rounds`` passes, and the likelihood before each pass."""
    model, history = start_model(counts, states), []
    for _ in range(rounds):
        given = model
        gathered = sequences.select("symbols").mapInArrow(lambda it, m=given: _gather(it, m), "cell int, v double")
        flat = np.zeros(states + states * states + states * len(counts) + 1)
        # Rounded sums do not depend on the order in which tasks end.
        for r in gathered.groupBy("cell").agg(F.sum(F.round(F.col("v") * 1e6).cast("decimal(30,0)")).cast("double").alias("v")).collect():
            flat[r["cell"]] = r["v"] / 1e6
        history.append(flat[-1])
        s, m, e = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 : -1].reshape(states, -1)
        prior = (counts + 1.0) / (counts + 1.0).sum()
        s, m, e = s + 1.0, m + 1.0, e + 10.0 * prior  # smoothing: no symbol is impossible
        model = (s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True))
    return model, history


@gives_back
def _score(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, np.ndarray, np.ndarray], inside: np.ndarray) -> Iterator[pa.RecordBatch]:
    """HMM likelihood less ``inside``, the part of P(token | symbol) that
    depends on the symbol alone."""
    start, move, emit = model
    emit_t = np.ascontiguousarray(emit.T)
    for batch in batches:
        sequences = _decode(batch.column(1))
        score = np.zeros(len(sequences))
        for group in _groups(sequences, 2_000_000):
            b = Batch([sequences[i] for i in group])
            score[[group[i] for i in b.order]] = forward(b, start, move, emit_t)[0]
        score -= [float(inside[s].sum()) for s in sequences]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sequences], pa.int64()), pa.array(score)], names=["row", "n_tokens", "class_score"])


def hmm_scores(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), F.col("text").cast("string").alias("text"))
    vocab = materialize(vocabulary(base.where(~F.col("held_out"))))
    total, distinct = (x or 0 for x in vocab.agg(F.sum("n"), F.count("*")).first())
    first = sorted(most_frequent(vocab, HELD).collect(), key=lambda r: (-r["n"], r["token"]))
    held = {r["token"]: k for k, r in enumerate(first)}
    # By place: symbol, and log10(c + 0.1) for held tokens.
    symbol, value = np.zeros(HELD + TAILS, dtype=np.uint16), np.zeros(HELD + TAILS)
    symbol[HELD:] = np.arange(TOP, SYMBOLS)
    symbol[: len(first)] = [k if k < TOP else r["tail"] for k, r in enumerate(first)]
    value[: len(first)] = [np.log10(r["n"] + ALPHA) for r in first]
    # By symbol: the count of its tokens, and how many distinct ones it has.
    n_symbol, v_symbol = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for k, r in enumerate(first[:TOP]):
        n_symbol[k] = r["n"]
    for r in beyond(vocab, first[:TOP]).groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_symbol[r["tail"]], v_symbol[r["tail"]] = r["n"], r["v"]

    numbered = materialize(base.mapInArrow(lambda it: _encode(it, held, symbol, value), NUMBERED_DDL))
    model, _ = train(numbered.where(~F.col("held_out")), n_symbol, rounds, states)

    # A symbol of one token emits it surely: its own count cancels out.
    inside = np.log10(n_symbol + ALPHA * np.where(np.arange(SYMBOLS) < len(first[:TOP]), 1, v_symbol + 1))
    scored = numbered.select("row", "symbols").mapInArrow(lambda it: _score(it, model, inside), "row long, n_tokens long, class_score double")
    counts = beyond(vocab, first).select("token", "n")
    rare = numbered.select("row", F.explode("rare").alias("token", "times")).join(counts, "token", "left")
    c = F.coalesce("n", F.lit(0))
    # Sums of whole numbers do not depend on the order of the rows.
    rest = rare.groupBy("row").agg((F.sum(F.col("times") * F.round(F.log10(c + ALPHA) * 1e10).cast("long")) / 1e10).alias("rare_sum"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    unit = float(np.log10(total + ALPHA * (distinct + 1)))
    sums = F.col("held_sum") + F.coalesce("rare_sum", F.lit(0.0))
    joined = numbered.select("row", "doc_id", "held_out", "held_sum", "held_known").join(scored, "row").join(rest, "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("held_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (sums - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("class_score") + sums).alias("score"),
    )


def beyond(vocab: DataFrame, first: list) -> DataFrame:
    """The vocabulary after ``first`` in order of falling count, then token."""
    if not first:
        return vocab.where(F.lit(False)) if vocab.isEmpty() else vocab
    n = first[-1]["n"]
    return vocab.where((F.col("n") < n) | (F.col("n") == n) & (F.col("token") > first[-1]["token"]))


#: Base columns in SQL; ``score`` is the model's. CRC-32 is folded over bits: a
#: value from 0 up is a byte to take in, -1 a shift.
ORACLE_BASE = r"""
WITH d AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS tokens,
         list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
           lambda x: [CASE WHEN x = '' THEN NULL ELSE ascii(x) END::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM documents
), h AS (
  SELECT doc_id, tokens, xor(list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 10 = 0 AS held_out,
         row_number() OVER () AS r
  FROM d
), t AS (
  SELECT r, held_out, unnest(tokens) AS token FROM h
), v AS (
  SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token
), n AS (
  SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM v
)
SELECT any_value(h.doc_id) AS doc_id, any_value(h.held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n.n) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)))), 4) AS base_score
FROM h JOIN t USING (r) LEFT JOIN v USING (token) CROSS JOIN n GROUP BY r
"""

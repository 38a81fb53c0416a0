"""DuckDB SQL for the registered queries, built from shared subqueries."""

from __future__ import annotations

from nearvote.config import BLOCK_ROWS, DIMS, EVALUATION_FIRST, EVALUATION_QUERIES, ITERATIONS, MCC_RISK, PARTITION_ABOVE, PARTITION_DIMS, PARTITIONS
from nearvote.sources.fixtures import MCCS, QUERY_EVERY

NLIST, GROUP = 32, 8
#: Paths that requests ask for, by turns.
PATHS = ("/fraud-score", "/ready", "/fraud-score?x=1", "/other")
ALL = range(DIMS)


def each(pattern: str, sep: str = ", ") -> str:
    return sep.join(pattern.format(d=d) for d in ALL)


_risk = " ".join(f"WHEN '{k}' THEN {v}::FLOAT" for k, v in sorted(MCC_RISK.items()))
_mccs = ", ".join(f"'{m}'" for m in MCCS)
EVENTS = f"""
ev AS (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts, [{_mccs}][event_id % 12 + 1] AS mcc FROM events
)"""


def clamp(x: str) -> str:
    return f"greatest(0::FLOAT, least(1::FLOAT, {x}))"


def _features(minutes: str) -> list[str]:
    average = "(((user_id * 37) % 400 + 1) * 5)::FLOAT"
    return [
        clamp("(value * 20)::FLOAT / 10000::FLOAT"),
        clamp("(event_id % 12 + 1)::FLOAT / 12::FLOAT"),
        clamp(f"((value * 20)::FLOAT / {average}) / 10::FLOAT"),
        "hour(ts)::FLOAT / 23::FLOAT",
        "(isodow(ts) - 1)::FLOAT / 6::FLOAT",
        f"CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {clamp(minutes)} END",
        f"CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {clamp('((event_id * 17) % 1100)::FLOAT / 1000::FLOAT')} END",
        clamp("((event_id * 31) % 1200)::FLOAT / 1000::FLOAT"),
        clamp("((event_id * 7) % 25)::FLOAT / 20::FLOAT"),
        "(event_id % 2 = 1)::INT::FLOAT",
        "(event_id % 3 = 0)::INT::FLOAT",
        "(event_id % 50 NOT IN (user_id % 50, (user_id + 7) % 50))::INT::FLOAT",
        f"CASE mcc {_risk} ELSE 0.5::FLOAT END",
        clamp("(((event_id * 53) % 2000) * 6)::FLOAT / 10000::FLOAT"),
    ]


def quantized(x: str) -> str:
    return f"round(({x}) * 10000::FLOAT)::INT"


WHOLE_MINUTES = "(epoch_us(ts) // 60000000 - epoch_us(last_ts) // 60000000)"


def _vec(name: str, minutes: str) -> str:
    columns = ", ".join(f"{quantized(f)} AS q{d}" for d, f in enumerate(_features(minutes)))
    return f"{name} AS (SELECT event_id AS pos, (event_type = 'error')::INT AS label, {columns} FROM ev)"


VEC = EVENTS + ", " + _vec("vec", f"{WHOLE_MINUTES}::FLOAT / 1440::FLOAT")
EXACT = EVENTS + ", " + _vec("vec", "(greatest(epoch_us(ts) // 1000000 - epoch_us(last_ts) // 1000000, 0)::FLOAT / 60::FLOAT) / 1440::FLOAT")
PKEY = " + ".join(f"(q{d} > {PARTITION_ABOVE})::INT * {1 << b}" for b, d in enumerate(PARTITION_DIMS))
SPLIT = (
    VEC
    + f""",
keyed AS (SELECT *, {PKEY} AS pkey FROM vec),
qs AS (SELECT pos AS qid, pkey, {each('q{d} AS a{d}')} FROM keyed WHERE pos % {QUERY_EVERY} = 0),
rs AS (
  SELECT pkey, label, {each('q{d}')}, row_number() OVER (ORDER BY pkey, q8, q1, q3, q4, pos) - 1 AS pos,
         (row_number() OVER (PARTITION BY pkey ORDER BY q8, q1, q3, q4, pos) - 1) // {BLOCK_ROWS} AS block
  FROM keyed
)"""
)


def dist(a: str, b: str) -> str:
    return each(f"({a}{{d}} - {b}{{d}})::BIGINT * ({a}{{d}} - {b}{{d}})", " + ")


def top(rows: str, order: str, k: int = 5, keep: str = "*") -> str:
    return f"SELECT {keep} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rk FROM ({rows})) WHERE rk <= {k}"


def voted(hits: str, queries: str = "qs") -> str:
    return f"SELECT qid, coalesce(sum(label), 0)::BIGINT AS votes, count(label)::BIGINT AS hits FROM {queries} LEFT JOIN ({hits}) USING (qid) GROUP BY qid"


EXACT_HITS = top(f"SELECT qid, r.pos, label, {dist('a', 'q')} AS d FROM qs, vec r", "d, pos")
PART_HITS = top(f"SELECT qid, r.pos, label, {dist('a', 'q')} AS d FROM qs JOIN rs r USING (pkey)", "d, pos", keep="qid, label")
PART_VOTES = f"WITH {SPLIT} {voted(PART_HITS)}"


def _kmeans(iterations: int) -> str:
    sql = SPLIT + f""", size AS (SELECT count(*) AS n FROM rs),
k0 AS (SELECT (pos // (n // {NLIST}))::INT AS cell, {each('q{d}::BIGINT AS c{d}')} FROM rs, size WHERE pos % (n // {NLIST}) = 0 AND pos // (n // {NLIST}) < {NLIST})"""
    for i in range(1, iterations + 1):
        sql += f""",
p{i} AS (SELECT pos, label, {each('q{d}')}, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d, cell) AS rk FROM (SELECT rs.*, cell, {dist('q', 'c')} AS d FROM rs, k{i - 1})) WHERE rk = 1),
k{i} AS (SELECT k.cell, {each('coalesce(s.c{d}, k.c{d})::BIGINT AS c{d}')} FROM k{i - 1} k LEFT JOIN (
  SELECT cell, {each('sum(q{d}) // count(*) AS c{d}')} FROM p{i} GROUP BY cell) s USING (cell))"""
    return sql


IVF = _kmeans(ITERATIONS)
CELLS, CENTROIDS = f"p{ITERATIONS}", f"k{ITERATIONS}"


def probes(queries: str) -> str:
    rows = f"SELECT qid, {each('a{d}')}, cell, {dist('a', 'c')} AS d FROM {queries}, {CENTROIDS}"
    return f"SELECT qid, {each('a{d}')}, rk AS probe_rank, cell, d FROM ({top(rows, 'd, cell', 3)})"


def ivf_hits(queries: str) -> str:
    rows = f"SELECT qid, probe_rank, r.pos, label, {dist('a', 'q')} AS d FROM ({probes(queries)}) p JOIN {CELLS} r USING (cell)"
    return top(rows, "d, probe_rank, pos", keep="qid, label")


IVF_VOTES = f"WITH {IVF} SELECT qid, votes FROM ({voted(ivf_hits('qs'))})"
_filled = f"SELECT i::INT AS cell, coalesce(n, 0)::BIGINT AS n FROM range({NLIST}) t(i) LEFT JOIN (SELECT cell, count(*) AS n FROM {CELLS} GROUP BY cell) c ON c.cell = i"

ORACLES: dict[str, str] = {
    "vectorize_tx": f"WITH {VEC} SELECT * FROM vec",
    "vectorize_tx_exact": f"WITH {EXACT} SELECT pos, q5 FROM vec",
    "time_features": "SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, (ts::DATE - DATE '1970-01-01')::INT AS epoch_day FROM events",
    "minutes_since_last": f"WITH {EVENTS} SELECT event_id, {WHOLE_MINUTES}::BIGINT AS minutes FROM ev",
    "unknown_merchant_flag": "SELECT event_id, (event_id % 50 NOT IN (user_id % 50, (user_id + 7) % 50))::INT AS flag FROM events",
    "mcc_risk_lookup": f"WITH {EVENTS} SELECT event_id, mcc, {quantized(_features('0')[12])} AS risk_q FROM ev",
    "json_extract_props": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events",
    "quantize_embeddings": "SELECT vec_id, (i - 1)::INT AS dim, round(embedding[i] * 10000::FLOAT)::INT AS q FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "partition_key": f"WITH {VEC} SELECT pos, {PKEY} AS pkey FROM vec",
    "partition_offsets": f"""WITH {SPLIT}, c AS (
  SELECT i::INT AS pkey, coalesce(n, 0)::BIGINT AS n FROM range({PARTITIONS}) t(i) LEFT JOIN (SELECT pkey, count(*) AS n FROM rs GROUP BY pkey) g ON g.pkey = i)
SELECT pkey, n, (sum(n) OVER (ORDER BY pkey) - n)::BIGINT AS row_offset,
       (sum((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) OVER (ORDER BY pkey) - (n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS})::BIGINT AS block_offset FROM c""",
    "block_bounds": f"WITH {SPLIT} SELECT pkey, block, {each('min(q{d}) AS min{d}')}, {each('max(q{d}) AS max{d}')}, count(*) AS n FROM rs GROUP BY pkey, block",
    "block_lower_bounds": f"""WITH {SPLIT}, b AS (SELECT pkey, block, {each('min(q{d}) AS lo{d}')}, {each('max(q{d}) AS hi{d}')} FROM rs GROUP BY pkey, block)
SELECT qid, pkey, block, ({each('greatest(lo{d} - a{d}, a{d} - hi{d}, 0)::BIGINT * greatest(lo{d} - a{d}, a{d} - hi{d}, 0)', ' + ')})::BIGINT AS lb FROM qs JOIN b USING (pkey)""",
    "dataset_meta": f"WITH {SPLIT} SELECT count(*) AS total, sum(label)::BIGINT AS fraud, (count(*) - sum(label))::BIGINT AS legit FROM rs",
    "index_ready": f"WITH {SPLIT} SELECT count(*) >= 5 AS ready FROM rs",
    "knn_exact_top5": f"WITH {SPLIT} SELECT qid, rk, pos, d FROM ({EXACT_HITS})",
    "knn_embeddings_top5": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 10000::FLOAT)::BIGINT) AS e FROM embeddings),
p AS (SELECT q.vec_id AS qid, r.vec_id AS pos, list_sum(list_transform(list_zip(q.e, r.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM v q, v r WHERE q.vec_id % {QUERY_EVERY} = 0)
{top('SELECT * FROM p', 'd, pos', keep='qid, rk, pos, d')}""",
    "fraud_decision": f"WITH {SPLIT} SELECT qid, votes, votes / 5.0::DOUBLE AS fraud_score, votes < 3 AS approved FROM ({voted(EXACT_HITS)})",
    "knn_partition_top5": PART_VOTES,
    "knn_block_pruned_top5": PART_VOTES,
    "ivf_seed_centroids": f"WITH {_kmeans(0)} SELECT * FROM k0",
    "ivf_assign": f"WITH {_kmeans(1)} SELECT pos, cell FROM p1",
    "ivf_kmeans_iter": f"WITH {IVF} SELECT k.cell, coalesce(n, 0)::BIGINT AS n, {each('c{d}')} FROM {CENTROIDS} k LEFT JOIN (SELECT cell, count(*) AS n FROM {CELLS} GROUP BY cell) USING (cell)",
    "ivf_cell_offsets": f"WITH {IVF} SELECT cell, n, (sum(n) OVER (ORDER BY cell) - n)::BIGINT AS row_offset FROM ({_filled})",
    "ivf_cell_stats": f"WITH {IVF} SELECT max(n)::BIGINT AS max_n, min(n)::BIGINT AS min_n, (sum(n) // {NLIST})::BIGINT AS avg_n FROM ({_filled}) WHERE n > 0",
    "ivf_coarse_centroids": f"WITH {IVF} SELECT (cell // {GROUP})::INT AS grp, {each(f'(sum(c{{d}}) // {GROUP})::BIGINT AS c{{d}}')} FROM {CENTROIDS} GROUP BY 1",
    "ivf_probe_top3": f"WITH {IVF} SELECT qid, probe_rank, cell, d FROM ({probes('qs')})",
    "ivf_votes": IVF_VOTES,
    "stream_score": IVF_VOTES,
    "stream_bad_requests": f"WITH {IVF} SELECT qid, CASE WHEN qid % {7 * QUERY_EVERY} = 0 THEN 400 ELSE 200 END AS status, CASE WHEN qid % {7 * QUERY_EVERY} <> 0 THEN votes END AS votes FROM ({voted(ivf_hits('qs'))})",
    "route_requests": f"""SELECT event_id, CASE WHEN user_id % 2 = 0 AND path[1:12] = '/fraud-score' THEN 'score' WHEN user_id % 2 <> 0 AND path[1:6] = '/ready' THEN 'ready' ELSE 'unknown' END AS asked
FROM (SELECT *, [{', '.join(f"'{p}'" for p in PATHS)}][event_id % {len(PATHS)} + 1] AS path FROM events)""",
    "reference_scan": f"WITH {VEC} SELECT label, {each('q{d}')} FROM vec",
    "index_round_trip": f"WITH {IVF} SELECT rs.pos, rs.pkey, rs.block, rs.label, c.cell, {each('rs.q{d}')} FROM rs JOIN {CELLS} c USING (pos)",
    "accuracy_report": f"""WITH {IVF}, es AS (
  SELECT r.pos AS qid, {each('q{d} AS a{d}')} FROM rs r, size
  WHERE r.pos >= {EVALUATION_FIRST} AND (r.pos - {EVALUATION_FIRST}) % greatest(1, n // {EVALUATION_QUERIES}) = 0
    AND r.pos - {EVALUATION_FIRST} < greatest(1, n // {EVALUATION_QUERIES}) * {EVALUATION_QUERIES}
), e AS ({voted(top(f"SELECT qid, r.pos, label, {dist('a', 'q')} AS d FROM es, rs r", 'd, pos', keep='qid, label'), 'es')}),
a AS ({voted(ivf_hits('es'), 'es')})
SELECT count(*) AS queries, round(100 * avg(CASE WHEN e.votes = a.votes THEN 1.0 ELSE 0.5 END), 4) AS vote_match_pct,
       sum(((e.votes >= 3) <> (a.votes >= 3))::INT)::BIGINT AS mismatches, round(100 * avg(((e.votes >= 3) <> (a.votes >= 3))::INT), 4) AS mismatch_pct,
       round(avg(e.votes), 4) AS avg_exact, round(avg(a.votes), 4) AS avg_ivf FROM e JOIN a USING (qid)""",
}

"""DuckDB SQL of the queries, written apart from the DataFrame code."""

from __future__ import annotations


def _len(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


def _cos(a: str, b: str) -> str:
    return f"(CASE WHEN {_len(a)} < 1e-8 OR {_len(b)} < 1e-8 THEN 0.0::DOUBLE ELSE list_dot_product({a}, {b}) / ({_len(a)} * {_len(b)}) END)"


def _unit(a: str) -> str:
    return f"(CASE WHEN {_len(a)} > 1e-8 THEN list_transform({a}, lambda x: x / {_len(a)}) ELSE {a} END)"


def _mix(a: str, b: str, wa: str, wb: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: {wa} * p[1] + {wb} * p[2])"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


MEM = """
WITH RECURSIVE emb AS (SELECT label::BIGINT AS store_id, vec_id::BIGINT AS mem_id, embedding::DOUBLE[] AS key FROM embeddings),
mem AS (SELECT store_id, mem_id, key, coalesce(lead(key) OVER w, first_value(key) OVER w) AS value, 1.0::DOUBLE + (mem_id % 7) * 0.25::DOUBLE AS strength, row_number() OVER w AS ts FROM emb WINDOW w AS (PARTITION BY store_id ORDER BY mem_id)),
state AS (SELECT store_id, max(ts) + 1 AS now, arg_max(key, ts) AS context FROM mem GROUP BY store_id)"""

PAIRS = f""",
pairs AS (SELECT q.store_id, q.mem_id AS query_id, m.mem_id, m.ts, m.strength, m.key, m.value, q.key AS q, {_cos("q.key", "m.key")} AS kk, {_cos("q.key", "m.value")} AS kv FROM mem q JOIN mem m ON q.store_id = m.store_id)"""

CENTRES = f""",
sums AS (SELECT store_id, i, sum(key[i]) AS x FROM mem, range(1, 65) r(i) GROUP BY store_id, i),
raw AS (SELECT store_id, list(x ORDER BY i) AS v FROM sums GROUP BY store_id),
centres AS (SELECT store_id AS query_id, store_id, {_unit("v")} AS q FROM raw)"""

CPAIRS = f""",
pairs AS (SELECT q.store_id, q.query_id, m.mem_id, m.ts, m.strength, m.key, m.value, q.q, {_cos("q.q", "m.key")} AS kk, {_cos("q.q", "m.value")} AS kv FROM centres q JOIN mem m ON q.store_id = m.store_id)"""


def _edges(displaced: bool = False) -> str:
    alike = f"0.5 * {_cos('a.key', 'b.key')} + 0.5 * {_cos('a.value', 'b.value')}"
    source = "mem"
    extra = ""
    if displaced:
        extra = f""",
moved AS (SELECT *, {_mix("value", "key", "1.0", "-1.0")} AS shift FROM mem)"""
        source = "moved"
        alike = f"({alike} + 0.3 * {_cos('a.shift', 'b.shift')}) / 1.3"
    return f"""{extra},
half AS (SELECT a.store_id, a.mem_id AS src, b.mem_id AS dst, ({alike}) * exp(-(b.ts - a.ts) / 5.0) AS weight FROM {source} a JOIN {source} b ON a.store_id = b.store_id AND b.ts > a.ts AND b.ts - a.ts <= 30),
edges AS (SELECT * FROM half WHERE weight >= 0.02 UNION ALL SELECT store_id, dst, src, weight FROM half WHERE weight >= 0.02)"""


def _heads(context: bool = True, recency: bool = True, h4: str = "exp(-greatest(s.now - p.ts, 0) / 10.0)") -> str:
    h3 = f"greatest({_cos('s.context', 'p.key')}, 0.0)" if context else "0.0"
    w = [0.45, 0.2, 0.2, 0.15 if recency else 0.0]
    return f""",
heads AS (SELECT p.*, greatest(kk, 0.0) AS h1, greatest(kv, 0.0) AS h2, {h3} AS h3, {h4} AS h4 FROM pairs p JOIN state s ON p.store_id = s.store_id),
scored AS (SELECT *, pow(greatest(strength, 1e-10), 0.3) * ({w[0] / sum(w)!r}::DOUBLE * h1 + {w[1] / sum(w)!r}::DOUBLE * h2 + {w[2] / sum(w)!r}::DOUBLE * h3 + {w[3] / sum(w)!r}::DOUBLE * h4) AS score FROM heads)"""


def _ranked(k: int | str = 5, source: str = "scored", name: str = "ranked", where: str = "score >= 0.01") -> str:
    return f""",
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS rank FROM {source}) WHERE rank <= {k} AND {where})"""


SHOW = f"\nSELECT query_id, rank, mem_id, {_r('score')} AS score FROM ranked"
DENSE = ",\nscored AS (SELECT *, kk AS score FROM pairs)"
ACTIVATION = ",\nact AS (SELECT query_id, store_id, mem_id, strength * greatest(0.0, kk) AS s0, kk AS sim FROM pairs)"


def _spread(debias: bool = False, multiscale: bool = False, aware: bool = False, start: str = ACTIVATION) -> str:
    sql, weight, combine, hops = start, "e.weight", "avg", 4 if multiscale else 2
    sql += ",\nst0 AS (SELECT *, 0.5 * greatest(max(abs(s0)) OVER (PARTITION BY query_id, store_id), 1e-12) AS cap FROM act)"
    if debias:
        sql += ",\ndeg AS (SELECT store_id, src, count(*)::DOUBLE AS n FROM edges GROUP BY ALL),\nnet AS (SELECT e.store_id, e.src, e.dst, e.weight / (sqrt(a.n) * sqrt(b.n)) AS weight FROM edges e JOIN deg a ON e.store_id = a.store_id AND e.src = a.src JOIN deg b ON e.store_id = b.store_id AND e.dst = b.src)"
        combine = "sum"
    else:
        sql += ",\nnet AS (SELECT * FROM edges)"
    for h in range(hops):
        eta = 0.5 * (0.7**h if multiscale else 1.0)
        held = f"s.s{h} * greatest(0.0, s.sim)" if aware else f"s.s{h}"
        change = "coalesce(g.got, 0.0)"
        if debias:
            change = f"greatest(-t.cap, least(t.cap, {change}))"
        sql += f""",
got{h} AS (SELECT s.query_id, s.store_id, e.src AS mem_id, {combine}({weight} * {held}) AS got FROM st{h} s JOIN net e ON e.store_id = s.store_id AND e.dst = s.mem_id GROUP BY ALL),
st{h + 1} AS (SELECT t.*, t.s{h} + {eta!r}::DOUBLE * {change} AS s{h + 1} FROM st{h} t LEFT JOIN got{h} g ON t.query_id = g.query_id AND t.store_id = g.store_id AND t.mem_id = g.mem_id)"""
    out = f"({' + '.join(f's{h}' for h in range(hops + 1))}) / {hops + 1}" if multiscale else f"s{hops}"
    return sql + f",\nspread AS (SELECT query_id, store_id, mem_id, {out} AS activation FROM st{hops})"


SPREAD = f"\nSELECT query_id, mem_id, {_r('activation')} AS activation FROM spread"
COLLECT = f"\nSELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, mem_id) AS rank, mem_id, {_r('activation')} AS activation FROM spread WHERE activation >= 0.01"

INCOMING = f""",
met AS (SELECT n.store_id, n.mem_id, n.ts, n.key AS e_in, n.value AS e_out, m.mem_id AS m_mem_id, m.ts AS m_ts, m.key AS m_key, m.value AS m_value, m.strength AS m_strength, {_cos("n.key", "m.key")} AS kk, {_cos("n.value", "m.key")} AS ok, {_cos("n.value", "m.value")} AS ov FROM mem n JOIN mem m ON n.store_id = m.store_id AND m.ts < n.ts),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mem_id ORDER BY kk DESC, m_ts) AS place FROM met) WHERE place = 1)"""

ENTROPY = """,
most AS (SELECT store_id, mem_id, max(ok) AS top, count(*) AS n FROM met GROUP BY ALL),
lifted AS (SELECT m.store_id, m.mem_id, o.n, exp((m.ok - o.top) / 0.5) AS x FROM met m JOIN most o ON m.mem_id = o.mem_id),
entropy AS (SELECT mem_id, CASE WHEN any_value(n) < 2 THEN 0.0 ELSE sum(-p * ln(p)) / ln(any_value(n)::DOUBLE) END AS entropy FROM (SELECT *, greatest(least(x / sum(x) OVER (PARTITION BY mem_id), 1.0), 1e-10) AS p FROM lifted) GROUP BY mem_id)"""


def _drift(soft: bool) -> str:
    by = "0.5 * (1.0 - ov)" if soft else "0.5"
    return MEM + INCOMING + f""",
moved AS (SELECT mem_id, e_out, m_value, {_mix("m_value", "e_out", f"(1.0 - {by})", f"({by})")} AS v FROM best),
drifted AS (SELECT *, {_unit("v")} AS d FROM moved)
SELECT mem_id, {_r(_len("d"))} AS length, {_r("list_dot_product(d, e_out)")} AS to_output, {_r("list_dot_product(d, m_value)")} AS to_value FROM drifted"""


def _embed(source: str, keys: str, text: str, name: str) -> str:
    """Table ``name`` (keys, e): unit hash embedding of a text."""
    return f""",
{name}_b AS (SELECT {keys}, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}) GROUP BY ALL),
{name}_m AS (SELECT {keys}, map(list(b), list(n)) AS m FROM {name}_b GROUP BY ALL),
{name}_v AS (SELECT {keys}, CASE WHEN m IS NULL THEN list_transform(range(64), lambda i: 0.0::DOUBLE) ELSE list_transform(range(64), lambda i: coalesce(m[i::INT], 0.0::DOUBLE)) END AS v FROM {source} LEFT JOIN {name}_m USING ({keys})),
{name} AS (SELECT {keys}, {_unit("v")} AS e FROM {name}_v)"""


TURNS = """
WITH RECURSIVE turns AS (SELECT conv_id AS store_id, turn::BIGINT AS turn, role, text FROM conversations),
talk AS (SELECT store_id, turn, text AS input_text, coalesce(lead(text) OVER (PARTITION BY store_id ORDER BY turn), '[End of conversation on ' || store_id || ']') AS output_text FROM turns)"""

WORDS = "list_filter(string_split_regex(regexp_replace(lower({}), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'and'))"


def _f1(source: str, keys: str, p: str, t: str, name: str) -> str:
    """Table ``name`` (keys, f1)."""
    return f""",
{name}_w AS (SELECT {keys}, {WORDS.format(p)} AS p, {WORDS.format(t)} AS t FROM {source}),
{name}_p AS (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys}, unnest(p) AS w FROM {name}_w) GROUP BY ALL),
{name}_t AS (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys}, unnest(t) AS w FROM {name}_w) GROUP BY ALL),
{name}_s AS (SELECT {keys}, sum(least(a.n, b.n)) AS s FROM {name}_p a JOIN {name}_t b USING ({keys}, w) GROUP BY ALL),
{name} AS (SELECT {keys}, CASE WHEN s > 0 THEN 2.0::DOUBLE * s / (len(p) + len(t)) ELSE 0.0 END AS f1 FROM {name}_w LEFT JOIN {name}_s USING ({keys}))"""


LEXICAL = """
WITH words AS (SELECT doc_id AS mem_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
idx AS (SELECT mem_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)"""

BM25 = LEXICAL + """,
size AS (SELECT doc_id AS mem_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::DOUBLE AS size FROM documents),
whole AS (SELECT count(*)::DOUBLE AS n, avg(size) AS mean FROM size),
bm AS (SELECT a.query_id, i.mem_id, sum(a.tf * ln(1.0 + (w.n - d.df + 0.5) / (d.df + 0.5)) * i.tf * 2.5 / (i.tf + 1.5 * (0.25 + 0.75 * s.size / w.mean))) AS bm25 FROM asked a JOIN df d ON a.term = d.term JOIN idx i ON i.term = a.term JOIN size s ON s.mem_id = i.mem_id CROSS JOIN whole w GROUP BY ALL)"""

HIERARCHY = f""",
l2s AS (SELECT store_id, store_id * 4 + ts % 4 AS l2_id, i, sum(strength * key[i]) / sum(strength) AS k, sum(strength * value[i]) / sum(strength) AS v FROM mem, range(1, 65) r(i) GROUP BY ALL),
l2r AS (SELECT store_id, l2_id, list(k ORDER BY i) AS k, list(v ORDER BY i) AS v FROM l2s GROUP BY ALL),
l2 AS (SELECT store_id, l2_id, {_unit("k")} AS key, {_unit("v")} AS value FROM l2r),
l2t AS (SELECT store_id * 4 + ts % 4 AS l2_id, sum(strength) AS strength FROM mem GROUP BY ALL),
l3s AS (SELECT store_id, store_id * 2 + l2.l2_id % 2 AS l3_id, i, sum(t.strength * key[i]) / sum(t.strength) AS k, sum(t.strength * value[i]) / sum(t.strength) AS v FROM l2 JOIN l2t t ON t.l2_id = l2.l2_id, range(1, 65) r(i) GROUP BY ALL),
l3r AS (SELECT store_id, l3_id, list(k ORDER BY i) AS k, list(v ORDER BY i) AS v FROM l3s GROUP BY ALL),
l3 AS (SELECT store_id, l3_id, {_unit("k")} AS key, {_unit("v")} AS value FROM l3r)"""

GOLD = """,
gold AS (SELECT q.mem_id AS query_id, m.mem_id FROM mem q JOIN mem m ON q.store_id = m.store_id AND m.ts = q.ts + 1)"""
HITS = _ranked(12, where="true") + GOLD + """,
hits AS (SELECT g.query_id, g.query_id % 5 AS category, (EXISTS (SELECT 1 FROM ranked r WHERE r.query_id = g.query_id AND r.mem_id = g.mem_id))::INT AS hit FROM gold g)"""

TAIL = "least(1.0, 2.0 * list_sum(list_transform(range(0, least(n01, n10) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2)))))"

LINE = """'[' || CASE WHEN score >= 1.0 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END || ']' || {} || ' User said: "said ' || mem_id || '" → You replied: "replied ' || ts || '" (strength: ' || printf('%.2f', strength) || ')'"""
TAG = "CASE WHEN mem_id % 3 = 0 THEN ' [fact]' WHEN mem_id % 3 = 1 THEN ' [hobby]' ELSE '' END"
TENSION = f""",
roles AS (SELECT r.*, CASE WHEN r.rank > 1 AND {_cos("t.key", "r.key")} > 0.2 AND {_cos("t.value", "r.value")} < 0.0 THEN 'conflicting' ELSE 'supporting' END AS role FROM ranked r JOIN ranked t ON t.query_id = r.query_id AND t.rank = 1)"""

RECALLED = MEM + PAIRS + _heads() + _ranked()
ALPHA = "1.0 / (1.0 + exp(-8.0 * (best - 0.3)))"
EFFECTIVE = f""",
sure AS (SELECT query_id, max(kk) AS best FROM pairs GROUP BY query_id),
blended AS (SELECT c.query_id, c.store_id, c.q, s.context, {ALPHA} AS alpha, {_mix("c.q", "s.context", f"({ALPHA})", f"(1.0 - {ALPHA})")} AS v FROM centres c JOIN sure USING (query_id) JOIN state s ON s.store_id = c.store_id),
eff AS (SELECT query_id, store_id, q, context, alpha, {_unit("v")} AS q_eff FROM blended)"""
FEEDBACK = DENSE + _ranked(15, where="true") + f""",
aligned AS (SELECT r.store_id, r.mem_id, r.rank, r.strength, {_cos("s.context", "r.value")} AS a FROM ranked r JOIN state s ON s.store_id = r.store_id)"""


GATE = (
    MEM
    + INCOMING
    + ENTROPY
    + f""",
sig AS (SELECT mem_id, max(kk) AS best, max(ok) AS r_out, max(ov) AS r_val FROM met GROUP BY mem_id),
mixed(store_id, ts, v) AS (SELECT store_id, ts, key FROM mem WHERE ts = 1 UNION ALL SELECT s.store_id, s.ts, (SELECT {_unit("u")} FROM (SELECT {_mix("m.v", "s.key", "0.7::DOUBLE", "0.3::DOUBLE")} AS u)) FROM mixed m JOIN mem s ON s.store_id = m.store_id AND s.ts = m.ts + 1),
along AS (SELECT a.mem_id, {_cos("a.key", "b.v")} AS d_ctx FROM mem a JOIN mixed b ON a.store_id = b.store_id AND b.ts = a.ts - 1),
g AS (SELECT s.*, d_ctx, 1.0 / (1.0 + exp(-6.0 * (greatest(0.0, least(1.0, 1.0 - best - (0.15 * r_out + 0.05 * r_val + 0.5 * CASE WHEN d_ctx > 0.05 THEN pow(least((d_ctx - 0.05) / (1.0 - 0.05 + 1e-8), 1.0), 1.5) ELSE 0.0 END + 0.1 * entropy))) - 0.4))) AS gate FROM sig s JOIN along USING (mem_id) JOIN entropy USING (mem_id))
SELECT mem_id, {_r("best")} AS best, {_r("r_out")} AS r_out, {_r("r_val")} AS r_val, {_r("d_ctx")} AS d_ctx, {_r("gate")} AS gate, CASE WHEN best >= 0.45 THEN 'strengthened' WHEN r_out >= 0.5 OR gate < 0.12 THEN 'filtered' ELSE 'created' END AS action FROM g"""
)
GATED = ",\ngates AS (SELECT".join(GATE.rsplit("\nSELECT", 1)) + ")"
ACTIONS = ",\nacts AS (SELECT mem_id % 10 AS store_id, action FROM gates),\nper AS (SELECT store_id, count(*) AS turns, count(*) FILTER (action = 'filtered') AS filtered, count(*) FILTER (action IN ('created', 'contradiction')) AS memories FROM acts GROUP BY store_id),\nstats AS (SELECT count(*) AS stores, avg(memories) AS avg_memories, 100.0::DOUBLE * sum(filtered) / sum(turns) AS filtered_pct FROM per)"
RESULTS = _f1("talk", "store_id, turn", "output_text", "input_text", "f") + """,
results AS (SELECT store_id, (turn % 5 + 1)::INT AS category, f1, (f1 >= 0.1)::INT AS judge, turn % 4 AS num_recalled, turn % 2 = 0 AS gold_present FROM f),
parts AS (SELECT 'category ' || category AS section, * FROM results UNION ALL SELECT 'overall', * FROM results UNION ALL SELECT 'answerable', * FROM results WHERE category <> 5 UNION ALL SELECT CASE WHEN gold_present THEN 'answerable, gold present' ELSE 'answerable, gold absent' END, * FROM results WHERE category <> 5),
summary AS (SELECT section, count(*) AS n, round(avg(f1), 4) AS f1, round(avg(judge), 4) AS judge, round(avg(num_recalled), 2) AS recalled, round(100.0::DOUBLE * avg(gold_present::INT), 1) AS gold_pct FROM parts GROUP BY section)"""


def queries() -> dict[str, str]:
    out = {
        "dense_topk": MEM + PAIRS + DENSE + _ranked(where="true") + SHOW,
        "weighted_recall_value": MEM + PAIRS + f"\nSELECT query_id, (i - 1)::INT AS pos, {_r('CASE WHEN sum(strength * kk) >= 1e-8 THEN sum(strength * kk * value[i]) / sum(strength * kk) END')} AS x FROM pairs, range(1, 65) r(i) GROUP BY query_id, i HAVING sum(strength * kk) >= 1e-8",
        "effective_query": MEM + CENTRES + CPAIRS + EFFECTIVE + f"\nSELECT query_id, {_r('alpha')} AS alpha, {_r(_cos('q_eff', 'q'))} AS to_query, {_r(_cos('q_eff', 'context'))} AS to_context, {_r(_len('q_eff'))} AS length FROM eff",
        "multi_head_recall": RECALLED + SHOW,
        "multi_head_recall_transcript": MEM + PAIRS + _heads(context=False, recency=False) + _ranked() + SHOW,
        "adaptive_heads": MEM
        + PAIRS
        + _heads()
        + f""",
mx AS (SELECT query_id, max(h1) AS m1, max(h2) AS m2, max(h3) AS m3, max(h4) AS m4 FROM heads GROUP BY query_id),
ex AS (SELECT query_id, exp((m1 - top) / 0.5) AS e1, exp((m2 - top) / 0.5) AS e2, exp((m3 - top) / 0.5) AS e3, exp((m4 - top) / 0.5) AS e4, exp((0.0 - top) / 0.5) AS e5 FROM (SELECT *, greatest(m1, m2, m3, m4, 0.0) AS top FROM mx)),
soft AS (SELECT h.query_id, h.mem_id, pow(greatest(strength, 1e-10), 0.3) * (e1 * h1 + e2 * h2 + e3 * h3 + e4 * h4) / (e1 + e2 + e3 + e4 + e5) AS score FROM heads h JOIN ex USING (query_id)){_ranked(source="soft")}"""
        + SHOW,
        "adaptive_k_recall": MEM + CENTRES + CPAIRS + _heads() + ",\ndeep AS (SELECT *, least(ceil(5 * (1.0 + 1.0 * (1.0 - greatest(0.0, max(h1) OVER (PARTITION BY query_id))))), 15) AS k FROM scored)" + _ranked("k", source="deep") + SHOW,
        "actr_recall": MEM
        + PAIRS
        + """,
lv AS (SELECT m.*, s.now, ln(greatest((CASE WHEN ts > 3 THEN pow(greatest(s.now - (ts - 3), 1), -0.5) ELSE 0.0 END) + pow(greatest(s.now - ts, 1), -0.5), 1e-10)) AS b FROM mem m JOIN state s USING (store_id)),
h4 AS (SELECT mem_id, CASE WHEN max(b) OVER w - min(b) OVER w > 1e-8 THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0.5 END AS v FROM lv WINDOW w AS (PARTITION BY store_id))"""
        + _heads(h4="(SELECT v FROM h4 WHERE h4.mem_id = p.mem_id)")
        + _ranked()
        + SHOW,
        "access_delta": RECALLED + "\nSELECT store_id, mem_id, count(*) AS accesses FROM ranked GROUP BY ALL",
        "actr_base_level": f"""WITH e AS (SELECT user_id, floor(epoch(ts) / 60)::BIGINT AS minute FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY minute DESC) AS place FROM e) WHERE place <= 20),
n AS (SELECT max(minute) + 1 AS now FROM e),
b AS (SELECT user_id, ln(greatest(sum(pow(greatest(now - minute, 1), -0.5)), 1e-10)) AS level FROM l, n GROUP BY user_id)
SELECT user_id, {_r("level")} AS level, {_r("CASE WHEN max(level) OVER () - min(level) OVER () > 1e-8 THEN (level - min(level) OVER ()) / (max(level) OVER () - min(level) OVER ()) ELSE 0.5 END")} AS head FROM b""",
        "tension_split": RECALLED + TENSION + "\nSELECT query_id, rank, mem_id, role FROM roles",
        "edge_band_join": MEM + _edges() + f"\nSELECT store_id, src, dst, {_r('weight')} AS weight FROM edges",
        "edge_displacement": MEM + _edges(True) + f"\nSELECT store_id, src, dst, {_r('weight')} AS weight FROM edges",
        "edge_degrees": MEM + _edges() + "\nSELECT store_id, src AS mem_id, count(*) AS degree FROM edges GROUP BY ALL",
        "neighbors_top3": MEM + _edges() + f"\nSELECT store_id, src, dst, rank, {_r('weight')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY store_id, src ORDER BY weight DESC, dst) AS rank FROM edges) WHERE rank <= 3",
        "graph_counts": MEM + _edges() + "\nSELECT m.store_id, count(*) AS nodes, coalesce((SELECT count(*) // 2 FROM edges e WHERE e.store_id = m.store_id), 0) AS edges FROM mem m GROUP BY m.store_id",
        "spread_mean_2hop": MEM + CENTRES + CPAIRS + _edges() + _spread() + SPREAD,
        "spread_gcn_sym": MEM + CENTRES + CPAIRS + _edges() + _spread(debias=True) + SPREAD,
        "spread_multiscale": MEM + CENTRES + CPAIRS + _edges() + _spread(multiscale=True) + SPREAD,
        "spread_query_aware": MEM + CENTRES + CPAIRS + _edges() + _spread(aware=True) + SPREAD,
        "spread_and_collect": MEM + CENTRES + CPAIRS + _edges() + _spread() + COLLECT,
        "graph_recall": MEM
        + CENTRES
        + CPAIRS
        + EFFECTIVE
        + f",\neffpairs AS (SELECT e.query_id, m.store_id, m.mem_id, m.ts, m.strength, m.key, {_cos('e.q_eff', 'm.key')} AS kk, {_cos('e.q_eff', 'm.value')} AS kv FROM eff e JOIN mem m ON e.store_id = m.store_id)"
        + _heads().replace("FROM pairs p", "FROM effpairs p")
        + _edges()
        + _spread(start=",\nact AS (SELECT query_id, store_id, mem_id, score AS s0, 1.0 AS sim FROM scored)")
        + COLLECT,
        "graph_recall_reranked": MEM
        + CENTRES
        + CPAIRS
        + EFFECTIVE
        + f",\neffpairs AS (SELECT e.query_id, e.q_eff, m.store_id, m.mem_id, m.ts, m.strength, m.key, {_cos('e.q_eff', 'm.key')} AS kk, {_cos('e.q_eff', 'm.value')} AS kv FROM eff e JOIN mem m ON e.store_id = m.store_id)"
        + _heads().replace("FROM pairs p", "FROM effpairs p")
        + _edges()
        + _spread(aware=True, start=",\nact AS (SELECT query_id, store_id, mem_id, score AS s0, kk AS sim FROM scored)")
        + HIERARCHY
        + f""",
lifted AS (SELECT r.query_id, r.mem_id, r.activation * (0.5 + 0.3 * greatest(0.0, {_cos("e.q_eff", "a.key")}) + 0.2 * greatest(0.0, {_cos("e.q_eff", "b.key")})) AS score FROM spread r JOIN eff e ON e.query_id = r.query_id JOIN mem m ON m.mem_id = r.mem_id JOIN l2 a ON a.l2_id = r.store_id * 4 + m.ts % 4 JOIN l3 b ON b.l3_id = r.store_id * 2 + a.l2_id % 2 WHERE r.activation >= 0.01)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS rank, mem_id, {_r("score")} AS score FROM lifted""",
        "classic_graph_recall": MEM + CENTRES + CPAIRS + _edges() + _spread(start=",\nact AS (SELECT query_id, store_id, mem_id, strength * kk AS s0, 1.0 AS sim FROM pairs)") + COLLECT,
        "search_report": MEM
        + CENTRES
        + CPAIRS
        + _edges()
        + _spread()
        + """,
counts AS (SELECT store_id, src, count(*) AS n FROM edges GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, mem_id) AS rank FROM spread WHERE activation >= 0.01)
SELECT f.query_id, f.rank, '  #' || f.rank || ' activation=' || printf('%.4f', f.activation) || ' strength=' || printf('%.4f', m.strength) || ' edges=' || coalesce(c.n, 0) || chr(10) || '      Input:  said ' || f.mem_id || chr(10) || '      Output: replied ' || m.ts AS line FROM found f JOIN mem m USING (store_id, mem_id) LEFT JOIN counts c ON c.store_id = f.store_id AND c.src = f.mem_id""",
        "feedback_delta": MEM + CENTRES + CPAIRS + FEEDBACK + f"\nSELECT store_id, mem_id, rank, {_r('a')} AS alignment, CASE WHEN a > 0.2 THEN 'strengthened' WHEN a < 0.0 THEN 'weakened' ELSE 'neutral' END AS effect, {_r('CASE WHEN a > 0.2 THEN strength + 0.05 * a WHEN a < 0.0 THEN strength * greatest(0.01, 1.0 - 0.05 * (0.0 - a)) ELSE strength END')} AS strength FROM aligned",
        "feedback_edges": MEM
        + CENTRES
        + CPAIRS
        + FEEDBACK
        + _edges()
        + f""",
f AS (SELECT store_id, mem_id, rank, CASE WHEN a > 0.2 THEN 1.1::DOUBLE WHEN a < 0.0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM aligned),
two AS (SELECT e.store_id, e.src, e.dst, e.weight, CASE WHEN x.rank IS NULL OR y.rank < x.rank THEN y.factor ELSE x.factor END AS f1, CASE WHEN x.rank IS NULL OR y.rank IS NULL THEN NULL WHEN y.rank < x.rank THEN x.factor ELSE y.factor END AS f2 FROM edges e LEFT JOIN f x ON x.store_id = e.store_id AND x.mem_id = e.src LEFT JOIN f y ON y.store_id = e.store_id AND y.mem_id = e.dst),
w1 AS (SELECT *, CASE WHEN f1 IS NULL THEN weight WHEN weight * f1 >= 0.02 THEN least(weight * f1, 1.0) END AS a1 FROM two),
w2 AS (SELECT *, CASE WHEN f2 IS NULL THEN a1 WHEN a1 * f2 >= 0.02 THEN least(a1 * f2, 1.0) END AS a2 FROM w1)
SELECT store_id, src, dst, {_r("a2")} AS weight FROM w2 WHERE a2 IS NOT NULL""",
        "contradiction_flags": MEM + INCOMING + f"\nSELECT mem_id, m_mem_id, {_r('kk')} AS key_sim, {_r('ov')} AS value_sim, kk >= 0.25 AND ov < 0.0 AS contradiction FROM best",
        "hard_value_drift": _drift(False),
        "soft_value_drift": _drift(True),
        "multichannel_flags": MEM
        + INCOMING
        + f""",
chan AS (SELECT b.mem_id, b.m_mem_id, b.kk, {_mix("m_value", "m_key", "1.0", "-1.0")} AS o, {_mix("e_out", "e_in", "1.0", "-1.0")} AS n, CASE WHEN m_mem_id % 3 > 0 THEN {_cos("s.context", "m_key")} ELSE 0.5 END AS ctx FROM best b JOIN state s USING (store_id)),
unit AS (SELECT *, {_unit("o")} AS uo, {_unit("n")} AS un FROM chan)
SELECT mem_id, m_mem_id, {_r(_cos("uo", "un"))} AS disp_sim, {_r("ctx")} AS ctx_sim, kk >= 0.25 AND 0.5 * kk + 0.3 * {_cos("uo", "un")} + 0.2 * ctx < 0.55 AS contradiction FROM unit""",
        "attention_entropy": MEM + INCOMING + ENTROPY + f"\nSELECT mem_id, {_r('entropy')} AS entropy FROM entropy",
        "gate_chain": GATE,
        "soft_decision": MEM
        + INCOMING
        + f""",
s AS (SELECT mem_id, max(kk) AS best, count(*)::DOUBLE AS n, count(*) FILTER (kk > 0.15)::DOUBLE AS near FROM met GROUP BY mem_id),
p AS (SELECT *, 5.0 + 15.0 * least(n / 100.0, 1.0) AS sharpness, 0.25 + 0.3 * near / n AS threshold, 1.0 + 3.0 * exp(-n / 10.0) AS cold FROM s)
SELECT mem_id, {_r("sharpness")} AS sharpness, {_r("threshold")} AS threshold, {_r("cold")} AS cold, {_r("1.0 / (1.0 + exp(-sharpness * (best - threshold)))")} AS p_strengthen, 1.0 / (1.0 + exp(-sharpness * (best - threshold))) >= 0.5 AS strengthen FROM p""",
        "cold_start_curve": MEM + f"\nSELECT store_id, mem_id, {_r('1.0 + 3.0 * exp(-(ts - 1) / 10.0)')} AS factor FROM mem",
        "prospect_delta": f"SELECT event_id, {_r('CASE WHEN value > 50 THEN pow(value - 50.0, 0.88) WHEN value < 50 THEN -2.25 * pow(abs(value - 50.0), 0.88) ELSE 0.0 END')} AS felt FROM events",
        "strength_decay": MEM + f"\nSELECT m.store_id, m.mem_id, {_r('m.strength * pow(0.995, s.now - m.ts)')} AS strength FROM mem m JOIN state s USING (store_id)",
        "strength_gain": MEM + INCOMING + f"\nSELECT mem_id, {_r('CASE WHEN kk > 0 THEN pow(0.1 * kk, 0.88) WHEN kk < 0 THEN -2.25 * pow(abs(0.1 * kk), 0.88) ELSE 0.0 END')} AS gain FROM best",
        "window_pairs": TURNS + "\nSELECT store_id, turn, input_text, output_text FROM talk",
        "direct_ingest": TURNS + _embed("talk", "store_id, turn", "input_text", "k") + _embed("talk", "store_id, turn", "output_text", "v").replace("\nv AS", "\nvv AS") + f"\nSELECT t.store_id, (row_number() OVER (PARTITION BY t.store_id ORDER BY t.turn) - 1) AS mem_id, row_number() OVER (PARTITION BY t.store_id ORDER BY t.turn) AS ts, 1.0::DOUBLE AS strength, {_r('list_dot_product(k.e, vv.e)')} AS key_value, {_r(_len('k.e'))} AS key_length, t.input_text FROM talk t JOIN k USING (store_id, turn) JOIN vv USING (store_id, turn)",
        "hash_embedding": TURNS + _embed("turns", "store_id, turn", "text", "em") + f"\nSELECT store_id, turn, (i - 1)::INT AS pos, {_r('e[i]')} AS x FROM em, range(1, 65) r(i)",
        "context_ema": TURNS
        + _embed("turns", "store_id, turn", "text", "em")
        + f""",
steps AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY turn) AS n FROM em),
mixed(store_id, turn, n, v) AS (SELECT store_id, turn, n, e FROM steps WHERE n = 1 UNION ALL SELECT s.store_id, s.turn, s.n, (SELECT {_unit("u")} FROM (SELECT {_mix("m.v", "s.e", "0.7::DOUBLE", "0.3::DOUBLE")} AS u)) FROM mixed m JOIN steps s ON s.store_id = m.store_id AND s.n = m.n + 1)
SELECT store_id, turn, (i - 1)::INT AS pos, {_r("v[i]")} AS x FROM mixed, range(1, 65) r(i)""",
        "channel_classify": TURNS
        + _embed("turns", "store_id, turn", "text", "em")
        + ",\nanchor AS (SELECT * FROM (VALUES (0, 'fact', 'This is a factual statement about the world or about me'), (1, 'preference', 'I like this, I prefer this, my favorite is'), (2, 'instruction', 'Please always do this, remember to do this'), (3, 'event', 'Something happened, I went to, yesterday I did')) v(i, name, text))"
        + _embed("anchor", "i, name", "text", "an")
        + f"\nSELECT store_id, turn, name AS channel FROM (SELECT em.store_id, em.turn, an.name, row_number() OVER (PARTITION BY em.store_id, em.turn ORDER BY round({_cos('em.e', 'an.e')}, 9) DESC, an.i) AS place FROM em, an) WHERE place = 1",
        "refusal_rate": f"SELECT count(*) AS n, {_r('''avg((lower(text) LIKE '%no information available%' OR lower(text) LIKE '%not mentioned%')::INT)''')} AS refusal_rate FROM conversations WHERE role = 'assistant'",
        "flatten_turns": TURNS + "\nSELECT store_id AS sample_id, CASE WHEN turn < 4 THEN 1 ELSE 2 END AS session_no, (row_number() OVER (PARTITION BY store_id, turn < 4 ORDER BY turn) - 1)::INT AS turn_idx, 'D' || turn AS dia_id, role AS speaker, CASE WHEN turn < 4 THEN 'day one' ELSE '' END AS session_date, '[' || CASE WHEN turn < 4 THEN 'day one' ELSE '' END || '] ' || role || ': ' || text || CASE WHEN turn = 1 THEN ' [shared image: a chart]' ELSE '' END AS text FROM turns",
        "tfidf_cosine": LEXICAL
        + f""",
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, ln(1.0 + n / (1.0 + df)) AS idf FROM df, n),
w AS (SELECT mem_id, term, tf * idf AS w FROM idx JOIN idf USING (term)),
q AS (SELECT query_id, term, tf * idf AS w FROM asked JOIN idf USING (term)),
dn AS (SELECT mem_id, sqrt(sum(w * w)) AS n FROM w GROUP BY mem_id),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM q GROUP BY query_id)
SELECT query_id, mem_id, {_r("dot / (dn.n * qn.n)")} AS sparse FROM (SELECT query_id, mem_id, sum(q.w * w.w) AS dot FROM q JOIN w USING (term) GROUP BY ALL) JOIN dn USING (mem_id) JOIN qn USING (query_id)""",
        "bm25_topk": BM25 + ",\nscored AS (SELECT query_id, mem_id, round(bm25, 6) AS score FROM bm)" + _ranked(where="true") + "\nSELECT query_id, rank, mem_id, score FROM ranked",
        "hybrid_topk": BM25
        + ",\ndocs AS (SELECT doc_id AS mem_id, text FROM documents),\nitems AS (SELECT item_id AS query_id, text FROM benchmark)"
        + _embed("docs", "mem_id", "text", "dv")
        + _embed("items", "query_id", "text", "qv")
        + """,
metric AS (SELECT qv.query_id, dv.mem_id, coalesce(bm.bm25, 0.0) AS bm25, list_dot_product(qv.e, dv.e) AS dense FROM dv CROSS JOIN qv LEFT JOIN bm ON bm.mem_id = dv.mem_id AND bm.query_id = qv.query_id),
scored AS (SELECT query_id, mem_id, round((CASE WHEN max(dense) OVER w > min(dense) OVER w THEN (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) ELSE 0.0 END) + 0.15 * (CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 0.0 END), 6) AS score FROM metric WINDOW w AS (PARTITION BY query_id))"""
        + _ranked(where="true")
        + "\nSELECT query_id, rank, mem_id, score FROM ranked",
        "document_frequency": LEXICAL + "\nSELECT term, df FROM df",
        "l2_centroids": MEM + HIERARCHY + f"\nSELECT store_id, l2_id, (i - 1)::INT AS pos, {_r('key[i]')} AS x FROM l2, range(1, 65) r(i)",
        "l3_centroids": MEM + HIERARCHY + f"\nSELECT store_id, l3_id, (i - 1)::INT AS pos, {_r('value[i]')} AS x FROM l3, range(1, 65) r(i)",
        "hierarchical_rerank": RECALLED
        + HIERARCHY
        + f""",
lifted AS (SELECT r.query_id, r.mem_id, r.score * (0.5 + 0.3 * greatest(0.0, {_cos("r.q", "a.key")}) + 0.2 * greatest(0.0, {_cos("r.q", "b.key")})) AS score FROM ranked r JOIN l2 a ON a.l2_id = r.store_id * 4 + r.ts % 4 JOIN l3 b ON b.l3_id = r.store_id * 2 + a.l2_id % 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS rank, mem_id, {_r("score")} AS score FROM lifted""",
        "l2_summary": MEM + f"\nSELECT store_id * 4 + ts % 4 AS l2_id, {_r('sum(strength)')} AS strength, count(*)::INT AS n, string_agg('memory ' || mem_id, ' | ' ORDER BY mem_id) AS texts FROM mem GROUP BY ALL",
        "merged_children": MEM
        + """,
pat AS (SELECT store_id, store_id * 4 + ts % 4 AS l2_id, mem_id FROM mem),
run AS (SELECT store_id, ts // 5 AS cluster, mem_id, count(*) OVER (PARTITION BY store_id, ts // 5) AS size FROM mem),
took AS (SELECT store_id, cluster, min(l2_id) AS l2_id FROM (SELECT r.store_id, r.cluster, p.l2_id FROM run r JOIN pat p ON p.store_id = r.store_id AND p.mem_id = r.mem_id GROUP BY r.store_id, r.cluster, p.l2_id HAVING count(*) > 0.3 * any_value(r.size)) GROUP BY ALL),
grown AS (SELECT * FROM pat UNION SELECT r.store_id, t.l2_id, r.mem_id FROM run r JOIN took t ON t.store_id = r.store_id AND t.cluster = r.cluster)
SELECT store_id, l2_id, NULL::BIGINT AS cluster, count(*)::INT AS n, min(mem_id) AS least, max(mem_id) AS most FROM grown GROUP BY store_id, l2_id
UNION ALL SELECT store_id, NULL, cluster, count(*)::INT, min(mem_id), max(mem_id) FROM run r WHERE NOT EXISTS (SELECT 1 FROM took t WHERE t.store_id = r.store_id AND t.cluster = r.cluster) GROUP BY store_id, cluster""",
        "shared_merge": MEM
        + CENTRES
        + CPAIRS
        + DENSE
        + _ranked(where="true")
        + f""",
far AS (SELECT c.query_id, m.mem_id, {_cos("c.q", "m.key")} AS score FROM centres c JOIN mem m ON m.store_id = (c.store_id + 1) % 10){_ranked(source="far", name="fars", where="true")},
merged AS (SELECT query_id, mem_id, score, 'own' AS origin FROM ranked UNION ALL SELECT query_id, mem_id, 0.3 * score, 'shared' FROM fars)
SELECT query_id, rank, mem_id, origin, {_r("score")} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, origin, mem_id) AS rank FROM merged) WHERE rank <= 5""",
        "recall_at_k": MEM + PAIRS + _heads() + HITS + f"\nSELECT count(*) AS n, {_r('avg(hit)')} AS recall FROM hits",
        "recall_by_category": MEM + PAIRS + _heads() + HITS + f"\nSELECT category, count(*) AS n, {_r('avg(hit)')} AS recall FROM hits GROUP BY ROLLUP (category)",
        "budget_sweep": MEM + PAIRS + _heads() + _ranked(30, where="true") + GOLD + f",\nfirsts AS (SELECT g.query_id, (SELECT min(r.rank) FROM ranked r WHERE r.query_id = g.query_id AND r.mem_id = g.mem_id) AS first FROM gold g)\nSELECT k::INT AS k, count(*) AS n, {_r('avg(coalesce((first <= k)::INT, 0))')} AS gold_share FROM firsts, (VALUES (1), (2), (3), (5), (8), (12), (20), (30)) b(k) GROUP BY k",
        "mcnemar_exact": f"SELECT n01, n10, {_r(TAIL)} AS p FROM (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 1 AND toxic = 0) AS n10 FROM labels)",
        "mcnemar_recall": MEM + PAIRS + _heads() + HITS + ",\ndense AS (SELECT *, kk AS score FROM pairs)" + _ranked(12, source="dense", name="drank", where="true") + f",\nboth_ AS (SELECT h.query_id, h.hit, (EXISTS (SELECT 1 FROM drank r JOIN gold g ON g.query_id = r.query_id AND g.mem_id = r.mem_id WHERE r.query_id = h.query_id))::INT AS dense FROM hits h)\nSELECT n01, n10, {_r(TAIL)} AS p FROM (SELECT count(*) FILTER (dense = 0 AND hit = 1) AS n01, count(*) FILTER (dense = 1 AND hit = 0) AS n10 FROM both_)",
        "evidence_ids": TURNS + "\nSELECT a.store_id, a.turn AS asked, 'D' || max(b.turn) AS dia_id FROM turns a JOIN turns b ON a.store_id = b.store_id AND a.text = b.text GROUP BY a.store_id, a.turn",
        "capped_questions": TURNS + "\nSELECT store_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY turn) AS place FROM turns WHERE role = 'user') WHERE place <= 2",
        "matched_results": MEM + PAIRS + _heads() + HITS + ",\ndense AS (SELECT *, kk AS score FROM pairs)" + _ranked(12, source="dense", name="drank", where="true") + ",\nside AS (SELECT h.category, h.hit AS b, (EXISTS (SELECT 1 FROM drank r JOIN gold g ON g.query_id = r.query_id AND g.mem_id = r.mem_id WHERE r.query_id = h.query_id))::INT AS a FROM hits h)\nSELECT count(*) AS n, count(*) FILTER (category = 4) AS unmatched, count(*) FILTER (category <> 4 AND a = b) AS same FROM side",
        "token_f1": TURNS + _f1("talk", "store_id, turn", "output_text", "input_text", "f") + f"\nSELECT store_id, turn, {_r('f1')} AS f1 FROM f",
        "score_answers": TURNS
        + ",\nqa AS (SELECT store_id * 100 + turn AS q_id, output_text AS prediction, input_text AS answer, (turn % 5 + 1)::INT AS category, CASE WHEN turn % 5 + 1 = 3 THEN trim(string_split(input_text, ';')[1]) ELSE input_text END AS a FROM talk)"
        + _f1("qa", "q_id", "prediction", "a", "f")
        + ",\nts AS (SELECT q_id, i AS part, trim(string_split(answer, ',')[i]) AS t, prediction FROM qa, range(1, 5000) r(i) WHERE category = 1 AND i <= len(string_split(answer, ','))),\nps AS (SELECT q_id, part, t, j, trim(string_split(prediction, ',')[j]) AS p FROM ts, range(1, 5000) r(j) WHERE j <= len(string_split(prediction, ',')))"
        + _f1("ps", "q_id, part, j", "p", "t", "g")
        + f",\nmulti AS (SELECT q_id, avg(f1) AS f1 FROM (SELECT q_id, part, max(f1) AS f1 FROM g GROUP BY ALL) GROUP BY q_id)\nSELECT qa.q_id, category, {_r('''CASE WHEN category = 1 THEN multi.f1 WHEN category IN (2, 3, 4) THEN f.f1 WHEN lower(prediction) LIKE '%no information available%' OR lower(prediction) LIKE '%not mentioned%' THEN 1.0 ELSE 0.0 END''')} AS score FROM qa JOIN f USING (q_id) LEFT JOIN multi USING (q_id)",
        "evaluation_summary": TURNS + RESULTS + "\nSELECT section, n, f1, judge, recalled, gold_pct FROM summary",
        "ingest_stats": GATED + ACTIONS + f"\nSELECT stores, {_r('avg_memories')} AS avg_memories, {_r('filtered_pct')} AS filtered_pct FROM stats",
        "evaluation_report": GATED
        + ACTIONS
        + TURNS.replace("WITH RECURSIVE turns", ",\nturns")
        + RESULTS
        + """,
names AS (SELECT * FROM (VALUES (0, 'category 4', 'single_hop'), (1, 'category 1', 'multi_hop'), (2, 'category 2', 'temporal'), (3, 'category 3', 'open_domain'), (4, 'category 5', 'adversarial'), (5, 'overall', 'overall'), (6, 'answerable', 'answerable'), (7, 'answerable, gold present', 'gold present'), (8, 'answerable, gold absent', 'gold absent')) v(place, section, name))
SELECT place::INT AS place, rpad(name, 18, ' ') || lpad(coalesce(n, 0)::VARCHAR, 6, ' ') || lpad(printf('%.4f', coalesce(f1, 0.0)), 8, ' ') || lpad(printf('%.4f', coalesce(judge, 0.0)), 8, ' ') || lpad(printf('%.1f', coalesce(gold_pct, 0.0)), 7, ' ') AS line FROM names LEFT JOIN summary USING (section)
UNION ALL SELECT 9, 'memories a conversation: ' || printf('%.3f', avg_memories) FROM stats
UNION ALL SELECT 10, 'memories recalled a question: ' || printf('%.2f', recalled) FROM summary WHERE section = 'overall'
UNION ALL SELECT 11, 'turns filtered: ' || printf('%.3f', filtered_pct) || '%' FROM stats""",
        "operating_curve": MEM
        + PAIRS
        + DENSE
        + _ranked(30, where="true")
        + GOLD
        + """,
firsts AS (SELECT g.query_id AS q_id, min(r.rank) AS first FROM gold g JOIN ranked r ON r.query_id = g.query_id AND r.mem_id = g.mem_id GROUP BY g.query_id),
asked AS (SELECT m.mem_id AS q_id, (m.mem_id % 5 + 1) AS category, k, coalesce(f.first <= k, false) AS found FROM mem m CROSS JOIN (VALUES (0), (1), (2), (3), (5), (8), (12), (20), (30)) b(k) LEFT JOIN firsts f ON f.q_id = m.mem_id),
told AS (SELECT *, NOT found AND (q_id + k) % 3 = 0 AS refused FROM asked),
judged AS (SELECT *, CASE WHEN q_id % 89 <> 0 THEN (CASE WHEN category = 5 THEN refused ELSE found END)::INT END AS judge FROM told)
SELECT k::INT AS k, count(judge) FILTER (category <> 5) AS n_answerable, count(judge) FILTER (category = 5) AS n_adversarial, round(avg(judge) FILTER (category <> 5), 4) AS answerable_judge, round(avg(judge) FILTER (category = 5), 4) AS adversarial_judge, round(avg(refused::INT) FILTER (category <> 5 AND judge IS NOT NULL), 4) AS answerable_refusal_rate, round(avg(found::INT) FILTER (category <> 5 AND judge IS NOT NULL), 4) AS answerable_gold_present, round(avg(judge) FILTER (category = 1), 4) AS judge_multi_hop, round(avg(judge) FILTER (category = 2), 4) AS judge_temporal, round(avg(judge) FILTER (category = 3), 4) AS judge_open_domain, round(avg(judge) FILTER (category = 4), 4) AS judge_single_hop, count(*) FILTER (judge IS NULL) AS errors FROM judged GROUP BY k""",
        "joined_categories": TURNS + "\nSELECT store_id, turn, CASE WHEN turn % 4 = 0 THEN 'opening' ELSE 'follow-up' END AS kind, CASE WHEN turn % 4 = 0 THEN length(text)::INT END AS n FROM turns WHERE role = 'user'",
        "sparse_head_recall": TURNS
        + _embed("talk", "store_id, turn", "input_text", "ki")
        + _embed("talk", "store_id, turn", "output_text", "vi")
        + ",\nheld AS (SELECT t.store_id, row_number() OVER (PARTITION BY t.store_id ORDER BY t.turn) - 1 AS mem_id, row_number() OVER (PARTITION BY t.store_id ORDER BY t.turn) AS ts, ki.e AS key, vi.e AS value, t.input_text FROM talk t JOIN ki USING (store_id, turn) JOIN vi USING (store_id, turn)),\nstate AS (SELECT store_id, max(ts) + 1 AS now, arg_max(key, ts) AS context FROM held GROUP BY store_id),\nqs AS (SELECT store_id, arg_min(input_text, turn) || ' ' || arg_max(output_text, turn) AS text FROM talk GROUP BY store_id)"
        + _embed("qs", "store_id", "text", "qe")
        + f""",
terms AS (SELECT store_id, mem_id, term, count(*)::DOUBLE AS tf FROM (SELECT store_id, mem_id, unnest(regexp_extract_all(lower(input_text), '[a-z0-9]+')) AS term FROM held) GROUP BY ALL),
n AS (SELECT store_id, count(*)::DOUBLE AS n FROM held GROUP BY store_id),
idf AS (SELECT store_id, term, ln(1.0 + any_value(n.n) / (1.0 + count(*))) AS idf FROM terms JOIN n USING (store_id) GROUP BY store_id, term),
tw AS (SELECT store_id, mem_id, term, tf * idf AS w FROM terms JOIN idf USING (store_id, term)),
qt AS (SELECT store_id, term, count(*) * any_value(idf) AS w FROM (SELECT store_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qs) JOIN idf USING (store_id, term) GROUP BY ALL),
tn AS (SELECT store_id, mem_id, sqrt(sum(w * w)) AS n FROM tw GROUP BY ALL),
qn AS (SELECT store_id, sqrt(sum(w * w)) AS n FROM qt GROUP BY ALL),
sp AS (SELECT d.store_id, d.mem_id, d.dot / (tn.n * qn.n) AS sparse FROM (SELECT a.store_id, b.mem_id, sum(a.w * b.w) AS dot FROM qt a JOIN tw b USING (store_id, term) GROUP BY ALL) d JOIN tn USING (store_id, mem_id) JOIN qn USING (store_id)),
scored AS (SELECT h.store_id AS query_id, h.mem_id, (0.45::DOUBLE * greatest({_cos("q.e", "h.key")}, 0.0) + 0.2::DOUBLE * greatest({_cos("q.e", "h.value")}, 0.0) + 0.2::DOUBLE * greatest({_cos("s.context", "h.key")}, 0.0) + 0.15::DOUBLE * exp(-(s.now - h.ts) / 10.0) + 0.15::DOUBLE * coalesce(sp.sparse, 0.0)) / 1.15::DOUBLE AS score FROM held h JOIN qe q USING (store_id) JOIN state s USING (store_id) LEFT JOIN sp USING (store_id, mem_id))"""
        + _ranked()
        + SHOW,
        "stratified_sample": "WITH n AS (SELECT lang, greatest(1, round(200 * count(*) / (SELECT count(*) FROM documents)::DOUBLE)) AS share FROM documents GROUP BY lang)\nSELECT lang, mem_id FROM (SELECT d.lang, d.doc_id AS mem_id, n.share, row_number() OVER (PARTITION BY d.lang ORDER BY md5(d.doc_id || ':0')) AS place FROM documents d JOIN n USING (lang)) WHERE place <= share",
        "strength_summary": MEM + f"\nSELECT store_id, count(*) AS n, {_r('avg(strength)')} AS mean, max(strength) AS most, min(strength) AS least, {_r('median(strength)')} AS median FROM mem GROUP BY store_id",
        "strength_histogram": MEM + "\nSELECT s.store_id, b.bucket, (SELECT count(*) FROM mem m WHERE m.store_id = s.store_id AND m.strength >= b.lo AND m.strength < b.hi) AS n FROM (SELECT DISTINCT store_id FROM mem) s, (VALUES ('0.0-0.1', 0.0::DOUBLE, 0.1::DOUBLE), ('0.1-0.5', 0.1, 0.5), ('0.5-1.0', 0.5, 1.0), ('1.0-2.0', 1.0, 2.0), ('2.0+', 2.0, 1e300)) b(bucket, lo, hi)",
        "top_bottom_strength": MEM + ",\np AS (SELECT store_id, mem_id, strength, row_number() OVER (PARTITION BY store_id ORDER BY strength DESC, mem_id) AS t, row_number() OVER (PARTITION BY store_id ORDER BY strength, mem_id DESC) AS b FROM mem)\nSELECT store_id, 'top' AS part, t AS place, mem_id, strength FROM p WHERE t <= 5 UNION ALL SELECT store_id, 'bottom', b, mem_id, strength FROM p WHERE b <= 5",
        "prompt_format": RECALLED + f",\nlines AS (SELECT query_id, rank, {LINE.format(chr(39) * 2)} AS line FROM ranked)\nSELECT query_id, '=== MEMORY CONTEXT ===' || chr(10) || 'Use these memories to answer accurately. Distinguish between different relationship types (friends vs partners vs colleagues).' || chr(10) || string_agg(line, chr(10) ORDER BY rank) || chr(10) || '=== END MEMORY ===' AS prompt FROM lines GROUP BY query_id",
        "channel_format": RECALLED
        + f""",
lines AS (SELECT query_id, rank, CASE WHEN mem_id % 3 = 0 THEN 'fact' WHEN mem_id % 3 = 1 THEN 'hobby' ELSE 'uncategorized' END AS channel, {LINE.format(TAG)} AS line FROM ranked),
blocks AS (SELECT query_id, CASE channel WHEN 'fact' THEN 0 WHEN 'uncategorized' THEN 4 ELSE 5 END AS place, chr(10) || '[' || upper(channel) || ']' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS text FROM lines GROUP BY query_id, channel)
SELECT query_id, '=== MEMORY CONTEXT ===' || chr(10) || string_agg(text, chr(10) ORDER BY place) || chr(10) || chr(10) || '=== END MEMORY ===' AS prompt FROM blocks GROUP BY query_id""",
        "tension_format": RECALLED
        + TENSION
        + f""",
lines AS (SELECT query_id, rank, role, {LINE.format(TAG)} AS line FROM roles)
SELECT query_id, '=== MEMORY CONTEXT ===' || chr(10) || 'Use these memories to answer accurately.' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (role = 'supporting') || coalesce(chr(10) || chr(10) || '=== CONFLICTING MEMORIES (consider both sides) ===' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (role = 'conflicting'), '') || chr(10) || '=== END MEMORY ===' AS prompt FROM lines GROUP BY query_id""",
        "memory_list": MEM + ",\np AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY strength DESC, mem_id) AS place FROM mem)\nSELECT store_id, place, rpad(place::VARCHAR, 4, ' ') || ' ' || lpad(printf('%.4f', strength), 10, ' ') || ' ' || lpad((ts % 3)::VARCHAR, 10, ' ') || ' ' || rpad('said ' || mem_id, 60, ' ') AS line FROM p",
    }
    return out

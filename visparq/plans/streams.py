"""Queries of trees and of what keeps state by key, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from visparq.operators import tree
from visparq.plans.scalars import table
from visparq.streaming import limiter, ndjson

DAY, PER_DAY = 24 * 3600 * 1000, 3


def events(spark, sf):
    # The column has no zone: its distance from the epoch does not depend on the session's.
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", ms.alias("ms"))


EVENTS = "SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS ms FROM events"


def rate_limit(spark, sf):
    return limiter.limit_batch(events(spark, sf), DAY, PER_DAY)


LIMIT_SQL = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, event_id) AS k FROM ({EVENTS})),
r AS (SELECT key, event_id, ms, k, true AS accepted, [ms] AS kept FROM o WHERE k = 1
UNION ALL SELECT o.key, o.event_id, o.ms, o.k, len(list_filter(r.kept, lambda t: o.ms - t < {DAY})) < {PER_DAY}, CASE WHEN len(list_filter(r.kept, lambda t: o.ms - t < {DAY})) < {PER_DAY} THEN list_append(list_filter(r.kept, lambda t: o.ms - t < {DAY}), o.ms) ELSE list_filter(r.kept, lambda t: o.ms - t < {DAY}) END FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1)
SELECT key, event_id, ms, accepted FROM r"""


def ttl_expiry(spark, sf):
    own = events(spark, sf).select("event_id", F.col("ms").alias("mtime_ms"))
    return limiter.expired(own, 1_705_000_000_000)


def admission(spark, sf):
    own = events(spark, sf).select((F.col("key") % 7).alias("slot"), F.col("event_id").alias("request_id"), "ms", (F.col("event_id") % 5 * 3_600_000).alias("busy_ms"))
    return limiter.admit(own, 2)


ADMIT_SQL = f"""WITH RECURSIVE o AS (SELECT key % 7 AS slot, event_id AS request_id, ms, event_id % 5 * 3600000 AS busy, row_number() OVER (PARTITION BY key % 7 ORDER BY ms, event_id) AS k FROM ({EVENTS})),
r AS (SELECT slot, request_id, ms, k, ms AS started_ms, [ms + busy] AS ends FROM o WHERE k = 1
UNION ALL SELECT slot, request_id, ms, k, CASE WHEN len(w) > 2 THEN NULL ELSE greatest(ms, coalesce(w[len(w)], ms)) END, CASE WHEN len(w) > 2 THEN w ELSE list_append(w, greatest(ms, coalesce(w[len(w)], ms)) + busy) END FROM (SELECT o.*, list_filter(r.ends, lambda e: e > o.ms) AS w FROM r JOIN o ON o.slot = r.slot AND o.k = r.k + 1))
SELECT slot, request_id, started_ms FROM r"""


def upload_status(spark, sf):
    k = F.col("event_id")
    content = F.when(k % 3 == 0, F.unhex(F.lit("89504E47"))).otherwise(F.unhex(F.lit("00112233")))
    declared = F.when(k % 4 == 0, "text/plain").otherwise("image/png")
    return table(spark, sf, "events").select("event_id", limiter.upload_status(k % 50 * 1_000_000, declared, content, k % 11 == 0).cast("long").alias("status"))


STATUS_SQL = "SELECT event_id, (CASE WHEN event_id % 11 = 0 THEN 429 WHEN event_id % 50 = 0 THEN 400 WHEN event_id % 50 * 1000000 > 20971520 THEN 413 WHEN event_id % 4 = 0 THEN 415 WHEN event_id % 3 > 0 THEN 422 ELSE 200 END)::BIGINT AS status FROM events"


def chunks(spark, sf):
    """Each turn is a line, cut into two pieces in the middle; some lines are blank or broken, some requests fail."""
    k = F.col("conv_id") + F.col("turn")
    ok = F.to_json(F.struct(F.col("text").alias("response"), (F.col("turn") % 3 == 2).alias("done"), F.col("turn").alias("eval_count")))
    line = F.when(k % 13 == 5, "{broken").when(k % 17 == 3, "").when(k % 29 == 7, '{"error": "out of memory"}').otherwise(ok)
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(line, F.lit("\n")).alias("line"))
    half = F.expr("CAST(length(line) div 2 AS INT)")
    pieces = F.array(F.struct(F.lit(0).alias("h"), F.expr("substring(line, 1, CAST(length(line) div 2 AS INT))").alias("piece")), F.struct(F.lit(1).alias("h"), F.expr("substring(line, CAST(length(line) div 2 AS INT) + 1)").alias("piece")))
    return own.select("conv_id", "turn", F.explode(pieces).alias("p")).select(F.col("conv_id").alias("request_id"), (F.col("turn") * 2 + F.col("p.h")).alias("seq"), (F.col("turn") * 1000 + F.col("p.h") * 500).alias("recv_ms"), "p.piece")


CHUNKS = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 13 = 5 THEN 'broken' WHEN (conv_id + turn) % 17 = 3 THEN 'blank' WHEN (conv_id + turn) % 29 = 7 THEN 'error' ELSE 'ok' END AS kind, text AS t FROM conversations"


def ndjson_reassemble(spark, sf):
    return ndjson.reassemble(ndjson.lines(chunks(spark, sf)))


ND_SQL = f"""SELECT conv_id AS request_id, coalesce(string_agg(t, '' ORDER BY turn) FILTER (kind = 'ok'), '') AS reply, count(*) FILTER (kind = 'ok' AND t <> '') AS n_parts, min(turn * 1000 + 500) FILTER (kind = 'ok' AND t <> '')::BIGINT AS first_token_ms,
coalesce(bool_or(turn % 3 = 2) FILTER (kind = 'ok'), false) AS done, coalesce(bool_or(kind = 'error'), false) AS failed, max(turn) FILTER (kind = 'ok' AND turn % 3 = 2) AS eval_count FROM ({CHUNKS}) WHERE kind IN ('ok', 'error') GROUP BY conv_id"""


def load_vs_infer(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", ndjson.phase(F.when(k % 5 > 0, k * 7 % 40_000), k % 3 * 60_000 + 30_000).alias("phase"), ndjson.ms(k * 123_456).alias("load_ms"))


PHASE_SQL = "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id * 7 % 40000 > least(20000, floor((event_id % 3 * 60000 + 30000) * 0.25)) THEN 'load' ELSE 'infer' END AS phase, floor(event_id * 123456 / 1e6 + 0.5)::BIGINT AS load_ms FROM events"


def paths(spark, sf):
    """Customers as files under region and nation folders, some hidden and some under modules."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, F.concat(F.lit(".hid"), k)).when(k % 10 == 1, F.concat(F.lit("node_modules/m"), k, F.lit(".js"))).when(k % 10 == 2, F.concat(F.lit("README"), k)).when(k % 10 == 3, F.concat(F.lit("a/b/c/d"), k, F.lit(".TXT"))).when(k % 10 == 4, F.concat(F.lit(".git/x"), k, F.lit(".idx"))).otherwise(F.concat(F.lit('f"'), k, F.lit(".md")))
    own = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return own.select(F.col("r_regionkey").cast("long").alias("graph_id"), F.concat_ws("/", "n_name", name).alias("path"), F.col("c_custkey").alias("size"))


PATHS = """SELECT n_regionkey::BIGINT AS graph_id, n_name || '/' || CASE WHEN c_custkey % 10 = 0 THEN '.hid' || c_custkey WHEN c_custkey % 10 = 1 THEN 'node_modules/m' || c_custkey || '.js' WHEN c_custkey % 10 = 2 THEN 'README' || c_custkey WHEN c_custkey % 10 = 3 THEN 'a/b/c/d' || c_custkey || '.TXT' WHEN c_custkey % 10 = 4 THEN '.git/x' || c_custkey || '.idx' ELSE 'f"' || c_custkey || '.md' END AS path, c_custkey AS size FROM customer JOIN nation ON c_nationkey = n_nationkey"""
TREE = f"""f AS (SELECT graph_id, string_split(path, '/') AS p, size FROM ({PATHS}) WHERE NOT regexp_matches(path, '(^|/)\\.hid') AND NOT contains(path, 'node_modules')),
e AS (SELECT graph_id, p, size, unnest(range(1, least(len(p), 4) + 1)) AS k FROM f),
n AS (SELECT graph_id, array_to_string(p[1:k], '/') AS id, CASE WHEN k = len(p) THEN 'file' ELSE 'directory' END AS type, p[k] AS name, CASE WHEN k > 1 THEN array_to_string(p[1:k - 1], '/') END AS parent, CASE WHEN k = len(p) THEN lower(regexp_extract(p[k], '^.+(\\.[^.]*)$', 1)) ELSE '' END AS extension, max(CASE WHEN k = len(p) THEN size ELSE 0 END)::BIGINT AS size FROM e GROUP BY ALL)"""


def _nodes(spark, sf):
    return tree.nodes(paths(spark, sf), 3)


def tree_nodes(spark, sf):
    return _nodes(spark, sf).select("graph_id", "id", "type", "name", "parent", "extension", F.col("size").cast("long").alias("size"))


def tree_edges(spark, sf):
    return tree.edges(_nodes(spark, sf))


def ext_distribution(spark, sf):
    return tree.extensions(_nodes(spark, sf))


def dot_export(spark, sf):
    return tree.dot(_nodes(spark, sf))


_Q = "'\"' || replace({0}, '\"', '\\\"') || '\"'"
DOT = f"""WITH {TREE}, l AS (SELECT graph_id, 0 AS k, id AS pos, '  ' || {_Q.format('id')} || ' [label=' || {_Q.format('name')} || CASE WHEN type = 'directory' THEN ', shape=folder];' ELSE ', shape=box];' END AS line FROM n
UNION ALL SELECT graph_id, 1, id, '  ' || {_Q.format('parent')} || ' -> ' || {_Q.format('id')} || ';' FROM n WHERE parent IS NOT NULL)
SELECT graph_id, 'digraph G {{' || chr(10) || '  rankdir=LR;' || chr(10) || string_agg(line, chr(10) ORDER BY k, pos, line) || chr(10) || '}}' AS dot FROM l GROUP BY graph_id"""

QUERIES = {
    "rate_limit": (rate_limit, LIMIT_SQL),
    "ttl_expiry": (ttl_expiry, f"SELECT event_id, ms AS mtime_ms FROM ({EVENTS}) WHERE 1705000000000 - ms > 900000"),
    "admission": (admission, ADMIT_SQL),
    "upload_status": (upload_status, STATUS_SQL),
    "ndjson_reassemble": (ndjson_reassemble, ND_SQL),
    "load_vs_infer": (load_vs_infer, PHASE_SQL),
    "tree_nodes": (tree_nodes, f"WITH {TREE} SELECT * FROM n"),
    "tree_edges": (tree_edges, f"WITH {TREE} SELECT graph_id, parent AS source, id AS target FROM n WHERE parent IS NOT NULL"),
    "ext_distribution": (ext_distribution, f"WITH {TREE} SELECT graph_id, CASE WHEN extension = '' THEN 'no_ext' ELSE extension END AS extension, count(*) AS n_files FROM n WHERE type = 'file' GROUP BY ALL"),
    "dot_export": (dot_export, DOT),
}

"""Queries for regions and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.operators import regions
from engramlake.registry.core import query

RAW_REGIONS = """SELECT o_orderkey AS seq,
 CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'user' WHEN 1 THEN 'topic' WHEN 2 THEN 'project' WHEN 3 THEN 'session' ELSE 'topic' END AS kind,
 CASE WHEN o_orderkey % 31 = 0 THEN ' ' WHEN o_orderkey % 37 = 0 THEN repeat('n', 201) ELSE concat('Region ', CAST(o_custkey AS STRING)) END AS name,
 CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 10 = 0 THEN 'user' ELSE 'mine' END
  WHEN o_orderkey % 41 = 0 THEN 'user' WHEN o_orderkey % 43 = 0 THEN 'has space' WHEN o_orderkey % 47 = 0 THEN repeat('x', 121)
  ELSE concat('r', CAST(o_custkey AS STRING)) END AS region_id,
 CASE WHEN o_orderkey % 5 = 3 AND o_orderkey % 3 <> 0 THEN concat('s', CAST(o_custkey % 50 AS STRING)) WHEN o_orderkey % 53 = 0 THEN 's' END AS session_id FROM {orders}"""
REGION_CHECKS = """SELECT seq, kind, trim(name) AS name, session_id, CASE WHEN kind = 'user' THEN 'user' ELSE region_id END AS id,
 CASE WHEN trim(name) = '' THEN 'blank name' WHEN length(trim(name)) > 200 THEN 'name too long'
 WHEN kind = 'session' AND session_id IS NULL THEN 'session_id required' WHEN kind <> 'session' AND session_id IS NOT NULL THEN 'session_id not allowed'
 WHEN kind = 'user' AND region_id NOT IN ('', 'user') THEN 'user region id is fixed' WHEN kind <> 'user' AND region_id = 'user' THEN 'reserved id'
 WHEN kind <> 'user' AND length(region_id) > 120 THEN 'id too long' WHEN kind <> 'user' AND region_id LIKE '% %' THEN 'id has whitespace or separators' END AS reason FROM {raw_regions}"""
REGION_FIRST = """SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM {checked} WHERE reason IS NULL"""


@query(
    "reg1_build_regions",
    """SELECT seq, kind, id AS region_id, CASE kind WHEN 'user' THEN 'user' WHEN 'session' THEN 'chat' ELSE concat(kind, ':', id) END AS space, '' AS reason
 FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(session_id, CAST(seq AS STRING)) ORDER BY seq) AS sn FROM {firsts} WHERE rn = 1) f WHERE sn = 1
 UNION ALL SELECT seq, kind, id, NULL, 'duplicate session' FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(session_id, CAST(seq AS STRING)) ORDER BY seq) AS sn FROM {firsts} WHERE rn = 1) f WHERE sn > 1
 UNION ALL SELECT seq, kind, id, NULL, 'duplicate id' FROM {firsts} WHERE rn > 1
 UNION ALL SELECT seq, kind, id, NULL, reason FROM {checked} WHERE reason IS NOT NULL""",
    raw_regions=RAW_REGIONS,
    checked=REGION_CHECKS,
    firsts=REGION_FIRST,
)
def _build_regions(t):
    built, rejects = regions.build_regions(t.sql(RAW_REGIONS, "orders"))
    return built.select("seq", "kind", "region_id", "space", F.lit("").alias("reason")).unionByName(
        rejects.select("seq", "kind", "region_id", F.lit(None).cast("string").alias("space"), "reason")
    )


# Bindings at a size that grows with the data: every customer has a project, some a worktree below it.
CUSTOMER_BINDINGS = """SELECT concat('b', CAST(c_custkey AS STRING)) AS binding_id, 'project' AS kind,
 concat('/work/c', CAST(c_custkey AS STRING)) AS canonical_root, concat('project-', CAST(c_custkey AS STRING)) AS region_id,
 CAST(NULL AS STRING) AS main_binding_id FROM {customer}
 UNION ALL SELECT concat('w', CAST(c_custkey AS STRING)), 'worktree', concat('/trees/', CAST(c_nationkey AS STRING), '/c', CAST(c_custkey AS STRING)),
 CAST(NULL AS STRING), concat('b', CAST(c_custkey AS STRING)) FROM {customer} WHERE c_acctbal > 0"""


@query(
    "reg3_resolve_bindings",
    """SELECT b.binding_id, coalesce(m.region_id, b.region_id) AS region_id, coalesce(b.main_binding_id, b.binding_id) AS project_id
 FROM {customer_bindings} b LEFT JOIN {customer_bindings} m ON m.binding_id = b.main_binding_id""",
    customer_bindings=CUSTOMER_BINDINGS,
)
def _resolve_bindings(t):
    return regions.resolve_bindings(t.sql(CUSTOMER_BINDINGS, "customer")).select("binding_id", "region_id", "project_id")


FOLDER_EVENTS = """SELECT o_orderkey AS event_id, CASE CAST(o_orderkey % 4 AS INT)
 WHEN 0 THEN concat('/work/c', CAST(o_custkey AS STRING), '/src/m')
 WHEN 1 THEN concat('/work/c', CAST(o_custkey AS STRING), '0x/src')
 WHEN 2 THEN concat('/trees/', CAST(o_custkey % 25 AS STRING), '/c', CAST(o_custkey AS STRING))
 ELSE '/home/u' END AS cwd FROM {orders}"""


@query(
    "reg4_route_by_cwd",
    """SELECT e.event_id, coalesce(b0.region_id, b1.region_id, b2.region_id) AS region_id FROM {folder_events} e
 LEFT JOIN {resolved} b0 ON b0.canonical_root = e.cwd
 LEFT JOIN {resolved} b1 ON b1.canonical_root = regexp_replace(e.cwd, '/[^/]*$', '')
 LEFT JOIN {resolved} b2 ON b2.canonical_root = regexp_replace(e.cwd, '/[^/]*/[^/]*$', '')""",
    resolved="""SELECT x.canonical_root, coalesce(m.region_id, x.region_id) AS region_id FROM {customer_bindings} x
 LEFT JOIN {customer_bindings} m ON m.binding_id = x.main_binding_id""",
    customer_bindings=CUSTOMER_BINDINGS,
    folder_events=FOLDER_EVENTS,
)
def _route_by_cwd(t):
    routed = regions.route_by_cwd(t.sql(FOLDER_EVENTS, "orders"), t.sql(CUSTOMER_BINDINGS, "customer"))
    return routed.select("event_id", F.col("bound_region_id").alias("region_id"))


ROUTED = """SELECT c.*, CASE WHEN b.root IS NOT NULL THEN b.region_id WHEN c.topic_id IS NOT NULL THEN r.region_id
 ELSE concat('session-', c.session_id) END AS region_id,
 CASE WHEN b.root IS NOT NULL THEN 'project' WHEN c.topic_id IS NOT NULL THEN 'topic' ELSE 'session' END AS region_kind
 FROM {captures} c LEFT JOIN (SELECT canonical_root AS root, region_id FROM {bindings} WHERE kind = 'project') b ON c.cwd LIKE concat(b.root, '/%')
 LEFT JOIN {regions} r ON r.region_id = c.topic_id AND r.kind = 'topic'"""


@query(
    "reg5_route_captures",
    """SELECT event_id, region_kind, CASE WHEN region_id IS NULL THEN 'unknown topic region' ELSE region_id END AS region_id FROM (
 SELECT event_id, region_kind, CASE WHEN region_kind = 'topic' AND topic_id = 'topic-3' THEN NULL ELSE region_id END AS region_id FROM {routed}) x""",
    routed=ROUTED,
)
def _route_captures(t):
    known = t.regions.filter(F.col("region_id") != "topic-3")
    routed, rejects = regions.route_captures(t.captures, t.bindings, known)
    return routed.select("event_id", "region_kind", "region_id").unionByName(
        rejects.select("event_id", "region_kind", F.col("reason").alias("region_id"))
    )


SCOPE_REQUESTS = """SELECT concat('q', CAST(o_orderkey AS STRING)) AS query_id,
 CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN concat('/work/p', CAST(o_custkey % 5 AS STRING), '/src') WHEN 1 THEN '/home/u' WHEN 2 THEN '/home/u' END AS cwd,
 CAST(NULL AS STRING) AS library_id, CASE WHEN o_orderkey % 6 = 3 THEN concat('topic-', CAST(o_custkey % 12 AS STRING)) END AS region_id,
 CASE WHEN o_orderkey % 6 = 4 THEN concat('user,project-', CAST(o_custkey % 5 AS STRING)) WHEN o_orderkey % 6 = 5 THEN 'session-s1,user' END AS region_list,
 CASE WHEN o_orderkey % 2 = 1 THEN concat('s', CAST(o_custkey AS STRING)) END AS session_id,
 CASE WHEN o_orderkey % 6 = 2 THEN concat('topic-', CAST(o_custkey % 12 AS STRING)) END AS topic_id FROM {orders}"""


@query(
    "reg6_expand_recall_scope",
    """SELECT query_id, concat('project-', regexp_extract(cwd, '/work/p([0-9]+)', 1)) AS region_id, 'project' AS scope_kind FROM {requests} WHERE cwd LIKE '/work/%'
 UNION ALL SELECT q.query_id, q.topic_id, CASE WHEN r.region_id IS NULL THEN 'unknown topic region' ELSE 'topic' END FROM {requests} q LEFT JOIN {regions} r ON r.region_id = q.topic_id WHERE q.topic_id IS NOT NULL
 UNION ALL SELECT query_id, 'user', 'user' FROM {requests} WHERE cwd = '/home/u' AND topic_id IS NULL
 UNION ALL SELECT query_id, concat('session-', session_id), 'session' FROM {requests} WHERE cwd = '/home/u' AND topic_id IS NULL AND session_id IS NOT NULL
 UNION ALL SELECT q.query_id, q.region_id, CASE WHEN r.region_id IS NULL THEN 'unknown region' ELSE 'explicit' END FROM {requests} q LEFT JOIN {regions} r ON r.region_id = q.region_id WHERE q.region_id IS NOT NULL
 UNION ALL SELECT query_id, unnest(string_split(region_list, ',')), 'explicit' FROM {requests} WHERE region_list LIKE 'user,%'
 UNION ALL SELECT query_id, 'session-s1', 'session region not allowed' FROM {requests} WHERE region_list LIKE 'session%'""",
    requests=SCOPE_REQUESTS,
)
def _expand_recall_scope(t):
    requests = t.sql(SCOPE_REQUESTS, "orders").withColumn("region_ids", F.split("region_list", ","))
    session = t.spark.range(1).select(
        F.lit("session-s1").alias("region_id"), F.lit("session").alias("kind"), F.lit("chat").alias("name")
    )
    scopes, rejects = regions.expand_recall_scope(requests, t.bindings, t.regions.unionByName(session))
    refused = rejects.join(requests.select("query_id", "region_id", "topic_id"), "query_id").select(
        "query_id",
        F.coalesce("region_id", "topic_id", F.lit("session-s1")).alias("region_id"),
        F.col("reason").alias("scope_kind"),
    )
    return scopes.unionByName(refused)

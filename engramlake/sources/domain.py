"""Domain tables derived from the raw tables by SQL that Spark and DuckDB both run.

``{name}`` marks an input table. Spark binds it to a DataFrame; the checks bind it to a view.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

EPOCH_BASE = 1767225600

DOMAIN_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "captures": (
        ("conversations",),
        """SELECT concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS event_id,
 concat('s', CAST(conv_id AS STRING)) AS session_id,
 concat('t', CAST(SUM(CASE WHEN role='user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS STRING)) AS turn_id,
 role AS event_kind, text AS content, 1767225600 + conv_id*3600 + turn*60 AS occurred_s,
 CASE WHEN conv_id % 3 = 0 THEN concat('/work/p', CAST(conv_id % 5 AS STRING), '/src/m') ELSE '/home/u' END AS cwd,
 CASE WHEN conv_id % 3 = 1 THEN concat('topic-', CAST(conv_id % 4 AS STRING)) END AS topic_id
 FROM {conversations} WHERE role IN ('user','assistant')""",
    ),
    "regions": (
        ("nation", "region"),
        """SELECT concat('topic-', CAST(n_nationkey AS STRING)) AS region_id, 'topic' AS kind, n_name AS name FROM {nation}
 UNION ALL SELECT concat('project-', CAST(r_regionkey AS STRING)), 'project', r_name FROM {region}
 UNION ALL SELECT 'user', 'user', 'user'""",
    ),
    "bindings": (
        ("region",),
        """SELECT concat('b', CAST(r_regionkey AS STRING)) AS binding_id, 'project' AS kind,
 concat('/work/p', CAST(r_regionkey AS STRING)) AS canonical_root,
 concat('project-', CAST(r_regionkey AS STRING)) AS region_id, CAST(NULL AS STRING) AS main_binding_id FROM {region}
 UNION ALL SELECT concat('w', CAST(r_regionkey AS STRING)), 'worktree', concat('/work/p', CAST(r_regionkey AS STRING), '/src'),
 CAST(NULL AS STRING), concat('b', CAST(r_regionkey AS STRING)) FROM {region}""",
    ),
    "units": (
        ("documents",),
        """SELECT concat('u', CAST(doc_id AS STRING)) AS id,
 CASE WHEN doc_id % 4 = 0 THEN 'user' WHEN doc_id % 4 = 1 THEN concat('topic-', CAST(doc_id % 10 AS STRING)) ELSE concat('project-', CAST(doc_id % 5 AS STRING)) END AS region_id,
 CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'decision' WHEN 1 THEN 'constraint' WHEN 2 THEN 'preference' WHEN 3 THEN 'domain_fact' WHEN 4 THEN 'reusable_experience' WHEN 5 THEN 'external_reference' WHEN 6 THEN 'capture' ELSE 'evolved' END AS memory_type,
 CASE CAST(doc_id % 11 AS INT) WHEN 9 THEN 'superseded' WHEN 8 THEN 'archived' WHEN 7 THEN 'forgotten' ELSE 'active' END AS lifecycle,
 CASE WHEN doc_id % 11 = 10 THEN concat('u', CAST(doc_id - 1 AS STRING)) END AS supersedes,
 text AS content, source, 1767225600 + (doc_id * 7919) % 2592000 AS updated_s FROM {documents}""",
    ),
    "recall_queries": (
        ("benchmark",),
        "SELECT concat('q', CAST(item_id AS STRING)) AS query_id, text AS query FROM {benchmark}",
    ),
    "vectors": (
        ("embeddings",),
        """SELECT concat('u', CAST(vec_id AS STRING)) AS id, embedding AS vector,
 concat('topic:', CAST(label AS STRING)) AS scope_space FROM {embeddings}""",
    ),
    "entity_support": (
        ("lineitem",),
        """SELECT concat('region-', CAST(l_suppkey % 3 AS STRING)) AS region_id, concat('m', CAST(l_orderkey AS STRING)) AS memory_id,
 'organization' AS entity_type, concat('Supplier ', CAST(l_suppkey AS STRING)) AS name,
 CASE WHEN MIN(l_linestatus) = 'F' THEN 'superseded' ELSE 'active' END AS lifecycle,
 1767225600 + l_orderkey * 60 AS updated_s FROM {lineitem} GROUP BY l_suppkey, l_orderkey
 UNION ALL SELECT concat('region-', CAST(l_suppkey % 3 AS STRING)), concat('m', CAST(l_orderkey AS STRING)),
 'component', concat('Part ', CAST(l_partkey AS STRING)),
 CASE WHEN MIN(l_linestatus) = 'F' THEN 'superseded' ELSE 'active' END,
 1767225600 + l_orderkey * 60 FROM {lineitem} GROUP BY l_suppkey % 3, l_orderkey, l_partkey""",
    ),
    "relation_support": (
        ("lineitem",),
        """SELECT concat('region-', CAST(l_suppkey % 3 AS STRING)) AS region_id, concat('m', CAST(l_orderkey AS STRING)) AS memory_id,
 concat('Part ', CAST(l_partkey AS STRING)) AS source_name, concat('Supplier ', CAST(l_suppkey AS STRING)) AS target_name,
 CASE WHEN l_returnflag = 'R' THEN 'depends_on' ELSE 'part_of' END AS relation_type,
 CASE WHEN MIN(l_linestatus) = 'F' THEN 'superseded' ELSE 'active' END AS lifecycle,
 1767225600 + l_orderkey * 60 AS updated_s
 FROM {lineitem} GROUP BY l_suppkey, l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'depends_on' ELSE 'part_of' END""",
    ),
    "audit": (
        ("events",),
        """SELECT event_id AS seq, concat('m', CAST(user_id AS STRING)) AS target_id, event_type AS action,
 concat('topic:', CAST(user_id % 10 AS STRING)) AS target_space, value FROM {events}""",
    ),
    "labels_dec": (
        ("labels",),
        """SELECT concat('u', CAST(doc_id AS STRING)) AS unit_id, CASE WHEN quality = 1 THEN 0.95 ELSE 0.5 END AS confidence,
 quality = 1 AS explicit, toxic = 1 AS blocked FROM {labels}""",
    ),
}


# Tables with costly per-row work, and the unique-enough key to spread them by.
SPREAD_KEYS = {"documents": "doc_id", "lineitem": "l_orderkey"}


SPREAD_SETTING = "spark.engramlake.spreadTables"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal a table out by its key where the session asks for it: for tables stored as one small file."""
    wanted = rows.sparkSession.conf.get(SPREAD_SETTING, None)
    return rows.repartition(int(wanted), key) if wanted else rows


# Domain tables that group all rows of a raw table, which is dealt by a key that all their groups have: a task then groups so many
# rows, whatever the size of the table, where files and compressed shuffles are cut by bytes, of which a row has very few.
GROUPED = {"entity_support": "l_orderkey", "relation_support": "l_orderkey"}
TASK_ROWS = 200_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one key together, some ``TASK_ROWS`` a partition; a table of one such partition, or one already spread, as it is."""
    if rows.sparkSession.conf.get(SPREAD_SETTING, None):
        return rows
    parts = math.ceil(rows.count() / TASK_ROWS)
    return rows.repartition(parts, key) if parts > 1 else rows


class Tables:
    """Lazy access to the raw parquet tables and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return spread(rows, SPREAD_KEYS[name]) if name in SPREAD_KEYS else rows

    def sql(self, text: str, *names: str) -> DataFrame:
        """Run SQL whose ``{name}`` markers are raw or domain tables."""
        return self.spark.sql(text, **{name: self.table(name) for name in names})

    def table(self, name: str) -> DataFrame:
        if name not in DOMAIN_SQL:
            return self.raw(name)
        inputs, text = DOMAIN_SQL[name]
        if name in GROUPED:
            return self.spark.sql(text, **{source: dealt(self.table(source), GROUPED[name]) for source in inputs})
        return self.sql(text, *inputs)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

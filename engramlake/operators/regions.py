"""Regions, bindings, and routing of events and recall requests to regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.hashing import joined_digest
from engramlake.functions.windows import mark_first

MAX_REGION_ID_CHARS = 120
MAX_REGION_NAME_CHARS = 200
MAX_SESSION_ID_CHARS = 256


def space_of(kind: Column, region_id: Column) -> Column:
    """Storage space of a region."""
    return (
        F.when(kind == "user", "user")
        .when(kind == "topic", F.concat(F.lit("topic:"), region_id))
        .when(kind == "project", F.concat(F.lit("project:"), region_id))
        .otherwise("chat")
    )


def build_regions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid regions with their space, and rejects with a reason.

    ``raw`` has region_id, kind, name, session_id and a unique arrival number ``seq``; the
    earliest row of an id, and then of a session, wins.
    """
    given = F.trim("region_id")
    is_user = F.col("kind") == "user"
    identifier = F.when(is_user, "user").otherwise(
        F.coalesce(given, joined_digest("kind", "name", F.coalesce("session_id", F.lit(""))))
    )
    session = F.trim("session_id")
    reason = (
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "blank name")
        .when(F.length(F.trim("name")) > MAX_REGION_NAME_CHARS, "name too long")
        .when(~F.coalesce(F.col("kind").isin("user", "topic", "project", "session"), F.lit(False)), "unknown kind")
        .when((F.col("kind") == "session") & (F.coalesce(session, F.lit("")) == ""), "session_id required")
        .when((F.col("kind") == "session") & (F.length(session) > MAX_SESSION_ID_CHARS), "session_id too long")
        .when((F.col("kind") != "session") & session.isNotNull(), "session_id not allowed")
        .when(is_user & ~F.coalesce(given, F.lit("")).isin("", "user"), "user region id is fixed")
        .when(~is_user & (given == ""), "blank id")
        .when(~is_user & (given == "user"), "reserved id")
        .when(~is_user & (F.length(given) > MAX_REGION_ID_CHARS), "id too long")
        .when(~is_user & given.rlike(r"(?U)[\s/\\]"), "id has whitespace or separators")
    )
    judged = raw.select(
        "seq", "kind", F.trim("name").alias("name"), session.alias("session_id"), reason.alias("reason"),
        F.col("region_id").alias("given_id"), identifier.alias("region_id"),
    )
    shaped = mark_first(judged.filter(F.col("reason").isNull()), ["region_id"], "seq", "first_id")
    by_session = mark_first(
        shaped.filter("first_id AND session_id IS NOT NULL"), ["session_id"], "seq", "first_session"
    )
    regions = (
        shaped.filter("first_id AND session_id IS NULL")
        .unionByName(by_session.filter("first_session").drop("first_session"))
        .select("region_id", "kind", "name", space_of(F.col("kind"), F.col("region_id")).alias("space"), "session_id", "seq")
    )
    rejects = (
        judged.filter(F.col("reason").isNotNull())
        .unionByName(shaped.filter(~F.col("first_id")).drop("first_id").withColumn("reason", F.lit("duplicate id")))
        .unionByName(
            by_session.filter(~F.col("first_session"))
            .drop("first_id", "first_session")
            .withColumn("reason", F.lit("duplicate session"))
        )
    )
    return regions, rejects


def resolve_bindings(bindings: DataFrame) -> DataFrame:
    """Give each worktree the region of its main binding."""
    mains = bindings.select(F.col("binding_id").alias("main_binding_id"), F.col("region_id").alias("main_region_id"))
    return (
        bindings.join(mains, "main_binding_id", "left")
        .withColumn("region_id", F.coalesce("main_region_id", "region_id"))
        .withColumn("project_id", F.coalesce("main_binding_id", "binding_id"))
        .drop("main_region_id")
    )


def ancestors_of(path: Column) -> Column:
    """The path and each of its ancestor folders, split at path parts."""
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda depth: F.struct(
            F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), depth), "/")).alias("root"), depth.alias("depth")
        ),
    )


def route_by_cwd(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """Add the region of the deepest bound folder at or above each event's cwd.

    Only distinct folders are expanded to their ancestors, so the events themselves are
    joined once and never multiplied.
    """
    roots = resolve_bindings(bindings).select(F.col("canonical_root").alias("root"), "region_id", "binding_id")
    folders = events.select("cwd").filter(F.col("cwd").isNotNull()).distinct()
    routes = (
        folders.select("cwd", F.inline(ancestors_of(F.col("cwd"))))
        .join(roots, "root")
        .groupBy("cwd")
        .agg(F.max_by(F.struct("region_id", "binding_id"), "depth").alias("best"))
        .select("cwd", F.col("best.region_id").alias("bound_region_id"), F.col("best.binding_id").alias("binding_id"))
    )
    return events.join(routes, "cwd", "left")


def route_captures(events: DataFrame, bindings: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Region of each capture: bound project, else its topic, else its session's chat region."""
    topics = regions.filter(F.col("kind") == "topic").select(
        F.col("region_id").alias("topic_id"), F.lit(True).alias("known_topic")
    )
    routed = route_by_cwd(events, bindings).join(topics, "topic_id", "left")
    topic_given = F.col("bound_region_id").isNull() & F.col("topic_id").isNotNull()
    routed = (
        routed.withColumn("reason", F.when(topic_given & F.col("known_topic").isNull(), "unknown topic region"))
        .withColumn(
            "region_id",
            F.coalesce(
                "bound_region_id", F.when(F.col("known_topic"), F.col("topic_id")), F.concat(F.lit("session-"), "session_id")
            ),
        )
        .withColumn(
            "region_kind",
            F.when(F.col("bound_region_id").isNotNull(), "project").when(F.col("topic_id").isNotNull(), "topic").otherwise("session"),
        )
        .drop("known_topic", "bound_region_id")
    )
    return routed.filter(F.col("reason").isNull()).drop("reason"), routed.filter(F.col("reason").isNotNull())


def expand_recall_scope(
    queries: DataFrame, bindings: DataFrame, regions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """One row per (query, region, scope_kind), and rejects with a reason."""
    known = regions.select(F.col("region_id"), F.col("kind").alias("region_kind"))
    explicit = queries.withColumn(
        "__ids", F.coalesce("region_ids", F.when(F.coalesce("region_id", "library_id").isNotNull(), F.array(F.coalesce("region_id", "library_id"))))
    )
    chosen = (
        explicit.filter(F.col("__ids").isNotNull())
        .select("query_id", F.size("__ids").alias("n_regions"), F.explode("__ids").alias("region_id"))
        .join(known, "region_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("region_kind").isNull(), "unknown region").when(
                (F.col("region_kind") == "session") & (F.col("n_regions") > 1), "session region not allowed"
            ),
        )
    )
    by_folder = route_by_cwd(queries.filter(F.col("cwd").isNotNull()), bindings).join(
        known.filter(F.col("region_kind") == "topic").select(F.col("region_id").alias("topic_id"), F.lit(True).alias("known_topic")),
        "topic_id",
        "left",
    )
    bound, topical = F.col("bound_region_id").isNotNull(), F.col("topic_id").isNotNull()

    def scope(region: Column, kind: str) -> Column:
        return F.struct(region.alias("region_id"), F.lit(kind).alias("scope_kind"))

    scopes = (
        F.when(bound, F.array(scope(F.col("bound_region_id"), "project")))
        .when(topical, F.array(scope(F.col("topic_id"), "topic")))
        .otherwise(
            F.filter(
                F.array(
                    scope(F.lit("user"), "user"),
                    scope(F.when(F.col("session_id").isNotNull(), F.concat(F.lit("session-"), "session_id")), "session"),
                ),
                lambda item: item["region_id"].isNotNull(),
            )
        )
    )
    folder_reason = F.when(~bound & topical & F.col("known_topic").isNull(), "unknown topic region")
    folder_rows = by_folder.withColumn("reason", folder_reason)
    expanded = folder_rows.filter(F.col("reason").isNull()).select("query_id", F.inline(scopes))
    explicit_rows = chosen.filter(F.col("reason").isNull()).select(
        "query_id", "region_id", F.lit("explicit").alias("scope_kind")
    )
    rejects = folder_rows.filter(F.col("reason").isNotNull()).select("query_id", "reason").unionByName(
        chosen.filter(F.col("reason").isNotNull()).select("query_id", "reason").distinct()
    )
    bad = rejects.select("query_id").distinct()
    return expanded.unionByName(explicit_rows.join(bad, "query_id", "left_anti")), rejects

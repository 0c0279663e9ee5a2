"""Bindings of the versioned dependency walk (G1 to G3) to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query
from .views import Views

# Every part is a package with two releases; features hand on, name dependencies by dep:, /, and ?/, and lead to each other.
RELEASES = "SELECT p_partkey * 2 AS release, p_partkey AS package, 0 AS sort_key FROM {part} UNION ALL SELECT p_partkey * 2 + 1 AS release, p_partkey AS package, 1 AS sort_key FROM {part}"
SIDES = "SELECT src, dst, 0 AS j FROM {edges} UNION ALL SELECT src, dst, 1 AS j FROM {edges}"
DEPS = f"""SELECT src * 2 + j AS release, concat('P', dst) AS dep, (src + dst) % 3 AS kind, src % 4 = 0 AND (src + dst) % 3 < 2 AS optional, (src + dst) % 11 = 0 AS target_specific,
    dst % 3 > 0 AS default_features, CASE WHEN dst % 2 = 0 THEN 'F' END AS feature, dst * 2 + (src + j) % 2 AS to_release FROM ({SIDES}) s"""
OWN = [("default", "'f'", "package % 2 = 1"), ("f", "'g'", "true"), ("g", "concat('dep:p', CAST(floor(package / 2) AS BIGINT))", "true"), ("h", "concat('p', CAST(floor(package / 3) AS BIGINT), '/f')", "package % 5 > 0"), ("f", "concat('P', CAST(floor(package / 4) AS BIGINT), '?/h')", "package % 3 = 0"), ("bare", "CAST(NULL AS STRING)", "true")]
FEATURES = " UNION ALL ".join(f"SELECT release, '{name}' AS feature, {what} AS enables FROM ({RELEASES}) r WHERE {when}" for name, what, when in OWN)
PLAIN = {k: x.replace("{", "").replace("}", "") for k, x in (("rel", RELEASES), ("dep", DEPS), ("feat", FEATURES))}


def roles(v: Views):
    releases = v.spark.sql(RELEASES, part=v.part)
    deps = v.spark.sql(DEPS, edges=v.edges).withColumn("features", F.array_compact(F.array("feature"))).drop("feature")
    return releases, v.spark.sql(FEATURES, part=v.part), deps


WALK = f"""WITH RECURSIVE rel AS ({PLAIN['rel']}), dep AS ({PLAIN['dep']}), feat AS ({PLAIN['feat']}),
wants AS (SELECT *, '' AS f FROM dep UNION ALL SELECT *, 'default' FROM dep WHERE default_features UNION ALL SELECT *, lower(feature) FROM dep WHERE feature IS NOT NULL),
named AS (SELECT release, feature, enables, lower(regexp_replace(regexp_replace(split_part(enables, '/', 1), '^dep:', ''), '[?]$', '')) AS name, CASE WHEN contains(enables, '/') THEN lower(split_part(enables, '/', 2)) END AS sub FROM feat WHERE enables IS NOT NULL),
link AS (
    SELECT release, '' AS feature, to_release, f AS to_feature, kind, target_specific FROM wants WHERE NOT optional
    UNION SELECT n.release, n.feature, to_release, f, kind, target_specific FROM named n JOIN wants w ON w.release = n.release AND lower(w.dep) = name WHERE optional
    UNION SELECT n.release, n.feature, to_release, sub, kind, target_specific FROM named n JOIN dep d ON d.release = n.release AND lower(d.dep) = name WHERE sub IS NOT NULL
    UNION SELECT n.release, n.feature, n.release, name, 0, false FROM named n JOIN feat x ON x.release = n.release AND x.feature = name WHERE sub IS NULL AND NOT starts_with(n.enables, 'dep:')
    UNION SELECT w.release, lower(w.dep), to_release, f, kind, target_specific FROM wants w WHERE optional AND NOT EXISTS (SELECT 1 FROM feat x WHERE x.release = w.release AND x.feature = lower(w.dep))
), near AS (
    SELECT w.release AS root, to_release AS release, f AS feature, kind FROM wants w WHERE optional AND w.release % 2 = 1 AND to_release <> w.release
    UNION SELECT release, to_release, to_feature, kind FROM link WHERE kind = 2 AND feature = '' AND release % 2 = 1 AND to_release <> release
), walk(root, level, release, feature, kind) AS (
    SELECT * FROM (SELECT release AS root, level, release, feature, 0 AS kind FROM rel, (VALUES (0, ''), (0, 'default'), (1, ''), (1, 'default')) s(level, feature) WHERE sort_key = 1
    UNION SELECT release, 1, release, feature, 0 FROM named WHERE release % 2 = 1 UNION SELECT release, 1, release, lower(dep), 0 FROM dep WHERE optional AND release % 2 = 1
    UNION SELECT root, 1, release, feature, kind FROM near) start
    UNION
    SELECT root, level, to_release, to_feature, greatest(w.kind, l.kind) FROM walk w JOIN link l ON l.release = w.release AND l.feature = w.feature WHERE l.kind < 2 AND (level = 1 OR NOT target_specific) AND (to_release <> root OR w.release = root)
), direct AS (
    SELECT root, to_release AS release FROM walk w JOIN link l ON l.release = w.release AND l.feature = w.feature WHERE w.release = root AND l.kind < 2 AND (level = 1 OR NOT target_specific) UNION SELECT root, release FROM near
), closure AS (
    SELECT w.root, w.release, min(kind) AS kind, min(level) = 0 AS is_default, bool_or(d.release IS NOT NULL) AS direct FROM walk w LEFT JOIN direct d ON d.root = w.root AND d.release = w.release WHERE w.release <> w.root GROUP BY ALL
)"""


@query("g1_resolved_closure", f"{WALK} SELECT root, release, kind, is_default, direct FROM closure")
def _(v: Views):
    releases, features, deps = roles(v)
    return graph.resolved_closure(releases.where("sort_key = 1"), features, deps)


@query("g3_version_counts", f"""{WALK}, flat AS (SELECT root, package, max_by(c.release, (direct, sort_key, c.release)) AS release FROM closure c JOIN rel r ON r.release = c.release GROUP BY root, package)
SELECT package, release, count(*) AS n_roots FROM flat GROUP BY ALL""")
def _(v: Views):
    releases, features, deps = roles(v)
    return graph.resolved_version_counts(releases.where("sort_key = 1"), features, deps, releases)

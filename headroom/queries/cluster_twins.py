"""SQL twins of the clustering queries: recursive statements that seed, move, merge and split as the operators do."""

from __future__ import annotations

from collections.abc import Sequence

from headroom.queries.registry import half_up_sql
from headroom.queries.warehouse import FEATURE_NAMES


def _distance(point: Sequence[str], center: str) -> str:
    return " + ".join(f"({p} - {center}[{i}]) * ({p} - {center}[{i}])" for i, p in enumerate(point, start=1))


def kmeans_sql(k: int, starts: int = 3, steps: int = 20, least: int = 4, seed: int = 1) -> str:
    """K-means of ``zscores``: hash races for seeds, Lloyd steps with decimal sums, small clusters given up."""
    z = ["a", "b", "c", "d"]
    far = f"list_min([{_distance(z, 'm')} for m in centers])"
    near = f"[{_distance(z, 'm')} for m in centers]"
    time = f"-ln((CAST('0x' || substr(md5('{seed}-' || s || '-' || {{turn}} || '|' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
    sums = ", ".join(f"cast(sum(CASE WHEN j IS NULL THEN cast({c} AS decimal(38,6)) ELSE 0 END) AS double) AS s{c}" for c in z)
    shown = ", ".join(f"{half_up_sql(c)} AS {c}" for c in ("pop_total", *FEATURE_NAMES))
    return f"""WITH RECURSIVE points AS MATERIALIZED (
      SELECT *, state || '|' || county AS key, round(z1, 6) AS a, round(z2, 6) AS b, round(z3, 6) AS c, round(z4, 6) AS d FROM zscores),
    work AS MATERIALIZED (SELECT key, a, b, c, d, CAST(NULL AS BIGINT) AS j FROM points
      UNION ALL SELECT NULL, 0, 0, 0, 0, j FROM range(1, {k + 1}) t(j)),
    seeds AS (
      SELECT s, 1 AS r, [first([a, b, c, d] ORDER BY {time.format(turn="0")}, key)] AS centers FROM points, range({starts}) t(s) GROUP BY s
      UNION ALL
      SELECT s, r + 1, list_append(any_value(centers), first([a, b, c, d] ORDER BY time / far, key))
      FROM (SELECT s, r, centers, key, a, b, c, d, {time.format(turn="r")} AS time, {far} AS far FROM seeds, points WHERE r < {k}) x
      WHERE far > 0 GROUP BY s, r),
    moved AS (
      SELECT s, 0 AS i, centers FROM seeds WHERE r = {k}
      UNION ALL
      SELECT s, i + 1, list(CASE WHEN n > 0 THEN [sa / n, sb / n, sc / n, sd / n] ELSE old END ORDER BY place)
      FROM (SELECT s, i, place, count(*) FILTER (j IS NULL) AS n, any_value(centers[place]) AS old, {sums}
        FROM (SELECT s, i, centers, j, a, b, c, d, coalesce(j, list_position(near, list_min(near))) AS place
          FROM (SELECT s, i, centers, j, a, b, c, d, {near} AS near FROM moved, work WHERE i < {steps}) x) y
        GROUP BY s, i, place) m
      GROUP BY s, i),
    costs AS (SELECT s, centers, list_position(near, list_min(near)) AS place, list_min(near) AS cost
      FROM (SELECT s, centers, {near} AS near FROM moved, points WHERE i = {steps}) x),
    best AS (SELECT s FROM costs GROUP BY s ORDER BY sum(cast(cost AS decimal(38,6))), s LIMIT 1),
    sizes AS (SELECT centers[place] AS center, count(*) AS n FROM costs WHERE s = (SELECT s FROM best) GROUP BY 1),
    kept AS (SELECT list(center ORDER BY center) AS centers FROM sizes WHERE n >= {least})
    SELECT state, county, {shown}, list_position(near, list_min(near)) AS cluster
    FROM (SELECT *, {near} AS near FROM points, kept) x"""


def linkage_sql() -> str:
    """Complete linkage of the states by their mean features: in each step the closest pair of clusters merges."""
    means = ", ".join(f"avg({c}) AS f{i}" for i, c in enumerate(FEATURE_NAMES, start=1))
    scaled = ", ".join(f"round(coalesce((f{i} - avg(f{i}) OVER ()) / nullif(stddev_samp(f{i}) OVER (), 0), 0), 6) AS z{i}" for i in range(1, 5))
    return f"""WITH RECURSIVE means AS (SELECT state, {means} FROM features GROUP BY state),
    points AS MATERIALIZED (SELECT state, z1, z2, z3, z4, row_number() OVER (ORDER BY z1, z2, z3, z4) AS i FROM (SELECT state, {scaled} FROM means) m),
    pairs AS MATERIALIZED (SELECT x.i AS i, y.i AS j, sqrt({" + ".join(f"pow(x.z{c} - y.z{c}, 2)" for c in range(1, 5))}) AS h
      FROM points x, points y WHERE x.i < y.i),
    steps AS (
      SELECT 0 AS step, (SELECT list(i ORDER BY i) FROM points) AS owner, 0::BIGINT AS l, 0::BIGINT AS r, 0.0::DOUBLE AS height
      UNION ALL
      SELECT step + 1, [CASE WHEN o = b.r THEN b.l ELSE o END for o in any_value(owner)], b.l, b.r, b.h
      FROM (SELECT step, owner, min({{'h': h, 'l': l, 'r': r}}) OVER () AS b
        FROM (SELECT step, owner, least(owner[i], owner[j]) AS l, greatest(owner[i], owner[j]) AS r, max(h) AS h
          FROM steps, pairs WHERE owner[i] <> owner[j] GROUP BY ALL) x) y
      GROUP BY step, b)
    SELECT step, a.state AS "left", b.state AS "right", round(height, 6) AS height, CAST(len([o for o in owner if o = l]) AS BIGINT) AS members
    FROM steps JOIN points a ON a.i = l JOIN points b ON b.i = r WHERE step > 0"""


def split_sql(rows: str, key: str, measures: Sequence[str], levels: int, least: int) -> str:
    """Leaves of a k-d tree over ``rows`` (a statement): lower medians of the measures in turn, sides of ``least`` rows or no split."""
    parts = [f"l0 AS (SELECT *, 1 AS leaf FROM ({rows}) r)"]
    for level in range(levels):
        m = measures[level % len(measures)]
        parts.append(f"m{level} AS (SELECT leaf, quantile_disc({m}, 0.5) AS median FROM l{level} GROUP BY leaf)")
        parts.append(
            f"""s{level} AS (SELECT leaf, median FROM l{level} JOIN m{level} USING (leaf) GROUP BY leaf, median
          HAVING count(*) FILTER ({m} <= median) >= {least} AND count(*) FILTER ({m} > median) >= {least})"""
        )
        parts.append(
            f"""l{level + 1} AS (SELECT l.* EXCLUDE (leaf), l.leaf * 2 + CASE WHEN {m} > median THEN 1 ELSE 0 END AS leaf
          FROM l{level} l LEFT JOIN s{level} USING (leaf))"""
        )
    return f"""WITH {", ".join(parts)}
    SELECT {key}, dense_rank() OVER (ORDER BY leaf) AS cluster FROM l{levels}"""

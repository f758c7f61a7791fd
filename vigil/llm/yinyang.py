"""Centroid clustering with Yinyang bounds.

Lloyd rounds over vectors of whole numbers. Centroids are dealt into groups once. Each vector keeps an upper bound of the distance to its centroid and, for
every group, a lower bound of the distance to any other centroid of the group. When centroids have moved, the bounds are moved by as much:
  * global filter: a vector whose upper bound is below all lower bounds keeps its centroid;
  * group filter: else its distance is taken anew, and only groups whose lower bound doesn't exceed it are looked at;
  * the centroids that survive are scanned exactly, in whole numbers.
Bounds are moved outwards by a little, so that rounding never settles a comparison, and a tie is always scanned.

Vectors and bounds are a table in the shared folder, rewritten by each round; tasks hold one Arrow batch. The centroids (k of them) are all that the driver
holds. Sums for the new centroids are taken by cluster and lane, so that a cluster that holds most rows is no one task's load.

Defined results: vectors that are null, of another size, or with a null or non-finite component are left out; a component x counts as floor(64 * x), held within
+-LIMIT, since the result's 64-bit distances could not hold more; repeated ids are vectors of their own; a null vec_id counts as `null` in the
hash; ties of the hash go by the components; fewer vectors than k give as many centroids; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
GROUPS = 4
LIMIT = 1 << 27
LANES = 64
_WIDE = 1e-9


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few Lloyd rounds over the centroids themselves."""
    k = len(centroids)
    x = centroids.astype(float)
    seeds = x[np.linspace(0, k - 1, min(groups, k)).astype(int)]
    for _ in range(5):
        at = ((x[:, None] - seeds[None]) ** 2).sum(-1).argmin(1)
        for g in range(len(seeds)):
            if (at == g).any():
                seeds[g] = x[at == g].mean(0)
    return np.unique(((x[:, None] - seeds[None]) ** 2).sum(-1).argmin(1), return_inverse=True)[1]


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids; products of doubles are exact while the numbers are small."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = float if most < 1 << 22 else np.int64
    a, b = v.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)


def first_bounds(v: np.ndarray, centroids: np.ndarray, group: np.ndarray):
    """cluster, upper and lower bounds of rows nothing is known of."""
    d = squared(v, centroids)
    at = d.argmin(1)
    return at, *_bounds(d, at, group)


def _bounds(d: np.ndarray, at: np.ndarray, group: np.ndarray):
    rows = np.arange(len(d))
    upper = np.sqrt(d[rows, at].astype(float)) * (1 + _WIDE)
    others = np.sqrt(d.astype(float)) * (1 - _WIDE)
    others[rows, at] = np.inf
    lower = np.stack([others[:, group == g].min(1) for g in range(group.max() + 1)], 1)
    return upper, lower


def next_bounds(v, at, upper, lower, old, centroids, group):
    """The same after the centroids moved from `old`; also how many distances were taken."""
    moved = np.sqrt(((centroids - old).astype(float) ** 2).sum(1)) * (1 + _WIDE)
    far = np.array([moved[group == g].max() for g in range(group.max() + 1)])
    at, upper, lower = at.copy(), upper + moved[at], lower - far - _WIDE
    taken = 0
    unsure = np.flatnonzero(upper >= lower.min(1))
    if not len(unsure):
        return at, upper, lower, taken
    own = np.zeros(len(unsure), np.int64)
    for c in np.unique(at[unsure]):
        of = at[unsure] == c
        own[of] = squared(v[unsure[of]], centroids[c : c + 1])[:, 0]
    taken += len(unsure)
    upper[unsure] = np.sqrt(own.astype(float)) * (1 + _WIDE)
    keep = upper[unsure] >= lower[unsure].min(1)
    unsure, own = unsure[keep], own[keep]
    if not len(unsure):
        return at, upper, lower, taken
    best, chosen = own.copy(), at[unsure].copy()
    exact = {}
    for g in range(group.max() + 1):
        members = np.flatnonzero(group == g)
        rows = np.flatnonzero(lower[unsure, g] <= upper[unsure])
        if not len(rows):
            continue
        d = squared(v[unsure[rows]], centroids[members])
        taken += d.size
        exact[g] = rows, d
        for j, c in enumerate(members):
            better = (d[:, j] < best[rows]) | ((d[:, j] == best[rows]) & (c < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = d[better, j], c
    before = at[unsure]
    for g, (rows, d) in exact.items():
        members = np.flatnonzero(group == g)
        others = np.sqrt(d.astype(float)) * (1 - _WIDE)
        others[chosen[rows][:, None] == members[None]] = np.inf
        lower[unsure[rows], g] = others.min(1)
    # a centroid that was left is one of its group's others now; its group may not have been scanned
    left = np.flatnonzero(chosen != before)
    g = group[before[left]]
    lower[unsure[left], g] = np.minimum(lower[unsure[left], g], np.sqrt(own[left].astype(float)) * (1 - _WIDE))
    at[unsure] = chosen
    upper[unsure] = np.sqrt(best.astype(float)) * (1 + _WIDE)
    return at, upper, lower, taken


_STATE = "vec_id {id}, v array<int>, cluster int, upper double, lower array<double>"


def _flat(column, kind, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _lists(x: np.ndarray, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel(), kind))


def assign(rows: DataFrame, group: np.ndarray, centroids: np.ndarray, old: np.ndarray | None) -> DataFrame:
    """(vec_id, v, cluster, upper, lower) under the centroids; old: those the rows' bounds are of, None if they have none yet."""
    schema = _STATE.format(id=rows.schema["vec_id"].dataType.simpleString())
    groups, size = int(group.max()) + 1, centroids.shape[1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = _flat(batch.column("v"), np.int64, size)
            if old is None:
                at, upper, lower = first_bounds(v, centroids, group)
            else:
                at = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = batch.column("upper").to_numpy(zero_copy_only=False)
                at, upper, lower, _ = next_bounds(v, at, upper, _flat(batch.column("lower"), float, groups), old, centroids, group)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(v, pa.int32()), pa.array(at, pa.int32()), pa.array(upper), _lists(lower, pa.float64())], ["vec_id", "v", "cluster", "upper", "lower"])

    return rows.mapInArrow(run, schema)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of each cluster's mean; of an empty one the centroid as it was."""
    size = centroids.shape[1]
    lane = F.pmod(F.xxhash64("vec_id", "v"), F.lit(LANES)).alias("lane")
    parts = state.select("cluster", lane, *[F.get("v", F.lit(j)).cast("long").alias(f"x{j}") for j in range(size)])
    parts = parts.groupBy("cluster", "lane").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{j}").alias(f"x{j}") for j in range(size)])
    out = centroids.copy()
    totals: dict[int, list[int]] = {}
    for r in parts.collect():  # at most clusters * LANES rows
        t = totals.setdefault(r.cluster, [0] * (size + 1))
        for j, x in enumerate([r.n, *r[3:]]):
            t[j] += x
    for c, (n, *sums) in totals.items():
        out[c] = [s // n for s in sums]
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, groups: int = GROUPS, size: int = SIZE):
    """(rows of (vec_id, cluster, distance), the final centroids)."""
    common.small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e")).where(F.size("e") == size)
    x = F.transform("e", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), c * SCALE))).cast("int"))
    rows = common.materialise(rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("v")))
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    start = rows.select("v", seed.alias("s")).orderBy("s", "v").limit(clusters).collect()
    if not start:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), np.zeros((0, size), np.int64)
    centroids = np.array([r.v for r in start], np.int64)
    group, old, state = grouped(centroids, groups), None, rows
    for k in range(rounds + 1):
        new = common.materialise(assign(state, group, centroids, old))
        common.discard(state)
        state = new
        if k < rounds:
            old, centroids = centroids, moved(state, centroids)
    return _distances(state, centroids), centroids


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = _flat(batch.column("v"), np.int64, centroids.shape[1])
            at = batch.column("cluster").to_numpy(zero_copy_only=False)
            d = ((v - centroids[at]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    return common.materialise(state.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(common.table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # one row a cluster
    total = sum(int(s) for s in sums.values())
    marks = [(c, int(sums[c]), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(sums)]
    known = spark.createDataFrame(marks, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    parts = [
        f"""e AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {SIZE})""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) - 1 AS INTEGER) AS c, v
  FROM e QUALIFY c < {CLUSTERS})""",
    ]
    for k in range(ROUNDS + 1):
        parts += [
            f"""d{k} AS (SELECT r, vec_id, e.v AS v, c, c{k}.v AS m, CAST(list_sum([(e.v[i] - c{k}.v[i]) * (e.v[i] - c{k}.v[i]) FOR i IN range(1, {SIZE + 1})]) AS BIGINT) AS distance FROM e, c{k})""",
            f"""a{k} AS (SELECT * FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)""",
        ]
        if k < ROUNDS:
            parts += [
                f"""s{k} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {SIZE + 1})) AS i FROM a{k}) GROUP BY c, i)""",
                f"""m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY c)""",
                f"""c{k + 1} AS (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))""",
            ]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS}"""


ORACLE_SQL = _oracle()

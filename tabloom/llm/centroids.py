"""Centroid clustering on dictionary-encoded subvectors.

A vector of whole numbers is cut into blocks of ``WIDTH`` components. A chunk of at most ``CHUNK`` vectors stores, per block, its distinct
subvectors and one code per vector, as a columnar file does; nothing is lost, and repeated vectors or values cost one entry. In a round
every dictionary entry is compared with the centroids once, exactly, and a vector's distances are the sums of its codes' partial distances.
New centroids come from the dictionaries as well: how often a cluster uses a code, times the subvector. Tasks return sums per cluster and
component; nothing else leaves them, so a round moves K * DIM numbers a task and holds one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fitted

DIM = 64
SCALE = 64
K = 16
ROUNDS = 3
WIDTH = 2
CHUNK = 8192
LIMIT = 1 << 26  # beyond it a squared distance may not fit a long


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the components as whole numbers ``q``, for vectors with DIM finite components."""
    usable = (F.size("embedding") == DIM) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    kept = vectors.select("vec_id", "embedding").where(F.coalesce(usable, F.lit(False)))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * SCALE) < LIMIT)
    return kept.select("vec_id", F.when(small, scaled).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits"))).alias("q"))


def first_centroids(whole: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest digests of their ids, in that order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = whole.orderBy(digest.asc_nulls_last(), "q").limit(k).select("q").collect()  # k rows
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), DIM)


def encode(whole: DataFrame) -> DataFrame:
    """One row per chunk: vec_id (list), codes (uint16, block by block), words (the dictionaries, one after another), sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                q = np.asarray(part.column("q").flatten()).astype(np.int64, copy=False).reshape(part.num_rows, DIM)
                codes, words, sizes = [], [], []
                for lo in range(0, DIM, WIDTH):
                    distinct, code = np.unique(q[:, lo : lo + WIDTH], axis=0, return_inverse=True)
                    codes.append(code.astype(np.uint16).ravel())
                    words.append(distinct.ravel())
                    sizes.append(len(distinct))
                ids = part.column("vec_id")
                yield pa.record_batch(
                    {
                        "vec_id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        "codes": pa.array([np.concatenate(codes).tobytes()], pa.binary()),
                        "words": pa.array([np.concatenate(words).tobytes()], pa.binary()),
                        "sizes": pa.array([sizes], pa.list_(pa.int32())),
                    }
                )

    id_type = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id array<{id_type}>, codes binary, words binary, sizes array<int>")


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """Ids, codes per block, dictionary per block."""
    for i in range(batch.num_rows):
        ids = batch.column("vec_id")[i].values
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16).reshape(-1, len(ids))
        words = np.frombuffer(batch.column("words")[i].as_buffer(), np.int64).reshape(-1, WIDTH)
        cuts = np.cumsum(batch.column("sizes")[i].as_py())[:-1]
        yield ids, list(codes), np.split(words, cuts)


def nearest(codes: list[np.ndarray], words: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of every vector of a chunk."""
    total = np.zeros((len(codes[0]), len(centroids)), np.int64)
    for b, (code, word) in enumerate(zip(codes, words)):
        part = ((word[:, None, :] - centroids[None, :, b * WIDTH : (b + 1) * WIDTH]) ** 2).sum(axis=2)
        total += part[code]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def moved(encoded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the exact mean of each one's vectors; those without vectors stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, DIM), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, codes, words in chunks(batch):
                cluster, _ = nearest(codes, words, centroids)
                counts += np.bincount(cluster, minlength=k)
                for b, (code, word) in enumerate(zip(codes, words)):
                    used = np.bincount(cluster * len(word) + code, minlength=k * len(word)).reshape(k, len(word))
                    sums[:, b * WIDTH : (b + 1) * WIDTH] += used @ word
        yield pa.record_batch(
            {
                "cluster": pa.array(np.repeat(np.arange(k, dtype=np.int32), DIM)),
                "dim": pa.array(np.tile(np.arange(DIM, dtype=np.int32), k)),
                "total": pa.array(sums.ravel()),
                "rows": pa.array(np.repeat(counts, DIM)),
            }
        )

    parts = encoded.mapInArrow(run, "cluster int, dim int, total bigint, rows bigint")
    summed = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows"))
    out = centroids.copy()
    for row in summed.where("rows > 0").collect():  # at most k * DIM rows
        out[row.cluster, row.dim] = int(row.total) // row.rows
    return out


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable row of ``vectors``: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, hold another number of components than DIM, or a null or non-finite one, are left out. A null vec_id is never a
    first centroid but is clustered; repeated rows count as often as they occur (and may be several first centroids). Fewer than k vectors
    give fewer centroids, none an empty result. Components of 2**20 or more in magnitude stop the job: their distances do not fit a long.
    """
    whole = whole_vectors(vectors)
    encoded = fitted(encode(whole), "encoded")
    centroids = first_centroids(whole, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(encoded, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, codes, words in chunks(batch):
                cluster, distance = nearest(codes, words, centroids)
                yield pa.record_batch({"vec_id": ids, "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    found = fitted(encoded.mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint"), "clustered")
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array(F.lit(None).cast(kind)), F.col("cluster") + 1)

    return found.select(
        "vec_id", "cluster", "distance", of_cluster([inertia.get(c, 0) for c in range(len(names))], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of_cluster(names, "string").alias("centroid_sha256"),
    )


def _sql() -> str:
    """The rounds spelled out; ids are row numbers, because a vec_id may repeat."""
    parts = [
        f"kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q"
        f" from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM})",
        f"c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), q) - 1 as cluster, q from kept where vec_id is not null"
        f" order by 1 limit {K})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"a{r} as materialized (select rid, min((d, cluster)) as best from (select rid, cluster,"
            f" list_sum(list_transform(list_zip(k.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept k, c{r} c) group by rid)"
        )
        if r < ROUNDS:
            parts.append(
                f"m{r} as materialized (select cluster, list(v order by dim) as q from (select best[2] as cluster, dim, floor(sum(v) / count(*))::bigint as v from"
                f" (select rid, unnest(q) as v, generate_subscripts(q, 1) as dim from kept) join a{r} using (rid) group by all) group by cluster)"
            )
            parts.append(f"c{r + 1} as materialized (select cluster, coalesce(m.q, c.q) as q from c{r} c left join m{r} m using (cluster))")
    return f"""with {", ".join(parts)}
select k.vec_id, best[2]::int as cluster, best[1]::bigint as distance, sum(best[1]) over (partition by best[2])::bigint as cluster_inertia,
  sum(best[1]) over ()::bigint as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from a{ROUNDS} join kept k using (rid) join c{ROUNDS} c on c.cluster = best[2]"""


SQL = _sql()

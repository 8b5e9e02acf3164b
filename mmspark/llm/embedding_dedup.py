"""Near-duplicate vectors of one label by cosine, tile by tile in PCA order.

Equal vectors are one class from the start.  The vectors of a label (and of one
length) are dealt to tiles by a hash of the id; a task compares one pair of
tiles.  Vectors are scaled to length 1 and turned to principal axes, so leading
coordinates carry most of a product: the products of the first coordinates are
added up first, the rest is bounded by the product of the two suffix norms, and
a pair leaves as soon as partial sum plus bound cannot reach the threshold.
Survivors of all steps are checked in double precision on the given vectors.
The axes are fitted to a bounded sample (`sample` vectors, expected number,
chosen by a hash); any axes give the same result.

A task returns link counts and only those edges that join its local
components, so a group of near copies never becomes all of its pairs.  The
number of tile pairs of a label grows with the square of its size.

Edge cases: null labels, null or empty vectors, zero vectors and those with a
null or non-finite component link with nothing and are their own component;
vectors of different lengths never link; rows with one id and one vector are
linked copies; a null id takes part but is never a component; ids below -2**62 are
not supported; other columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmspark.llm._graph import components
from mmspark.llm._spark import Steps, join_spread


NAMELESS = -(2**63)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def finite(name: str):
    """The vector has components, and each is a finite number."""
    return F.coalesce(F.expr(f"size({name}) > 0 and forall({name}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def similar(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with the cosine of x[i] and y[j] at least the threshold."""
    ux, uy = unit(x), unit(y)
    px, py = ux @ axes, uy @ axes
    d = px.shape[1]
    tail = lambda p, k: np.sqrt(np.maximum(0, (p[:, k:] ** 2).sum(1)))
    k = min(step, d)
    part = px[:, :k] @ py[:, :k].T
    i, j = np.nonzero(part + tail(px, k)[:, None] * tail(py, k)[None, :] >= threshold - 1e-9)
    part = part[i, j]
    while k < d:
        nxt = min(d, k + step)
        part = part + np.einsum("ij,ij->i", px[i, k:nxt], py[j, k:nxt])
        k = nxt
        keep = part + tail(px, k)[i] * tail(py, k)[j] >= threshold - 1e-9
        i, j, part = i[keep], j[keep], part[keep]
    exact = np.einsum("ij,ij->i", ux[i], uy[j]) >= threshold
    return i[exact], j[exact]


def principal_axes(rows: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, by descending second moment."""
    _, v = np.linalg.eigh(rows.T @ rows)
    return v[:, ::-1]


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, tile: int = 1024, sample: int = 20_000) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    steps = Steps(vectors.sparkSession)
    # adding zero makes one zero of two, so that equal vectors have equal hashes
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("embedding"), F.col("label"))
    ok = finite("embedding") & F.expr("exists(embedding, x -> x <> 0)") & F.col("label").isNotNull()
    vectors = vectors.withColumn("ok", F.coalesce(ok, F.lit(False)))
    vectors = vectors.withColumn("h", F.xxhash64("label", "embedding"))
    classes = steps.keep(vectors.where("ok").groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).select("*", F.size("embedding").alias("d"), F.monotonically_increasing_id().alias("row")))
    # a class of null ids only still needs a name: one below all real ids, so it is told apart below
    classes = classes.withColumn("id", F.coalesce("least", F.lit(NAMELESS) + F.col("row"))).drop("row", "least")
    n = classes.count()
    axes = {}
    drawn = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30)).select("d", "embedding").toArrow()
    for d in set(drawn.column("d").to_pylist()):
        axes[d] = principal_axes(unit(matrix(drawn.filter(pa.compute.equal(drawn.column("d"), d)).column("embedding"))))
    sizes = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / tile).cast("int").alias("m"))
    rows = classes.join(sizes, ["label", "d"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("label", "d", "id", "copies", "embedding", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
        x = matrix(table.column("embedding"))
        lo, hi = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links = np.zeros(len(ids), np.int64)
        up = list(range(len(ids)))

        def root(a):
            while up[a] != a:
                up[a] = a = up[up[a]]
            return a

        edges = []
        if len(left) and len(right):
            basis = axes.get(x.shape[1], np.eye(x.shape[1]))
            for s in range(0, len(left), 1024):
                a, b = similar(x[left[s : s + 1024]], x[right], basis, threshold)
                a, b = left[s + a], right[b]
                if lo == hi:
                    a, b = a[a < b], b[a < b]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    if (u := root(p)) != (v := root(q)):
                        up[max(u, v)] = min(u, v)
                        edges.append((ids[p], ids[q]))
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array([*ids[some].tolist(), *(int(e[0]) for e in edges)], pa.int64()), "b": pa.array([*[None] * len(some), *(int(e[1]) for e in edges)], pa.int64()), "links": pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64())})

    found = steps.keep(rows.groupBy("label", "d", "i", "j").applyInArrow(run, "a long, b long, links long"))
    linked = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"), steps).select(F.col("node").alias("id"), "component")
    real = classes.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    nameless = F.col("component") < NAMELESS // 2
    if not real.where(nameless).isEmpty():
        # such a name is the smallest of its component: rename the component by its smallest real id
        real = steps.keep(real)
        renamed = real.where(nameless).groupBy("component").agg(F.min(F.when(F.col("id") >= NAMELESS // 2, F.col("id"))).alias("real"))
        real = join_spread(real, renamed, "component", "id", "left").select("id", F.when(nameless, F.col("real")).otherwise(F.col("component")).alias("component"))
    named = steps.keep(classes.select("h", "label", "embedding", "id", "copies").join(linked, "id", "left").join(real, "id", "left").select("h", "label", "embedding", "copies", "links", "component"))
    steps.drop(found)
    out = join_spread(vectors, named, "h", "vec_id", "left", ["label", "embedding"])
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("ok"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Exact top-k search by inner product in M-trees.

Vectors become integers: ``floor(scale * x)`` for each component. With one more component,
``sqrt(M - |x|^2)`` for the largest squared norm M, inner products turn into a metric: the squared
Euclidean distance of a query (there 0 is added) and a vector is ``|q|^2 + M - 2 * q.x``.

Trees are paged: a node has a pivot, a covering radius and the distance of its pivot from its
parent's, a leaf page has the distances of its vectors from its pivot. A search takes the node with
the least possible distance first. By the triangle inequality, stored distances rule out nodes and
vectors before anything is computed for them; what remains gets an exact integer score. Queries are
searched in blocks: a node is opened once for all queries of the block that may need it.

An index is a table of trees of bounded size. Vectors are range-partitioned by their nearest route
(of a bounded sample) and the distance from it, so a large group is cut into shells. Vectors that are
equal are one entry, with as many of its smallest ids as any result can have.

The roots of all trees (pivot, covering radius) are a directory, which each block searches first: a
query visits the tree of the nearest root, and with the reach found there only those trees whose
least possible distance lies within it. Trees that no query of a block needs aren't sent to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import columns, parallel, record_batch, write_table

#: Below this squared norm all scores fit a long.
MAX_NORM2 = 1 << 61

#: Entries of a tree, of a leaf page, children of a node.
TREE_ROWS, PAGE_ROWS, FANOUT = 4096, 96, 8

#: Queries searched together, and vectors sampled as routes.
BLOCK_QUERIES, ROUTES = 512, 64

#: Roots of a page of the directory, and bytes of roots up to which all pages are broadcast.
DIRECTORY_ROWS, BROADCAST_BYTES = 4096, 32 << 20

#: The k-th best score where there are fewer than k.
NONE = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, row_id, dim, norm2 and v (little-endian 32-bit integers) of the usable rows."""
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and x is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            flat = col.values.to_numpy(zero_copy_only=False)
            ends = col.offsets.to_numpy().astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # a null is read as NaN
            good = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
            whole = np.floor(scale * np.where(np.isfinite(flat), flat, 0.0))
            parts = [whole[ends[i] : ends[i + 1]] for i in good]
            norms = [float(p @ p) for p in parts]
            if any(n >= MAX_NORM2 for n in norms):
                raise ValueError(f"a squared norm of {MAX_NORM2} or more after scaling: scores may not fit a long")
            schema = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("norm2", pa.int64()), ("v", pa.binary())])
            yield record_batch(schema, [batch.column(0).take(pa.array(good)), [len(p) for p in parts], [int(n) for n in norms], [p.astype("<i4").tobytes() for p in parts]])

    return src.mapInArrow(run, "id long, dim int, norm2 long, v binary").withColumn("row_id", F.monotonically_increasing_id())


def _lifted(vectors: np.ndarray, largest: int) -> np.ndarray:
    """Vectors (n, dim) with the component that makes their squared norm ``largest``."""
    x = vectors.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, largest - (x * x).sum(1)))[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of ``a`` from the row ``b``."""
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of int32 rows: in floating point while every sum stays below
    2**53, else in 64-bit integers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


class Tree:
    """One M-tree over int32 vectors (n, dim), its nodes in breadth-first order.

    Node i has ``pivots[i]``, ``radius[i]``, ``to_parent[i]`` and the range ``spans[i]``: of its
    children, or for a leaf page of its vectors, whose distances from the pivot are ``from_pivot``.
    """

    FIELDS = (("dim", "int"), ("vectors", "binary"), ("pivots", "binary"), ("radius", "binary"), ("to_parent", "binary"), ("leaf", "binary"), ("spans", "binary"), ("from_pivot", "binary"))

    def __init__(self, dim: int, vectors: bytes, pivots: bytes, radius: bytes, to_parent: bytes, leaf: bytes, spans: bytes, from_pivot: bytes):
        self.vectors = np.frombuffer(vectors, "<i4").reshape(len(from_pivot) // 8, dim)
        self.pivots = np.frombuffer(pivots, "<f8").reshape(-1, dim + 1)
        self.radius, self.to_parent, self.from_pivot = (np.frombuffer(x, "<f8") for x in (radius, to_parent, from_pivot))
        self.leaf, self.spans = np.frombuffer(leaf, bool), np.frombuffer(spans, "<i4").reshape(-1, 2)

    @classmethod
    def build(cls, vectors: np.ndarray, largest: int) -> tuple[tuple, np.ndarray]:
        """The fields of a tree, and the order in which it holds the vectors."""
        lifted = _lifted(vectors, largest)
        waiting: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(vectors)), None)]
        nodes, order, from_pivot = [], [], []
        taken = 0
        for at, parent in waiting:  # grows while it is read
            x = lifted[at]
            pivot = x[_distances(x, x.mean(0)).argmin()]
            d = _distances(x, pivot)
            leaf = len(at) <= PAGE_ROWS
            if leaf:
                span = (taken, taken + len(at))
                taken += len(at)
                order.append(at)
                from_pivot.append(d)
            else:
                parts = [at]
                while len(parts) < FANOUT and max(map(len, parts)) > PAGE_ROWS:
                    parts = [half for p in parts for half in (cls._halves(lifted, p) if len(p) > PAGE_ROWS else [p])]
                span = (len(waiting), len(waiting) + len(parts))
                waiting += [(p, pivot) for p in parts]
            nodes.append((pivot, float(d.max(initial=0.0)), 0.0 if parent is None else float(_distances(pivot[None], parent)[0]), leaf, span))
        order = np.concatenate(order)
        pivots, radius, to_parent, leaf, spans = (np.array(x) for x in zip(*nodes, strict=True))
        arrays = (vectors[order].astype("<i4"), pivots.astype("<f8"), radius.astype("<f8"), to_parent.astype("<f8"), leaf, spans.astype("<i4"), np.concatenate(from_pivot).astype("<f8"))
        return (vectors.shape[1], *(x.tobytes() for x in arrays)), order

    @staticmethod
    def _halves(lifted: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """A split by two far objects, at the median, so that pages stay full and paths short."""
        x = lifted[at]
        one = x[_distances(x, x[0]).argmax()]
        two = x[_distances(x, one).argmax()]
        order = np.argsort(_distances(x, one) - _distances(x, two), kind="stable")
        return [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


class Best:
    """The ``k`` best entries of each query of a block: by score, then by the smaller id. ``kth``
    are scores that the k-th best is known to reach: lower ones aren't looked for."""

    def __init__(self, queries: np.ndarray, largest: int, k: int, kth: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.lifted = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], 1)
        self.norm2 = (self.lifted**2).sum(1)
        self.largest = largest
        self.found: list[list[tuple[int, int, object]]] = [[] for _ in range(len(queries))]
        self.kth = np.full(len(queries), NONE) if kth is None else kth.copy()
        self.slack = 1e-6 * np.sqrt(self.norm2 + largest) + 1e-6  # rounding of the lifted component
        self.reach = np.where(self.kth == NONE, np.inf, np.sqrt(np.maximum(0.0, self.norm2 + largest - 2.0 * self.kth)) + self.slack)

    def root_distances(self, roots: np.ndarray) -> np.ndarray:
        """Distances of all queries from the roots of trees."""
        square = self.norm2[:, None] + (roots * roots).sum(1)[None, :] - 2 * self.lifted @ roots.T
        return np.sqrt(np.maximum(0.0, square))

    def needed(self, roots: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Which queries may find something in which trees."""
        return self.root_distances(roots) - radii[None, :] <= (self.reach + self.slack)[:, None]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, refs: list) -> None:
        """Scores of queries ``rows`` against entries with smallest ids ``ids``."""
        floor = self.kth[rows]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        hit = scores >= floor[:, None]
        for r in np.flatnonzero(hit.any(1)):
            q = int(rows[r])
            new = [(-int(scores[r, j]), int(ids[j]), refs[j]) for j in np.flatnonzero(hit[r])]
            self.found[q] = heapq.nsmallest(self.k, self.found[q] + new, key=lambda f: f[:2])
            if len(self.found[q]) == self.k:
                self.kth[q] = -self.found[q][-1][0]
                self.reach[q] = np.sqrt(max(0.0, self.norm2[q] + self.largest - 2.0 * self.kth[q])) + self.slack[q]


def search(tree: Tree, best: Best, ids: np.ndarray, refs: list) -> None:
    """Best-first search of one tree for a block of queries; what is found goes to ``best``.

    The queue holds nodes by their least possible distance from a query that still needs them,
    together with those queries and their distances from the node's pivot.
    """
    everyone = np.arange(len(best.queries))
    d = _distances(best.lifted, tree.pivots[0])
    low = np.maximum(0.0, d - tree.radius[0])
    queue = [(float(low.min(initial=np.inf)), 0, everyone, d, low)]
    while queue:
        _, at, who, d, low = heapq.heappop(queue)
        needed = low <= best.reach[who]
        who, d, low = who[needed], d[needed], low[needed]
        if not len(who):
            continue
        start, end = tree.spans[at].tolist()
        if tree.leaf[at]:
            close = np.abs(d[:, None] - tree.from_pivot[None, start:end]) <= best.reach[who][:, None]
            some, entries = close.any(1), start + np.flatnonzero(close.any(0))
            if len(entries):
                best.add(who[some], _scores(best.queries[who[some]], tree.vectors[entries]), ids[entries], [refs[e] for e in entries])
            continue
        for c in range(start, end):
            near = np.abs(d - tree.to_parent[c]) - tree.radius[c] <= best.reach[who]
            if near.any():
                to = _distances(best.lifted[who[near]], tree.pivots[c])
                least = np.maximum(low[near], to - tree.radius[c])
                heapq.heappush(queue, (float(least.min()), c, who[near], to, least))


def _routed(entries: DataFrame, routes: dict[int, np.ndarray], largest: int) -> DataFrame:
    """Adds the nearest route and the distance from it (order of work only: results don't depend on it)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lifted = {dim: _lifted(r, largest) for dim, r in routes.items()}
        for batch in batches:
            dims, vs = columns(batch, "dim", "v")
            route, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in set(dims):
                rows = np.array([i for i, n in enumerate(dims) if n == dim])
                if dim not in lifted:
                    continue
                x = _lifted(_matrix([vs[i] for i in rows], dim), largest)
                square = (x * x).sum(1)[:, None] + (lifted[dim] ** 2).sum(1)[None, :] - 2 * x @ lifted[dim].T
                route[rows] = square.argmin(1)
                dist[rows] = np.sqrt(np.maximum(0.0, square.min(1)))
            schema = batch.schema.append(pa.field("route", pa.int32())).append(pa.field("dist", pa.float64()))
            yield record_batch(schema, [*batch.columns, pa.array(route), pa.array(dist)])

    return entries.mapInArrow(run, f"{fields}, route int, dist double")


_TREE = pa.schema([("root", pa.binary()), ("root_radius", pa.float64()), *[(n, pa.int32() if t == "int" else pa.binary()) for n, t in Tree.FIELDS], ("ids", pa.list_(pa.list_(pa.int64()))), ("rows", pa.list_(pa.list_(pa.int64())))])
_TREE_DDL = "root binary, root_radius double, " + ", ".join(f"{n} {t}" for n, t in Tree.FIELDS) + ", ids array<array<long>>, rows array<array<long>>"


def _pages(batches: Iterable[pa.RecordBatch], per_row: int) -> Iterator[tuple[int, list[tuple]]]:
    """Consecutive rows (id_list, row_list, v) of one dim, at most ``per_row`` together."""
    held: list[tuple] = []
    dim = None
    for batch in batches:
        for d, *row in zip(*columns(batch, "dim", "id_list", "row_list", "v"), strict=True):
            if held and (d != dim or len(held) == per_row):
                yield dim, held
                held = []
            dim = d
            held.append(tuple(row))
    if held:
        yield dim, held


def _matrix(vs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vs), "<i4").reshape(len(vs), dim)


def top_k(rows: DataFrame, queries: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest integer inner product with each query row; ties to smaller ids.

    ``queries`` is SQL over ``id`` (the id column as a long) that says which rows are queries;
    candidates are all rows but the query's own. Returns query_id, rank (from 1), vec_id, score.

    Rows with a null id or vector, or with a null or non-finite component, take no part. Vectors are
    compared with those of their own length only. Repeated rows are rows of their own: each is a
    query or candidate. Other columns are ignored; an empty table gives no rows. A squared norm
    of 2**61 or more after scaling raises an error, as scores might not fit a long.
    """
    spark = rows.sparkSession
    base, _ = write_table(integer_vectors(rows, id_col, vector_col, scale), "vectors")
    asked = base.where(F.expr(queries))
    order = Window.partitionBy("dim", "v").orderBy("id", "row_id")
    few = base.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)  # limited before the shuffle too
    entries = few.groupBy("dim", "v").agg(F.sort_array(F.collect_list(F.struct("id", "row_id"))).alias("who"))
    entries = entries.select("dim", F.col("who.id").alias("id_list"), F.col("who.row_id").alias("row_list"), "v")
    entries, _ = write_table(entries, "entries")
    largest = base.agg(F.max("norm2")).first()[0] or 0
    sample = entries.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(ROUTES).collect()
    routes: dict[int, list[bytes]] = {}
    for r in sample:
        routes.setdefault(r["dim"], []).append(bytes(r["v"]))
    routes = {dim: _matrix(vs, dim) for dim, vs in routes.items()}
    place = ["dim", "route", "dist", "v"]
    placed = _routed(entries, routes, largest).repartitionByRange(parallel(spark), *place).sortWithinPartitions(*place)

    def to_trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, got in _pages(batches, TREE_ROWS):
            fields, at = Tree.build(_matrix([r[2] for r in got], dim), largest)
            root, radius = fields[2][: 8 * (dim + 1)], float(np.frombuffer(fields[3], "<f8")[0])
            yield record_batch(_TREE, [[root], [radius], *([f] for f in fields), [[got[i][0] for i in at]], [[got[i][1] for i in at]]])

    trees, _ = write_table(placed.mapInArrow(to_trees, _TREE_DDL).withColumn("tree", F.monotonically_increasing_id()), "trees")
    if trees.select("tree").limit(1).count() == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q_dim", pa.int32()), ("q", pa.binary()), ("n_q", pa.int32())])
        for dim, got in _pages(batches, BLOCK_QUERIES):
            yield record_batch(schema, [[dim], [b"".join(r[2] for r in got)], [len(got)]])

    asked_entries = entries.join(asked.select("dim", "v").distinct(), ["dim", "v"], "left_semi").select(*entries.columns)
    near = _routed(asked_entries, routes, largest).repartitionByRange(parallel(spark), *place).sortWithinPartitions(*place)
    blocks = near.mapInArrow(to_blocks, "q_dim int, q binary, n_q int").withColumn("block", F.monotonically_increasing_id())
    blocks, _ = write_table(blocks, "queries")
    with_pages = _directory(trees)
    lists_of = pa.schema([("block", pa.int64()), ("tree", pa.int64()), ("q_nos", pa.list_(pa.int32()))])

    def to_nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("q_no", pa.int32()), ("tree", pa.int64()), ("d", pa.float64())])
        for block, q, n_q, dim, ids, roots, _ in _rows(batches):
            d = Best(_ints(q, n_q, dim), largest, k + 1).root_distances(np.frombuffer(roots, "<f8").reshape(len(ids), dim + 1))
            at = d.argmin(1)
            yield record_batch(schema, [pa.array(np.full(n_q, block)), pa.array(np.arange(n_q, dtype=np.int32)), pa.array(np.array(ids)[at]), pa.array(d[np.arange(n_q), at])])

    nearest = with_pages(blocks, ["block", "q", "n_q"]).mapInArrow(to_nearest, "block long, q_no int, tree long, d double")
    nearest = nearest.groupBy("block", "q_no").agg(F.min(F.struct("d", "tree"))["tree"].alias("tree"))
    nearest, _ = write_table(nearest, "nearest-trees")

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, q, n_q, known, q_nos, ids, row_ids, *fields in _rows(batches):
            best = Best(_ints(q, n_q, fields[0])[q_nos], largest, k + 1, _known(known, n_q)[0][q_nos])
            search(Tree(*fields), best, np.array([x[0] for x in ids], np.int64), list(zip(ids, row_ids, strict=True)))
            yield _found(best, block, q_nos)

    def visited(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        """What the queries of blocks find in the trees they are paired with (block, tree, q_nos)."""
        both = pairs.join(blocks, "block").hint("merge").join(trees.hint("merge"), "tree")
        return both.select("block", "q", "n_q", "known", "q_nos", "ids", "rows", *(n for n, _ in Tree.FIELDS)).mapInArrow(visit, _FOUND_DDL)

    pairs = nearest.groupBy("block", "tree").agg(F.collect_list("q_no").alias("q_nos"))  # at most those of a block
    near_found, _ = write_table(visited(pairs, blocks.withColumn("known", F.lit(None).cast("array<struct<q_no:int,kth:long,tree:long>>"))), "found-nearest")
    kth = near_found.groupBy("block", "q_no").agg(F.when(F.count("*") > k, F.min("score")).alias("kth"))
    known = nearest.join(kth, ["block", "q_no"]).groupBy("block").agg(F.collect_list(F.struct("q_no", "kth", "tree")).alias("known"))
    blocks, _ = write_table(blocks.join(known, "block"), "reaches")

    def to_needed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, q, n_q, known, dim, ids, roots, radii in _rows(batches):
            kths, seen = _known(known, n_q)
            best = Best(_ints(q, n_q, dim), largest, k + 1, kths)
            need = best.needed(np.frombuffer(roots, "<f8").reshape(len(ids), dim + 1), np.array(radii)) & (np.array(ids)[None, :] != seen[:, None])
            at = np.flatnonzero(need.any(0))
            yield record_batch(lists_of, [[block] * len(at), [ids[t] for t in at], [np.flatnonzero(need[:, t]).tolist() for t in at]])

    pairs = with_pages(blocks, ["block", "q", "n_q", "known"]).mapInArrow(to_needed, "block long, tree long, q_nos array<int>")
    pairs, _ = write_table(pairs, "visits")
    found = near_found.union(visited(pairs, blocks)).select("v", "score", "ids", "rows")
    first = Window.partitionBy("v").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    each = F.transform(F.arrays_zip("ids", "rows"), lambda x: F.struct((-F.col("score")).alias("worse"), x["ids"].alias("id"), x["rows"].alias("row_id")))
    lists = found.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list(each))), 1, k + 1).alias("top"))
    results = asked.select("id", "row_id", "v").join(lists, "v")
    others = F.slice(F.filter("top", lambda x: x["row_id"] != F.col("row_id")), 1, k)
    out = results.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.worse")).alias("score"))


_FOUND = pa.schema([("block", pa.int64()), ("q_no", pa.int32()), ("v", pa.binary()), ("score", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])
_FOUND_DDL = "block long, q_no int, v binary, score long, ids array<long>, rows array<long>"


def _found(best: Best, block: int, q_nos: list[int]) -> pa.RecordBatch:
    rows = [(block, q_nos[q], best.queries[q].tobytes(), -worse, ids, row_ids) for q, got in enumerate(best.found) for worse, _, (ids, row_ids) in got]
    return record_batch(_FOUND, list(zip(*rows, strict=True)) if rows else [[]] * 6)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """Values of one row after another."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def _ints(q: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(q, "<i4").reshape(n, dim)


def _known(known: list[dict] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores that the results of each query reach, and the tree it has seen."""
    kth, seen = np.full(n, NONE), np.full(n, -1)
    for x in known or []:
        kth[x["q_no"]] = NONE if x["kth"] is None else x["kth"]
        seen[x["q_no"]] = x["tree"]
    return kth, seen


def _directory(trees: DataFrame) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Writes the roots of the trees in pages, and returns a join of blocks of queries (columns given)
    with the pages of their dim: it adds dim, trees, roots, radii. All pages are broadcast only where
    the roots have at most ``BROADCAST_BYTES``; beyond, each page gets the blocks by a shuffle."""
    n, size = trees.agg(F.count("*"), F.sum(8 * (F.col("dim") + 3))).first()
    schema = pa.schema([("dim", pa.int32()), ("trees", pa.list_(pa.int64())), ("roots", pa.binary()), ("radii", pa.list_(pa.float64()))])

    def to_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[tuple]] = {}
            for dim, *row in zip(*columns(batch, "dim", "tree", "root", "root_radius"), strict=True):
                held.setdefault(dim, []).append(row)
            for dim, got in held.items():
                for i in range(0, len(got), DIRECTORY_ROWS):
                    ids, roots, radii = zip(*got[i : i + DIRECTORY_ROWS], strict=True)
                    yield record_batch(schema, [[dim], [ids], [b"".join(roots)], [radii]])

    pages = trees.select("dim", "tree", "root", "root_radius").repartitionByRange(n // DIRECTORY_ROWS + 1, "dim", "tree")
    pages = pages.mapInArrow(to_pages, "dim int, trees array<long>, roots binary, radii array<double>").withColumn("page", F.monotonically_increasing_id())
    pages, _ = write_table(pages, "directory")

    def join(blocks: DataFrame, names: list[str]) -> DataFrame:
        wanted = blocks.select(*names, "q_dim")
        if size <= BROADCAST_BYTES:
            both = wanted.join(F.broadcast(pages), wanted["q_dim"] == pages["dim"])
        else:
            numbers = F.broadcast(pages.select(F.col("dim").alias("q_dim"), "page"))  # 12 bytes for 4096 trees
            both = wanted.join(numbers, "q_dim").hint("merge").join(pages.hint("merge"), "page")
        return both.select(*names, "dim", "trees", "roots", "radii")

    return join

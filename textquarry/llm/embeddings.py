"""Near-duplicate embeddings by lattice hashing: random projections decoded to points of the E8 lattice, in several tables.

Each table projects a unit vector to 8 * ``LATTICES`` dimensions and decodes every 8 of them to the nearest point of E8; the points,
with the label, are the vector's cell. A vector is stored in its own cell and looks into that and the ``PROBES`` next nearest cells of each table.
All that meet in a cell with cosine >= ``threshold`` (double precision, on whole vectors) are linked.

Vectors that are equal, with equal labels, are one node that counts as many times as it occurs. A cell's work is dealt in blocks of at most ``BLOCK``
stored by ``BLOCK`` looking nodes, so no cell is capped and none lies in one task; many small blocks share a task's group of about ``GROUP_ROWS`` rows.
First the blocks are searched with components rounded to a byte, which can only find too much: what that leaves out can't reach the threshold. Only nodes
that are left in a block travel to it with their whole vectors. A pair that meets several times is counted where it meets first (by table,
then the smaller id looking), which a task can tell from the two vectors; so tasks return counts and a spanning forest, never all pairs.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with nothing and are components of their own.
Labels are compared as text, in full. Vectors of different lengths never meet. Rows that share a vec_id are vectors of their own with one component id. Null ids: component_id is the smallest
id reachable, null if there is none. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, table, written
from .components import components
from .minhash import U, mix

THRESHOLD = 0.93
TABLES, LATTICES, SCALE, PROBES = 6, 2, 0.34, 4
BLOCK = 1024
GROUP_ROWS = 20_000
AT_ONCE = 100_000  # pairs
SEED = 20


def e8_points(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n <= 8 nearest points of E8 (as doubled integers) of each row of 8, nearest first, and their squared distances.

    E8 is D8 and D8 moved by a half: in either, rounding gives a point of the right parity or one coordinate more must go the other way;
    next nearest points move one or two of the coordinates whose rounding was least certain.
    """
    points, costs = [], []
    for move in (0.0, 0.5):
        r = np.round(x - move)
        err = x - move - r
        order = np.argsort(-np.abs(err), 1)[:, :3]  # the least certain coordinates
        price = 1 - 2 * np.abs(np.take_along_axis(err, order, 1))
        step = np.where(err >= 0, 1, -1)
        odd = r.sum(1) % 2 != 0
        base = (err**2).sum(1)
        for even_set, odd_set in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,)), ((1, 2), (0, 1, 2))):
            p, cost = r.copy(), base.copy()
            for chosen, rows in ((even_set, ~odd), (odd_set, odd)):
                at = np.flatnonzero(rows)
                for c in chosen:
                    k = order[at, c]
                    p[at, k] += step[at, k]
                    cost[at] += price[at, c]
            points.append((2 * (p + move)).astype(np.int64))
            costs.append(cost)
    points, costs = np.stack(points, 1), np.stack(costs, 1)
    near = np.argsort(costs, 1, kind="stable")[:, :n]
    return np.take_along_axis(points, near[:, :, None], 1), np.take_along_axis(costs, near, 1)


def _projection(dims: int, t: int) -> np.ndarray:
    g = np.random.Generator(np.random.PCG64([SEED, dims, t])).standard_normal((dims, 8 * LATTICES))
    return np.linalg.qr(g)[0] if dims >= 8 * LATTICES else g / np.sqrt(dims)


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """[vectors, TABLES, 1 + PROBES] cell keys, the own cell first. ``unit``: unit vectors of one length; ``label``: numbers made of the labels."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        y = unit @ _projection(unit.shape[1], t) * (np.sqrt(unit.shape[1] / 64) / SCALE)
        n = 3 if LATTICES > 1 else 1 + PROBES
        points, costs = zip(*(e8_points(y[:, 8 * k : 8 * k + 8], n) for k in range(LATTICES)), strict=True)
        # cells: a choice of point in each lattice; the least total distance first
        choice = np.stack(np.meshgrid(*[np.arange(n)] * LATTICES, indexing="ij"), -1).reshape(-1, LATTICES)
        total = sum(costs[k][:, choice[:, k]] for k in range(LATTICES))
        best = np.argsort(total, 1, kind="stable")[:, : 1 + PROBES]
        h = mix(label.astype(U) * U(0x9E3779B97F4A7C15) + U(t * 1000 + unit.shape[1] * 100_000))[:, None]
        h = np.broadcast_to(h, best.shape).copy()
        for k in range(LATTICES):
            p = np.take_along_axis(points[k], choice[best, k][:, :, None], 1)
            for j in range(8):
                h = mix(h * U(3) + p[:, :, j].astype(U) + U(0x94D049BB133111EB))
        out[:, t] = h.view(np.int64)
    return out


def _matrix(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _usable(v: list | None) -> bytes | None:
    """The components as doubles, or None."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    n = np.linalg.norm(x)
    return x.tobytes() if np.isfinite(x).all() and np.isfinite(n) and n > 0 else None


def vectors(df: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """A row a row: id, label (text), mark (a hash of it), digest (of label and components; null if it can link with nothing), dims, x (components as doubles)."""
    bounded_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            labels = [None if k is None else k.encode() for k in b.column("label").to_pylist()]
            x = [_usable(v) if k is not None else None for v, k in zip(b.column("v").to_pylist(), labels, strict=True)]
            mark = [None if k is None else int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in labels]
            digest = [hashlib.blake2b(len(k).to_bytes(8, "little") + k + v, digest_size=16).hexdigest() if v else None for v, k in zip(x, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(mark, pa.int64()), pa.array(digest, pa.string()), pa.array([len(v) // 8 if v else None for v in x], pa.int32()), pa.array(x, pa.binary())], ["id", "label", "mark", "digest", "dims", "x"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).alias("v")).mapInArrow(run, "id bigint, label string, mark bigint, digest string, dims int, x binary")


def _rough(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors with components rounded to 1/127 of the largest one, as bytes, and that scale; a row each."""
    scale = np.abs(unit).max(1) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale


def _pairs(block: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(looking rows, stored rows, whole): all pairs of large blocks (every looking with every stored row), and the pairs of small blocks row by row."""
    order = np.lexsort((own, block))
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    looks, stores, held = [], [], 0
    for part in np.split(order, cuts):
        n = int(own[part].sum())
        q, s = part[: len(part) - n], part[len(part) - n :]
        if not len(q) or not len(s):
            continue
        if len(q) * len(s) > AT_ONCE // 10:
            yield q, s, True
            continue
        looks.append(np.repeat(q, len(s)))
        stores.append(np.tile(s, len(q)))
        held += len(q) * len(s)
        if held > AT_ONCE:
            yield np.concatenate(looks), np.concatenate(stores), False
            looks, stores, held = [], [], 0
    if held:
        yield np.concatenate(looks), np.concatenate(stores), False


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each one's component, for local links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def link_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """A row a row of ``df``: id, n_links, component_id, kept."""
    rows = written(vectors(df, id_col, vec, label), "vectors")
    classes = written(rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    # a node's number: the least id of its copies, or a hash where no copy has an id; ids that two nodes share are told apart by the hash, too
    shared = classes.groupBy("least").agg(F.count("*").alias("uses")).filter("uses > 1 or least is null").select(F.col("least").alias("l"))
    number = F.when(F.col("l").isNotNull() | F.col("least").isNull(), F.xxhash64("digest")).otherwise(F.col("least"))
    classes = written(classes.join(shared, F.col("least") == F.col("l"), "left").select("digest", "copies", "least", number.alias("node")), "classes")
    nodes = written(rows.join(classes, "digest").groupBy("node").agg(F.min("label").alias("label"), F.min("mark").alias("mark"), F.min("dims").alias("dims"), F.min("x").alias("x"), F.min("copies").alias("copies")), "nodes")

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                keys = cells(_matrix(part.column("x").to_pylist()), part.column("mark").to_numpy())
                n, per = len(keys), TABLES * (1 + PROBES)
                node, t = np.repeat(part.column("node").to_numpy(), per), np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)
                own = np.tile(np.arange(1 + PROBES) == 0, n * TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(t), pa.array(keys.ravel()), pa.array(own)], ["node", "t", "cell", "own"])

    def shrink(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                rough, scale = _rough(_matrix(part.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([r.tobytes() for r in rough], pa.binary()), pa.array(scale)], ["node", "rough", "scale"])

    looks = written(nodes.select("node", "mark", "dims", "x").mapInArrow(place, "node bigint, t int, cell bigint, own boolean"), "looks")
    sizes = looks.groupBy("cell").agg(F.count_if("own").alias("stored"), F.count("*").alias("looking")).filter("stored > 0 and looking > 1")
    met = looks.join(written(sizes, "cells"), "cell")
    n_stored, n_looking = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("stored", "looking"))
    spread = F.xxhash64("node")
    # stored nodes go to every block of looking ones, looking ones to every block of stored ones
    stored = met.filter("own").select("cell", "t", "node", F.lit(True).alias("own"), F.pmod(spread, n_stored).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_looking - 1)).alias("j"))
    looking = met.select("cell", "t", "node", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), n_stored - 1)).alias("i"), F.pmod(spread, n_looking).cast("int").alias("j"))
    dealt = written(stored.union(looking).select("node", "t", "own", F.xxhash64("cell", "i", "j").alias("block")), "blocks")
    groups = F.pmod("block", F.lit(dealt.count() // GROUP_ROWS + 1)).alias("part")
    rough = written(nodes.select("node", "dims", "x").mapInArrow(shrink, "node bigint, rough binary, scale double"), "rough")

    def sift(key, tab):
        """The rows of a block that may link with any other of it."""
        own, node, block = (tab.column(c).to_numpy() for c in ("own", "node", "block"))
        sizes = np.array([len(x) for x in tab.column("rough").to_pylist()])
        scale, keep = tab.column("scale").to_numpy(), np.zeros(len(node), bool)
        for d in np.unique(sizes):
            of = np.flatnonzero(sizes == d)
            x = np.frombuffer(b"".join(tab.column("rough").take(pa.array(of)).to_pylist()), np.int8).reshape(-1, d).astype(np.float32) * scale[of, None].astype(np.float32)
            # a component is off by half a scale at most, a vector by half a scale times sqrt(d)
            off = 0.5 * np.sqrt(d) * scale[of] + 1e-5
            for q, s, whole in _pairs(block[of], own[of]):
                if whole:
                    dots, slack = x[q] @ x[s].T, off[q][:, None] * (1 + off[s]) + off[s]
                    ok = (dots >= threshold - slack) & (node[of[q]][:, None] != node[of[s]])
                    keep[of[q[ok.any(1)]]] = keep[of[s[ok.any(0)]]] = True
                else:
                    ok = (np.einsum("ij,ij->i", x[q], x[s]) >= threshold - off[q] * (1 + off[s]) - off[s]) & (node[of[q]] != node[of[s]])
                    keep[of[q[ok]]] = keep[of[s[ok]]] = True
        return tab.select(["node", "t", "own", "block"]).filter(pa.array(keep))

    left = written(dealt.join(rough, "node").select("node", "t", "own", "block", "rough", "scale", groups).groupBy("part").applyInArrow(sift, "node bigint, t int, own boolean, block bigint"), "left")
    groups = F.pmod("block", F.lit(left.count() // GROUP_ROWS + 1)).alias("part")
    full = left.join(nodes, "node").select("node", "t", "own", "block", "label", "mark", "x", "copies", groups)

    def link(key, tab):
        own, node, block, t, mark, copies = (tab.column(c).to_numpy() for c in ("own", "node", "block", "t", "mark", "copies"))
        label = tab.column("label").to_numpy(zero_copy_only=False)
        blobs = tab.column("x").to_pylist()
        sizes = np.array([len(x) for x in blobs])
        ids, at = np.unique(node, return_inverse=True)
        links, roots_a, roots_b = np.zeros(len(ids), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in np.unique(sizes):
            of = np.flatnonzero(sizes == d)
            x = _matrix([blobs[k] for k in of.tolist()])
            for q, s, whole in _pairs(block[of], own[of]):
                if whole:
                    qi, si = np.nonzero(x[q] @ x[s].T >= threshold - 1e-9)
                    q, s = q[qi], s[si]
                for lo in range(0, len(q), AT_ONCE):
                    a, b = q[lo : lo + AT_ONCE], s[lo : lo + AT_ONCE]
                    ok = (np.einsum("ij,ij->i", x[a], x[b]) >= threshold) & (node[of[a]] != node[of[b]]) & (label[of[a]] == label[of[b]])
                    a, b = a[ok], b[ok]
                    if not len(a):
                        continue
                    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                    keys = cells(x[used], mark[of[used]])
                    first = np.zeros(len(a), bool)
                    for k in range(0, len(a), 20_000):
                        part = slice(k, k + 20_000)
                        p, r = keys[back[: len(a)][part]], keys[back[len(a) :][part]]
                        ab, ba = (p == r[:, :, :1]).any(2), (r == p[:, :, :1]).any(2)  # a looks into b's own cell, b into a's
                        at_t, row = np.argmax(ab | ba, 1), np.arange(len(p))
                        both = ab[row, at_t] & ba[row, at_t]
                        first[part] = (at_t == t[of[a[part]]]) & ab[row, at_t] & (~both | (node[of[a[part]]] < node[of[b[part]]]))
                    na, nb = at[of[a]], at[of[b]]
                    np.add.at(links, na[first], copies[of[b[first]]])
                    np.add.at(links, nb[first], copies[of[a[first]]])
                    roots_a.append(na)
                    roots_b.append(nb)
        root = _forest(np.concatenate(roots_a), np.concatenate(roots_b), len(ids))
        some = np.unique(np.concatenate([*roots_a, *roots_b]))
        return pa.table({"node": ids[some], "links": links[some], "root": ids[root[some]]})

    found = written(full.groupBy("part").applyInArrow(link, "node bigint, links bigint, root bigint"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_digest = classes.join(named.select("node", "component"), "node").join(least, "component").join(counts, "node", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "digest").join(of_digest, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE = """
with recursive v as (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e
  from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
links as (select a.rid as a, b.rid as b from ok a join ok b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select rid, rid from v union select reach.a, links.b from reach join links on reach.b = links.a),
comp as (select reach.a as rid, min(v.vec_id) as component_id from reach join v on v.rid = reach.b group by reach.a),
n as (select a as rid, count(*) as n_links from links group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from v join comp using (rid) left join n using (rid)
"""

"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors by the concatenated signs of random projections, a number for each vector and pass,
and compares each with a bounded window of neighbours in that order; the verified pairs of all passes together
give components. The number of passes follows from the rows, so that a pair at the threshold is expected to meet.

What would overfill windows is taken out first, without losing a link. Equal vectors are one class. In the first
passes, vectors close to one that leads become its ball: while all lie within half the threshold's angle of the leader,
all of a ball link with each other by the triangle inequality, and its leader stands for it from then on. A hot group of
near copies thus is a few balls, and its links are counted, not listed. Two balls that are near are linked whole where
angle and radii prove it, apart where these rule it out, and else compared member by member.

Windows bound what a pass finds, so links are counted exactly within components: every leader of one is compared with
all others of it, in blocks, with counts alone as the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import labels
from .shared import discard, few_enough, small_batches, tidy, written
from .vectors import by_size, element_type, finite, packed, units

#: Vectors after each one that a pass compares it with.
WINDOW = 128
#: Chance, at least, that a pair right at the threshold meets in a window of some pass.
RECALL = 0.98
#: Passes that gather balls, before those that find pairs.
GATHERINGS = 3
#: Signs of projections in a key.
BITS = 62
#: Taken off angles for rounding, in radians.
SLACK = 1e-6
#: Vectors of a block where components and balls are compared whole.
BLOCK = 1024
#: Rows that one matrix product takes.
CHUNK = 256


def passes_for(rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with the chance `recall`: it does in a pass where its first
    log2(rows / window) signs agree, each of which does with 1 - angle / pi."""
    signs = max(0.0, math.log2(max(rows, 1) / window))
    met = (1 - math.acos(threshold) / math.pi) ** signs
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def projection_keys(unit: np.ndarray, number: int) -> np.ndarray:
    """The signs of BITS random projections as one number, the first projection's as the highest."""
    d = unit.shape[1]
    planes = np.random.default_rng([d, number]).standard_normal((d, BITS))
    return ((unit @ planes) > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


class _Vectors:
    """Bytes of a batch's vectors as unit rows."""

    def __init__(self, kind: str):
        self.kind = "<f4" if kind == "float" else "<f8"

    def units(self, column: pa.Array) -> np.ndarray:
        """Of a column whose vectors have one length."""
        return units(np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), -1))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def classes(embeddings: DataFrame) -> DataFrame:
    """cid, h1, h2, rows, first, embedding of each distinct vector that can link, as a written table.

    A vector is known by two 64-bit hashes of its entries; first is its least vec_id.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", *_hashes())
    rows = rows.filter(finite("embedding") & F.exists("embedding", lambda e: e != 0))
    each = rows.groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding"))
    return written(each.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def _hashes() -> list:
    entries = F.transform("embedding", lambda e: e.cast("double") + F.lit(0.0))  # 0 and -0 alike
    return [F.xxhash64(entries).alias("h1"), F.xxhash64(F.lit("second"), entries).alias("h2")]


def keyed(each: DataFrame, kind: str, number: int) -> DataFrame:
    """id, weight, radius, size, keys, vector of the classes, as a written table: a key for each pass."""
    names = ["id", "weight", "radius", "size", "keys", "vector"]

    def work(batches):
        for batch in batches:
            for rows, matrix in by_size(batch.column(2)) if batch.num_rows else ():
                unit, at = units(matrix), pa.array(rows)
                keys = np.stack([projection_keys(unit, p) for p in range(number)], axis=1)
                listed = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * number, keys.reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.zeros(len(rows))), pa.array(np.full(len(rows), matrix.shape[1], np.int32)), listed, packed(matrix.astype("<f4" if kind == "float" else "<f8"))], names=names)

    return written(each.select("cid", "rows", "embedding").mapInArrow(tidy(work), "id long, weight long, radius double, size int, keys array<bigint>, vector binary"), "vector-keys")


def _ordered(vectors: DataFrame, number: int) -> DataFrame:
    """In the order of a pass, dealt over tasks by ranges; ids part equal keys, so that no key fills one task."""
    rows = vectors.withColumn("key", F.get("keys", F.lit(number)))
    return rows.repartitionByRange("size", "key", "id").sortWithinPartitions("size", "key", "id")


def gathered(vectors: DataFrame, kind: str, number: int, limit: float, window: int) -> tuple[DataFrame, DataFrame]:
    """The vectors that lead after a pass, with radius and weight of their balls, and (child, parent) of the others.

    A vector joins the nearest of the last `window` leaders of its task if its ball stays within `limit` of that leader.
    """
    names = ["id", "weight", "radius", "size", "keys", "vector", "parent"]
    read = _Vectors(kind)

    def work(batches):
        lead: list[list] = []  # [id, weight, radius, keys, vector] of the last leaders
        unit = np.zeros((0, 0))

        def out(rows: list[list], size: int):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([size] * len(rows), pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] if len(r) > 5 else None for r in rows], pa.int64())], names=names)

        for batch in batches:
            for begin, end, x in _runs(batch, 3, 5, read):
                d = x.shape[1]
                if lead and unit.shape[1] != d:
                    yield out(lead, unit.shape[1])
                    lead = []
                if not lead:
                    unit = np.zeros((0, d))
                ids, weights, radii = (batch.column(i).slice(begin, end - begin).to_pylist() for i in (0, 1, 2))
                keys, vectors = (batch.column(i).slice(begin, end - begin) for i in (4, 5))
                before = len(lead)
                near = np.concatenate([x @ unit.T, x @ x.T], axis=1)
                can = near >= math.cos(limit)
                can[:, before:] = np.tril(can[:, before:], -1)
                some, children = can.any(axis=1), []
                place: list[int] = list(range(before))  # column of each leader in `near`
                for i in range(len(x)):
                    if some[i]:
                        angle = _angle(near[i, place[-window:]]) + radii[i]
                        k = int(angle.argmin()) + max(0, len(place) - window) if len(angle) else -1
                        if k >= 0 and angle[k - max(0, len(place) - window)] <= limit:
                            lead[k][1] += weights[i]
                            lead[k][2] = max(lead[k][2], float(angle[k - max(0, len(place) - window)]))
                            children.append([ids[i], weights[i], radii[i], None, None, lead[k][0]])
                            continue
                    lead.append([ids[i], weights[i], radii[i], keys[i].as_py(), vectors[i].as_py()])
                    place.append(before + i)
                unit = np.concatenate([unit, x])[place]
                done, lead, unit = lead[:-window], lead[-window:], unit[-window:]
                if done or children:
                    yield out(done + children, d)
        if lead:
            yield out(lead, unit.shape[1])

    made = written(_ordered(vectors, number).select("id", "weight", "radius", "size", "keys", "vector").mapInArrow(tidy(work), "id long, weight long, radius double, size int, keys array<bigint>, vector binary, parent long"), "balls")
    left = made.filter("parent IS NULL").drop("parent")
    left.__dict__.update(_written_to=made.__dict__.get("_written_to"))
    return left, made.filter("parent IS NOT NULL").select(F.col("id").alias("child"), "parent")


def _runs(batch, size: int, vector: int, read: _Vectors):
    """(begin, end, unit rows) of at most CHUNK rows of one length each; rows of one length stand together."""
    sizes = batch.column(size).to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [len(sizes)]]) if len(sizes) else []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        for begin in range(int(low), int(high), CHUNK):
            end = min(begin + CHUNK, int(high))
            yield begin, end, read.units(batch.column(vector).slice(begin, end - begin))


def _near(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of the pairs of rows that are or may be linked; radii are those of their balls."""
    cosine = x @ y.T
    reach = theta + float(rx.max(initial=0)) + float(ry.max(initial=0))
    i, j = np.nonzero(cosine >= math.cos(min(math.pi, reach + SLACK)))
    found, both = cosine[i, j], rx[i] + ry[j]
    single = both == 0
    angle = _angle(found)
    sure = np.where(single, found >= math.cos(theta), angle + both <= theta - SLACK)
    may = np.where(single, sure, angle - both <= theta + SLACK)
    return i[may], j[may], sure[may]


def window_pairs(vectors: DataFrame, kind: str, number: int, theta: float, window: int) -> DataFrame:
    """(a, b, sure) of one pass: pairs at most `window` places apart that are linked (sure), or may be as balls.

    Tasks compare what they hold, and hand on their first and last rows; with the tasks' row counts, one number each, these
    get their places in the whole order and are compared across tasks, however many lie within a window.
    """
    read = _Vectors(kind)
    names = ["a", "b", "sure", "task", "place", "total", "radius", "size", "vector"]
    pairs_schema = "a long, b long, sure boolean"

    def pairs(ids, at, other_ids, x, y, rx, ry, px, py, tx=None, ty=None):
        i, j, sure = _near(x, y, rx, ry, theta)
        gap = py[j] - px[i]
        keep = (gap >= 1) & (gap <= window)
        if tx is not None:
            keep &= tx[i] != ty[j]
        return ids[i[keep]], other_ids[j[keep]], sure[keep]

    def edges(task, ids, place, total, radius, size, vector):
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids), none, pa.nulls(len(ids), pa.bool_()), pa.array(np.full(len(ids), task, np.int32)), pa.array(place), pa.array(total, pa.int64()), pa.array(radius), pa.array(size, pa.int32()), vector], names=names)

    def work(batches):
        task, seen = TaskContext.get().partitionId(), 0
        # the last rows, as ids, places, radii, unit rows, sizes and bytes
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None, np.zeros(0, np.int32), pa.array([], pa.binary()))
        for batch in batches:
            for begin, end, x in _runs(batch, 2, 3, read):
                part = batch.slice(begin, end - begin)
                ids, radius, size = (part.column(k).to_numpy() for k in (0, 1, 2))
                place = np.arange(seen, seen + len(ids))
                first = place < window
                if first.any():
                    yield edges(task, ids[first], place[first], [None] * int(first.sum()), radius[first], size[first], part.column(3).filter(pa.array(first)))
                same = held[3] is not None and held[3].shape[1] == x.shape[1]
                own = np.concatenate([held[0], ids]), np.concatenate([held[1], place]), np.concatenate([held[2], radius])
                y = np.concatenate([held[3], x]) if same else x
                k = len(own[0]) - len(y)
                a, b, sure = pairs(own[0][k:], None, ids, y, x, own[2][k:], radius, own[1][k:], place)
                if len(a):
                    n = len(a)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
                seen += len(ids)
                sizes, raw = np.concatenate([held[4], size]), pa.concat_arrays([held[5].cast(pa.binary()), part.column(3).cast(pa.binary())])
                last = max(0, len(own[0]) - window)
                held = own[0][last:], own[1][last:], own[2][last:], y[-window:] if len(y) > window else y, sizes[last:], raw.slice(last)
        if seen:
            yield edges(task, held[0], held[1], [seen] * len(held[0]), held[2], held[4], held[5])

    look = written(_ordered(vectors, number).select("id", "radius", "size", "vector").mapInArrow(tidy(work), "a long, b long, sure boolean, task int, place long, total long, radius double, size int, vector binary"), "pass")
    inside = look.filter("b IS NOT NULL").select("a", "b", "sure")
    totals = sorted((r["task"], r["total"]) for r in look.filter("total IS NOT NULL").groupBy("task").agg(F.max("total").alias("total")).collect())  # one number a task
    if len(totals) < 2:
        return inside
    before, starts = 0, []
    for task, total in totals:
        starts.append((task, before))
        before += total
    rows = look.filter("b IS NULL").groupBy("task", "place").agg(F.first("a").alias("id"), F.first("radius").alias("radius"), F.first("size").alias("size"), F.first("vector").alias("vector"))
    known = look.sparkSession.createDataFrame(starts, "task int, start long")
    rows = rows.join(F.broadcast(known), "task").withColumn("rank", F.col("start") + F.col("place"))
    width = 8 * window
    cut = F.floor(F.col("rank") / width)
    rows = rows.withColumn("part", F.explode(F.when(F.col("rank") % width < window, F.array(cut - 1, cut)).otherwise(F.array(cut))))

    def across(batches):
        for part in _grouped(batches, ["part"]):
            rank, task, ids, radius, sizes = (part.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            head = rank // width == part.column(0)[0].as_py()
            for d in np.unique(sizes):
                of = np.flatnonzero(sizes == d)
                x = read.units(part.column(6).take(pa.array(of)))
                left = np.flatnonzero(head[of])
                a, b, sure = pairs(ids[of][left], None, ids[of], x[left], x, radius[of][left], radius[of], rank[of][left], rank[of], task[of][left], task[of])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], names=["a", "b", "sure"])

    placed = rows.select("part", "rank", "task", "id", "radius", "size", "vector").repartition("part").sortWithinPartitions("part", "rank")
    out = inside.unionAll(placed.mapInArrow(tidy(across), pairs_schema))
    return out


def _grouped(batches, keys: list[str]):
    """One RecordBatch for each run of equal keys (the first columns)."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[low] for c in columns)
            if held and now != name:
                yield _joined(held)
                held = []
            name = now
            held.append(batch.slice(low, high - low))
    if held:
        yield _joined(held)


def _joined(parts: list) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _counts(groups: DataFrame, kind: str, theta: float) -> DataFrame:
    """(id, links, a, b) of groups (g1, g2, i, j, side, id, weight, radius, vector): what each vector of a side is linked with on
    the other side (of a group of side 0 alone: within), by weight; pairs (a, b) of balls that may be linked in part are rows of
    their own, with no links; so is (g1, g2) as (a, b, links 1) where anything in the group is linked."""
    read = _Vectors(kind)
    names = ["id", "links", "a", "b"]

    def work(batches):
        for part in _grouped(batches, ["g1", "g2", "i", "j"]):
            g1, g2 = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            right = part.column(4).to_numpy(zero_copy_only=False).astype(bool)
            ids, weight, radius = (part.column(k).to_numpy() for k in (5, 6, 7))
            x = read.units(part.column(8))
            left, other = np.flatnonzero(~right), np.flatnonzero(right)
            within = not len(other) and g1 == g2
            other = left if within else other
            if not len(left) or not len(other):
                continue
            i, j, sure = _near(x[left], x[other], radius[left], radius[other], theta)
            if within:
                keep = i < j
                i, j, sure = i[keep], j[keep], sure[keep]
            i, j = left[i], other[j]
            total = np.bincount(i[sure], weights=weight[j[sure]].astype(float), minlength=len(ids)) + np.bincount(j[sure], weights=weight[i[sure]].astype(float), minlength=len(ids))
            some, open_i, open_j = np.flatnonzero(total), i[~sure], j[~sure]
            n, m, any_link = len(some), len(open_i), int(bool(sure.any()))
            if n + m + any_link == 0:
                continue
            none = [None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[some].tolist(), *none * (m + any_link)], pa.int64()), pa.array([*total[some].astype(np.int64).tolist(), *none * m, *[1] * any_link], pa.int64()), pa.array([*none * n, *ids[open_i].tolist(), *[g1] * any_link], pa.int64()), pa.array([*none * n, *ids[open_j].tolist(), *[g2] * any_link], pa.int64())],
                names=names,
            )

    columns = ["g1", "g2", "i", "j", "side", "id", "weight", "radius", "vector"]
    placed = groups.select(*columns).repartition("g1", "g2", "i", "j").sortWithinPartitions("g1", "g2", "i", "j")
    return written(placed.mapInArrow(tidy(work), "id long, links long, a long, b long"), "counted")


def _blocks(rows: DataFrame, count: str) -> DataFrame:
    """rows with the number of blocks that so many rows take, and a row's own."""
    return rows.withColumn("nb", F.ceil(F.col(count) / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))


def _within(labelled: DataFrame, kind: str, theta: float) -> DataFrame:
    """_counts of all leaders (label, id, weight, radius, size, vector) of each component."""
    sizes = labelled.groupBy("label", "size").agg(F.count("*").alias("k"))
    rows = _blocks(labelled.join(sizes, ["label", "size"]), "k")
    every = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).alias("side")))
    rows = rows.withColumn("at", F.explode(every))
    return _counts(rows.select(F.col("label").alias("g1"), F.col("label").alias("g2"), F.col("at.i").alias("i"), F.col("at.j").alias("j"), "id", "weight", "radius", "vector", F.col("at.side").alias("side")), kind, theta)


def _members(pairs: DataFrame, members: DataFrame, kind: str, theta: float) -> DataFrame:
    """_counts of the members (root, id, weight, vector, k: their number in the ball) of each pair (a, b) of balls."""
    counted = members.groupBy("root").agg(F.count("*").alias("k"))
    both = pairs.join(counted.select(F.col("root").alias("a"), F.ceil(F.col("k") / BLOCK).cast("int").alias("na")), "a").join(counted.select(F.col("root").alias("b"), F.ceil(F.col("k") / BLOCK).cast("int").alias("nb")), "b")
    sides = []
    for side, own, mine, others in ((0, "a", "na", "nb"), (1, "b", "nb", "na")):
        rows = both.join(members.withColumnRenamed("root", own), own)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        i, j = ("block", "other") if side == 0 else ("other", "block")
        sides.append(rows.select(F.col("a").alias("g1"), F.col("b").alias("g2"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(bool(side)).alias("side"), "id", "weight", F.lit(0.0).alias("radius"), "vector"))
    return _counts(sides[0].unionAll(sides[1]), kind, theta)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings (vec_id, embedding); other columns aren't read.

    Rows link when the cosine of their vectors, in double precision, is `threshold` or more, none below it. n_links: other rows
    linked directly; component_id: the least vec_id that links reach; kept: whether a row's vec_id is that.
    Vectors that are null, empty, zero, or hold null or non-finite entries link with nothing, and vectors of different
    lengths don't link. Rows that repeat, or share a vec_id, are rows each. A component without any vec_id has a null one,
    and its rows are kept. No row gives no rows.
    """
    spark = embeddings.sparkSession
    small_batches(spark, rows=2048)
    kind, theta = element_type(embeddings, "embedding"), math.acos(threshold)
    each = classes(embeddings)
    most = GATHERINGS + passes_for(each.count(), threshold, window, recall)
    vectors = keyed(each, kind, most)

    slim = each.select("cid", "h1", "h2", "rows", "first", F.col("cid").alias("root"))
    leaders, maps = vectors, []
    for number in range(GATHERINGS):
        before = leaders
        leaders, children = gathered(leaders, kind, number, theta / 2 - SLACK, window)
        if before is not vectors:
            before.__dict__.pop("_written_to", None)  # children of that pass are read below
        maps.append(children)
    for children in maps:
        few = few_enough(children)
        found = slim.join(F.broadcast(children) if few else children, F.col("root") == F.col("child"), "left")
        slim = found.withColumn("root", F.coalesce("parent", "root")).drop("child", "parent")
    slim = written(slim, "vector-roots")

    n = leaders.count()
    looks = [window_pairs(leaders, kind, GATHERINGS + p, theta, window) for p in range(passes_for(n, threshold, window, recall))]
    pairs = looks[0]
    for more in looks[1:]:
        pairs = pairs.unionAll(more)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").filter("a <> b")
    pairs = written(pairs.groupBy("a", "b").agg(F.max("sure").alias("sure")), "vector-pairs")
    members = slim.select(F.col("cid").alias("id"), "root", F.col("rows").alias("weight")).join(vectors.select("id", "vector"), "id")

    def opened(some: DataFrame) -> DataFrame | None:
        """Member by member, where balls may be linked in part."""
        some = written(some.distinct(), "open-pairs")
        return None if some.isEmpty() else _members(some, members, kind, theta)

    links = pairs.filter("sure").select("a", "b")
    part = opened(pairs.filter("NOT sure").select("a", "b"))
    if part is not None:
        links = links.unionAll(part.filter("a IS NOT NULL").select("a", "b").distinct())
    found = labels(links)
    several = found.select(F.col("node").alias("id"), "label").unionAll(found.select(F.col("label").alias("id"), "label").distinct())
    several = written(several, "vector-components")
    counted = _within(leaders.join(F.broadcast(several) if few_enough(several) else several, "id"), kind, theta)
    part = opened(counted.filter("links IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    sums = lambda t: t.filter("id IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    whole = written(sums(counted).withColumnRenamed("id", "ball").withColumnRenamed("links", "ball_links"), "ball-links")
    ball = leaders.filter("weight > 1").select(F.col("id").alias("ball"), "weight")
    ball = written(ball.join(whole, "ball", "full_outer").select("ball", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("ball_links", F.lit(0))).alias("of_ball")), "balls-counted")
    label = several.select(F.col("id").alias("of_label"), "label")
    slim = slim.join(F.broadcast(ball) if few_enough(ball) else ball, F.col("root") == F.col("ball"), "left").join(F.broadcast(label) if few_enough(label) else label, F.col("root") == F.col("of_label"), "left")
    slim = slim.select("cid", "h1", "h2", "first", F.coalesce("label", "root").alias("label"), F.coalesce("of_ball", F.lit(0)).alias("links"))
    if part is not None:
        slim = slim.join(sums(part).withColumnsRenamed({"id": "member", "links": "more"}), F.col("cid") == F.col("member"), "left").withColumn("links", F.col("links") + F.coalesce("more", F.lit(0))).drop("member", "more")
    slim = written(slim.filter("links > 0"), "linked-vectors")
    least = slim.groupBy("label").agg(F.min("first").alias("component_id"))
    least = written(least, "least")
    linked = written(slim.join(F.broadcast(least) if few_enough(least) else least, "label").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "links", "component_id"), "linked")
    discard(leaders, vectors, pairs)

    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), *_hashes(), (finite("embedding") & F.exists("embedding", lambda e: e != 0)).alias("can"))
    out = rows.join(F.broadcast(linked) if few_enough(linked, 32) else linked, F.coalesce("can", F.lit(False)) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("k1").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length 1 in double precision, so cosine >= t is distance
<= sqrt(2 - 2 t). Equal vectors of a label are one row with a count (aggregated
before the shuffle). A label of more than BLOCK distinct vectors is dealt into cells
around at most PIVOTS centres, spread by farthest-first choice over a sample of at most
SAMPLE of its vectors (all labels' centres together at most MOST_PIVOTS; further labels
have one cell). The cells are the cover tree's top level: a cell's covering radius is
the largest distance of all its members, and two cells meet only if their centres are
no farther apart than both radii and the link distance. A cell of more than BLOCK
vectors is dealt into chunks by hash, and the chunks meet in pairs. So each task holds
two chunks at most, whatever a label's share of the rows.

In a task, each chunk becomes a tree of nested levels with halving radii. The dual
traversal drops a node pair when the centres are farther apart than both radii and the
link distance, takes it whole when even its farthest members must link, and compares
leaves exactly. Whole pairs add to the members' link counts and leave one connecting
edge per member; pairs of a large group of near copies are never written out.

A very tight group never reaches that: centres are first put where the sample is
dense, and the vectors within half the link distance of a centre are its core. A core's
vectors all link to each other, so their links are a sum. Any other vector is held
against the core as one node, by centre and covering radius: it links with none or with
all of it, or, in the narrow ring between, it is compared with its members in chunks.

Defined results: vectors that are null, zero or hold null or non-finite components, and vectors with a null label, link with nothing (0
links, own component). Vectors of different lengths never link. Repeated vec_ids keep
their rows; rows of one vec_id with different vectors are one node, whose links add up. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, components, cut, small_batches, table

THRESHOLD = 0.93
BLOCK = 2048
PIVOTS, SAMPLE, MOST_SAMPLED, MOST_PIVOTS = 16, 2000, 40_000, 8192
#: Bytes of the sampled vectors that the driver holds (at least 4 PIVOTS vectors of each label); they place centres and change no result.
SAMPLE_BYTES = 64 << 20
LEAF, FLAT, NET = 16, 256, 128
#: Distances of unit vectors come from products, whose rounding moves small ones by up to some 1e-8; bounds keep this clear of both limits.
SLACK = 1e-7


class Tree:
    """Nodes of nested levels: center (row), radius, rows as a slice of `order`, children as node numbers."""

    def __init__(self, x: np.ndarray):
        self.x, self.center, self.radius, self.low, self.high, self.children = x, [], [], [], [], []
        self.order = np.arange(len(x))
        gaps = self.gaps(0, self.order)
        self.add(0, gaps, 0, len(x))
        for node in self.walk():
            self.split(node)

    def gaps(self, c: int, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.x[c]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def add(self, c: int, gaps: np.ndarray, low: int, high: int) -> None:
        self.center.append(c)
        self.radius.append(float(gaps.max()))
        self.low.append(low)
        self.high.append(high)
        self.children.append([])

    def walk(self):
        i = 0
        while i < len(self.center):
            yield i
            i += 1

    def split(self, node: int) -> None:
        """Children: a net of half the radius over the node's rows; each row goes to the first net point near enough.

        Net points are tried in order, NET at a time: one product gives their distances to
        all rows that are left. A node of at most FLAT rows of which most would be children of
        their own stays a leaf.
        """
        low, high, radius = self.low[node], self.high[node], self.radius[node]
        if high - low <= LEAF or radius <= SLACK:
            return
        rows, at = self.order[low:high], low
        here = int(np.flatnonzero(rows == self.center[node])[0])
        rows = np.concatenate([rows[here : here + 1], rows[:here], rows[here + 1 :]])  # the node's own centre is the first
        out = []
        while len(rows):
            gaps = np.sqrt(np.maximum(0, 2 - 2 * (self.x[rows[:NET]] @ self.x[rows].T)))
            near, free = gaps <= radius / 2, np.ones(len(rows), bool)
            for k in range(len(near)):
                if free[k]:
                    own = near[k] & free
                    own[k] = True
                    free ^= own
                    pick = np.flatnonzero(own)
                    out.append((int(rows[k]), gaps[k, pick], rows[pick]))
            rows = rows[free]
        if high - low <= FLAT and 2 * len(out) > high - low:
            return
        for c, gap, own in out:
            self.order[at : at + len(own)] = own
            self.children[node].append(len(self.center))
            self.add(c, gap, at, at + len(own))
            at += len(own)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]


class Forest:
    """Union-find by smallest row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join_pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join i[k] with j[k]; only pairs of different trees are walked."""
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        a, b = self.up[i], self.up[j]
        for pair in np.unique(np.stack([a, b], axis=1)[a != b], axis=0):
            self.join(pair)

    def join(self, rows: np.ndarray) -> None:
        roots = {self.root(int(i)) for i in rows}
        least = min(roots)
        for r in roots:
            self.up[r] = least


def links(a: np.ndarray, b: np.ndarray | None, wa: np.ndarray, wb: np.ndarray | None, threshold: float):
    """(links of each row of a, of each row of b, forest over a then b); b None: pairs inside a. Weights count copies."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    n, same = len(a), b is None
    ta = Tree(a)
    tb = ta if same else Tree(b)
    wb = wa if same else wb
    ca = np.zeros(n, np.int64)
    cb = ca if same else np.zeros(len(b), np.int64)
    forest, shift = Forest(n if same else n + len(b)), 0 if same else n
    meta = lambda t: (np.array(t.center), np.array(t.radius))
    (pa_, ra), (pb_, rb) = meta(ta), meta(tb)
    todo = [(0, 0)]
    while todo:
        u, v = todo.pop()
        own = same and u == v
        if not own:
            d = ta.x[pa_[u]] - tb.x[pb_[v]]
            d = float(np.sqrt(d @ d))
            if d - ra[u] - rb[v] > reach + SLACK:
                continue
        else:
            d = 0.0
        i, j = ta.rows(u), tb.rows(v)
        if d + ra[u] + rb[v] <= reach - SLACK:  # all members link
            if own:
                ca[i] += wa[i].sum() - wa[i]
            else:
                ca[i] += wb[j].sum()
                cb[j] += wa[i].sum()
            if not own or len(i) > 1:
                forest.join(np.concatenate([i, j + shift]))
            continue
        kids_a, kids_b = ta.children[u], tb.children[v]
        if not kids_a and not kids_b:
            hit = ta.x[i] @ tb.x[j].T >= threshold
            if own:
                np.fill_diagonal(hit, False)
                ca[i] += hit @ wa[i]
            else:
                ca[i] += hit @ wb[j]
                cb[j] += wa[i] @ hit
            p, q = np.nonzero(hit)
            if len(p):
                forest.join_pairs(i[p], j[q] + shift)
            continue
        if own:
            kids_b = kids_a
        elif kids_a and kids_b:  # the wider node is opened; both if alike
            if ra[u] > 2 * rb[v]:
                kids_b = []
            elif rb[v] > 2 * ra[u]:
                kids_a = []
        left, right = np.array(kids_a or [u]), np.array(kids_b or [v])
        gap = np.sqrt(np.maximum(0, 2 - 2 * (ta.x[pa_[left]] @ tb.x[pb_[right]].T)))
        far = gap - ra[left][:, None] - rb[right][None, :] > reach + 1e-6  # coarse, as rows of length 1; the exact test follows
        if own:
            far |= np.tri(len(left), k=-1, dtype=bool)
        p, q = np.nonzero(~far)
        todo += zip(left[p].tolist(), right[q].tolist(), strict=True)
    return ca, cb, forest


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


def pivots(distinct: DataFrame, large: DataFrame, sizes: list, reach: float, block: int, sample: int = SAMPLE) -> dict:
    """Centres of each label that needs more than one cell: dense places of a bounded sample of it (by hash, about `sample` vectors, fewer for very many labels), then the farthest."""
    if not sizes:
        return {}
    widest = max(width for _, width, _ in sizes)
    share = max(4 * PIVOTS, min(sample, MOST_SAMPLED // len(sizes), SAMPLE_BYTES // (8 * widest * len(sizes))))
    own = distinct.withColumn("width", F.size("e")).join(F.broadcast(large), ["label", "width"])
    own = own.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 30)) < F.lit(float(share << 30)) / F.col("n"))
    got = own.select("label", "width", "e", F.xxhash64("rep").alias("o")).toArrow().combine_chunks()  # about share vectors of each label
    order, places = got.column("o").to_numpy(), {}
    for i, k in enumerate(zip(got.column("label").to_pylist(), got.column("width").to_pylist(), strict=True)):
        places.setdefault(k, []).append(i)
    out = {}
    for label, width, n in sizes:
        some = np.array(places.get((label, width), []), np.int64)
        some = some[np.argsort(order[some], kind="stable")][: 2 * share]
        if not len(some):
            continue
        x = matrix(got.column("e").take(pa.array(some)))
        many = min(PIVOTS, len(x), -(-n // block))
        near = 2 - 2 * (x @ x.T) <= (reach / 2) ** 2
        chosen, free = [], np.ones(len(x), bool)
        while len(chosen) < many // 2:  # dense places, while any holds a few hundredths of the sample
            count = near[:, free].sum(axis=1)
            best = int(np.argmax(count))
            if count[best] < max(3, 0.02 * len(x)):
                break
            chosen.append(best)
            free &= ~near[best]
        chosen = chosen or [0]
        gap = (2 - 2 * (x @ x[chosen].T)).min(axis=1)
        while len(chosen) < many:
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, 2 - 2 * (x @ x[chosen[-1]]))
        out[label, width] = x[chosen]
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    e = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), e.alias("e"))
    ok = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("e", fine) & F.exists("e", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("e", F.when(ok, F.col("e")))
    # -- equal vectors of a label are one row
    distinct = cut(rows.where("e is not null").groupBy("label", "e").agg(F.min("id").alias("rep"), F.count("*").alias("w")))
    large = distinct.groupBy("label", F.size("e").alias("width")).agg(F.count("*").alias("n")).where(F.col("n") > block).orderBy(F.desc("n"), "label").limit(MOST_PIVOTS // PIVOTS)
    large = cut(large)  # at most MOST_PIVOTS / PIVOTS rows
    centres = pivots(distinct, large, [(r["label"], r["width"], r["n"]) for r in large.collect()], reach, block)

    def to_cells(batches):
        for batch in batches:
            cells, gaps = [0] * batch.num_rows, [0.0] * batch.num_rows
            groups: dict = {}
            for i, (lab, vec) in enumerate(zip(batch.column("label").to_pylist(), batch.column("e").to_pylist(), strict=True)):
                if (lab, len(vec)) in centres:
                    groups.setdefault((lab, len(vec)), []).append((i, vec))
            for k, own in groups.items():
                g = unit([v for _, v in own]) @ centres[k].T
                for (i, _), c, d in zip(own, g.argmax(1).tolist(), np.sqrt(np.maximum(0, 2 - 2 * g.max(1))).tolist(), strict=True):
                    cells[i], gaps[i] = c, d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(gaps, pa.float64())], names=[*batch.schema.names, "cell", "gap"])

    def to_cores(batches):
        for batch in batches:
            rows_ = list(zip(batch.column("label").to_pylist(), batch.column("e").to_pylist(), batch.column("cell").to_pylist(), batch.column("core").to_pylist(), strict=True))
            whole, ring = [[] for _ in rows_], [[] for _ in rows_]
            groups: dict = {}
            for i, (lab, vec, _, _) in enumerate(rows_):
                groups.setdefault((lab, len(vec)), []).append(i)
            for k, own in groups.items():
                d = np.sqrt(np.maximum(0, 2 - 2 * (unit([rows_[i][1] for i in own]) @ centres[k].T)))
                for c, (number, radius) in cores_of.get(k, {}).items():
                    for i, far in zip(own, d[:, c].tolist(), strict=True):
                        _, _, cell, core = rows_[i]
                        if far > reach + radius + 1e-6 or core and cell <= c:  # cores meet once, and not themselves
                            continue
                        (whole if far <= reach - radius - 1e-6 else ring)[i].append(number)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("w"), batch.column("e"), pa.array(whole, pa.list_(pa.int32())), pa.array(ring, pa.list_(pa.int32()))], names=["rep", "w", "e", "whole", "ring"])

    kind = rows.schema["label"].dataType.simpleString()
    id_kind = rows.schema["id"].dataType.simpleString()
    base = f"label {kind}, e array<double>, rep {id_kind}, w long"
    cells = distinct.mapInArrow(to_cells, f"{base}, cell int, gap double") if centres else distinct.withColumn("cell", F.lit(0)).withColumn("gap", F.lit(0.0))
    core = F.lit(False)
    if centres:
        many = spark.createDataFrame([(*k, True) for k in centres], f"label {kind}, width int, many boolean")
        cells = cells.withColumn("width", F.size("e")).join(F.broadcast(many), ["label", "width"], "left")
        core = F.coalesce("many", F.lit(False)) & (F.col("gap") <= reach / 2 - 1e-6)
    cells = cut(cells.withColumn("width", F.size("e")).withColumn("core", core))
    found, blocks = [], []
    cores = cells.where("core").groupBy("label", "width", "cell").agg(F.sum("w").alias("all_w"), F.count("*").alias("n"), F.min("rep").alias("root"), F.max("gap").alias("radius")).collect() if centres else []  # at most MOST_PIVOTS rows
    if cores:
        cores_of: dict = {}
        for i, r in enumerate(cores):
            cores_of.setdefault((r["label"], r["width"]), {})[r["cell"]] = (i, r["radius"])
        known = F.broadcast(spark.createDataFrame([(r["label"], r["width"], r["cell"], i, r["all_w"], r["n"], r["root"]) for i, r in enumerate(cores)], f"label {kind}, width int, cell int, number int, all_w long, n long, root {id_kind}"))
        others = cells.where("many").select("label", "e", "rep", "w", "cell", "core")
        related = cut(others.mapInArrow(to_cores, f"rep {id_kind}, w long, e array<double>, whole array<int>, ring array<int>").where("size(whole) + size(ring) > 0"))
        whole = related.select("rep", "w", F.explode("whole").alias("number"))
        found.append(whole.join(known, "number").select("rep", F.col("all_w").alias("links"), "root"))
        gained = whole.groupBy("number").agg(F.sum("w").alias("gain"))
        members = cells.where("core").join(known, ["label", "width", "cell"])
        found.append(members.join(F.broadcast(gained), "number", "left").select("rep", (F.col("all_w") - F.col("w") + F.coalesce("gain", F.lit(0))).alias("links"), "root"))
        ring = related.select("rep", "w", "e", F.explode("ring").alias("number"))
        sizes = ring.groupBy("number").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
        deal = lambda k, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), k).cast("int")
        width_of = F.ceil(F.col("n") / block).cast("int")
        lefts = ring.join(F.broadcast(sizes), "number").join(known, "number").select("rep", "w", "e", "number", deal(F.col("k"), "ring").alias("i"), F.explode(F.sequence(F.lit(0), width_of - 1)).alias("j"))
        rights = members.join(F.broadcast(sizes), "number").select("rep", "w", "e", "number", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), deal(width_of, "core").alias("j"))
        for side, is_left in ((lefts, True), (rights, False)):
            blocks.append(side.select("rep", "w", "e", F.lit(is_left).alias("left"), F.concat_ws("/", F.lit("core"), "number", "i", "j").alias("block"), F.lit(False).alias("own")))
    cells = cells.where("not core")
    stats = cells.groupBy("label", "width", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    # -- which cells of a label meet: (cell, other cell, its chunks); labels of one cell meet themselves
    met = {}
    if centres:
        of = {(r["label"], r["width"], r["cell"]): (-(-r["n"] // block), r["radius"]) for r in stats.join(F.broadcast(spark.createDataFrame([(k[0], k[1]) for k in centres], f"label {kind}, width int")), ["label", "width"]).collect()}
        together: dict = {}
        for (lab, width, c), (chunks, radius) in of.items():
            together.setdefault((lab, width), []).append((c, chunks, radius))
        for lab, width, c, radius in [(*k, c, radius) for k, own in together.items() for c, _, radius in own]:
            x = centres[lab, width]
            for d, chunks, radius2 in together[lab, width]:
                if c == d or np.sqrt(max(0, 2 - 2 * float(x[c] @ x[d]))) - radius - radius2 <= reach + 1e-6:
                    met.setdefault((lab, width, c), []).append((d, chunks))
    table_ = [(lab, width, c, d, chunks) for (lab, width, c), own in met.items() for d, chunks in own]
    sized = cells.join(stats.select("label", "width", "cell", F.ceil(F.col("n") / block).cast("int").alias("k")), ["label", "width", "cell"])
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("k")).cast("int"))
    single = F.array(F.struct(F.col("cell").alias("cell2"), F.col("k").alias("k2")))
    if table_:
        meets = spark.createDataFrame(table_, f"label {kind}, width int, cell int, cell2 int, k2 int").groupBy("label", "width", "cell").agg(F.collect_list(F.struct("cell2", "k2")).alias("meets"))
        sized = sized.join(F.broadcast(meets), ["label", "width", "cell"], "left").withColumn("meets", F.coalesce("meets", single))
    else:
        sized = sized.withColumn("meets", single)
    others = F.flatten(F.transform("meets", lambda m: F.transform(F.sequence(F.lit(0), m["k2"] - 1), lambda c: F.struct(m["cell2"].alias("cell2"), c.alias("chunk2")))))
    me, you = F.struct("cell", "chunk"), F.struct(F.col("o.cell2").alias("cell"), F.col("o.chunk2").alias("chunk"))
    placed = sized.withColumn("o", F.explode(others)).select("rep", "w", "e", (me <= you).alias("left"), F.xxhash64("label", "width").alias("l"), F.least(me, you).alias("p"), F.greatest(me, you).alias("q"))
    placed = placed.select("rep", "w", "e", "left", F.concat_ws("/", "l", "p.cell", "p.chunk", "q.cell", "q.chunk").alias("block"), (F.col("p") == F.col("q")).alias("own"))

    for more in blocks:
        placed = placed.unionByName(more)

    def task(group: pa.Table):
        reps, w, left = (group.column(c).to_numpy() if c != "left" else group.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "w", "left"))
        x = matrix(group.column("e"))
        if group.column("own")[0].as_py():
            order = np.argsort(reps)
            reps = reps[order]
            count, _, forest = links(x[order], None, w[order], None, threshold)
        else:
            i, j = np.flatnonzero(left), np.flatnonzero(~left)
            if not len(i) or not len(j):
                return None
            i, j = i[np.argsort(reps[i])], j[np.argsort(reps[j])]
            ca, cb, forest = links(x[i], x[j], w[i], w[j], threshold)
            count, reps = np.concatenate([ca, cb]), np.concatenate([reps[i], reps[j]])
        some = np.flatnonzero(count)
        root = np.array([forest.root(int(k)) for k in some], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(count[some]), pa.array(reps[root]) if len(some) else pa.array(reps[:0])], names=["rep", "links", "root"])

    met_in = by_key(placed, "block", task, f"rep {id_kind}, links long, root {id_kind}")
    for more in found:
        met_in = met_in.unionByName(more)
    found = cut(met_in)
    comps = components(found.select(F.col("rep").cast("long").alias("u"), F.col("root").cast("long").alias("v")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = distinct.join(counted, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # rows that link with nothing have no vector to be joined by, however many they are
    apart = rows.where("e is null").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = rows.where("e is not null").join(reps, ["label", "e"]).select("id", "n_links", F.col("component_id").cast("long").alias("component_id")).unionByName(apart)
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col(key)))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))

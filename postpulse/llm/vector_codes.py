"""Product codes of vectors: k-means on integer parts, with metric trees instead of full scans.

A vector's components become integers, floor(scale * x), and are cut into equal consecutive
parts; each part position has a codebook of 256 entries.  A task gathers BLOCK vectors and builds
one metric tree per part position, an *anchors hierarchy*: anchors are chosen one after the
other as the point farthest from its anchor, a new anchor takes over points only from those lists
of others that can hold nearer ones; anchors are merged two by two into the smallest ball (so the
tree is built from its middle outwards), and an anchor with many points gets its own hierarchy.
Each ball caches the sum and number of its points.  The trees are written once.

A round walks each tree with a list of candidate entries that shrinks on the way down: an entry
goes when the ball lies wholly on the other side of the plane between it and the entry nearest to
the ball's centre.  A ball with one candidate left is *owned*: its cached sum and number count, its
points are not looked at.  In leaves the points meet the candidates that are left.  Tasks send
their sums per entry (at most parts x entries rows); the driver sees the codebooks only.

All is exact: distances are whole numbers below 2**53 in floating point, or 64-bit integers where
values are larger; the plane test has slack, so an entry that could tie is kept.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are
dropped, as are vectors whose length is not that of the first kept one (by id) or no multiple of
the number of parts.  Components beyond +-2**27 count as that bound, so that an error fits into a
long.  A null id stands after all others; repeated ids and rows are all coded, in the order of
their components when codebooks begin.  Fewer vectors than entries make shorter codebooks; no
vectors no rows.  Names of other columns do not matter: only those named in ``keep`` are read.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from postpulse.llm.common import attach
from postpulse.session import materialize

#: Vectors in a block (one tree per part), and points in a leaf.
BLOCK, LEAF = 4096, 48
#: Bound of components; below EXACT whole numbers are exact in floating point.
BOUND, EXACT = 1 << 27, 1 << 23


# ---------------------------------------------------------------------------- trees


class Tree:
    """Balls over the rows ``order[begin:end]`` of a matrix; children lie behind their parent."""

    FIELDS = ("order", "begin", "end", "left", "right", "sums", "radius")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{f: found[f] for f in cls.FIELDS})


def anchors(points: np.ndarray, wanted: int) -> np.ndarray:
    """The anchor number of each row: farthest points, each taking what is nearer to it."""
    owner = np.zeros(len(points), np.int64)
    pivots = points[:1]
    away = np.sqrt(((points - pivots[0]) ** 2).sum(1))
    while len(pivots) < wanted:
        new = int(away.argmax())
        if away[new] == 0:
            break
        between = np.sqrt(((pivots - points[new]) ** 2).sum(1))
        open_rows = np.flatnonzero(2 * away > between[owner])  # others are nearer to their own
        there = np.sqrt(((points[open_rows] - points[new]) ** 2).sum(1))
        nearer = there < away[open_rows]
        taken = open_rows[nearer]
        owner[taken], away[taken] = len(pivots), there[nearer]
        pivots = np.vstack([pivots, points[new : new + 1]])
    return owner


def _merged(centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs to merge, each time the two whose common ball is smallest; pair i makes ball n + i."""
    n = len(centres)
    centres, radii, sizes = list(centres), list(radii), list(sizes)
    ids = list(range(n))
    grid = np.full((n, n), np.inf)
    c, r = np.array(centres), np.array(radii)
    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0))
    low = np.tril_indices(n, -1)
    ball = np.maximum((apart + r[:, None] + r[None]) / 2, np.maximum(r[:, None], r[None]))
    grid[low] = ball[low]
    pairs = []
    for step in range(n - 1):
        at = int(grid.argmin())
        i, j = divmod(at, n)  # i > j: the new ball takes j's place
        pairs.append((ids[i], ids[j]))
        size = sizes[i] + sizes[j]
        c[j] = (c[i] * sizes[i] + c[j] * sizes[j]) / size
        r[j] = grid[i, j]
        sizes[j], ids[j] = size, n + step
        grid[i, :] = np.inf
        grid[:, i] = np.inf
        live = np.flatnonzero(np.isfinite(grid[j, :j]))
        above = j + 1 + np.flatnonzero(np.isfinite(grid[j + 1 :, j]))
        for others, row in ((live, True), (above, False)):
            d = np.sqrt(((c[others] - c[j]) ** 2).sum(1))
            ball = np.maximum((d + r[others] + r[j]) / 2, np.maximum(r[others], r[j]))
            if row:
                grid[j, others] = ball
            else:
                grid[others, j] = ball
    return pairs


def build_tree(values: np.ndarray) -> Tree:
    """The anchors hierarchy over the rows of an integer matrix."""
    points = values.astype(np.float64)
    order: list[np.ndarray] = []
    nodes: list[list] = []  # begin, end, left, right
    # Work is kept on a stack: a set of rows to divide, or a merged ball waiting for its children.
    root = [None]
    stack = [("divide", np.arange(len(points)), root, 0)]
    at = 0
    while stack:
        kind, what, holder, slot = stack.pop()
        if kind == "close":
            nodes[what][1] = at
            continue
        node = len(nodes)
        holder[slot] = node
        if kind == "divide":
            rows, groups = what, None
            if len(rows) > LEAF:
                owner = anchors(points[rows], max(2, math.isqrt(len(rows))))
                if owner.any():
                    groups = [rows[owner == g] for g in range(int(owner.max()) + 1)]
                    groups = [g for g in groups if len(g)]
            if not groups or len(groups) == 1:
                nodes.append([at, at + len(rows), -1, -1])
                order.append(rows)
                at += len(rows)
                continue
            centres = np.array([points[g].mean(0) for g in groups])
            radii = np.array([np.sqrt(((points[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centres, strict=True)])
            pairs = _merged(centres, radii, np.array([float(len(g)) for g in groups]))
            what = (groups, pairs, len(groups) + len(pairs) - 1)
        groups, pairs, number = what
        nodes.append([at, at, None, None])
        stack.append(("close", node, None, 0))
        for side, child in ((3, pairs[number - len(groups)][1]), (2, pairs[number - len(groups)][0])):
            if child < len(groups):
                stack.append(("divide", groups[child], nodes[node], side))
            else:
                stack.append(("merged", (groups, pairs, child), nodes[node], side))
    begin, end, left, right = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
    order_all = np.concatenate(order) if order else np.zeros(0, np.int64)
    inside = values[order_all].astype(np.int64)
    running = np.vstack([np.zeros((1, values.shape[1]), np.int64), inside.cumsum(0)])
    sums = running[end] - running[begin]
    radius = np.zeros(len(nodes))
    for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        if e > b:
            off = inside[b:e] - sums[i] / (e - b)
            radius[i] = math.sqrt((off * off).sum(1).max())
    return Tree(order=order_all, begin=begin, end=end, left=left, right=right, sums=sums, radius=radius)


def assign(tree: Tree, values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each row (ties: lower index), sums and numbers per entry, and how many
    point-to-entry distances were computed."""
    entries = book.astype(np.float64)
    squares = (entries * entries).sum(1)
    between = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * entries @ entries.T, 0))
    limit = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if limit < EXACT else np.int64
    exact, exact_squares = book.astype(kind), (book.astype(kind) ** 2).sum(1)
    inside = values[tree.order].astype(kind)
    label = np.empty(len(values), np.int64)
    sums, counts, computed = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64), 0
    front = np.zeros(1, np.int64)
    allowed = np.ones((1, len(book)), bool)
    while len(front):
        n = tree.end[front] - tree.begin[front]
        centre = tree.sums[front] / n[:, None]
        far = (centre * centre).sum(1)[:, None] + squares[None] - 2 * centre @ entries.T
        slack = 1e-9 * ((centre * centre).sum(1) + squares.max()) + 1e-6
        near = np.where(allowed, far, np.inf).argmin(1)
        rows = np.arange(len(front))
        reach = 2 * tree.radius[front][:, None] * between[near] * (1 + 1e-9) + slack[:, None]
        allowed &= far - far[rows, near][:, None] <= reach
        owned = allowed.sum(1) == 1
        np.add.at(sums, near[owned], tree.sums[front[owned]])
        np.add.at(counts, near[owned], n[owned])
        for node, entry in zip(front[owned].tolist(), near[owned].tolist(), strict=True):
            label[tree.begin[node] : tree.end[node]] = entry
        leaf = ~owned & (tree.left[front] < 0)
        for i in np.flatnonzero(leaf).tolist():
            low, high = tree.begin[front[i]], tree.end[front[i]]
            left = np.flatnonzero(allowed[i])
            score = exact_squares[left] - 2 * (inside[low:high] @ exact[left].T)
            found = left[score.argmin(1)]
            computed += score.size
            label[low:high] = found
            np.add.at(sums, found, inside[low:high].astype(np.int64))
            np.add.at(counts, found, 1)
        deeper = ~owned & ~leaf
        front, allowed = (
            np.concatenate([tree.left[front[deeper]], tree.right[front[deeper]]]),
            np.concatenate([allowed[deeper], allowed[deeper]]),
        )
    result = np.empty(len(values), np.int64)
    result[tree.order] = label
    return result, sums, counts, computed


# ---------------------------------------------------------------------------- Spark


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list array, as a matrix within +-BOUND."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -BOUND, BOUND).astype(np.int64).reshape(-1, dims)


def _write_blocks(rows: DataFrame, dims: int, parts: int, scale: int) -> DataFrame:
    """Blocks of ``rows`` (kept columns, vector last): columns as lists, numbers, one tree a part."""
    kinds = [ArrayType(f.dataType) for f in rows.schema.fields[:-1]]
    schema = StructType(
        [StructField(f"c{i}", k) for i, k in enumerate(kinds)]
        + [StructField("numbers", BinaryType())] + [StructField(f"tree{p}", BinaryType()) for p in range(parts)]
    )
    width = dims // parts

    def block(table: pa.Table) -> pa.RecordBatch:
        columns = [c.combine_chunks() for c in table.columns]
        numbers = whole_numbers(columns[-1], dims, scale).astype(np.int32)
        ends = pa.array([0, len(numbers)], pa.int32())
        trees = [build_tree(numbers[:, p * width : (p + 1) * width]).pack() for p in range(parts)]
        return pa.RecordBatch.from_arrays(
            [*(pa.ListArray.from_arrays(ends, c) for c in columns[:-1]),
             *(pa.array([x], pa.binary()) for x in (numbers.tobytes(), *trees))],
            names=schema.names,
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            waiting = pa.concat_tables([waiting, new]) if waiting is not None else new
            while len(waiting) >= BLOCK:
                yield block(waiting.slice(0, BLOCK))
                waiting = waiting.slice(BLOCK)
        if waiting is not None and len(waiting):
            yield block(waiting)

    return rows.mapInArrow(gather, schema)


def _opened(batch: pa.RecordBatch, dims: int, parts: int) -> Iterator[tuple[int, int, Tree, np.ndarray]]:
    """(row, part, tree, matrix) of the blocks in a batch."""
    width = dims // parts
    for row in range(batch.num_rows):
        numbers = np.frombuffer(batch.column("numbers")[row].as_buffer(), np.int32).reshape(-1, dims)
        for p in range(parts):
            yield row, p, Tree.unpack(batch.column(f"tree{p}")[row].as_py()), numbers[:, p * width : (p + 1) * width]


def _next_books(blocks: DataFrame, books: list[np.ndarray], dims: int, parts: int) -> list[np.ndarray]:
    """One round: each entry becomes the floor of the mean of its parts; unused entries stay."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, p, tree, values in _opened(batch, dims, parts):
                _, s, c, _ = assign(tree, values, books[p])
                sums[p] += s
                counts[p] += c
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()),
                "n": pa.array(counts[p][used], pa.int64()), "sums": pa.array(list(sums[p][used]), pa.list_(pa.int64())),
            })

    found = (
        blocks.mapInArrow(partial, "part int, entry int, n bigint, sums array<bigint>")
        .select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
        .collect()  # at most entries x dims rows
    )
    after = [b.copy() for b in books]
    for r in found:
        after[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return after


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, joined by commas."""
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def encode_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), *,
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, the columns of ``keep``, code, error) of each kept row, and the final codebooks.

    The code has two hex digits per part, so ``entries`` is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    names = [id_col, *keep]
    fit = f"size(v) > 0 and size(v) % {parts} = 0"
    finite = "not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    chosen = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    rows = df.select(*chosen, F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(f"{fit} and {finite}")
    order = [F.asc_nulls_last("c0"), "v"]
    first = rows.select("c0", "v").orderBy(*order).limit(1).collect()
    fields = [StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields, strict=False)]
    added = [StructField("code", StringType()), StructField("error", LongType())]
    schema = StructType([*fields, *added])
    if not first:
        return df.sparkSession.createDataFrame([], schema), []
    dims = len(first[0]["v"])
    rows = rows.where(F.size("v") == dims)
    start = whole_numbers(
        pa.array([r["v"] for r in rows.select("c0", "v").orderBy(*order).limit(entries).collect()], pa.list_(pa.float64())),
        dims, scale,
    )
    width = dims // parts
    books = [np.ascontiguousarray(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    blocks = materialize(_write_blocks(rows, dims, parts, scale), "vector-trees")
    for _ in range(rounds):
        books = _next_books(blocks, books, dims, parts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[np.ndarray] = []
            for row, p, tree, values in _opened(batch, dims, parts):
                label, _, _, _ = assign(tree, values, books[p])
                errors = ((values.astype(np.int64) - books[p][label]) ** 2).sum(1)
                if p == 0:
                    codes, total = [], np.zeros(len(label), np.int64)
                codes.append(label.astype(np.uint8))
                total += errors
                if p == parts - 1:
                    raw = np.stack(codes, 1).tobytes().hex()
                    size = 2 * parts
                    texts = [raw[i : i + size] for i in range(0, len(raw), size)]
                    own = [batch.column(i).slice(row, 1).flatten() for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(texts, pa.string()), pa.array(total, pa.int64())],
                        names=[f.name for f in numbered.fields],
                    )

    numbered = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate([*fields, *added])])
    return blocks.mapInArrow(coded, numbered).toDF(*schema.names), books


def with_label_error(coded: DataFrame, label_col: str, name: str = "label_error") -> DataFrame:
    """The errors summed over rows of equal label (nulls are equal); null where a long is too small."""
    written = materialize(coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))), "vector-codes")
    sums = materialize(
        written.groupBy("_label").agg(F.try_sum("error").alias(name), F.count(F.lit(1)).alias("_n")), "vector-labels"
    )
    return attach(written, sums, "_label", "_n").select(*coded.columns, name)


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()

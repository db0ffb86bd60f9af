"""Terrain meshes: triangulation of tiles by Arrow batches; vertices, skirts and boxes as DataFrame operations."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

# --- triangulators (numpy) ------------------------------------------------------------------------------------------------


def _roots(n: int) -> np.ndarray:
    """The two half squares as (ax, ay, bx, by, cx, cy): hypotenuse from a to b, right angle at c."""
    return np.array([[0, 0, n, n, n, 0], [n, n, 0, 0, 0, n]], np.int64)


def _halves(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middles of the hypotenuses, and the triangles' halves."""
    a, b, c = t[:, :2], t[:, 2:4], t[:, 4:]
    m = (a + b) // 2
    return m, np.hstack([c, a, m]), np.hstack([b, c, m])


def rtin_errors(grid: np.ndarray) -> np.ndarray:
    """For each point, the largest error at it and below it in the hierarchy of right triangles, level by level."""
    n = grid.shape[0] - 1
    if n < 1 or n & (n - 1) or grid.shape[0] != grid.shape[1]:
        raise ValueError("the grid must be square with 2^k + 1 points a side")
    z, levels = grid.astype(np.float64), [_roots(n)]
    while np.abs(levels[-1][:, :2] - levels[-1][:, 2:4]).max() > 1:
        _, p, q = _halves(levels[-1])
        levels.append(np.concatenate([p, q]))
    error = np.zeros(grid.shape)
    below: np.ndarray | None = None
    for t in reversed(levels[:-1] if n > 1 else levels[:0]):
        m, p, q = _halves(t)
        own = np.abs((z[t[:, 1], t[:, 0]] + z[t[:, 3], t[:, 2]]) / 2 - z[m[:, 1], m[:, 0]])
        if below is not None:
            for half in (p, q):
                k = (half[:, :2] + half[:, 2:4]) // 2
                own = np.maximum(own, error[k[:, 1], k[:, 0]])
        np.maximum.at(error, (m[:, 1], m[:, 0]), own)
        below = t
    return error


def rtin(grid: np.ndarray, max_error: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (x, y) and triangles of a right-triangulated mesh: a triangle is split where its middle's error is above the bound."""
    error, now, done = rtin_errors(grid), _roots(grid.shape[0] - 1), []
    while len(now):
        m, p, q = _halves(now)
        fine = np.abs(now[:, :2] - now[:, 2:4]).max(1) <= 1
        split = ~fine & (error[m[:, 1], m[:, 0]] > max_error)
        done.append(now[~split])
        now = np.concatenate([p[split], q[split]])
    corners = np.concatenate(done).reshape(-1, 2)
    points, index = np.unique(corners, axis=0, return_inverse=True)
    return points, index.reshape(-1, 3)


class Tin:
    """A Delaunay mesh that grows by the grid point where it is worst, until no error is above the bound."""

    def __init__(self, grid: np.ndarray):
        self.z = grid.astype(np.float64)
        h, w = grid.shape
        self.points = [(0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1)]
        self.used = set(self.points)
        self.triangles: dict[int, tuple[int, int, int]] = {}
        self.side: dict[tuple[int, int], int] = {}  # directed edge to its triangle
        self.heap: list[tuple[float, int, tuple[int, int]]] = []
        self.xs, self.ys = np.arange(w, dtype=np.float64)[None], np.arange(h, dtype=np.float64)[:, None]
        self.count = 0
        for t in ((3, 0, 2), (0, 3, 1)):
            self._add(t)

    def _cross(self, a: tuple, b: tuple, c: tuple) -> int:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def _add(self, t: tuple[int, int, int]) -> None:
        if self._cross(*(self.points[i] for i in t)) < 0:
            t = (t[1], t[0], t[2])
        k = self.count = self.count + 1
        self.triangles[k] = t
        for i in range(3):
            self.side[t[i], t[(i + 1) % 3]] = k
        worst, place = self._worst(t)
        if place is not None:
            heapq.heappush(self.heap, (-worst, k, place))

    def _errors(self, t: tuple[int, int, int]) -> tuple[np.ndarray, int, int]:
        """How far each grid point of the triangle's box is from its plane (-1 outside of the triangle), and the box's first column and row."""
        (ax, ay), (bx, by), (cx, cy) = (self.points[i] for i in t)
        x0, x1, y0, y1 = min(ax, bx, cx), max(ax, bx, cx), min(ay, by, cy), max(ay, by, cy)
        x, y, z = self.xs[:, x0 : x1 + 1], self.ys[y0 : y1 + 1], self.z
        w0 = (cx - bx) * (y - by) - (cy - by) * (x - bx)
        w1 = (ax - cx) * (y - cy) - (ay - cy) * (x - cx)
        area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        w2 = area - w0 - w1
        miss = np.abs((w0 * z[ay, ax] + w1 * z[by, bx] + w2 * z[cy, cx]) / area - z[y0 : y1 + 1, x0 : x1 + 1])
        miss[(w0 < 0) | (w1 < 0) | (w2 < 0)] = -1
        return miss, x0, y0

    def _worst(self, t: tuple[int, int, int]) -> tuple[float, tuple[int, int] | None]:
        """The grid point in the triangle that is farthest from its plane."""
        miss, x0, y0 = self._errors(t)
        for i in t:
            x, y = self.points[i]
            miss[y - y0, x - x0] = -1
        at = int(miss.argmax())
        row, col = divmod(at, miss.shape[1])
        own = float(miss[row, col])
        return (own, (col + x0, row + y0)) if own >= 0 else (0.0, None)

    def _in_circle(self, t: tuple[int, int, int], p: tuple[int, int]) -> bool:
        rows = [(q[0] - p[0], q[1] - p[1]) for q in (self.points[i] for i in t)]
        (ax, ay), (bx, by), (cx, cy) = rows
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0

    def _insert(self, start: int, p: tuple[int, int]) -> None:
        """Replaces the triangles whose circle holds p by triangles from p to the hole's border."""
        hole, todo = {start}, [start]
        while todo:
            t = self.triangles[todo.pop()]
            for i in range(3):
                a, b = t[i], t[(i + 1) % 3]
                k = self.side.get((b, a))
                on_edge = self._cross(self.points[a], self.points[b], p) == 0
                if k is not None and k not in hole and (on_edge or self._in_circle(self.triangles[k], p)):
                    hole.add(k)
                    todo.append(k)
        border = [(t[i], t[(i + 1) % 3]) for k in hole for t in (self.triangles[k],) for i in range(3) if self.side.get((t[(i + 1) % 3], t[i])) not in hole]
        for k in hole:
            t = self.triangles.pop(k)
            for i in range(3):
                self.side.pop((t[i], t[(i + 1) % 3]))
        self.points.append(p)
        self.used.add(p)
        for a, b in border:
            if self._cross(self.points[a], self.points[b], p):
                self._add((a, b, len(self.points) - 1))

    def max_error(self) -> float:
        while self.heap and self.heap[0][1] not in self.triangles:
            heapq.heappop(self.heap)
        return -self.heap[0][0] if self.heap else 0.0

    def rms(self) -> float:
        """Root of the mean squared error: the squares of all triangles' grid points, sides included, over the number of grid points."""
        total = 0.0
        for t in self.triangles.values():
            miss, _, _ = self._errors(t)
            total += float(np.square(miss[miss >= 0]).sum())
        return float(np.sqrt(total / self.z.size))

    def run(self, max_error: float) -> tuple[np.ndarray, np.ndarray]:
        while self.max_error() > max_error:
            _, k, p = heapq.heappop(self.heap)
            self._insert(k, p)
        return np.array(self.points), np.array(list(self.triangles.values()))


def triangulate(grid: np.ndarray, max_error: float, tesselator: str = "martini") -> tuple[np.ndarray, np.ndarray]:
    return rtin(grid, max_error) if tesselator == "martini" else Tin(grid).run(max_error)


def mesh_tiles(tiles: DataFrame, max_error: float = 4.0, tesselator: str = "martini", keys: tuple[str, ...] = ("dataset", "z", "x", "y")) -> DataFrame:
    """Vertices (px, py) and triangles of each tile (keys, width, height, pixels): a tile is a row, so tasks hold one at a time."""
    ship(tiles.sparkSession)
    own = tiles.select(*keys, "width", "height", "pixels")
    schema = own.select(*keys, F.col("pixels").cast("array<int>").alias("xs"), F.col("pixels").cast("array<int>").alias("ys"), F.col("pixels").cast("array<float>").alias("zs"), F.col("pixels").cast("array<int>").alias("indices")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, out = len(keys), []
            for w, h, p in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), b.column(k + 2), strict=True):
                grid = np.asarray(p.values, np.float32).reshape(h, w)
                points, index = triangulate(grid, max_error, tesselator)
                out.append((points[:, 0], points[:, 1], grid[points[:, 1], points[:, 0]], index.ravel()))
            cols = [pa.array([o[i].astype(t) for o in out], pa.list_(kind)) for i, (t, kind) in enumerate(((np.int32, pa.int32()), (np.int32, pa.int32()), (np.float32, pa.float32()), (np.int32, pa.int32())))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), *cols], schema.names)

    return own.mapInArrow(run, schema)


def mesh_stats(meshes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """n_vertices, n_triangles, twice the area of all triangles, and whether all are oriented and cover the tile."""
    at = lambda i: F.get("indices", i)
    n = (F.size("indices") / 3).cast("int")
    x, y = (lambda i: F.get("xs", at(i))), (lambda i: F.get("ys", at(i)))
    doubled = lambda t: F.abs((x(3 * t + 1) - x(3 * t)) * (y(3 * t + 2) - y(3 * t)) - (y(3 * t + 1) - y(3 * t)) * (x(3 * t + 2) - x(3 * t)))
    area = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, t: a + doubled(t).cast("long"))
    return meshes.select(*keys, F.size("xs").cast("long").alias("n_vertices"), n.cast("long").alias("n_triangles"), area.alias("area2"))


# --- mesh tables ----------------------------------------------------------------------------------------------------------


def vertex_attributes(px: Column, py: Column, z: Column, grid: int, bounds: tuple[float, float, float, float], exaggeration: float = 1.0) -> dict[str, Column]:
    """Position and texture coordinates; a grid of 257 spans 256 cells."""
    width = 256 if grid in (256, 257) else grid - 1
    sx, sy = (bounds[2] - bounds[0]) / width, (bounds[3] - bounds[1]) / width
    return {"x": px * sx + bounds[0], "y": -py * sy + bounds[3], "z": z * exaggeration, "u": px / float(width), "v": py / float(width)}


def bounding_box(vertices: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return vertices.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))


def outer_edges(triangles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges (keys, p, q, with p < q) that an odd number of triangles (keys, a, b, c) have."""
    pairs = F.explode(F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    return triangles.select(*keys, pairs.alias("e")).groupBy(*keys, "e.p", "e.q").agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys, "p", "q")


def side_edges(vertices: DataFrame, side: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive pairs (p, q) of the vertices (keys, vid, x, y, side) of one side: west by y, east by falling y, south by falling x, north by x."""
    order = {"west": F.asc("y"), "east": F.desc("y"), "south": F.desc("x"), "north": F.asc("x")}[side]
    w = Window.partitionBy(*keys, "side").orderBy(order, "vid")
    return vertices.where(F.col("side") == side).withColumns({"p": F.col("vid"), "q": F.lead("vid").over(w)}).where(F.col("q").isNotNull()).select(*keys, "p", "q")


def numbered(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """edges (keys, p, q) with i, their number from 0 in each mesh."""
    order = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("p", "q")
    return edges.withColumn("i", (F.row_number().over(order) - 1).cast("int"))


def skirt(vertices: DataFrame, edges: DataFrame, height: float, n_vertices: int | Column, exaggeration: float = 1.0, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The vertices and triangles that a mesh's edges (keys, i from 0, p, q) add: each edge again, lower, and the two triangles between.

    vertices (keys, vid, x, y, z, u, v) and edges may hold many meshes, told apart by keys; n_vertices is a number for all of them, or
    a Column over edges.
    """
    drop = height * exaggeration
    if drop <= 0:
        return vertices.limit(0), edges.select(*keys, F.col("p").alias("a"), F.col("q").alias("b"), F.col("q").alias("c")).limit(0)
    n = F.lit(n_vertices) if isinstance(n_vertices, int) else n_vertices
    first = (n + 2 * F.col("i")).cast("int")
    ends = edges.select(*keys, first.alias("first"), F.posexplode(F.array("p", "q")).alias("k", "vid"))
    low = ends.join(vertices, [*keys, "vid"]).select(*keys, (F.col("first") + F.col("k")).cast("int").alias("vid"), "x", "y", (F.col("z") - drop).alias("z"), "u", "v")
    both = F.array(F.struct(F.col("p").alias("a"), (first + 1).alias("b"), F.col("q").alias("c")), F.struct((first + 1).alias("a"), F.col("p").alias("b"), first.alias("c")))
    return low, edges.select(*keys, F.inline(both))


def vertical_errors(meshes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each tile (keys, width, height, pixels, xs, ys, indices): max_error, the greatest distance of a pixel from the mesh's plane above or
    below it, and n_covered, how many pixels some triangle covers. Corners take their height from pixels, not from the mesh."""
    n, at = F.col("width"), lambda k: F.get("indices", 3 * F.col("t") + k)
    z = lambda k: F.get("pixels", F.get("ys", at(k)) * n + F.get("xs", at(k))).cast("double")
    corner = {f"{c}{k}": F.get(f"{c}s", at(k)) for k in range(3) for c in "xy"} | {f"z{k}": z(k) for k in range(3)}
    own = meshes.select(*keys, "width", "pixels", "xs", "ys", "indices", F.explode(F.sequence(F.lit(0), (F.size("indices") / 3).cast("int") - 1)).alias("t"))
    own = own.select(*keys, "width", "pixels", *(c.alias(k) for k, c in corner.items()))
    side = lambda a, b, x, y: (F.col(f"x{b}") - F.col(f"x{a}")) * (y - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (x - F.col(f"x{a}"))
    box = lambda c: F.explode(F.sequence(F.least(*(F.col(f"{c}{k}") for k in range(3))), F.greatest(*(F.col(f"{c}{k}") for k in range(3)))))
    points = own.withColumn("py", box("y")).withColumn("px", box("x"))
    x, y = F.col("px"), F.col("py")
    points = points.withColumns({"area": side(0, 1, F.col("x2"), F.col("y2")), "w0": side(1, 2, x, y), "w1": side(2, 0, x, y), "w2": side(0, 1, x, y)})
    points = points.where("area <> 0 and w0 * sign(area) >= 0 and w1 * sign(area) >= 0 and w2 * sign(area) >= 0")
    plane = (F.col("w0") * F.col("z0") + F.col("w1") * F.col("z1") + F.col("w2") * F.col("z2")) / F.col("area")
    miss = F.abs(plane - F.get("pixels", y * F.col("width") + x))
    cells = points.groupBy(*keys, "px", "py").agg(F.max(miss).alias("e"))
    return cells.groupBy(*keys).agg(F.max("e").alias("max_error"), F.count("*").alias("n_covered"))

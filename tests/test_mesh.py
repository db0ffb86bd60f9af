import numpy as np
import pytest

from rasterloom.operators import mesh
from rasterloom.plans.options import Options
from rasterloom.plans.pipelines import mesh_arrays


def surface(n, seed=0):
    y, x = np.mgrid[0:n, 0:n]
    return (20 * np.sin(x / 5) + 15 * np.cos(y / 7) + np.random.default_rng(seed).normal(0, 1, (n, n))).astype(np.float32)


def miss(grid, points, index):
    """The largest vertical distance of grid points from the mesh, and twice its area."""
    worst, area2 = 0.0, 0
    for t in index:
        p = points[t]
        area = (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[1][1] - p[0][1]) * (p[2][0] - p[0][0])
        area2 += abs(area)
        (x0, y0), (x1, y1) = p.min(0), p.max(0)
        y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        w = [((p[j][0] - p[i][0]) * (y - p[i][1]) - (p[j][1] - p[i][1]) * (x - p[i][0])) / area for i, j in ((1, 2), (2, 0), (0, 1))]
        inside = (w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0)
        plane = sum(a * grid[q[1], q[0]] for a, q in zip(w, p, strict=True))
        worst = max(worst, np.abs(plane - grid[y0 : y1 + 1, x0 : x1 + 1])[inside].max())
    return worst, area2


@pytest.mark.parametrize("kind", ["martini", "delatin"])
@pytest.mark.parametrize("error", [0.0, 3.0, 30.0])
def test_meshes_cover_the_grid(kind, error):
    g = surface(17)
    points, index = mesh.triangulate(g, error, kind)
    worst, area2 = miss(g.astype(float), points, index)
    assert area2 == 2 * 16 * 16
    assert len(points) == len({tuple(p) for p in points.tolist()})
    if kind == "delatin" or error == 0:
        assert worst <= error + 1e-3
    edges = {}
    for a, b, c in index.tolist():
        for e in ((a, b), (b, c), (c, a)):
            edges[tuple(sorted(e))] = edges.get(tuple(sorted(e)), 0) + 1
    assert max(edges.values()) == 2  # no cracks: an edge inside has two triangles
    outer = [points[list(e)] for e, n in edges.items() if n == 1]
    assert all(p[0][k] == p[1][k] and p[0][k] in (0, 16) for p in outer for k in [0 if p[0][0] == p[1][0] else 1])


def test_flat_terrain_is_two_triangles():
    for kind in ("martini", "delatin"):
        assert len(mesh.triangulate(np.ones((9, 9), np.float32), 0.5, kind)[1]) == 2


def test_rtin_wants_a_power_of_two():
    with pytest.raises(ValueError):
        mesh.rtin(np.zeros((8, 8)), 1)


def test_skirt_below_outer_edges():
    g = surface(9)
    xyz, uv, index, low, high = mesh_arrays(g, (0, 0, 8, 8), 0.0, Options(type="terrain", terrain_skirt_height=10, vertical_exaggeration=2))
    assert (low, high) == (pytest.approx(2 * g.min()), pytest.approx(2 * g.max()))
    assert len(xyz) == 81 + 2 * 32 and len(index) == 128 + 64 and len(uv) == len(xyz)
    assert xyz[81:, 2].max() <= high - 20 + 1e-3


def test_rms_over_all_pixels():
    """Against errors taken triangle by triangle; pixels on a side count in each triangle that has it."""
    y, x = np.mgrid[0:17, 0:17]
    grid = 10 * np.sin(x / 3) * np.cos(y / 4)
    tin = mesh.Tin(grid)
    points, index = tin.run(0.8)
    total = 0.0
    for t in index:
        (ax, ay), (bx, by), (cx, cy) = points[t]
        area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        for py in range(17):
            for px in range(17):
                w = [(cx - bx) * (py - by) - (cy - by) * (px - bx), (ax - cx) * (py - cy) - (ay - cy) * (px - cx), (bx - ax) * (py - ay) - (by - ay) * (px - ax)]
                if min(w) >= 0:
                    total += (sum(k * grid[q[1], q[0]] for k, q in zip(w, points[t], strict=True)) / area - grid[py, px]) ** 2
    assert tin.rms() == np.sqrt(total / 289) or abs(tin.rms() - np.sqrt(total / 289)) < 1e-9
    assert tin.max_error() <= 0.8


def test_gaps_have_no_neighbours(spark):
    from rasterloom.operators import kernels

    px = spark.createDataFrame([(r, c, float(r * c)) for r in range(5) for c in range(5) if (r, c) != (2, 2)], "row int, col int, v double")
    assert kernels.neighbours(px).count() == 0
    own = kernels.neighbours(px.union(spark.createDataFrame([(2, 2, 4.0)], px.schema))).select("row", "col").collect()
    assert {tuple(r) for r in own} == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)}

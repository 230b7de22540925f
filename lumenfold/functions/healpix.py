"""Equal-area cells of the sphere (nested numbering) as NumPy functions, for Arrow-batched use."""

from __future__ import annotations

import numpy as np

# fixed values: the row and column of each base cell's southern corner
_ROW = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
_COL = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def n_cells(depth: int) -> int:
    return 12 << (2 * depth)


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of a number moved to the even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v.astype(np.int64)


def cell_of(ra_deg: np.ndarray, dec_deg: np.ndarray, depth: int) -> np.ndarray:
    """Nested cell of each position."""
    n = 1 << depth
    z = np.sin(np.radians(dec_deg))
    t = np.mod(np.asarray(ra_deg, float), 360.0) / 90.0  # quarter turns, 0 to 4
    za = np.abs(z)
    # near the equator: distances along the two diagonals
    up = n * (0.5 + t) - n * z * 0.75
    down = n * (0.5 + t) + n * z * 0.75
    jp, jm = np.floor(up).astype(np.int64), np.floor(down).astype(np.int64)
    ip, im = jp // n, jm // n
    face_eq = np.where(ip == im, (ip & 3) | 4, np.where(ip < im, ip & 3, (im & 3) + 8))
    x_eq, y_eq = jm & (n - 1), n - (jp & (n - 1)) - 1
    # near the poles
    nt = np.minimum(t.astype(np.int64), 3)
    tp = t - nt
    root = n * np.sqrt(3.0 * np.maximum(1.0 - za, 0.0))
    a, b = np.minimum((tp * root).astype(np.int64), n - 1), np.minimum(((1.0 - tp) * root).astype(np.int64), n - 1)
    north = z >= 0
    face_po = np.where(north, nt, nt + 8)
    x_po, y_po = np.where(north, n - b - 1, a), np.where(north, n - a - 1, b)
    eq = za <= 2.0 / 3.0
    face, x, y = np.where(eq, face_eq, face_po), np.where(eq, x_eq, x_po), np.where(eq, y_eq, y_po)
    return face.astype(np.int64) * n * n + (_spread(x) | (_spread(y) << np.uint64(1))).astype(np.int64)


def centre_of(cell: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Right ascension and declination of each cell's centre, in degrees."""
    n = 1 << depth
    cell = np.asarray(cell, np.int64)
    face, inside = cell // (n * n), cell % (n * n)
    x, y = _gather(inside), _gather(inside >> 1)
    ring = _ROW[face] * n - x - y - 1
    north, south = ring < n, ring > 3 * n
    width = np.where(north, ring, np.where(south, 4 * n - ring, n))
    z = np.where(north, 1 - width * width / (3.0 * n * n), np.where(south, width * width / (3.0 * n * n) - 1, (2 * n - ring) * 2.0 / (3.0 * n)))
    shift = np.where(north | south, 0, (ring - n) & 1)
    place = (_COL[face] * width + x - y + 1 + shift) // 2
    place = np.where(place > 4 * width, place - 4 * width, np.where(place < 1, place + 4 * width, place))
    ra = (place - (shift + 1) * 0.5) * (90.0 / width)
    return np.mod(ra, 360.0), np.degrees(np.arcsin(np.clip(z, -1, 1)))


def cells_in_polygon(ra: np.ndarray, dec: np.ndarray, depth: int) -> np.ndarray:
    """Cells whose centre lies in the convex region between the given corners, in any order; without one, the cells that it meets.

    A fine grid on the tangent plane finds every cell near the region; the
    centres of those cells are then tested against the great circles. A region
    that holds no centre holds no whole cell, so its edge meets all its cells.
    """
    v = _xyz(ra, dec)
    m = v.sum(axis=0)
    m /= np.linalg.norm(m)
    helper = np.array([0.0, 0.0, 1.0]) if abs(m[2]) < 0.9 else np.array([1.0, 0.0, 0.0])
    east = np.cross(helper, m)
    east /= np.linalg.norm(east)
    north = np.cross(m, east)
    order = np.argsort(np.arctan2(v @ north, v @ east))
    v = v[order]
    normals = np.cross(v, np.roll(v, -1, axis=0))
    reach = np.tan(np.arccos(np.clip(v @ m, -1, 1)).max())
    side = np.sqrt(4 * np.pi / n_cells(depth))
    step = side / 2.5
    k = int(np.ceil((reach + side) / step))
    grid = np.arange(-k, k + 1) * step
    gx, gy = (g.ravel() for g in np.meshgrid(grid, grid))
    p = m + gx[:, None] * east + gy[:, None] * north
    p /= np.linalg.norm(p, axis=1)[:, None]
    cells = np.unique(cell_of(np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1))), depth))
    c = _xyz(*centre_of(cells, depth))
    inside = cells[(c @ normals.T >= 0).all(axis=1)]
    return inside if len(inside) else _cells_on_edge(v, side / 200, depth)


def _cells_on_edge(v: np.ndarray, step: float, depth: int) -> np.ndarray:
    """Cells under the closed line through the vectors, seen at points at most ``step`` apart: one that is clipped by less may be missed."""
    points = []
    for a, b in zip(v, np.roll(v, -1, axis=0)):
        k = int(np.ceil(np.linalg.norm(b - a) / step)) + 1
        points.append(a + np.linspace(0, 1, k)[:, None] * (b - a))
    p = np.concatenate(points)
    p /= np.linalg.norm(p, axis=1)[:, None]
    return np.unique(cell_of(np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1))), depth))


def _xyz(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)

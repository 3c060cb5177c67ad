"""Camera transforms as column arithmetic: 4 x 4 matrices are lists of rows, points are column vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geofold.functions.geom import Vec, add, apply, col, dot, matmul, scale, transposed


def world_to_view(rotation: list[Vec], t: Vec, translate=(0.0, 0.0, 0.0), factor=1.0) -> list[Vec]:
    """Matrix of a view whose camera-to-world rotation and world-to-view translation are given; the camera's centre is first moved and scaled."""
    centre = scale(add([-c for c in apply(rotation, t)], list(translate)), factor)
    turned = transposed(rotation)
    back = apply(turned, centre)
    return [*([*row, -b] for row, b in zip(turned, back, strict=True)), [F.lit(0.0)] * 3 + [F.lit(1.0)]]


def projection(near, far, fov_x, fov_y) -> list[Vec]:
    """Perspective matrix: depth from 0 at near to 1 at far, w is the depth in view space."""
    near, far, zero = col(near), col(far), F.lit(0.0)
    return [
        [1 / F.tan(col(fov_x) / 2), zero, zero, zero],
        [zero, 1 / F.tan(col(fov_y) / 2), zero, zero],
        [zero, zero, far / (far - near), -far * near / (far - near)],
        [zero, zero, F.lit(1.0), zero],
    ]


def transformed(p: Vec, m: list[Vec], least: float = 1e-7) -> Vec:
    """A point's image under a 4 x 4 matrix, divided by its w, to which ``least`` is added."""
    out = [dot(row[:3], p) + col(row[3]) for row in m]
    return [c / (out[3] + least) for c in out[:3]]


def ndc_pixel(u, v, width: int, height: int) -> tuple[Column, Column]:
    """A pixel's centre where the shorter side of the image goes from 1 to -1, left and up positive."""
    short = float(min(width, height))
    return -(2 * (col(u) + 0.5) / width - 1) * (width / short), -(2 * (col(v) + 0.5) / height - 1) * (height / short)


def unproject_ndc(u, v, depth, width: int, height: int, focal: tuple, centre: tuple = (0.0, 0.0)) -> Vec:
    """View-space place of a pixel at a depth; focal lengths and centre in units of ``ndc_pixel``."""
    x, y = ndc_pixel(u, v, width, height)
    return [(x - col(centre[0])) * col(depth) / col(focal[0]), (y - col(centre[1])) * col(depth) / col(focal[1]), col(depth)]


def affine_inverse(m: list[Vec]) -> list[Vec]:
    """Inverse of three rows (linear part, shift), by cofactors."""
    a = [[col(x) for x in row] for row in m]
    minor = lambda r, c: a[(r + 1) % 3][(c + 1) % 3] * a[(r + 2) % 3][(c + 2) % 3] - a[(r + 1) % 3][(c + 2) % 3] * a[(r + 2) % 3][(c + 1) % 3]
    det = sum((a[0][c] * minor(0, c) for c in range(1, 3)), a[0][0] * minor(0, 0))
    linear = [[minor(c, r) / det for c in range(3)] for r in range(3)]
    return [[*row, -dot(row, [a[k][3] for k in range(3)])] for row in linear]


def affine_product(a: list[Vec], b: list[Vec]) -> list[Vec]:
    """First b, then a."""
    linear = matmul([row[:3] for row in a], [row[:3] for row in b])
    return [[*row, dot(own[:3], [x[3] for x in b]) + col(own[3])] for row, own in zip(linear, a, strict=True)]

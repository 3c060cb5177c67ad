"""Column expressions for points, rotations, cameras and splats.

All angles are radians; quaternions are (w, x, y, z); matrices are row-major lists of columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Real spherical-harmonic factors.
SH_C0 = 0.28209479177387814
SH_C1 = 0.4886025119029199
SH_C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH_C4 = (2.5033429417967046, -1.7701307697799304, 0.9461746957575601, -0.6690465435572892, 0.10578554691520431, -0.6690465435572892, 0.47308734787878004, -1.7701307697799304, 0.6258357354491761)
SH_C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)

Vec = list


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def r6(c, digits: int = 6) -> Column:
    """Rounded for comparison; never a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(p) -> Column:
    return F.ln(col(p) / (1 - col(p)))


def dot(a: Vec, b: Vec) -> Column:
    out = col(a[0]) * col(b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + col(x) * col(y)
    return out


def sub(a: Vec, b: Vec) -> Vec:
    return [col(x) - col(y) for x, y in zip(a, b, strict=True)]


def add(a: Vec, b: Vec) -> Vec:
    return [col(x) + col(y) for x, y in zip(a, b, strict=True)]


def scale(a: Vec, k) -> Vec:
    return [col(x) * col(k) for x in a]


def cross(a: Vec, b: Vec) -> Vec:
    a, b = [col(x) for x in a], [col(x) for x in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def normalized(a: Vec, least: float = 0.0) -> Vec:
    n = F.greatest(norm(a), F.lit(least)) if least else norm(a)
    return [col(x) / n for x in a]


def quaternion_matrix(q: Vec, normalise: bool = True) -> list[Vec]:
    """Rotation matrix; camera files use unit quaternions as they are, splats normalise."""
    w, x, y, z = normalized(q) if normalise else [col(c) for c in q]
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_product(a: Vec, b: Vec) -> Vec:
    aw, ax, ay, az = (col(c) for c in a)
    bw, bx, by, bz = (col(c) for c in b)
    return [
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    ]


def matrix_quaternion(m: list[Vec]) -> Vec:
    """Unit quaternion of a rotation matrix, w >= 0, by the largest of the four squared parts."""
    t = m[0][0] + m[1][1] + m[2][2]
    squares = [1 + t, 1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2]]
    rows = [
        [squares[0], m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]],
        [m[2][1] - m[1][2], squares[1], m[0][1] + m[1][0], m[0][2] + m[2][0]],
        [m[0][2] - m[2][0], m[0][1] + m[1][0], squares[2], m[1][2] + m[2][1]],
        [m[1][0] - m[0][1], m[0][2] + m[2][0], m[1][2] + m[2][1], squares[3]],
    ]
    most = F.greatest(*squares)
    out = []
    for i in range(4):
        pick = F.lit(None).cast("double")
        for k in (3, 2, 1, 0):
            pick = F.when(squares[k] >= most, rows[k][i] / (2 * F.sqrt(squares[k]))).otherwise(pick)
        out.append(pick)
    sign = F.when(out[0] < 0, -1.0).otherwise(1.0)
    return [c * sign for c in out]


def apply(m: list[Vec], v: Vec) -> Vec:
    return [dot(row, v) for row in m]


def transposed(m: list[Vec]) -> list[Vec]:
    return [list(x) for x in zip(*m, strict=True)]


def matmul(a: list[Vec], b: list[Vec]) -> list[Vec]:
    return [[dot(row, column) for column in transposed(b)] for row in a]


def covariance3d(q: Vec, s: Vec) -> Vec:
    """Upper half (xx, xy, xz, yy, yz, zz) of R diag(s^2) R^T."""
    m = quaternion_matrix(q)
    rs = [[x * col(k) for x, k in zip(row, s, strict=True)] for row in m]
    return [dot(rs[i], rs[j]) for i in range(3) for j in range(i, 3)]


def inverse_root(q: Vec, s: Vec, v: Vec) -> Vec:
    """diag(1/s) R^T v: differences in a splat's own frame."""
    return [x / col(k) for x, k in zip(apply(transposed(quaternion_matrix(q)), v), s, strict=True)]


def ewa_covariance(cov: Vec, p: Vec, focal: tuple, tan_fov: tuple, low_pass: float = 0.3) -> Vec:
    """(a, b, c) of a splat's image covariance; p is in camera space, cov too."""
    x, y, z = (col(c) for c in p)
    lx, ly = 1.3 * tan_fov[0], 1.3 * tan_fov[1]
    tx = F.least(F.greatest(x / z, F.lit(-lx)), F.lit(lx)) * z
    ty = F.least(F.greatest(y / z, F.lit(-ly)), F.lit(ly)) * z
    j = [[focal[0] / z, F.lit(0.0), -focal[0] * tx / (z * z)], [F.lit(0.0), focal[1] / z, -focal[1] * ty / (z * z)]]
    xx, xy, xz, yy, yz, zz = (col(c) for c in cov)
    full = [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]
    jc = [[dot(row, c) for c in full] for row in j]
    return [dot(jc[0], j[0]) + low_pass, dot(jc[0], j[1]), dot(jc[1], j[1]) + low_pass]


def conic_radius(a, b, c, floor: float = 0.1) -> tuple[Vec, Column]:
    """Inverse of a 2x2 covariance and the radius in pixels that three deviations reach."""
    a, b, c = col(a), col(b), col(c)
    det = a * c - b * b
    mid = 0.5 * (a + c)
    largest = mid + F.sqrt(F.greatest(F.lit(floor), mid * mid - det))
    return [c / det, -b / det, a / det], F.ceil(3 * F.sqrt(largest))


def sh_basis(d: Vec, degree: int) -> Vec:
    """Real spherical harmonics of a unit direction, degrees 0 to 4."""
    x, y, z = (col(c) for c in d)
    out = [F.lit(SH_C0)]
    if degree > 0:
        out += [-SH_C1 * y, SH_C1 * z, -SH_C1 * x]
    if degree > 1:
        out += [SH_C2[0] * x * y, SH_C2[1] * y * z, SH_C2[2] * (2 * z * z - x * x - y * y), SH_C2[3] * x * z, SH_C2[4] * (x * x - y * y)]
    if degree > 2:
        xx, yy, zz = x * x, y * y, z * z
        out += [
            SH_C3[0] * y * (3 * xx - yy), SH_C3[1] * x * y * z, SH_C3[2] * y * (4 * zz - xx - yy), SH_C3[3] * z * (2 * zz - 3 * xx - 3 * yy),
            SH_C3[4] * x * (4 * zz - xx - yy), SH_C3[5] * z * (xx - yy), SH_C3[6] * x * (xx - 3 * yy),
        ]
    if degree > 3:
        plane, steep, flat = xx - yy, 7 * zz - 1, 7 * zz - 3
        terms = [x * y * plane, y * z * (3 * xx - yy), x * y * steep, y * z * flat, 35 * zz * zz - 30 * zz + 3, x * z * flat, plane * steep, x * z * (xx - 3 * yy), xx * xx - 6 * xx * yy + yy * yy]
        out += [c * t for c, t in zip(SH_C4, terms, strict=True)]
    return out


def sh_value(coefficients: Vec, d: Vec, degree: int, clamp: bool = True) -> Column:
    """One channel's colour: the series plus one half, not below zero."""
    out = dot(sh_basis(d, degree), coefficients) + 0.5
    return F.greatest(out, F.lit(0.0)) if clamp else out


def rgb_to_sh(c) -> Column:
    return (col(c) - 0.5) / SH_C0


def sh_to_rgb(c) -> Column:
    return col(c) * SH_C0 + 0.5


def to_spherical(v: Vec) -> tuple[Column, Column]:
    """(elevation, azimuth) of a unit direction with y up."""
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(v[1])))), F.atan2(col(v[0]), col(v[2]))


def from_spherical(elevation, azimuth) -> Vec:
    e, a = col(elevation), col(azimuth)
    return [F.cos(e) * F.sin(a), F.sin(e), F.cos(e) * F.cos(a)]


def fov_to_focal(fov, pixels) -> Column:
    return col(pixels) / (2 * F.tan(col(fov) / 2))


def focal_to_fov(focal, pixels) -> Column:
    return 2 * F.atan(col(pixels) / (2 * col(focal)))


def project(p: Vec, focal: tuple, centre: tuple) -> Vec:
    """Pinhole image place (u, v) of a camera-space point."""
    return [focal[0] * col(p[0]) / col(p[2]) + centre[0], focal[1] * col(p[1]) / col(p[2]) + centre[1]]


def unproject(u, v, depth, focal: tuple, centre: tuple) -> Vec:
    return [(col(u) - centre[0]) / focal[0] * col(depth), (col(v) - centre[1]) / focal[1] * col(depth), col(depth)]


def spread_bits(c) -> Column:
    """Ten bits with two zeros between neighbours."""
    x = col(c).cast("long").bitwiseAND(F.lit(1023))
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(p: Vec, low: Vec, high: Vec) -> Column:
    """30-bit Z-order code inside a box."""
    cells = [F.floor((col(x) - col(a)) / (col(b) - col(a)) * 1023) for x, a, b in zip(p, low, high, strict=True)]
    return spread_bits(cells[0]).bitwiseOR(F.shiftleft(spread_bits(cells[1]), 1)).bitwiseOR(F.shiftleft(spread_bits(cells[2]), 2))


def point_triangle_squared(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Squared distance of a point to a triangle, by the region of its nearest point."""
    ab, ac, ap = sub(b, a), sub(c, a), sub(p, a)
    d1, d2 = dot(ab, ap), dot(ac, ap)
    bp, cp = sub(p, b), sub(p, c)
    d3, d4, d5, d6 = dot(ab, bp), dot(ac, bp), dot(ab, cp), dot(ac, cp)
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    total = va + vb + vc

    def far(q: Vec) -> Column:
        return squared_distance(p, q)

    on_ab = far(add(a, scale(ab, d1 / (d1 - d3))))
    on_ac = far(add(a, scale(ac, d2 / (d2 - d6))))
    on_bc = far(add(b, scale(sub(c, b), (d4 - d3) / ((d4 - d3) + (d5 - d6)))))
    inside = far(add(a, add(scale(ab, vb / total), scale(ac, vc / total))))
    return (
        F.when((d1 <= 0) & (d2 <= 0), far(a))
        .when((d3 >= 0) & (d4 <= d3), far(b))
        .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), on_ab)
        .when((d6 >= 0) & (d5 <= d6), far(c))
        .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), on_ac)
        .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), on_bc)
        .otherwise(inside)
    )


def face_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return cross(sub(b, a), sub(c, a))


def angle_degrees(cosine) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(cosine)))))


def learning_rate(step, first: float, last: float, steps: int, delay_steps: int = 0, delay_factor: float = 1.0) -> Column:
    """Log-linear decay from first to last; an optional sine ramp at the start."""
    t = F.least(F.greatest(col(step) / float(steps), F.lit(0.0)), F.lit(1.0))
    ramp = F.lit(1.0)
    if delay_steps:
        ramp = delay_factor + (1 - delay_factor) * F.sin(0.5 * math.pi * F.least(F.greatest(col(step) / float(delay_steps), F.lit(0.0)), F.lit(1.0)))
    return F.when((col(step) < 0) | F.lit(first == 0 and last == 0), F.lit(0.0)).otherwise(ramp * F.exp(math.log(first or 1) * (1 - t) + math.log(last or 1) * t))

"""Tables of triangle meshes: vertices(vid, x, y, z) and faces(fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofold.functions.camera import affine_inverse, affine_product
from geofold.functions.geom import angle_degrees, cross, dot, face_normal, norm, normalized, sub
from geofold.operators.components import connected_components
from geofold.operators.ordering import numbered
from geofold.operators.shared import stash

CORNERS = ("a", "b", "c")


def edges(faces: DataFrame) -> DataFrame:
    """(fid, u, v): a face's three edges, u <= v."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    return faces.select("fid", F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).select("fid", "e.u", "e.v")


def edge_usage(faces: DataFrame) -> DataFrame:
    return edges(faces).groupBy("u", "v").agg(F.count("*").alias("uses"))


def edge_kinds(faces: DataFrame) -> DataFrame:
    """One row: how many edges bound one face, two, or more."""
    n = F.col("uses")
    return edge_usage(faces).agg(F.count("*").alias("edges"), F.sum((n == 1).cast("long")).alias("boundary"), F.sum((n == 2).cast("long")).alias("manifold"), F.sum((n > 2).cast("long")).alias("non_manifold"))


def adjacent_faces(faces: DataFrame) -> DataFrame:
    """(u, v, f, g): the faces on both sides of each edge that two use."""
    return edges(faces).groupBy("u", "v").agg(F.count("*").alias("uses"), F.min("fid").alias("f"), F.max("fid").alias("g")).where("uses = 2 AND f < g").drop("uses")


#: Rows of vertices up to which they are sent to all tasks, so that faces needn't be dealt by their corners (some 100 MB at most). The join's rows are the same.
SENT = 1 << 20


def sender(rows: DataFrame, most: int = SENT):
    """What marks a table made of rows to be broadcast, where these are at most so many; else it stays as it is."""
    return F.broadcast if rows.select(rows.columns[0]).limit(most + 1).count() <= most else lambda part: part


def with_corners(faces: DataFrame, vertices: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """faces with the corners' coordinates ax, ay, ... cz."""
    out, send = faces, sender(vertices)
    for k in CORNERS:
        out = out.join(send(vertices.select(F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in ("x", "y", "z", *extra)))), k)
    return out


def corner(k: str) -> list:
    return [F.col(k + c) for c in "xyz"]


def normals(faces: DataFrame, vertices: DataFrame, least: float = 1e-20) -> DataFrame:
    """(fid, nx, ny, nz) of faces whose normal isn't zero."""
    n = face_normal(*(corner(k) for k in CORNERS))
    rows = with_corners(faces, vertices).select("fid", *(c.alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)))
    size = norm(["nx", "ny", "nz"])
    return rows.where(size > least).select("fid", *((F.col(f"n{x}") / size).alias(f"n{x}") for x in "xyz"))


def dihedral_angles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(f, g, raw, folded): angle between neighbouring faces' normals in degrees; folded ignores orientation."""
    n = stash(normals(faces, vertices), "normals")  # both sides read it
    left = n.select(F.col("fid").alias("f"), *(F.col(f"n{x}").alias(f"f{x}") for x in "xyz"))
    right = n.select(F.col("fid").alias("g"), *(F.col(f"n{x}").alias(f"g{x}") for x in "xyz"))
    cosine = dot(["fx", "fy", "fz"], ["gx", "gy", "gz"])
    return adjacent_faces(faces).join(left, "f").join(right, "g").select("f", "g", angle_degrees(cosine).alias("raw"), angle_degrees(F.abs(cosine)).alias("folded"))


def face_components(faces: DataFrame) -> DataFrame:
    """(fid, component): faces linked by shared edges; component is its smallest face. Hubs, not pairs, link an edge's faces."""
    e = edges(faces)
    hub = e.groupBy("u", "v").agg(F.min("fid").alias("hub"))
    links = e.join(hub, ["u", "v"]).where("fid != hub").select(F.col("hub").alias("a"), F.col("fid").alias("b"))
    roots = connected_components(links)
    return faces.select("fid").join(roots.withColumnRenamed("node", "fid"), "fid", "left").select("fid", F.coalesce("root", "fid").alias("component"))


def fragment_stats(components: DataFrame, least_faces: int = 100) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("faces"))
    small = F.col("faces") < least_faces
    return sizes.agg(F.count("*").alias("components"), F.sum(small.cast("long")).alias("fragments"), F.coalesce(F.sum(F.when(small, F.col("faces"))), F.lit(0)).alias("fragment_faces"), F.sum("faces").alias("faces"), (F.max("faces") / F.sum("faces")).alias("largest_share"))


def deduplicated(faces: DataFrame) -> DataFrame:
    """Faces without degenerate ones and without a second one of the same corners; the smallest fid stays."""
    key = F.array_sort(F.array(*CORNERS))
    proper = faces.where("a != b AND b != c AND a != c")
    return proper.groupBy(key.alias("corners")).agg(F.min(F.struct("fid", *CORNERS)).alias("f")).select("f.*")


def merged_vertices(vertices: DataFrame, faces: DataFrame, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """Vertices of equal rounded place become the one of the smallest vid; faces follow."""
    place = [F.round(c, digits) for c in "xyz"]
    own = vertices.select("vid", F.xxhash64(*place).alias("k"), *(p.alias(f"r{c}") for p, c in zip(place, "xyz", strict=True)))
    first = own.groupBy("rx", "ry", "rz").agg(F.min("vid").alias("kept"))
    renamed = own.join(first, ["rx", "ry", "rz"]).select("vid", "kept")
    out = faces
    for k in CORNERS:
        out = out.join(renamed.select(F.col("vid").alias(k), F.col("kept").alias(f"new_{k}")), k).drop(k).withColumnRenamed(f"new_{k}", k)
    return vertices.join(first.select(F.col("kept").alias("vid")), "vid", "left_semi"), out.select("fid", *CORNERS)


def areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, area)."""
    n = face_normal(*(corner(k) for k in CORNERS))
    return with_corners(faces, vertices).select("fid", (norm(n) / 2).alias("area"))


def non_manifold_edges(faces: DataFrame) -> DataFrame:
    """(u, v, uses) of the edges that more than two faces share."""
    return edge_usage(faces).where("uses > 2")


def manifold_faces(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces after dropping, smallest first (by area, then fid), each one that then still has an edge of more than two faces.

    When a face's turn comes, all smaller faces on its edges have gone, as long as those edges were too full; so a
    face stays if it is one of the two largest on each of its edges, and no round is needed. Two rows of an edge are kept before the shuffle.
    Faces must have three different corners.
    """
    sized = edges(faces).join(areas(faces, vertices), "fid")
    largest = Window.partitionBy("u", "v").orderBy(F.desc("area"), F.desc("fid"))
    whole = sized.withColumn("__r", F.row_number().over(largest)).where("__r <= 2").groupBy("fid").agg(F.count("*").alias("__n")).where("__n = 3")
    return faces.join(whole, "fid", "left_semi")


def smooth_normals(faces: DataFrame, vertices: DataFrame, crease: float = 60.0) -> DataFrame:
    """(fid, corner, vid, nx, ny, nz): a normal for each corner of each face, shared by the faces around the vertex that no crease parts.

    Faces around a vertex are linked if they share an edge there (that two faces use) whose normals differ by at most ``crease`` degrees; a
    linked part's normal is the mean of its faces' normals, weighed by area. Null where that is zero.
    """
    raw = lambda rows: with_corners(rows, vertices).withColumns({f"r{x}": c for x, c in zip("xyz", face_normal(*(corner(k) for k in CORNERS)), strict=True)})
    sides = stash(adjacent_faces(faces), "adjacent")
    beside = sides.select(F.explode(F.array("f", "g")).alias("fid")).distinct()
    # only faces beside another one are dealt out; the others' corners keep their own normal
    own = stash(raw(faces.join(sender(beside, SENT // 4)(beside), "fid", "left_semi")).select("fid", *CORNERS, "rx", "ry", "rz"), "face-normals")
    size = norm(["rx", "ry", "rz"])
    unit = lambda k: own.where(size > 1e-20).select(F.col("fid").alias(k), *((F.col(f"r{x}") / size).alias(f"{k}{x}") for x in "xyz"))
    bend = angle_degrees(dot(["fx", "fy", "fz"], ["gx", "gy", "gz"]))
    shared = sides.join(unit("f"), "f").join(unit("g"), "g").where(bend <= crease).select("f", "g", F.explode(F.array("u", "v")).alias("vid")).distinct()
    at = F.explode(F.array(*(F.struct((3 * F.col("fid") + i).alias("node"), F.col(k).alias("vid")) for i, k in enumerate(CORNERS))))
    corners = own.select("fid", at.alias("c")).select("fid", "c.node", "c.vid")
    side = lambda k, name: corners.select(F.col("fid").alias(k), "vid", F.col("node").alias(name))
    links = shared.join(side("f", "i"), ["f", "vid"]).join(side("g", "j"), ["g", "vid"]).select("i", "j")
    roots = connected_components(links, stars=True).select("root", F.expr("node - pmod(node, 3)").alias("__first"), F.expr("pmod(node, 3)").alias("k"))
    linked = roots.join(own.select((3 * F.col("fid")).alias("__first"), "fid", "rx", "ry", "rz"), "__first")
    sums = linked.groupBy("root").agg(*(F.sum(f"r{x}").alias(f"s{x}") for x in "xyz"))
    of = lambda i, x: F.max(F.when(F.col("k") == i, F.col(f"s{x}"))).alias(f"s{i}{x}")
    parts = stash(linked.select("root", "fid", "k").join(sums, "root").groupBy("fid").agg(*(of(i, x) for i in range(3) for x in "xyz")), "corner-normals")
    found = raw(faces.join(sender(parts, SENT // 4)(parts), "fid", "left"))
    total = lambda i, x: F.coalesce(f"s{i}{x}", f"r{x}").alias(f"s{x}")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("corner"), F.col(k).alias("vid"), *(total(i, x) for x in "xyz")) for i, k in enumerate(CORNERS))))
    size = norm(["sx", "sy", "sz"])
    return found.select("fid", each.alias("c")).select("fid", "c.*").select("fid", "corner", "vid", *(F.when(size > 0, F.col(f"s{x}") / size).alias(f"n{x}") for x in "xyz"))


def bounds(vertices: DataFrame) -> DataFrame:
    """One row: the vertices' box (low and high by axis) and their centroid."""
    return vertices.agg(*(f(c).alias(f"{k}{c}") for k, f in (("lo", F.min), ("hi", F.max), ("c", F.avg)) for c in "xyz"))


def submesh(faces: DataFrame, kept: DataFrame) -> DataFrame:
    """(fid, a, b, c) of the faces with all corners in kept(vid), renumbered densely in vid order."""
    new = numbered(kept.select("vid").distinct(), ["vid"], "new")
    out = faces
    for k in CORNERS:
        out = out.join(new.select(F.col("vid").alias(k), F.col("new").alias(f"new_{k}")), k)
    return out.select("fid", *(F.col(f"new_{k}").alias(k) for k in CORNERS))


def concatenated(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two meshes as one: the second one's ids go on after the first one's."""
    (va, fa), (vb, fb) = first, second
    shift = va.agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("dv")).join(fa.agg(F.coalesce(F.max("fid") + 1, F.lit(0)).alias("df")))
    moved_v = vb.join(F.broadcast(shift)).withColumn("vid", F.col("vid") + F.col("dv")).select(va.columns)
    moved_f = fb.join(F.broadcast(shift)).select((F.col("fid") + F.col("df")).alias("fid"), *((F.col(k) + F.col("dv")).alias(k) for k in CORNERS))
    return va.unionByName(moved_v), fa.select("fid", *CORNERS).unionByName(moved_f)


def smoothed(vertices: DataFrame, faces: DataFrame, step: float = 0.5) -> DataFrame:
    """One Laplacian step: each vertex moves towards the mean of its neighbours; step < 0 inflates (two-step smoothing)."""
    e = edge_usage(faces)
    both = e.select(F.col("u").alias("vid"), F.col("v").alias("other")).unionByName(e.select(F.col("v").alias("vid"), F.col("u").alias("other")))
    near = both.join(vertices.select(F.col("vid").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz")), "other").groupBy("vid").agg(*(F.avg(f"o{c}").alias(f"m{c}") for c in "xyz"))
    moved = [(F.col(c) + step * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in "xyz"]
    return vertices.join(near, "vid", "left").select("vid", *moved)


def subdivided(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every face split into four at its edges' midpoints."""
    base = vertices.agg((F.max("vid") + 1).alias("base"))
    mids = numbered(edge_usage(faces).select("u", "v"), ["u", "v"], "k").join(F.broadcast(base)).select("u", "v", (F.col("base") + F.col("k")).alias("vid"))
    ends = [vertices.select(F.col("vid").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")) for k in "uv"]
    new = mids.join(ends[0], "u").join(ends[1], "v").select("vid", *(((F.col(f"u{c}") + F.col(f"v{c}")) / 2).alias(c) for c in "xyz"))
    out = faces
    for x, y, m in (("a", "b", "ab"), ("b", "c", "bc"), ("c", "a", "ca")):
        out = out.withColumn("u", F.least(x, y)).withColumn("v", F.greatest(x, y)).join(mids.withColumnRenamed("vid", m), ["u", "v"]).drop("u", "v")
    four = F.array(*(F.struct(F.lit(i).alias("part"), *(F.col(s).alias(k) for s, k in zip(t, CORNERS, strict=True))) for i, t in enumerate((("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")))))
    split = out.select("fid", F.explode(four).alias("t")).select((4 * F.col("fid") + F.col("t.part")).alias("fid"), "t.a", "t.b", "t.c")
    return vertices.select("vid", *"xyz").unionByName(new), split


def nearest_face_distance(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """(i, distance): least distance to any candidate face. candidates: i and the faces' corners ax ... cz; points: id, x, y, z."""
    import numpy as np
    import pandas as pd

    from geofold.operators.boxes import CORNERS as NUMBERS
    from geofold.operators.boxes import point_triangle

    @F.pandas_udf("double")
    def squared(*c):  # as an expression it is too long to be compiled
        p = np.column_stack(c).reshape(-1, 4, 3)
        return pd.Series(point_triangle(*(p[:, k] for k in range(4))))

    own = points.select(F.col("id").alias("i"), *"xyz")
    return candidates.join(own, "i").select("i", squared(*"xyz", *NUMBERS).alias("d2")).groupBy("i").agg(F.sqrt(F.min("d2")).alias("distance"))


def skinned(vertices: DataFrame, weights: DataFrame, bones: DataFrame) -> DataFrame:
    """(vid, x, y, z): weighted sum of bones' affine maps; weights(vid, bone, w) are normalised, bones have m00..m23."""
    share = F.col("w") / F.sum("w").over(Window.partitionBy("vid"))
    rows = weights.where("w > 0").withColumn("share", share).join(bones, "bone").join(vertices, "vid")
    moved = [F.sum(F.col("share") * (dot([F.col(f"m{r}{k}") for k in range(3)], list("xyz")) + F.col(f"m{r}3"))).alias(c) for r, c in enumerate("xyz")]
    return rows.groupBy("vid").agg(*moved)


def pose_from_rest(bones: DataFrame) -> DataFrame:
    """(bone, m00..m23): each bone's pose after the inverse of its rest; bones have p00..p23 (pose) and r00..r23 (rest)."""
    rows = lambda k: [[F.col(f"{k}{r}{c}") for c in range(4)] for r in range(3)]
    m = affine_product(rows("p"), affine_inverse(rows("r")))
    return bones.select("bone", *(m[r][c].alias(f"m{r}{c}") for r in range(3) for c in range(4)))


def carried(splats: DataFrame, faces: DataFrame | None, reference: DataFrame, edited: DataFrame) -> DataFrame:
    """(sid, x y z, m00..m22, s1, s2): splats that are bound to faces, after the mesh was edited.

    splats: sid, fid, weights b0 b1 b2 of the face's corners, in-plane turn (re, im) and in-plane scales s1 s2; faces: fid and corners (None: splats have their face's corners a, b, c); reference, edited: the
    vertices before and after. A splat keeps its place in the face. Its frame (columns of m) is the edited face's normal and two
    directions in the face: the turn, by as much more as the corners have turned against the first side, corner by corner as they weigh.
    Its scales follow how far the corners have moved from or to the face's centre, along the splat's own directions.
    """
    bound = splats if faces is None else splats.join(faces.select("fid", *CORNERS), "fid")
    both = reference.select("vid", *"xyz").join(edited.select("vid", *(F.col(c).alias(f"e{c}") for c in "xyz")), "vid")
    rows = with_corners(bound, both, ("ex", "ey", "ez"))
    rows = rows.withColumnsRenamed({f"{k}{x}": f"r{k}{x}" for k in CORNERS for x in "xyz"} | {f"{k}e{x}": f"e{k}{x}" for k in CORNERS for x in "xyz"})
    new: dict = {}

    def vector(name: str, v: list) -> list[str]:
        """Keeps a vector as columns, so that later expressions stay short."""
        nonlocal rows
        rows = rows.withColumns({f"__{name}{x}": c for x, c in zip("xyz", v, strict=True)})
        return [f"__{name}{x}" for x in "xyz"]

    at = lambda mark, k: [F.col(f"{mark}{k}{x}") for x in "xyz"]
    least = 1e-12
    for mark in "re":
        mid = vector(f"{mark}m", [(F.col(f"{mark}a{x}") + F.col(f"{mark}b{x}") + F.col(f"{mark}c{x}")) / 3 for x in "xyz"])
        base = vector(f"{mark}base", normalized(sub(at(mark, "a"), at(mark, "b")), least))
        for i, k in enumerate(CORNERS):
            out = vector(f"{mark}out{k}", sub(at(mark, k), mid))
            unit = vector(f"{mark}unit{k}", normalized(out, least))
            side = dot(unit, base)
            rows = rows.withColumns({f"__{mark}angle{k}": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), side if i < 2 else -side))), f"__{mark}far{k}": norm(out)})
    normal = vector("n", normalized(face_normal(*(at("e", k) for k in CORNERS)), least))
    other = vector("other", normalized(cross(normal, ["__ebasex", "__ebasey", "__ebasez"]), least))
    angle = sum((F.col(f"b{i}") * (F.col(f"__eangle{k}") - F.col(f"__rangle{k}")) for i, k in enumerate(CORNERS)), F.lit(0.0))
    size = F.greatest(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), F.lit(least))
    rows = rows.withColumn("__t", angle).withColumns({"__re": (F.col("re") * F.cos("__t") - F.col("im") * F.sin("__t")) / size, "__im": (F.col("re") * F.sin("__t") + F.col("im") * F.cos("__t")) / size})
    first = vector("one", [F.col("__re") * F.col(f"__ebase{x}") + F.col("__im") * F.col(f"__other{x}") for x in "xyz"])
    second = vector("two", [F.col("__re") * F.col(f"__other{x}") - F.col("__im") * F.col(f"__ebase{x}") for x in "xyz"])
    for name, axis in (("s1", first), ("s2", second)):
        parts = []
        for i, k in enumerate(CORNERS):
            unit = [f"__eunit{k}{x}" for x in "xyz"]
            stretch = F.col(f"__efar{k}") / F.col(f"__rfar{k}")
            parts.append(F.col(f"b{i}") * F.sqrt((dot(axis, unit) * stretch) ** 2 + dot(axis, cross(unit, normal)) ** 2))
        new[name] = F.col(name) * (parts[0] + parts[1] + parts[2])
    place = [sum((F.col(f"b{i}") * F.col(f"e{k}{x}") for i, k in enumerate(CORNERS)), F.lit(0.0)).alias(x) for x in "xyz"]
    frame = [F.col(c[r]).alias(f"m{r}{i}") for r in range(3) for i, c in enumerate((normal, first, second))]
    return rows.select("sid", *place, *frame, *(v.alias(k) for k, v in new.items()))


def deformation(faces: DataFrame, vertices: DataFrame, reference: DataFrame, most: float = 2.0) -> DataFrame:
    """(fid, ratio, kept): largest ratio of a corner's distance to its face's centre to that distance in the reference mesh. Faces up to ``most`` are kept."""
    def spans(v: DataFrame) -> DataFrame:
        c = with_corners(faces, v)
        mid = [(F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3 for x in "xyz"]
        return c.select("fid", *(norm(sub([f"{k}{x}" for x in "xyz"], mid)).alias(f"{k}d") for k in "abc"))

    now = spans(vertices)
    then = spans(reference).withColumnsRenamed({f"{k}d": f"{k}r" for k in "abc"})
    # a corner on its reference centre: any distance is beyond every limit, none is no change
    ratio = F.greatest(*(F.when(F.col(f"{k}r") > 0, F.col(f"{k}d") / F.col(f"{k}r")).when(F.col(f"{k}d") > 0, F.lit(float("inf"))) for k in "abc"))
    return now.join(then, "fid").select("fid", ratio.alias("ratio")).withColumn("kept", F.coalesce(F.col("ratio") <= most, F.lit(False)))

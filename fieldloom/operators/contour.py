"""Contours: marching squares, marching cubes, flying edges, finite-element isolines and isosurfaces.

The 256-case triangle table comes from a rule, not from a listing: on each face of the cube, cut edges are joined so
that corners above the isovalue are set apart; the joints chain to loops, and each loop is cut to a fan. The rule
looks at a face's own corners alone, so neighbouring cells agree and surfaces close.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.mesh import HEX
from fieldloom.operators.scan import dense_index
from fieldloom.sources.scratch import materialized

#: Corners of the cube's edges (each from its lower corner) ...
EDGES = [(0, 1), (1, 2), (3, 2), (0, 3), (4, 5), (5, 6), (7, 6), (4, 7), (0, 4), (1, 5), (3, 7), (2, 6)]
#: ... corners of its faces, counter-clockwise seen from outside ...
FACES = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (2, 3, 7, 6), (1, 2, 6, 5), (3, 0, 4, 7)]
#: ... and marching-squares segments by case (edges 0: p0p1, 1: p1p2, 2: p2p3, 3: p3p0; 5 and 10 are saddles).
SEGMENTS = [[], [(3, 0)], [(0, 1)], [(3, 1)], [(1, 2)], [(3, 0), (1, 2)], [(0, 2)], [(3, 2)], [(2, 3)], [(0, 2)], [(0, 1), (2, 3)], [(1, 2)], [(1, 3)], [(0, 1)], [(0, 3)], []]
SQUARE = [(0, 1), (1, 2), (2, 3), (3, 0)]


@cache
def triangles(case: int) -> tuple[tuple[int, int, int], ...]:
    """Triangles of a case (bit c: corner c is above) as edge numbers, counter-clockwise seen from where values are lower."""
    above = [bool(case >> c & 1) for c in range(8)]
    number = {frozenset(e): k for k, e in enumerate(EDGES)}
    follows: dict[int, int] = {}
    for face in FACES:
        for a in range(4):
            if above[face[a]] and not above[face[a - 1]]:  # an edge where the walk rises; the next fall ends the joint
                b = a
                while above[face[(b + 1) % 4]]:
                    b = (b + 1) % 4
                follows[number[frozenset((face[a - 1], face[a]))]] = number[frozenset((face[b], face[(b + 1) % 4]))]
    out, left = [], set(follows)
    while left:
        start = min(left)
        loop, at = [], start
        while at in left:
            left.discard(at)
            loop.append(at)
            at = follows[at]
        out += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
    return tuple(out)


def table_frame(spark: SparkSession) -> DataFrame:
    """(case_id, t, e0, e1, e2): under 1,300 rows."""
    rows = [(c, t, *e) for c in range(256) for t, e in enumerate(triangles(c))]
    return spark.createDataFrame(rows, "case_id int, t int, e0 int, e1 int, e2 int")


def corners(nodes: DataFrame, val: str = "s", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, k, s0 .. s7): each node with the values at its cell's corners, NULL beyond the grid.

    Values are sent to the up to eight cells that need them and meet in one aggregate: one shuffle, linear.
    """
    send = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(r).alias("r")) for r, (a, b, c) in enumerate(HEX)])).alias("o")
    sent = nodes.select(*keys, "i", "j", "k", val, send).select(*keys, (F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j"), (F.col("k") - F.col("o.c")).alias("k"), F.col("o.r").alias("r"), val)
    inside = sent.where("i >= 0 and j >= 0 and k >= 0")
    return inside.groupBy(*keys, "i", "j", "k").agg(*[F.max(F.when(F.col("r") == r, F.col(val))).alias(f"s{r}") for r in range(8)])


def case_of(iso: float, n: int = 8) -> Column:
    """Bit c is set where corner c is above; NULL for an incomplete cell."""
    return sum((F.when(F.col(f"s{c}").isNull(), None).otherwise((F.col(f"s{c}") > iso).cast("int") * (1 << c)) for c in range(n)), F.lit(0))


#: Which corner lies one step along each axis, and a cell edge's axis and owning node.
_ALONG = [1, 3, 4]
_OWNER = [(next(d for d in range(3) if HEX[a][d] != HEX[b][d]), HEX[a]) for a, b in EDGES]


def cut_edges(at: DataFrame, iso: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, axis, i, j, k, t): forward edges that the isovalue cuts, t from the node."""
    tried = F.explode(F.array(*[F.struct(F.lit(d).alias("axis"), F.col(f"s{c}").alias("to")) for d, c in enumerate(_ALONG)])).alias("e")
    e = at.select(*keys, "i", "j", "k", "s0", tried).select(*keys, "i", "j", "k", "s0", "e.axis", "e.to")
    cut = e.where("to is not null").where((F.col("s0") > iso) != (F.col("to") > iso))
    return cut.select(*keys, "axis", "i", "j", "k", ((iso - F.col("s0")) / (F.col("to") - F.col("s0") + 1e-10)).alias("t"))


def flying_edges(nodes: DataFrame, iso: float, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), val: str = "s", mask: DataFrame | None = None, block: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged isosurface of one or more blocks of nodes ([block,] i, j, k, s).

    Points (pt_id, [block,] axis, i, j, k, x, y, z) are numbered by block, axis, k, j, i; triangles (tri_id, v0, v1, v2[, block])
    by block, cell and table order. Cells of ``mask`` ([block,] i, j, k, mask) other than 0 give no triangles; points stay.
    Seams between blocks keep both blocks' points.
    """
    keys = (block,) if block else ()
    at = materialized(corners(nodes, val, keys))  # points and triangles both start from it
    pts = dense_index(cut_edges(at, iso, keys), [*keys, "axis", "k", "j", "i"], "pt_id")
    xyz = [(F.lit(float(origin[d])) + (F.col(n) + F.when(F.col("axis") == d, F.col("t")).otherwise(0.0)) * float(spacing[d])).alias(c) for d, (n, c) in enumerate(zip("ijk", "xyz", strict=True))]
    points = pts.select("pt_id", *keys, "axis", "i", "j", "k", *xyz)
    cells = at.withColumn("case_id", case_of(iso)).where("case_id is not null and case_id not in (0, 255)").select(*keys, "i", "j", "k", "case_id")
    if mask is not None:
        cells = cells.join(mask.where("mask <> 0"), [*keys, "i", "j", "k"], "left_anti")
    tris = cells.join(F.broadcast(table_frame(nodes.sparkSession)), "case_id")  # the table has a fixed size
    tris = dense_index(tris, [*keys, "k", "j", "i", "t"], "tri_id")
    owner = F.array(*[F.struct(F.lit(a).alias("axis"), *[F.lit(o[d]).alias(f"d{d}") for d in range(3)]) for a, o in _OWNER])
    ends = tris.select("tri_id", *keys, "i", "j", "k", F.posexplode(F.array("e0", "e1", "e2")).alias("n", "e")).withColumn("o", F.get(owner, F.col("e")))
    ends = ends.select("tri_id", *keys, "n", F.col("o.axis").alias("axis"), *[(F.col(x) + F.col(f"o.d{d}")).alias(x) for d, x in enumerate("ijk")])
    found = ends.join(points.select("pt_id", *keys, "axis", "i", "j", "k"), [*keys, "axis", "i", "j", "k"])
    out = found.groupBy("tri_id", *keys).agg(*[F.max(F.when(F.col("n") == n, F.col("pt_id"))).alias(f"v{n}") for n in range(3)])
    return points, out


def row_counts(at: DataFrame, iso: float) -> DataFrame:
    """(k, j, x, y, z, tris): cut edges by axis and triangles of each row of nodes."""
    cuts = [F.count_if(F.col(f"s{c}").isNotNull() & ((F.col("s0") > iso) != (F.col(f"s{c}") > iso))).alias(n) for n, c in zip("xyz", _ALONG, strict=True)]
    number = F.array(*[F.lit(len(triangles(c))) for c in range(256)])
    tris = F.sum(F.coalesce(F.get(number, case_of(iso)), F.lit(0))).alias("tris")
    return at.groupBy("k", "j").agg(*cuts, tris)


def marching_cubes(at: DataFrame, iso: float, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Unmerged triangles: (i, j, k, t, n, x, y, z), three rows each."""
    cells = at.withColumn("case_id", case_of(iso)).where("case_id is not null and case_id not in (0, 255)")
    tris = cells.join(F.broadcast(table_frame(at.sparkSession)), "case_id")
    rows = tris.select("i", "j", "k", "t", *[f"s{c}" for c in range(8)], F.posexplode(F.array("e0", "e1", "e2")).alias("n", "e"))
    vals = F.array(*[f"s{c}" for c in range(8)])
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.lit(float(HEX[a][d])).alias(f"p{d}") for d in range(3)], *[F.lit(float(HEX[b][d] - HEX[a][d])).alias(f"q{d}") for d in range(3)]) for a, b in EDGES])
    rows = rows.withColumn("o", F.get(ends, F.col("e"))).withColumns({"sa": F.get(vals, F.col("o.a")), "sb": F.get(vals, F.col("o.b"))})
    rows = rows.withColumn("w", _weight(F.col("sa"), F.col("sb"), iso))
    return rows.select("i", "j", "k", "t", "n", *[(F.lit(float(origin[d])) + (F.col(x) + F.col(f"o.p{d}") + F.col("w") * F.col(f"o.q{d}")) * float(spacing[d])).alias(c) for d, (x, c) in enumerate(zip("ijk", "xyz", strict=True))])


def _weight(a: Column, b: Column, iso: float) -> Column:
    """Where the isovalue lies between two values, clamped; the middle of equal ones."""
    w = F.when(F.abs(b - a) <= 1e-10, 0.5).otherwise((iso - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))


def marching_squares(cells: DataFrame, iso: float) -> DataFrame:
    """(cell_id, s0 .. s3, x0, y0 .. x3, y3) to segments (cell_id, seg, ax, ay, bx, by)."""
    table = F.array(*[F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in s]) if s else F.array().cast("array<array<int>>") for s in SEGMENTS])
    rows = cells.withColumn("case_id", case_of(iso, 4)).where("case_id not in (0, 15)")
    rows = rows.withColumn("segs", F.get(table, F.col("case_id"))).select("*", F.posexplode("segs").alias("seg", "e")).drop("segs")

    def end(k: int, name: str) -> dict[str, Column]:
        e = F.get("e", F.lit(k))
        pick = lambda c, side: F.get(F.array(*[F.col(f"{c}{s[side]}") for s in SQUARE]), e)
        w = _weight(pick("s", 0), pick("s", 1), iso)
        return {f"{name}{c}": pick(c, 0) + w * (pick(c, 1) - pick(c, 0)) for c in "xy"}

    return rows.select("cell_id", "seg", *[c.alias(n) for k, name in enumerate("ab") for n, c in end(k, name).items()])


def square_cells(nodes: DataFrame, val: str = "s") -> DataFrame:
    """Nodes (i, j, s) of a 2-D grid to complete cells (cell_id unset): i, j, s0 .. s3, x0, y0 ..."""
    quad = HEX[:4]
    send = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(r).alias("r")) for r, (a, b, _) in enumerate(quad)])).alias("o")
    sent = nodes.select("i", "j", val, send)
    sent = sent.select((F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j"), F.col("o.r").alias("r"), val)
    got = sent.where("i >= 0 and j >= 0").groupBy("i", "j").agg(*[F.max(F.when(F.col("r") == r, F.col(val))).alias(f"s{r}") for r in range(4)])
    full = got.where(" and ".join(f"s{r} is not null" for r in range(4)))
    return full.withColumns({f"{c}{r}": (F.col(n) + float(o[d])) for r, o in enumerate(quad) for d, (n, c) in enumerate(zip("ij", "xy", strict=True))})


def isolines(values: DataFrame, geometry: DataFrame, n_sub: int, iso: float) -> DataFrame:
    """Finite-element isolines.

    ``values`` (elem, si, sj, v): the field at each element's (n_sub + 1)^2 sub-points; ``geometry`` (elem, x0, y0 .. x3, y3): its
    vertices. An edge is cut where (a >= iso) differs from (b >= iso); cuts pair up in edge order. Segments (elem, si,
    sj, seg, ax, ay, bx, by).
    """
    cells = square_cells_of(values)
    h = 1.0 / n_sub
    lo_r, lo_s = F.col("si") * h, F.col("sj") * h
    pos = [(lo_r, lo_s), (lo_r + h, lo_s), (lo_r + h, lo_s + h), (lo_r, lo_s + h)]
    cuts = []
    for a, b in SQUARE:
        va, vb = F.col(f"v{a}"), F.col(f"v{b}")
        t = (iso - va) / F.when(vb == va, F.lit(1.0)).otherwise(vb - va)
        cuts.append(F.when((va >= iso) != (vb >= iso), F.struct((pos[a][0] + t * (pos[b][0] - pos[a][0])).alias("r"), (pos[a][1] + t * (pos[b][1] - pos[a][1])).alias("s"))))
    rows = cells.withColumn("c", F.filter(F.array(*cuts), lambda x: x.isNotNull())).where("size(c) >= 2")
    rows = rows.select("elem", "si", "sj", "c", F.explode(F.sequence(F.lit(0), (F.size("c") / 2).cast("int") - 1)).alias("seg"))
    rows = rows.withColumns({"a": F.get("c", F.col("seg") * 2), "b": F.get("c", F.col("seg") * 2 + 1)}).join(geometry, "elem")
    from fieldloom.operators.fe import quad_map

    out = [quad_map(c, F.col(f"{e}.r"), F.col(f"{e}.s")).alias(f"{e}{c}") for e in "ab" for c in "xy"]
    return rows.select("elem", "si", "sj", "seg", *out)


def square_cells_of(values: DataFrame) -> DataFrame:
    """(elem, si, sj, v) to sub-cells (elem, si, sj, v0 .. v3)."""
    quad = HEX[:4]
    send = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(r).alias("r")) for r, (a, b, _) in enumerate(quad)])).alias("o")
    sent = values.select("elem", "si", "sj", "v", send).select("elem", (F.col("si") - F.col("o.a")).alias("si"), (F.col("sj") - F.col("o.b")).alias("sj"), F.col("o.r").alias("r"), "v")
    got = sent.where("si >= 0 and sj >= 0").groupBy("elem", "si", "sj").agg(*[F.max(F.when(F.col("r") == r, F.col("v"))).alias(f"v{r}") for r in range(4)])
    return got.where(" and ".join(f"v{r} is not null" for r in range(4)))


def isosurface(values: DataFrame, geometry: DataFrame, n_sub: int, iso: float) -> DataFrame:
    """Finite-element isosurface: (elem, i, j, k, v) at sub-points, cut by marching cubes in each sub-cell and mapped by the
    element's eight vertices (elem, x0, y0, z0 ..). Rows (elem, i, j, k, t, n, x, y, z), three a triangle."""
    from fieldloom.operators.fe import hex_map

    at = corners(values, "v", ("elem",))
    cells = at.withColumn("case_id", case_of(iso)).where("case_id is not null and case_id not in (0, 255)")
    local = _sub_triangles(cells, iso, n_sub).join(geometry, "elem")
    return local.select("elem", "i", "j", "k", "t", "n", *[hex_map(c, F.col("r"), F.col("s"), F.col("q")).alias(c) for c in "xyz"])


def _sub_triangles(cells: DataFrame, iso: float, n_sub: int) -> DataFrame:
    tris = cells.join(F.broadcast(table_frame(cells.sparkSession)), "case_id")
    rows = tris.select("elem", "i", "j", "k", "t", *[f"s{c}" for c in range(8)], F.posexplode(F.array("e0", "e1", "e2")).alias("n", "e"))
    vals = F.array(*[f"s{c}" for c in range(8)])
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.lit(float(HEX[a][d])).alias(f"p{d}") for d in range(3)], *[F.lit(float(HEX[b][d] - HEX[a][d])).alias(f"q{d}") for d in range(3)]) for a, b in EDGES])
    rows = rows.withColumn("o", F.get(ends, F.col("e"))).withColumn("w", _weight(F.get(vals, F.col("o.a")), F.get(vals, F.col("o.b")), iso))
    return rows.select("elem", "i", "j", "k", "t", "n", *[((F.col(x) + F.col(f"o.p{d}") + F.col("w") * F.col(f"o.q{d}")) / float(n_sub)).alias(c) for d, (x, c) in enumerate(zip("ijk", "rsq", strict=True))])



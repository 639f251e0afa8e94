"""Small expressions of meshes, tiles and textures."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cross(ax, ay, az, bx, by, bz, cx, cy, cz) -> tuple[Column, Column, Column]:
    """The product of a triangle's two sides from a: its normal, twice as long as its area."""
    ux, uy, uz, vx, vy, vz = bx - ax, by - ay, bz - az, cx - ax, cy - ay, cz - az
    return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx


def length(x, y, z) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def area_3d(*corners) -> Column:
    return length(*cross(*corners)) / 2


def area_uv(au, av, bu, bv, cu, cv) -> Column:
    return F.abs((bu - au) * (cv - av) - (cu - au) * (bv - av)) / 2


def is_wall(nx, ny, nz, least_horizontal: float = 0.3) -> Column:
    """Degenerate, or so steep that its normal has little of the vertical."""
    size = length(nx, ny, nz)
    return (size == 0) | (F.abs(nz) / size < least_horizontal)


def texel_size(weighted_density) -> Column:
    """Metres a texel; infinite without a density."""
    return F.when(weighted_density > 0, 1 / F.sqrt(weighted_density)).otherwise(F.lit(float("inf")))


def tile_error(is_leaf, texel, child_error, has_mesh, factor: float = 16.0, floor: float = 0.01) -> Column:
    """Leaves have none; others at least a factor of their texel and more than any child; without a mesh twice the child's."""
    own = F.when((texel != float("inf")) & ~F.isnan(texel), texel * factor)
    least = F.greatest(F.coalesce(own, F.lit(0.0)), F.coalesce(child_error, F.lit(0.0)) * 1.01, F.lit(floor))
    return F.when(is_leaf, 0.0).when(~has_mesh, F.greatest(least, F.coalesce(child_error, F.lit(0.0)) * 2)).otherwise(least)


def box_of(lo: list, hi: list, least_half: float = 0.01) -> Column:
    """The 12 numbers of an axis-parallel box: centre and three half axes."""
    half = [F.greatest((b - a) / 2, F.lit(least_half)) for a, b in zip(lo, hi, strict=True)]
    zero = F.lit(0.0)
    return F.array(*((a + b) / 2 for a, b in zip(lo, hi, strict=True)), half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])


def box_range(box, axis: int) -> tuple[Column, Column]:
    c, h = F.get(_c(box), F.lit(axis)), F.abs(F.get(_c(box), F.lit(3 + 4 * axis)))
    return c - h, c + h


def multiple_of_four(n) -> Column:
    """Up to the next multiple, 4 at least."""
    return F.greatest(F.lit(4), (F.ceil(_c(n) / 4) * 4)).cast("int")


def remapped_uv(u, v, x, y, w, h, atlas_w, atlas_h) -> tuple[Column, Column]:
    """A texture's coordinates within an atlas where it lies at (x, y) with size (w, h)."""
    return (x + u * w) / atlas_w, (y + v * h) / atlas_h


def cache_budget_mb(short_side_px, memory_gb) -> Column:
    """Of a viewer's tile cache: phones the least, machines of little memory less."""
    return F.when(_c(short_side_px) < 640, 600).when(F.coalesce(_c(memory_gb), F.lit(8)) <= 4, 1024).otherwise(1536)


def layer_group(kind) -> Column:
    """Which switch a map layer belongs to."""
    return F.when(_c(kind) == "fill-extrusion", "buildings").when(_c(kind) == "symbol", "names")


def is_place_label(kind, layer_id) -> Column:
    return (_c(kind) == "symbol") & (_c(layer_id) != "poi") & ~_c(layer_id).rlike("shield|one_way") & ~_c(layer_id).startswith("poi")

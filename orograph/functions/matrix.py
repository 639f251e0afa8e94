"""4x4 matrices as arrays of 16 numbers, column after column: Column expressions for rows, numpy for single ones on the driver."""

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]


def literal(m) -> Column:
    return F.array(*(F.lit(float(x)) for x in m))


def product(a: Column, b: Column) -> Column:
    """a times b; a null factor counts as the identity."""
    a, b = (F.coalesce(m, literal(IDENTITY)) for m in (a, b))
    return F.array(*(sum((F.get(a, F.lit(k * 4 + r)) * F.get(b, F.lit(c * 4 + k)) for k in range(1, 4)), F.get(a, F.lit(r)) * F.get(b, F.lit(c * 4))) for c in range(4) for r in range(4)))


def apply(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(F.get(m, F.lit(r)) * x + F.get(m, F.lit(4 + r)) * y + F.get(m, F.lit(8 + r)) * z + F.get(m, F.lit(12 + r)) for r in range(3))


def y_up_to_z_up(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, -z, y


def z_up_to_y_up(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, z, -y


def as_numpy(m) -> np.ndarray:
    return np.array(m, float).reshape(4, 4).T


def as_list(m: np.ndarray) -> list[float]:
    return m.T.reshape(-1).tolist()


def trs(translation=(0, 0, 0), rotation=(0, 0, 0, 1), scale=(1, 1, 1)) -> list[float]:
    """From a translation, a quaternion (x, y, z, w) and a scale."""
    x, y, z, w = rotation
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    m = np.eye(4)
    m[:3, :3] = turn * np.array(scale, float)
    m[:3, 3] = translation
    return as_list(m)


def tilt(east: float, north: float) -> list[float]:
    """The turn that takes the normal (east, north, 1) to the vertical, about the horizontal axis between them (Rodrigues); the identity if
    they are the same. The two numbers are the residual plane's (terrain less mesh), so they are the negative of the mesh's own slopes, and the turn levels it."""
    normal = np.array([east, north, 1.0])
    normal /= np.linalg.norm(normal)
    axis = np.cross(normal, [0.0, 0.0, 1.0])
    sine = float(np.linalg.norm(axis))
    m = np.eye(4)
    if sine >= 1e-12:
        k = axis / sine
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        m[:3, :3] += sine * cross + (1 - float(normal[2])) * cross @ cross
    return as_list(m)


def georeference(frame, up_axis, spin_degrees: float, scale: float, offset, slopes, pivot: float) -> list[float]:
    """A model's root matrix: its axes to z up, levelled about the pivot height, the offset, the grid's scale and convergence, then the frame."""
    move = lambda x, y, z: as_numpy(trs((x, y, z)))
    a = math.radians(spin_degrees) / 2
    spin = as_numpy(trs(rotation=(0, 0, math.sin(a), math.cos(a))))
    level = move(0, 0, pivot) @ as_numpy(tilt(*slopes)) @ move(0, 0, -pivot)
    chain = as_numpy(frame) @ spin @ as_numpy(trs(scale=(scale, scale, 1))) @ move(*offset) @ level
    return as_list(chain @ as_numpy([1, 0, 0, 0, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1] if up_axis == "y" else IDENTITY))

"""Recursive cuts of a page into columns and bands."""

from __future__ import annotations

import numpy as np

MAX_EXTENT = 1_000_000


class ExtentError(ValueError):
    """A coordinate asks for a longer histogram than allowed."""


def profile(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """How many intervals cover each integer; absolute values, clamped to the extent."""
    least = min(lows.min(), highs.min())
    extent = int(-least if least < 0 else max(lows.max(), highs.max()))
    if extent > MAX_EXTENT:
        raise ExtentError(f"extent {extent} is above {MAX_EXTENT}")
    a = np.minimum(np.abs(lows), extent)
    b = np.maximum(np.minimum(np.abs(highs), extent), a)
    edges = np.bincount(a, minlength=extent + 1) - np.bincount(b, minlength=extent + 1)
    return np.cumsum(edges)[:extent]


def segments(values: np.ndarray, min_value: int = 0, min_gap: int = 1) -> list[tuple[int, int]]:
    """Runs above min_value that gaps wider than min_gap part. Inner runs end at their last index, the last one after it."""
    at = np.flatnonzero(np.asarray(values) > min_value)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > min_gap)
    starts = [int(at[0]), *at[cut + 1].tolist()]
    ends = [*at[cut].tolist(), int(at[-1]) + 1]
    return list(zip(starts, ends))


def recursive_cut(boxes: np.ndarray, by_columns: bool) -> list[int]:
    """Order of boxes (n, 4): columns, then bands in them (by_columns), or bands, then columns; a part that the second cut leaves whole is put out, others are cut anew.

    Columns go from right to left if a left edge is negative. A box that lies in no segment is left out.
    """
    boxes = np.asarray(boxes, np.int64).reshape(-1, 4)
    out: list[int] = []
    todo = [np.arange(len(boxes))]
    first, second = (0, 1) if by_columns else (1, 0)

    def split(ids: np.ndarray, axis: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        ids = ids[np.argsort(boxes[ids, axis], kind="stable")]
        found = segments(profile(boxes[ids, axis], boxes[ids, axis + 2]))
        return ids, found[::-1] if axis == 0 and (boxes[ids, 0] < 0).any() else found

    def members(ids: np.ndarray, axis: int, segment: tuple[int, int]) -> np.ndarray:
        low = boxes[ids, axis]
        low = np.abs(low) if axis == 0 else low
        return ids[(low >= segment[0]) & (low < segment[1])]

    while todo:
        ids = todo.pop()
        if isinstance(ids, list):
            out += ids
            continue
        if not len(ids):
            continue
        later: list = []
        ids, outer = split(ids, first)
        for segment in outer:
            part = members(ids, first, segment)
            if not len(part):
                continue
            part, inner = split(part, second)
            if len(inner) == 1:
                later.append(part.tolist())
            else:
                later += [members(part, second, s) for s in inner]
        todo += later[::-1]
    return out

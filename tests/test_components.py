"""Components of pixels: tiles joined at once, and what goes on across their borders."""

from __future__ import annotations

import random

import pytest

from traceframe.operators import matching as M


def plain(rows: set[tuple], diagonal: bool) -> dict[tuple, tuple]:
    out: dict[tuple, tuple] = {}
    for start in sorted(rows):
        todo = [start] if start not in out else []
        while todo:
            m, x, y = at = todo.pop()
            if at in out or at not in rows:
                continue
            out[at] = start
            steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if diagonal or dx * dy == 0]
            todo += [(m, x + dx, y + dy) for dx, dy in steps]
    return out


def labelled(spark, rows, **options) -> list[tuple]:
    p = spark.createDataFrame(rows, "mask_id BIGINT, x INT, y INT, grey INT")
    c = M.pixel_components(p, ["mask_id"], keep=["grey"], **options)
    return [(r["mask_id"], r["x"], r["y"], r["grey"], tuple(r["component"])) for r in c.collect()]


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [1, 3, 7, 256])
def test_components_at_any_tile(spark, diagonal, tile):
    rng = random.Random(tile)
    rows = {(m, rng.randrange(-9, 12), rng.randrange(-9, 12)) for m in range(3) for _ in range(120 + 90 * m)}
    want = plain(rows, diagonal)
    got = labelled(spark, [(*r, i) for i, r in enumerate(sorted(rows))], diagonal=diagonal, tile=tile)
    assert sorted(got) == sorted((*r, i, want[r]) for i, r in enumerate(sorted(rows)))


def test_small_masks_need_no_rounds(spark, monkeypatch):
    """A snake through one tile is settled in its task."""

    def refused(*_):
        raise AssertionError("rounds over pixels")

    monkeypatch.setattr(M, "connected_components", refused)
    snake = [(5, x, y, 0) for x in range(41) for y in (range(41) if x % 2 == 0 else [0] if x % 4 == 1 else [40])]
    assert {r[4] for r in labelled(spark, snake)} == {(5, 0, 0)}


def test_repeated_and_unplaced_pixels(spark):
    """Each row stays one row; without a mask or a place a pixel touches nothing."""
    rows = [(1, 0, 0, 1), (1, 0, 0, 2), (1, 0, 1, 3), (1, None, 1, 4), (1, None, 2, 5), (None, 0, 0, 6), (None, 0, 1, 7), (1, 0, None, 8)]
    got = {r[3]: r[4] for r in labelled(spark, rows, tile=2)}
    assert got == {1: (1, 0, 0), 2: (1, 0, 0), 3: (1, 0, 0), 4: (1, None, 1), 5: (1, None, 2), 6: (None, 0, 0), 7: (None, 0, 1), 8: (1, 0, None)}

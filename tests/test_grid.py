import json

import pytest

from sheetwise.operators import closure, grid, units
from sheetwise.sources.artifacts import snapshots

from .test_units import ROWS, row

ONE = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
SHEAR = [1, 0.25, 0, 3, 0, 1, 0, -2, 0, 0, 1, 0, 0, 0, 0, 1]
STRETCH = [2, 0, 0, 0, 0, 0.5, 0, 7, 0, 0, 1, 1, 0, 0, 0, 1]
QUARTER = [0, 1, 0, -4, -1, 0, 0, 6, 0, 0, 1, 0, 0, 0, 0, 1]


def read(spark, path, geometry):
    (path / "job").mkdir()
    blocks = [{"handle": h, "name": n} for h, n in (("a1", "B"), ("a2", "MID"), ("a3", "IN"))]
    (path / "job" / "snapshot.json").write_text(json.dumps({"geometry": geometry, "blocks": blocks}))
    return snapshots(spark, f"{path}/job/snapshot.json")


def ref(handle, block, definition, matrix):
    return {"handle": handle, "type": "AcDbBlockReference", "block": block, "shape": {"definition": definition, "matrix": matrix}}


def slow(geometry, names):
    """All edges by walking every way down, one reference and one point at a time."""

    def at(m, p):
        x, y, z = (*p, 0)[:3]
        return tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3))

    def edges(block):
        out = [((*g["a"], 0.0)[:3], (*g["b"], 0.0)[:3]) for g in geometry if g["type"] == "AcDbLine" and g["block"] == block]
        for g in geometry:
            if g["type"] == "AcDbBlockReference" and g["block"] == block:
                out += [tuple(at(g["shape"]["matrix"], p) for p in e) for e in edges(names[g["shape"]["definition"].lower()])]
        return out

    return sorted((block, *a[:2], *b[:2]) for block in set(names.values()) for a, b in edges(block))


def test_a_child_of_two_parents_over_three_levels(spark, tmp_path):
    """IN stands in MID and, turned, in B itself; MID stands twice in B, once stretched."""
    line = lambda h, block, a, b: {"handle": h, "type": "AcDbLine", "block": block, "a": a, "b": b}
    geometry = [line("1", "IN", [0, 0], [0, 5]), line("2", "IN", [1, 1, 2], [6, 1, 2]), line("3", "MID", [-3, 4], [9, 4]), line("4", "B", [0, 0], [8, 0])]
    geometry += [ref("r1", "MID", "A3", SHEAR), ref("r2", "B", "a2", ONE), ref("r3", "B", "A2", STRETCH), ref("r4", "B", "a3", QUARTER)]
    names = {"a1": "B", "a2": "MID", "a3": "IN"}
    flat = grid.expanded(read(spark, tmp_path, geometry)).collect()
    assert sorted((r.block, *r.a[:2], *r.b[:2]) for r in flat) == slow(geometry, names)
    assert len(flat) == 2 + (1 + 2) + (1 + 2 * 3 + 2)


def test_turned_lines_part_texts(spark, tmp_path):
    """A level line of a nested block, turned upright between two texts, keeps them apart."""
    edge = {"handle": "e", "type": "AcDbLine", "block": "IN", "a": [-6, 14.5], "b": [6, 14.5]}
    lines = grid.barriers(read(spark, tmp_path, [edge, ref("r1", "MID", "A3", ONE), ref("r2", "B", "A2", QUARTER)]))
    got = sorted((r.block, r.kind, r["at"]) for r in lines.collect())
    assert got == [("B", "vertical", 10.5), ("IN", "horizontal", 14.5), ("MID", "horizontal", 14.5)]
    texts = spark.createDataFrame([row(0, 0, 0, "left"), row(1, 11, 0, "right")], ROWS)
    assert sorted(tuple(r.members) for r in units.build_units(texts).collect()) == [(0, 1)]
    assert sorted(tuple(r.members) for r in units.build_units(texts, lines).collect()) == [(0,), (1,)]


def test_levels_of_a_graph_with_a_million_ways(spark, tmp_path):
    """Twenty diamonds in a row have 2 ** 20 ways down; levels and cycles take the edges only. One more edge makes a cycle below a tail."""
    edges = [(f"n{i}", f"n{i + 1}{side}") for i in range(20) for side in "lr"] + [(f"n{i + 1}{side}", f"n{i + 1}") for i in range(20) for side in "lr"]
    ddl = "parent string, child string"
    levels, loops = closure.peel(spark.createDataFrame(edges, ddl))
    assert [sorted(r.parent for r in x.collect()) for x in levels] == [x for i in range(19, -1, -1) for x in ([f"n{i + 1}l", f"n{i + 1}r"], [f"n{i}"])]
    assert loops.isEmpty()
    levels, loops = closure.peel(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("s", "s")], ddl))
    assert [[r.parent for r in x.collect()] for x in levels] == [["d"]] and {r.parent for r in loops.collect()} == {"a", "b", "c", "s"}
    geometry = [ref(f"r{i}{k}", f"D{i}", f"d{i + 1}", ONE) for i in range(20) for k in "ab"]
    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "snapshot.json").write_text(json.dumps({"geometry": geometry, "blocks": [{"handle": f"d{i}", "name": f"D{i}"} for i in range(21)]}))
    assert grid.expanded(snapshots(spark, f"{tmp_path}/job/snapshot.json")).isEmpty()


def test_lines_closed_polylines_and_hidden_ones(spark, tmp_path):
    square = {"handle": "s", "type": "AcDbPolyline", "block": "B", "shape": {"closed": True, "vertices": [[0, 0], [4, 0], [4, 3], [0, 3]]}}
    line = {"handle": "l", "type": "AcDbLine", "block": "B", "a": [9, 0], "b": [9, 5, 1]}
    hidden = {"handle": "h", "type": "AcDbLine", "block": "B", "visible": False, "shape": {"a": [7, 0], "b": [7, 5]}}
    got = {(r.kind, r["at"]) for r in grid.barriers(read(spark, tmp_path, [square, line, hidden])).collect()}
    assert got == {("horizontal", 0.0), ("horizontal", 3.0), ("vertical", 0.0), ("vertical", 4.0), ("vertical", 9.0)}


@pytest.mark.parametrize("geometry", [[ref("r", "B", "a2", ONE[:15])], [ref("r", "B", "a2", ONE), ref("q", "MID", "a1", ONE)]])
def test_bad_matrix_and_cycle(spark, tmp_path, geometry):
    with pytest.raises(ValueError):
        grid.expanded(read(spark, tmp_path, geometry))

import copy
import json

from pyspark.sql import functions as F

from sheetwise.operators import binding, contracts, diff, evidence
from sheetwise.sources import artifacts, schemas, sinks

HASH_A, HASH_B = "a" * 64, "b" * 64


def snapshot():
    rows = [
        {"handle": "1a", "kind": "TEXT", "slot": "text", "raw": "阀门 C30", "block": "Model", "height": 2.5, "rotation": 0, "layer": "0", "style": "S", "color": 7, "position": [0, 0, 0], "box": [0, 0, 10, 2]},
        {"handle": "1B", "kind": "TEXT", "slot": "text", "raw": "P-101", "block": "Model", "height": 2.5, "rotation": 0, "layer": "0", "style": "S", "color": 7, "position": [50, 0, 0], "box": [50, 0, 53, 2]},
        {"handle": "2C", "kind": "TABLE", "slot": "0,1,0", "row": 0, "column": 1, "contentIndex": 0, "raw": "x", "block": "Model", "height": 2.5, "rotation": 0, "layer": "0", "style": "S", "color": 7, "position": [0, 90, 0], "box": [0, 90, 5, 92]},
    ]
    for r in rows:
        r["worldBoxes"] = [{"root": "Model", "instancePath": ["B1"], "box": r["box"]}]
    return {
        "schemaVersion": 1, "tableIndexBase": 0, "sourceSha256": HASH_A, "cadInputSha256": HASH_B, "worldBoxCoverage": "complete", "rows": rows,
        "blocks": [{"handle": "B1", "name": "Model", "layout": True, "origin": [0, 0, 0], "entities": 5}, {"handle": "B2", "name": "*U3", "layout": False, "origin": [0, 0, 0], "entities": 1}],
        "geometry": [{"handle": "G1", "type": "AcDbCircle", "block": "Model", "layer": "0", "color": 1, "visible": True, "shape": {"center": [51.5, 1, 0], "radius": 3.0, "normal": [0, 0, 1]}}, {"handle": "G2", "type": "AcDbLine", "block": "*U3", "layer": "0", "color": 1, "visible": True, "shape": {"a": [0, 0.1, 0], "b": [1, 1, None], "n": 3, "e": {}}}],
        "instances": [{"path": "B1/9", "block": "*U3", "matrix": [1.0, 0.0], "origin": [0, 0], "bounds": [0, 0, 1, 1]}],
        "styles": [{"name": "S", "font": "a.shx", "bigFont": "", "width": 1.0}], "layouts": [], "coverageIssues": [],
    }


def edit(handle, raw, action, kind="TEXT", slot="text", **more):
    return {"handle": handle, "kind": kind, "slot": slot, "expectedRaw": raw, "action": action, "verificationIssues": [], "protectedValues": [], **more}


def mapping():
    return {
        "schemaVersion": 1, "tableIndexBase": 0, "mode": "replace", "sourceLanguage": "zh", "targetLanguage": "en", "sourceSha256": HASH_A, "cadInputSha256": HASH_B, "scope": {"sheetIds": ["s1"], "coverageResolutions": []},
        "edits": [edit("1A", "阀门 C30", "replace", target="Valve C30", protectedValues=["C30", {"source": "阀门", "target": "Valve"}]), edit("1b", "P-101", "retain", retainReason="tag"), edit("2C", "x", "replace", "TABLE", "0,1,0", row=0, column=1, contentIndex=0, target="y")],
        "reflows": [], "additions": [],
    }


def load(spark, tmp_path, value, schema, name):
    p = tmp_path / "job1"
    p.mkdir(exist_ok=True)
    (p / name).write_text("﻿" + json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return artifacts.read_json(spark, str(p / name), schema)


def with_edit(change):
    m = mapping()
    change(m)
    return m


def bilingual(**first):
    m = mapping()
    m["mode"] = "bilingual"
    for e in m["edits"]:
        e.update(action="retain", needsTranslation=False, target=e["expectedRaw"])
    m["edits"][0].update(needsTranslation=True, retainReason="existing-bilingual", counterpartKeys=[["2c", "0,1,0"]], counterpartComplete=True, counterpartMeaning="valve")
    m["edits"][0].update(first)
    return m


def cases():
    """(source, mapping, rules that must break, whether no other may)."""
    out = [(snapshot(), mapping(), set(), True)]
    single = [
        ("V01", lambda m: m.update(schemaVersion=2)),
        ("V02", lambda m: m.update(sourceSha256=HASH_B)),
        ("V03", lambda m: m.update(mode="other")),
        ("V04", lambda m: m.update(targetLanguage="zh")),
        ("V07", lambda m: m["edits"].pop()),
        ("V07", lambda m: m["edits"].append(m["edits"][0])),
        ("V33", lambda m: m["edits"][0].update(expectedRaw="other")),
        ("V34", lambda m: m["edits"][0].update(verificationIssues=["?"])),
        ("V36", lambda m: m["edits"][2].update(column=0)),
        ("V47", lambda m: m["edits"][0].update(target="\u3000 ", protectedValues=[])),
        ("V48", lambda m: m["edits"][0].update(target="Valve C300")),
        ("V49", lambda m: m["edits"][1].pop("retainReason")),
        ("V51", lambda m: m["edits"][1].update(action="burn")),
    ]
    out += [(snapshot(), with_edit(change), {rule}, False) for rule, change in single]

    m = mapping()  # reflows
    for e in m["edits"][:2]:
        e.update(action="reflow-member", reflowGroup="g")
    m["reflows"] = [{"group": "g", "sourceHandles": ["1A", "1B"], "block": "Model", "target": "Valve C30 P-101", "protectedValues": ["C30"], "verificationIssues": [], "layoutPlan": {"region": [0, 0, 9, 9], "width": 5}}]
    plain = snapshot()
    plain["geometry"].pop(0)
    out += [(plain, m, set(), True), (snapshot(), m, {"V10"}, True)]
    m = copy.deepcopy(m)
    m["reflows"].append({**m["reflows"][0], "sourceHandles": ["1A", "77"], "target": "C300"})
    out.append((plain, m, {"V09", "V16", "V17", "V19"}, False))

    long = copy.deepcopy(plain)  # a note's column
    long["rows"][0].update(kind="MTEXT", raw="a long note of several lines\\Pthat is longer than forty characters", box=[0, 0, 40, 9])
    for width, broken in ((40.0, set()), (41.0, {"V20"})):
        m = mapping()
        m["edits"][0].update(kind="MTEXT", expectedRaw=long["rows"][0]["raw"], action="reflow-member", reflowGroup="g", protectedValues=[])
        m["reflows"] = [{"group": "g", "sourceHandles": ["1a"], "block": "Model", "target": "t", "verificationIssues": [], "layoutPlan": {"region": [0, 0, 90, 9], "width": width}}]
        out.append((long, m, broken, True))

    m = bilingual(retainReason=None, counterpartKeys=None, target=None)  # additions
    place = {"position": [1, 1, 0], "rotation": 0, "width": 5, "height": 3, "region": [0, 0, 10, 10], "minReadableHeight": 2}
    m["additions"] = [{"id": "a", "sourceKeys": [["1a", "text"]], "block": "Model", "properties": "1a", "target": "Valve C30", "placement": place, "protectedValues": ["C30"], "verificationIssues": []}]
    out.append((snapshot(), m, set(), True))
    m = copy.deepcopy(m)
    m["additions"] += [{**m["additions"][0], "block": "Other", "placement": {**place, "position": [50, 1, 0], "height": 1}}]
    out.append((snapshot(), m, {"V21", "V25", "V26", "V28", "V31", "V32"}, False))

    v, m = snapshot(), mapping()  # coverage
    v["coverageIssues"] = [{"type": "missing-text-bounds", "handle": "1B"}, {"type": "unreadable-custom-or-image", "handle": "G9"}]
    out.append((copy.deepcopy(v), copy.deepcopy(m), {"CR1"}, True))
    v["rows"][1].update(raw="I")
    v["geometry"].append({"handle": "G9", "type": "AcDbZombieEntity", "block": "Model", "shape": {"OriginalClassName": "TH_ParaBasePntUA", "HasFields": False, "XData": [None, ""]}})
    m["edits"][1].update(handle="1B", expectedRaw="I", target="I")
    m["scope"]["coverageResolutions"] = [{"type": "missing-text-bounds", "handle": "1B", "reason": "unchanged-ascii-degenerate"}, {"type": "unreadable-custom-or-image", "handle": "G9", "reason": "preserved-proxy-graphics"}]
    out.append((copy.deepcopy(v), copy.deepcopy(m), set(), True))
    v["geometry"][-1]["shape"]["HasFields"] = True
    m["scope"]["coverageResolutions"][0]["reason"] = "other"
    out.append((v, m, {"CR2", "CR3"}, True))

    inline = {"retainReason": "existing-bilingual-inline", "inlineSource": "阀门", "inlineTarget": "C30"}  # counterparts
    out += [
        (snapshot(), bilingual(), set(), True),
        (snapshot(), bilingual(counterpartKeys=[["1a", "text"]]), {"V45", "V46"}, True),
        (snapshot(), bilingual(**inline), set(), True),
        (snapshot(), bilingual(**{**inline, "inlineTarget": "门"}), {"V42"}, True),
    ]
    v = snapshot()
    v["rows"][1]["worldBoxes"] = []
    v.pop("worldBoxCoverage")
    out.append((v, bilingual(needsTranslation=False), {"V40", "PR1", "PR3"}, True))
    return out


def write(folder, **documents):
    """The documents as JSON files with a byte order mark."""
    folder.mkdir(parents=True)
    for name, value in documents.items():
        (folder / f"{name}.json").write_text("\ufeff" + json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_mappings(spark, tmp_path):
    """All cases as jobs of one validation."""
    known = cases()
    for i, (v, m, _, _) in enumerate(known):
        write(tmp_path / f"case{i:02d}", extracted=v, mapping=m)
    found = contracts.validate(artifacts.snapshots(spark, f"{tmp_path}/*/extracted.json"), artifacts.mappings(spark, f"{tmp_path}/*/mapping.json"))
    got = {}
    for r in found.collect():
        got.setdefault(r.job_id, set()).add(r.rule)
    wrong = {}
    for i, (_, _, want, only) in enumerate(known):
        have = got.get(f"case{i:02d}", set())
        if not want <= have or only and have != want:
            wrong[i] = (want, have)
    assert not wrong


def test_joined_text(spark):
    from sheetwise.operators import members

    ddl = "g int, place int, block string, raw string, visibleText string, kind string, rotation double, height double, box array<double>, position array<double>"
    rows = [(1, 0, "B", "C3", None, "TEXT", 0.0, 2.0, [0.0, 0.0, 5.0, 2.0], None), (1, 1, "B", "0", None, "TEXT", 0.0, 2.0, [5.5, 0.1, 7.0, 2.0], None), (1, 2, "B", "far", None, "TEXT", 0.0, 2.0, [50.0, 0.0, 55.0, 2.0], None), (2, 0, "B", "a", "v", "TEXT", 0.0, 2.0, None, None)]
    got = {r.g: r.source for r in members.joined_text(spark.createDataFrame(rows, ddl), ["g"]).collect()}
    assert got == {1: "C30\nfar", 2: "v"}


def test_circles(spark, tmp_path):
    s = load(spark, tmp_path, snapshot(), schemas.SNAPSHOT, "extracted.json")
    found = binding.circled(artifacts.section(s, "rows"), artifacts.section(s, "geometry")).collect()
    assert [(r.handle, r.r) for r in found] == [("1B", 3.0)]


def changed(change):
    v = snapshot()
    v["rows"][0]["raw"], v["rows"][2]["raw"] = "Valve C30", "y"
    change(v)
    return v


CHANGES = [
    (None, lambda v: None),
    (None, lambda v: (v["blocks"][1].update(name="*U9"), v["geometry"][1].update(block="*U9"), v["instances"][0].update(block="*U9", bounds=[9, 9, 9, 9]))),
    (None, lambda v: v["geometry"][1]["shape"]["a"].__setitem__(1, 0.1 + 1e-16)),
    ("GD12", lambda v: v["geometry"][1]["shape"]["a"].__setitem__(1, 0.1001)),
    ("GD12", lambda v: v["geometry"][1]["shape"].pop("e")),
    ("GD12", lambda v: v["geometry"][1]["shape"].update(n=4)),
    ("GD12", lambda v: v["geometry"][1]["shape"]["b"].__setitem__(2, 0)),
    ("GD1", lambda v: v["blocks"].pop()),
    ("GD4", lambda v: v["blocks"][1].update(name="Named")),
    ("GD6", lambda v: v["blocks"][0].update(entities=6)),
    ("GD8", lambda v: v["geometry"].pop()),
    ("GD10", lambda v: v["geometry"][0].update(layer="other")),
    ("GD14", lambda v: v["instances"][0].update(matrix=[2.0, 0.0])),
    (None, lambda v: v["styles"][0].update(font="b.shx")),
    ("SC1", lambda v: v["rows"][1].update(raw="P-102")),
    ("SC4", lambda v: v["rows"][0].update(raw="Valve")),
    ("SC26", lambda v: v["rows"].append({**v["rows"][0], "handle": "FF"})),
    ("SC28", lambda v: v["rows"][1].update(box=[60, 0, 63, 2])),
    (None, lambda v: v["rows"][1].update(handle="1b")),
    ("GD10", lambda v: v["geometry"][0].update(linetype="dashed")),
    ("GD10", lambda v: v["geometry"][0].update(note=None)),
    ("GD10", lambda v: v["geometry"][0].pop("color")),
    (None, lambda v: v["geometry"][0].update(color=1.0)),
    ("GD9", lambda v: v["geometry"][0].update(block="*U3")),
    ("GD9", lambda v: v["geometry"][0].pop("block")),
    ("GD14", lambda v: v["instances"][0].update(columns=2)),
    ("GD14", lambda v: v["instances"][0].update(origin=None)),
]


def test_saved_snapshots(spark, tmp_path):
    """All changes of a saved snapshot as jobs of one comparison."""
    for i, (_, change) in enumerate(CHANGES):
        write(tmp_path / f"case{i:02d}", extracted=snapshot(), mapping=mapping(), saved=changed(change), status={"schemaVersion": 1, "additions": [], "reflows": []})
    s, v = (artifacts.snapshots(spark, f"{tmp_path}/*/{n}.json") for n in ("extracted", "saved"))
    m, r = artifacts.mappings(spark, f"{tmp_path}/*/mapping.json"), artifacts.read_json(spark, f"{tmp_path}/*/status.json", schemas.RECEIPT)
    got = {}
    for x in [*diff.geometry_diff(s, v, m).collect(), *diff.content_diff(s, m, v, r).collect()]:
        got.setdefault(x.job_id, set()).add(x.rule)
    wrong = {}
    for i, (rule, _) in enumerate(CHANGES):
        have = got.get(f"case{i:02d}", set())
        if (rule not in have) if rule else have:
            wrong[i] = (rule, have)
    assert not wrong


def test_attributes_that_no_schema_names(spark, tmp_path):
    """Geometry in a block that neither side knows, extra attributes on both sides, and styles that differ in more than their fields."""

    def both(mode, before, after):
        s, m, v, r = generated("bilingual") if mode == "bilingual" else (snapshot(), mapping(), changed(lambda v: None), {"schemaVersion": 1, "additions": [], "reflows": []})
        before(s)
        before(v)
        after(v)
        return {"extracted": s, "mapping": m, "saved": v, "status": r}

    lost = lambda x: x["geometry"][0].update(block="nowhere")
    free = lambda x: x["geometry"][0].pop("block")
    more = lambda x: x["geometry"][0].update(extra={"b": [1, {"c": None}], "a": 2.0})
    angle = lambda x: x["styles"][0].update(obliquing=0)
    cases = [
        ({"GD9"}, "replace", lost, lambda v: None), (set(), "replace", free, lambda v: None), (set(), "replace", more, lambda v: v["geometry"][0].update(extra={"a": 2, "b": [1, {"c": None}]})),
        ({"GD10"}, "replace", more, lambda v: v["geometry"][0]["extra"]["b"][1].clear()), ({"GD10"}, "replace", more, lambda v: v["geometry"][0]["extra"].update(a=2.0000001)),
        (set(), "bilingual", angle, lambda v: v["styles"][0].update(obliquing=0.0)), ({"SC8"}, "bilingual", angle, lambda v: v["styles"][0].update(obliquing=15)), ({"SC8"}, "bilingual", angle, lambda v: v["styles"][0].pop("obliquing")),
    ]
    for i, (_, mode, before, after) in enumerate(cases):
        write(tmp_path / f"case{i:02d}", **both(mode, before, after))
    got = differences(spark, tmp_path)
    assert [got.get(f"case{i:02d}", set()) for i in range(len(cases))] == [c[0] for c in cases]


def test_circled_label_as_a_joined_text_of_its_own(spark, tmp_path):
    """The label is found by the receipt's handle, in any case of letters."""
    for i, box in enumerate(([50, 0, 53, 2], [60, 0, 63, 2])):
        s, m, v = snapshot(), mapping(), changed(lambda v: None)
        m["edits"][1].update(action="reflow-member", reflowGroup="g1")
        m["reflows"] = [{"group": "g1", "sourceHandles": ["1b"], "block": "Model", "target": "P-101", "minReadableHeight": 2.0, "layoutPlan": {"region": [0, 0, 99, 99]}}]
        v["rows"][1].update(handle="F7", box=box)
        write(tmp_path / f"case{i:02d}", extracted=s, mapping=m, saved=v, status={"schemaVersion": 1, "additions": [], "reflows": [{"group": "g1", "handle": "f7"}]})
    assert differences(spark, tmp_path) == {"case01": {"SC28"}}


def test_saved_folder_belongs_to_its_job(spark, tmp_path):
    write(tmp_path / "job9", extracted=snapshot())
    write(tmp_path / "job9" / "saved", extracted=snapshot())
    assert {r.job_id for n in ("job9/extracted.json", "job9/saved/extracted.json") for r in artifacts.snapshots(spark, f"{tmp_path}/{n}").collect()} == {"job9"}


def test_equal_records_are_not_taken_apart(spark):
    """Work on nodes follows the records that differ: one of a thousand."""
    rows = spark.range(1000).select("id", F.parse_json(F.concat(F.lit('{"b": [1, 2, {"c": '), "id", F.lit('}], "a": {}}'))).alias("v"))
    other = spark.range(1000).select("id", F.parse_json(F.concat(F.lit('{"a": {}, "b": [1, 2, {"c": '), F.when(F.col("id") == 7, 0).otherwise(F.col("id")), F.lit("}]}"))).alias("v"))
    seen = []
    whole = diff.leaves
    try:
        diff.leaves = lambda df, *a: (seen.append(df.count()), whole(df, *a))[1]
        got = diff.unequal_shapes(rows, other, ["id"], "v").collect()
    finally:
        diff.leaves = whole
    assert [(r.id, r.path.split(diff.STEP)) for r in got] == [(7, ["", "b", "2", "c"])] and seen == [2]


def test_review(spark, tmp_path):
    folder = tmp_path / "pics"
    folder.mkdir()
    (folder / "a.png").write_bytes(artifacts.PNG_SIGNATURE + b"0" * 600)
    (folder / "b.png").write_bytes(b"0" * 600)
    pics = artifacts.files(spark, str(folder)).select(F.lit("job1").alias("job_id"), F.regexp_extract("path", "[^/]+$", 0).alias("name"), "sha256", "is_png")
    m = load(spark, tmp_path, mapping(), schemas.MAPPING, "mapping.json")
    tasks, candidates = spark.createDataFrame([("job1", HASH_A)], "job_id string, sourceSha256 string"), spark.createDataFrame([("job1", "c")], "job_id string, candidateSha256 string")
    broken = lambda review: {r.rule for r in evidence.review_rules(load(spark, tmp_path, review, schemas.REVIEW, "r.json"), tasks, candidates, m, pics).collect()}
    good = {"sourceSha256": HASH_A, "candidateSha256": "c", "translationReviewed": True, "symbolsReviewed": True, "issues": [], "sheets": [{"id": "s1", "reviewed": True, "sourceImage": "a.png", "candidateImage": "a.png", "denseRegions": [{"sourceImage": "a.png", "candidateImage": "a.png"}]}]}
    assert broken(good) == set()
    assert broken({**good, "candidateSha256": "d"}) == broken({**good, "sourceSha256": HASH_B}) == broken({k: v for k, v in good.items() if k != "candidateSha256"}) == {"RV1"}
    assert broken({k: v for k, v in good.items() if k != "issues"}) == broken({**good, "issues": None}) == broken({**good, "issues": ["open"]}) == {"RV2"}
    good["sheets"][0].update(candidateImage="b.png", sourceImage="c.png", denseRegions=[])
    good["sheets"].append({**good["sheets"][0], "id": "s9"})
    good.update(symbolsReviewed=False, sourceSha256=HASH_B)
    assert broken(good) == {"RV1", "RV2", "RV4", "RV5", "RV6", "RV7"}


def test_delivery_is_numbered_and_checked(spark, tmp_path):
    (tmp_path / "c.dwg").write_bytes(b"drawing")
    out = str(tmp_path / "out")
    names = [sinks.deliver(spark, str(tmp_path / "c.dwg"), out, "plan", "zh hans", "bilingual", "dwg")[0].rsplit("/", 1)[1] for _ in range(2)]
    assert names == ["plan-ZHHANS-BILINGUAL-v01.dwg", "plan-ZHHANS-BILINGUAL-v02.dwg"]


def test_listing_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, sha256 string")
    b = spark.createDataFrame([("y", "2"), ("z", "4"), ("w", "5")], "path string, sha256 string")
    assert sorted(map(tuple, artifacts.listing_diff(a, b).collect())) == [("w", "archive"), ("x", "copy"), ("z", "replace")]


def test_references_and_looks(spark, tmp_path):
    """Changed references between blocks, and changed looks of retained texts."""

    def full():
        x = snapshot()
        x["blocks"][0]["references"] = [{"handle": "R1", "child": "*U3", "scale": [1, 1.0], "box": [0, 0, 1, 1]}]
        for r in x["rows"]:
            r.update(font="a.shx", bigFont="", width=0.0, alignmentPoint=[0, 0, 0], widthFactor=1.0)
        return x

    def link(**k):
        return lambda x: x["blocks"][0]["references"][0].update(k)

    def look(**k):
        return lambda x: x["rows"][0].update(k)

    cases = [(None, link(box=[0, 0, 2, 2])), (None, link(scale=[1.0, 1])), ("GD7", link(scale=[1, 2.0])), ("GD7", link(child="Model")), ("GD3", link(child="gone")), ("GD7", lambda x: x["blocks"][0]["references"].clear())]
    cases += [("GD3", lambda x: x["blocks"][0]["references"].append(x["blocks"][0]["references"][0])), ("SC3", look(width=3.0)), ("SC3", look(bigFont="b")), ("SC3", look(widthFactor=0.8)), ("SC2", look(alignmentPoint=None)), ("SC3", look(block="*U3"))]
    for i, (_, change) in enumerate(cases):
        saved = full()
        change(saved)
        write(tmp_path / f"case{i:02d}", extracted=full(), mapping=bilingual(), saved=saved, status={"schemaVersion": 1, "additions": [], "reflows": []})
    s, v = (artifacts.snapshots(spark, f"{tmp_path}/*/{n}.json") for n in ("extracted", "saved"))
    m, r = artifacts.mappings(spark, f"{tmp_path}/*/mapping.json"), artifacts.read_json(spark, f"{tmp_path}/*/status.json", schemas.RECEIPT)
    got = {}
    for x in [*diff.geometry_diff(s, v, m).collect(), *diff.content_diff(s, m, v, r).collect()]:
        got.setdefault(x.job_id, set()).add(x.rule)
    have = [got.get(f"case{i:02d}", set()) for i in range(len(cases))]
    assert all(rule in h if rule else not h & {"GD3", "GD7", "SC2", "SC3"} for (rule, _), h in zip(cases, have)), have


def generated(mode, change=lambda m, v, r: None):
    """A job with an addition, or with a joined text, and its saved snapshot and receipt."""
    s = snapshot()
    for x in s["rows"]:
        x.update(font="a.shx", bigFont="", width=0.0, alignmentPoint=[0, 0, 0], widthFactor=1.0)
    v = copy.deepcopy(s)
    new = {**v["rows"][0], "handle": "F1", "raw": "Added", "position": [20, 20, 0], "box": [20, 20, 30, 22], "worldBoxes": [{"root": "Model", "instancePath": ["B1"], "box": [20, 20, 30, 22]}]}
    if mode == "bilingual":
        m = bilingual()
        m["additions"] = [{"id": "a1", "sourceKeys": [["1a", "text"]], "block": "Model", "target": "Added", "placement": {"region": [15, 15, 40, 30], "minReadableHeight": 2.0}}]
        r = {"schemaVersion": 1, "additions": [{"id": "a1", "handle": "f1", "slot": "text"}], "reflows": []}
    else:
        m = mapping()
        m["edits"][0].update(action="reflow-member", reflowGroup="g1")
        m["reflows"] = [{"group": "g1", "sourceHandles": ["1A"], "block": "Model", "target": "Added", "minReadableHeight": 2.0, "layoutPlan": {"region": [15, 15, 40, 30], "checkTextOverlap": True}}]
        v["rows"].pop(0)
        v["rows"][1]["raw"] = "y"
        r = {"schemaVersion": 1, "additions": [], "reflows": [{"group": "g1", "handle": "f1"}]}
    v["rows"].append(new)
    v["blocks"][0]["entities"] = 6 if mode == "bilingual" else 5
    change(m, v, r)
    return s, m, v, r


def other(**k):
    """Another text near the new one, which the source has as well."""
    return {"handle": "EE", "kind": "TEXT", "slot": "text", "raw": "near", "block": "Model", "height": 2.0, "rotation": 0, "box": [28, 21, 35, 23], "position": [28, 21, 0], "worldBoxes": [{"root": "Model", "instancePath": [], "box": [28, 21, 35, 23]}], **k}


def with_other(**k):
    return lambda m, v, r: (v["rows"].append(other(**k)), m["edits"].append(edit("EE", "near", "replace", target="near")))


FAR = [{"root": "Model", "instancePath": [], "box": [90, 90, 95, 92]}]
GENERATED = [
    ("bilingual", None, lambda m, v, r: None), ("replace", None, lambda m, v, r: None),
    ("bilingual", "SC10", lambda m, v, r: r["additions"].clear()), ("bilingual", "SC10", lambda m, v, r: r["additions"].append(r["additions"][0])),
    ("replace", "SC17", lambda m, v, r: r["reflows"].clear()), ("replace", "SC17", lambda m, v, r: r["reflows"].append({"group": "g2", "handle": "F1"})),
    ("bilingual", "SC11", lambda m, v, r: r["additions"][0].update(handle="1b")), ("bilingual", "SC11", lambda m, v, r: r["additions"][0].update(handle="zz")), ("replace", "SC18", lambda m, v, r: r["reflows"][0].update(handle="1b")),
    ("bilingual", "SC12", lambda m, v, r: v["rows"][-1].update(raw="Else")), ("replace", "SC19", lambda m, v, r: v["rows"][-1].update(block="*U3")),
    ("bilingual", "SC13", lambda m, v, r: v["rows"][-1].update(height=1.0)), ("replace", "SC22", lambda m, v, r: v["rows"][-1].update(height=1.0)),
    ("bilingual", "SC14", lambda m, v, r: v["rows"][-1].update(box=[10, 20, 30, 22])), ("replace", "SC23", lambda m, v, r: v["rows"][-1].update(box=[10, 20, 30, 22])),
    ("replace", "SC20", lambda m, v, r: m["reflows"][0]["layoutPlan"].update(region=[40, 15, 15, 30])), ("replace", "SC21", lambda m, v, r: m["reflows"][0].pop("minReadableHeight")),
    ("replace", "SC24", lambda m, v, r: v["rows"][-1].update(inkBox=[10, 20, 30, 22])), ("replace", None, lambda m, v, r: v["rows"][-1].update(inkBox=[20, 20, 30, 22])),
    ("bilingual", "SC15", with_other(worldBoxes=FAR)), ("bilingual", "SC16", with_other(block="*U3")), ("bilingual", None, with_other(block="*U3", worldBoxes=FAR)), ("bilingual", None, with_other(visible=False)),
    ("bilingual", None, with_other(raw="near", instanceDisplay="attribute-definition-suppressed", kind="ATTDEF")), ("bilingual", None, with_other(block="*U3", worldBoxes=[{**FAR[0], "root": "Else", "box": [28, 21, 35, 23]}])),
    ("replace", "SC27", with_other()), ("replace", None, with_other(instanceDisplay="attribute-definition-suppressed", kind="ATTDEF")), ("replace", None, with_other(box=[28, 21, 35, float("inf")])), ("replace", None, with_other(box=[35, 21, 28, 23])),
    ("bilingual", "SC2", lambda m, v, r: v["rows"][1].update(font=None)), ("bilingual", "SC3", lambda m, v, r: v["rows"][1].update(font="c.shx")), ("bilingual", "SC3", lambda m, v, r: v["rows"][1].update(layer="L")),
    ("bilingual", "SC6", lambda m, v, r: v["coverageIssues"].append({"type": "missing-text-bounds", "handle": "1a"})), ("bilingual", "SC7", lambda m, v, r: v["rows"][1].update(worldBoxes=None)), ("replace", None, lambda m, v, r: v["rows"][1].update(worldBoxes=None)),
    ("bilingual", "SC8", lambda m, v, r: v["styles"][0].update(font="b.shx")), ("bilingual", "SC8", lambda m, v, r: v["styles"].clear()), ("bilingual", "SC8", lambda m, v, r: v["styles"][0].update(width=2.0)), ("replace", None, lambda m, v, r: v["styles"][0].update(font="b.shx")),
]


def differences(spark, folder):
    s, v = (artifacts.snapshots(spark, f"{folder}/*/{n}.json") for n in ("extracted", "saved"))
    m, r = artifacts.mappings(spark, f"{folder}/*/mapping.json"), artifacts.read_json(spark, f"{folder}/*/status.json", schemas.RECEIPT)
    got = {}
    for x in [*diff.geometry_diff(s, v, m).collect(), *diff.content_diff(s, m, v, r).collect()]:
        got.setdefault(x.job_id, set()).add(x.rule)
    return got


def test_generated_texts(spark, tmp_path):
    """A case for each rule on saved content, and cases that keep them all."""
    for i, (mode, _, change) in enumerate(GENERATED):
        s, m, v, r = generated(mode, change)
        write(tmp_path / f"case{i:02d}", extracted=s, mapping=m, saved=v, status=r)
    got = differences(spark, tmp_path)
    wrong = {}
    for i, (_, rule, _) in enumerate(GENERATED):
        have = {x for x in got.get(f"case{i:02d}", set()) if x.startswith("SC") and x != "SC26"}
        if (rule not in have) if rule else have:
            wrong[i] = (rule, have)
    assert not wrong


def test_joined_text_stays_in_its_source_note(spark, tmp_path):
    def note(right):
        def change(m, v, r):
            m["edits"][0]["expectedRaw"] = LONG
            v["rows"][-1].update(box=[20, 20, right, 22])
        return change

    for i, right in enumerate((24.9, 30.0)):
        s, m, v, r = generated("replace", note(right))
        s["rows"][0].update(kind="MTEXT", raw=LONG, box=[20, 14, 25, 22], position=[20, 22, 0])
        write(tmp_path / f"case{i:02d}", extracted=s, mapping=m, saved=v, status=r)
    got = differences(spark, tmp_path)
    assert "SC25" not in got.get("case00", set()) and "SC25" in got["case01"]


LONG = "a note of several words that is long enough to have limits"


def test_fonts_by_face(spark, tmp_path):
    face = {"fontFace": "Arial", "fontBold": False, "fontItalic": False}
    cases = [(None, {"font": "arial.ttf", **face}, {"font": "ARIAL.TTC", **face}), (None, {"font": "", **face}, {"font": "x.ttf", **face}), ("SC3", {"font": "a.shx", **face}, {"font": "b.ttf", **face}),
             ("SC3", {"font": "a.ttf", **face}, {"font": "b.ttf", **face, "fontBold": True}), ("SC3", {"font": "a.ttf"}, {"font": "b.ttf"}), ("SC3", {"font": "a.ttf", **face, "fontFace": ""}, {"font": "b.ttf", **face, "fontFace": ""})]
    for i, (_, old, new) in enumerate(cases):
        s, m, v, r = generated("bilingual")
        for x, k in ((s, old), (v, new)):
            x["rows"][1].update(k)
            x["styles"][0].update(k)
        write(tmp_path / f"case{i:02d}", extracted=s, mapping=m, saved=v, status=r)
    got = differences(spark, tmp_path)
    for i, (rule, _, _) in enumerate(cases):
        assert got.get(f"case{i:02d}", set()) == ({"SC3", "SC8"} if rule else set()), i


def test_ghosts_and_ellipses(spark, tmp_path):
    import math

    ghost = {"handle": "Z1", "type": "AcDbZombieEntity", "block": "*U3", "layer": "0", "shape": {"OriginalClassName": "TH_ParaBasePntUA", "HasFields": False, "GraphicsMetafileType": 1, "Other": 2}}
    oval = {"handle": "E1", "type": "AcDbEllipse", "block": "Model", "layer": "0", "shape": {"Center": [1e6, 0.0, 0.0], "MajorAxis": [5.0, 0.0, 0.0], "MinorAxis": [0.0, 2.0, 0.0], "StartPoint": [0.001, 0.0, 0.0], "EndPoint": [3.0, 0.0, 0.0]}}
    step = math.ulp(1e6)

    def shape(i, **k):
        return lambda v: v["geometry"][i]["shape"].update(k)

    cases = [(None, 0, shape(2, GraphicsMetafileType=5)), ("GD12", 1, shape(2, GraphicsMetafileType=5)), ("GD12", 0, shape(2, Other=3)), ("GD12", 0, shape(2, GraphicsMetafileType=5, HasFields=True)),
             (None, 0, shape(3, StartPoint=[0.001 + 3 * step, 0.0, 0.0])), ("GD12", 0, shape(3, StartPoint=[0.001 + 9 * step, 0.0, 0.0])), ("GD12", 0, shape(3, MajorAxis=[5.0 + 3 * step, 0.0, 0.0]))]
    for i, (_, seen, change) in enumerate(cases):
        s = snapshot()
        s["blocks"][1]["visibleInstanceCount"] = seen
        s["geometry"] += copy.deepcopy([ghost, oval])
        v = copy.deepcopy(s)
        v["rows"][0]["raw"], v["rows"][2]["raw"] = "Valve C30", "y"
        change(v)
        write(tmp_path / f"case{i:02d}", extracted=s, mapping=mapping(), saved=v, status={"schemaVersion": 1, "additions": [], "reflows": []})
    got = differences(spark, tmp_path)
    assert [got.get(f"case{i:02d}", set()) for i in range(len(cases))] == [{rule} if rule else set() for rule, _, _ in cases]


def test_bound_evidence(spark):
    names = [*evidence.BOUND, "candidate.dwg"]
    tasks = spark.createDataFrame([("j", "bilingual", HASH_A)], "job_id string, mode string, sourceSha256 string")
    candidates = spark.createDataFrame([("j", "c")], "job_id string, candidateSha256 string")
    files = spark.createDataFrame([("j", n, "c" if n == "candidate.dwg" else f"h{i}") for i, n in enumerate(names)], "job_id string, name string, sha256 string")
    reviews = spark.createDataFrame([("j", [("s1",)], None)], "job_id string, sheets array<struct<id:string>>, warnings array<string>")
    none = spark.createDataFrame([], "job_id string")
    record = evidence.verification(tasks, candidates, reviews, files, none)
    assert record.first().asDict() == {"job_id": "j", "status": "verified", "mode": "bilingual", "sourceSha256": HASH_A, "candidateSha256": "c", "reviewedSheetIds": ["s1"], "warnings": [], **{c: f"h{i}" for i, c in enumerate(evidence.BOUND.values())}}
    assert evidence.verification(tasks, candidates, reviews, files, spark.createDataFrame([("j",)], "job_id string")).count() == 0
    source, copy_ = (spark.createDataFrame([("j", h)], "job_id string, sha256 string") for h in (HASH_A, "c"))
    assert evidence.delivery_rules(record, files, source, copy_).count() == 0
    changed_ = files.withColumn("sha256", F.when(F.col("name") == "visual-review.json", "x").otherwise(F.col("sha256")))
    assert [r.detail for r in evidence.delivery_rules(record, changed_, source, copy_).collect()] == ["visualReviewSha256 changed"]
    assert [r.detail for r in evidence.delivery_rules(record, files, source, source).collect()] == ["final copy"]
    images = spark.createDataFrame([("j", "a.png", "source", "p"), ("j", "b.png", "candidate", "q"), ("j", "c.png", "candidate", "r"), ("j", "d.png", "source", "s")], "job_id string, name string, role string, sha256 string")
    renders = spark.createDataFrame([("j", "a.png", HASH_A, "p", True), ("j", "b.png", "c", "q", True), ("j", "c.png", HASH_A, "r", True)], "job_id string, name string, drawingSha256 string, pngSha256 string, native boolean")
    assert sorted(r.key for r in evidence.render_rules(images, renders, tasks, candidates).collect()) == ["candidate c.png", "source d.png"]

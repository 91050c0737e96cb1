import json

from sheetwise.streaming import jobs

from .test_contracts import mapping, snapshot


def test_arriving_mappings_are_validated(spark, tmp_path):
    bad = mapping()
    bad["mode"] = "other"
    for name, m in (("good", mapping()), ("bad", bad)):
        folder = tmp_path / "in" / name
        folder.mkdir(parents=True)
        (folder / "extracted.json").write_text(json.dumps(snapshot()))
        (folder / "mapping.json").write_text(json.dumps(m))
    got = []
    q = jobs.validate_arriving(spark, f"{tmp_path}/in/*/extracted.json", f"{tmp_path}/in/*/mapping.json", lambda v, _: got.extend(v.collect()), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert {(r.job_id, r.rule) for r in got} >= {("bad", "V03")} and not any(r.job_id == "good" for r in got)

"""JSON documents cut anywhere against the plain parser."""

import json
import random

import pytest

from traceframe.sources.json_ranges import json_rows, write_json_rows


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", ":", " ", "é", "x", "\n", '\\"rows": [']) for _ in range(rng.randrange(12)))


def documents():
    rng = random.Random(3)
    row = lambda i: rng.choice([{"k": i, "t": odd_text(rng), "n": [[1, 2], {"rows": [{"k": 0}]}]}, {"k": i}, i, None, [i, {"k": 1}], "a,b"])
    out = {
        "many": json.dumps({"frame": 'f"\\', "side": {"rows": [{"k": 9}]}, "rows": [row(i) for i in range(60)], "label": "after, [it"}, ensure_ascii=False),
        "spaced": json.dumps({"rows": [row(i) for i in range(9)]}, indent=3),
        "empty list": '{"rows" :  [ \n ] }',
        "slashes": json.dumps({"rows": [{"k": 1, "t": "\\" * 70}, {"k": 2, "t": "\\" * 71 + '"'}]}),
        "no list": '{"rows": {"k": 1}}', "other key": '{"my\\"rows": [{"k": 1}]}', "a list": '[{"k": 1}, {"k": 2}]', "nothing": "",
        "cut": '{"rows": [{"k": 1}, {"k": ', "bad value": '{"rows": [{"k": 1}, {k}, {"k": 3}]}', "hole": '{"rows": [{"k": 1}, , {"k": 3}]}',
        "twice": '{"rows": [{"k": 1}], "rows": [{"k": 2}]}',
    }
    return out


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_ranges_against_the_plain_parser(spark, tmp_path, split):
    docs = documents()
    for name, text in docs.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    rows, warnings = json_rows(spark, str(tmp_path), "rows", "k BIGINT, t STRING", split)
    name = lambda p: p.rsplit("/", 1)[1].removesuffix(".json").replace("%20", " ")
    got = sorted((name(r["path"]), r["place"], r["row"]["k"], r["row"]["t"], r["frame"], r["label"]) for r in rows.collect())
    want = []
    for doc in ("many", "spaced", "slashes"):
        told = json.loads(docs[doc])
        want += [(doc, i, v["k"], v.get("t"), told.get("frame"), told.get("label")) for i, v in enumerate(told["rows"]) if isinstance(v, dict)]
    assert got == sorted(want)
    assert {name(r["path"]) for r in warnings.collect()} == set(docs) - {"many", "spaced", "slashes", "empty list", "nothing"}


def test_missing_path(spark, tmp_path):
    rows, warnings = json_rows(spark, str(tmp_path / "none"), "rows", "k BIGINT")
    assert rows.count() == 0 and warnings.count() == 0


def test_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else odd_text(random.Random(i))) for i in range(300)], "k BIGINT, t STRING")
    write_json_rows(df.coalesce(1), str(tmp_path / "one"), frame="f")
    rows, warnings = json_rows(spark, str(tmp_path / "one"), "rows", "k BIGINT, t STRING", 500)
    got = sorted((r["place"], r["row"]["k"], r["row"]["t"], r["frame"]) for r in rows.collect())
    assert got == [(i, r["k"], r["t"], "f") for i, r in enumerate(df.collect())]
    assert warnings.count() == 0

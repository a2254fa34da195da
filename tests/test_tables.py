"""Writes, refusals, readers and streams in temporary folders."""

import datetime as dt
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceframe.operators import checks as Ch
from traceframe.sources import readers as Rd
from traceframe.sources import writers as Wr
from traceframe.streaming import jobs as J


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_table_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "part INT, id INT, v STRING, seq INT"
    one = spark.createDataFrame([(0, 1, "a", 1), (0, 1, "b", 2), (1, 2, "c", 1)], ddl)
    Wr.upsert_table(spark, path, one, ["part", "id"], "seq", "part")
    two = spark.createDataFrame([(0, 1, "x", 1), (0, 3, "y", 1)], ddl)
    for _ in range(2):
        Wr.upsert_table(spark, path, two, ["part", "id"], "seq", "part")
    assert rows(spark.read.parquet(path), "id", "v") == [(1, "x"), (2, "c"), (3, "y")]


def test_protected_replace_in_one_batch(spark):
    ddl = "owner STRING, id INT, provenance STRING, body STRING"
    stored = spark.createDataFrame([("s", 1, "authored", "old"), ("s", 2, "traced", "old"), ("t", 9, "traced", "old")], ddl)
    batch = spark.createDataFrame(
        [("s", 1, "traced", "n1", 0), ("s", 3, "traced", "n2", 1), ("s", 3, "authored", "n3", 2), ("s", 3, "traced", "n4", 3)], ddl + ", seq INT"
    )
    table, counts = Wr.protected_replace(stored, batch, "owner", ["id"], "seq", True)
    assert rows(table, "owner", "id", "body") == [("s", 1, "old"), ("s", 3, "n3"), ("t", 9, "old")]
    assert rows(counts, "stored", "deleted", "skipped") == [(1, 1, 2)]


def test_snapshot_refusals_and_restore(spark, tmp_path):
    root = str(tmp_path / "snap")
    hands = spark.createDataFrame([("h", "x")], "id STRING, label STRING")
    forms = spark.createDataFrame([(1, "h"), (2, "h")], "form INT, hand STRING")
    Wr.export_snapshot(spark, {"hands": hands, "forms": forms}, root, "2024a", ["forms"])
    with pytest.raises(FileExistsError):
        Wr.export_snapshot(spark, {"hands": hands, "forms": forms}, root, "2024a", ["forms"])
    with pytest.raises(ValueError, match="shrank"):
        Wr.export_snapshot(spark, {"hands": hands, "forms": forms.limit(1)}, root, "2024b", ["forms"])
    with pytest.raises(ValueError, match="empty"):
        Wr.export_snapshot(spark, {"hands": hands, "forms": forms.limit(0)}, root, "2024c", ["forms"])
    target = str(tmp_path / "forms")
    plan = {"hands": (str(tmp_path / "hands"), ["id"])}, {"forms": target}
    dry = Wr.restore_snapshot(spark, root, "2024a", *plan, apply=False, replace=False)
    assert rows(dry, "table", "rows") == [("forms", 2), ("hands", 1)] and not Wr.exists(spark, target)
    Wr.restore_snapshot(spark, root, "2024a", *plan, apply=True, replace=False)
    assert rows(spark.read.parquet(target), "form") == [(1,), (2,)]
    with pytest.raises(ValueError, match="occupied"):
        Wr.restore_snapshot(spark, root, "2024a", *plan, apply=True, replace=False)
    Wr.restore_snapshot(spark, root, "2024a", *plan, apply=True, replace=True)


def test_run_log_is_create_only(spark, tmp_path):
    root = str(tmp_path / "log")
    a = spark.createDataFrame([("rows", "1"), ("block", "2")], "name STRING, body STRING")
    Wr.append_run(spark, root, a, "s1", "  First Run! ")
    assert rows(spark.read.parquet(f"{root}/index"), "label", "artifacts") == [("first-run", 2)]
    with pytest.raises(FileExistsError):
        Wr.append_run(spark, root, a, "s1", "first run")
    with pytest.raises(ValueError):
        Wr.append_run(spark, root, a.unionByName(a), "s2", "x")
    with pytest.raises(ValueError):
        Wr.append_run(spark, root, a.withColumn("body", F.lit("")), "s3", "x")


def test_reference_folder(spark, tmp_path):
    def row(i, **kw):
        m = {"registration_px": {"baseline_row": 40.0}, "xh_px": 30.0}
        return {"specimen_id": i, "strokes": [[[0, 0], [1, 1]]], "measurements": m, **kw}

    art = {"rows": [row("b"), row("a"), row("stale", frame_stale="moved"), row("bare", strokes=[]), row("lost"), row("raw", measurements={}), 7]}
    (tmp_path / "word_instances.json").write_text(json.dumps(art))
    (tmp_path / "manifest.json").write_text(json.dumps({"words": [{"id": "a", "word": "a"}]}))
    for i in ("a", "b", "stale", "bare", "raw"):
        (tmp_path / i).mkdir()
        (tmp_path / i / "word.json").write_text("{}")
    ref = Rd.load_reference(spark, str(tmp_path))
    assert dict(rows(ref, "specimen_id", "reason")) == {
        "a": None, "b": None, "stale": "frame_stale", "bare": "no_strokes", "lost": "no_entry", "raw": "no_registration",
    }
    assert [r["specimen_id"] for r in ref.where("reason IS NULL").orderBy("order_key").collect()] == ["a", "b"]


def test_missing_and_malformed_json(spark, tmp_path):
    assert Rd.whole_texts(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "list.json").write_text("[1]")
    got, warnings = Rd.json_objects(Rd.whole_texts(spark, str(tmp_path / "list.json")), "rows", "k INT")
    assert got.count() == 0 and warnings.count() == 1


def test_candidate_file(spark, tmp_path):
    p = tmp_path / "c.json"
    body = {"frame": "word_registration", "rows": [{"specimen_id": "a", "xh_px": 9, "measurements": {"xh_px": 30.0}}, {"specimen_id": "z"}, {"word": "?"}]}
    p.write_text(json.dumps(body))
    wanted = spark.createDataFrame([("a",), ("b",)], "specimen_id STRING")
    out, ignored = Rd.file_candidates(spark, str(p), wanted)
    assert rows(out, "specimen_id", "status", "xh_px") == [("a", "ok", 30.0), ("b", "skipped", None)]
    assert rows(ignored, "reason", "n") == [("no_id", 1), ("unknown_id", 1)]
    p.write_text(json.dumps({**body, "frame": "crop"}))
    with pytest.raises(ValueError):
        Rd.file_candidates(spark, str(p), wanted)


GOOD = 'R2 geprueft=4 von 9\nS001:G@177s\n\nS002:WB#75,56@12s\nS003:-\nS004:E@9s "a \\"text\\""\nGut: 1\n'


@pytest.mark.parametrize(
    ("text", "errors"),
    [
        (GOOD, []),
        ("S001:G\n", ["no_header"]),
        ("R geprueft=2 von 2\nS1:G\nS1:A\n", ["judged_twice"]),
        ("R geprueft=1 von 2\nS1:X\n", ["unknown_code"]),
        ("R geprueft=1 von 2\nS1:G\nwhat is this\n", ["bad_line"]),
        ("R geprueft=2 von 2\nS1:G\nGut: 1\nS2:A\n", ["verdict_after_tally"]),
        ("R geprueft=3 von 2\nS1:G\n", ["header_count"]),
        ("R geprueft=1 von 2\nS1:G\nGut: 4\n", ["tally_count"]),
        ("R geprueft=1 von 2\nS1:G\nGut: 1\nGut: 1\n", ["tally_twice"]),
    ],
)
def test_verdict_text(spark, tmp_path, text, errors):
    (tmp_path / "r.txt").write_text(text)
    _, verdicts, found = Rd.parse_verdicts(Rd.verdict_lines(Rd.whole_texts(spark, str(tmp_path / "r.txt"))))
    assert sorted(r["error"] for r in found.collect()) == errors
    if not errors:
        assert rows(verdicts, "position", "uid", "sx", "seconds") == [(0, "S001", None, 177), (1, "S002", 75, 12), (2, "S003", None, None), (3, "S004", None, 9)]


def test_transition_rule_matches_its_stream_twin(spark):
    values = [None, " ", "x"]
    changes = [
        {"status": s, "understanding": u, "reproduced": r, "stage": st, "resolution": re, "kind": None}
        for s in (None, "open", "ack", "done") for u in values for r in values for st in (None, "x") for re in values
    ]
    stored = [{"kind": k, "status": "open", "understanding": u, "reproduced": None, "stage": None, "resolution": None} for k in ("note", "glyph") for u in values]
    pairs = [(s, c) for s in stored for c in changes]
    ddl = ", ".join(f"{f}: STRING" for f in J.FIELDS)
    data = [(i, tuple(s[f] for f in J.FIELDS), tuple(c[f] for f in J.FIELDS)) for i, (s, c) in enumerate(pairs)]
    df = spark.createDataFrame(data, f"i INT, s STRUCT<{ddl}>, c STRUCT<{ddl}>")
    got = dict(rows(df.select("i", Ch.transition_problem().alias("p")), "i", "p"))
    assert all(got[i] == J.change_problem(s, c) for i, (s, c) in enumerate(pairs))


def test_tallies_in_many_batches_equal_one_batch(spark, tiny, tmp_path):
    """Files of mixed order within the delay, one of them twice; a file far behind is counted as late."""
    from traceframe.operators.words import session_tallies
    from traceframe.functions.ordered import dense_position
    from traceframe.plans import views as V

    e = V.table(spark, tiny, "events").withColumn("ok", F.col("event_type") != "error").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = tmp_path / "in"
    ordered = e.orderBy("ts", "event_id").toPandas()
    n = len(ordered) // 6
    cuts = [ordered.iloc[i * n : (i + 1) * n] if i < 5 else ordered.iloc[5 * n :] for i in range(6)]
    files = [cuts[0].iloc[::-1], cuts[2], cuts[1], cuts[2], cuts[3], cuts[5], cuts[4]]
    for f in files:
        spark.createDataFrame(f, e.schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01)
    stream = J.file_stream(spark, str(folder), "*.parquet", e.schema, per_batch=1)
    got = J.stream_tallies(stream, ["user_id"], "ts", "event_id", "ok", 365 * 86400, str(tmp_path / "out"))
    pos = dense_position(e, ["user_id"], ["ts", "event_id"], V.hour_bucket("ts"))
    cols = ["user_id", "seen", "correct", "streak", "best_streak"]
    assert rows(got, *cols) == rows(session_tallies(pos, ["user_id"], "pos", "ok"), *cols)
    assert got.where("late > 0").isEmpty()
    behind = tmp_path / "behind"
    for i in (0, 2, 3, 1):
        spark.createDataFrame(cuts[i], e.schema).coalesce(1).write.mode("append").parquet(str(behind))
        time.sleep(0.01)
    stream = J.file_stream(spark, str(behind), "*.parquet", e.schema, per_batch=1)
    seen, late = J.stream_tallies(stream, ["user_id"], "ts", "event_id", "ok", 3600, str(tmp_path / "strict")).agg(F.sum("seen"), F.sum("late")).first()
    assert 0 < late <= n and seen + late == 4 * n  # two batches behind: left out and named


def test_runs_fold_in_any_cut():
    rng = random.Random(2)
    for _ in range(50):
        ok = np.array([rng.random() < 0.7 for _ in range(rng.randrange(0, 40))], dtype=bool)
        whole, cut = J.folded((0, 0, 0, 0), ok), (0, 0, 0, 0)
        at = 0
        while at < len(ok):
            step = rng.randrange(1, 9)
            cut = J.folded(cut, ok[at : at + step])
            at += step
        text = "".join("x" if o else " " for o in ok)
        assert cut == whole == (len(ok), int(ok.sum()), max(map(len, text.split()), default=0), len(text) - len(text.rstrip("x")))


def changes_folder(spark, folder, batches):
    ddl = "item_id BIGINT, change_id BIGINT, at TIMESTAMP, " + J.STATE_DDL
    for batch in batches:
        spark.createDataFrame([(i, c, dt.datetime(2024, 1, 1, 0, m), None, *f) for i, c, m, f in batch], ddl).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)
    return J.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema, per_batch=1)


def test_changes_in_the_wrong_order(spark, tmp_path):
    ack = (1, 10, 1, ("ack", "seen", "yes", None, None))
    done = (1, 20, 2, ("done", None, None, "compose", "fixed"))
    other = (2, 5, 3, ("ack", None, None, None, None))
    after = [(9, 99, 50, ("open", None, None, None, None))], [(9, 100, 55, ("open", None, None, None, None))]
    right = [(1, 10, None, "ack"), (1, 20, None, "done"), (2, 5, "ack_missing", "open")]
    show = lambda df: sorted(tuple(r) for r in df.where("item_id < 9").collect())
    for n, (batches, delay, want) in enumerate(
        [
            ([[ack], [done, other]], None, right),
            ([[done, ack, other]], None, right),
            ([[done, other], [ack]], None, [(1, 10, "late_change", "open"), (1, 20, "not_understood", "open"), (2, 5, "ack_missing", "open")]),
            ([[done, other], [ack], *after], "10 minutes", right),
        ]
    ):
        stream = changes_folder(spark, str(tmp_path / f"in{n}"), batches)
        out = J.stream_to_folder(J.life_cycle(stream, delay), str(tmp_path / f"out{n}"), str(tmp_path / f"state{n}"))
        assert show(out) == want, n


def test_protected_stream(spark, tmp_path):
    ddl = "owner STRING, id INT, provenance STRING, body STRING, seq INT"
    folder = str(tmp_path / "in")
    for i, row in enumerate([("s", 1, "authored", "mine", 0), ("s", 1, "traced", "auto", 0), ("s", 2, "traced", "auto", 0)]):
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(folder)
    stream = J.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema, per_batch=1)
    J.stream_protected(stream, "owner", ["id"], "seq", str(tmp_path / "t"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "id", "body") == [(1, "mine"), (2, "auto")]


def test_checkpoint_folder_is_required_on_a_cluster():
    from traceframe import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_restored_keys_are_new_and_linked(spark):
    people = spark.createDataFrame([(7, "a"), (3, "b"), (9, "c")], "id BIGINT, name STRING")
    letters = spark.createDataFrame([(1, 7), (2, 3), (5, 8), (6, None)], "no BIGINT, person BIGINT")
    stores = {"people": spark.createDataFrame([(3, "x"), (20, "y")], "id BIGINT, name STRING"), "letters": letters.limit(0)}
    out = Wr.with_new_keys({"people": people, "letters": letters}, stores, {"people": "id", "letters": "no"}, {"letters": {"person": "people"}})
    assert rows(out["people"], "id", "name") == [(21, "b"), (22, "a"), (23, "c")]
    got = {r["no"]: r["person"] for r in out["letters"].collect()}
    assert got == {1: 22, 2: 21, 3: None, 4: None}  # a reference to a row that was not filed is null
    empty = Wr.with_new_keys({"people": people.limit(0)}, stores, {"people": "id"}, {})
    assert empty["people"].count() == 0


def test_pins_come_first_and_the_rest_fills_up(spark):
    from traceframe.operators.words import pinned_sample

    data = [(g, i, i in pins, score) for g, pins, scores in ((1, (2, 4), (0, 5, 0, 1, 0)), (2, (), (0, 0, 3, 0, 0)), (3, (1,), (0, 0))) for i, score in enumerate(scores)]
    df = spark.createDataFrame(data, "g INT, i INT, pin BOOLEAN, score INT")
    u = (F.col("i") * 37 % 101 + 1) / 103
    got = {}
    for r in pinned_sample(df, ["g"], 3, F.col("pin"), F.col("score"), u, "i").collect():
        got.setdefault(r["g"], {})[r["place"]] = r["i"]
    assert got[1][1] == 4 and 2 in got[1].values()  # of the pins the smaller number, 4 * 37 % 101 = 47 and 74
    assert got[2][1] == 2 and len(got[2]) == 3  # the only scored row, then a top-up
    assert got[3] == {1: 1, 2: 0}  # fewer rows than places


def test_deleted_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    assert Wr.delete_rows(spark, path, F.col("id") >= 7) == 3
    assert Wr.delete_rows(spark, path, F.col("id") >= 7) == 0
    assert spark.read.parquet(path).count() == 7


def test_boxes_keep_a_lock(spark):
    from traceframe.operators.runs import covered_keys, merged_boxes

    df = spark.createDataFrame([("a", 2, 5.0, True), ("a", 1, 6.0, False), ("b", 0, 7.0, None)], "key STRING, priority INT, x DOUBLE, locked BOOLEAN")
    assert rows(merged_boxes(df, ["key"], ["priority"], "locked"), "key", "x", "locked") == [("a", 6.0, True), ("b", 7.0, False)]
    same = spark.createDataFrame([(3, "t"), (1, "t"), (2, "u"), (4, None), (5, None)], "id INT, text STRING")
    assert rows(covered_keys(same, ["text"], "id"), "kept", "covered") == [(1, 1), (1, 3), (2, 2), (4, 4), (4, 5)]

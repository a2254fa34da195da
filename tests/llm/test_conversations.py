"""Conversation repair against a plain search that keeps whole edit strings."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from traceframe.llm import conversations as C
from traceframe.llm.conversations_queries import damaged

SCHEMA = "conv_id bigint, turn bigint, role string, text string, position int"


def plain(rows):
    """rows: (turn, role, text) in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, kinds = set(), []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if blank else "duplicate" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}  # role initials so far, reduced to what matters

    def state(said):
        return said if said in ("", "s") else "".join(said)[-1:]

    def follow(said, initial):
        if initial == "s":
            return "s" if said == "" else None
        if initial == "u":
            return "u" if said in ("", "s", "a") else None
        return "a" if initial == "a" and said == "u" else None

    def inserted(ways):
        done = dict(ways)
        for _ in range(2):
            for said, (cost, audit, made) in list(done.items()):
                for role in ("user", "assistant"):
                    to = follow(said, role[0])
                    if to is not None:
                        way = (cost + 5, audit + "I", (*made, (role, "")))
                        done[to] = min(done.get(to, way), way, key=lambda w: w[:2])
        return done

    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for said, (cost, audit, made) in inserted(best).items():
            options = [(said, cost + 2, "D", made)]
            if kind not in ("blank", "duplicate"):
                extra = 5 * (kind == "truncated")
                options.append((follow(said, role[:1]), cost + extra, "K", (*made, (role, text))))
                options += [(follow(said, r[0]), cost + 1 + extra, "R", (*made, (r, text))) for r in ("user", "assistant")]
            for to, c, edit, m in options:
                if to is not None:
                    way = (c, audit + edit, m)
                    new[to] = min(new.get(to, way), way, key=lambda w: w[:2])
        best = new
    cost, audit, made = min((w for s, w in inserted(best).items() if s in ("", "a")), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    said = "\n".join(f"{r}:{t}" for r, t in made)
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest()), made


def random_rows(rng, n, conv):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "u", None, ""]
    texts = ["Yes.", "No!", "cut off", " \t", "", None, "Why?  ", "So it is.", "…", "word " * 50 + "."]
    rows = [(conv, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}" + rng.choice([".", ""]), 0) for t in range(n)]
    return [r if rng.random() > 0.1 else (conv, None, *r[2:]) for r in rows]


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], (" " if r[3] is None else r[3])[:64])
    return [r[1:4] for r in sorted(rows, key=key)]


def expected(rows):
    return {c: plain(ordered([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    got = C.repair_conversations(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id][0], r
    turns = {}
    for r in sorted(C.repaired_turns(df).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: list(w[1]) for c, w in want.items() if w[1]}


def test_plain_search(spark):
    rng = random.Random(11)
    rows = [r for conv in [None, *range(60)] for r in random_rows(rng, rng.randrange(1, 9), conv)]
    rows += [(99, None, None, None, 0)] * 3 + [(98, 5, "user", "Same.", 0)] * 40
    check(spark, rows)


def test_many_pieces(spark, monkeypatch):
    """A long conversation in pieces of five rows, with repeats of text in other pieces."""
    real = C._pieces

    def small(batches, rows, size):
        return real(batches, 5, size)

    monkeypatch.setattr(C, "_pieces", small)
    rng = random.Random(12)
    check(spark, [*random_rows(rng, 300, 1), *random_rows(rng, 120, None), *random_rows(rng, 2, 3)])


def test_halves_agree_with_one_pass():
    rng = random.Random(13)
    for _ in range(200):
        codes = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        cut = rng.randrange(len(codes) + 1)
        parts = [p for p in (codes[:cut], codes[cut:]) if p]
        out = []
        states = C.piece_states([C.summed([C.STEPS[c] for c in p]) for p in parts])
        for p, a, b in zip(parts, states, states[1:]):
            C.best_edits([C.STEPS[c] for c in p], a, b, out)
        one = []
        whole = C.piece_states([C.summed([C.STEPS[c] for c in codes])])
        C.best_edits([C.STEPS[c] for c in codes], *whole, one)
        assert (out, states[-1]) == (one, whole[-1])


def test_damage_and_empty(spark):
    rows = [(c, t, "assistant", "Well. Done!", 0) for c in range(40) for t in range(5)] + [(None, None, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    hurt = damaged(df).collect()
    h = {(r.conv_id, r.turn): r.h for r in df.select("conv_id", "turn", (F.crc32(F.format_string("%s:%s", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20).alias("h")).collect()}
    for key, code in h.items():
        mine = [(r.role, r.text) for r in hurt if (r.conv_id, r.turn) == key]
        if key == (None, None):
            continue
        role = "user" if code == 4 else "assistant"
        text = "" if code == 1 else "Well Done" if code == 2 else "Well. Done!"
        assert mine == [(role, text)] * {0: 0, 3: 2}.get(code, 1)
    assert C.repair_conversations(df.limit(0)).count() == 0

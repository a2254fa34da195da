"""Words: shaping, coverage, look-alikes, sampling, banks and session tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.functions import text as X
from traceframe.functions.ordered import running_total
from traceframe.session import checkpointed


def tokens(words: DataFrame, keys: Sequence[str], word: str, once: Sequence[str] = ()) -> DataFrame:
    """Shaped tokens of each word: (keys, i, text, key, ligature, joins, position, quote).

    Positions count inside a run of tokens that all join or all stand apart. A deferred s is long unless it ends its run
    or the marker follows it. A straight quote has no key yet: it depends on the quotes before it in its text.

    `once`: only these columns, one row for each of their combinations in a word, and `n`, its tokens.
    A run begins and ends where the neighbour is of the other kind, so a word is shaped in its own row, without a sort.
    """
    joining = [text for text, _, _, joins in X.registry_rows() if joins]
    known = [F.lit(v) for text, key, ligature, _ in X.registry_rows() for v in (text, f"{int(ligature)}{key}")]
    found = F.transform(F.regexp_extract_all(word, F.lit(X.TOKENS), 1), lambda t, i: F.struct(i.alias("i"), t.alias("tok")))

    def unit(t: Column) -> Column:
        text = X.strip_marker(t["tok"])
        joins, entry = text.isin("s", "ſ", *joining), F.element_at(F.create_map(*known), text)
        return F.struct(t["i"].alias("i"), text.alias("text"), t["tok"].endswith(X.MARKER).alias("round"), joins.alias("joins"), entry.alias("entry"))

    def shaped(t: Column, j: Column) -> Column:
        ends = lambda by: F.coalesce(F.get("_t", j + by)["joins"] != t["joins"], F.lit(True))
        place = F.when(ends(-1), "initial").when(ends(1), "final").otherwise("medial")
        s, quote = t["text"].isin("s", "ſ"), t["text"] == '"'
        key = F.when(s, F.when(t["round"] | (place == "final"), "s").otherwise("longs")).otherwise(F.substr(t["entry"], F.lit(2)))
        ligature = F.coalesce(t["entry"].startswith("1"), F.lit(False))
        position = F.when(s | quote | t["entry"].isNotNull(), place)
        return F.struct(
            t["i"].alias("i"), t["text"].alias("text"), key.alias("key"), ligature.alias("ligature"), t["joins"].alias("joins"), position.alias("position"), quote.alias("quote")
        )

    raw = words.select(*keys, F.transform(F.filter(found, lambda t: t["tok"] != X.MARKER), unit).alias("_t"))
    raw = raw.select(*keys, F.transform("_t", shaped).alias("_t"))
    if once:
        raw = raw.select(*keys, F.transform("_t", lambda t: F.struct(*[t[c].alias(c) for c in once])).alias("_t"))
        number = lambda k: F.size(F.filter("_t", lambda t: t.eqNullSafe(k))).cast("bigint").alias("n")
        raw = raw.select(*keys, F.transform(F.array_distinct("_t"), lambda k: F.struct(*[k[c].alias(c) for c in once], number(k))).alias("_t"))
    # outer: a plain explode would add a size filter and run the pattern twice
    return raw.select(*keys, F.explode_outer("_t").alias("_u")).where(F.col("_u").isNotNull()).select(*keys, "_u.*")


def word_keys(toks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key list per word in order; a group is one word."""
    g = toks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "key"))).alias("_k"))
    return g.select(*keys, F.filter(F.transform("_k", lambda s: s["key"]), lambda k: k.isNotNull()).alias("slots"))


def without_missing_clusters(toks: DataFrame, inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace clusters the inventory lacks by their letters; the parts inherit the cluster's place. ß stays whole."""
    have = inventory.select("key", F.lit(True).alias("_have")).distinct()
    j = toks.join(have, "key", "left")
    split = F.col("ligature") & F.col("position").isNotNull() & (F.length("text") >= 2) & F.col("_have").isNull()
    parts = F.when(split, F.split("text", "")).otherwise(F.array("text"))
    j = j.select(*keys, "i", "key", "position", split.alias("_split"), F.size(parts).alias("_n"), F.posexplode(parts).alias("part", "piece"))
    first, last = F.col("part") == 0, F.col("part") == F.col("_n") - 1
    place = (
        F.when(~F.col("_split"), F.col("position"))
        .when(first & (F.col("position") == "initial"), "initial")
        .when(last & (F.col("position") == "final"), "final")
        .otherwise("medial")
    )
    letter = F.when(F.col("piece").isin("s", "ſ"), F.when(place == "final", "s").otherwise("longs")).otherwise(F.col("piece"))
    return j.select(*keys, "i", "part", F.when(F.col("_split"), letter).otherwise(F.col("key")).alias("key"), place.alias("position"))


def quote_parity(toks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Straight quotes alternate low and high through the text they stand in; a text is one input row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("quote").cast("int")).over(w), F.lit(0))
    form = F.when(before % 2 == 0, "quote-low").otherwise("quote-high")
    return toks.withColumn("key", F.when(F.col("quote"), form).otherwise(F.col("key")))


def coverage(toks: DataFrame, inventory: DataFrame, keys: Sequence[str], once: bool = False) -> DataFrame:
    """Words whose every key is in the inventory and ready; `missing` counts the others. `once`: `toks` hold a key of a word once."""
    inv = inventory.select("key", F.col("ready").alias("_ready"))
    need = toks.where(F.col("key").isNotNull()).select(*keys, "key")
    j = (need if once else need.distinct()).join(inv, "key", "left")
    ready = F.coalesce("_ready", F.lit(False))
    return j.groupBy(*keys).agg(F.bool_and(ready).alias("qualifies"), F.count_if(~ready).alias("missing"))


# ------------------------------------------------------------------ look-alikes


def _features(words: DataFrame, word: str) -> DataFrame:
    return words.select(
        F.col(word).alias("w"),
        X.is_capitalised(F.col(word)).alias("cap"),
        F.length(word).alias("len"),
        F.lower(F.substring(word, 1, 1)).alias("f"),
        F.lower(F.substring(word, -1, 1)).alias("l"),
    )


def _near_length(lexicon: DataFrame) -> DataFrame:
    """Lexicon rows offered to answers one letter shorter and one letter longer."""
    return lexicon.select("*", F.explode(F.array(F.col("len") - 1, F.col("len") + 1)).alias("for_len"))


def _pieces(words: DataFrame) -> DataFrame:
    """Letter-class pieces of a word: with L letters at most (L+1)/3 can differ in class in a positive score, so one of
    floor((L+1)/3)+1 aligned pieces must agree."""
    n = F.floor((F.col("len") + 1) / 3).cast("int") + 1
    cls = X.letter_class(F.col("w"))

    def piece(j: Column) -> Column:
        lo = F.floor(j * F.col("len") / n).cast("int")
        hi = F.floor((j + 1) * F.col("len") / n).cast("int")
        return F.substring(cls, lo + 1, hi - lo)

    return words.withColumn("pieces", F.transform(F.sequence(F.lit(0), n - 1), piece)).withColumns({"code": X.letter_codes(F.col("w")), "cls": cls})


def equal_length_pairs(answers: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(answer, candidate, score) of equal length with a positive score; every such pair appears exactly once.

    The outer explode keeps Spark from inferring a size filter, which it would evaluate on every raw word.

    Pairs meet on an aligned piece of letter classes and are kept at the first piece they share.
    """
    a = _pieces(_features(answers, "word"))
    b = _pieces(_features(lexicon, "word"))
    a = a.select("cap", "len", F.col("w").alias("answer"), F.col("f").alias("af"), F.col("l").alias("al"), F.col("code").alias("ac"), F.col("cls").alias("acls"), F.col("pieces").alias("ap"), F.posexplode_outer("pieces").alias("j", "piece"))
    b = b.select("cap", "len", F.col("w").alias("candidate"), F.col("f").alias("bf"), F.col("l").alias("bl"), F.col("code").alias("bc"), F.col("cls").alias("bcls"), F.col("pieces").alias("bp"), F.posexplode_outer("pieces").alias("j", "piece"))
    m = a.join(b, ["cap", "len", "j", "piece"]).where(
        ((F.col("af") == F.col("bf")) | (F.col("al") == F.col("bl"))) & (F.col("answer") != F.col("candidate"))
    )
    # edit distance never exceeds the number of differing places, and stops early beyond the limit
    m = m.where(F.expr("levenshtein(acls, bcls, int(floor((len + 1) / 3))) >= 0"))
    earlier = F.exists(F.slice(F.zip_with("ap", "bp", lambda x, y: x == y), F.lit(1), F.col("j")), lambda e: e)
    m = m.where((F.col("j") == 0) | ~earlier)
    ends = 2 * (F.col("af") == F.col("bf")).cast("int") + 2 * (F.col("al") == F.col("bl")).cast("int")
    score = ends + X.difference_score(F.col("ac"), F.col("bc"))
    return m.select("answer", "candidate", score.alias("score")).where(F.col("score") > 0)


def _heads(lexicon: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """First k words per key in text order; every task keeps at most k per key."""
    w = Window.partitionBy(*keys).orderBy("w")
    return lexicon.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def other_length_heads(answers: DataFrame, lexicon: DataFrame, k: int) -> DataFrame:
    """The candidates one letter shorter or longer that can reach an answer's top k: (answer, candidate, score).

    Both ends shared scores 3, one end shared scores 1, ties are in text order. So per group of ends only the first k
    words matter, and for one shared end the first k per other end. No pair outside these heads can be in a top k.
    """
    a = _features(answers, "word").select(F.col("w").alias("answer"), "cap", F.col("len").alias("for_len"), F.col("f").alias("af"), F.col("l").alias("al"))
    near = _near_length(_features(lexicon, "word"))
    group = ["cap", "for_len", "f", "l"]
    heads = checkpointed(_heads(near, group, k))
    both = a.join(heads, (a.cap == heads.cap) & (a.for_len == heads.for_len) & (a.af == heads.f) & (a.al == heads.l)).select(
        "answer", F.col("w").alias("candidate"), F.lit(3).alias("score")
    )
    out = both
    for shared, other in (("f", "l"), ("l", "f")):
        # one table per (shared end, excluded other end): its size depends on the alphabet, not on the data
        excl = a.select("cap", "for_len", F.col(f"a{shared}").alias(shared), F.col(f"a{other}").alias("_skip")).distinct()
        table = heads.join(excl, ["cap", "for_len", shared]).where(F.col("_skip") != F.col(other))
        table = _heads(table, ["cap", "for_len", shared, "_skip"], k).select("cap", "for_len", shared, "_skip", "w")
        one = a.select("answer", "cap", "for_len", F.col(f"a{shared}").alias(shared), F.col(f"a{other}").alias("_skip")).join(
            table, ["cap", "for_len", shared, "_skip"]
        )
        out = out.unionByName(one.select("answer", F.col("w").alias("candidate"), F.lit(1).alias("score")))
    return out


def best_lookalikes(answers: DataFrame, lexicon: DataFrame, k: int = 4) -> DataFrame:
    """Top k look-alikes per answer by (score desc, text)."""
    # both word lists are read several times and come from whole texts
    answers, lexicon = checkpointed(answers.select("word")), checkpointed(lexicon.select("word"))
    pairs = equal_length_pairs(answers, lexicon).unionByName(other_length_heads(answers, lexicon, k))
    w = Window.partitionBy("answer").orderBy(F.col("score").desc(), "candidate")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def plausible_counts(answers: DataFrame, lexicon: DataFrame) -> DataFrame:
    """How many plausible look-alikes each answer has. Other lengths are counted from group sizes, not from pairs."""
    answers, lexicon = checkpointed(answers.select("word")), checkpointed(lexicon.select("word"))
    a = _features(answers, "word").select(F.col("w").alias("answer"), "cap", F.col("len").alias("for_len"), "f", "l")
    near = _near_length(_features(lexicon, "word"))
    out = a
    for name, ends in (("_f", ["f"]), ("_l", ["l"]), ("_fl", ["f", "l"])):
        n = near.groupBy("cap", "for_len", *ends).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, ["cap", "for_len", *ends], "left")
    z = F.lit(0)
    other = F.coalesce("_f", z) + F.coalesce("_l", z) - F.coalesce("_fl", z)
    same = equal_length_pairs(answers, lexicon).groupBy("answer").agg(F.count(F.lit(1)).alias("_same"))
    return out.join(same, "answer", "left").select(
        "answer", other.alias("other_length"), F.coalesce("_same", z).alias("same_length"), (other + F.coalesce("_same", z)).alias("plausible")
    )


def bank_problems(bank: DataFrame, eras: Sequence[str]) -> DataFrame:
    """Every broken rule of a question bank: (word, problem). bank(word, distractors, era, note, marked)."""
    twice = bank.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word", F.lit("duplicate_word").alias("problem"))
    d = F.col("distractors")
    rules = {
        "era": ~F.coalesce(F.col("era").isin(list(eras)), F.lit(False)),
        "no_distractor": F.coalesce(F.size(d), F.lit(0)) < 1,
        "answer_in_list": F.array_contains(d, F.col("word")),
        "duplicate_in_list": F.size(F.array_distinct(d)) < F.size(d),
        "historic_without_note": (F.col("era") == "historic") & (F.trim(F.coalesce("note", F.lit(""))) == ""),
        "marked_form": F.col("marked").isNotNull() & (X.strip_marker(F.col("marked")) != F.col("word")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return twice.unionByName(bank.select("word", F.explode(found).alias("problem")))


# --------------------------------------------------------------------- sampling


def weighted_sample(rows: DataFrame, keys: Sequence[str], k: int, weight: Column, uniform: Column, id_col: str) -> DataFrame:
    """k rows per key without replacement, larger weights first in expectation: the k smallest of -ln(u) / w."""
    w = Window.partitionBy(*keys).orderBy("_key", id_col)
    keyed = rows.withColumn("_key", -F.log(uniform) / weight)
    return keyed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_key")


#: Fixed value: weight of a pinned row that is not the first pick.
PIN_WEIGHT = 8.0


def pinned_sample(rows: DataFrame, keys: Sequence[str], k: int, pinned: Column, score: Column, uniform: Column, id_col: str) -> DataFrame:
    """k rows per key: one of the pinned rows first, then a weighted draw without replacement, then a top-up from the rest.

    The draw holds the other pins with weight 8 and the rows of a positive score with their score; rows without a score fill what
    is left. `uniform` in (0, 1) decides all three. Adds `place` from 1.
    """
    drawn = pinned | (score > 0)
    weight = F.when(pinned, PIN_WEIGHT).otherwise(score.cast("double"))
    r = rows.withColumn("_pin", pinned).withColumn("_u", uniform).withColumn("_key", F.when(drawn, -F.log(uniform) / weight).otherwise(uniform))
    r = r.withColumn("_tier", F.when(drawn, 1).otherwise(2))
    first = r.where("_pin").groupBy(*keys).agg(F.min(F.struct("_u", id_col)).alias("_first"))
    r = r.join(first, list(keys), "left")
    anchor = F.col("_pin") & (F.col(id_col) == F.col(f"_first.{id_col}"))
    w = Window.partitionBy(*keys).orderBy(F.when(anchor, 0).otherwise(F.col("_tier")), "_key", id_col)
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_pin", "_u", "_key", "_tier", "_first")


def seeded_uniform(seed: int, *cols: str) -> Column:
    """Uniform number in (0, 1) from a hash of the seed and columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


# --------------------------------------------------------------------- sessions


def session_tallies(events: DataFrame, keys: Sequence[str], pos: str, ok: str) -> DataFrame:
    """Seen, correct, current and best streak per session over a dense position. Streaks are islands of `ok`."""
    t = running_total(events, keys, pos, {"_bad": (~F.col(ok)).cast("int")})
    runs = t.where(F.col(ok)).groupBy(*keys, "_bad").agg(F.count(F.lit(1)).alias("_len"), F.max(pos).alias("_end"))
    best = runs.groupBy(*keys).agg(F.max("_len").alias("best_streak"), F.max_by("_len", "_end").alias("_last"), F.max("_end").alias("_end"))
    n = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(ok).alias("correct"), F.max(pos).alias("_max")
    )
    z = F.lit(0)
    return n.join(best, list(keys), "left").select(
        *keys,
        "seen",
        "correct",
        F.when(F.col("_end") == F.col("_max"), F.col("_last")).otherwise(z).alias("streak"),
        F.coalesce("best_streak", z).alias("best_streak"),
    )


def confusions(events: DataFrame, keys: Sequence[str], right: str, guessed: str) -> DataFrame:
    """Counts of (right, guessed) where they differ."""
    return events.where(F.col(right) != F.col(guessed)).groupBy(*keys, right, guessed).agg(F.count(F.lit(1)).alias("n"))

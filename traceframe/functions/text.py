"""Shaping of words into keys and look-alike scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "|"

# fixed values: two-letter clusters and single units with a form of their own
CLUSTERS = {"ch": "ch", "ck": "ck", "tz": "tz", "qu": "qu", "st": "longst", "ſt": "longst", "ß": "sz"}
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
DETACHED = {
    ".": "period", ",": "comma", ";": "semicolon", ":": "colon", "!": "exclam", "?": "question", "'": "apostrophe",
    "’": "apostrophe", "„": "quote-low", "“": "quote-high", "”": "quote-high", "-": "hyphen", "‐": "hyphen",
    "‑": "hyphen", "–": "dash", "—": "dash", "(": "paren-open", ")": "paren-close", "§": "section",
}
MARKS_PER_KEY = {"i": 1, "j": 1, "u": 1, "ae": 1, "oe": 1, "ue": 1, "Ae": 1, "Oe": 1, "Ue": 1}
CONFUSABLE = [
    ("e", "n"), ("n", "u"), ("u", "a"), ("n", "m"), ("m", "w"), ("h", "k"), ("h", "b"), ("b", "l"), ("k", "l"),
    ("f", "s"), ("f", "ſ"), ("c", "e"), ("r", "x"), ("g", "z"), ("i", "e"), ("t", "l"),
]

# leftmost alternative wins: clusters, single units, an s with or without the boundary marker, the marker, any character
TOKENS = r"(ch|ck|tz|qu|[sſ]t|ß|[sſ]\|?|\||.)"


def registry_rows() -> list[tuple[str, str, bool, bool]]:
    """(text, key, ligature, joins) of every written form with a fixed key."""
    plain = [(c, c, False, True) for a, z in (("a", "z"), ("A", "Z")) for c in map(chr, range(ord(a), ord(z) + 1)) if c != "s"]
    rows = plain + [(t, k, False, True) for t, k in UMLAUTS.items()] + [(t, k, True, True) for t, k in CLUSTERS.items()]
    rows += [(str(n), str(n), False, False) for n in range(10)]
    return rows + [(t, k, False, False) for t, k in DETACHED.items()]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), "text STRING, key STRING, ligature BOOLEAN, joins BOOLEAN")


def strip_marker(text: Column) -> Column:
    return F.replace(text, F.lit(MARKER), F.lit(""))


def squeeze(text: Column) -> Column:
    """Whitespace runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_capitalised(word: Column) -> Column:
    """The first letter has two cases and is the upper one."""
    c = F.substring(word, 1, 1)
    return (F.upper(c) == c) & (F.lower(c) != c)


def expected_marks(keys: Column) -> Column:
    """Delayed marks a key list asks for."""
    marked = F.array(*[F.lit(k) for k in MARKS_PER_KEY])
    return F.size(F.filter(keys, lambda k: F.array_contains(marked, k)))


def letter_class(word: Column) -> Column:
    """Lower-case word with every letter replaced by the least letter it can be reached from by confusions."""
    least = {}

    def root(c: str) -> str:
        while least.setdefault(c, c) != c:
            c = least[c]
        return c

    for a, b in CONFUSABLE:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    letters = sorted(least)
    return F.translate(F.lower(word), "".join(letters), "".join(root(c) for c in letters))


_LETTERS = sorted({c for p in CONFUSABLE for c in p})
_LOW = (1 << len(_LETTERS)) - 1


def letter_codes(word: Column) -> Column:
    """Lower-case letters as numbers: code point, own bit and the bits of the letters they are confused with.

    Two codes are equal for equal letters; letters are confusable when one's mask holds the other's bit.
    """
    n = len(_LETTERS)
    codes = {}
    for i, c in enumerate(_LETTERS):
        mask = sum(1 << _LETTERS.index(b if a == c else a) for a, b in CONFUSABLE if c in (a, b))
        codes[c] = ord(c) | (1 << i) << 21 | mask << (21 + n)
    lookup = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    return F.transform(F.split(F.lower(word), ""), lambda c: F.coalesce(F.element_at(lookup, c), F.ascii(c).cast("bigint")))


def difference_score(a: Column, b: Column) -> Column:
    """Sum over equal-length letter codes: 0 same, +1 confusable, -2 any other difference."""
    n = len(_LETTERS)

    def step(x: Column, y: Column) -> Column:
        hit = F.shiftright(x, 21 + n).bitwiseAND(F.shiftright(y, 21)).bitwiseAND(F.lit(_LOW))
        return F.when(x == y, 0).when(hit != 0, 1).otherwise(-2)

    return F.aggregate(F.zip_with(a, b, step), F.lit(0), lambda s, v: s + v)

"""Secret scans with DataFrame functions only.

Three patterns give the base spans.  Further candidates are long strings of key
characters; a window slides over each of them, and the Shannon entropy of the
window follows from counts that change by one character in and one out.  A
candidate whose highest window entropy reaches the threshold of its character
class is a span too, unless the allow-list or a base span covers it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns by kind, in the order in which equal starts are listed.  Where
#: a shorter match fails, the quantifier states the needed length at once if
#: that gives the same spans (maximal runs); ``assign`` is filtered afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEPT = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})$"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that may be secrets: whole runs of key characters.
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Character classes: name, pattern of strings within it, alphabet, least
#: entropy in bits of some window.  The first that fits is used.
CLASSES = (
    ("hex", "^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 3.0),
    ("alnum", "^[0-9A-Za-z]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
    ("base64", "^.*$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.8),
)
#: Candidates that are no secrets whatever their entropy.
ALLOWED = (
    "^[A-Za-z]+$",  # one long word
    "^[0-9]+$",  # a number
    "^([A-Za-z]*|[0-9]*)([+/_=-]+([A-Za-z]*|[0-9]*))*$",  # words and numbers joined: paths, dates, headings
    "^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",  # identifiers
    "(?i)example|placeholder|redacted|dummy|xxxx",
)
WINDOW = 20
_BLOCK = 256


def _starts(lengths: Column) -> Column:
    """Exclusive running totals of an array, in blocks so that copying stays small."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    zero = F.array(F.lit(0))
    more = lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))
    heads = F.aggregate(F.transform(blocks, total), zero, more)
    inner = F.zip_with(blocks, F.slice(heads, 1, F.size(heads) - 1), lambda b, h: F.slice(F.aggregate(b, F.array(h), more), 1, F.size(b)))
    return F.flatten(inner)


def _located(kind: int, matches: Column, gaps: Column) -> Column:
    """Spans of matches, from the lengths of the texts between them."""
    lengths = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    spans = F.transform(
        F.arrays_zip(matches.alias("m"), _starts(lengths).alias("s"), gaps.alias("g")),
        lambda x: F.struct(
            (x["s"] + F.length(x["g"])).alias("start"),
            F.lit(kind).alias("kind"),
            (x["s"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
            x["m"].alias("text"),
        ),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>")
    return F.when(F.size(matches) > 0, F.slice(spans, 1, F.size(matches))).otherwise(none)


def _peak_entropy(text: Column, alphabet: str) -> Column:
    """Highest Shannon entropy in bits of any window of ``WINDOW`` characters.

    The state holds the counts of the alphabet in the window and the sum of
    count * log2(count); a step adds the entering and removes the leaving
    character's share.
    """
    part = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak")
    )
    place = lambda i: F.instr(F.lit(alphabet), F.substring(text, i, F.lit(1)))

    def step(state: Column, i: Column) -> Column:
        enters = place(i)
        leaves = F.when(i > WINDOW, place(i - WINDOW)).otherwise(F.lit(0))
        n = F.element_at(state["counts"], enters)
        more = F.element_at(part, n + 2) - F.element_at(part, n + 1)
        # the leaving character is counted after the entering one has come in
        m = F.when(leaves > 0, F.element_at(state["counts"], F.greatest(leaves, F.lit(1))) + F.when(leaves == enters, 1).otherwise(0))
        less = F.when(leaves > 0, F.element_at(part, m + 1) - F.element_at(part, m)).otherwise(0.0)
        total = state["sum"] + more - less
        counts = F.transform(state["counts"], lambda c, j: c + (j + 1 == enters).cast("int") - (j + 1 == leaves).cast("int"))
        full = F.when(i >= WINDOW, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(0.0)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(state["peak"], full).alias("peak"))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), zero, step, lambda s: s["peak"])


def _is_secret(text: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a candidate passes the allow-list and its class's entropy."""
    suspect = F.lit(True)
    for pattern in allowed:
        suspect = suspect & ~text.rlike(pattern)
    dense = F.lit(False)
    for _, pattern, alphabet, least in reversed(CLASSES):
        dense = F.when(text.rlike(pattern), _peak_entropy(text, alphabet) >= least).otherwise(dense)
    return F.when(suspect, dense).otherwise(F.lit(False))


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Documents with ``secret_spans``: an array of (start, kind, end, text).

    Positions are code points from 0, the end is exclusive, the order is start
    and then kind (an index into ``KINDS``).  Null and empty texts have no
    spans, every row is scanned by itself, an empty table gives no rows.  A
    column named ``secret_spans`` is replaced, all others are kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.drop("secret_spans")
    for name, pattern in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("e", CANDIDATE)):
        found = found.withColumn(f"__{name}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for name, pattern in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("e", CANDIDATE)):
        gaps = F.when(F.size(f"__{name}") > 0, F.split(text, pattern, -1))
        found = found.withColumn(f"__{name}", _located(KINDS.index(dict(a="assign", k="access", h="hex", e="entropy")[name]), F.col(f"__{name}"), gaps))
    base = F.concat(F.filter("__a", lambda s: s["text"].rlike(ASSIGN_KEPT)), F.col("__k"), F.col("__h"))
    found = found.withColumn("__base", base)
    covered = lambda s: F.exists("__base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    added = F.filter("__e", lambda s: ~covered(s) & _is_secret(s["text"], allowed))
    found = found.withColumn("secret_spans", F.array_sort(F.concat(F.col("__base"), added)))
    return found.drop("__a", "__k", "__h", "__e", "__base")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts of each base kind, the digest of the base spans, and all spans."""
    of = lambda k: F.filter("secret_spans", lambda s: s["kind"] == KINDS.index(k))
    base = F.filter("secret_spans", lambda s: s["kind"] < KINDS.index("entropy"))
    return scanned.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
    )


def masked(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The texts with every run of overlapping spans replaced, and ``n_chars`` to match."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))
        out = F.when((x["start"] >= s["at"]), fresh).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    whole = F.aggregate("secret_spans", state, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.size("secret_spans") > 0, whole).otherwise(F.col("text"))
    out = scanned.withColumn("text", text).drop("secret_spans")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in scanned.columns else out

"""Secret scan: patterns of credentials, and a sliding-window entropy, in DataFrame functions only.

Three patterns give the base spans. Runs of a character class as long as its window are candidates
for the added ones: unless the allow-list knows them, a window slides over each, and counts of its
characters, updated by the one that enters and the one that leaves, give its Shannon entropy. Windows
that reach the class's entropy are merged into spans. A text is worked on where it is read: nothing
is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Pattern(NamedTuple):
    """A kind of base span: matches of ``regex`` whose ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int
    least: int


class Class(NamedTuple):
    """A character class of candidates: windows of ``window`` characters with ``bits`` of entropy or more."""

    kind: str
    characters: str
    window: int
    bits: float


#: The kinds in the order of their spans. A run of one class that must have so many
#: characters says so itself; where a failing match hides what follows, the length is looked at after.
PATTERNS = (
    Pattern("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Pattern("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Pattern("hex", r"[0-9a-f]{16,}", 0, 16),
)
CLASSES = (Class("entropy_hex", "[0-9A-Fa-f]", 24, 3.0), Class("entropy_base64", "[A-Za-z0-9+/_=-]", 24, 4.0))
#: Candidates that are no secrets: words and paths, numbers, stand-ins, counting, and UUIDs.
ALLOWED = (r"^[A-Za-z_/+=-]+$", r"^[0-9_/+=-]+$", r"(?i)example|sample|dummy|placeholder|changeme|redacted", r"(?i)0123456789|abcdefghij", r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")

#: Running sums are made in portions of this length, so that no list is copied once for each element.
PORTION = 512
#: c * log2(c) in these parts, so that sums of it are whole numbers.
PARTS = 1 << 20

_INTS = "array<int>"


def running(steps: Column) -> Column:
    """The sum of the elements before each element of an array of integers."""
    portions = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PORTION).cast("int")), lambda i: F.slice(steps, i * PORTION + 1, F.lit(PORTION)))
    held = F.transform(portions, lambda p: F.struct(p.alias("steps"), F.aggregate(p, F.lit(0), lambda a, x: a + x).alias("sum")))

    def append(state: Column, x: Column) -> Column:
        return F.struct((state["sum"] + x).alias("sum"), F.concat(state["out"], F.array(state["sum"])).alias("out"))

    def portion(state: Column, p: Column) -> Column:
        inner = F.aggregate(p["steps"], F.struct(state["sum"].alias("sum"), F.array().cast(_INTS).alias("out")), append, lambda s: s["out"])
        return F.struct((state["sum"] + p["sum"]).alias("sum"), F.concat(state["out"], F.array(inner)).alias("out"))

    start = F.struct(F.lit(0).alias("sum"), F.array().cast(f"array<{_INTS}>").alias("out"))
    return F.when(F.size(steps) > 0, F.flatten(F.aggregate(held, start, portion, lambda s: s["out"]))).otherwise(F.array().cast(_INTS))


def located(df: DataFrame, text: str, regex: str, name: str) -> DataFrame:
    """``df`` with the matches of ``regex`` as a column ``name`` of (start, match), in code points.
    Texts without one are looked at once."""
    none = "array<struct<gap:int,match:string>>"
    gaps = F.transform(F.split(F.col(text), regex, -1), lambda g: F.length(g))
    pairs = F.zip_with(gaps, F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())  # the last gap has none
    df = df.withColumn(name, F.when(F.col(text).rlike(regex), pairs).otherwise(F.array().cast(none)))
    ends = F.zip_with(name, running(F.transform(name, lambda p: p["gap"] + F.length(p["match"]))), lambda p, before: F.struct((before + p["gap"]).alias("start"), p["match"].alias("match")))
    return df.withColumn(name, ends)


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def pattern_spans(matches: str, kind: int, pattern: Pattern) -> Column:
    whole = F.filter(matches, lambda m: F.length(F.regexp_extract(m["match"], pattern.regex, pattern.group)) >= pattern.least)
    return F.transform(whole, lambda m: _span(kind, m["start"], m["start"] + F.length(m["match"])))


def entropy_spans(df: DataFrame, candidates: str, kind: int, window: int, bits: float) -> DataFrame:
    """``df`` with its column of (start, match) turned into the spans that high-entropy windows cover."""
    weights = [0] + [round(c * math.log2(c) * PARTS) for c in range(1, window + 1)]
    # what the c-th copy of a character adds to the sum of c * log2(c); entropy is log2(window) - sum / window
    added = F.array(*[F.lit(b - a) for a, b in zip(weights, weights[1:], strict=False)])
    most = math.floor(window * (math.log2(window) - bits) * PARTS)
    df = df.withColumn(candidates, F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.split(c["match"], "").alias("chars"))))
    df = df.withColumn(candidates, F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["chars"].alias("chars"), F.array_distinct(c["chars"]).alias("alphabet"))))
    df = df.withColumn(
        candidates,
        F.transform(
            candidates,
            lambda c: F.struct(c["start"].alias("start"), F.transform(c["chars"], lambda x: F.array_position(c["alphabet"], x).cast("int")).alias("codes"), F.transform(c["alphabet"], lambda _: F.lit(0)).alias("zeros")),
        ),
    )

    def slid(c: Column) -> Column:
        codes = c["codes"]

        def step(s: Column, i: Column) -> Column:
            """The window that ended before the i-th character is judged, then it moves on to end behind it."""
            enters, leaves = F.get(codes, i - 1), F.when(i > window, F.get(codes, i - window - 1))
            high = (i > window) & (s["sum"] <= most)
            begin, end = c["start"] + i - 1 - window, c["start"] + i - 1
            apart = high & (F.coalesce(s["end"], F.lit(-1)) < begin)
            counts = F.transform(s["counts"], lambda n, at: n + F.when(at + 1 == enters, 1).otherwise(0) - F.when(at + 1 == leaves, 1).otherwise(0))
            grown = F.get(s["counts"], enters - 1)
            shrunk = F.get(s["counts"], leaves - 1) + F.when(leaves == enters, 1).otherwise(0)
            moved = s["sum"] + F.coalesce(F.get(added, grown), F.lit(0)) - F.coalesce(F.get(added, shrunk - 1), F.lit(0))
            done = F.when(apart & s["end"].isNotNull(), F.concat(s["done"], F.array(_span(kind, s["begin"], s["end"])))).otherwise(s["done"])
            return F.struct(
                counts.alias("counts"), moved.cast("int").alias("sum"),
                F.when(apart, begin).otherwise(s["begin"]).alias("begin"), F.when(high, end).otherwise(s["end"]).alias("end"), done.alias("done"),
            )

        start = F.struct(c["zeros"].alias("counts"), F.lit(0).alias("sum"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"), F.array().cast(_SPANS).alias("done"))
        last = lambda s: F.when(s["end"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(_span(kind, s["begin"], s["end"]))))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes) + 1), start, step, last)

    return df.withColumn(candidates, F.flatten(F.transform(candidates, slid)))


def find_secrets(docs: DataFrame, text: str = "text", patterns: tuple[Pattern, ...] = PATTERNS, classes: tuple[Class, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with a last column ``secrets``: an array of (start, kind, end), in code points, the end
    exclusive, by start and then in the order of the kinds, patterns before classes.

    A pattern's spans are its leftmost matches that do not overlap, whole, without those whose group
    is too short. The allow-list suppresses candidates of the classes, not the patterns' spans. Null
    and empty texts have no spans; texts are read whole; repeated rows each get their spans; an empty
    table gives an empty table; other columns stay, whatever their names, but one named ``secrets``,
    which is replaced. The spans of a text must fit into a task's memory, as the text does.
    """
    names = [*[p.kind for p in patterns], *[c.kind for c in classes]]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"]).alias("kept"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    columns = []
    for kind, p in enumerate(patterns):
        columns.append(f"spans_{kind}")
        out = located(out, "text", p.regex, columns[-1])
        out = out.withColumn(columns[-1], pattern_spans(columns[-1], kind, p))
    for kind, c in enumerate(classes, len(patterns)):
        columns.append(f"spans_{kind}")
        out = located(out, "text", f"{c.characters}{{{c.window},}}", columns[-1])
        out = out.withColumn(columns[-1], F.filter(columns[-1], lambda m: ~reduce(or_, [m["match"].rlike(rule) for rule in allowed], F.lit(False))))
        out = entropy_spans(out, columns[-1], kind, c.window, c.bits)
    found = F.array_sort(F.concat(*columns))
    labels = F.array(*[F.lit(n) for n in names])
    return out.select("kept.*", F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.get(labels, s["kind"]).alias("kind"), s["end"].alias("end"))).alias("secrets"))


def written_spans(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its id, how many base spans of each kind, the SHA-256 of the base
    spans' text, and all spans as text. Behaves as :func:`find_secrets` with odd rows."""
    kinds = [p.kind for p in PATTERNS]
    found = find_secrets(docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text}`").alias("text")))
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    of_kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{k}") for k in kinds]
    return found.select(id_column, *counts, F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(F.col("secrets")).alias("spans"))

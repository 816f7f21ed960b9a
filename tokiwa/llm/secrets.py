"""Secret scanning with DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.functions.pretokens import running, scanned

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
EMPTY = f"cast(array() as array<{SPAN}>)"


@dataclass(frozen=True)
class Kind:
    """A pattern, the group whose length counts, and its least length."""

    name: str
    pattern: str
    group: int
    least: int


#: A run of [A-Z0-9] or [0-9a-f] that is too short leaves nothing for a shorter match to start in, so for the last two a
#: least length in the pattern finds the same spans as dropping short matches; for the first it would not.
KINDS = (
    Kind("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharClass:
    """Strings wholly of `chars` with all of `needs` are suspect if some window of that many has this many bits a character."""

    name: str
    chars: str
    needs: tuple[str, ...]
    window: int
    bits: float


@dataclass(frozen=True)
class Entropy:
    """Candidate strings, their classes (the first that fits decides) and what is let through."""

    candidate: str = r"[A-Za-z0-9+/_=-]{20,}"
    least: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass("hex", "[0-9a-fA-F]+", ("[0-9]", "[a-fA-F]"), 16, 3.0),
        CharClass("alphanumeric", "[0-9A-Za-z]+", ("[0-9]", "[A-Za-z]"), 20, 3.6),
        CharClass("base64", "[0-9A-Za-z+/_=-]+", ("[0-9]", "[A-Za-z]"), 20, 3.8),
    )
    allow: tuple[str, ...] = field(
        default=(
            r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
            r"^[A-Za-z/_=+-]+$",  # words, paths and identifiers without a digit
            r"^[0-9/_=+-]+$",  # dates, phone and card numbers
            r"^([0-9A-Za-z])\1+$",  # one character over and over
            r"^[A-Z]?[a-z]+([_/-][A-Z]?[a-z]+)*[_/-]?[0-9]{1,4}$",  # names with a number at their end
        )
    )


def found(text: Column, kind: Kind, rank: int) -> Column:
    """The spans of kind in text, as code points, leftmost and not overlapping.

    Splitting at the pattern and extracting it give the gaps and the matches in turn; their lengths add up to offsets.
    """
    zipped = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("hit"),
        F.regexp_extract_all(text, F.lit(kind.pattern), kind.group).alias("value"),
    )

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.when(F.length(x["value"]) >= kind.least, F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["hit"])).alias("end"), F.lit(kind.name).alias("kind"), x["hit"].alias("value")))

    lengths = lambda xs: F.transform(xs, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
    spans = F.transform(F.array(zipped), lambda xs: F.filter(F.zip_with(xs, running(lengths(xs)), span), lambda s: s.isNotNull()))[0]
    return F.when(text.rlike(kind.pattern), spans).otherwise(F.expr(EMPTY))


def apart(candidates: Column, spans: Column) -> Column:
    """The candidates that overlap none of the spans: one pass over both in order, keeping how far the spans have reached."""

    def judged(both: Column) -> Column:
        ends = F.transform(both["c"], lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("span"), i.alias("i"), F.lit(0).alias("end")))
        begins = F.transform(both["s"], lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("span"), F.lit(0).alias("i"), s["end"].alias("end")))
        marks = F.array_sort(F.concat(ends, begins))  # what begins where a candidate ends comes after it
        reached = F.transform(F.array(marks), lambda ms: F.zip_with(ms, scanned(F.transform(ms, lambda m: m["end"]), F.lit(0), F.greatest), lambda m, r: F.when(m["span"] == 0, F.struct(m["i"].alias("i"), r.alias("r")))))[0]
        by_place = F.array_sort(F.filter(reached, lambda x: x.isNotNull()))
        return F.filter(F.zip_with(both["c"], by_place, lambda c, x: F.when(x["r"] <= c["start"], c)), lambda c: c.isNotNull())

    found = F.transform(F.array(F.struct(candidates.alias("c"), spans.alias("s"))), judged)[0]
    return F.when((F.size(candidates) == 0) | (F.size(spans) == 0), candidates).otherwise(found)


def window_entropy(value: Column, window: int) -> Column:
    """The most bits a character of any window of that many characters of value (ASCII), from incremental counts.

    One character enters and one leaves at each step; the counts and the sum of n log2 n change for these two alone.
    Counts are kept for the characters that value has.
    """
    weigh = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def events(codes: Column) -> Column:
        event = lambda code, by: F.struct(code.alias("code"), F.lit(by).alias("by"))
        return F.flatten(F.transform(codes, lambda c, i: F.when(i >= window, F.array(event(F.get(codes, i - window), -1), event(c, 1))).otherwise(F.array(event(c, 1)))))

    def step(acc: Column, e: Column) -> Column:
        n = F.get(acc["counts"], e["code"])
        total = acc["total"] + weigh(n + e["by"]) - weigh(n)
        size = acc["size"] + e["by"]
        bits = F.log2(F.lit(float(window))) - total / window
        return F.struct(
            F.transform(acc["counts"], lambda v, k: F.when(k == e["code"], v + e["by"]).otherwise(v)).alias("counts"),
            size.alias("size"),
            total.alias("total"),
            F.when(size == window, F.greatest(acc["most"], bits)).otherwise(acc["most"]).alias("most"),
        )

    def most(chars: Column) -> Column:
        distinct = F.array_distinct(chars)
        codes = F.transform(F.array(distinct), lambda d: F.transform(chars, lambda c: (F.array_position(d, c) - 1).cast("int")))[0]
        start = F.struct(F.array_repeat(F.lit(0), F.size(distinct)).alias("counts"), F.lit(0).alias("size"), F.lit(0.0).alias("total"), F.lit(0.0).alias("most"))
        return F.transform(F.array(codes), lambda c: F.aggregate(events(c), start, step)["most"])[0]

    return F.transform(F.array(F.split(value, "")), most)[0]


def suspicious(value: Column, entropy: Entropy) -> Column:
    allowed = F.lit(False)
    for pattern in entropy.allow:
        allowed = allowed | value.rlike(pattern)
    verdict = F.lit(False)
    for c in reversed(entropy.classes):
        needs = F.lit(True)
        for pattern in c.needs:
            needs = needs & value.rlike(pattern)
        verdict = F.when(value.rlike(f"^{c.chars}$"), F.when(needs, F.round(window_entropy(value, c.window), 9) >= c.bits).otherwise(False)).otherwise(verdict)
    return F.when(allowed, False).otherwise(verdict)


def scan(docs: DataFrame, entropy: Entropy = Entropy()) -> DataFrame:
    """docs (text and any other columns) with `base_spans` and `spans`.

    Both are arrays of struct(start, rank, end, kind, value) in order of start, then of kinds as listed in KINDS and
    `entropy` last; offsets are code points, end exclusive. base_spans: the matches of KINDS. spans: these and the
    candidates of high windowed entropy that are not on the allow list and overlap no base span. A null or empty text
    has none; an empty table gives an empty result. Columns of docs that clash with the two names are replaced; repeated
    rows and null keys pass through. The work grows with a text's length, not with its square, so very long texts do too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop("base_spans", "spans", "_candidates")
    base = docs.withColumn("base_spans", F.array_sort(F.concat(*[found(text, k, i) for i, k in enumerate(KINDS)])))
    base = base.withColumn("_candidates", found(text, Kind("entropy", entropy.candidate, 0, entropy.least), len(KINDS)))
    more = F.filter(apart(F.col("_candidates"), F.col("base_spans")), lambda c: suspicious(c["value"], entropy))
    return base.withColumn("spans", F.when(F.size("_candidates") == 0, F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", more)))).drop("_candidates")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans replaced by mark."""

    def joined(x: Column) -> Column:
        reached = scanned(F.transform(x["spans"], lambda s: s["end"]), F.lit(0), F.greatest)
        kept = F.filter(F.zip_with(x["spans"], reached, lambda s, at: F.when(s["start"] >= at, F.struct(at.alias("at"), s["start"].alias("start")))), lambda s: s.isNotNull())
        cut = lambda at, n: F.array_join(F.slice(x["chars"], at + 1, n), "")  # noqa: E731  # a substring would be sought from the text's start
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(kept, lambda k: F.concat(cut(k["at"], k["start"] - k["at"]), F.lit(mark))), ""), cut(last, F.size(x["chars"]) - last))

    done = F.transform(F.array(F.struct(F.split(text, "").alias("chars"), spans.alias("spans"))), joined)[0]
    return F.when(F.size(spans) == 0, text).otherwise(done)

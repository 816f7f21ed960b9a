"""The analyzer as Spark functions: Arrow UDFs, a table function, tags on top, and an engine that holds dictionaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokiwa import __version__
from tokiwa.operators import lattice, tokens

MORPHEME = (
    "struct<surface:string,start:int,end:int,pos:string,extended_pos:string,lemma:string,conj_type:string,conj_form:string,is_dictionary:boolean,is_user_dict:boolean,"
    "is_formal_noun:boolean,is_unknown:boolean,is_low_info:boolean>"
)
EDGE = "struct<edge_id:int,start:int,end:int,surface:string,pos:string,extended_pos:string,cost:float,lemma:string,known:boolean>"
PAIR = "struct<surface:string,pos:string>"
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "float": pa.float32()}
#: Values of so many morphemes are turned to Arrow at a time, so that few Python objects live at once.
MOST_PAIRS = 20_000
#: A dictionary of more bytes of surfaces and lemmas than this doesn't go to every worker.
MOST_BYTES = 256 << 20


def dictionary_entries(df: DataFrame, most: int = 2_000_000, most_bytes: int = MOST_BYTES) -> list[lattice.Entry]:
    """The rows of a dictionary (surface, pos and, if there, extended_pos, lemma, user, formal) for the workers.

    Their number and bytes are counted first; over `most` rows or `most_bytes` bytes it refuses.
    """
    names = [c for c in ("surface", "pos", "extended_pos", "lemma", "user", "formal") if c in df.columns]
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length("surface") + (F.coalesce(F.octet_length("lemma"), F.lit(0)) if "lemma" in names else F.lit(0)))).first()
    if rows > most or (size or 0) > most_bytes:
        raise ValueError(f"a dictionary of {rows} rows and {size} bytes doesn't go to every worker")
    return [lattice.Entry(**{k: v for k, v in r.asDict().items() if v is not None}) for r in df.select(*names).collect()]


@dataclass(frozen=True)
class Shared:
    """A dictionary as a broadcast, which an executor fetches once, and a name that workers know it by."""

    name: str
    entries: Broadcast | None


def shared(entries: list[lattice.Entry]) -> Shared:
    return Shared(uuid.uuid4().hex, SparkSession.active().sparkContext.broadcast(tuple(entries))) if entries else Shared("", None)


_ENGINES: dict[tuple[str, str], lattice.Analyzer] = {}


def engine_of(held: Shared, options: lattice.Options) -> lattice.Analyzer:
    """The worker's analyzer for a dictionary and options: built once a worker, not once a task; a few are kept."""
    name = (held.name, repr(options))
    if name not in _ENGINES:
        if len(_ENGINES) >= 4:
            _ENGINES.clear()
        _ENGINES[name] = lattice.Analyzer(list(held.entries.value) if held.entries else [], options)
    return _ENGINES[name]


def fields_of(schema: str) -> list[pa.Field]:
    """The Arrow fields of a Spark struct of plain types."""
    return [pa.field(name, ARROW[kind]) for name, kind in (f.split(":") for f in schema[len("struct<") : -1].split(","))]


def _lists(schema: str, values: Callable[[lattice.Analyzer, str], Iterator[tuple]], entries: list[lattice.Entry], options: lattice.Options) -> Callable[[Column], Column]:
    """A function from a text column to arrays of structs, from the rows of fields that `values` gives for a text."""
    fields, held = fields_of(schema), shared(entries)

    @F.arrow_udf(f"array<{schema}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = engine_of(held, options)

        def made(offsets: list[int | None], rows: list[tuple]) -> pa.Array:
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            both = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
            return pa.ListArray.from_arrays(pa.array([*offsets, len(rows)], pa.int32()), both)

        for batch in batches:
            parts, offsets, rows = [], [], []
            for raw in batch:
                value = raw.as_py()
                offsets.append(None if value is None else len(rows))
                rows += values(engine, value) if value else ()
                if len(rows) > MOST_PAIRS:
                    parts.append(made(offsets, rows))
                    offsets, rows = [], []
            yield pa.concat_arrays([*parts, made(offsets, rows)])

    return run


def analyzer(entries: list[lattice.Entry] = (), options: lattice.Options = lattice.Options()) -> Callable[[Column], Column]:
    """A function from a text column to its array of morphemes. A null text has none (null); an empty one an empty array."""

    def values(engine: lattice.Analyzer, raw: str) -> list[tuple]:
        return [(m.surface, m.start, m.end, m.pos, m.extended_pos, m.lemma, m.conj_type, m.conj_form, m.is_dictionary, m.is_user_dict, m.is_formal_noun, m.is_unknown, False) for m in engine.analyze(raw)]

    return _lists(MORPHEME, values, list(entries), options)


def explained(entries: list[lattice.Entry] = (), options: lattice.Options = lattice.Options(), by_cost: bool = False) -> Callable[[Column], Column]:
    """A function from a text column to all its candidates, without lexical extraction or chunks.

    They come in the order in which equal costs are decided, or by_cost the cheapest first.
    """

    def values(engine: lattice.Analyzer, raw: str) -> list[tuple]:
        every = [e for here in engine.edges(lattice.normalized(raw, options)) for e in here]
        if by_cost:
            every.sort(key=lambda e: e.cost)
        return [(i, e.start, e.end, e.surface, e.pos, e.extended_pos, e.cost, e.lemma or e.surface, e.known) for i, e in enumerate(every)]

    return _lists(EDGE, values, list(entries), options)


def _pairs(entries: list[lattice.Entry], options: lattice.Options) -> Callable[[Column], Column]:
    """As `analyzer`, with surface and pos only."""
    return _lists(PAIR, lambda engine, raw: [(m.surface, m.pos) for m in engine.analyze(raw)], list(entries), options)


def tagged(morphemes: Column, options: tokens.TagOptions = tokens.TagOptions()) -> Column:
    return tokens.tags(morphemes, options)


def tagger(entries: list[lattice.Entry] = (), options: lattice.Options = lattice.Options(), tag_options: tokens.TagOptions = tokens.TagOptions()) -> Callable[[Column], Column]:
    """A function from a text column to its tags."""
    run = analyzer(entries, options)
    return lambda text: tagged(run(text), tag_options)


def register(spark: SparkSession, entries: list[lattice.Entry] = (), options: lattice.Options = lattice.Options(), tag_options: tokens.TagOptions = tokens.TagOptions()) -> None:
    """analyze(text) and tags(text) as SQL functions and tokenize(text) as a SQL table function."""
    spark.udf.register("analyze", analyzer(entries, options))

    def tag_values(engine: lattice.Analyzer, raw: str) -> list[tuple]:
        return tokens.plain_tags(engine.analyze(raw), tag_options)

    spark.udf.register("tags", _lists("struct<tag:string,pos:string>", tag_values, list(entries), options))
    held = shared(list(entries))

    class Tokenize:
        def __init__(self):
            self.engine = engine_of(held, options)

        def eval(self, raw: str):
            for i, m in enumerate(self.engine.analyze(raw or "")):
                yield i, m.surface, m.start, m.end, m.pos, m.lemma

    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType="token_index int, surface string, start int, end int, pos string, lemma string"))


@dataclass(frozen=True)
class Engine:
    """Dictionaries in layers and options, as one value: each `with_` gives a new engine and leaves the old one as it was.

    User dictionaries add up, in the order given; a dictionary table replaces the one before. What a dictionary had to be
    refused for is in `warnings` if it is added leniently.
    """

    options: lattice.Options = lattice.Options()
    tag_options: tokens.TagOptions = tokens.TagOptions()
    table: tuple[lattice.Entry, ...] = ()
    users: tuple[lattice.Entry, ...] = ()
    warnings: tuple[str, ...] = ()

    version = __version__

    def with_dictionary_table(self, df: DataFrame) -> Engine:
        return replace(self, table=tuple(dictionary_entries(df)))

    def with_user_dictionary(self, df: DataFrame, lenient: bool = False) -> Engine:
        try:
            more = tuple(replace(e, user=True) for e in dictionary_entries(df))
        except ValueError as problem:
            if not lenient:
                raise
            return replace(self, warnings=(*self.warnings, str(problem)))
        return replace(self, users=self.users + more)

    def with_dictionaries(self, spark: SparkSession, paths: list[str]) -> Engine:
        """The first of `paths` that holds a dictionary table; those that don't are warnings. No folder is looked at unasked."""
        warnings = []
        for path in paths:
            try:
                return replace(self.with_dictionary_table(spark.read.parquet(path)), warnings=(*self.warnings, *warnings))
            except Exception as problem:  # noqa: BLE001  whatever a store answers, the next path is tried
                warnings.append(f"{path}: {str(problem).splitlines()[0]}")
        return replace(self, warnings=(*self.warnings, *warnings))

    def with_mode(self, mode: str) -> Engine:
        return replace(self, options=replace(self.options, mode=mode))

    @property
    def entries(self) -> list[lattice.Entry]:
        return [*self.table, *self.users]

    def analyze(self, text: Column) -> Column:
        return analyzer(self.entries, self.options)(text)

    def tags(self, text: Column) -> Column:
        return tagger(self.entries, self.options, self.tag_options)(text)

    def register(self, spark: SparkSession) -> None:
        register(spark, self.entries, self.options, self.tag_options)


def from_options(given: dict) -> Engine:
    """An engine from a record of named options, as programs in other languages hand them over.

    Names: mode, preserveVu, preserveCase, preserveSymbols, lemmatize, mergeCompounds, minLength, useLemma, maxTags,
    excludeBasic, pos (a list of noun, verb, adjective, adverb; other names ask for nothing). An unknown option is an error.
    """
    known = {"mode", "preserveVu", "preserveCase", "preserveSymbols", "lemmatize", "mergeCompounds", "minLength", "useLemma", "maxTags", "excludeBasic", "pos"}
    if set(given) - known:
        raise ValueError(f"unknown options: {sorted(set(given) - known)}")
    bits = sum({tokens.POS_BITS.get(p, 0) for p in given.get("pos", ())})
    options = lattice.Options(given.get("mode", "normal"), given.get("preserveVu", True), given.get("preserveCase", True), not given.get("preserveSymbols", False), lemmatize=given.get("lemmatize", True), merge_compounds=given.get("mergeCompounds", False))
    return Engine(options, tokens.TagOptions(use_lemma=given.get("useLemma", True), min_tag_length=given.get("minLength", 2), max_tags=given.get("maxTags", 0), exclude_basic=given.get("excludeBasic", False), pos_filter=bits))


def _parted(docs: DataFrame, entries: list[lattice.Entry], options: lattice.Options, text: str, key: str, slow: Callable[[Column], Column], fast: Callable[[Column], Column], name: str) -> DataFrame:
    """(key, name): `fast` of the texts that the closed form covers and `slow`, an Arrow UDF, of the others.

    Every row passes the UDF, those of the closed form as null, so nothing is shuffled and streams can have it too. The
    closed form holds with any dictionary whose words all have kana or kanji; else, and in a mode other than normal, every
    row is slow. A null text gives null.
    """
    if options != lattice.Options() or not all(lattice.ODD.search(e.surface) for e in entries):
        return docs.select(key, slow(F.col(text)).alias(name))
    rows = docs.select(key, F.col(text).alias("_text"), F.coalesce(tokens.closed_form(F.col(text)), F.lit(False)).alias("_closed"))
    both = rows.withColumn("_slow", slow(F.when(~F.col("_closed"), F.col("_text"))))
    return both.select(key, F.when(F.col("_closed"), fast(F.col("_text"))).otherwise(F.col("_slow")).alias(name))


def arrays(docs: DataFrame, entries: list[lattice.Entry] = (), options: lattice.Options = lattice.Options(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, morphemes), an array of surface and pos for each row: the JVM's closed form where it holds, else the lattice."""
    noun = lambda s: F.struct(s.alias("surface"), F.lit("NOUN").alias("pos"))
    return _parted(docs, entries, options, text, key, _pairs(entries, options), lambda t: F.transform(tokens.latin_surfaces(t), noun), "morphemes")


def surfaces(docs: DataFrame, entries: list[lattice.Entry] = (), options: lattice.Options = lattice.Options(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, surfaces): as `arrays`, of surfaces alone."""
    slow = lambda t: F.transform(_pairs(entries, options)(t), lambda m: m["surface"])
    return _parted(docs, entries, options, text, key, slow, tokens.latin_surfaces, "surfaces")


def morphemes(docs: DataFrame, entries: list[lattice.Entry] = (), options: lattice.Options = lattice.Options(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, token_index, surface, pos) of every row of docs, from `arrays`."""
    found = arrays(docs, entries, options, text, key)
    # outer, as Spark infers a filter from the other form, which would make the arrays twice
    rows = found.select(key, F.posexplode_outer("morphemes").alias("token_index", "m")).where(F.col("token_index").isNotNull())
    return rows.select(key, "token_index", "m.surface", "m.pos")


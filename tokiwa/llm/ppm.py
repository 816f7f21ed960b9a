"""LM scoring by prediction by partial matching over bytes, beside a unigram model of words.

The model is the trie of all byte contexts up to `order` in all training texts, as a distributed table of byte n-grams
with their counts; it grows with the corpus and no task holds it whole. Texts are dealt to blocks of bounded size. A block
sends its distinct n-grams and words, packed, to the buckets that they hash to; a bucket adds them up over the blocks. The
distinct n-grams are then dealt by the ends of their contexts, as many bytes of them as make small groups, get their
probabilities there, and go back to the buckets, which answer each block with the values of what it asked for. So what is
shuffled is the blocks' distinct n-grams, a few bytes each, and not the positions of the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.llm.common import cut, discard, release, remainder

#: Bytes that UTF-8 never has: what stands before a text, and its end, which is predicted like any other symbol.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256
#: Bytes of texts whose n-grams are in memory at once; a longer text is taken in pieces.
AT_ONCE = 1 << 20
#: Counts of so many runs of texts are merged into one.
MERGED = 8
#: Bytes of text for each bucket of n-grams.
BUCKET_BYTES = 8 << 20
#: n-grams behind one end of a context that are surely dealt together, and that may be; between them a thousandth of all.
FEW_GRAMS, MANY_GRAMS = 1 << 12, 1 << 20

CELLS = "block long, bucket int, grams binary, counts binary, words binary, word_counts binary"


def packed(values: np.ndarray) -> bytes:
    """8-byte numbers, their first bytes first, compressed."""
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    """What packed made, of `size` numbers."""
    raw = pa.decompress(data, 8 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as packed differences, after their number."""
    return len(keys).to_bytes(8, "little") + packed(np.diff(keys, prepend=np.int64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data[8:], int.from_bytes(data[:8], "little"), np.int64))


def packed_words(words: list[bytes]) -> bytes:
    """Words, which have no line feed, one a line, after the length of them all; the end of a text is the empty word."""
    lines = b"\n".join(words)
    return len(lines).to_bytes(8, "little") + pa.compress(lines, codec="zstd", asbytes=True) if words else b""


def unpacked_words(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b"\n") if data else []


def prepared(text: bytes | None) -> bytes:
    """A-Z lowered; null is empty."""
    return (text or b"").lower()


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of `order` context bytes and a symbol at each position of texts, END included; where each text starts."""
    pad, end = bytes([BEFORE]) * order, bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    keys = windows(data, order)
    real = np.ones(len(keys), dtype=bool)  # windows that begin in one text and end in the padding of the next are none
    for k in range(order):
        real[(starts + np.arange(len(texts)) * order - order + k)[1:]] = False
    return keys[real], starts


def windows(data: np.ndarray, order: int) -> np.ndarray:
    """The n-grams at all places of data that have `order` bytes before them."""
    keys = np.zeros(max(0, len(data) - order), dtype=np.int64)
    for i in range(order + 1):
        keys = (keys << 8) | data[i : i + len(keys)]
    return keys


def pieces(text: bytes, order: int) -> Iterator[np.ndarray]:
    """The n-grams of one long text, about AT_ONCE at a time."""
    data = np.frombuffer(bytes([BEFORE]) * order + text + bytes([END]), dtype=np.uint8)
    for at in range(order, len(data), AT_ONCE):
        yield windows(data[at - order : at + AT_ONCE], order)


def portions(texts: pa.Array) -> Iterator[slice]:
    """Runs of texts (binary) of about AT_ONCE bytes; a longer text is alone."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > AT_ONCE:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several counts, and their sums."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each key, by a multiplicative hash."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(buckets)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with the places of its rows in their order."""
    order = np.argsort(buckets, kind="stable")
    found, first = np.unique(buckets[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]), strict=True)


def gathered(order: int, buckets: int) -> Callable:
    """For a block: its distinct n-grams and words by bucket, each with its count in the block's training texts."""

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter[bytes] = Counter()
        for batch in batches:
            texts, held = batch.column("text"), batch.column("held_out").to_pylist()
            for part in portions(texts):
                for kept in (False, True):
                    some = [prepared(t) for t, h in zip(texts[part].to_pylist(), held[part], strict=True) if h is kept]
                    if not some:
                        continue
                    long = len(some) == 1 and len(some[0]) > AT_ONCE
                    for found in pieces(some[0], order) if long else [grams(some, order)[0]]:
                        keys, n = np.unique(found, return_counts=True)
                        parts.append((keys, n * (not kept)))
                        if len(parts) >= MERGED:
                            parts = [merged(parts)]
                    if kept:  # there with the count they have, which may be 0
                        words.update(dict.fromkeys((w for t in some for w in t.split()), 0))
                        words[b""] += 0
                    else:
                        for t in some:
                            words.update(t.split())
                        words[b""] += len(some)
        keys, n = merged(parts)
        of_grams = dict(by_bucket(spread(keys, buckets)))
        of_words: dict[int, list[bytes]] = {}
        for w in words:
            of_words.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for bucket in sorted(of_grams.keys() | of_words.keys()):
            mine, some = of_grams.get(bucket, np.zeros(0, np.int64)), of_words.get(bucket, [])
            cell = (packed_keys(keys[mine]), packed(n[mine]), packed_words(some), packed(np.array([words[w] for w in some], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in cell]], ["block", "bucket", "grams", "counts", "words", "word_counts"])

    return gather


def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a bucket: its distinct n-grams and words over all blocks with their counts; sum and number of the words'."""
    parts, total = [], None
    for batch in batches:
        for row in batch.to_pylist():
            found = unpacked_keys(row["grams"])
            parts.append((found, unpacked(row["counts"], len(found), np.int64)))
            if len(parts) >= 4 * MERGED:
                parts = [merged(parts)]
            some = unpacked_words(row["words"])
            if some:
                table = pa.table({"word": pa.array(some, pa.binary()), "n": unpacked(row["word_counts"], len(some), np.int64)})
                total = table if total is None else pa.concat_tables([total, table])
                if total.num_rows > 2_000_000:
                    total = summed_words(total)
    keys, n = merged(parts)
    total = summed_words(total) if total is not None else pa.table({"word": pa.array([], pa.binary()), "n": np.zeros(0, np.int64)})
    counts = total.column("n").to_numpy()
    cell = {"grams": packed_keys(keys), "counts": packed(n), "words": packed_words(total.column("word").to_pylist()), "word_counts": packed(counts)}
    yield pa.RecordBatch.from_pylist([{"bucket": key[0].as_py(), "n_grams": len(keys), "n_words": int(counts.sum()), "distinct": int((counts > 0).sum())} | cell], SUMS)


SUMS = pa.schema({"bucket": pa.int32(), "n_grams": pa.int64(), "n_words": pa.int64(), "distinct": pa.int64(), "grams": pa.binary(), "counts": pa.binary(), "words": pa.binary(), "word_counts": pa.binary()})


def summed_words(rows: pa.Table) -> pa.Table:
    return rows.group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


class Level:
    """The contexts of one length: sorted (context, symbol) keys with counts, and per context the total and the symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.contexts, first = np.unique(keys >> 8, return_index=True)
        self.totals = np.add.reduceat(self.counts, first) if len(keys) else np.zeros(0)
        self.distinct = np.diff(np.append(first, len(keys))).astype(np.float64)

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where keys are in the sorted table; -1 where they aren't."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, order: int, given: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 p of the last byte of each key after the bytes before it.

    keys, counts: n-grams of order + 1 bytes (count 0: not in training), all that there are behind each of their contexts
    but those in `given`, which has, by length of context, keys and counts of the whole corpus; of lengths 0 and 1 it has
    all contexts. From the longest context on: a symbol seen c times after a context of total t with d distinct symbols has
    probability (2c - 1) / 2t, and the escape to the next shorter context d / 2t; symbols of the longer context are
    excluded from t and d of the shorter ones. A context never seen is skipped, and after the empty one the symbols left
    are alike.
    """
    seen = counts > 0
    levels: list[Level] = []
    for j in range(order + 1):
        short, n = given.get(j, (np.zeros(0, np.int64),) * 2)
        if j >= 2:
            own, at = np.unique(keys[seen] & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
            total = np.bincount(at, counts[seen], len(own)) if len(own) else np.zeros(0)
            if len(short):
                mine, apart = np.isin(short >> 8, (keys >> 8) & ((1 << 8 * j) - 1)), np.isin(own >> 8, short >> 8)
                own, total = np.concatenate([own[~apart], short[mine]]), np.concatenate([total[~apart], n[mine]])
                at = np.argsort(own)
                own, total = own[at], total[at]
            short, n = own, total
        levels.append(Level(short, n))
    result = np.zeros(len(keys))
    open_ = np.ones(len(keys), dtype=bool)
    above = np.full(len(keys), -1)  # the row's context in the level above, if that was seen
    for j in range(order, -1, -1):
        level = levels[j]
        key = keys & ((1 << 8 * (j + 1)) - 1)
        context, symbol = Level.find(level.contexts, key >> 8), Level.find(level.keys, key)
        seen = context >= 0
        total, distinct = np.zeros(len(keys)), np.zeros(len(keys))
        total[seen], distinct[seen] = level.totals[context[seen]], level.distinct[context[seen]]
        if j < order and len(levels[j + 1].keys):
            upper = levels[j + 1]
            below = Level.find(level.keys, upper.keys & ((1 << 8 * (j + 1)) - 1))
            excluded = np.bincount(Level.find(upper.contexts, upper.keys >> 8), np.where(below >= 0, level.counts[below], 0.0), len(upper.contexts))
            known = above >= 0
            total[known] -= excluded[above[known]]
            distinct[known] -= upper.distinct[above[known]]
        hit = open_ & seen & (symbol >= 0)
        result[hit] += np.log10((2 * level.counts[symbol[hit]] - 1) / (2 * total[hit]))
        miss = open_ & seen & (symbol < 0) & (distinct > 0)
        result[miss] += np.log10(distinct[miss] / (2 * total[miss]))
        open_ &= symbol < 0
        above = context
    result[open_] -= np.log10(SYMBOLS - len(levels[0].keys))
    return result


def counted(length: int, parents: np.ndarray | None) -> Callable:
    """For rows of sums: by the last `length` context bytes of n-grams, if those after the first are in parents, how many
    n-grams there are (symbol -1), and how often each symbol follows in training."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpacked_keys(row["grams"])
                n = unpacked(row["counts"], len(keys), np.int64)
                if parents is not None:
                    kept = np.isin((keys >> 8) & ((1 << 8 * (length - 1)) - 1), parents)
                    keys, n = keys[kept], n[kept]
                short, symbols = merged([(keys & ((1 << 8 * (length + 1)) - 1), n)])
                ends, sizes = np.unique((keys >> 8) & ((1 << 8 * length) - 1), return_counts=True)
                once, real = np.zeros(len(ends), np.int64) - 1, symbols > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((ends, short[real] >> 8), (once, short[real] & 0xFF), (sizes, symbols[real]))], ["context", "symbol", "n"])

    return count


def contexts(sums: DataFrame, order: int, limit: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray]]:
    """Counts of the symbols after the empty context, all of one byte, and those longer ones that over `limit` n-grams end
    in; and the latter. Of these there are at most (all n-grams / limit) of a length, each with 256 symbols."""

    def rows(length: int, parents: np.ndarray | None) -> DataFrame:
        found = sums.select("grams", "counts").mapInArrow(counted(length, parents), "context long, symbol long, n long")
        return found.groupBy("context", "symbol").agg(F.sum("n").alias("n"))

    def table(got: list) -> tuple[np.ndarray, np.ndarray]:
        both = sorted((r["context"] << 8 | r["symbol"], r["n"]) for r in got if r["symbol"] >= 0)
        return np.array([k for k, _ in both], np.int64), np.array([n for _, n in both], np.int64)

    one = table(rows(1, None).collect())  # at most 65,792 rows
    given = {0: merged([(one[0] & 0xFF, one[1])]), 1: one}
    hot: dict[int, np.ndarray] = {}
    for length in range(2, order):
        found = cut(rows(length, hot.get(length - 1)), "ppm-contexts")
        crowded = found.where((F.col("symbol") == -1) & (F.col("n") > limit)).select("context")
        got = found.join(crowded, "context", "left_semi").collect()
        discard(found)
        if not got:
            break
        given[length], hot[length] = table(got), np.array(sorted({r["context"] for r in got}), np.int64)
    return given, hot


def dealt(buckets: int, hot: dict[int, np.ndarray]) -> Callable:
    """For rows of sums: their n-grams by the shortest end of the context, of two bytes or more, that isn't crowded."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpacked_keys(row["grams"])
                n = unpacked(row["counts"], len(keys), np.int64)
                end = (keys >> 8) & 0xFFFF
                for length in sorted(hot):
                    crowded = np.isin((keys >> 8) & ((1 << 8 * length) - 1), hot[length])
                    end[crowded] = (length + 1) << 56 | (keys[crowded] >> 8) & ((1 << 8 * (length + 1)) - 1)
                for bucket, mine in by_bucket(spread(end, buckets)):
                    yield pa.RecordBatch.from_pydict({"deal": pa.array([bucket], pa.int32()), "grams": pa.array([packed_keys(keys[mine])], pa.binary()), "counts": pa.array([packed(n[mine])], pa.binary())})

    return deal


def valued(order: int, buckets: int, given: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable:
    """For the n-grams dealt together: their log probabilities, by bucket."""

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for row in batch.to_pylist():
                keys.append(unpacked_keys(row["grams"]))
                counts.append(unpacked(row["counts"], len(keys[-1]), np.int64))
        both, n = np.concatenate(keys), np.concatenate(counts)
        at = np.argsort(both)
        both, n = both[at], n[at]
        found = log_probabilities(both, n, order, given)
        for bucket, mine in by_bucket(spread(both, buckets)):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "grams": pa.array([packed_keys(both[mine])], pa.binary()), "vals": pa.array([packed(found[mine])], pa.binary())})

    return value


def answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For a bucket: to each block the values of the n-grams and the counts of the words that it asked for."""
    keys = [unpacked_keys(g) for g in known.column("grams").to_pylist() if g is not None]
    values = [unpacked(v, len(k), np.float64) for v, k in zip((v for v in known.column("vals").to_pylist() if v is not None), keys, strict=True)]
    both, found = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (values, np.float64)))
    at = np.argsort(both)
    both, found = both[at], found[at]
    counts: dict[bytes, int] = {}
    for words, n in zip(known.column("words").to_pylist(), known.column("word_counts").to_pylist(), strict=True):
        if words:
            some = unpacked_words(words)
            counts.update(zip(some, unpacked(n, len(some), np.int64).tolist(), strict=True))
    vals, word_counts = [], []
    for g, words in zip(asked.column("grams").to_pylist(), asked.column("words").to_pylist(), strict=True):
        vals.append(packed(found[np.searchsorted(both, unpacked_keys(g))]))
        word_counts.append(packed(np.array([counts[w] for w in unpacked_words(words)], np.int64)))
    return asked.select(["block", "grams", "words"]).append_column("vals", pa.array(vals, pa.binary())).append_column("word_counts", pa.array(word_counts, pa.binary()))


def summed(order: int, denominator: float) -> Callable:
    """For a block, whose values come before its texts: the sums over each text of what its n-grams and words have."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, known, logs = [], [], set(), {}
        for batch in batches:
            answers = batch.filter(pc.is_valid(batch.column("grams")))
            for row in answers.select(["grams", "vals", "words", "word_counts"]).to_pylist():
                keys.append(unpacked_keys(row["grams"]))
                values.append(unpacked(row["vals"], len(keys[-1]), np.float64))
                some = unpacked_words(row["words"])
                n = unpacked(row["word_counts"], len(some), np.int64)
                logs.update(zip(some, np.log10((n + 0.5) / denominator).tolist(), strict=True))
                known.update(w for w, m in zip(some, n.tolist(), strict=True) if m)
            rows = batch.filter(pc.is_null(batch.column("grams")))
            if not rows.num_rows:
                continue
            if len(keys) > 1:
                both = np.concatenate(keys)
                at = np.argsort(both)
                keys, values = [both[at]], [np.concatenate(values)[at]]
                del both, at
            score, base, n_tokens, n_known = [], [], [], []
            texts = rows.column("text")
            for part in portions(texts):
                some = [prepared(t) for t in texts[part].to_pylist()]
                if len(some) == 1 and len(some[0]) > AT_ONCE:
                    score.append([sum(float(values[0][np.searchsorted(keys[0], g)].sum()) for g in pieces(some[0], order))])
                else:
                    gram, starts = grams(some, order)
                    once, place = np.unique(gram, return_inverse=True)  # what is looked up in order stays in the caches
                    score.append(np.add.reduceat(values[0][np.searchsorted(keys[0], once)][place], starts))
                for t in some:
                    words = t.split()
                    words.append(b"")
                    n_tokens.append(len(words))
                    base.append(sum(map(logs.__getitem__, words)))
                    n_known.append(sum(map(known.__contains__, words)))
            found = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(score), pa.float64())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), *found], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return total


def score(docs: DataFrame, held_out: Column | None = None, order: int = 5, block_bytes: int = 24 << 20, few_grams: int = FEW_GRAMS) -> DataFrame:
    """Score every row of docs (doc_id, text; others are ignored) with a model learnt from the rows not held out.

    held_out: a boolean; by default, crc32 of doc_id as text leaves 1 modulo 5 (a null doc_id isn't held out). Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score: log10 probabilities of the text with A-Z
    lowered, by the unigram model of words and by the byte model, each with the end of the text. A null text is empty: its
    end alone is scored. Repeated rows are learnt from as often as they come and each scored; with no training rows bytes
    are uniform; an empty table gives an empty result. order is 2 to 6. A block's rows are streamed, and a long text is
    taken in pieces, its n-grams all counted, so that a worker holds a block's distinct n-grams and one batch of texts, however many rows repeat.
    """
    if not 2 <= order <= 6:
        raise ValueError(f"order is 2 to 6, not {order}")
    spark = docs.sparkSession
    flag = F.coalesce(held_out if held_out is not None else remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), flag.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // min(BUCKET_BYTES, block_bytes)))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    cells = cut(docs.groupBy("block").applyInArrow(gathered(order, buckets), CELLS), "ppm-cells")
    release(spark)  # the shuffled texts, which the last step shuffles again

    sums = cut(cells.groupBy("bucket").applyInArrow(added, "bucket int, n_grams long, n_words long, distinct long, grams binary, counts binary, words binary, word_counts binary"), "ppm-sums")
    n_grams, n_train, distinct = (x or 0 for x in sums.agg(F.sum("n_grams"), F.sum("n_words"), F.sum("distinct")).first())
    given, hot = contexts(sums, order, max(few_grams, min(MANY_GRAMS, n_grams // 1000)))
    apart = sums.select("grams", "counts").mapInArrow(dealt(buckets, hot), "deal int, grams binary, counts binary")
    values = cut(apart.groupBy("deal").applyInArrow(valued(order, buckets, given), "bucket int, grams binary, vals binary"), "ppm-values")
    release(spark)

    known = values.withColumns({"words": F.lit(None).cast("binary"), "word_counts": F.lit(None).cast("binary")})
    known = known.unionByName(sums.select("bucket", F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("vals"), "words", "word_counts"))
    answers = cells.select("bucket", "block", "grams", "words").groupBy("bucket").cogroup(known.groupBy("bucket"))
    answers = answers.applyInArrow(answered, "block long, grams binary, words binary, vals binary, word_counts binary")
    both = answers.unionByName(docs, allowMissingColumns=True)
    both = both.repartition("block").sortWithinPartitions("block", F.col("grams").isNull())
    result = both.groupBy("block").applyInArrow(summed(order, n_train + 0.5 * (distinct + 1)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")

"""Best-fit packing of tokenised documents by large-item matching.

Documents are tokenised once, in Python (the tokenizer has no other form); only lengths and checksums leave that pass.
The bins are then planned from the histogram of lengths, which has at most `capacity` entries however large the corpus
is, and every piece finds its place from its length and its rank among the pieces of that length. No piece is ever
compared with another, and no group of pieces is gathered.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from string import punctuation
from struct import pack as packed

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokiwa.llm.common import cut, slices, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])
#: Words whose ids a worker remembers; having met that many it keeps them until it has met as many others.
REMEMBERED = 200_000
#: Words that the tokenizer is asked at a time, and how its ids mark a word's end.
JOINED, WORD_END = 500, "</w>"
#: Bytes of texts that are taken apart at once.
AT_ONCE = 6 << 20


class WordIds:
    """Ids of texts from the ids of their words between blanks and line ends.

    The vocabulary spans no white space, so a text may be taken apart at some of it; each distinct word of a batch is then
    looked at once. A word of Latin-1 letters and digits, in whatever case and before whatever ASCII punctuation, has the
    ids of its lower case and then those of the punctuation, as the vocabulary is lower case and parts letters, digits and
    punctuation; so only such lower-cased words go to the tokenizer, many at a time, and those already met don't.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.word_ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.word_ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's end in it."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        codes = self.codes(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        begins = np.cumsum(sizes) - sizes
        places = coded.indices.to_numpy()
        times = sizes[places]
        ends = np.cumsum(times)
        at = np.repeat(begins[places] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
        ids = np.frombuffer(b"".join(codes), dtype="<u4")[at]
        words = np.cumsum(pc.list_value_length(lists).to_numpy())
        return ids, np.concatenate([[0], ends])[words]

    def codes(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit bytes."""
        if len(self.known) >= REMEMBERED:
            self.old, self.known = self.known, {"": b""}
        parts, new, known, old = [], {}, self.known, self.old
        for word in words:
            core = word.rstrip(punctuation)
            if core.isalnum() and max(core) < "\u0100":
                stops, core = word[len(core) :], core.lower()
            else:
                stops, core = "", word
            parts.append((core, stops))
            for part in (core, stops):
                if part not in known:
                    if (found := old.get(part)) is not None:
                        known[part] = found
                    else:
                        new[part] = None
        self.learn(new)
        return [known[core] + known[stops] if stops else known[core] for core, stops in parts]

    def learn(self, new: dict[str, None]) -> None:
        """Ask the tokenizer. Words wholly of Latin-1 letters are asked many at a time: each ends where a word-end id is."""
        letters = [w for w in new if w.isalpha() and max(w) < "\u0100"]
        for at in range(0, len(letters), JOINED):
            some = letters[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.word_ends[ids]) + 1)).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                self.known.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends], ends, strict=False))
        for word in new:
            if word not in self.known:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
                self.known[word] = packed(f"<{len(ids)}I", *ids)


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32, and nth, their number within the task."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        word_ids, end, size, nth = WordIds(tokenizer_path), end_id.to_bytes(4, "little"), 4 * capacity, 0
        for batch in batches:
            for part in slices(batch, 1, AT_ONCE):
                ids, ends = word_ids(part.column(1))
                rows, data = [], ids.tobytes()
                for doc_id, begin, stop in zip(part.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    own = data[4 * begin : 4 * stop] + end
                    for at in range(0, len(own), size):
                        piece = own[at : at + size]
                        rows.append((doc_id, at // size, at // 4, len(piece) // 4, zlib.crc32(piece), nth))
                        nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PIECES_ARROW, strict=True)], schema=PIECES_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_up, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for the pieces: (length, lo, hi, copies, sequence, offset).

    The pieces of that length with rank lo <= rank < hi go to sequences from `sequence` on, `copies` to each, from
    `offset` on. First each large length (over a third of the capacity), longest first, is matched with the longest large
    length that still fits, so that at most two large pieces share a bin; then the smaller lengths, longest first, fill
    the smallest gap that takes them. Bins alike are handled together. A group of bins that a length fills goes from a
    gap g to g mod length < g / 2, so it moves at most log2(capacity) times, and a length splits at most two groups: with
    capacity 4096 the plan has under 120,000 rows, whatever the number of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    sequences = 0

    def put(length: int, bins: int, copies: int, sequence: int, offset: int) -> None:
        n = bins * copies
        rows.append((length, rank[length], rank[length] + n, copies, sequence, offset))
        rank[length] += n
        left[length] -= n

    def keep(gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            if gap not in groups:
                insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((sequence, bins))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        at = bisect_right(large, capacity - longest) - 1
        if at >= 0 and large[at] == longest and left[longest] < 2:
            at -= 1
        if at < 0:
            bins = left[longest]
            put(longest, bins, 1, sequences, 0)
            keep(capacity - longest, sequences, bins)
        elif (partner := large[at]) == longest:
            bins = left[longest] // 2
            put(longest, bins, 2, sequences, 0)
            keep(capacity - 2 * longest, sequences, bins)
        else:
            bins = min(left[longest], left[partner])
            put(longest, bins, 1, sequences, 0)
            put(partner, bins, 1, sequences, longest)
            keep(capacity - longest - partner, sequences, bins)
            if not left[partner]:
                del large[at]
        sequences += bins
        if not left[longest]:
            large.pop()

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # nothing takes it: open as many bins as it fills, or one
                bins = max(1, left[length] // (capacity // length))
                keep(capacity, sequences, bins)
                sequences += bins
                continue
            gap = gaps[at]
            sequence, bins = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            copies = gap // length
            full = min(bins, left[length] // copies)
            if not full:
                full, copies = 1, left[length]
            put(length, full, copies, sequence, capacity - gap)
            keep(gap - copies * length, sequence, full)
            keep(gap, sequence + full, bins - full)
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, rows_per_salt: int = 500_000) -> DataFrame:
    """Pack every document of docs (doc_id, text; others are ignored) into sequences of at most `capacity` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece. A null or empty text is its
    end id alone; only texts longer than `capacity` are cut; a null doc_id stays null; repeated rows are packed as often
    as they come, and which of several like pieces goes where is decided by rank in a hash bucket, then doc_id and piece.
    An empty table gives an empty result. Pieces of one length, however many, are ranked in buckets of about
    `rows_per_salt` rows; rows that share a doc_id, or have none, or are copies of one another, are in different buckets,
    as their places within the tokenising tasks are hashed too (the pieces are written once, so these hold).
    """
    spark = docs.sparkSession
    pieces = cut(tokenised(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = max(16, -(-sum(counts.values()) // rows_per_salt))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "nth"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "nth")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))
    plan = spark.createDataFrame(plan_bins(counts, capacity), "length long, lo long, hi long, copies long, sequence long, at long")
    placed = ranked.alias("p").join(F.broadcast(plan).alias("b"), (F.col("p.length") == F.col("b.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("copies") * F.col("p.length")).alias("offset"),
    )

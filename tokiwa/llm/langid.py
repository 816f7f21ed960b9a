"""Language identification of words, and so of texts, by a linear-chain conditional random field."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.llm.common import remainder, slices, tidy

UNDETERMINED = "und"
#: Bytes of texts whose words are in memory at once.
AT_ONCE = 4 << 20
#: Bytes that UTF-8 never has mark the ends of words.
FIRST, LAST = b"\xfe", b"\xff"


@dataclass(frozen=True)
class Settings:
    """rows_per_language and most_bytes bound the sample of labelled rows that the model is fitted on, texts over longest
    bytes aside. Every language is learnt; over most_languages of them is an error. All other figures are the fit's."""

    rows_per_language: int = 200
    most_languages: int = 256
    longest: int = 200_000
    most_bytes: int = 64 << 20
    buckets: int = 1 << 16
    window: int = 40
    batch: int = 256
    epochs: int = 3
    spliced: float = 0.4
    rate: float = 0.3
    decay: float = 1e-6
    lexicon_least: int = 5
    lexicon_share: float = 0.8
    seed: int = 7


def stripped(word: str) -> bytes:
    """The letters and marks of a lower-cased word as UTF-8, other characters gone; empty if it has no letter."""
    if word.isascii():
        if word.isalpha():
            return word.encode()
        return "".join(c for c in word if c.isalpha()).encode()
    kept = "".join(c for c in word if c.isalpha() or unicodedata.category(c)[0] == "M")
    return kept.encode() if any(c.isalpha() for c in kept) else b""


def features(words: list[bytes], lexicon: dict[bytes, int], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, one after the other, and where each word's begin.

    Byte 2-, 3- and 4-grams with the word's ends marked (those at an end are its affixes), and the whole word; then, as
    buckets of their own, the language in whose lexicon the word is.
    """
    data = np.frombuffer(b"".join(FIRST + w + LAST for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    spot = np.arange(len(data))
    mix = lambda code, n: ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(settings.buckets)
    found, of = [], []
    code = data.copy()
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            code = (code[:-1] << np.uint64(8)) | data[n - 1 :]
            inside = spot[: len(code)] + n <= ends[: len(code)]
            found.append(mix(code[inside], n).astype(np.int64))
            of.append(owner[: len(code)][inside])
    import xxhash

    found.append(np.fromiter((xxhash.xxh3_64_intdigest(w) % settings.buckets for w in words), dtype=np.int64, count=len(words)))
    of.append(np.arange(len(words)))
    listed = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    found.append(np.array([settings.buckets + k for _, k in listed], dtype=np.int64))
    of.append(np.array([i for i, _ in listed], dtype=np.int64))
    of, found = np.concatenate(of), np.concatenate(found)
    at = np.argsort(of, kind="stable")
    return found[at], np.searchsorted(of[at], np.arange(len(words)))


@dataclass
class Field:
    """labels; weights by bucket and label; transitions from label to label; the start's scores; lexicon: word to label."""

    labels: list[str]
    settings: Settings
    weights: np.ndarray = field(default=None)
    transitions: np.ndarray = field(default=None)
    start: np.ndarray = field(default=None)
    lexicon: dict[bytes, int] = field(default_factory=dict)

    def emissions(self, words: list[bytes], at_once: int = 20_000) -> np.ndarray:
        """Scores of each word for each label; words without letters have none for any."""
        out = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        real = np.flatnonzero(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) > 0)
        for at in range(0, len(real), at_once):
            some = real[at : at + at_once]
            found, starts = features([words[i] for i in some], self.lexicon, self.settings)
            out[some] = np.add.reduceat(self.weights[found], starts, axis=0)
        return out


def marginals(emissions: np.ndarray, at: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(label) at every place of every sequence, by forward-backward.

    Place k of sequence d has emissions[at[offsets[d] + k]]. All sequences go forward and backward together, longest
    first, in the probability domain with each place's vector brought to sum 1.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = offsets[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    top = emissions.max(axis=1, keepdims=True)
    chance = np.exp(np.maximum(emissions - top, -60.0)).astype(np.float64)
    step, begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    forward = np.empty((len(at), emissions.shape[1]))
    a = None
    for k in range(longest):
        n = active[k]
        where = first[:n] + k
        a = (begin if k == 0 else a[:n] @ step) * chance[at[where]]
        a /= a.sum(axis=1, keepdims=True)
        forward[where] = a
    b = np.ones((0, emissions.shape[1]))
    for k in range(longest - 1, -1, -1):
        n = active[k]
        where = first[:n] + k
        if n > len(b):
            b = np.concatenate([b, np.ones((n - len(b), emissions.shape[1]))])
        spare = forward[where] * b
        spare /= spare.sum(axis=1, keepdims=True)
        forward[where] = spare
        b = (b * chance[at[where]]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
    return forward


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lower-cased words of texts, each place's word among them, and where each text begins."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), offsets


def sample(docs: DataFrame, settings: Settings) -> dict[str, list[str]]:
    """At most rows_per_language texts of each language, those with the least hashes of doc_id and text.

    Every labelled row is counted; about twice the bound are drawn by hash and brought to the driver, at most, and fewer
    of each language if their bytes would be more than most_bytes.
    """
    size = F.octet_length("text")
    docs = docs.where("lang is not null and text rlike '\\\\p{L}'").withColumn("_h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    short = size <= settings.longest
    counts = docs.groupBy("lang").agg(F.count_if(short).alias("n"), F.sum(F.when(short, size)).alias("bytes")).limit(settings.most_languages + 1).collect()
    if len(counts) > settings.most_languages:
        raise ValueError(f"over {settings.most_languages} languages: raise Settings.most_languages, which the model's memory grows with")
    wanted = {r["lang"]: min(r["n"], 1.5 * settings.rows_per_language + 20) for r in counts if r["n"]}
    if not wanted:
        return {}
    share = min(1.0, settings.most_bytes / sum(n * r["bytes"] / r["n"] for r in counts if (n := wanted.get(r["lang"]))))
    bars = [(r["lang"], int(min(1.0, share * wanted[r["lang"]] / r["n"]) * (1 << 30))) for r in counts if r["lang"] in wanted]
    bars = F.broadcast(docs.sparkSession.createDataFrame(bars, "lang string, _bar long"))  # a row a language
    drawn = sorted((r["lang"], r["_h"], r["text"]) for r in docs.where(short).join(bars, "lang").where("_h < _bar").select("lang", "_h", "text").collect())
    found: dict[str, list[str]] = {}
    for lang, _, text in drawn:
        if len(texts := found.setdefault(lang, [])) < settings.rows_per_language:
            texts.append(text)
    return found


def fit(texts: dict[str, list[str]], settings: Settings) -> Field:
    """Fit weights, transitions and start by likelihood, on windows of words of one text and on spliced windows.

    A text's label is that of all its words; spliced windows join pieces of texts of different languages, so that the
    transitions learn how code-switched text changes language.
    """
    labels, rng = sorted(texts), np.random.default_rng(settings.seed)
    model, k = Field(labels, settings), len(labels)
    model.weights = np.zeros((settings.buckets + k, k), dtype=np.float32)
    model.transitions, model.start = np.zeros((k, k)), np.zeros(k)
    if not labels:
        return model
    runs, names = [], {}
    for label, lang in enumerate(labels):
        words, at, offsets = tokens(pa.array(texts[lang], pa.string()))
        bare = [stripped(w) for w in words]
        ids = np.array([names.setdefault(w, len(names)) for w in bare], dtype=np.int64)
        real = np.array([len(w) > 0 for w in bare], dtype=bool)
        for d in range(len(offsets) - 1):
            places = at[offsets[d] : offsets[d + 1]]
            places = ids[places[real[places]]]
            if len(places):
                runs.append((label, places))
    words = list(names)
    counts = np.zeros((len(words), k))
    for label, places in runs:
        np.add.at(counts[:, label], places, 1)
    sums = counts.sum(axis=1)
    known = (sums >= settings.lexicon_least) & (counts.max(axis=1) >= settings.lexicon_share * sums)
    model.lexicon = {words[i]: int(counts[i].argmax()) for i in np.flatnonzero(known) if words[i]}

    size, width = settings.window, settings.batch
    found, starts = features(words, model.lexicon, settings)
    spans = np.append(starts, len(found))
    windows: list[tuple[np.ndarray, np.ndarray]] = []
    for label, places in runs:
        for i in range(0, len(places), size):
            part = places[i : i + size]
            windows.append((part, np.full(len(part), label)))
    by_label = [[p for one, p in runs if one == label] for label in range(k)]
    for _ in range(int(len(windows) * settings.spliced) if k > 1 else 0):
        parts, tags, total, label = [], [], 0, int(rng.integers(k))
        while total < size:
            run = by_label[label][int(rng.integers(len(by_label[label])))]
            n = min(int(rng.integers(3, 25)), size - total, len(run))
            i = int(rng.integers(len(run) - n + 1))
            parts.append(run[i : i + n])
            tags.append(np.full(n, label))
            total += n
            label = (label + 1 + int(rng.integers(k - 1))) % k
        windows.append((np.concatenate(parts), np.concatenate(tags)))

    grad_w, grad_t, grad_s = (np.full(x.shape, 1e-6) for x in (model.weights, model.transitions, model.start))
    for _ in range(settings.epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), width):
            some = [windows[j] for j in order[i : i + width]]
            lengths = np.array([len(p) for p, _ in some])
            places, tags = np.concatenate([p for p, _ in some]), np.concatenate([t for _, t in some])
            distinct, at = np.unique(places, return_inverse=True)
            pieces = np.concatenate([np.arange(spans[w], spans[w + 1]) for w in distinct])
            heads = np.concatenate([[0], np.cumsum(spans[distinct + 1] - spans[distinct])[:-1]])
            rows = found[pieces]
            emissions = np.add.reduceat(model.weights[rows], heads, axis=0)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            p, pairs = expected(emissions, at, offsets, model.transitions, model.start)
            error = p.copy()
            error[np.arange(len(tags)), tags] -= 1
            per_word = np.stack([np.bincount(at, error[:, c], len(distinct)) for c in range(k)], axis=1)
            per_row = np.repeat(per_word, spans[distinct + 1] - spans[distinct], axis=0)
            unique, back = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(back, per_row[:, c], len(unique)) for c in range(k)], axis=1) / len(some) + settings.decay * model.weights[unique]
            grad_w[unique] += g * g
            model.weights[unique] -= (settings.rate * g / np.sqrt(grad_w[unique])).astype(np.float32)
            inner = np.ones(len(tags) - 1, dtype=bool)
            inner[offsets[1:-1] - 1] = False
            np.add.at(pairs, (tags[:-1][inner], tags[1:][inner]), -1)
            g = pairs / len(some)
            grad_t += g * g
            model.transitions -= settings.rate * g / np.sqrt(grad_t)
            g = error[offsets[:-1]].mean(axis=0)
            grad_s += g * g
            model.start -= settings.rate * g / np.sqrt(grad_s)
    return model


def expected(emissions: np.ndarray, at: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals at each place, and the sum over all sequences of the expected counts of each transition."""
    k, lengths = emissions.shape[1], np.diff(offsets)
    width = int(lengths.max())
    full = np.full((len(lengths), width), -1)
    for d, n in enumerate(lengths):
        full[d, :n] = at[offsets[d] : offsets[d + 1]]
    chance = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -60.0)).astype(np.float64)
    e = np.where(full[..., None] >= 0, chance[full], 1.0)
    live = full >= 0
    step, begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    a, b = np.empty((len(lengths), width, k)), np.ones((len(lengths), width, k))
    for t in range(width):
        v = (begin if t == 0 else a[:, t - 1] @ step) * e[:, t]
        a[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(width - 2, -1, -1):
        v = (b[:, t + 1] * e[:, t + 1]) @ step.T
        b[:, t] = np.where(live[:, t + 1, None], v / v.sum(axis=1, keepdims=True), 1.0)
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(width - 1):
        both = a[:, t, :, None] * step * (e[:, t + 1] * b[:, t + 1])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += both[live[:, t + 1]].sum(axis=0)
    return p[live], pairs


def labelled_words(model: Field, text: str) -> list[tuple[str, str, float]]:
    """Each word of text that has a letter, with its likeliest language and that one's probability."""
    words, at, offsets = tokens(pa.array([text], pa.string()))
    bare = [stripped(w) for w in words]
    if not model.labels or not any(bare):
        return []
    p = marginals(model.emissions(bare), at, offsets, model.transitions, model.start)
    return [(words[w], model.labels[int(q.argmax())], float(q.max())) for w, q in zip(at, p, strict=True) if bare[w]]


def identify(docs: DataFrame, learn: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """Predict the language of every row of docs (doc_id, text, lang; others pass through) from its text alone.

    Returns the columns of docs with held_out, lang_pred and score (clashing names are replaced). learn: which rows the
    model may learn from, by default those whose crc32 of doc_id as text is not 2 modulo 4 (a null doc_id may be learnt
    from); of these it is fitted on at most rows_per_language rows of each language, chosen by hash. lang_pred: the
    language of the most words, counted by their probabilities, first in alphabetical order if two have the same; score:
    its mean probability over the words with letters. A text that is null or has no letter gets `und` and 0, and so does
    every text if there is nothing to learn from. A text of any length is judged whole. Repeated rows are judged alike; an empty table gives an empty result.
    """
    may = F.coalesce(learn if learn is not None else remainder(F.col("doc_id"), 4) != 2, F.lit(True))
    docs = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", ~may)
    model = fit(sample(docs.where("not held_out"), settings), settings)
    place = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place, AT_ONCE)):
            texts = batch.column(place)
            words, at, offsets = tokens(texts)
            bare = [stripped(w) for w in words]
            real = np.fromiter((len(w) > 0 for w in bare), dtype=bool, count=len(bare))
            n = len(texts)
            weight = np.zeros((n, max(1, len(model.labels))))
            if model.labels and real.any():
                p = marginals(model.emissions(bare), at, offsets, model.transitions, model.start) * real[at][:, None]
                full = np.diff(offsets) > 0
                weight[full] = np.add.reduceat(p, offsets[:-1][full], axis=0)
            sums = weight.sum(axis=1)
            best = weight.argmax(axis=1)
            named = [model.labels[b] if s > 0 else UNDETERMINED for b, s in zip(best, sums, strict=True)]
            share = np.where(sums > 0, weight[np.arange(n), best] / np.where(sums > 0, sums, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(np.clip(share, 0.0, 1.0))], names=[*batch.schema.names, "lang_pred", "score"])
        tidy()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(judge, f"{schema}, lang_pred string, score double")

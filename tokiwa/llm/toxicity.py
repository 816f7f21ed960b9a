"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokiwa.llm.common import slices

#: Bytes of texts whose features are in memory at once.
AT_ONCE = 2 << 20


@dataclass(frozen=True)
class Settings:
    """most_rows and most_bytes bound the labelled rows that the model is fitted on (a hash of doc_id chooses), texts over
    longest bytes aside; the rest is the fit's."""

    most_rows: int = 6_000
    longest: int = 200_000
    most_bytes: int = 64 << 20
    buckets: int = 1 << 18
    stems: tuple[int, ...] = (4, 5, 6, 7)
    grades: int = 2
    epochs: int = 20
    batch: int = 50
    rate: float = 0.3
    threshold_rate: float = 0.1
    decay: float = 1e-4
    least_z: float = 3.0
    flagged: float = 0.5
    seed: int = 11


STRIPPED = ".,;:!?'\"()[]{}#*$%&|<>"


def word_features(words: list[str], settings: Settings) -> list[tuple[int, ...]]:
    """The buckets of each distinct lower-cased word: the bare word's, and those of its stems (its first few letters)."""
    import xxhash

    digest, n = xxhash.xxh3_64_intdigest, settings.buckets
    out = []
    for word in words:
        bare = word.strip(STRIPPED)
        out.append((digest(bare) % n, *[digest(bare[:k] + "~") % n for k in settings.stems if k < len(bare)]) if bare else ())
    return out


def entries(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text and each of its distinct buckets: the text's place, the bucket and its weight."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = coded.indices.to_numpy().astype(np.int64)
    buckets = word_features(coded.dictionary.to_pylist(), settings)
    per_word = np.fromiter(map(len, buckets), dtype=np.int64, count=len(buckets))
    flat = np.fromiter((b for bs in buckets for b in bs), dtype=np.int64)
    begin = np.cumsum(per_word) - per_word
    times = per_word[places]
    owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), times)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    key, count = np.unique(owner * settings.buckets + (flat[np.repeat(begin[places], times) + within] if len(flat) else within), return_counts=True)
    return key // settings.buckets, key % settings.buckets, 1 + np.log(count)


class Rows:
    """Sparse rows: for each text its distinct buckets, weighted 1 + log(count)."""

    def __init__(self, texts: pa.Array, settings: Settings):
        parts, before = [], 0
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, AT_ONCE):
            row, bucket, value = entries(part.column(0), settings)
            parts.append(((row + before).astype(np.int32), bucket.astype(np.int32), value.astype(np.float32)))
            before += part.num_rows
        self.n = before
        none = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))]
        self.row, self.bucket, self.value = (np.concatenate(x) for x in zip(*(parts or none), strict=True))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.bucket] * self.value, self.n)

    def of(self, kept: np.ndarray) -> Rows:
        part, keep = object.__new__(Rows), kept[self.bucket]
        part.n, part.row, part.bucket, part.value = self.n, self.row[keep], self.bucket[keep], self.value[keep]
        return part

    def some(self, chosen: np.ndarray) -> Rows:
        part = object.__new__(Rows)
        place = np.full(self.n, -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[self.row] >= 0
        part.n, part.row, part.bucket, part.value = len(chosen), place[self.row[keep]], self.bucket[keep], self.value[keep]
        return part


@dataclass
class Model:
    """Weights shared by all thresholds, and the ordered thresholds: P(grade > j) = sigmoid(weights x - thresholds[j])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - rows.times(self.weights)[:, None], -40, 40)))


def telling(rows: Rows, toxic: np.ndarray, settings: Settings) -> np.ndarray:
    """By bucket, the z of the smoothed log odds of being in toxic rather than clean rows."""
    one = np.bincount(rows.bucket[toxic[rows.row]], minlength=settings.buckets) + 0.5
    zero = np.bincount(rows.bucket[~toxic[rows.row]], minlength=settings.buckets) + 0.5
    odds = np.log(one / (toxic.sum() + 1 - one)) - np.log(zero / ((~toxic).sum() + 1 - zero))
    return odds / np.sqrt(1 / one + 1 / zero)


def likelihood(s: np.ndarray, y: np.ndarray, first: float, gaps: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """The mean negative log likelihood of grades y at scores s, its slopes by each score (times their number), by the first
    threshold and by the logarithms of the gaps between thresholds."""
    k, n = len(gaps) + 1, len(y)
    theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    p = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -40, 40)))  # P(grade > j)
    upper = np.concatenate([np.ones((n, 1)), p], axis=1)[np.arange(n), y]
    lower = np.concatenate([p, np.zeros((n, 1))], axis=1)[np.arange(n), y]
    chance = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
    by_theta = np.zeros(k)
    np.add.at(by_theta, y[y > 0] - 1, du[y > 0])
    np.add.at(by_theta, y[y < k], -dl[y < k])
    tail = np.cumsum((by_theta / n)[::-1])[::-1]
    return float(-np.log(chance).mean()), dl - du, float(tail[0]), tail[1:] * np.exp(gaps)


def fit(texts: list[str], grade: list[int], settings: Settings) -> Model:
    """Fit on texts and their grades; of toxic ones that have only been told from clean ones, `cross_graded` makes grades."""
    rows, grade = Rows(pa.array(texts, pa.string()), settings), np.array(grade, dtype=np.int64)
    if settings.grades > 1 and grade.max(initial=0) <= 1:
        grade = cross_graded(rows, grade > 0, settings)
    return fitted(rows, grade, settings)


def cross_graded(rows: Rows, toxic: np.ndarray, settings: Settings) -> np.ndarray:
    """Ordered grades from 0/1 labels: 0 for clean rows; toxic ones in equal parts by how toxic the other half finds them.

    Each half of the rows is scored by a model of the two labels that was fitted on the other half alone. So no row's grade
    comes from its own label's or features' part in a model.
    """
    score, half = np.zeros(rows.n), np.arange(rows.n) % 2 == 0
    for mine in (half, ~half):
        others = np.flatnonzero(~mine)
        model = fitted(rows.some(others), toxic[others].astype(np.int64), replace(settings, grades=1))
        score[mine] = rows.some(np.flatnonzero(mine)).times(model.weights)
    grade = np.zeros(rows.n, dtype=np.int64)
    ranked = np.flatnonzero(toxic)[np.argsort(score[toxic], kind="stable")]
    for j, part in enumerate(np.array_split(ranked, settings.grades)):
        grade[part] = j + 1
    return grade


def fitted(rows: Rows, grade: np.ndarray, settings: Settings) -> Model:
    """Fit by likelihood with Adagrad on shuffled batches; the gaps between thresholds stay positive by their logarithms."""
    k, flags = settings.grades, grade > 0
    rng = np.random.default_rng(settings.seed)
    w, first, gaps = np.zeros(settings.buckets), 2.0, np.zeros(k - 1)
    if not flags.any() or flags.all():
        return Model(w, (40.0 if not flags.any() else -40.0) + np.arange(k))
    kept = np.abs(telling(rows, flags, settings)) >= settings.least_z
    rows = rows.of(kept)  # the other weights stay 0
    sum_w, sum_t = np.full(settings.buckets, 1e-8), np.full(k, 1e-8)
    for _ in range(settings.epochs):
        order = rng.permutation(rows.n)
        for i in range(0, rows.n, settings.batch):
            chosen = order[i : i + settings.batch]
            part = rows.some(chosen)
            _, slope, by_first, by_gaps = likelihood(part.times(w), grade[chosen], first, gaps)
            at = np.unique(part.bucket)
            g = np.bincount(np.searchsorted(at, part.bucket), slope[part.row] * part.value, len(at)) / part.n + settings.decay * w[at]
            sum_w[at] += g * g
            w[at] -= settings.rate * g / np.sqrt(sum_w[at])
            g = np.concatenate([[by_first], by_gaps])
            sum_t += g * g
            first -= settings.threshold_rate * g[0] / np.sqrt(sum_t[0])
            gaps -= settings.threshold_rate * g[1:] / np.sqrt(sum_t[1:])
    return Model(w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def severities(labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, severity): the worst of each labelled doc_id's labels: column severity, up to `grades`, or else toxic, 0 or 1."""
    name = "severity" if "severity" in labels.columns else "toxic"
    most = settings.grades if name == "severity" else 1
    given = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return given.groupBy("doc_id").agg(F.greatest(F.least(F.max(F.col(name).cast("int")), F.lit(most)), F.lit(0)).alias("severity"))


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[str], list[int]]:
    """At most most_rows labelled texts with their grades, those with the least hashes of doc_id; labels meet texts by doc_id.

    How many and how long they are is counted first; fewer are taken if their bytes would be more than most_bytes.
    """
    labels = severities(labels, settings).withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    bar = min(1.0, settings.most_rows / max(1, labels.count()))
    size = F.octet_length("text")
    drawn = docs.select("doc_id", "text").where(F.coalesce(size, F.lit(0)) <= settings.longest).join(labels.where(F.col("_h") < int(bar * (1 << 30))), "doc_id")
    total = drawn.agg(F.sum(size)).first()[0] or 0
    bar *= min(1.0, settings.most_bytes / max(1, total))
    rows = drawn.where(F.col("_h") < int(bar * (1 << 30))).select("_h", "text", "severity").collect()
    rows = sorted((r["_h"], r["text"] or "", r["severity"]) for r in rows)[: settings.most_rows]
    return [t for _, t, _ in rows], [y for _, _, y in rows]


def grade(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Grade every row of docs (doc_id, text; others pass through) by a model fitted on labels (doc_id, toxic 0 or 1).

    Where labels have a column severity that is the grade learnt; else toxic texts are graded by `cross_graded`. Returns the columns of docs with p_toxic (the probability of a grade over 0), expected_severity (0 to `grades`), grade
    (the likeliest) and toxic (p_toxic at least `flagged`); clashing names are replaced. Labels with a null doc_id or label
    are ignored; of several for one doc_id the worst holds. A null, empty or wordless text is not toxic, with severity 0;
    so is every text if no row is labelled toxic. A text of any length is graded whole. Repeated rows are graded alike; an empty table gives an empty result.
    """
    docs = docs.drop("p_toxic", "expected_severity", "grade", "toxic")
    model = fit(*sample(docs, labels, settings), settings)
    place = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place, AT_ONCE)):
            rows = Rows(batch.column(place), settings)
            p = model.above(rows)
            p[np.bincount(rows.row, minlength=rows.n) == 0] = 0.0
            each = -np.diff(np.concatenate([np.ones((rows.n, 1)), p, np.zeros((rows.n, 1))], axis=1), axis=1)
            more = [pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= settings.flagged)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "p_toxic", "expected_severity", "grade", "toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(judge, f"{schema}, p_toxic double, expected_severity double, grade int, toxic boolean")

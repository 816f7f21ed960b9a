"""Classes against all pairs, on documents and on planted groups of near fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokiwa.llm import queries, simhash
from tokiwa.llm.common import connected_components, table


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    """fps: list of ints; the index of the least member reachable."""
    a, parent = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op6_simhash(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    ids = sorted(docs)
    fps = [brute_fingerprint(docs[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i]["component_id"] for i in ids] == [ids[c] for c in brute_classes(fps)]


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_links_connect_what_all_pairs_connect(spark, hot):
    """hot = 0 sends every half through the second round of balls, 1000 none."""
    rng = random.Random(hot)
    fps = {0}
    for _ in range(25):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(12):
            fps.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot)
    pairs = edges.distinct().collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3 for r in pairs)
    named = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    mine = [named.get(f, f) for f in signed]
    brute = brute_classes(fps)
    assert len(set(zip(mine, brute, strict=True))) == len(set(mine)) == len(set(brute))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in range(100, 160)} == {100} and found[301] == 300 and 200 not in found


def test_odd_rows(odd, none):
    rows = simhash.classes(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["fp"], r["component_id"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, 1)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {min(r["component_id"] for r in rows if r["doc_id"] == 4)}
    assert simhash.classes(none).collect() == []
    assert simhash.classes(odd.where("doc_id is null").withColumn("text", F.lit("same"))).first()["component_id"] is None

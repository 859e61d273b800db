"""Operator 11 against a trie built turn by turn in plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewake.llm import prefix_trie, queries, scans

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs string, d string, path string, _index string"


def brute(rows, block=20, most=4, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        k = zlib.crc32(str(c).encode()) % most if rebuild else 0
        made[c] = own.get(c - int(math.fmod(c, block)), [])[:k] + ts[k:] if rebuild else ts
    nodes = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes.setdefault(tuple(made[c][:d]), []).append(c)
    children, out = {}, []
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)
    words = {s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0 for s in nodes}
    total = {}
    for s in sorted(nodes, key=len, reverse=True):
        below = [total[x] for x in children.get(s, [])]
        total[s] = (sum(b[0] for b in below) or 1, (len(nodes[s]) - 1) * words[s] + sum(b[1] for b in below))
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(made[c]) == len(s))
        out.append((members[0], len(s), nodes[s[:-1]][0] if s else None, len(members), len(children.get(s, [])), *total[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def told(found):
    assert found.columns == COLUMNS
    assert {t for _, t in found.dtypes[:-1]} == {"bigint"}
    return sorted((tuple(r) for r in found.collect()), key=repr)


def shaped(seed=3):
    """Copies, common beginnings, one long conversation twice, nulls, ties, repeated rows, turnless and baseless conversations."""
    rnd, rows = random.Random(seed), []
    for c in range(70):
        n = rnd.choice([1, 1, 2, 3, 4, 6])
        rows += [(c, i, rnd.choice(["user", "system"]), rnd.choice(["a b", "c", "", "d  e\tf"])) for i in range(n)]
    rows += [(c, i, "user", f"turn {i}") for c in (100, 101, 103) for i in range(300)]
    rows += [(c, i, "user", "same words here") for c in range(200, 320) for i in range(3)]
    rows += [(400, None, None, None), (400, 0, None, "x"), (400, 0, "user", None), (400, 0, "user", None), (None, 1, "user", "lost"), (433, 5, "u", "no base"), (-7, 1, "u", "below zero")]
    rows += [(440, 0, "u", "long " * 5000), (441, 0, "u", "long " * 5000)]
    rnd.shuffle(rows)
    return rows


def test_nodes_are_those_of_a_plain_trie(spark):
    rows = shaped()
    assert told(prefix_trie.of_blocks(conversations(spark, rows))) == brute(rows)


def test_conversations_as_they_are(spark):
    rows = shaped(5)[:400]
    assert told(prefix_trie.plain(conversations(spark, rows))) == brute(rows, rebuild=False)


def test_collisions_are_split(spark):
    """Three values of turn hashes and fingerprints: nearly every candidate group is mixed."""
    rnd = random.Random(8)
    rows = [(c, i, rnd.choice("us"), rnd.choice("abcd")) for c in range(120) for i in range(rnd.choice([1, 2, 4, 7]))]
    weak = prefix_trie.of_blocks(conversations(spark, rows), hashed=lambda r, t: F.pmod(F.xxhash64(r, t), F.lit(3)), hashes=((2, 3), (1, 1)))
    assert told(weak) == brute(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert told(prefix_trie.of_blocks(conversations(spark, []))) == []
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 1)  # its base is absent, its only turn goes
    rows = [(c, 1, "u", "gone")]
    assert told(prefix_trie.of_blocks(conversations(spark, rows))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_is_its_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.QUERIES["op11_prefix_trie"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_scans_over_partitions_equal_a_loop(spark, parts):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, 9]), i, rnd.randrange(-(2**62), 2**62)) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        data = spark.createDataFrame(rows, "k bigint, i bigint, x bigint").repartition(5)
        found = scans.scan(data.withColumn("one", F.lit(1).cast("bigint")), "k", ["i"], ["k", "i", "x", "one"], {"f": scans.Polynomial("x", 31, 1_000_003), "n": scans.Polynomial("one")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, state = {}, {}
    for k, i, x in sorted(rows):
        n, f = state.get(k, (0, 0))
        state[k] = n + 1, (f + x * pow(31, n, 1_000_003)) % 1_000_003
        want[k, i] = (n, state[k][1], n + 1)
    assert {(r.k, r.i): (r._index, r.f, r.n) for r in found} == want


def test_running_begins_anew():
    assert scans.running(np.array([1, 2, 3, 4, 5]), np.array([0, 2, 3])).tolist() == [1, 3, 3, 4, 9]

"""Periodic runs against a direct scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiqua.llm import periodic
from lexiqua.llm.periodic import common_extensions, find_runs, grammar, mirror


def brute(words, least=24, power=3):
    found = {}
    for p in range(1, len(words) // power + 1):
        i = 0
        while i + p < len(words):
            if words[i] == words[i + p]:
                j = i
                while j + p < len(words) and words[j] == words[j + p]:
                    j += 1
                if j - i + p >= max(least, power * p):
                    found.setdefault((i, j - i + p), p)
                i = j
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def repetitive(rng):
    out = []
    for _ in range(rng.randint(0, 8)):
        if rng.random() < 0.3:
            out += [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        else:
            block = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 12))]
            out += (block * rng.randint(2, 14))[: rng.randint(1, 100)]
    return out


@pytest.mark.parametrize("least, power", [(24, 3), (6, 2), (2, 2), (10, 4)])
def test_runs_equal_brute_force(least, power):
    rng = random.Random(least)
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 8))]
        got = find_runs([np.array(t, np.int64) for t in texts], least, power)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t, least, power) for t in texts]


def test_extensions_in_both_directions():
    rng = random.Random(3)
    text = [rng.randint(0, 1) for _ in range(200)] * 3 + [1] * 50
    words = np.array([9, *text, 10])
    levels = grammar(words, 2)
    assert len(levels[-1].symbols) == 3
    pairs = [(i, j) for i in range(1, 600, 7) for j in range(i + 1, 650, 11)]
    i, j = (np.array(x) for x in zip(*pairs))

    def straight(a, b, step):
        n = 0
        while words[a] == words[b]:
            a, b, n = a + step, b + step, n + 1
        return n

    assert common_extensions(levels, i, j).tolist() == [straight(a, b, 1) for a, b in pairs]
    back = len(words) - 1
    assert common_extensions(mirror(levels), back - i, back - j).tolist() == [straight(a, b, -1) for a, b in pairs]


def test_long_periods_and_one_repeated_word():
    block = list(range(700))
    (whole, same) = find_runs([np.array(block * 3 + block[:5]), np.zeros(5000, np.int64)])
    assert whole.tolist() == [[0, 2105, 700]] and same.tolist() == [[0, 5000, 1]]
    assert len(find_runs([np.array(block * 3)[:-1]])[0]) == 0
    assert find_runs([]) == [] and len(find_runs([np.empty(0, np.int64)])[0]) == 0


def test_operator_on_odd_rows(spark):
    text = "x " + "a b\tc\n" * 9 + "y"
    rows = [(1, None, 3), (2, "", 3), (3, " \n", 3), (4, text, 3), (4, text, 3), (None, text, 3), (5, "é " * 24, 3), (6, "é " * 23, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((tuple(r) for r in periodic.periodic_runs(table).collect()), key=lambda r: (r[0] or 0, r[1]))
    run = [(1, 27, 3)]
    assert [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got] == [
        (None, 29, run, "x a b c y"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 29, run, "x a b c y"), (4, 29, run, "x a b c y"),
        (5, 24, [(0, 24, 1)], "é"), (6, 23, [], " ".join(["é"] * 23)),
    ]
    best = {r["doc_id"]: r for r in periodic.digests(periodic.periodic_runs(table)).collect()}
    assert (best[4]["start"], best[4]["exponent_milli"], best[1]["period"]) == (1, 9000, None)
    assert best[4]["runs_sha256"] == hashlib.sha256(b"1,27,3\n").hexdigest()
    assert best[1]["runs_sha256"] == best[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic.digests(periodic.periodic_runs(table.limit(0))).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(table, power=1)


def test_greatest_exponent_and_ties(spark):
    text = " ".join(["a b"] * 12 + ["-"] + ["c d"] * 12 + ["-"] + ["e f g"] * 12)
    got = periodic.digests(periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (got["n_runs"], got["start"], got["length"], got["period"]) == (3, 0, 24, 2)


def test_planted_periods(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(None, "a b")]
    got = periodic.with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, text), r in zip(rows, got):
        words, h = text.split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r["text"] == " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
        else:
            assert r["text"] == text
    assert spark.createDataFrame(got).where(F.col("text").isNull()).count() == 0

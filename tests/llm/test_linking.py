"""The stream of shared keys and the sketches, against their plain definitions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import jaccard, linking, words


class Dealt:
    """Stands for a table that is dealt and sorted already."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition


@pytest.fixture
def stream(monkeypatch):
    monkeypatch.setattr(linking, "map_arrow", lambda df, run, schema: run)
    return linking.shared_rows(Dealt())


def test_shared_rows_over_any_cut_into_batches(stream):
    rnd = random.Random(1)
    for _ in range(500):
        rows = [(rnd.randint(0, 6) * rnd.choice((1, 1, 0)), (rnd.choice((0, 1 << 127, 1 << 64)) | rnd.randint(0, 9)).to_bytes(16, "big")) for _ in range(rnd.randint(1, 40))]
        rows.sort(key=lambda r: r[0])  # by key alone
        batches, at = [], 0
        while at < len(rows):
            part = rows[at : (at := at + rnd.randint(1, 6))]
            words = linking.id_longs([r[1] for r in part])
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names=["key", "hi", "lo"]))
        got = [r for columns in stream(iter(batches)) for r in zip(*(c.to_pylist() for c in columns), strict=True)]
        want = []
        for key in sorted({r[0] for r in rows}):
            ids = sorted({r[1] for r in rows if r[0] == key})
            if len(ids) > 1:
                want += [(key, x, ids[0], ids[j - 1] if j else None, len(ids) > linking.FEW, j // linking.BLOCK) for j, x in enumerate(ids)]
        assert got == want


def test_shared_rows_of_nothing(stream):
    assert list(stream(iter([]))) == []


def test_sketches_let_every_link_through_and_rule_out_far_sets():
    rng = np.random.default_rng(2)
    for n in (1, 40, 500, 600, 1000, 1100, 5000, 40_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for more in (0, n // 20, n // 9, n // 5):
            b = np.unique(np.concatenate((a[: n - more], rng.integers(0, 1 << 63, more, dtype=np.uint64))))
            p, q = (jaccard.long_sketch(s) or jaccard.sketch(s) for s in (a, b))
            if jaccard.links(a.tobytes(), b.tobytes()):
                assert jaccard.near_by_long(p, q) and jaccard.near_by_long(q, p)
            # a set within another one, of another length of sketch
            c = a[: n - more]
            if len(c) and jaccard.links(a.tobytes(), c.tobytes()):
                assert jaccard.near_by_long(p, jaccard.long_sketch(c) or jaccard.sketch(c))
        far = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        if n >= 40:
            assert not jaccard.near_by_long(jaccard.long_sketch(a) or jaccard.sketch(a), jaccard.long_sketch(far) or jaccard.sketch(far))


def test_word_hashes_over_any_cut_into_slices(monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "b", "é", "word", "漢字", "x" * 5000, "y" * 300_000, "\t", "\v", "\n"]) for _ in range(rnd.randint(0, 20))) for _ in range(60)] + [None, "", "  ", "abc"]
    for size in (1 << 21, 3000):
        monkeypatch.setattr(words, "SLICE", size)
        known, back, n = {}, {}, 0
        for s in words.slices(pa.array(texts, pa.string())):
            for k in range(len(s)):
                raw = (texts[s.first + k] or "").encode()
                assert s.text(k) == raw and len(s.hashes(k)) == len(raw.split())
                for w, h in zip(raw.split(), s.hashes(k).tolist(), strict=True):
                    assert known.setdefault(w, h) == h and back.setdefault(h, w) == w
                n += 1
        assert n == len(texts)


def test_round_two_over_several_blocks(spark, monkeypatch):
    """One key that all ids share, in blocks of four: every pair across components is tested."""
    monkeypatch.setattr(linking, "BLOCK", 4)
    n = 30
    ids = [i.to_bytes(16, "big") for i in range(n)]
    rows = spark.createDataFrame([(7, *map(int, linking.id_longs([i])[0])) for i in ids], linking.KEYS)
    table = spark.createDataFrame([(bytearray(i), bytearray(i)) for i in ids], "id binary, f binary")
    # links: i and i + 7, which neither a leader nor a neighbour shows
    found = linking.find_links(
        rows,
        lambda w: table.join(w, "id"),
        lambda x, ys: np.array([abs(int.from_bytes(x, "big") - int.from_bytes(y, "big")) == 7 for y in ys]),
        lambda w: table.withColumnRenamed("f", "p").join(w, "id"),
        lambda x, y: abs(int.from_bytes(x, "big") - int.from_bytes(y, "big")) == 7,
    )
    comps = {bytes(r["id"]): bytes(r["comp"]) for r in linking.components(found).collect()}
    assert comps == {ids[i]: ids[i % 7] for i in range(n)}


def test_filters_and_merged_chunks(spark, monkeypatch):
    given = np.arange(-30, 5000, 3)
    ids = spark.createDataFrame([(int(i),) for i in given] + [(None,)], "id long").repartition(7)
    held = linking.filter_of(ids)
    assert held.may_hold(given).all()
    assert held.may_hold(np.arange(1, 50_000, 3)).mean() < 0.1
    assert not linking.filter_of(ids.limit(0)).may_hold(given).any()
    monkeypatch.setattr(linking, "FAN", 2)
    parts = [(c, p, bytearray(zlib.compress(np.full(4, 10 * c + p, np.uint64).tobytes()))) for c in range(3) for p in range(9) if (c + p) % 4]
    merged = linking.merge_chunks(spark.createDataFrame(parts, "chunk int, part int, f binary").repartition(5), "<u8", np.add)
    assert {c: x.tolist() for c, x in merged.items()} == {c: [sum(10 * c + p for p in range(9) if (c + p) % 4)] * 4 for c in range(3)}


def test_a_key_of_many_rows_goes_on_in_parts(stream, monkeypatch):
    monkeypatch.setattr(linking, "HELD", 7)
    rnd = random.Random(4)
    ids = [rnd.randint(0, 40).to_bytes(16, "big") for _ in range(90)]
    rows = [(1, b"a" * 16)] + [(2, i) for i in ids] + [(3, b"b" * 16), (4, b"c" * 16), (4, b"d" * 16)]
    batches = []
    for x in range(0, len(rows), 5):
        part = rows[x : x + 5]
        words = linking.id_longs([r[1] for r in part])
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names=["key", "hi", "lo"]))
    got = [r for columns in stream(iter(batches)) for r in zip(*(c.to_pylist() for c in columns), strict=True)]
    two = [r for r in got if r[0] == 2]
    assert {r[1] for r in two} == set(ids) and all(r[4] for r in two) and len({r[2] for r in two}) == 1
    assert sum(r[3] is None for r in two) == 1 and [r[1] for r in got if r[0] == 4] == [b"c" * 16, b"d" * 16] and {r[0] for r in got} == {2, 4}


def brute_smallest(pairs):
    """Of every end of pairs that differ the smallest one reachable."""
    comp = {x: x for a, b in pairs if a != b for x in (a, b)}
    while any(comp[a] != comp[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def random_links(rnd, ids, n):
    return [(ids[rnd.randrange(len(ids))], ids[rnd.randrange(len(ids))]) for _ in range(n)]


def test_stars_of_random_links():
    rnd = random.Random(5)
    for _ in range(300):
        ids = [(rnd.choice((0, 1 << 64, 255 << 120)) | rnd.randrange(40)).to_bytes(16, "big") for _ in range(30)]
        pairs = [(a, b) for a, b in random_links(rnd, ids, rnd.randint(1, 40)) if a != b]
        words = np.hstack([linking.id_longs([p[k] for p in pairs]).view(np.uint64) for k in (0, 1)]) if pairs else np.empty((0, 4), np.uint64)
        got, roots = (linking.id_bytes(x.byteswap()).to_pylist() for x in linking.stars_of(words))
        assert len(set(got)) == len(got)
        assert dict(zip(got, roots, strict=True)) == brute_smallest(pairs)


@pytest.mark.parametrize("most", [3, 50, 1 << 17])
def test_components_over_one_task_or_several(spark, monkeypatch, most):
    monkeypatch.setattr(linking, "EDGES", most)
    rnd = random.Random(6)
    ids = [rnd.getrandbits(128).to_bytes(16, "big") for _ in range(150)]
    pairs = random_links(rnd, ids, 90) + list(zip(ids[:60], ids[1:61], strict=True)) * 2 + [(i, i) for i in ids[-9:]]
    rnd.shuffle(pairs)
    links = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], linking.LINK).repartition(8)
    got = [(bytes(r["id"]), bytes(r["comp"])) for r in linking.components(links).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == brute_smallest(pairs)
    assert linking.components(links.limit(0)).count() == 0


def test_a_long_chain_takes_few_jobs(spark):
    """Rounds of stars grow with a chain's length, and each costs several stages."""
    ids = [i.to_bytes(16, "big") for i in range(2000)]
    links = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(ids, ids[1:], strict=False)], linking.LINK)
    spark.sparkContext.setJobGroup("chain", "components of a chain")
    try:
        comps = linking.components(links)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {bytes(r["comp"]) for r in comps.collect()} == {ids[0]} and comps.count() == len(ids)
    assert jobs <= 4

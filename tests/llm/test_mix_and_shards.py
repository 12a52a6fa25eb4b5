"""Curriculum mix, sharding, the pipeline, and the registered queries."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import curriculum_mix, language_id, minimax_shards, queries
from tests.conftest import SF
from tests.test_catalogue import TABLES, sorted_rows

from .conftest import prose
from .test_dedup import shingles


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), ratio=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = ratio * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        level = (total - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > repeats * sizes[s]]
        if not over:
            return held | {s: level * weight[s] for s in free}
        held |= {s: repeats * sizes[s] for s in over}


def check_mix(rows, texts):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in texts:
        sizes[source] += size_of(text)
    targets = brute_targets(sizes)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == -(-r["taken"] // max(r["size"], 1)) or 0 < r["taken"]
        assert r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_of_odd_rows(odd, odd_rows, none):
    rows = curriculum_mix.mix_sources(odd).collect()
    check_mix(rows, [(r[0], r[1], r[3]) for r in odd_rows])
    assert curriculum_mix.mix_sources(none).count() == 0
    again = curriculum_mix.mix_sources(odd.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["taken"], r["positions"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_schedules_move_sources(spark):
    docs = spark.createDataFrame([(i, "word " * 10, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    rows = curriculum_mix.mix_sources(docs, weights=(1,), ratio=1.0, schedules=[(1.0, 1.0), (0.5, 1.5), (1.5, 0.5)]).collect()
    mean = {s: np.mean([p for r in rows if r["source"] == s for p in r["positions"]]) for s in ("s0", "s1", "s2")}
    assert mean["s2"] < mean["s0"] - 1000 < mean["s1"] - 2000
    early = sum(p < 15_000 for r in rows for p in r["positions"])
    assert abs(early - 1500) < 40  # half of all words by half of all positions
    ordered = curriculum_mix.in_training_order(curriculum_mix.mix_sources(docs)).collect()
    mixed = curriculum_mix.mix_sources(docs).collect()
    assert [r["position"] for r in ordered] == sorted(p for r in mixed for p in r["positions"])
    assert sorted(r["doc_id"] for r in ordered) == sorted(r["doc_id"] for r in mixed for _ in r["positions"]) and len(ordered) > len(mixed)


def test_inverse_of_the_demand(spark):
    rows = spark.range(101).selectExpr("id / 100.0D as u").crossJoin(spark.createDataFrame([(a,) for a in (-1.0, -0.5, 0.0, 0.3, 1.0)], "a double"))
    for r in rows.select("u", "a", curriculum_mix._time_of(rows["u"], rows["a"]).alias("t")).collect():
        assert r["t"] + r["a"] * (r["t"] - r["t"] ** 2) == pytest.approx(r["u"], abs=1e-9) and -1e-9 <= r["t"] <= 1 + 1e-9


def brute_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, used, have = (low + high) // 2, 1, 0
        for s in sizes:
            used, have = (used + 1, s) if have + s > mid else (used, have + s)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def check_shards(rows, shards):
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["text"]].add(r["shard"])
        assert r["size"] == (len(r["text"].encode()) if r["text"] is not None else 0) + 1 and 0 <= r["shard"] < shards
        assert r["text_crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())


def test_shards_of_odd_rows(odd, odd_rows, none):
    rows = minimax_shards.shard_documents(odd, 4, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(odd_rows)
    check_shards(rows, 4)
    assert minimax_shards.shard_documents(none, 4).count() == 0


@pytest.mark.parametrize("seed, shards", [(0, 3), (1, 7), (2, 16), (3, 1)])
def test_capacity_is_the_least(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(minimax_shards, "FIRST_SHIFT", 61)  # eight ranges at first, so that several levels are needed
    monkeypatch.setattr(minimax_shards, "STEP", 2)
    rng = np.random.default_rng(seed)
    h, size = rng.integers(-(1 << 63), (1 << 63) - 1, 500), rng.integers(1, 100, 500)
    size[7] = 2000 if seed % 2 else 5
    groups = spark.createDataFrame(list(zip(h.tolist(), size.tolist())), "h long, bytes long")
    cuts, capacity = minimax_shards.minimax_cuts(groups, shards)
    ordered = [int(s) for _, s in sorted(zip(h.tolist(), size.tolist()))]
    assert capacity == brute_capacity(ordered, shards)
    filled = np.bincount(np.searchsorted(sorted(cuts), h, "right"), size)
    assert len(cuts) < shards and filled.max() <= capacity
    if not seed % 2:
        assert len(filled) == shards and np.abs(filled - size.sum() / shards).max() <= size.max()


def test_few_groups(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(50)] + [(99, "other")], "doc_id long, text string")
    rows = minimax_shards.shard_documents(docs, 16, keep=["doc_id", "text"]).collect()
    check_shards(rows, 16)
    assert len({r["shard"] for r in rows}) == 2


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(want.fetchall(), want.columns)


def test_contract_columns(spark):
    want = {
        "op2_": "doc_id n_assign n_access n_hex base_sha256 spans", "op3_": "doc_id size source_size target taken", "op4_": "doc_id n_lines n_dropped kept_sha256", "op5_": "doc_id n_shingles component_id",
        "op6_": "vec_id n_links component_id kept", "op7_": "doc_id size text_crc32 law shard slot grown_shard", "op8_": "page_id host path rule verdict", "op9_": "doc_id held_out lang_pred score", "op10_": "doc_id held_out score predicted",
    }
    registered = __spark_entry__.queries()
    assert "pipeline" in registered
    for start, columns in want.items():
        (name,) = [n for n in registered if n.startswith(start)]
        assert set(columns.split()) <= set(registered[name](spark, SF).columns), name


def stages(spark, docs, sf_dir=SF):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def position_of(ahead, source, sources, targets):
    """Training position of a word of a source, from the schedules by bisection."""
    tilt = {s: (0.0, -0.5, 0.5)[i % 3] for i, s in enumerate(sources)}
    demand = lambda s, t: t + tilt[s] * (t - t * t)
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if demand(source, middle) * targets[source] < ahead else (low, middle)
    return sum(targets[s] * demand(s, low) for s in sources)


def check_curriculum(clean, mixed):
    """The mix of whole rows in training order, by brute force."""
    sizes, order = defaultdict(int), defaultdict(list)
    for r in clean:
        sizes[r["source"]] += size_of(r["text"])
        turn = "" if r["doc_id"] is None else hashlib.md5(str(r["doc_id"]).encode()).hexdigest()
        order[r["source"]].append((turn, r["doc_id"] or 0, size_of(r["text"]), r))
    sources, targets, want = sorted(sizes, key=lambda s: (s is None, (s or "").encode())), brute_targets(sizes), []
    for s, rows in order.items():
        rows.sort(key=lambda x: x[:3])
        ahead = 0
        for _, _, size, r in rows * 2:
            if size and ahead < int(targets[s]):
                want.append((position_of(ahead, s, sources, targets), str(r)))
            ahead += size
    # Rows of one id and size may change places.
    tied = {k for k in ((r["source"], r["doc_id"], size_of(r["text"])) for r in clean)}
    if len(tied) == len(clean):
        assert sorted(w for _, w in want) == sorted(str(r) for r in mixed)
        at = {}
        for p, w in sorted(want):
            at.setdefault(w, []).append(p)
        read = defaultdict(int)
        positions = []
        for r in mixed:
            positions.append(at[str(r)][read[str(r)]])
            read[str(r)] += 1
        assert all(b >= a - 1e-3 for a, b in zip(positions, positions[1:]))
    else:
        assert len(want) == len(mixed) and {str(r) for r in mixed} <= {str(r) for r in clean}


def check_pipeline(tables, bench):
    start, known, unique, clean, mixed, sharded = [t.select(*corpus_pipeline.COLUMNS).collect() for t in tables]
    for t in tables[1:-1]:
        assert t.columns == corpus_pipeline.COLUMNS
    letters = lambda r: any(c.isalpha() for c in r["text"] or "")
    # Texts with a letter stay, unless no language holds half of their words; lang is what was found.
    plain = lambda r: str((r["doc_id"], r["text"], r["source"], r["n_chars"]))
    model = language_id.train(tables[0].filter(~language_id.held_out()))
    found = language_id.identify(tables[0], model, keep=corpus_pipeline.COLUMNS).collect()
    assert {plain(r) for r in start if not letters(r)}.isdisjoint(map(plain, known)) and len(known) <= sum(map(letters, start))
    assert sorted(plain(r) + r["lang"] for r in known) == sorted(plain(r) + r["lang_pred"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5)
    sets = [shingles(r["text"]) for r in unique]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            common = len(a & b)
            assert not a or 100 * common < 75 * (len(a) + len(b) - common)
    every = {r["doc_id"] for r in known}
    assert {r["doc_id"] for r in unique} <= every and min(every - {None}) in {r["doc_id"] for r in unique}
    flat = lambda t: " ".join((t or "").lower().split())
    hit = {r["doc_id"] for r in unique if any(flat(b) in flat(r["text"]) for b in bench)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique} - hit
    check_curriculum(clean, mixed)
    assert sorted(map(str, sharded)) == sorted(map(str, mixed))
    check_shards(tables[-1].collect(), corpus_pipeline.SHARDS)


def test_pipeline(spark):
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    check_pipeline(tables, bench)
    assert tables[1].count() > tables[2].count() > tables[3].count() > 0
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, tables[-1].collect()))


def test_pipeline_of_odd_rows(spark, odd, none):
    tables = stages(spark, odd.filter("doc_id is not null"))
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check_pipeline(tables, bench)
    assert stages(spark, odd)[-1].count() > 0
    assert [t.count() for t in stages(spark, none)] == [0] * 6


def test_pipeline_of_rows_without_ids(spark, odd):
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = stages(spark, odd)
    check_pipeline(tables, bench)
    assert tables[3].filter("doc_id is null").count() > 0


def test_mix_of_rows_with_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i // 6, f"text {i} " * (i % 4 + 1), "en" if i % 2 else None, f"s{i % 2}", i) for i in range(60)] + [(None, "twice the same", "en", "s0", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    got = defaultdict(int)
    for r in corpus_pipeline.mix_to_targets(spark, docs, SF).collect():
        got[tuple(r)] += 1
    want = defaultdict(int)
    keyed = docs.withColumn("whole", F.struct(*corpus_pipeline.COLUMNS)).withColumn("_t_row", corpus_pipeline.row_key())
    for r in curriculum_mix.mix_sources(keyed, keep=["_t_row", "whole"]).collect():
        want[tuple(r["whole"])] += len(r["positions"])
    assert got == {k: n for k, n in want.items() if n}
    assert any(k[0] is None for k in got)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c, d = (prose(60, 70 + i) for i in range(4))
    rows = [(1, a), (7, a + " end"), (7, b), (7, c), (None, b + " end"), (None, d), (None, d + " end"), (None, d), (9, c), (9, c), (None, "..."), (None, "...")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(g for g in got if g[0]) == sorted([(1, a), (7, b), (7, c)])
    assert [t for i, t in got if i is None and t == "..."] == ["..."] and [t for i, t in got if i is None and t in (d, d + " end")]
    assert len(got) == 5


def test_documents_with_letters_stay_without_labels(spark, odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    known = corpus_pipeline.identify_language(spark, unlabelled, SF)
    want = [r["text"] for r in odd.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(r["text"] for r in known.collect()) == sorted(want) and known.columns == corpus_pipeline.COLUMNS

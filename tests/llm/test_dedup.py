"""Components, line dedup, Jaccard join, embeddings, decontamination."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, embed_dedup, jaccard_join, line_dedup, queries
from tessera.llm import textkernel as tk
from tessera.llm.components import connected_components
from tests.conftest import SF

from .conftest import CLASHING, prose

LAST = (1 << 63) - 1


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 2), (2, 5), (9, 5), (None, 3), (7, 8)], [(random.Random(k).randrange(90), random.Random(k + 999).randrange(90)) for k in range(70)]])
def test_components(spark, edges):
    want = Union()
    for a, b in edges:
        if a is not None and b is not None:
            want.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: want.find(x) for x in want.up if want.find(x) != x}


def test_word_and_shingle_hashes():
    texts = ["", "a", "b  c\td\ne f g", " x ", "a", "é ü a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    starts, ends, first = tk.word_spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in t.split()] and np.diff(first).tolist() == [len(t.split()) for t in texts]
    hashes = tk.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words)) and hashes[0] == hashes[words.index("a", 1)]
    shingles, bounds = tk.shingle_hashes(hashes, first, 3)
    assert np.diff(bounds).tolist() == [0, 1, 4, 1, 1, 1]
    assert shingles[0] == shingles[bounds[4]]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute_lines(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 10:
                holders[line_key(line)].add(LAST if i is None else i)
    out = []
    for i, text in rows:
        lines, own = (text or "").split("\n"), LAST if i is None else i
        kept = [x for x in lines if len(line_key(x)) < 10 or len(holders[line_key(x)]) < 2 or min(holders[line_key(x)]) == own]
        out.append((own, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got_lines(df):
    return sorted((LAST if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


def test_lines_of_odd_rows(odd, odd_rows, none):
    assert got_lines(line_dedup.deduplicate_lines(odd)) == brute_lines([(r[0], r[1]) for r in odd_rows])
    assert line_dedup.deduplicate_lines(none).count() == 0


def test_lines_at_random(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 400)
    rng = random.Random(5)
    lines = [f"  Line number {i} of many{' ' * (i % 3)}" for i in range(40)] + ["short", "", "ÄÖÜäöüßéèê", "123456789", "1234567890", "\tLINE number 3 of many\r"]
    rows = [(rng.randrange(200), "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for _ in range(150)] + [(500 + i, "the very common line") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_lines(line_dedup.deduplicate_lines(df)) == brute_lines(rows)


def test_lines_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 600)
    rng = random.Random(8)
    lines = [f"this is line number {i}" for i in range(60)] + ["short"]
    text = lambda: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))
    rows = [(None, text()) for _ in range(120)] + [(7, text()) for _ in range(60)] + [(None, "this is line number 1\nshort")] * 30 + [(i, text()) for i in range(60)] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_lines(line_dedup.deduplicate_lines(df)) == brute_lines(rows)
    lists = line_dedup.duplicate_line_lists(df).collect()
    assert max(len(r["_t_lost"]) for r in lists) <= 5 * 8  # what one row loses, not what an id loses
    assert len({(r["_t_id"], r["_t_hash"]) for r in lists}) == len({(r["_t_id"], r["_t_hash"], bytes(r["_t_lost"])) for r in lists})


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert sorted(line_dedup.PerfectHash(keys).index(keys).tolist()) == list(range(len(keys)))
    shard = line_dedup.LineShard.unpacked(line_dedup.LineShard(keys, np.full(len(keys), 2), np.arange(len(keys))).packed())
    found, owner = shard.probe(np.concatenate((keys[:100], keys[:100] + np.uint64(1))))
    assert set(range(100)) <= set(found.tolist()) and owner[:100].tolist() == list(range(100)) and len(found) == 100 + np.isin(keys[:100] + np.uint64(1), keys).sum()
    assert len(line_dedup.PerfectHash(np.zeros(0, np.uint64)).index(keys[:3])) == 3


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows):
    sets, classes = [shingles(t) for _, t in rows], Union()
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        classes.find(k)
        for x in s:
            holders[x].append(k)
    pairs = {(a, b) for v in holders.values() for n, b in enumerate(v) for a in v[:n]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            classes.join(a, b)
    least = defaultdict(lambda: LAST)
    for k, (i, _) in enumerate(rows):
        least[classes.find(k)] = min(least[classes.find(k)], LAST if i is None else i)
    return sorted((LAST if i is None else i, len(sets[k]), least[classes.find(k)]) for k, (i, _) in enumerate(rows))


def got_classes(df):
    real = lambda x: LAST if x is None else x
    return sorted((real(r["doc_id"]), r["n_shingles"], real(r["component_id"])) for r in df.collect())


def test_classes_of_odd_rows(odd, odd_rows, none):
    assert got_classes(jaccard_join.jaccard_classes(odd)) == brute_classes([(r[0], r[1]) for r in odd_rows])
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_classes_at_the_border(spark, monkeypatch):
    """Groups of copies that differ by a few words, so that many pairs lie on either
    side of the threshold; a passage that unrelated documents share; exact copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 500)
    rng, rows = random.Random(11), []
    for group in range(5):
        words = prose(90, 1000 + group).split()
        for _ in range(24):
            copy = list(words)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10_000)}"
            rows.append((rng.randrange(10_000), " ".join(copy)))
    passage = prose(40, 77)
    rows += [(rng.randrange(10_000), prose(60, 5000 + i) + " " + passage) for i in range(30)] + [(rng.randrange(10_000), passage + f" end{i}") for i in range(6)]
    rows += [(20_000 + i, rows[3][1].upper()) for i in range(20)] + [(30_000, "one two three"), (30_001, "One  two THREE"), (30_002, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_classes(jaccard_join.jaccard_classes(df)) == brute_classes(rows)
    monkeypatch.setattr(jaccard_join, "DRAWS", ())  # leaves more to the last step
    assert got_classes(jaccard_join.jaccard_classes(df)) == brute_classes(rows)


def test_classes_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got_classes(queries.op5_jaccard_join(spark, SF)) == brute_classes(rows)


def brute_vectors(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(v)
    classes, links = Union(), defaultdict(int)
    for a in good:
        classes.find(a)
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                classes.join(a, b)
                links[a] += 1
                links[b] += 1
    least = defaultdict(lambda: LAST)
    for k in good:
        least[classes.find(k)] = min(least[classes.find(k)], rows[k][0])
    return sorted((str(i), links[k], str(least[classes.find(k)] if k in good else i)) for k, (i, _) in enumerate(rows))


def got_vectors(df):
    rows = df.collect()
    for r in rows:
        assert r["kept"] == (None if r["vec_id"] is None else r["vec_id"] == r["component_id"])
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rows)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SPLIT", 20)
    monkeypatch.setattr(embed_dedup, "CELL", 40)
    rng, rows = np.random.default_rng(2), []
    centres = rng.standard_normal((12, 16))
    for k in range(300):
        v = centres[k % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.8])
        rows.append((k, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # equal vectors
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (None, rows[5][1]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in [*CLASHING, "cell", "pair", "code", "rep", "good", "splits"]}).repartition(3)
    got, want = got_vectors(embed_dedup.near_duplicates(df, recall=0.9999)), brute_vectors(rows)
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want) and [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g != w for g, w in zip(got, want)) <= 2


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["kept"]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a, b = (embed_dedup.unit(rng.standard_normal((400, 64))) for _ in range(2))
    b[:200] = embed_dedup.unit(a[:200] + 0.1 * b[:200])
    b[200:300] = embed_dedup.unit(a[200:300] + 0.04 * b[200:300])
    exact = a @ b.T
    for bits, groups in ((0, 1), (8, 10)):
        count = embed_dedup.rotations(64, bits, groups)
        left, right = (embed_dedup.Codes.of(x, count) for x in (a, b))
        again = embed_dedup.Codes.unpacked(np.array([list(p) for p in right.packed()], np.uint8), 64, count)
        assert (again.signs == right.signs).all() and (again.levels == right.levels).all() and (again.cells(bits, groups) == right.cells(bits, groups)).all()
        used = embed_dedup._used(64, count)
        estimate = left.queries() @ np.where(again.signs[:, : used * 64], 1, -1).T / np.sqrt(used * 64) / again.factor
        assert abs((estimate - exact).mean()) < 0.002
        for threshold in (0.6, 0.95, 0.99):
            near = exact >= threshold
            kept = np.zeros(exact.shape, bool)
            for i, j in embed_dedup.possible_pairs(left, again, threshold):
                kept[i, j] = True
            assert near.any() and kept[near].mean() > 0.99 and kept[~near].mean() < 0.2


def test_recall_with_the_registered_parameters(spark):
    """All pairs of 50,000 vectors by brute force, many of them just above the threshold."""
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((50_000, 32)).astype(np.float32)
    near = vectors[:10_000] / np.linalg.norm(vectors[:10_000], axis=1, keepdims=True)
    angle = rng.uniform(0.05, 0.36, 10_000)[:, None]
    away = rng.standard_normal((10_000, 32))
    away -= (away * near).sum(1, keepdims=True) * near
    vectors[10_000:20_000] = np.cos(angle) * near + np.sin(angle) * away / np.linalg.norm(away, axis=1, keepdims=True)
    units = embed_dedup.unit(vectors)
    want, single = np.zeros(len(units), np.int64), units.astype(np.float32)
    for a in range(0, len(units), 1000):
        i, j = np.nonzero(single[a : a + 1000] @ single[a:].T > 0.9499)
        i, j = i[i < j] + a, j[i < j] + a
        sure = np.einsum("ij,ij->i", units[i], units[j]) >= 0.95
        want += np.bincount(i[sure], minlength=len(units)) + np.bincount(j[sure], minlength=len(units))
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(units)), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})).repartition(8)
    got = embed_dedup.near_duplicates(frame).select("vec_id", "n_links").toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert want.sum() > 15_000 and (got <= want).all() and got.sum() >= 0.999 * want.sum()


def brute_scores(index, words):
    table = np.zeros((len(index.terms), index.size))
    table[np.repeat(np.arange(len(index.terms)), np.diff(index.start)), index.chunk] = index.weight
    best = {}
    for a in range(0, max(len(words), 1), decontaminate.STEP):
        inside = np.isin(index.terms, words[a : a + decontaminate.STEP * decontaminate.STEPS])
        for c in np.flatnonzero(table[inside].sum(0) >= decontaminate.SCORE - 1e-9):
            k = int(index.owner[c])
            best[k] = max(best.get(k, 0.0), table[inside, c].sum())
    return best


def test_pruned_retrieval_equals_scoring_everything():
    items = [(i, prose(20 + i % 50, 300 + i)) for i in range(120)]
    index, rng = decontaminate.ItemIndex(items), random.Random(3)
    assert index.rest.max() <= decontaminate.REST + 1e-9 and (~index.essential).any()
    for k in range(60):
        text = prose(rng.randrange(200), 900 + k).split()
        if k % 2:
            part = items[rng.randrange(120)][1].split()
            text[10:10] = [w for w in part if rng.random() < 0.8]
        words = decontaminate._words(" ".join(text))
        got = {i: s for _, i, s in index.retrieve(words, np.array([0, len(words)]))}
        want = brute_scores(index, words)
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_contaminated_documents(spark):
    item = "What is the name of the tall tower that stands in the old town of Berlin? It is called the television tower of course."
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "!!!"), (None, prose(30, 4)), (5, prose(300, 8))], "item_id long, text string")
    near = item.replace("tall", "high").upper()
    rows = [(1, prose(100, 1) + " " + item + " " + prose(50, 2)), (2, near), (3, prose(200, 3)), (4, item.split("?")[0]), (5, None), (6, ""), (7, prose(300, 8)), (8, prose(30, 4)), (9, "junk*** ".join(item.split()))]
    found = decontaminate.find_matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    got = {r["doc_id"]: sorted(str(m["item_id"]) for m in r["matches"]) for r in found}
    assert got[1] == ["1"] and got[2] == ["1"] and got[7] == ["5"] and got[8] == ["None"]
    assert not any(got[i] for i in (3, 4, 5, 6))


def test_items_in_several_passes(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    pairs = lambda: sorted((r["doc_id"], m["item_id"]) for r in decontaminate.find_matches(docs, bench).collect() for m in r["matches"])
    want = sorted((d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if " ".join(b["text"].lower().split()) in " ".join(d["text"].lower().split()))
    assert want and pairs() == want
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    assert pairs() == want


def test_decontamination_of_odd_rows(spark, odd, odd_rows, none):
    bench = spark.createDataFrame([(1, "a short one")], "item_id long, text string")
    rows = decontaminate.find_matches(odd, bench).collect()
    assert len(rows) == len(odd_rows) and [r["doc_id"] for r in rows if r["matches"]] == [1]
    assert decontaminate.find_matches(none, bench).count() == 0
    assert decontaminate.find_matches(odd, bench.limit(0)).filter("size(matches) > 0").count() == 0


def test_item_parts():
    assert decontaminate.split_item("Q one? Answer: it is two") == ("Q one? ", " it is two")
    assert decontaminate.split_item("who are you? i am the one")[1].strip() == "i am the one"
    assert decontaminate.split_item("single") == ("single", "single")


def test_items_with_short_parts(spark):
    items = ["What is the capital of France? Answer: Paris", "Largest planet? Answer: it is the planet Jupiter", "Name the two authors. A: no", "Who wrote the old book of fables?\nA: Jean Fontaine", "Nine lives"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"{prose(80, i)} {t} {prose(30, i + 9)}") for i, t in enumerate(items)] + [(10, items[0].replace("Paris", "Lyon")), (11, "nine old lives"), (12, "Paris"), (13, "Jean, Who wrote the old book of fables? Fontaine")]
    found = decontaminate.find_matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in found} == {i: [i] for i in range(5)} | {10: [], 11: [], 12: [], 13: []}


def test_copies_with_one_word_changed(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/benchmark.parquet").collect() if r["text"]]
    index = decontaminate.ItemIndex(list(enumerate(items)))
    around = decontaminate._words(prose(200, 5))
    for k, text in enumerate(items):
        words = decontaminate._words(text)
        short = [p for p in (index.questions[k], index.answers[k]) if len(p[2]) < decontaminate.GRAM]
        for at in range(0 if short else len(words)):
            changed = words.copy()
            changed[at] = 12345
            doc = np.concatenate((around[:90], changed, around[90:]))
            hits = [(i, s) for _, i, s in index.retrieve(doc, np.array([0, len(doc)]))]
            assert k in [m[0] for m in index.verified(doc, hits)], (text, at)
    assert decontaminate.least_edits(np.array([1, 2, 3]), np.array([9, 1, 3, 4])) == 1 and decontaminate.least_edits(np.array([1, 2]), np.array([7, 8])) == 2


def test_retrieval_finds_what_verification_accepts(spark):
    own = lambda kind, i: " ".join(f"{kind}{i}x{j}" for j in range(20))
    items = [(i, f"{own('q', i)}? Answer: {own('a', i)}") for i in range(15)] + [(15, "Tall tower? Answer: Eiffel")]
    index = decontaminate.ItemIndex(items)
    text = decontaminate._words(f"{own('q', 2)} {prose(150, 40)} {own('a', 2)}")
    assert not index.retrieve(text, np.array([0, len(text)]))
    assert all(set(decontaminate._words(t)) == set(np.concatenate(decontaminate.chunks_of(decontaminate._words(t)))) for _, t in items)
    rows = [(i, f"{prose(30, i)} {t.split('? Answer: ')[0]} {prose(150, 40 + i)} {t.split('? Answer: ')[1]}") for i, t in items]
    found = decontaminate.find_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in found:
        words = decontaminate._words(dict(rows)[r["doc_id"]])
        every = {m[0]: m[1] for m in index.verified(words, [(k, None) for k in range(len(items))])}
        assert r["doc_id"] in every and {m["item_id"]: m["score"] for m in r["matches"]} == pytest.approx(every)
    text = decontaminate._words(rows[3][1])
    for k, score in ((k, s) for _, k, s in index.retrieve(text, np.array([0, len(text)]), 0.3)):
        assert index.best_score(text, k) == pytest.approx(score)


def test_scores_do_not_depend_on_the_passes(spark, monkeypatch):
    items = [(i, prose(20 + i % 50, 300 + i)) for i in range(60)]
    rng = random.Random(8)
    rows = [(i, " ".join([prose(40, i), *[w for w in t.split() if rng.random() < 0.85], prose(40, 70 + i)])) for i, t in items]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    scores = lambda: {(r["doc_id"], m["item_id"]): m["score"] for r in decontaminate.find_matches(docs, bench).collect() for m in r["matches"]}
    want = scores()
    for limit in (400, 2000):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", limit)
        assert want and scores() == pytest.approx(want)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 1)
    assert scores() == pytest.approx(want)
    plan = decontaminate.find_matches(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def runs_of(words, width):
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def edits_of(part, words):
    """Least edits of a part to a run of words: the plain table."""
    above = [0] * (len(words) + 1)
    for i, p in enumerate(part, 1):
        row = [i]
        for j, w in enumerate(words, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (p != w)))
        above = row
    return min(above)


def holds_item(words, text):
    """Whether words hold both parts of an item, without index, hashes or pruning."""
    parts = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", part.translate(LOW)) for part in decontaminate.split_item(text)]
    shares = []
    for part in parts:
        own = runs_of(part, min(3, len(part)))
        shares.append(len(own & runs_of(words, min(3, len(part)))) / len(own) if own and part else 0.0)
    found = list(shares)
    for i, part in enumerate(parts):
        if shares[i] < 0.5 and 3 <= len(part) <= 24 and (len(part) >= 5 or shares[1 - i] >= 0.5) and len(runs_of(words, 1) & runs_of(part, 1)) >= len(part) // 2:
            edits = edits_of(part, words)
            if edits <= max(1, len(part) // 5):
                found[i] = max(shares[i], 1 - edits / len(part))
    return min(found) >= 0.5


def test_the_whole_query_against_brute_force(spark):
    items = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, item["item_id"]) for i, text in texts.items() for item in items if holds_item(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOW)), item["text"])}
    got = queries.op1_decontaminate(spark, SF).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)

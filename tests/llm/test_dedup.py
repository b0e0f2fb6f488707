"""Exact, substring and near-duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headway.llm import ngram_join, sketch
from headway.llm.common import Scratch
from headway.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from headway.llm.ngram_join import keep_one_of_each, near_duplicates
from headway.llm.sketch import PART_SCHEMA, DenseCounter, LogSketch, TwiceSketch, cells_for, count_hashes, log_cells_for, others
from headway.llm.substring_dedup import remove_repeats
from headway.llm.vectors import Forest, _share_one, near_duplicate_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, key string, name string, level int, n int, tokens string, n_rows int, kept string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
HARD = [
    (5, None), (4, ""), (9, "a b"), (2, "a \t\n b"), (2, "a \t\n b"), (7, "a  b "), (None, "a b"), (None, None), (11, LONG), (10, LONG), (12, LONG + " end"),
    (13, "Ünï   x"), (14, "ünï   x"), (15, "   "), (16, "abcdefgh"), (17, "abcdefg"), (18, "abcdefgh "),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2, "t", 3, "k") for i, t in rows], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_duplicates(spark, block):
    got = {(r.id, r.key): (r.n_rows, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(frame(spark, HARD), block=block).collect()}
    groups = defaultdict(list)
    for i, t in HARD:
        groups[norm(t)].append(i)
    want = []
    for ids in groups.values():
        smallest = min((i for i in ids if i is not None), default=None)
        want += [(i, n, smallest, len(ids), i == smallest) for i, n in Counter(ids).items()]
    order = lambda rows: sorted(rows, key=str)
    assert order((i, *v) for (i, _), v in got.items()) == order(want)


def test_exact_duplicates_are_dropped(spark):
    docs = frame(spark, HARD)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in HARD})
    assert drop_exact_duplicates(docs.limit(0)).count() == 0


def test_repeated_windows_are_removed(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (102, rows[3][1]), (None, rows[5][1]), (103, "q " * 50), (104, LONG)]
    for window in (4, 9):
        seen = Counter()
        for _, t in rows:
            w = WORD.findall(t or "")
            seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
        want = []
        for i, t in rows:
            w = WORD.findall(t or "")
            gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
            want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
        for cells in (1 << 28, 1):  # a broadcast sketch, and one that is a table
            got = [tuple(r) for r in remove_repeats(frame(spark, rows), window=window, max_cells=cells).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
    assert remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_sketches_keep_their_rate_of_errors(spark):
    """The share of hashes of one occurrence that pass as repeated, at the size that cells_for gives."""
    h, parts = np.random.default_rng(4).integers(0, 1 << 63, 1 << 20).astype(np.uint64), spark.range(4)
    for cells, most in ((cells_for(len(h)), 0.06), (2 * len(h), 0.42)):
        sketch = TwiceSketch(count_hashes(parts, lambda batch: (h[int(i) :: 4] for i in batch.column(0).to_pylist()), cells, 2), cells)
        assert sketch.often(h).mean() < most
    assert cells_for(1e9) is None and cells_for(1e8) == 1 << 28 and cells_for(1e6) == 1 << 23


def test_frequencies_of_many_parts(spark, monkeypatch):
    """1000 parts of each segment, added up in one step and in two; frequent hashes stand out, and the cells grow with the corpus."""
    rng = np.random.default_rng(9)
    common, cells = rng.integers(0, 1 << 63, 3).astype(np.uint64), 1 << 15

    def parts(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                counter = DenseCounter(cells)
                for turn in range(2):
                    counter.add(np.concatenate([np.random.default_rng([k, turn]).integers(0, 1 << 63, 500).astype(np.uint64), common[: 1 + k % 3]]))
                yield counter.flush()

    table = Scratch(spark, "parts").write(spark.range(0, 1000, 1, 8).mapInArrow(parts, PART_SCHEMA))
    levels, load = [], 1000 * 1004 / cells
    rare = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for most in (1000, 60):
        monkeypatch.setattr(sketch, "PARTS", most)
        logs = LogSketch(table, cells, load)
        levels.append(logs.level(common))
        assert (others(logs.level(rare)) > 0).mean() < 0.05
    assert (levels[0] == levels[1]).all()
    for got, want in zip(others(levels[0]), (2000, 1332, 666), strict=True):
        assert abs(got - want) < 0.1 * want + 3 * math.sqrt(load)
    assert [log_cells_for(x) for x in (0, 1e8, 2e8, 1e9, 1e13)] == [1 << 20, 1 << 20, 1 << 21, 1 << 23, 1 << 24]


def test_prefixes_adapt_in_a_large_corpus():
    """At a load of a million other counts in each cell, documents of common shingles ask for several shared tokens, others for one."""
    texts = pa.array([" ".join(f"{c}{k}" for k in range(44)) for c in "ab"])
    sets = ngram_join._Sets(texts, 5)
    frequent = set(sets.flat[sets.row == 0].tolist())

    class Logs:
        def level(self, h):
            counts = np.where([x in frequent for x in h.tolist()], 1_030_000, 1_001_500).astype(np.uint64)
            bits = sketch._logs(pd.DataFrame({"segment": [0], "counts": [np.resize(counts, sketch.DENSE_SEGMENT).tobytes()]}), 1e6)["bits"][0]
            return np.frombuffer(bits, np.uint8)[: len(h)]

    taken, _, matches = sets.prefixes(Logs(), 75)
    assert matches.tolist() == [4, 1] and [int(taken[sets.row == r].sum()) for r in (0, 1)] == [14, 11]


def shingles(text, size=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def linked(rows, size=5):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    return [(i, len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 120))) for _ in range(12)]
    rows = []
    for k in range(220):
        w = base[k % 12 if k % 3 else 0].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((k + 1, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    return rows + [(None if i is None else i + 1000, t) for i, t in HARD]


@pytest.mark.parametrize("cells, hot", [(1 << 28, 1000), (1, 1000), (1 << 28, 3)])
def test_near_duplicates(spark, monkeypatch, cells, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = near_rows()
    got = [(r.id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), max_cells=cells).collect()]
    assert sorted(got, key=str) == sorted(linked(rows), key=str)
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_sets_that_share_a_name_stay_apart(spark):
    rows = near_rows()
    got = [(r.id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), name_bits=5).collect()]
    assert sorted(got, key=str) == sorted(linked(rows), key=str)
    by_key = defaultdict(set)
    for r in near_duplicates(frame(spark, rows[:40]), name_bits=3).collect():
        by_key[r.key].add(frozenset(shingles(dict(rows)[r.id])))
    assert all(len(v) == 1 for v in by_key.values())


def six_documents():
    """Documents 1 and 2 barely link; what they share lies in part with 3 and 4, in part with 5 and 6."""
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    p, q, r, s, z = words("p", 60), words("q", 60), words("r", 131), words("s", 131), words("z", 746)
    own = lambda name, n: words(f"own{name}", n)
    docs = [r + p + q + z + own("a", 3), s + p + q + z + own("b", 3)]
    docs += [words("wa", 62) + r + p + z + own(f"c{k}", 1) for k in (3, 4)] + [words("wb", 62) + s + q + z + own(f"d{k}", 1) for k in (5, 6)]
    return [(k + 1, " ".join(d)) for k, d in enumerate(docs)]


def bridged_rows(shingle, seed):
    """Clusters of near copies, some of whose members a chain of small changes leads to another cluster."""
    rng, rows = random.Random(seed), []
    for k in range(25):
        n = int(20 * 75 ** rng.random())
        now = [f"c{k}w{i}" for i in range(n)]
        # Changing x words of n in a row makes x + shingle - 1 shingles differ.
        most = max(1, (n - shingle + 1) // 7 - shingle + 1)
        for hop in range(rng.randint(2, 4)):
            for copy in range(rng.randint(1, 4)):
                w, at = list(now), rng.randrange(n)
                w[at : at + 1] = [f"c{k}h{hop}v{copy}"]
                rows.append(w)
            at = rng.randrange(max(1, n - most))
            now = [*now[:at], *(f"c{k}h{hop}n{j}" for j in range(min(most, n))), *now[at + min(most, n) :]]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_links_between_groups_are_found(spark):
    got = near_duplicates(frame(spark, six_documents()), shingle=1)
    assert {r.component_id for r in got.collect()} == {1}
    for shingle, seed in ((1, 3), (5, 4)):
        rows = bridged_rows(shingle, seed)
        got = [(r.id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), shingle=shingle).collect()]
        assert sorted(got) == sorted(linked(rows, shingle))


def border_rows():
    """Pairs of groups of near copies, with a link between their first members that barely holds."""
    rng, rows = random.Random(8), []
    for k in range(60):
        n = rng.randint(60, 140)
        first = [f"g{k}w{i}" for i in range(n)]
        least = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
        second = list(first)
        for i in rng.sample(range(n), n):
            tried = [*second[:i], f"g{k}x{i}", *second[i + 1 :]]
            if least(shingles(" ".join(first)), shingles(" ".join(tried))):
                second = tried
        for side, base in (("a", first), ("b", second)):
            rows.append(base)
            for c in range(rng.randint(2, 7)):
                w = list(base)
                at = rng.randrange(n - 3)
                w[at : at + 3] = [f"g{k}{side}{c}y{j}" for j in range(3)]
                rows.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_groups_with_one_link_between_them(spark):
    rows = border_rows()
    got = [(r.id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(linked(rows))


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {(i, t) for (i, t), (_, _, c) in zip(rows, linked(rows), strict=True) if i == c}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 30, axis=0) + 0.12 * rng.standard_normal((1200, 16))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(5000 + k, x[0].tolist(), 2) for k in range(50)] + [(5000, x[0].tolist(), 2)]
    odd = [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 16, 1), (6003, [float("nan")] * 16, 1), (6004, [float("inf")] + [1.0] * 15, 1), (6005, [None] + [1.0] * 15, 1), (None, x[0].tolist(), 1), (6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1), (6008, [1e-300] * 16, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int")
    got = {}
    for r in near_duplicate_vectors(table).collect():
        got.setdefault(r.id, (r.n_links, r.component_id, r.kept))
    m = np.array([v for _, v, _ in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i][0] for i, _, _ in rows])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    ids = np.array([i for i, _, _ in rows])
    exact = ids.copy()
    for _ in range(20):
        exact = np.where(u @ u.T >= 0.95, exact[None], 10**9).min(axis=1)
    assert np.mean([got[i][1] == c for i, c in zip(ids, exact, strict=True)]) > 0.9
    assert all(got[i] == (0, i, True) for i in (6000, 6001, 6002, 6003, 6004, 6005, 6008))
    assert got[None][0] == 0 and got[6006][0] == got[6007][0] == 1
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_deep_forests_find_what_brute_force_finds(spark):
    """Splits on samples of their own down to depth 8 and more, a dense group of several blocks, and the searches of ids divisible by 20."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((12_000, 32)))
    pairs = unit(base[:3000] + 0.04 * rng.standard_normal((3000, 32)))
    hot = unit(base[3500] + 0.02 * rng.standard_normal((1500, 32)))
    x = np.concatenate([base, pairs, hot])[rng.permutation(16_500)].astype(np.float32)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(4)
    got = {r.id: (r.n_links, r.component_id) for r in near_duplicate_vectors(table, sample=256, block=400).collect()}
    u = unit(x.astype(np.float64))
    ids, want, found, missed = range(0, len(x), 20), 0, 0, 0
    for k in range(0, len(x), 1000):
        links = u[k : k + 1000] @ u.T >= 0.95
        for i in range(k, min(k + 1000, len(x)), 20):
            near = np.flatnonzero(links[i - k])
            want, found = want + len(near) - 1, found + got[i][0]
            assert got[i][0] <= len(near) - 1
            missed += any(got[i][1] != got[j][1] for j in near.tolist())
    print("recall", found / want, "searches that miss a neighbour", missed / len(ids))
    assert want > 5000 and found >= 0.9 * want and missed <= 0.1 * len(ids)


@pytest.mark.parametrize("share", [0.3, 0.02])
@pytest.mark.parametrize("dim", [64, 256])
def test_groups_that_are_near_but_not_linked_have_few_copies(dim, share):
    """Vectors at cosine 0.93 to each other lie near any split of them: they are left whole, not copied to both sides at each level."""
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit(math.sqrt(0.93) * unit(rng.standard_normal((1, dim))) + math.sqrt(0.07) * unit(rng.standard_normal((20_000, dim))))
    n = int(20_000 * share)
    forest = Forest(rng.permutation(np.concatenate([unit(rng.standard_normal((20_000 - n, dim))), near[:n]])), 400_000)
    assert forest.depth == 11 and sum(len(rows) for rows, _ in forest.leaves(near)) < 60 * len(near)


def test_an_id_with_several_vectors_is_several_rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((2, 16))
    near = lambda x: (x + 0.02 * rng.standard_normal(16)).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (4, near(b)), (9, [1.0]), (9, [1.0]), (9, [2.0, 0.0])]
    got = sorted((r.id, r.n_links, r.component_id) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (9, 0, 9), (9, 1, 9), (9, 1, 9)]


def test_a_star_is_one_component(spark):
    from headway.llm.components import components
    from headway.storage import Scratch

    edges = spark.range(20_000).select((F.col("id") * 7 % 20_011 + 5).alias("a"), F.lit(3).cast("long").alias("b")).unionByName(spark.createDataFrame([(90_001, 90_000), (90_000, 90_002)], "a long, b long"))
    found = components(edges, Scratch(spark, "star"))
    assert {(r.component, r["count"]) for r in found.groupBy("component").count().collect()} == {(3, 20_001), (90_000, 3)}


def test_sets_with_a_number_in_common():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 9))) for _ in range(60)]
    a, b = rng.integers(0, 60, 3000), rng.integers(0, 60, 3000)
    want = [bool(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(a, b, strict=True)]
    # A number that only one set holds is in common for nobody but that set itself.
    for width in (64, 4096):
        got = _share_one(sets, a, b, width)
        assert [g for g, i, j in zip(got, a, b, strict=True) if i != j] == [w for w, i, j in zip(want, a, b, strict=True) if i != j]


@pytest.mark.parametrize("count", [12_000, 100_000, 300_000])
def test_a_large_group_of_noisy_copies_shares_leaves(count):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n = min(count, 20_000)
    x = unit(rng.standard_normal((n, 64)))
    x[::3] = unit(unit(rng.standard_normal((1, 64))) + 0.0175 * rng.standard_normal((len(x[::3]), 64)))
    a, b = x[::3][:2000], x[::3][2000:4000]
    linked = (a * b).sum(axis=1) >= 0.95
    shared = np.zeros(len(a), bool)
    for rows, leaves in Forest(x, count).leaves(np.concatenate([a, b])):
        homes = defaultdict(set)
        for row, leaf in zip(rows.tolist(), leaves.tolist(), strict=True):
            homes[row].add(leaf)
        shared |= [bool(homes[k] & homes[k + len(a)]) for k in range(len(a))]
    print(count, linked.sum(), "recall", shared[linked].mean())
    assert linked.sum() > 1000 and shared[linked].mean() >= 0.99


def test_digest_columns(spark, tmp_path):
    from headway.llm.registry import queries

    frame(spark, [(i, t) for i, t in HARD if i is not None][:6]).select("doc_id", "text").dropDuplicates().write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries()["op7_exact_dedup"](spark, str(tmp_path)).collect():
        text = norm({i: t for i, t in HARD}[r.doc_id])
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()

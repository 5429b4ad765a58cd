import random
import re
from collections import Counter, defaultdict

import hypothesis.strategies as st
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from pyspark.sql import functions as F

from motif_engine.llm import common as C
from motif_engine.llm import embedding_dedup as E
from motif_engine.llm import exact_dedup as X
from motif_engine.llm import simhash_dedup as S
from motif_engine.llm.common import connected_components

DOCS = "doc_id long, text string, digest string, row string, salt int, keep string"


def components(n, pairs):
    p = list(range(n))

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.fixture
def docs(spark):
    def build(*texts):
        return spark.createDataFrame([(i, t, "d", "r", i, None) for i, t in enumerate(texts)], DOCS)

    return build


TEXTS = ["a  b", "a b", None, "", "\t", " ", "a\nb", "b", "a b ", "x" * 5000, "x" * 5000, "\x85a b", "a\xa0b"]


def brute_groups(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return {i: (g[0], len(g), i == g[0]) for g in groups.values() for i in g}


@pytest.mark.parametrize("digest", [X.sha256, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), lambda t: F.when(t.isNotNull(), F.unhex(F.lit("00")))])
def test_exact_groups(docs, digest):
    """A short or constant digest collides; byte verification still tells texts apart."""
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.duplicate_groups(docs(*TEXTS), digest=digest).collect()}
    assert got == brute_groups(TEXTS)


def test_exact_keeps_rows_and_columns(spark, docs):
    d = docs(*TEXTS).unionByName(docs("a b")).unionByName(spark.createDataFrame([(None, "b", None, None, None, None), (None, "new", None, None, None, None)], DOCS))
    got = X.deduplicate(d)
    assert got.columns == d.columns
    ids = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x))
    assert ids == [*[i for i, v in brute_groups(TEXTS).items() if v[2]], None]
    assert X.deduplicate(d.limit(0)).count() == 0 and X.duplicate_groups(d.limit(0)).count() == 0


def test_a_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(X, "SALT_ROWS", 7)
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same  text")).otherwise(F.col("id").cast("string")).alias("text"))
    got = X.duplicate_groups(d)
    assert got.filter("group_size = 100").count() == 100 and got.filter("kept").count() == 201


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)]
    want = components(600, edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[i] == c for i, c in got.items()) and {x for e in edges if e[0] != e[1] for x in e} <= set(got)
    split = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hub=5).collect()}
    assert split == got and connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_one_table_and_more_take_rounds(spark, monkeypatch):
    """The driver's memory follows the plans and jobs; both ways give what a plain union gives, also on paths and hubs."""
    rng, written = random.Random(8), []
    names = list(range(700))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], names[k]) for k in range(301, 400)]
    edges += [(names[rng.randrange(400, 700)], names[rng.randrange(400, 700)]) for _ in range(150)] + [(5, 5)]
    low = components(700, edges)
    want = {x: low[x] - 300 for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([(a - 300, b - 300) for a, b in edges] + [(None, 1), (2, None)], "a long, b long")
    write = C.table
    monkeypatch.setattr(C, "table", lambda df, name, **o: written.append(name) or write(df, name, **o))
    assert {r.id + 300: r.component for r in connected_components(df).collect()} == want and written == ["edges"]
    monkeypatch.setattr(C, "UNITED", 0)
    for hub in (C.HUB, 5):
        assert {r.id + 300: r.component for r in connected_components(df, hub).collect()} == want
    assert "stars" in written and "least" in written
    assert connected_components(df.limit(0)).count() == 0


def brute_fingerprint(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB é\t\n\x0b\xa0Σ", max_size=60), st.sampled_from([4, 5]))
def test_fingerprints(text, k):
    assert S.fingerprint(text.encode(), k) == brute_fingerprint(text, k)


def test_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    monkeypatch.setattr(S, "_AT_ONCE", 13)
    assert S.fingerprint(text.encode()) == brute_fingerprint(text, 4)


def close_fingerprints(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n // 4):
        base = rng.getrandbits(64)
        out.append(base)
        for _ in range(3):
            x = base
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 8])):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("distance, blocks, shard, levels", [(4, 3, 8192, 7), (4, 3, 8192, 1), (4, 3, 8, 2), (4, 3, 2, 1), (9, 5, 8192, 3), (4, 5, 30, 3)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, distance, blocks, shard, levels):
    """With the production setting (radii 1, 1, 0) and others, trees of any depth, deeper trees and tiles."""
    monkeypatch.setattr(S, "LEVELS", levels)
    monkeypatch.setattr(S, "_HELD", 1 / 8**levels)
    fps = close_fingerprints(120 if levels < 7 else 400)
    f = np.array(fps, np.uint64)
    want = components(len(fps), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= distance), strict=True))
    df = spark.createDataFrame([(x,) for x in f.view(np.int64).tolist()], "fp long")
    rows = S.links(df, distance, blocks, shard).collect()
    at = {x: i for i, x in enumerate(f.view(np.int64).tolist())}
    assert all(bin(fps[at[r.a]] ^ fps[at[r.b]]).count("1") for r in rows)
    assert components(len(fps), [(at[r.a], at[r.b]) for r in rows]) == want


def test_production_trees_query_over_boundaries_and_prune():
    """Pairs within 4 bits share a shard that one of them is stored in; the triangle bound closes most others."""
    trees = S.forest(10**6, list(range(64)), 4, S.BLOCKS, 0)
    assert [t.radius for t in trees] == [1, 1, 0] and [len(t.bits) for t in trees] == [22, 22, 20] and len(trees[0].vantage) == 5
    rng = random.Random(5)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 5))) for x in a], np.uint64)
    met = np.zeros(len(a), int)
    for t in trees:
        ha, hb = t.home(a), t.home(b)
        at_home = ha == hb
        over = np.zeros(len(a), bool)
        for x, y, home in ((a, ha, hb), (b, hb, ha)):
            row, path = t.queried(x)
            over[row[path == home[row]]] = True
            # what is queried keeps the triangle bound on every level, and rings beyond it aren't queried
            digits = np.stack([path // 23 ** k % 23 for k in range(len(t.vantage))][::-1], axis=1) if len(t.bits) == 22 else np.zeros((0, len(t.vantage)))
            assert (np.abs(digits - t.distances(x)[row][: len(digits)]) <= t.radius).all()
            if t.radius:
                assert len(row) / len(x) < 12 and len(np.unique(path)) > 1000
        met += at_home | over
        assert t.radius == 0 or over.sum() > 300
    assert (met > 0).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 12), st.integers(1, 8))
def test_radii_leave_no_pair_out(distance, blocks):
    r = S.radii(distance, blocks)
    assert sum(x + 1 for x in r) == distance + 1 and all(x >= 0 for x in r) and len(r) <= blocks
    cut = S._blocks(list(range(64)), r) if 2 * sum(r) < 60 else None
    assert cut is None or sorted(sum(cut, [])) == list(range(64))


def test_both_ways_of_comparing_agree():
    rng = np.random.default_rng(0)
    fps = np.array(close_fingerprints(160), np.uint64)
    rng.shuffle(fps)
    group = np.repeat([0, 1], [70, len(fps) - 70])
    visitor = np.concatenate([np.arange(70) >= 30, np.arange(len(fps) - 70) >= 50])
    small = S._linked_small(fps, group, visitor, 4)
    large = np.concatenate([S._linked_large(fps[:70], 30, 4), 70 + S._linked_large(fps[70:], 50, 4)])
    assert small.tolist() == large.tolist()
    home = ~visitor
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (home[:, None] | home[None]) & (group[:, None] == group[None])
    assert small.tolist() == components(len(fps), zip(*np.nonzero(near), strict=True))


def test_simhash_components_and_rows(docs):
    base = " ".join(f"w{i}" for i in range(300))
    d = docs(base, base.upper(), base.replace("w150", "x"), None, "", "one", "two words", "one")
    got = {r.doc_id: r.component_id for r in S.components(d).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 5}
    kept = S.deduplicate(d.unionByName(docs("two words")))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 0, 3, 5] and kept.columns == d.columns
    assert S.deduplicate(d.limit(0)).count() == 0 and S.components(d.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [8192, 3])
def test_near_copies_and_clean_texts(spark, monkeypatch, shard):
    """Texts sharing 0.85 of their shingles or more are found, others stay; also with tiles."""
    monkeypatch.setattr(S, "SHARD", shard)
    rng = random.Random(4)
    texts, group = [], []
    for g in range(120):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.choice([150, 400]))]
        for k in range(3 if g % 2 else 1):
            w = list(words)
            for at in rng.sample(range(len(w)), k * len(w) // 150):
                w[at] = "changed"
            texts.append(" ".join(w))
            group.append(g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r.doc_id for r in S.deduplicate(df).collect()]
    assert {group[i] for i in kept} == set(range(120)) and len(kept) <= 124


def shared(rng, similarity, n=120):
    """Two texts with this Jaccard similarity of five-word shingles, or the next one that changes at the end allow."""
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    cut = round((n - 4) * (1 - similarity) / (1 + similarity))
    return " ".join(words), " ".join(words[: n - cut] + [f"z{rng.randrange(10**6)}" for _ in range(cut)])


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 7, "LONG": 8, "OFTEN": 4, "PIVOTS": 3, "SALT_PAIRS": 5, "HUB": 10}])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, sizes):
    """Every pair at 0.8 or more is found, also just there; none below is, down to 0.6; with a hub of similar texts,
    also where long lists get pivots and tiles, and hot values, lists and texts ways of their own."""
    for name, n in sizes.items():
        monkeypatch.setattr(S, name, n)
    rng, texts, bands = random.Random(9), [], Counter()
    for k in range(400):
        a, b = shared(rng, 0.6 + 0.3 * k / 400)
        texts += [a, b]
        bands[int(jaccard(a, b) * 20)] += 1
    assert all(bands[k] > 30 for k in range(12, 18))
    hub = [f"h{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(60):
        at = rng.randrange(150 - 20)
        texts.append(" ".join(hub[:at] + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 20))] + hub[at + 20 :]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in S.deduplicate(df).collect())
    assert kept == sorted(set(components(len(texts), pairs)))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.data())
def test_similar_sets_share_a_prefix_value_and_parities_bound_their_difference(a, data):
    b = (a - set(data.draw(st.lists(st.sampled_from(sorted(a)), max_size=4)))) | data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=4))
    x, y = (np.array(sorted(v), np.uint64) for v in (a, b))
    frequent = np.array(sorted(a)[::3], np.uint64)
    if S.similar(x, y):
        assert set(S.prefix(x, frequent, np.arange(len(frequent))).tolist()) & set(S.prefix(y, frequent, np.arange(len(frequent))).tolist())
    assert S.similar(x, y) == (5 * len(a & b) >= 4 * len(a | b))
    assert sum((p ^ q) % 2**64 >> k & 1 for p, q in zip(S.parities(x), S.parities(y), strict=True) for k in range(64)) <= len(a ^ b)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=700), st.data())
def test_wide_parities_rule_out_no_similar_pair(a, data):
    """Also across sizes that have other numbers of classes."""
    b = (a - set(sorted(a)[: data.draw(st.integers(0, 1 + len(a) // 7))])) | data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=1 + len(a) // 7))
    x, y = (np.array(sorted(v), np.uint64) for v in (a, b))
    if S.similar(x, y):
        assert S.may_be_similar(S.wide(x), S.wide(y)) and S.may_be_similar(S.wide(y), S.wide(x))


def test_near_dedup_takes_links_of_fingerprints_first(spark, monkeypatch):
    """Its first pairs are those of the search in vantage-point trees; what these connect is what brute force connects."""
    rng, asked = random.Random(3), []
    texts = [x for k in range(60) for x in shared(rng, 0.9 + 0.1 * k / 60, 300)]
    fps = [S.fingerprint(t.encode(), 5) for t in texts]
    df = spark.createDataFrame([(k, int(np.uint64(f).astype(np.int64))) for k, f in enumerate(fps)], "id long, fp long")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert len(near) > 10
    assert components(len(fps), [(r.a, r.b) for r in S.nominated(df).collect()]) == components(len(fps), near)
    search = S.links
    monkeypatch.setattr(S, "links", lambda *a, **k: asked.append(1) or search(*a, **k))
    S.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert asked


def test_hot_ids_of_both_columns_are_counted_once(spark, monkeypatch):
    """Pairs get both texts, whichever column has ids with many pairs; one table names these, before a text is joined."""
    monkeypatch.setattr(S, "SALT_PAIRS", 4)
    written, write = [], S.table
    monkeypatch.setattr(S, "table", lambda df, name, **o: written.append(name) or write(df, name, **o))
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "id long, t string")
    for pairs in ([(0, k) for k in range(1, 30)] + [(k, 50) for k in range(10, 40)], [(2 * k, 2 * k + 1) for k in range(9)]):
        written.clear()
        got = S._with_texts(spark.createDataFrame(pairs, "a long, b long"), texts, b="y", a="x").select("a", "b", "x", "y")
        assert sorted(map(tuple, got.collect())) == sorted((a, b, f"t{a}", f"t{b}") for a, b in pairs) and written == ["many"]


def test_near_dedup_also_unites_in_rounds(spark, monkeypatch):
    """Over UNITED links, its components take the distributed rounds; the rows kept are the same."""
    rng = random.Random(12)
    texts = [x for k in range(40) for x in shared(rng, 0.7 + 0.3 * k / 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in S.deduplicate(df).collect())
    monkeypatch.setattr(C, "UNITED", 0)
    assert 40 < len(kept) < 80 and sorted(r.doc_id for r in S.deduplicate(df).collect()) == kept


def test_texts_move_only_for_pairs_that_can_be_similar(spark, monkeypatch):
    """Long texts that share a passage are many pairs, ruled out before their texts are read."""
    monkeypatch.setattr(S, "FREQUENT", 0)
    rng, moved = random.Random(6), []
    passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join([f"u{rng.randrange(10**6)}" for _ in range(1500)] + passage) for _ in range(30)]
    confirm = S._confirmed
    monkeypatch.setattr(S, "_confirmed", lambda pairs, *rest: moved.append(pairs.count()) or confirm(pairs, *rest))
    assert S.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 30
    assert len(moved) > 1 and sum(moved) == 0


def vectors(n=300, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dims))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.12, base[: n // 6] * 3.0])
    return x.astype(np.float32)


def brute_links(x, cosine=0.9):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    return near.sum(axis=1).tolist(), components(len(x), zip(*np.nonzero(near), strict=True))


@pytest.mark.parametrize("cell, tile, clustered", [(4096, 2048, False), (20, 7, False), (40, 1, True)])
def test_embeddings_agree_with_brute_force(spark, monkeypatch, cell, tile, clustered):
    monkeypatch.setattr(E, "CELL", cell)
    monkeypatch.setattr(E, "TILE", tile)
    x = vectors()
    if clustered:  # few directions, so that ranges and rings close most of the visits
        x = (x * 0.05 + np.eye(16, dtype=np.float32)[np.arange(len(x)) % 5]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(E.near_duplicates(df).collect(), key=lambda r: r.vec_id)
    n, c = brute_links(x)
    assert [r.n_links for r in got] == n and [r.component_id for r in got] == c and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    linked = {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)}
    assert got == {i: linked.get(i, (0, i, i is not None)) for i, _ in rows}
    assert E.near_duplicates(df.limit(0)).count() == 0
    assert E.near_duplicates(df.filter("vec_id = 3")).count() == 1


def test_rows_of_one_identifier_and_doubles(spark):
    """Counts and components are each row's own; components beyond single precision count."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 0.2]), (3, [1e300, 1e299]), (4, [1e-320, 0.0]), (5, [-1.0, 1e-9]), (5, [-1.0, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x")).withColumn("v", F.lit(1))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == [(1, 0, 1, True), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False), (5, 1, 5, True), (5, 1, 5, True)]


def test_ranges_and_rings_close_visits_of_clustered_vectors():
    """Vectors about few directions leave most cells and rings closed; random directions leave nearly all open."""
    rng = np.random.default_rng(0)
    centres = E._unit(rng.normal(size=(12, 32)))
    x = E._unit(centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 32)) * 0.02)
    cells = E._Cells(centres, np.sqrt(0.2))
    dot = x @ centres.T
    home, far = dot.argmax(axis=1), np.sqrt(2 - 2 * dot.max(axis=1))
    d = np.sqrt(np.maximum(0, 2 - 2 * dot))
    for c in range(12):
        cells.low[c], cells.high[c], cells.top[c] = d[home == c].min(axis=0), d[home == c].max(axis=0), far[home == c].max()
    cells.rings, cells.first = np.zeros(12), np.arange(13)
    row, cell, low, n = cells.visits(x, home, np.zeros(2000, np.int64), far)
    assert n.sum() < 0.05 * 2000 * 11


def test_fewer_copies_than_a_near_group_needs(spark):
    x = vectors(60)
    pivots = E.farthest_first(E._unit(x), 5)
    assert len(pivots) == 5 and len(E.farthest_first(E._unit(x[:2]), 5)) == 2

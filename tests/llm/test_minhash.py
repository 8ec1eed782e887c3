import random

import numpy as np

from tallywire.llm import forest, minhash
from tallywire.llm.graph import components
from tallywire.llm.minhash import near_duplicates
from tallywire.llm.shingles import PART, shingle_sets
from tests.llm import helpers

SCHEMA = "doc_id long, text string, component_id string"
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def _group(size, changes):
    base = [rng.choice(WORDS) for _ in range(120)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        out.append(" ".join(copy))
    return out


def test_against_all_pairs(spark):
    """Exact copies, loose near copies, a large group, and unlike texts."""
    texts = _group(60, 9) + _group(12, 6) + _group(1, 1) * 20 + [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(60)]
    texts += ["a b", "A\tb", "a", "", None, None, "  \n", "word " * 3000]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    sets = {i: helpers.shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = helpers.components(sets, links)
    got = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), words=4).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_far_apart_in_a_family(spark):
    """One form filled in 1500 times, just under the threshold; the links in it stand anywhere among the others."""
    form = [rng.choice(WORDS) + str(i) for i in range(150)]
    fields = [15, 45, 75, 105, 135]

    def filled(i, first):
        out = list(form)
        for f in fields:
            out[f] = f"fill{i}x{f}"
        out[fields[0]] = first
        return " ".join(out)

    n, twins = 1500, 40
    texts = {i: filled(i, f"name{i}") for i in range(n)} | {n + i: filled(n + i, f"name{i * 30}") for i in range(twins)}
    a, b, c = (helpers.shingles(texts[i], 4) for i in (0, 1, n))
    assert 100 * len(a & b) < 80 * len(a | b) and 100 * len(a & c) >= 80 * len(a | c)
    got = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA), words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i if i < n else (i - n) * 30 for i in texts}


def test_odd_tables(spark):
    one = "one two three four five six"
    got = near_duplicates(spark.createDataFrame([(1, one, None), (1, one, None), (2, one, None), (None, one, None), (None, None, None)], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shingles_of_long_texts():
    text = ("Ab cdé ef " * (PART // 8)).encode()
    assert len(text) > PART
    short, long = shingle_sets([b"ab cd\xc3\xa9 ef ab cd\xc3\xa9 ef ab", text], 4)
    assert set(long.tolist()) == set(short.tolist()[:3]) and len(long) == 3


def test_components(spark):
    n = 300
    chain = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    want = helpers.components({x for e in chain for x in e}, chain)
    assert got == {k: v for k, v in want.items() if k != 5000}


def test_components_of_many_blocks(spark, monkeypatch):
    """Blocks of three edges over many tasks: chains, stars and ids that are texts."""
    from tallywire.llm import graph

    monkeypatch.setattr(graph, "BLOCK_EDGES", 3)
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(i, 300) for i in range(200, 240)] + [tuple(rng.sample(range(400, 460), 2)) for _ in range(50)]
    rng.shuffle(edges)
    want = helpers.components({x for e in edges for x in e}, edges)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(want.items())
    got = components(spark.createDataFrame([tuple(f"n{x:03d}" for x in e) for e in edges], "u string, v string").repartition(7)).collect()
    assert sorted((int(r.node[1:]), int(r.component[1:])) for r in got) == sorted(want.items())
    assert components(spark.createDataFrame(edges, "u long, v long").limit(0)).collect() == []


def _sorted_tree(rows):
    """(tree, labels as bytes) of rows of labels, in sorted order."""
    raw = sorted(b"".join(x.to_bytes(w, "big") for x, w in zip(r, minhash.LABELS, strict=True)) for r in rows)
    return np.zeros(len(raw), dtype=np.int32), np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), minhash.TREE_BYTES)


def test_regions_are_deeper_where_it_is_crowded():
    rest = [9] * (minhash.DEPTH - 3)
    sparse = [[1, 1, x, *rest] for x in range(3)]
    crowded = [[2, 2, x // 5, x % 5, *rest[1:]] for x in range(40)]  # eight runs of five at the third label
    one_group = [[3, 3, x, *rest] for x in range(40)]
    rows = [[0, 0, 0, *rest], *sparse, *crowded, *one_group, [4, 4, 4, *rest]]
    tree, labels = _sorted_tree(rows)
    group = np.array([0, *range(1, 44), *[99] * 40, 100])
    shared = forest.shared_labels(tree, labels, minhash.LABELS)
    depth, end = forest.regions(shared, group, 10, minhash.SHALLOWEST, minhash.DEPTH)
    assert depth.tolist() == [0, *[2] * 3, *[3] * 40, *[2] * 40, 0]
    assert end[1:4].tolist() == [4] * 3 and end[4:9].tolist() == [9] * 5 and end[50] == 51
    # a wider region needs no deeper prefix
    assert forest.regions(shared, group, 40, minhash.SHALLOWEST, minhash.DEPTH)[0].tolist() == [0, *[2] * 83, 0]


def test_candidates_follow_the_depth(spark):
    """In one tree: all pairs of a sparse region, none across the deeper regions of a crowded one but neighbours."""
    rest = [9] * (minhash.DEPTH - 3)
    rows = [[1, 1, x, *rest] for x in range(4)] + [[2, 2, x // 4, x % 4, *rest[1:]] for x in range(40)]
    tree, labels = _sorted_tree([[0, 0, 0, *rest], *rows, [3, 3, 3, *rest]])
    frame = spark.createDataFrame([(0, bytes(x), i, 100, i) for i, x in enumerate(labels)], "tree int, labels binary, id long, n long, component long").coalesce(1)

    def pairs(most):
        found = forest.looked_up(frame, minhash.LABELS, minhash.SHALLOWEST, most, 80)
        return {(r.u, r.v) for r in forest.candidate_pairs(found).collect()}, {r.u for r in found.filter("depth is not null").collect()}

    many, none = pairs(64)
    few, lacking = pairs(10)
    assert {(a, b) for a in range(1, 5) for b in range(a + 1, 5)} <= few < many
    inside = {(a, b) for a in range(5, 45) for b in range(a + 1, 45) if (a - 5) // 4 == (b - 5) // 4}
    assert few - {(a, b) for a, b in few if b < 5} == inside | {(a, a + 1) for a in range(5, 44)}
    assert set(range(5, 45)) <= lacking and not none & set(range(1, 45))


def test_recall_in_loose_groups(spark):
    """Large groups whose members are mostly just under the threshold: links found against all pairs."""
    texts = [t for size, changes in ((150, 30), (150, 14), (100, 20), (40, 11)) for t in _group(size, changes)]
    sets = {i: helpers.shingles(t, 5) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert links and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    whole = helpers.components(sets, links)
    assert sum(got[i] == whole[i] for i in got) >= 0.99 * len(got) and all(whole[got[i]] == whole[i] for i in got)

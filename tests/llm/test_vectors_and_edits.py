"""Edit fingerprints, centroids and whitening, and joins of vectors of several widths, against brute-force versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from emberframe.llm import centroids, edit_fingerprints as ef, embeddings, linking, whitening
from pyspark.sql import functions as F

rng = random.Random(11)
VECTORS = "vec_id long, embedding array<float>, label int"


def prose(n):
    return " ".join("".join(rng.choice("abcdefgh éß😀") for _ in range(rng.randint(1, 8))) for _ in range(n))


# ------------------------------------------------------------------ edit fingerprints

LONG = prose(20_000)
TEXTS = [
    prose(300), prose(280), "", None, "a", "ab", prose(40), prose(40), "ß" * 5, prose(900), LONG, LONG[:50_000] + LONG[50_003:],
    "x" * 3000, prose(120), prose(120)
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3, t, k, "w") for k, t in enumerate(TEXTS)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, part int, packed string").repartition(3)


def shown(text, step_count=None):
    """What the walk shows at every step, one step after the other, and how long it stays in the text."""
    out, at, j = [], 0, 0
    codes = [ord(c) for c in text]
    while at < len(codes):
        out.append(codes[at])
        kind = int(ef._mixed(np.array([codes[at]]))[0] >> np.uint64(56))
        at += ef._WAIT[kind][j % ef.PERIOD] == 1  # a wait of one: the walk moves on at this step
        j += 1
    return out


def walked(text):
    codes = ef.code_points((text or "").encode())
    return ef.fingerprint(codes, ef.walk(codes))


@pytest.mark.parametrize("text", [t for t in TEXTS if t and len(t) < 9000])
def test_fingerprints_sample_the_walk(text):
    steps, got = shown(text), walked(text)
    assert len(got) % ef.SAMPLES == 0 and len(steps) <= ef._STEP[len(got) - 1] + 2 ** (len(got) // ef.SAMPLES)
    for j, symbol in zip(ef._STEP, got):
        if j >= len(steps):
            assert symbol == ef.END
        else:
            assert symbol == ef.SYMBOLS[int(ef._mixed(np.array([steps[j]]))[0] >> np.uint64(48)) & 63]
    # all steps of the text are covered: the next doubling begins after its end
    assert len(steps) <= ef.SAMPLES * 2 ** (len(got) // ef.SAMPLES - 1)


def test_waits_are_those_of_the_bits():
    for kind in range(0, 256, 17):
        wait = ef._WAIT[kind]
        assert all(wait[j] == 1 or wait[j] == wait[(j + 1) % ef.PERIOD] + 1 for j in range(ef.PERIOD))
        assert 0.45 < sum(w == 1 for w in wait) / ef.PERIOD < 0.55


def brute_likeness(a, b):
    n = max(len(a), len(b))
    a, b, same, all_ = a.ljust(n, "."), b.ljust(n, "."), 0.0, 0.0
    for k in range(n):
        w = 2.0 ** max(0, k // ef.SAMPLES - 1)
        if a[k] != "." or b[k] != ".":
            all_ += w
            same += w * (a[k] == b[k])
    return same / all_ if all_ else 1.0


def brute_edits(rows):
    """rows: (id, text) in the order of the documents."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), walked(text), walked(edited),
            round(brute_likeness(walked(text), walked(edited)), 9), round(brute_likeness(walked(text), walked(after)), 9)
        ))
    return Counter(out)


def told(df):
    return Counter(
        (r[0], r[1], r[2], r[3], r[4], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()
    )


def test_edits_of_all_documents(spark, docs):
    got = ef.compare_edits(docs)
    assert told(got) == brute_edits(list(zip(range(0, 3 * len(TEXTS), 3), TEXTS)))
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in got.collect()}
    assert near[30][1] > 0.9  # three characters cut out of a hundred thousand
    assert near[0][0] > 0.5 > 0.35 > near[0][1] and near[6] == (1.0, 1.0)  # an empty text before an empty one
    assert told(ef.compare_edits(docs.limit(0))) == Counter()
    one = spark.createDataFrame([(5, "alone here")], "doc_id long, text string")
    assert told(ef.compare_edits(one)) == brute_edits([(5, "alone here")])


def test_edits_of_repeated_and_missing_ids(spark):
    rows = [(1, "one text"), (2, "two texts"), (2, "two texts"), (2, "another two"), (None, "no id"), (None, None), (7, "seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = dict(
        (r["text"], r["h"]) for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()
    )
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    for parts in (1, 2, 5):
        assert told(ef.compare_edits(df.repartition(parts))) == brute_edits(order)
    many = spark.createDataFrame([(None, "same")] * 300 + [(1, "x")], "doc_id long, text string")
    assert told(ef.compare_edits(many)) == brute_edits([(1, "x")] + [(None, "same")] * 300)


def test_likeness_follows_edits():
    text = prose(400)
    levels = []
    for edits in (0, 2, 20, 200):
        w = list(text)
        for _ in range(edits):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        levels.append(ef.likeness(walked(text), walked("".join(w))))
    assert levels[0] == 1 and levels[0] >= levels[1] > levels[2] > levels[3]
    assert ef.likeness(walked(text), walked(prose(400))) < 0.35  # of 14 characters
    assert ef.likeness("", "") == 1 and ef.likeness("", walked("a")) == 0


def test_near_texts_against_all_pairs(spark):
    base = [prose(rng.randint(60, 200)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:20]):
        for copy in range(1 + 10 * (k == 0)):
            at = rng.randrange(len(t) // 2, len(t))
            rows.append((100 + 20 * k + copy, t[:at] + rng.choice("xyz") + t[at + rng.randint(0, 2) :]))
    rows += [(900, base[3]), (901, base[3]), (902, ""), (903, None), (904, "   "), (905, "a"), (906, "a"), (None, base[4])]
    rows += [(907, base[5]), (907, base[6])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rep int, key int").repartition(4)
    got = ef.near_texts(df)
    assert got.columns == ["doc_id", "component_id", "kept"] and got.count() == len(rows)
    prints = [(i, walked(t)) for i, t in rows]
    top = list(range(len(rows)))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    wanted = 0
    for a in range(len(rows)):
        for b in range(a):
            if None not in (prints[a][0], prints[b][0]) and prints[a][1] and prints[b][1]:
                if brute_likeness(prints[a][1], prints[b][1]) >= 0.8:
                    wanted += prints[a][1] != prints[b][1]
                    top[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i if i is not None else math.inf)
    want = Counter((i, least[find(k)] if i is not None else None) for k, (i, _) in enumerate(prints))
    have = Counter((r["doc_id"], r["component_id"]) for r in got.collect())
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got.collect())
    missed = (want - have).total()
    assert wanted >= 25 and missed <= 1, (wanted, missed)  # a band is missed with a probability of about 0.01 at 0.8
    reach = {(i, c) for i, c in want}
    assert all((i, c) in reach or c == i or any(i == j and c >= d for j, d in reach) for i, c in have)  # no link is made up
    both = ef.compare_edits(df, 0.8)
    assert Counter((r["doc_id"], r["component_id"]) for r in both.collect()) == have
    assert ef.near_texts(df.limit(0)).count() == 0


def test_walks_at_once_are_walks():
    texts = [ef.code_points((t or "").encode()) for t in TEXTS * 4 + [prose(k) for k in range(200)]]
    starts = [rng.randrange(100_000) for _ in texts]
    assert [w.tolist() for w in ef.walks(texts)] == [ef.walk(t) for t in texts]
    assert [w.tolist() for w in ef.walks(texts, starts)] == [ef.walk(t, s) for t, s in zip(texts, starts)]
    assert ef.walks([]) == []


def test_bands_show_samples_inside_their_texts():
    text = prose(150)
    prints = [walked(t) for t in ("", text, text[:-40] + "zz" + text[-39:], prose(150), text + text[: len(text) // 4], "a", "b")]
    at, keys = ef.band_keys(prints)
    have = [set(keys[at == k].tolist()) for k in range(len(prints))]
    assert not have[0] and have[1] & have[4] and len(have[1] & have[3]) < ef.BANDS // 3  # of 14 characters
    level = len(prints[1]) // ef.SAMPLES - 1
    assert len(prints[2]) == len(prints[1])

    def first(print_, samples):
        return [(k, print_[k]) for k in samples if print_[k] != ef.END][: ef.STEPS]

    equal = sum(first(prints[1], samples) == first(prints[2], samples) for samples in ef._BANDS[level])
    assert 0 < equal <= len(have[1] & have[2])


def test_query_tells_near_texts(spark, tmp_path):
    """The registered query runs the bands and links of near texts, for every document."""
    from emberframe.llm.queries import QUERIES

    base = [prose(150) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10 + k, t[:-30] + "!" + t[-29:]) for k, t in enumerate(base[:4])]
    rows += [(20, base[5]), (21, ""), (22, None), (23, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in QUERIES["op11_edit_fingerprints"](spark, str(tmp_path)).collect()}
    of = {10 + k: k for k in range(4)} | {20: 5}
    assert got == {k: (of.get(k, k), k not in of) for k, _ in rows}


# ------------------------------------------------------------------ vectors


def vectors(n=700, width=64, seed=3):
    g = np.random.default_rng(seed)
    around = g.normal(size=(6, width))
    x = (around[g.integers(0, 6, n)] + 0.3 * g.normal(size=(n, width))).astype(np.float32)
    x[50:150] = x[0]  # a hot vector
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)]
    bad = [None, [], [1.0] * (width - 1), [math.nan] + [0.0] * (width - 1), [math.inf] + [0.0] * (width - 1)]
    rows += [(1000 + k, v, 0) for k, v in enumerate(bad)]
    rows += [(1010, [None] + [0.5] * (width - 1), 0), (5, x[9].tolist(), 1), (5, x[10].tolist(), 1), (6, x[6].tolist(), 2)]
    rows += [(None, x[11].tolist(), 1), (None, x[12].tolist(), 1), (2000, [0.0] * width, None)]
    return rows


def good(rows, width):
    return [
        (i, v) for i, v, _ in rows
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)
    ]


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in good(rows, 64)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted((name(i), x) for i, x in kept)[:k]]
    x = np.array([v for _, v in kept], dtype=np.int64)

    def nearest():
        d = np.stack([((x - np.array(c)) ** 2).sum(1) for c in centres], axis=1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        to, _ = nearest()
        for c in range(len(centres)):
            if (to == c).any():
                centres[c] = [int(s) // int((to == c).sum()) for s in x[to == c].sum(0)]
    to, d = nearest()
    sha = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centres]
    own = [int(d[to == c].sum()) for c in range(len(centres))]
    return Counter((i, int(c), int(q), own[c], int(d.sum()), sha[c]) for (i, _), c, q in zip(kept, to, d))


@pytest.mark.parametrize("tree,leaf", [(4096, 32), (64, 4), (1, 1)])
def test_clusters(spark, tree, leaf):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("x")).repartition(3)
    got = Counter(tuple(r) for r in centroids.cluster_vectors(df, k=40, rounds=3, tree=tree, leaf=leaf).collect())
    assert got == brute_clusters(rows, 40, 3)


def test_clusters_of_few_vectors(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    assert centroids.cluster_vectors(df.limit(0)).count() == 0
    assert centroids.cluster_vectors(df.filter("vec_id between 1000 and 1010")).count() == 0
    few = [(k, [0.5 * k] * 64, 0) for k in (3, 1, 1, 2)]
    got = Counter(tuple(r) for r in centroids.cluster_vectors(spark.createDataFrame(few, VECTORS)).collect())
    assert got == brute_clusters(few, 40, 5)
    with pytest.raises(Exception, match="do not fit in a long"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, 0)], VECTORS)).count()


def test_balls_go_whole_where_one_centroid_is_left():
    g = np.random.default_rng(0)
    x = np.concatenate([g.integers(0, 50, (500, 8)), g.integers(10_000, 10_050, (500, 8))])
    tree, order = centroids.grow_tree(x, 16)
    assert sorted(order.tolist()) == list(range(1000)) and (x[order] == tree.points).all()
    for k in range(len(tree.first)):
        part = tree.points[tree.first[k] : tree.last[k]]
        assert (part.sum(0) == tree.sums[k]).all()
        assert np.sqrt(((part - tree.centres[k]) ** 2).sum(1).max()) <= tree.radius[k] + 1e-9
    centres = np.array([[25] * 8, [10_025] * 8, [25] * 8], dtype=np.int64)
    found = list(centroids.assigned(tree, centres))
    assert all(isinstance(to, int) for *_, to in found) and {to for *_, to in found} == {0, 1} and len(found) == 2
    # a large component is compared in 64 bits
    far = np.array([[2**27] * 8, [-(2**27)] * 8], dtype=np.int64)
    assert centroids.squared(far, far).tolist() == [[0, 8 * 2**56], [8 * 2**56, 0]]


def brute_whitening(rows, width):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good(rows, width)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in fit])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    return kept, n, s, e[::-1], q[:, ::-1], np.trace(v)


@pytest.mark.parametrize("width,spread", [(64, 1.0), (40, 1.0), (5, 1.0), (120, 30.0)])
def test_whitening(spark, width, spread):
    rows = vectors(400, width)
    if spread > 1:  # a falling spectrum: the random basis settles without all dimensions
        f = [spread ** (1.5 - j) if j < 16 else 1e-1 for j in range(width)]
        rows = [(i, v and [c if c is None else c * w * 2.0**24 for c, w in zip(v, f)], k) for i, v, k in rows]
    df = spark.createDataFrame(rows, VECTORS).withColumn("component", F.lit("x")).repartition(3)
    got = whitening.whiten_vectors(df).collect()
    kept, n, s, e, q, trace = brute_whitening([(i, np.float32(v).tolist() if v and None not in v else v, k) for i, v, k in rows], width)
    k = min(16, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(kept) and {r["n"] for r in got} == {n}
    per = defaultdict(list)
    for r in got:
        per[r["component"]].append(r)
    assert sorted(per) == list(range(1, k + 1))
    exact = [(i, sum((n * c - t) ** 2 for c, t in zip(x, s))) for i, x in kept]
    deviation = Counter((i, d if d < 2**63 else None) for i, d in exact)
    for c, part in per.items():
        have = Counter((r["vec_id"], r["deviation"]) for r in part)
        assert have == deviation
        want = sorted(
            (str(i), sum((n * a - t) / n * b for a, t, b in zip(x, s, q[:, c - 1])) / math.sqrt(e[c - 1])) for i, x in kept
        )
        mine = sorted((str(r["vec_id"]), r["whitened"]) for r in part)
        by = lambda v: {key: [w for i, w in v if i == key] for key, _ in v}
        a, b = by(want), by(mine)
        one = [(x, y) for key in a for x, y in zip(sorted(a[key]), sorted(b[key]))]
        two = [(x, -y) for key in a for x, y in zip(sorted(a[key]), sorted(b[key], reverse=True))]
        assert min(max(abs(x - y) for x, y in v) for v in (one, two)) < 1e-6
        assert all(abs(r["explained"] - e[c - 1] / trace) <= 1e-9 * e[c - 1] / trace for r in part)
    assert {r["identity_error"] for r in got} and got[0]["identity_error"] < 1e-6


def test_whitening_settles_in_a_smaller_basis(spark, monkeypatch):
    seen = []
    kept = whitening._summed

    def noted(fit, width, shift, size, kind, add):
        seen.append(size)
        return kept(fit, width, shift, size, kind, add)

    monkeypatch.setattr(whitening, "_summed", noted)
    g = np.random.default_rng(1)
    x = g.normal(size=(300, 80)) * np.array([400.0 / 2**j if j < 12 else 0.05 for j in range(80)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df, components=3, passes=20)
    assert max(seen) < 80 * 80 and len(seen) > 3  # never the whole covariance
    *_, e, q, trace = brute_whitening([(k, v.tolist(), 0) for k, v in enumerate(x)], 80)
    assert np.abs(np.abs((model.vectors * q[:, :3]).sum(0)) - 1).max() < 1e-12 and np.allclose(model.values, e[:3], rtol=1e-12)


def test_whitening_of_few_vectors(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    assert whitening.whiten_vectors(df.limit(0)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(4)], VECTORS)
    assert whitening.whiten_vectors(same).count() == 0
    line = spark.createDataFrame([(k, [1.0 * k, 2.0 * k, 0.0], 0) for k in range(4)], VECTORS)
    got = whitening.whiten_vectors(line).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    mixed = spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.5], 0), (4, [0.0, 1.0], 0)], VECTORS)
    assert {r["vec_id"] for r in whitening.whiten_vectors(mixed).collect()} == {2, 3, 4}


def test_near_vectors_of_several_widths(spark):
    """A foreign width first in a batch takes no links from the rest, and widths do not link with each other."""
    g = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.01, 0.0])]
    rows += [(10 + k, [1.0, 0.01 * k]) for k in range(5)] + [(20, [1.0]), (21, [2.0]), (22, [-1.0]), (23, []), (24, [0.0, 0.0])]
    for k, w in enumerate([3, 5, 5, 5, 8, 8] * 30):
        v = g.normal(size=w)
        rows += [(100 + 2 * k, v.tolist()), (101 + 2 * k, (v * 3 + 0.01 * g.normal(size=w)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    for pivots in (None, 7):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, pivots=pivots, block=64, chunk=64).collect()}
        for i, v in rows:
            want = 0
            for j, u in rows:
                if i != j and len(u) == len(v) and v and any(v) and any(u):
                    want += np.dot(u, v) / math.sqrt(np.dot(u, u) * np.dot(v, v)) >= 0.95
            assert got[i] == want, (i, got[i], want)


@pytest.mark.parametrize("block", [8, 1024])
def test_large_buckets_are_no_rows_of_pairs(spark, block):
    """A group whose members are linked only with a few others: confirmed pairs follow the memberships, links are all found."""
    n, rng = 150, np.random.default_rng(5)
    member = sorted({(int(k), int(r)) for k in range(4) for r in rng.choice(n, 120, replace=False)} | {(9, n), (9, n + 1)})
    value = {r: int(v) for r, v in enumerate(rng.integers(0, 2000, n + 2))}
    df = spark.createDataFrame(member, "key long, rep long")
    values = spark.createDataFrame(sorted(value.items()), "rep long, value long")
    confirmed = []

    def confirm(pairs):
        confirmed.append(pairs.count())
        a, b = (values.select(F.col("rep").alias(c), F.col("value").alias(f"v{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").filter("abs(va - vb) <= 9").select("a", "b")

    def compare(table):
        v = table.column("value").to_numpy()
        return lambda i, j: np.abs(v[i] - v[j]) <= 9

    found = linking.link_buckets(df, confirm, lambda cells: cells.join(values, "rep"), compare, block)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert sum(confirmed) < len(member)
    label = list(range(n + 2))
    for key in {k for k, _ in member}:
        of = [r for k, r in member if k == key]
        for a in of:
            for b in of:
                if abs(value[a] - value[b]) <= 9 and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
    assert {r: got.get(r, r) for r in range(n + 2)} == dict(enumerate(label))
    assert 20 < len(set(label)) < n

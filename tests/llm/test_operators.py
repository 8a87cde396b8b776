"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberframe.llm import chat, components, embeddings, language_model, media, minhash, mixing, packing, quality, repeats, token_counts, words

public_tokenizers = pytest.importorskip("public_tokenizers")

rng = random.Random(5)
VOCABULARY = [
    "".join(rng.choice("abcdeéÈß") for _ in range(rng.randint(1, 7))) for _ in range(150)
] + ["The", "the", "don't", "x1!", "<|endoftext|>"]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near_copy(text, every):
    w = text.split(" ")
    for k in range(rng.randrange(every), len(w), every):
        w[k] = "changed"
    return " ".join(w)


BASE = [prose(rng.randint(30, 120)) for _ in range(25)]
TEXTS = [
    "", None, " \t\n", "one", "two words", "ONE", prose(3000), "a" * 900, "ab" * 600, "line\nline\n\nline", " x y\x0bz",
    *BASE, *BASE[:5], *[near_copy(t, 40) for t in BASE[:10]], *[near_copy(t, 6) for t in BASE[10:15]]
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and columns named like the operators' own."""
    rows = [
        (None, BASE[0], 1, "c"), (7, BASE[0], 2, "d"), (7, BASE[0], 2, "d"), (8, None, 3, None),
        (None, None, None, None)
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, size long, source string"
    ).withColumn("row", F.lit(1)).withColumn("spans", F.lit("x")).withColumn(
        "text_hash", F.lit("y")
    ).withColumn("role", F.lit(0)).withColumn("rep", F.lit(2)).withColumn("key", F.lit(0))


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def split(text):
    return (text or "").encode().lower().split()


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    raw, offsets = words.text_bytes(pa.array(TEXTS))
    h, counts = words.word_hashes(raw, offsets)
    assert counts.tolist() == [len(split(t)) for t in TEXTS]
    seen = {}
    for w, x in zip((w for t in TEXTS for w in split(t)), h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, odd, spark, rule):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    run = lambda d: token_counts.attribute_tokens(d, path, public_tokenizers.PATTERN, rule)
    got = defaultdict(dict)
    for r in run(docs).collect():
        got[r["doc_id"]][r["section"]] = (r["start_char"], r["end_char"], r["n_tokens"], r["n_crossing"])
    encoder, _ = token_counts._encoder(path, public_tokenizers.PATTERN)
    assert isinstance(encoder, tiktoken.Encoding)
    for k, text in enumerate(TEXTS):
        text = text or ""
        sections = text.splitlines(keepends=True) if " " not in text else [text]
        sections = [s for s in text.replace("\n", "\n\0").split("\0") if s] or [""]
        ends = list(itertools.accumulate(len(s.encode()) for s in sections))
        chars = list(itertools.accumulate(len(s) for s in sections))
        n, crossing, at = Counter(), Counter(), 0
        for token in encoder.encode_ordinary(text):
            size = len(encoder.decode_single_token_bytes(token))
            place = {"first": at, "last": at + size - 1, "middle": at + (size - 1) // 2}[rule]
            home = next(j for j, e in enumerate(ends) if place < e)
            n[home] += 1
            crossing[home] += at < ends[home] - len(sections[home].encode()) or at + size > ends[home]
            at += size
        assert got[k] == {j: (chars[j] - len(s), chars[j], n[j], crossing[j]) for j, s in enumerate(sections)}
    assert run(odd).count() >= 5 and run(empty(spark)).count() == 0


def test_mixing(docs, odd, spark):
    rows = mixing.mix_sources(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    per = defaultdict(list)
    for r in rows:
        assert r["size"] == len((TEXTS[r["doc_id"]] or "").encode().split())
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        per[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in g) for s, g in per.items()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share again until none is above its cap
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    for s, g in per.items():
        assert g[0]["target"] == pytest.approx(target[s]) and g[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in g) - target[s]) <= max(r["size"] for r in g)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix_sources(odd).count() == 5 and mixing.mix_sources(empty(spark)).count() == 0


def test_mixing_takes_heavier_documents_more_often(spark):
    many = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit("a b").alias("text"),
        F.when(F.col("id") < 1000, "a").otherwise("b").alias("source")
    )
    got = mixing.mix_sources(
        many, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(0.3)
    ).filter("source = 'a'").collect()
    taken = [sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert taken[0] > 2 * taken[1] > 0


def brute_links(texts, size, percent):
    sets = []
    for t in texts:
        w = split(t)
        sets.append(
            {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        )
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def test_near_duplicates(docs, odd, spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, size=4).collect()}
    assert [got[k] for k in range(len(TEXTS))] == brute_links(TEXTS, 4, 80)
    rows = minhash.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [
        (-1, -1, True), (-1, -1, True), (7, 7, True), (7, 7, True), (8, 8, True)
    ]
    assert minhash.near_duplicates(empty(spark)).count() == 0
    kept = minhash.drop_near_duplicates(docs, size=4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {
        k for k, v in got.items() if v[1] == k
    }


def test_crowded_buckets_are_linked_in_rounds(spark):
    """Many members of one bucket in several components, of which the first leader is only in one. A band of one value
    misses a pair of similarity 0.8 with probability 0.2, 16 bands all of them with 6e-12."""
    base = [prose(100) for _ in range(3)]
    texts = [near_copy(base[k % 3], 50) for k in range(60)]
    got = minhash.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=16, rows=1
    ).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: v[1] for k, v in enumerate(brute_links(texts, 5, 80))}


def test_minmax_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**48, 3000, dtype=np.uint64), r.integers(0, 2**48, 1000, dtype=np.uint64)
    sets = [a, np.concatenate([a[:2000], b])]
    s = minhash.minmax_signatures(np.concatenate([np.sort(x) for x in sets]), np.array([len(x) for x in sets]), 512)
    assert (s[0] == s[1]).mean() == pytest.approx(0.5, abs=0.06)
    assert (s[0][:512] == s[1][:512]).mean() == pytest.approx((s[0][512:] == s[1][512:]).mean(), abs=0.1)


def test_components(spark):
    r = random.Random(3)
    edges = [
        (r.randrange(300), r.randrange(300)) for _ in range(220)
    ] + [(k, k + 1) for k in range(400, 460)] + [(1, 1)]
    top = {v: v for e in edges for v in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = {
        x["node"]: x["component"] for x in components.components(
            spark.createDataFrame(edges, "a long, b long")
        ).collect()
    }
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def labelled(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        w = [r.choice(VOCABULARY) for _ in range(r.randint(5, 60))]
        grade = k % 3
        if grade < 2:
            for _ in range(2):
                w[r.randrange(len(w))] = ("vile" if grade == 0 else "spam!!") + r.choice(["", "s", "ly"])
        rows.append((k, " ".join(w), grade))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_quality_on_held_out_texts(spark, odd):
    train, test = labelled(spark, 900, 1), labelled(spark, 300, 2)
    model = quality.train_quality(train, train.select("doc_id", "grade"), F.col("grade"), sample=800)
    assert (np.diff(model.thresholds) >= 0).all() and (model.weights != 0).sum() < 300
    grades = {r["doc_id"]: r["grade"] for r in test.collect()}
    scored = quality.score_quality(test, model).collect()
    right = sum(round(r["expected_grade"]) == grades[r["doc_id"]] for r in scored)
    assert right >= 0.9 * len(scored) and all(0 <= r["tail_probability"] <= r["expected_grade"] <= 2 for r in scored)
    kept = quality.select_quality(test.withColumn("score", F.lit("own")), model)
    assert kept.columns == [*test.columns, "score"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scored if r["tail_probability"] >= 0.5}
    assert quality.score_quality(odd, model).count() == 5 and quality.select_quality(empty(spark), model).count() == 0
    none = quality.train_quality(train, empty(spark, "doc_id long, grade int"), F.col("grade"))
    assert not none.weights.any() and quality.score_quality(test, none).count() == 300


def test_ordinal_fit_finds_the_thresholds_order():
    r = np.random.default_rng(0)
    rows = [np.array([7] * int(g != 0) + [9] * int(g == 2) + [11], dtype=np.int32) for g in r.integers(0, 3, 600)]
    grades = np.array([int(7 in x) + int(9 in x) for x in rows])
    m = quality.fit_ordinal(rows, grades)
    assert m.weights[7] > 0.5 and m.weights[9] > 0.5 and m.thresholds[0] <= m.thresholds[1]


def image(r, h=96, w=120):
    x = np.full((h, w), 90.0)
    for _ in range(25):
        y, z, a, b = r.integers(0, h - 8), r.integers(0, w - 8), r.integers(5, 25), r.integers(5, 25)
        x[y : y + a, z : z + b] = r.integers(0, 255)
    return x


def test_media_copies(spark):
    r = np.random.default_rng(4)
    originals = [image(r) for _ in range(12)]
    rows = [(k, media.encode(x)) for k, x in enumerate(originals)]
    edits = {
        20: originals[0][8:90, 10:110],  # cropped
        21: np.clip(originals[1] * 0.8 + 30, 0, 255),  # darker
        22: originals[2] + r.normal(0, 3, originals[2].shape),  # noisy
        23: np.rot90(originals[3]),  # turned
        24: originals[4],  # equal
    }
    rows += [(k, media.encode(np.clip(x, 0, 255))) for k, x in edits.items()]
    rows += [
        (40, None), (41, b"junk"), (42, media.encode(np.zeros((4, 4)))), (43, media.encode(np.full((64, 64), 7))),
        (None, rows[5][1]), (44, None)
    ]
    frame = spark.createDataFrame(rows, "image_id long, image binary").withColumn("print", F.lit(1))
    got = {
        x["image_id"]: (
            x["component_id"], x["kept"]
        ) for x in media.near_images(frame, points=48).collect() if x["image_id"] is not None
    }
    assert {k: got[k][0] for k in edits} == {20: 0, 21: 1, 22: 2, 23: 3, 24: 4}
    assert all(got[k] == (k, True) for k in [*range(12), 40, 41, 42, 43, 44])
    assert media.near_images(empty(spark, "image_id long, image binary")).count() == 0


def test_media_keys_come_in_parts():
    """Every table key of an image is in one part, once, so no part of the tables has to hold all keys."""
    r = np.random.default_rng(4)
    bits = [r.integers(0, 256, (n, 16), dtype=np.uint8) for n in (40, 0, 70)]
    bits[2][:20], bits[2][30:50] = bits[0][:20], bits[2][50:70]
    batch = pa.record_batch([pa.array([7, 8, 9]), pa.array([x.tobytes() for x in bits])], names=["id", "bits"])
    got = [list(zip(*(c.to_pylist() for c in b.columns))) for part in range(media.PARTS) for b in media._keyed(part)([batch])]
    want = {(int(w) | t << 32, k) for k, x in zip((7, 8, 9), bits) for row in x.view(np.uint32) for t, w in enumerate(row)}
    rows = [x for some in got for x in some]
    assert sorted(rows) == sorted(want)
    assert max(map(len, got)) < len(want) / 4 and all(got)
    where = [{key for key, _ in some} for some in got]
    assert all(not where[a] & where[b] for a in range(len(where)) for b in range(a))


def test_media_cells_link_what_all_pairs_link(monkeypatch):
    """Two blocks, each linked within itself and then with the other, join what all pairs with two keys in common join, also
    where few common keys are listed at once and a large group has all its keys in common."""
    r = np.random.default_rng(8)
    made = []
    for _ in range(12):
        place, bits = r.uniform(0, 60, (14, 2)), r.integers(0, 256, (14, 16), dtype=np.uint8)
        for _ in range(r.integers(1, 5)):
            some = r.permutation(14)[: r.integers(3, 13)]
            made.append((place[some] + r.uniform(0, 9), bits[some]))
    made += [(place + k, bits) for k in range(20)]  # near copies
    made += [(r.uniform(0, 60, (14, 2)), bits) for _ in range(6)]  # with the same descriptors elsewhere
    made = [made[k] for k in r.permutation(len(made))]
    places = [p.astype(np.float32) for p, _ in made]
    names, n, half = [f"{k * 37 % 101:03d}" for k in range(len(made))], len(made), len(made) // 2
    keys = [{(t, int(w)) for row in bits.view(np.uint32) for t, w in enumerate(row)} for _, bits in made]

    def least(pairs):
        top = list(range(n))
        for a, b in list(pairs) * n:
            top[a] = top[b] = min(top[a], top[b])
        return top

    linked = []
    for a in range(n):
        for b in range(n):
            if names[a] > names[b] and len(keys[a] & keys[b]) >= 2:
                if media.consensus(places[a], made[a][1], places[b], made[b][1]) >= 6:
                    linked.append((a, b))
    want = least(linked)
    assert 20 <= len(set(want)) <= n - 20
    points, bits = (pa.array([x.tobytes() for x in some], pa.binary()) for some in (places, [b for _, b in made]))
    for listed in (1 << 22, 60):
        monkeypatch.setattr(media, "LISTED", listed)
        label = np.arange(n)
        for s in (slice(0, half), slice(half, n)):
            own = np.arange(s.stop - s.start)
            for p, q in media._join(names[s], own, points[s], bits[s], len(own), 2, 6):
                own[own == p] = q
            label[s] = own + s.start
        within = [(k, int(v)) for k, v in enumerate(label)]
        assert least(within + media._join(names, label, points, bits, half, 2, 6)) == want


def test_media_in_several_blocks(spark, monkeypatch):
    """Images link alike in one block and in many, and equal ones of different blocks are one."""
    r = np.random.default_rng(12)
    originals = [image(r) for _ in range(6)]
    rows = [(k, media.encode(x)) for k, x in enumerate(originals)] + [
        (20 + k, media.encode(x[4:90, 6:110])) for k, x in enumerate(originals)
    ] + [(40 + k, media.encode(x)) for k, x in enumerate(originals)] + [(60, media.encode(np.full((64, 64), 7)))] * 3
    frame = spark.createDataFrame(rows, "image_id long, image binary").repartition(5).cache()
    whole = sorted(media.near_images(frame).collect())
    monkeypatch.setattr(media, "IMAGES", 4)
    assert sorted(media.near_images(frame).collect()) == whole
    got = {x["image_id"]: x["component_id"] for x in whole}
    assert all(got[k] == got[20 + k] == got[40 + k] == k for k in range(6)) and got[60] == 60


def test_media_small_crops_with_the_defaults(spark):
    """A crop of a third has few of the strongest corners; all of them find it. Different images stay apart."""
    r = np.random.default_rng(11)
    originals = [image(r) for _ in range(12)]
    rows = [(k, media.encode(x)) for k, x in enumerate(originals)] + [
        (20 + k, media.encode(x[:48, :70])) for k, x in enumerate(originals)
    ]
    got = {
        x["image_id"]: x["component_id"] for x in media.near_images(
            spark.createDataFrame(rows, "image_id long, image binary")
        ).collect()
    }
    assert all(got[k] == k for k in range(12)) and all(got[20 + k] in (k, 20 + k) for k in range(12))
    assert sum(got[20 + k] == k for k in range(12)) >= 11


def test_consensus_in_blocks_and_with_an_early_end(monkeypatch):
    r = np.random.default_rng(5)
    a, bits = r.uniform(0, 100, (90, 2)), r.integers(0, 256, (90, 16), dtype=np.uint8)
    b, other = np.vstack([a[:40] * 2 + 3, r.uniform(0, 100, (30, 2))]), np.vstack(
        [bits[:40], r.integers(0, 256, (30, 16), dtype=np.uint8)]
    )
    assert media.consensus(a, bits, b, other) == 40
    assert media.consensus(a, bits, b, other, 6) >= 6 and media.consensus(a, bits, b, other, 41) == 40
    monkeypatch.setattr(media, "BLOCK", 100)
    assert media.consensus(a, bits, b, other) == 40 and media.consensus(a, bits, b, other, 41) == 40


def test_consensus_wants_one_turn_scale_and_shift():
    r = np.random.default_rng(2)
    a, bits = r.uniform(0, 100, (20, 2)), r.integers(0, 256, (20, 16), dtype=np.uint8)
    turned = a @ np.array([[0.0, 1.5], [-1.5, 0.0]]) + 7
    assert media.consensus(a, bits, turned, bits) == 20
    assert media.consensus(a, bits, r.uniform(0, 100, (20, 2)), bits) < 6


def brute_mixture(tokens, held, tuning):
    """Scores by counters: weights learned from the counts of the training texts that do not tune, then the mixture of the
    counts of all training texts."""

    def counted(keys):
        word, pair, before = Counter(), Counter(), Counter()
        for k in keys:
            word.update(tokens[k])
            pair.update(zip([None, *tokens[k]], tokens[k]))
            before.update([None, *tokens[k][:-1]])
        n, v = sum(word.values()), len(word)
        return lambda h, w: (
            pair[h, w] / max(before[h], 1), word[w] / max(n, 1), 1 / (v + 1),
            min(before[h].bit_length(), language_model.LEVELS - 1)
        )

    estimate = counted([k for k in tokens if not held(k) and not tuning(k)])
    steps = Counter()
    for k in tokens:
        if tuning(k):
            for h, w in zip([None, *tokens[k]], tokens[k]):
                p, q, u, level = estimate(h, w)
                steps[level, *(int(language_model._ratio(np.array([x / u]))[0]) for x in (p, q))] += 1
    level, p, q = (np.array(x) for x in zip(*sorted(steps)))
    weights = language_model.learn_weights(level, p, q, np.array([float(steps[x]) for x in sorted(steps)]))
    estimate = counted([k for k in tokens if not held(k)])
    out = {}
    for k, t in tokens.items():
        found = [estimate(h, w) for h, w in zip([None, *t], t)]
        out[k] = sum(math.log10(float(weights[x[3]] @ x[:3])) for x in found)
    return out


def test_language_model(docs, odd, spark):
    held, tuning = F.col("doc_id") % 5 == 2, F.col("doc_id") % 5 == 3
    got = {
        r["doc_id"]: r for r in language_model.score_texts(
            docs, held, tuning, batch_bytes=2000, range_bytes=1000
        ).collect()
    }
    one = {r["doc_id"]: r for r in language_model.score_texts(docs, held, tuning).collect()}
    tokens = {k: [*split(t), 0] for k, t in enumerate(TEXTS)}
    count = Counter(w for k, t in tokens.items() if k % 5 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for k, t in tokens.items():
        r = got[k]
        assert (
            r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]
        ) == (k % 5 == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] == pytest.approx(one[k]["score"]) and r["score"] <= 0
    want = brute_mixture(tokens, lambda k: k % 5 == 2, lambda k: k % 5 == 3)
    assert [got[k]["score"] for k in tokens] == pytest.approx([want[k] for k in tokens])
    assert language_model.score_texts(odd, F.lit(False), F.lit(True)).count() == 5
    assert language_model.score_texts(odd, F.lit(True), F.lit(False)).filter(
        "train_tokens = 0 and score < 0"
    ).count() == 5
    assert language_model.score_texts(empty(spark), held, tuning).count() == 0


def test_language_model_estimates_and_mixture():
    """No other weights on a grid have a greater likelihood."""
    levels, p, w = np.array([3] * 3), np.array([40, 0, 30]), np.array([20, 20, 25])
    counts = np.array([50.0, 30.0, 20.0])
    weights = language_model.learn_weights(levels, p, w, counts)
    assert weights.sum(1) == pytest.approx(1)

    def likelihood(x):
        return float(
            counts @ np.log(np.column_stack([language_model._value(p), language_model._value(w), np.ones(3)]) @ x)
        )

    grid = (np.array(x) / sum(x) for x in itertools.product(np.linspace(0.01, 0.98, 25), repeat=3))
    assert all(likelihood(weights[3]) >= likelihood(x) - 1e-3 for x in grid)


def test_packing(docs, odd, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for frame, texts, window, grain in (
        (docs, dict(enumerate(TEXTS)), 2048, 32), (docs, dict(enumerate(TEXTS)), 64, 8)
    ):
        rows = packing.pack_documents(frame, path, window=window, grain=grain).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
        assert by_doc.keys() == texts.keys()
        for k, text in texts.items():
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
            at = 0
            for r in sorted(by_doc[k], key=lambda r: r["start"]):
                part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
                assert r["start"] == at and r["length"] > 0 and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
                at += r["length"]
            assert at == len(ids)
        for pieces in by_sequence.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= window and at & (at - 1) == 0  # full, or a power of two
    assert packing.pack_documents(odd, path).count() >= 5 and packing.pack_documents(empty(spark), path).count() == 0


def test_least_squares_never_takes_more_than_there_is():
    r = np.random.default_rng(0)
    for _ in range(5):
        h = r.integers(0, 200, 16)
        table, repeats_ = packing.repeat_counts(h, 3)
        assert (table @ repeats_ <= h).all() and (table.T @ np.arange(1, 17) == 16).all() and repeats_.sum() > 0
    a, b = r.normal(size=(8, 12)), r.normal(size=8)
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g[x == 0] < 1e-6).all() and np.abs(g[x > 0]).max(initial=0) < 1e-6


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    x = np.concatenate(
        [base, base[:20] + r.normal(size=(20, 16)) * 0.12, base[:5], base[0] + r.normal(size=(60, 16)) * 0.1]
    )
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [
        (500, None), (501, [0.0] * 16), (502, [float("nan"), *[1.0] * 15]), (503, [None, *[1.0] * 15]),
        (None, x[0].tolist()), (0, x[0].tolist())
    ]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    top = list(range(len(x)))
    for i, j in zip(*np.nonzero(near)):
        a, b = sorted((top[i], top[j]))
        top = [a if t == b else t for t in top]
    for options in ({}, {"block": 7, "chunk": 11, "pivots": 6}):
        got = {q["vec_id"]: q for q in embeddings.near_vectors(frame, **options).collect() if q["vec_id"] is not None}
        assert [
            (got[k]["n_links"], got[k]["component_id"]) for k in range(len(x))
        ] == list(zip(near.sum(1).tolist(), top))
        assert all(
            (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in (500, 501, 502, 503)
        )
    assert embeddings.near_vectors(empty(spark, "vec_id long, embedding array<double>")).count() == 0


def brute_cost(roles):
    """Least cost by trying every choice."""
    best = {chat.START: 0}
    for r in chat.codes(roles):
        new = {}
        for s, c in best.items():
            for t in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                for n in range(4):
                    for way in itertools.product((chat.SYSTEM, chat.USER, chat.ASSISTANT), repeat=n):
                        if all(b in chat.LEGAL[a] for a, b in itertools.pairwise((s, *way, t))):
                            own = 0 if r == t else chat.RELABEL_UNKNOWN if r == 0 else chat.RELABEL
                            new[t] = min(new.get(t, 99999), c + own + n * chat.INSERT)
            if s != chat.START:
                new[s] = min(new.get(s, 99999), c + (chat.MERGE_SAME if r == s else chat.MERGE_OTHER))
        best = new
    return min(c + chat.END_COST[s] for s, c in best.items())


def test_chat_repair(spark):
    r = random.Random(9)
    kinds = ["user", "assistant", "system", "User ", "tool", None]
    conversations = {k: [r.choice(kinds) for _ in range(r.randint(1, 7))] for k in range(60)}
    conversations[100] = [r.choice(kinds[:3]) for _ in range(400)]  # lies in several tasks
    conversations[101] = ["system"]
    rows = [(k, t, role, f"t{t}" if t % 5 else None) for k, c in conversations.items() for t, role in enumerate(c)]
    rows += [(None, 0, "user", "a"), (None, None, "user", "b"), (None, None, "user", "b")]
    frame = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"
    ).withColumn("part", F.lit(3)).withColumn("pos", F.lit("x"))
    got = defaultdict(list)
    for q in chat.repair_roles(frame, partitions=5).collect():
        got[q["conv_id"]].append(q)
    for k, roles in conversations.items():
        q = sorted(got[k], key=lambda x: x["seq"])
        assert [x["seq"] for x in q] == list(range(len(roles))) and [x["role"] for x in q] == roles
        if len(roles) < 50:
            assert sum(x["cost"] for x in q) == brute_cost(roles)
        out = "".join(x["rendered"] for x in q)
        turns = [line[2:-2] for line in out.split("\n") if line.startswith("<|")]
        states = [chat.START, *[chat.ROLES.index(t) + 1 for t in turns]]
        assert all(b in chat.LEGAL[a] for a, b in itertools.pairwise(states)) and states[-1] in chat.ENDS
        assert [
            line for line in out.split("\n") if line.startswith("t")
        ] == [f"t{t}" for t in range(len(roles)) if t % 5]
    assert "".join(x["rendered"] for x in sorted(got[None], key=lambda x: x["seq"])) == "<|user|>\nb\nb\na"
    # pieces and blocks: the cost is that of one piece, however rows are dealt, and the repair does not depend on the dealing
    one = {k: sum(x["cost"] for x in q) for k, q in got.items()}
    for width in (2, 7):
        dealt = [sorted(chat.repair_roles(frame, partitions=n, width=width).collect(), key=str) for n in (1, 5, 9)]
        assert dealt[0] == dealt[1] == dealt[2]
        cost, states = Counter(), defaultdict(list)
        for q in sorted(dealt[0], key=lambda x: x["seq"]):
            cost[q["conv_id"]] += q["cost"]
            states[q["conv_id"]] += [line[2:-2] for line in q["rendered"].split("\n") if line.startswith("<|")]
        assert cost == one
        assert all(
            chat.ROLES.index(b) + 1 in chat.LEGAL[chat.ROLES.index(a) + 1] for v in states.values() for a,
            b in itertools.pairwise(v)
        )
    assert chat.repair_roles(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


def brute_repeats(texts, length):
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~gone[:-1]].tobytes()
        out.append((len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeats(docs, odd, spark, crowd, monkeypatch):
    got = {r["doc_id"]: tuple(r[1:]) for r in repeats.repeated_bytes(docs, length=40, gram=8, crowd=crowd).collect()}
    assert [got[k] for k in range(len(TEXTS))] == brute_repeats([(t or "").encode() for t in TEXTS], 40)
    rows = repeats.repeated_bytes(odd, length=40, gram=8).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 0, *[len(BASE[0].encode())] * 3]
    assert repeats.repeated_bytes(empty(spark)).count() == 0
    kept = repeats.remove_repeats(docs, length=40, gram=8, crowd=crowd)
    assert kept.columns == docs.columns
    for r in kept.collect():
        text = TEXTS[r["doc_id"]]
        assert (r["text"] is None) == (text is None) and r["n_chars"] == len(r["text"] or "")
        if text is not None:
            assert abs(len(r["text"].encode()) - (got[r["doc_id"]][0] - got[r["doc_id"]][1])) <= 3 * got[r["doc_id"]][2]
    assert repeats.remove_repeats(odd, length=40, gram=8).columns == odd.columns


def test_repeats_in_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    long = [prose(400).encode(), b"x" * 30, prose(500).encode()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in long])])
    parts = list(repeats._pieces(offsets, 40))
    assert len(parts) > 5 and max(high - low for *_, low, high in parts) <= 1100
    covered = [set() for _ in long]
    for i, j, low, high in parts:
        for r in range(i, j):
            a, b = max(low, offsets[r]), min(high, offsets[r + 1])
            covered[r] |= set(range(a, b - 39))
    assert [len(c) for c in covered] == [max(0, len(t) - 39) for t in long]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(150) for _ in range(40)]
    passage = prose(140)
    texts = [*clean, clean[3], near_copy(clean[5], 60), clean[7] + " " + passage, prose(90) + " " + passage]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in near.collect()} == set(range(44)) - {40, 41}
    unique = corpus_pipeline.remove_repeats(spark, near, str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert all(left[k] == texts[k] for k in range(40) if k != 7) and passage[10:500] not in left[43]
    mixed = corpus_pipeline.mix_sources(spark, unique, str(tmp_path))
    assert mixed.columns == docs.columns
    total = lambda f: sum(len(r["text"].encode().split()) for r in f.collect())
    assert total(mixed) == pytest.approx(total(unique), rel=0.1)
    pieces = corpus_pipeline.pack(spark, mixed, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "repeats", "mixing", "packing"
    ]

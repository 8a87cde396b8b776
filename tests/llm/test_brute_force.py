"""The quality model against an independent optimiser, image links against all pairs, and very long texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import chat, language_model, media, quality, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
rng = random.Random(21)


# ------------------------------------------------------------------ quality


def rated_texts(n=160):
    good, bad, plain = ["careful", "thorough", "evidence"], ["buy", "cheap", "now"], [f"word{k}" for k in range(25)]
    texts, grades = [], []
    for _ in range(n):
        g = rng.randrange(3)
        words = [rng.choice(plain) for _ in range(rng.randint(4, 25))]
        words += [rng.choice((bad, plain, good)[g]) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.15:
            words += ["same"] * 6
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g if rng.random() < 0.85 else rng.randrange(3))
    return texts, np.array(grades)


def named_features(text):
    """The features by name: words, their beginnings and endings, the length's magnitude, shares of repeats."""
    words = text.split(" ")
    again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    out = {("word", w) for w in words} | {("begin", w[:5]) for w in words} | {("end", w[-2:]) for w in words}
    return out | {("size", int(math.log2(len(words) + 1)))} | {("again", s) for s in quality.REPEATED if again >= s}


def plain_fit(texts, grades, l1=1e-3, least_rows=8, steps=40_000):
    """Proximal gradient with one small step, on a dense matrix: (objective, linear scores, thresholds)."""
    rows = [named_features(t) for t in texts]
    count = Counter(f for r in rows for f in r)
    names = sorted(f for f, c in count.items() if c >= least_rows)
    x = np.array([[f in r for f in names] for r in rows], dtype=float)
    n, levels = len(texts), int(grades.max())
    above = grades[:, None] > np.arange(levels)
    w, t = np.zeros(len(names)), np.zeros(levels)
    step = 1 / (0.25 * levels * (np.linalg.norm(x, 2) ** 2 + n) / n)
    for _ in range(steps):
        z = (x @ w)[:, None] - t
        slope = (1 / (1 + np.exp(-z)) - above) / n
        w = w - step * (x.T @ slope.sum(1))
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        t = t + step * slope.sum(0)
    assert (np.diff(t) >= 0).all()
    z = (x @ w)[:, None] - t
    return float(np.sum(np.logaddexp(0, z) - above * z) / n + l1 * np.abs(w).sum()), x @ w, t


def test_quality_is_the_optimum_of_its_likelihood(spark):
    texts, grades = rated_texts()
    best, score, thresholds = plain_fit(texts, grades)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(g)) for k, g in enumerate(grades)], "doc_id long, grade int")
    above = grades[:, None] > np.arange(2)
    for steps, slack in ((90, 0.01), (1500, 1e-4)):  # as in production, and carried on
        model = quality.train_quality(docs, labels, F.col("grade"), steps=steps)
        rows = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
        z = np.array([rows[k]["score"] for k in range(len(texts))])[:, None] - model.thresholds
        value = float(np.sum(np.logaddexp(0, z) - above * z)) / len(texts) + 1e-3 * np.abs(model.weights).sum()
        assert best - 1e-6 <= value <= best + slack, (value, best)
        tails = 1 / (1 + np.exp(-(score[:, None] - thresholds)))
        near = 0.1 if steps == 90 else 0.02
        for k in range(len(texts)):
            assert rows[k]["tail_probability"] == pytest.approx(tails[k, -1], abs=near)
            assert rows[k]["expected_grade"] == pytest.approx(tails[k].sum(), abs=2 * near)
    assert (np.diff(model.thresholds) >= 0).all()


# ------------------------------------------------------------------ images


def drawn(r, h=80, w=90):
    x = np.full((h, w), 90.0)
    for _ in range(22):
        y, z, a, b = r.integers(0, h - 8), r.integers(0, w - 8), r.integers(5, 22), r.integers(5, 22)
        x[y : y + a, z : z + b] = r.integers(0, 255)
    return x


def test_image_links_against_all_pairs(spark):
    """The links are those of all pairs with two table keys in common whose key points agree; almost none has fewer keys."""
    r = np.random.default_rng(6)
    base = [drawn(r) for _ in range(12)]
    images = list(base)
    for x in base[:8]:
        images += [x[6:70, 8:80], np.clip(x + r.normal(0, 4, x.shape), 0, 255), np.rot90(x), x[:50, :60]]
    rows = [(k, media.encode(x)) for k, x in enumerate(images)]
    rows += [(200, rows[1][1]), (200, rows[1][1]), (3, rows[4][1]), (None, rows[0][1]), (201, None)]
    df = spark.createDataFrame(rows, "image_id long, image binary").repartition(3)
    # all pairs of different images; the operator sees an image as its stored bytes
    stored = [media.decode(media.encode(x)) for x in images]
    told = []
    for x in stored:
        _, place, bits = media.describe(x[None])
        words = bits.view(np.uint32)
        told.append((place, bits, {(w, int(v)) for w in range(words.shape[1]) for v in words[:, w]}))
    agree, keyed = set(), set()
    for a in range(len(told)):
        for b in range(a):
            if media.consensus(*told[a][:2], *told[b][:2]) >= media.AGREE:
                agree.add((a, b))
                if len(told[a][2] & told[b][2]) >= 2:
                    keyed.add((a, b))
    assert len(keyed) >= 40 and len(agree - keyed) <= 0.05 * len(agree)
    top = list(range(len(images)))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in keyed:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {}
    for q in media.near_images(df).collect():
        got.setdefault(q["image_id"], set()).add((q["component_id"], q["kept"]))
    # image 4 stands under the id 3 too, which is the least of its group; the rows of an id are judged each by its image
    name = {k: 3 if find(k) == find(4) else find(k) for k in range(len(images))}
    assert find(4) == 4 and got.pop(3) == {(3, True)}
    assert {k: got[k] for k in range(len(images)) if k != 3} == {
        k: {(name[k], name[k] == k)} for k in range(len(images)) if k != 3
    }
    assert got[200] == {(find(1), False)} and got[201] == {(201, True)} and got[None] == {(None, True)}


# ------------------------------------------------------------------ very long texts

LONG = " ".join("".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9))) for _ in range(20_000))


def test_token_counts_of_a_very_long_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = LONG[:60_000] + "\n" + LONG[60_000:]
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {
        (r["doc_id"], r["section"]): (r["start_char"], r["end_char"], r["n_tokens"], r["n_crossing"])
        for r in token_counts.attribute_tokens(df, path, public_tokenizers.PATTERN, "first").collect()
    }
    encoder, _ = token_counts._encoder(path, public_tokenizers.PATTERN)
    border, at, n = len(text[:60_001].encode()), 0, [0, 0, 0]
    for token in encoder.encode_ordinary(text):
        size = len(encoder.decode_single_token_bytes(token))
        n[at >= border] += 1
        n[2] += at < border < at + size
        at += size
    assert got[1, 0] == (0, 60_001, n[0], n[2]) and got[1, 1] == (60_001, len(text), n[1], 0)


def test_language_model_of_a_very_long_text(spark):
    texts = {1: LONG, 2: LONG[:5000], 3: "a b c", 4: LONG[40_000:]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokens = {k: [*t.encode().lower().split(), 0] for k, t in texts.items()}
    count = Counter(w for k, t in tokens.items() if k != 4 for w in t)
    n, v = sum(count.values()), len(count)
    for q in language_model.score_texts(df, F.col("doc_id") == 4, F.col("doc_id") == 3).collect():
        t = tokens[q["doc_id"]]
        assert (q["n_tokens"], q["train_tokens"], q["n_known"]) == (len(t), n, sum(count[w] > 0 for w in t))
        assert q["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))


def test_chat_with_a_very_long_text(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "user", "more"), (1, 2, "assistant", LONG[::-1]), (2, 0, "assistant", "x")]
    got = chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    out = "".join(q["rendered"] for q in sorted(got, key=lambda q: q["seq"]) if q["conv_id"] == 1)
    assert LONG in out and LONG[::-1] in out and out.index(LONG) < out.index("more") < out.index(LONG[::-1])

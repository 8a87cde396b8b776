"""The pipeline's stages: passages of just over 50 words, odd rows, and columns with clashing names."""

import random

import pytest
from emberframe.llm import repeats
from pyspark.sql import functions as F

r = random.Random(11)
WORDS = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(1, 6))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "times", "_id", "_size", "_source", "size", "key", "bin", "taken", "target", "rated", "of", "part", "copy", "n",
    "rep", "component", "spans", "anchor", "score", "c0", "own_text"
)


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    there = tmp_path_factory.mktemp("tables")
    texts = [prose(80) for _ in range(60)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(60 + k, prose(60) + " vile vilely " + prose(10), "en", "s1", 0) for k in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{there}/documents.parquet")
    spark.createDataFrame(
        [(k, int(k < 60), int(k >= 60)) for k in range(100)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{there}/labels.parquet")
    return str(there)


@pytest.mark.parametrize("n", [51, 55, 60])
def test_passages_of_just_over_fifty_words_go(spark, n):
    """However they are spaced or cased, and wherever they stand; 50 words stay, and so do texts without any."""
    import corpus_pipeline

    passage, short = prose(n), prose(50)
    clean = [prose(120) for _ in range(20)]
    texts = [
        *clean, passage + " " + prose(30), prose(30) + "\n" + passage.replace(" ", "  "),
        prose(20) + " " + passage.upper() + " " + prose(20), short + " " + prose(40), prose(40) + " " + short
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    out = corpus_pipeline.remove_repeats(spark, docs, "")
    assert out.columns == docs.columns
    left = {q["doc_id"]: q for q in out.collect()}
    assert [left[k]["text"] for k in range(20)] == clean and [left[k]["text"] for k in (23, 24)] == texts[23:]
    want = [texts[20][len(passage) :], texts[21][: texts[21].index("\n") + 1], texts[22].replace(passage.upper(), "")]
    assert [left[k]["text"] for k in (20, 21, 22)] == want
    assert all(q["n_chars"] == len(q["text"]) for q in left.values())


def brute_word_repeats(texts, n):
    split = [t.lower().split() for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def test_word_passages_against_brute_force(spark):
    few = WORDS[:6]
    texts = [
        " ".join(r.choice(few) for _ in range(r.randint(0, 60))) for _ in range(40)
    ] + ["la " * 50, "la la", "", "x " * 7 + "y " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (3, 7):
        left = {q["doc_id"]: q["text"].lower().split() for q in repeats.remove_repeats(docs, words=n, gram=4).collect()}
        assert [left[k] for k in range(len(texts))] == brute_word_repeats(texts, n)


def odd_rows(spark):
    text = prose(90)
    rows = [
        (None, text, None, None, 1), (7, text, "en", "a", 2), (7, text, "en", "a", 2), (8, None, "en", None, None),
        (None, None, None, None, None), (9, "", "en", "a", 0), (10, prose(20_000), "en", "b", 3)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def test_stages_take_odd_rows_and_clashing_names(spark, folder):
    import corpus_pipeline

    odd = odd_rows(spark)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert docs is odd or not rows
            if name == "packing":
                assert docs is not odd or {q["doc_id"] for q in rows} == {None, 7, 8, 9, 10}
                continue
            assert out.columns == docs.columns
            if docs is odd:
                assert all(tuple(q[c] for c in CLASHES) == tuple(range(len(CLASHES))) for q in rows)
                ids = sorted(q["doc_id"] or -1 for q in rows)
                if name == "near_duplicates":
                    assert ids == [-1, -1, 7, 7, 8, 9, 10]
                elif name == "repeats":
                    left = {(q["doc_id"], q["text"]) for q in rows}
                    assert len(rows) == 7 and {(None, ""), (7, ""), (8, None), (None, None), (9, "")} < left
                elif name == "mixing":
                    assert all((q["text"] or "").split() for q in rows)


def test_quality_stage_and_run(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {q["doc_id"] for q in corpus_pipeline.select_quality(spark, docs, folder).collect()}
    assert kept == set(range(60))
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and {q["doc_id"] for q in pieces} <= set(range(60))
    per = {}
    for q in pieces:
        per.setdefault(q["sequence_id"], []).append((q["offset"], q["length"]))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048

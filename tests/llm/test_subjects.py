import random

import pytest

from textloom.llm.subjects import SUBJECTS, Subjects, featured, subjects, train

DOCS = "doc_id bigint, text string, share double"
LABELS = "doc_id bigint, subject string, annotator string"


def table(spark, seed=1, n=400):
    rng = random.Random(seed)
    vocabulary = {s: [f"{s}{c}word" for c in "abcdefgh"] for s in SUBJECTS}
    frames = ["The {} is near the {}.", "Nobody ever saw a {} without its {}.", "We sold a {} for the {} yesterday.", "My guess is that the {} needs a {}."]
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(SUBJECTS, rng.choice([1, 1, 2]))
        lines = [rng.choice(frames).format(*rng.sample(vocabulary[s], 2)) for s in own for _ in range(4)]
        lines += ["Hope to see a few of you there.", "Greetings from all of us."]
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), None))
        truth[i] = set(own)
    labels = [(i, s.upper() if i % 3 else s, "a") for i in range(0, n, 4) for s in truth[i]]
    labels += [(0, "law", "b"), (4, None, None), (8, "nonsense", "c"), (None, "law", None)] + labels[:5]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = table(spark)
    got = {i: set() for i in truth}
    read = featured(docs)
    model = train(read, labels)
    for r in subjects(read, model).collect():
        got[r.doc_id].add(r.subject)
    held = [i for i in truth if i % 4]
    assert sum(got[i] == truth[i] for i in held) >= 0.9 * len(held)
    # the calibration decides: without it the same scores find something else
    plain = Subjects(model.w, model.slope * 0 + 1, model.shift * 0 + 0.1)
    assert {tuple(r) for r in subjects(read, plain).select("doc_id", "subject").collect()} != {(i, s) for i, own in got.items() for s in own}


@pytest.mark.parametrize("docs", [[], [(1, None, None), (2, "", None), (3, "...", None), (None, "law", None)]])
def test_nothing_to_learn_from(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    read = featured(df)
    assert subjects(read, train(read, spark.createDataFrame([], LABELS))).count() == 0

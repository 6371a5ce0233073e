import os
import random

import pytest

from textloom.llm.packing import TOKENIZER, BestFit, pack, token_counts
from textloom.llm.practice import MARK, Writer
from textloom.llm.components import components
from textloom.llm.responses import copied, defects, empty, linked, requested, tongues_for, truncated

RUNS = "run_id bigint, query string, rewritten_query string, answer string, defect string"


def said(writer, lang, n=3):
    return " ".join(MARK.sub(lambda m: m[2], writer.sentence(lang)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    w = Writer(2)
    rows = [(i, said(w, lang, 5), lang) for i, lang in enumerate(["en", "de", "fr", "es", "pt"] * 150)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


UNLIKE = [
    "Where do swallows spend the winter?", "How long should rice be cooked?", "Which bridge over the river is older?", "Who invented the zip fastener?",
    "Can two magnets ever cancel out?", "Why are old violins so expensive?", "What did people eat at sea?", "Is the ferry running on Sundays?",
]


def test_defects(spark, docs):
    w = Writer(8)
    query = "Why does nobody ever compare the numbers of the old engine with the weather?"
    rows = [(i, f"{query} {i}", None, said(w, "en"), None) for i in range(60)]
    refusal = "I am sorry but that is nothing I may talk about here."
    rows += [(100 + i, q, None, refusal, None) for i, q in enumerate(UNLIKE)]
    rows += [
        (200, query, None, None, None), (201, query, None, " \n", None), (202, query, None, "<answer></answer>", None), (203, query, None, "N/A", None),
        (210, query, None, query.upper(), None), (211, "x", query, f"Q: {query} {query}", None),
        (220, query, None, said(w, "de"), None), (221, query + " Please answer in German.", None, said(w, "de"), None),
        (230, query, None, said(w, "en", 2) + " But then the old engine of the", None), (240, query, None, "Yes.", None),
        (241, query, None, query + " " + said(w, "en"), None), (242, query, None, "```\nset level 4\n```", None), (None, query, None, None, None), (250, None, None, "Fine as it is.", None),
    ]
    df = spark.createDataFrame(rows + rows[60:64], RUNS)
    got = {r.run_id: r.defect for r in defects(df, tongues_for(df, docs)).where("run_id >= 100").collect()}
    want = {100 + i: "refusal" for i in range(8)} | dict.fromkeys([200, 201, 202, 203], "empty") | {210: "copied_question", 211: "copied_question", 220: "wrong_language", 230: "truncated"}
    assert got == want


def test_an_answer_to_related_prompts_only_is_no_refusal(spark, docs):
    fixed = "The ferry leaves at eight and comes back at noon."
    same = [(i, "When does the ferry leave?", None, fixed, None) for i in range(40)]
    near = [(100 + i, f"When does the ferry number {i} of the company leave?", None, fixed.replace("ferry", "boat"), None) for i in range(12)]
    df = spark.createDataFrame(same + near, RUNS)
    assert defects(df, tongues_for(df, docs)).count() == 0


def test_three_unrelated_prompts_reveal_a_refusal_at_any_size(spark, docs):
    rng = random.Random(9)
    for n in (20, 1500):
        rows = [(i, f"{UNLIKE[i % 8]} {i}", None, "The " + " ".join(f"w{rng.randrange(300)}" for _ in range(9)) + ".", None) for i in range(n)]
        rows += [(10_000 + i, UNLIKE[i], None, "I must leave that question without any reply.", None) for i in range(3)]
        df = spark.createDataFrame(rows, RUNS)
        got = {r.run_id for r in defects(df, tongues_for(df, docs)).where("defect = 'refusal'").collect()}
        assert got == {10_000, 10_001, 10_002}


def test_links_are_the_same_in_small_blocks(spark):
    base = "i am afraid that is beyond my knowledge".split()
    openings = [" ".join(base[:k] + [f"w{k}{v}"] + base[k + 1 :]) for k in range(8) for v in range(6)]
    df = spark.createDataFrame(list(enumerate(openings)), "id bigint, opening string")
    made = [{(r.id, r.component) for r in components(linked(df, 48, block_rows=b)).collect()} for b in (1024, 4)]
    assert made[0] == made[1] == {(i, 0) for i in range(48)}


def test_checks():
    assert empty(None) and empty("​") and empty("**") and not empty("No.") and not empty("42")
    assert requested("Wer weiß das? Bitte auf Spanisch antworten.") == "es" and requested("Where is the German engine?") is None
    assert copied("where is it", [["where", "is", "it"]]) and not copied("It.", [["where", "is", "it"]]) and copied("WEISS ER ES", [["weiß", "er", "es"]])
    assert truncated("It is the", set()) and truncated("It is, because,", set()) and not truncated("- one thing\n- another thing", {"the"})
    assert truncated("- One thing.\n- Another thing.\n- A third", {"the"}) and not truncated("See this. :-)", set())


def test_no_runs(spark, docs):
    df = spark.createDataFrame([], RUNS)
    assert defects(df, tongues_for(df, docs.limit(0))).count() == 0


def test_best_fit_takes_the_smallest_space():
    bins = BestFit(10, 3)
    assert [bins.add(x) for x in (6, 7, 9, 3, 1, 4)] == [0, 1, 2, 1, 2, 0]
    bins = BestFit(10, 2)
    assert [bins.add(x) for x in (6, 7, 8, 3)] == [0, 1, 2, 0]  # the fullest, 1, was closed


def test_packing_is_whole(spark):
    rows = [(i, (i * 37) % 300 + 1) for i in range(500)] + [(900, 5000), (901, 0), (902, None), (903, 2048)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    for per_task in (25_000, 60):
        got = pack(df, per_task=per_task).collect()
        load, size = {}, {}
        for r in got:
            size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
            if r.n_tokens:
                load[r.container] = load.get(r.container, 0) + r.n_tokens
        assert size == {i: n or 0 for i, n in rows}
        assert max(load.values()) <= 2048
        assert len([r for r in got if r.doc_id == 900]) == 3 and len([r for r in got if r.doc_id == 903]) == 1
        assert len(load) <= 1.1 * sum(load.values()) / 2048 + 2
    assert pack(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (3, None), (None, "x")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}


def test_all_openings_alike_enough_are_linked(spark):
    from textloom.llm.responses import linked

    rows = []
    for k in range(1500):  # six of ten words shared
        same = [f"s{k}x{i}" for i in range(6)]
        rows += [(2 * k, " ".join(same + [f"a{k}", f"b{k}"])), (2 * k + 1, " ".join(same + [f"c{k}", f"d{k}"]))]
    found = {(max(r.a, r.b), min(r.a, r.b)) for r in linked(spark.createDataFrame(rows, "id bigint, opening string"), len(rows)).collect()}
    assert found == {(2 * k + 1, 2 * k) for k in range(1500)}

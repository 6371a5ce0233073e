from textloom.llm.leaks import Automaton, leaks, passages, without_leaks

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a bitter potion near the old stone bridge"
ITEMS = "item_id bigint, question string, answer string, contexts array<string>"
DOCS = "doc_id bigint, text string, item_id string"


def found(spark, docs, items=((7, "short one", None, [ITEM, None]), (8, None, None, None), (None, ITEM, "", []))):
    return leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(items), ITEMS))


def test_what_counts_as_a_passage(spark):
    w = ITEM.split()
    altered = w[:12]
    altered[5] = "cat"
    docs = [
        (1, "Before. " + ITEM.upper() + "! After.", "x"), (2, " ".join(w[:12]), None), (3, " ".join(w[:11]), ""), (4, " ".join(altered), None),
        (5, " ".join(altered[:9] + ["x"] + altered[10:]), None), (6, "> the quick brown\n> <b>fox</b> jumps *over*\n> the lazy dog while seven wizards quietly", None),
        (7, " ".join(w[:8] + w[9:20]), None), (8, "nothing of the kind", None), (9, None, None), (10, "", None), (None, ITEM, None),
    ]
    rows = found(spark, docs).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 7), (2, 7), (4, 7), (6, 7), (7, 7)}
    first = next(r for r in rows if r.doc_id == 1)
    assert docs[0][1][first.start_pos : first.end_pos] == ITEM.upper()


def test_longest_matches():
    a = Automaton([(1, "a b c a b d".split()), (2, "x a b c".split())])
    assert [(e, n) for e, n, _ in a.matches("z a b c q a b d".split(), 2)] == [(4, 3), (8, 3)]
    assert passages(a, []) == []


def test_empty_tables(spark):
    assert found(spark, []).count() == 0
    assert found(spark, [(1, ITEM, None)], items=[]).count() == 0


def test_spans_are_cut(spark):
    text = "Keep this opening line in the text please, it is our own and long enough to stay. " * 3 + ITEM + " Keep the end."
    docs = [(1, text, None), (2, ITEM, None), (3, "clean", None)]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: (r.text, r.removed) for r in without_leaks(df, found(spark, docs)).collect()}
    assert got[1] == (text.replace(ITEM, ""), len(ITEM))
    assert got[2] == (None, len(ITEM))
    assert got[3] == ("clean", 0)


def test_a_span_that_two_items_share_counts_once(spark):
    text = "Keep this opening line in the text please, it is our own and long enough to stay. " * 3 + ITEM + " Keep the end."
    df = spark.createDataFrame([(1, text, None), (1, text, None)], DOCS)
    items = [(7, ITEM, None, None), (8, None, ITEM, None), (9, None, None, [ITEM])]
    rows = leaks(df, spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, r.item_id) for r in rows.collect()} == {(1, 7), (1, 8), (1, 9)}
    assert [(r.text, r.removed) for r in without_leaks(df, rows).collect()] == [(text.replace(ITEM, ""), len(ITEM))]


def test_every_passage_of_an_item_is_cut(spark):
    w = ITEM.split()
    item = " ".join(w[:13] + [f"filler{i}" for i in range(30)] + w[9:])
    own = " ".join(f"own{i}" for i in range(40))
    text = f"{own} {' '.join(w[:13])} mine1 mine2 mine3 mine4 mine5 {' '.join(w[9:])} {own}"
    df = spark.createDataFrame([(1, text, None)], DOCS)
    got = without_leaks(df, leaks(df, spark.createDataFrame([(7, item, None, None)], ITEMS))).first()
    assert got.text.split() == own.split() + [f"mine{i}" for i in range(1, 6)] + own.split()

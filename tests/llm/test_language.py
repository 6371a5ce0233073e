import pytest

from textloom.llm.language import ByteNetwork, canonical, languages, segments, train, windows, wrong_labels
from textloom.llm.practice import MARK, Writer
from textloom.llm.text import plain, repaired, sentences

SCHEMA = "doc_id bigint, text string, lang string, confidence string"


def document(writer, lang, n=5):
    return " ".join(MARK.sub(lambda m: m[2], writer.sentence(lang)) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    w = Writer(2)
    rows = [(i, document(w, lang), lang, "c") for i, lang in enumerate(["en", "de", "fr", "es", "pt"] * 300)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def network(labelled):
    return train(labelled)


def test_held_out_accuracy(network):
    w = Writer(77)
    langs = ["en", "de", "fr", "es", "pt"] * 20
    got = segments(network, [document(w, lang, 3) for lang in langs])
    assert sum(bool(g) and g[0][1] == lang for g, lang in zip(got, langs)) >= 0.9 * len(langs)


def test_labels_and_mixtures(spark, network):
    w = Writer(5)
    en, de = document(w, "en", 4), document(w, "de", 4)
    rows = [(1, en, "en-GB", None), (2, en, "German", None), (3, de, None, None), (4, de, "  ", None), (5, en + "\n\n" + de, "en", None), (6, None, "en", None), (7, "", None, None), (8, "!!! 123", "xx", None)]
    found = languages(spark.createDataFrame(rows, SCHEMA), network)
    assert {tuple(r) for r in wrong_labels(found).collect()} == {(2, 0, "en"), (3, 0, "de"), (4, 0, "de"), (5, 0, "en"), (5, len(en) + 2, "de")}
    assert all(0 <= r.confidence <= 1 for r in found.collect())


def test_windows_read_every_byte():
    for n in (1, 7, 8, 96, 97, 119, 120, 191, 192, 193, 500):
        body = "".join(chr(97 + i % 26) for i in range(n))
        parts = windows(body)
        at = [k * 96 for k in range(len(parts) - 1)] + [max(0, n - len(parts[-1]))]
        assert {i for a, p in zip(at, parts) for i in range(a, a + len(p))} == set(range(n)) and max(map(len, parts)) <= 96
    assert windows("") == windows("42 <x@y>") == []


def test_no_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = train(empty)
    assert isinstance(model, ByteNetwork)
    assert languages(empty, model).count() == 0


def test_canonical():
    assert [canonical(x) for x in ("EN", "pt-BR", "French", "deu", "und", "", None)] == ["en", "pt", "fr", "de", None, None, None]


def test_text_helpers():
    assert repaired("HÃ¡ Ã\xa0 venda") == "Há à venda"
    assert plain("Übergröße É") == "ubergroße e"
    text = "One line\ncontinued. Two!\n\nThree"
    assert [text[a:b] for a, b in sentences(text)] == ["One line\ncontinued.", "Two!", "Three"]

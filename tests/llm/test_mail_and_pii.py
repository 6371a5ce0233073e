import pytest

from textloom.llm import mail, pii
from textloom.llm.practice import Writer, unmarked

POST = "post_id bigint, text string, line string"
TEXT = """From: Sanna Vexley <sanna.vexley@lorvik.example>
Newsgroups: sci.orbits
Subject: Re: probes
Message-ID: <88577302.742@grizorylin.edu.example>

Hello,
On 2 Nov 1994, Bram Tansgate wrote:
> Has anyone here launched a probe with the Velkor?
> Some say it is
overrated
> today.

The old probe worked better than anything else.

Regards,
-Sanna
-- 
Sanna Vexley
ph# 020 7946 0521"""


@pytest.fixture(scope="module")
def model():
    return mail.train(300, 3)


@pytest.fixture(scope="module")
def tagger():
    return pii.train(pii.labelled_table()[::2])


def test_newly_written_lines(spark, model):
    rows = [(1, TEXT, "x"), (2, TEXT.replace("\n", "\r\n"), None), (3, None, None), (4, "", None), (5, "only one line of text here.", None), (None, TEXT, None)]
    got = {}
    for r in mail.authored(spark.createDataFrame(rows, POST), model).collect():
        got.setdefault(r.post_id, []).append(r.line_no)
    assert sorted(got[1]) == sorted(got[2]) == [6, 13]
    assert set(got) <= {1, 2, 5}
    text = {r.post_id: r.text for r in mail.new_text(spark.createDataFrame(rows + rows[:1], POST), model).collect()}
    assert text[1] == "Hello,\nThe old probe worked better than anything else."


def test_mail_held_out_accuracy(model):
    right = total = 0
    for m, gold in mail.practice(80, seed=901):
        a = [p for lo, hi, p in gold for _ in range(lo, hi)]
        b = [p for lo, hi, p in model.decode(m) for _ in range(lo, hi)]
        right += sum((x == 1) == (y == 1) for x, y in zip(a, b))
        total += len(a)
    assert right >= 0.96 * total


def test_mail_empty_table(spark, model):
    df = spark.createDataFrame([], POST)
    assert mail.authored(df, model).count() == 0
    assert mail.new_text(df, model).count() == 0


def test_personal_data_held_out(tagger):
    writer, finder, hit, told, true = Writer(555), pii.Finder(tagger), 0, 0, 0
    for _ in range(60):
        shown, places, text = "", set(), ""
        for line, _ in writer.post():
            shown, found = unmarked(line)
            places |= {(a + len(text), k) for a, _, k in found}
            text += shown + "\n"
        got = {(a, k) for a, _, k in finder.find([text])[0]}
        hit, told, true = hit + len(got & places), told + len(got), true + len(places)
    assert hit >= 0.93 * told and hit >= 0.93 * true


def test_masking(spark, tagger):
    schema = "row_id bigint, text string, masked string"
    body = "You can reach me at sanna.vexley@lorvik.example most days."
    rows = [(1, body, "x"), (2, None, None), (3, "", None), (4, "no data " * 20_000, None), (None, body, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.row_id: (r.masked, r.n_places) for r in pii.found(df, tagger, "t", "row_id", masked=True).collect()}
    assert got[1] == ("You can reach me at [EMAIL] most days.", 1)
    assert got[3] == ("", 0) and set(got) == {1, 3, 4}
    assert [(r.pii_type, r.start_pos, r.end_pos) for r in pii.found(df, tagger, "t", "row_id").where("row_id = 1").collect()] == [("email", 20, 47)]
    assert pii.found(spark.createDataFrame([], schema), tagger, "t", "row_id").count() == 0


def test_senders_teach_names(tagger):
    post = "From: {0} <{1}@x.example>\nSubject: boats\nMessage-ID: <{2}.55@x.example>\n\nAs {0} told us, the boat is late.\nAsk {3} or {4}, the number is somewhere else.\n\n{3}"
    people = [("Quorra Lindquax", "Quorra"), ("Bastik Umbrell", "Bastik"), ("Teshi Vondrake", "Teshi")]
    texts = [post.format(full, f"u{i}", 7_000_000 + i, short, f"Dr. {people[i - 1][0].split()[1]}") for i, (full, short) in enumerate(people)]
    assert pii.senders(texts) == ({"quorra", "bastik", "teshi"}, {"lindquax", "umbrell", "vondrake"})
    named = set()
    for raw, labels in pii.taught(texts, tagger):
        named |= {w.strip() for w, k in zip(raw, labels) if k in (1, 2)}
    assert {"Quorra", "Lindquax", "Bastik", "Umbrell", "Teshi", "Vondrake"} <= named and not {"boat", "As", "x", "Subject"} & named


def test_training_without_mails(spark):
    df = spark.createDataFrame([(1, None, None)], POST)
    assert pii.Finder(pii.train_on(df)).find(["nothing here"]) == [[]]

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X

CASES = [
    ("Subject: Re: Re: hi\nFrom: x\n\nbody a\n> q\n  > q2\nb  c\n-- \nsig", "Re: hi. body a b c"), ("no blank\nSubject: z", "z."), ("\nSubject: in body\nt", "in body. Subject: in body t"),
    ("Subject:\n\nx\nSubject: later y\n", "later y. x Subject: later y"), ("Subject:   \n\nx y", "x y"), ("subject: FW:fwd: a\n\n-----BEGIN PGP SIGNED\nbody", "fwd: a."),
    ("Subject: s\r\n\r\nl1\r\nl2\r\n", "s. l1 l2"), ("Subject: u\n\na\x0bb\x0cc\x1cd\x85e f\xa0g　h", "u. a b c d e f g h"), ("Subject: s\n \t\n--x\n--\nz", "s. --x"), ("", ""), ("\n", ""),
    ("Subject: k\n\n" + " ".join(f"w{i}" for i in range(350)), "k. " + " ".join(f"w{i}" for i in range(300))), ("Subject: Re:\n\nabc", "abc"), ("a\n\nb\n\n\nc\n--\n", "b c"),
    ("Subject: \xe9 \xfc\n\n\xc0\xa0> no\n\xa0> yes", "\xe9 \xfc. \xc0 > no"), ("Subject: q\n\nx\n\n", "q. x"), (None, None),
]


def test_clean_post(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.clean_post(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c for _, c in CASES]


@pytest.mark.parametrize("n", [19, 20])
def test_minimum_length(spark, n):
    df = spark.createDataFrame([(" ".join("abc" for _ in range(n)),)], "t string")
    assert df.select(X.is_meaningful(F.col("t")).alias("k")).first().k == (n >= 20)


def test_ids_and_views(spark):
    raw = "größe ☃"
    r = spark.createDataFrame([(raw, 0.5, None)], "t string, v double, n double").select(
        X.content_id(F.col("t")).alias("id"), X.prefix(F.col("t"), 3).alias("p"), X.score_bar(F.col("v")).alias("b"), X.score_bar(F.col("n")).alias("na")
    ).first()
    assert r.id == hashlib.md5(raw.encode()).hexdigest()[:12] and r.p == "grö" and r.b == "#" * 10 + "." * 10 and r.na == "n/a"


def test_blank_is_what_python_splits_at(spark):
    chars = [chr(c) for c in range(1, 0x3001) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r.c for r in df.where(F.col("c").rlike(f"^{X.BLANK}$")).collect()}
    assert {c for c in chars if c.isspace()} <= got and all(not re.match(r"\w", c) for c in got)

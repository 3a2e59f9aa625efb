"""Cut texts: planted cuts, finished texts, marks, edge cases."""

import random

from pkgloom.llm import truncation as T

NOUNS = ["printer", "archive", "formatter", "session", "counter", "keyring", "library", "dashboard", "integrator", "scheduler"]
VERBS = ["validates", "rebuilds", "schedules", "compresses", "restarts", "annotates"]


def sentence(rnd):
    return f"The {rnd.choice(NOUNS)} {rnd.choice(VERBS)} every {rnd.choice(NOUNS)} behind the {rnd.choice(NOUNS)}."


def text(rnd, n):
    return " ".join(sentence(rnd) for _ in range(n))


def test_planted_cuts(spark):
    rnd = random.Random(2)
    whole = [(k, text(rnd, rnd.randint(4, 12)) + rnd.choice(["", "\n\nRegards,\nKorvane", "\n\nBack to top", "\n- Add the keyring", "\n```\nmake install\n```", "\n\nLet us see how this goes..."])) for k in range(200)]
    cuts = []
    for k in range(200, 260):
        t = text(rnd, 9)
        end = t.rfind(rnd.choice(NOUNS)) + rnd.randint(3, 4)
        cuts.append((k, t[:end] + rnd.choice(["", "", "...", "…", " (more", " [...]", "<", "-", "�"])))
    cuts += [(300, text(rnd, 3) + " The printer restarts the"), (301, text(rnd, 3) + " (closes #12")]
    bare = [(400 + k, text(rnd, 5)[:-1]) for k in range(20)]
    rows = [(i, "s", t) for i, t in whole + cuts + bare]
    got = {r.doc_id for r in T.cut_texts(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    want = {i for i, _ in cuts}
    assert got == want


def test_length_evidence(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join(rnd.choice(NOUNS) for _ in range(n))
    rows = []
    for k in range(60):
        rows.append((k, "a", f"{k} " + words(40)[: 200 + 3 * k] + "z"))
    for k in range(100, 112):
        rows.append((k, "b", (f"{k} " + words(60))[:300].rstrip().ljust(300, "x")))
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert {(r.source, r.n) for r in T.piled_lengths(T.features(df)).collect()} == {("b", 300)}


def test_edges(spark):
    rows = [(1, "s", None), (2, "s", ""), (3, None, "12345"), (4, None, "..."), (None, "s", "A line (more"), (5, "s", "word " * 40_000 + "end."), (5, "s", "word " * 40_000 + "end.")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id bigint, source string, text string, prefix string, n int")
    got = [r.doc_id for r in T.cut_texts(df).collect()]
    assert got == [None]
    rates = {r.source: (r.texts, r.cut_texts, r.rate) for r in T.cut_rates(df).collect()}
    assert rates == {"s": (5, 1, 0.2), "": (2, 0, 0.0)}
    assert T.cut_texts(df.where("false")).count() == 0
    twice = [(7, "s", "The printer restarts. Then the prin"), (7, "s", "The printer restarts. Then the prin"), (None, "s", "The printer restarts the pri")] + [(8, "s", "The printer restarts.")] * 3
    assert sorted(str(r.doc_id) for r in T.cut_texts(spark.createDataFrame(twice, "doc_id bigint, source string, text string")).collect()) == ["7", "7", "None"]


def test_copies_make_no_footer(spark):
    rnd = random.Random(6)
    rows = [(k, "s", text(rnd, 6)) for k in range(120)]
    rows += [(200 + k, "s", text(rnd, 5) + "\n\nReplies: keyr") for k in range(6)]
    torn = text(rnd, 5) + "\nThe printer restarts every form"
    rows += [(300 + k, "s", torn) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert {(r.last_line, r.c) for r in T.footers(T.features(df)).collect()} == {("Replies: keyr", 6)}
    assert {r.doc_id for r in T.cut_texts(df).collect()} == set(range(300, 360))
    assert [(r.texts, r.cut_texts) for r in T.cut_rates(df).collect()] == [(186, 60)]


def test_long_last_lines(spark):
    """What begins far before the end of the last line is seen, too."""
    rnd = random.Random(12)
    rows = [(k, "s", text(rnd, 8)) for k in range(80)]
    rows += [(100, "s", text(rnd, 3) + " (as told " + "the printer and " * 40 + "the printer"), (101, "s", text(rnd, 3) + " (as told the printer"), (102, "s", "x" * 900 + ". The printer (" + "x " * 300 + ")")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert {r.doc_id for r in T.cut_texts(df).collect()} == {100, 101}

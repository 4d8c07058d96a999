import random

from lumenframe.llm import jaccard, lines

DOCS = "doc_id long, text string, n_chars long"
LONG = "a line that is long enough to take part in the edit join"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], DOCS)


def test_short_lines_and_blank_leftovers_go(spark):
    text = f"Title\n\n{LONG}\n \t\r\nThe end."
    rows = [(0, text), (1, text), (2, f"Title\nnew words\n{LONG}"), (3, "\t\n"), (4, ""), (5, "so\nso\n\n"), (6, "so")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert got == {0: (text, len(text)), 2: ("new words", 9), 3: ("\t\n", 2), 4: ("", 0), 5: ("so\n\n", 4)}
    report = {r["doc_id"]: r["dropped"] for r in lines.line_report(docs(spark, rows), short=True).collect()}
    assert report == {0: [], 1: [0, 2, 4], 2: [0, 2], 3: [], 4: [], 5: [1], 6: [0]}


def test_exact_dedup_at_every_length_against_brute_force(spark):
    rng = random.Random(20)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 4))) for _ in range(30)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        expected[i] = []
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                if line in seen:
                    expected[i].append(k)
                seen.add(line)
    assert {r["doc_id"]: r["dropped"] for r in lines.line_report(docs(spark, enumerate(texts)), short=True).collect()} == expected


def test_lines_go_from_their_row_only(spark):
    a, b, c, d = (f"{w} {LONG} {w * 5}" for w in ("one", "unlike", "third", "fourth"))
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{b}"), (None, f"{a}\n{b}"), (7, f"{d}\nx"), (7, f"{a}\ny"), (7, f"{d}\nx"), (8, None), (8, None)]
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(docs(spark, rows).coalesce(1)).collect()]
    assert sorted(got, key=str) == sorted([(None, f"{a}\n{b}"), (None, c), (7, f"{d}\nx"), (7, "y"), (8, None), (8, None)], key=str)
    report = [(r["doc_id"], r["n_lines"], r["dropped"], r["source_docs"]) for r in lines.line_report(docs(spark, rows).coalesce(1), short=True).collect()]
    expected = [(None, 2, [], []), (None, 2, [1], []), (None, 2, [0, 1], []), (7, 2, [], []), (7, 2, [0], []), (7, 2, [0, 1], [7]), (8, 0, [], []), (8, 0, [], [])]
    assert sorted(report, key=str) == sorted(expected, key=str)


def test_keep_one_judges_rows(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    rows = [(5, one), (5, two), (3, one), (4, "alone"), (4, "alone"), (None, one), (None, "by itself"), (None, "By itself"), (6, None), (6, None), (6, " "), (None, ""), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs(spark, rows).coalesce(1)).collect()]
    expected = [(5, two), (3, one), (4, "alone"), (None, "by itself"), (6, None), (6, " "), (None, ""), (None, "")]
    assert sorted(got, key=str) == sorted(expected, key=str)

import duckdb
import pytest

from ridecast.llm import line_dedup
from ridecast.llm.queries import ORACLES, QUERIES

from .conftest import SF_SMALL


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def brute(rows):
    lines = [(i, n, tuple(line.split())) for i, t in sorted(rows) if t is not None for n, line in enumerate(t.split("\n")) if line.split()]
    out = []
    for k, (i, n, words) in enumerate(lines):
        for j, m, other in lines[:k]:
            near = words == other or (min(len(words), len(other)) >= 8 and distance(words, other) <= 1)
            if near:
                out.append((i, n, j, m))
                break
    return out


LONG = "one two three four five six seven eight nine ten"
ROWS = [
    (1, f"{LONG}\nshort line\n\n{LONG} eleven"),
    (2, f"{LONG.replace('five', 'FIVE')}\nshort line\nshort lane"),
    (3, LONG.replace("two ", "") + "\n" + LONG.replace("one ", "") + " x"),
    (4, LONG.replace("ten", "TEN") + "\n" + LONG.replace("one", "two").replace("ten", "y")),
    (5, None),
    (6, ""),
    (7, "ten nine eight seven six five four three two one\n" + LONG.replace("one two", "two one")),
    (8, "a a a a a a a a\na a a a a a a\na a a a a a a a a"),
    (9, "  " + LONG.replace(" ", "  ") + "\t\n \t "),
    (10, "b c d e f g h i\nb c d e f g h i j\nb c d e f g h"),
    (11, " ".join(f"w{i}" for i in range(3000)) + "\n" + " ".join(f"w{i}" for i in range(3000) if i != 1500)),
]


def test_equals_brute_force(documents):
    rows = line_dedup.repeated_lines(documents(ROWS)).collect()
    assert sorted((r["doc_id"], r["line_no"], r["first_doc_id"], r["first_line_no"]) for r in rows) == sorted(brute(ROWS))
    texts = {i: t.split("\n") for i, t in ROWS if t}
    for r in rows:
        a, b = texts[r["doc_id"]][r["line_no"]].split(), texts[r["first_doc_id"]][r["first_line_no"]].split()
        assert distance(a, b) == r["distance"]


@pytest.mark.parametrize("n", [7, 8, 9, 15, 16, 17, 31, 32])
def test_every_edit_of_a_line(documents, n):
    words = [f"v{i}" for i in range(n)]
    rows = [(0, " ".join(words))]
    for i in range(n):
        rows += [(3 * i + 1, " ".join(words[:i] + words[i + 1 :])), (3 * i + 2, " ".join(words[:i] + ["x"] + words[i + 1 :])), (3 * i + 3, " ".join(words[:i] + ["y"] + words[i:]))]
    got = line_dedup.repeated_lines(documents(rows)).collect()
    assert sorted((r["doc_id"], r["line_no"], r["first_doc_id"], r["first_line_no"]) for r in got) == sorted(brute(rows))


def test_many_lines_that_differ_in_one_word(documents):
    rows = [(i, f"please write to user{i} at the address below for details") for i in range(300)]
    got = line_dedup.repeated_lines(documents(rows)).collect()
    assert len(got) == 299 and {(r["first_doc_id"], r["distance"]) for r in got} == {(0, 1)}


def test_dropping_lines(documents):
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(documents(ROWS)).collect()}
    gone = {(i, n) for i, n, _, _ in brute(ROWS)}
    for i, text in ROWS:
        lines = (text or "").split("\n")
        left = [line for n, line in enumerate(lines) if (i, n) not in gone]
        if text is not None and len(left) < len(lines) and not any(x.strip() for x in left):
            assert i not in out
        else:
            assert out[i] == (None if text is None else "\n".join(left))


def test_odd_tables(documents):
    assert line_dedup.repeated_lines(documents(ROWS).where("false")).collect() == []
    assert line_dedup.drop_repeated_lines(documents(ROWS).where("false")).collect() == []
    twice = line_dedup.drop_repeated_lines(documents([(1, "a b"), (1, "a b"), (None, "a b"), (2, "c")]))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in twice.collect()) == [(0, "a b"), (2, "c")]
    assert twice.columns == documents([(1, "a")]).columns


def test_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    expected = connection.execute(ORACLES["op7_line_dedup"]).fetchall()
    df = QUERIES["op7_line_dedup"](spark, SF_SMALL)
    assert sorted(map(tuple, df.select("doc_id", "line_no", "first_doc_id", "first_line_no", "distance").collect())) == sorted(expected)


def test_no_python_in_the_plan(documents):
    plan = line_dedup.repeated_lines(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

from collections import defaultdict

from crawlspark.llm.line_dedup import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and i != max(holders[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def run(df):
    return sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(df).collect())


def test_against_brute_force(docs):
    shared, accents = "This line is shared by very many documents, I say", "É" * 40
    rows = [(i, f"own line {i} " + "w" * 40 + f"\n{shared.upper() if i % 2 else '  ' + shared}\t\n\n{shared}\nend") for i in range(6)]
    rows += [(10 + i, accents) for i in range(5)] + [(20 + i, "y" * 39) for i in range(6)] + [(30 + i, "z" * 40) for i in range(4)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, shared + "\n" + "k" * 100_000)]
    assert run(docs(rows)) == brute(rows)


def test_repeated_rows_and_other_columns(docs):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "other"), (None, "x")]
    out = line_dedup(docs(rows))
    assert out.count() == 4
    assert {r.score for r in out.collect()} == {"clash"} and out.columns.count("n_lines") == 1
    assert out.where("doc_id is null").first().text == "x"


def test_rows_that_repeat_an_id_are_one_document(docs):
    four, five = "f" * 40, "v" * 40
    rows = [(i, four) for i in (1, 1, 2, 3, 3, 4)] + [(i, f"{i}\n{five}") for i in (1, 1, 2, 3, 4, 5, 5)] + [(1, f"other\n{five}")]
    got = run(docs(rows))
    assert got == brute(rows)
    assert sum(r[3] for r in got) == 6


def test_null_id_is_the_smallest(docs):
    line = "l" * 50
    out = {r.doc_id: r.n_dropped for r in line_dedup(docs([(None, line), (1, line), (2, line), (3, line), (4, line)])).collect()}
    assert out == {None: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_empty_table(docs):
    assert line_dedup(docs([])).collect() == []

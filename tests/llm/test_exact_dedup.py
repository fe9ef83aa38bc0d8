from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from crawlspark.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    key = lambda i: -1 if i is None else i
    out = []
    for i, t in rows:
        keep = max(groups[t or ""], key=key)
        out.append((i, keep, len(groups[t or ""]), i == keep))
    return sorted(out, key=str)


def run(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()], key=str)


def test_cases(docs):
    long = "x" * 5000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, long + "y"), (8, long[:64]), (9, long[:64] + "z"), (7, long + "y"), (None, "a"), (None, "b"), (10, "é" * 40), (11, "é" * 40)]
    assert run(docs(rows)) == brute(rows)


def test_prefixes_at_level_borders(docs):
    rows = [(n, "q" * n) for n in (0, 1, 63, 64, 65, 1087, 1088, 1089, 17471, 17472, 17473)]
    rows += [(100 + n, t) for n, t in rows]
    assert run(docs(rows)) == brute(rows)


def test_empty_table(docs):
    assert exact_dedup(docs([])).collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n", max_size=3), max_size=20))
def test_against_grouping(docs, texts):
    rows = list(enumerate(texts))
    assert run(docs(rows)) == brute(rows)

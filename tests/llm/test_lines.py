"""Line dedup against counting sites in memory."""

import time

import pytest

from riskspark.llm import line_dedup


def expected(rows, min_sites):
    sites, first = {}, {}
    blanks = " \t\r\x0b\x0c"
    for doc_id, text, source in rows:
        for place, line in enumerate(text.split("\n") if text is not None else []):
            line = line.strip(blanks)
            if len(line) >= line_dedup.MIN_CHARS:
                sites.setdefault(line, set()).add(source)
                if doc_id is not None:
                    first[line] = min(first.get(line, (doc_id, place)), (doc_id, place))
    out = []
    for doc_id, text, source in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for place, x in enumerate(lines) if doc_id is None or len(sites.get(x.strip(blanks), ())) < min_sites
                or first[x.strip(blanks)] == (doc_id, place)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def spread_rows():
    rows = [(i, f"head {i}\nshared boilerplate line\n  padded boilerplate line \nshort\n", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, f"seldom seen line of {i % 5}\nshort", f"s{i % 4}") for i in range(30)]
    rows += [(200, "shared boilerplate line\nshared boilerplate line\nown text here", "s1"), (201, None, None), (202, "", "s1"),
             (None, "shared boilerplate line", "z"), (203, "shared boilerplate line", None), (3, "head 3\nother text of 3", "s3"),
             (39, rows[39][1], "s3")]
    return rows


@pytest.mark.parametrize("min_sites", [1, 2, 4, 10, 13, 14, 15])
def test_equals_counting(spark, min_sites):
    rows = spread_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = line_dedup.remove_boilerplate(docs, min_sites=min_sites)
    found = found.select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, min_sites)


def test_lines_near_the_threshold_are_counted_exactly(spark):
    spread = [(f"a line on {n} of the sites", f"site {k}") for n in range(950, 1051, 10) for k in range(n)]
    docs = spark.createDataFrame([(i, text, site) for i, (text, site) in enumerate(spread)], "doc_id long, text string, source string")
    lines = line_dedup.line_table(docs)
    assert line_dedup.spread_lines(lines, 1000).count() == sum(n >= 1000 for n in range(950, 1051, 10))


def test_a_text_of_many_lines_takes_linear_time(spark):
    many = "\n".join(f"a line with the number {i}" for i in range(50_000))
    docs = spark.createDataFrame([(i, f"{many}\nown line of {i}", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    start = time.monotonic()
    found = line_dedup.remove_boilerplate(docs).orderBy("doc_id").collect()
    assert time.monotonic() - start < 60
    assert [(r.n_lines, r.n_removed) for r in found] == [(50_001, 0)] + [(50_001, 50_000)] * 5
    assert [r.text for r in found] == [f"{many}\nown line of 0"] + [f"own line of {i}" for i in range(1, 6)]


def test_passage_on_a_few_sites_goes_and_clean_documents_stay(spark, folder):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own text of document {i}\n{passage}\nand its end {i}", f"s{i % 5}") for i in range(8)]
    rows += [(100 + i, f"clean text {i}\nof document number {i}", f"s{i % 3}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs).collect()}
    assert [found[i].n_removed for i in range(8)] == [0] + [1] * 7
    assert all(found[i].text == text for i, text, _ in rows[8:])


def test_odd_rows(odd, empty):
    out = line_dedup.remove_boilerplate(odd, min_sites=2)
    assert out.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert out.count() == odd.count()
    assert line_dedup.remove_boilerplate(empty).collect() == []

import hashlib
import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumaframe.llm import line_templates

from ..oracle import same
from .conftest import prose


def test_query_equals_its_sql(spark, sf):
    same(spark, sf, line_templates.op5_line_templates, line_templates.OP5_SQL)


def test_edges(edge_docs, edge_rows, no_docs):
    out = line_templates.drop_templates(edge_docs)
    assert out.columns == [c for c in edge_docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    rows = {(r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest()) for r in out.collect()}
    assert out.count() == len(edge_rows) and len(rows) == len({r[:2] for r in edge_rows})
    assert line_templates.drop_templates(no_docs).count() == 0
    names = ("__text_hash", "__gone", "text_hash", "gone", "lines", "row", "id", "hash")
    named = line_templates.drop_templates(edge_docs.withColumns({c: F.lit(c) for c in names})).select(*names).distinct().collect()
    assert [tuple(r) for r in named] == [names]


def test_variable_fields_and_counts(spark):
    rows = []
    for k in range(12):
        text = [prose(900 + k, 12).replace("\n", " "), f"Copyright {2000 + k} by Some Firm all rights", "", f"user name{'abcdefghijkl'[k]} logged in from the host"]
        if k < 4:
            text.append("seen in four documents only")
        rows.append((k, "\n".join(text)))
    rows += [(50, None), (None, "Copyright 1999 by Some Firm all rights"), (0, rows[0][1])]
    out = {(r["doc_id"], r["text"]): r for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), r in out.items():
        if i is None:
            assert text == "" and r["n_dropped"] == 1
        elif i == 50:
            assert text == "" and (r["n_lines"], r["n_dropped"]) == (1, 0)
        else:
            # The years are variable fields; the names differ and stand among the leading tokens, so those lines stay.
            assert "Copyright" not in text and "logged in" in text and (i < 4) == ("four" in text) and "\n\n" in text and r["n_dropped"] == 1


def test_prose_with_a_common_start_stays(spark):
    rows = [(k, "it was the " + " ".join(prose(700 + k, 30).replace("\n", " ").split()[:20])) for k in range(40)]
    assert line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").count() == 0


def brute(rows):
    """{line of a recurring template}, by loops over (doc_id, text)."""
    documents = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r"):
                documents[line].add(i)
    weight = {line: len(ids - {None}) for line, ids in documents.items()}
    words = {line: ["<*>" if re.search("[0-9]", w) else w for w in line.split(" ")] for line in documents}
    lead = line_templates.LEAD
    lines, tokens, owners, members = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for line, w in words.items():
        leaf = (len(w), *w[:lead])
        lines[leaf] += weight[line]
        tokens.update({(leaf, k, w[k]): weight[line] for k in range(lead, len(w))})
    for line, w in words.items():
        leaf = (len(w), *w[:lead])
        for share in line_templates.LEVELS:
            kept = [x if k < lead or not share or 100 * tokens[leaf, k, x] > share * lines[leaf] else "<*>" for k, x in enumerate(w)]
            if 100 * sum(x not in ("", "<*>") for x in kept) >= line_templates.CONSTANT * sum(x != "" for x in w):
                template = (share, tuple("<*>" if x == "" and k >= lead else x for k, x in enumerate(kept)))
                owners[template] |= documents[line] - {None}
                members[template].add(line)
        blank = [w[k] if k < lead or w[k] not in ("", "<*>") else "<*>" for k in range(len(w))]
        for k in range(lead, len(w)):
            kept = [*blank[:k], "<*>", *blank[k + 1 :]]
            if blank[k] != "<*>" and 100 * sum(x not in ("", "<*>") for x in kept) >= line_templates.CONSTANT * sum(x != "" for x in w):
                template = ("open", k, tuple(kept))
                owners[template] |= documents[line] - {None}
                members[template].add(line)
    return {line for t, ids in owners.items() if len(ids) >= line_templates.MIN_DOCS for line in members[t]}


def dropped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["n_dropped"]) for r in line_templates.drop_templates(docs).collect()}


def fields(n, copies=1):
    names = [f"{a}{b}" for a in ("an", "bo", "ci", "du", "ek", "fa", "gol", "hin", "ir", "ju") for b in ("na", "ri", "to", "ve", "zu", "la", "mi", "po", "se", "dy")]
    lines = [f"login accepted for {a} at the front gate of {b}" for a in names[:n] for b in names[50 : 50 + n]] * copies
    return list(enumerate(lines))


def test_against_loops(spark):
    rows = [(k, "\n".join([prose(k, 30), *(f"sent from my {w} phone on day {k}" for w in ("old", "new")[: k % 3]), "page  2 of  the same report"[: 10 + 3 * (k % 7)], "all rights of the house are kept" * (k % 2)])) for k in range(60)]
    rows += fields(5, 2) + [(None, "sent from my old phone on day 1"), (7, rows[7][1])]
    found = brute(rows)
    want = {(i, sum(x in found for x in (t or "").split("\n"))) for i, t in rows}
    assert dropped(spark, rows) == want and any(n for _, n in want)


def test_many_lines_of_one_document_are_one_document(spark):
    rows = [(1, "\n".join(f"item {k} costs 30 coins today" for k in range(6))), (2, prose(1, 30)), (3, prose(2, 30))]
    assert dropped(spark, rows) == {(1, 0), (2, 0), (3, 0)}
    rows += [(10 + k, f"item {k} costs 30 coins today") for k in range(4)]
    assert dropped(spark, rows) == {(1, 6), (2, 0), (3, 0)} | {(10 + k, 1) for k in range(4)}


def test_more_values_of_a_field_find_no_fewer_templates(spark):
    for n, copies in ((4, 1), (4, 2), (10, 1), (60, 1)):
        assert {k for _, k in dropped(spark, fields(n, copies))} == {1}


def test_a_hot_value_hides_no_template(spark):
    states = ["ok", "failed", "late", "slow", "lost"]
    rows = [(k, f"the nightly job ended in state {w}") for k, w in enumerate(states)]
    assert dropped(spark, rows) == {(k, 1) for k in range(5)}
    for hot in (1, 20, 100, 400):
        more = rows + [(100 + k, "the nightly job ended in state ok") for k in range(hot)]
        assert {n for _, n in dropped(spark, more)} == {1}, hot
    assert brute(more) == {t for _, t in more}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdef"), min_size=5, max_size=12), st.lists(st.sampled_from("abcdefg"), max_size=30), st.integers(0, 3))
def test_lines_that_go_in_a_part_go_in_the_whole(spark, few, more, place):
    """One field, any values, any numbers of them, and other lines in the same leaf."""
    words = "then all of them went to bed early".split()
    line = lambda v: " ".join([*words[: 3 + place], f"v{v}", *words[4 + place :]])
    part = [(k, line(v)) for k, v in enumerate(few)]
    whole = part + [(1000 + k, line(v)) for k, v in enumerate(more)] + [(2000 + k, f"then all of {v} else") for k, v in enumerate("xyz")]
    small = {i for i, n in dropped(spark, part) if n}
    assert small <= {i for i, n in dropped(spark, whole) if n} and len(small) == len(few)


def test_two_templates_of_a_leaf(spark):
    lines = ["by the way we close the doors at night", "by the way she paints small boats of wood"]
    assert {k for _, k in dropped(spark, [(k, lines[k % 2]) for k in range(20)])} == {1}


def test_one_python_free_plan(spark, sf):
    plan = line_templates.op5_line_templates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

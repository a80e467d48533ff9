import time

import compare
import numpy as np

from lodestone.llm import lines


def brute(rows):
    """(id, text) in order of (id, first come): each line where it first stands."""
    seen, out = set(), []
    for i, text in sorted(dict.fromkeys(rows), key=lambda r: r[0]):
        if text is None or not text.replace("\n", "").replace(" ", ""):
            out.append((i, text))
            continue
        left, new = [], False
        for line in text.split("\n"):
            key = line.strip(" ")
            if not key:
                left.append(line)
            elif key not in seen:
                seen.add(key)
                left.append(line)
                new = True
        if new:
            out.append((i, "\n".join(left)))
    return sorted(out)


def test_matches_brute_force_for_any_batches_and_fanout(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "\n".join(rng.choice(["", " "] + [f"line {x} " for x in range(60)], rng.integers(1, 9)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for batches, fanout in ((1, 2), (4, 3), (7, 2)):
        assert sorted(map(tuple, lines.dedup_lines(docs, batches, fanout).collect())) == want


def test_query_equals_sql(spark):
    from lodestone.llm.queries import ORACLES, QUERIES

    assert compare.difference(QUERIES["op9_line_dedup"](spark, compare.SF), ORACLES["op9_line_dedup"], compare.connection()) == ""


def test_edges(spark, edge_docs, no_docs):
    got = lines.dedup_lines(edge_docs)
    assert got.schema == edge_docs.schema
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.select("doc_id", "text").collect())
    long = [t for i, t in rows if i == 6]
    assert len(long) == 1 and long[0].count("line59999") == 1
    # of the equal rows 1, 1 and 2 the first stays; equal rows without id are one; texts without lines stay
    assert [i for i, _ in rows] == [-9, -1, -1, 1, 3, 4, 5, 6, 7, 8, 9223372036854775807]
    assert lines.dedup_lines(no_docs).count() == 0
    assert spark.sql("SHOW TABLES").where("tableName like 'lodestone_run%'").count() == 0


def test_many_lines_take_time_in_proportion(spark):
    n = 200_000
    text = "\n".join(f"row {i % (n // 2)}" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "row 5\nnew\n\nrow 7"), (-(1 << 63), "row 5\nthe least id"), (None, "row 5\nthe least id")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs, 2).collect()}
    assert time.time() - began < 60
    assert got == {None: "row 5\nthe least id", 1: "\n".join(f"row {i}" for i in range(n // 2) if i != 5), 2: "new\n"}


def test_store_is_reopened_by_a_later_job(spark, tmp_path):
    def batch(rows):
        return lines.explode_lines(spark.createDataFrame(rows, "doc_id long, text string"))

    path = f"file://{tmp_path}/store"
    store, seen = lines.LineStore(spark, 2, 3, path), set()
    rng = np.random.default_rng(7)
    for job in range(6):
        text = [f"line {x}" for x in rng.integers(0, 60, 25)]
        new = store.add(batch([(job, "\n".join(text))]))
        assert new.count() == len(set(text) - seen)
        seen |= set(text)
        store.detach()
        store = lines.LineStore.open(spark, path, 2)
        assert sum(r.count() for r in store.runs()) == len(seen) and store.buckets == 3
    assert len(store.levels) > 1
    plan = store.runs()[0].join(store.runs()[-1].hint("merge"), ["h1", "h2"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store.close()

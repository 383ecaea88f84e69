import math
from collections import Counter

import duckdb
import pytest

from millrace.functions import tokens as T
from millrace.plans import catalog
from tests import oracle

SQL = catalog.ORACLE_SQL["feat_tfidf"]


def weights(rows, terms, low=1, high=4):
    """Plain TF-IDF of (key, bytes) rows by the definition: rows of one key count as one."""
    tf = {}
    for key, text in rows:
        own = tf.setdefault(key, Counter())
        own.update((text or b"")[k : k + n].hex() for n in range(low, high + 1) for k in range(len(text or b"") - n + 1))
    total, df = Counter(), Counter()
    for own in tf.values():
        total.update(own)
        df.update(own.keys())
    best = sorted(total, key=lambda t: (-total[t], t))[:terms]
    w = {(key, t): own[t] * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for key, own in tf.items() for t in best if t in own}
    norm = Counter()
    for (key, _), x in w.items():
        norm[key] += x * x
    return {k: x / math.sqrt(norm[k[0]]) for k, x in w.items()}


ODD = [(1, b"abcabcabd"), (2, None), (3, b""), (4, b"a"), (5, b"\x00\x00\x00\x00\x00"), (6, b"\xff\x00\xffab"), (7, bytes(range(256)) * 3), (8, "héllo".encode())]


@pytest.mark.parametrize("rows", [ODD, [*ODD, (1, b"abd"), (1, None), (None, b"ab"), (None, b"cabca")], [(1, None)], [(None, b"abc")], []])
@pytest.mark.parametrize("terms", [3, 40, 200_000])
def test_weights_of_odd_rows(spark, monkeypatch, rows, terms):
    for piece, held in ((7, 5), (1 << 16, 1 << 20)):
        monkeypatch.setattr(T, "PIECE", piece)
        monkeypatch.setattr(T, "HELD_RUNS", held)
        found = T.tfidf(spark.createDataFrame(rows, "id int, b binary"), "id", "b", terms=terms).collect()
        wanted = weights(rows, terms)
        assert len(found) == len(wanted)
        assert {(r[0], r[1]): r[2] for r in found} == pytest.approx(wanted)


@pytest.mark.parametrize(("low", "high"), [(2, 3), (7, 7), (1, 7)])
def test_other_lengths_and_kinds_of_keys(spark, low, high):
    rows = [(f"k{k}", text) for k, text in ODD] * 2 + [(f"m{k}", b"abcabcabc%d" % k) for k in range(70)]
    found = T.tfidf(spark.createDataFrame(rows, "id string, b binary"), "id", "b", low, high, 500).collect()
    assert {(r[0], r[1]): r[2] for r in found} == pytest.approx(weights(rows, 500, low, high))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_sums_are_shuffled(spark, data):
    """Neither terms nor texts are dealt out: the plan that yields the weights has no exchange."""
    df = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "CAST(text AS BINARY) AS b")
    for found in (T.tfidf(df, "doc_id", "b"), catalog.QUERIES["feat_tfidf"](spark, data)):
        assert "Exchange" not in plan(found) and "Generate" not in plan(found)


def tables(spark, folder, texts, labels):
    spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_query_with_a_null_id(spark, tmp_path):
    """Ids occur once: for others the SQL's windows leave open which text's byte is next."""
    tables(spark, tmp_path, [(1, "one text, one more"), (2, None), (None, "no id, again no id"), (3, ""), (4, "one text")], [(1, 0, 1), (4, 1, 0), (None, 1, 1), (None, 1, 1)])
    df = catalog.QUERIES["feat_tfidf"](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = c.sql(SQL)
    assert oracle.rows(df.columns, df.collect()) == oracle.rows(list(sql.columns), sql.fetchall())


def test_query_with_several_labels_of_an_id(spark, tmp_path):
    tables(spark, tmp_path, [(1, "one text"), (2, "one more"), (3, None)], [(1, 0, 1), (1, 1, 1), (2, 1, 1)])
    found = catalog.QUERIES["feat_tfidf"](spark, str(tmp_path)).collect()
    wanted = weights([(1, b"one text"), (1, b"one text"), (2, b"one more"), (3, None)], 200_000)
    assert {(r[0], r[1]): r[2] for r in found} == pytest.approx(wanted, abs=6e-7)

"""The queries of spanlight.llm and the pipeline on the smallest tables."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlight.llm import cotraining, order_minhash, training_order
from spanlight.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([canon(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([canon(r[i]) for i in at]) for r in want.fetchall())


def test_base_columns_of_the_rules(spark, duck):
    rows = {r[0]: r[1] for r in duck.sql("select doc_id, text from documents").fetchall()}
    for r in QUERIES["op5_ngram_llr"](spark, SF).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))


@pytest.mark.parametrize("name", ["op1_pii_surrogates", "op2_order_minhash", "op3_co_training"])
def test_a_row_for_each_document(spark, name):
    ids = sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_near_duplicates_against_all_pairs(spark):
    """Every pair that aligns shares a class, and every class is linked by pairs that align."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_order_minhash"](spark, SF).collect()}
    names: dict[str, int] = {}
    sequence = {d: np.array([names.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), w), len(names)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")], np.uint64) for d, t in rows.items()}
    linked = defaultdict(set)
    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sequence[a], sequence[b]
            limit = order_minhash.allowed(max(len(x), len(y)), 0.8)
            if len(x) and len(y) and abs(len(x) - len(y)) <= limit and order_minhash.alignment_distance(x, y, limit) <= limit:
                linked[a].add(b)
                linked[b].add(a)
                if max(len(x), len(y)) >= 20:  # a shorter text may keep no five words in a row
                    assert classes[a] == classes[b], (a, b)
    for d, c in classes.items():
        reached, todo = {d}, [d]
        while todo:
            for n in linked[todo.pop()] - reached:
                reached.add(n)
                todo.append(n)
        assert c in reached


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SF).cache()
        kept.append(out)
        if name != names[-1]:
            assert out.columns == docs.columns and out.exceptAll(docs).filter("false").count() == 0
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(kept[1]) == ids(cotraining.classify(docs, labels).filter("kept").select("row.doc_id"))
    classes = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(kept[1]).collect()}
    assert sorted(ids(kept[2])) == sorted(set(classes.values()))
    items = QUERIES["op7_decontaminate"](spark, SF).filter("contaminated")
    assert ids(kept[3]) == sorted(set(ids(kept[2])) - set(ids(items)))
    times = kept[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"] for r in times} <= set(ids(kept[3])) and max(r["n"] for r in times) <= 3
    decode = training_order.encoding().decode
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = defaultdict(lambda: defaultdict(list))
    for r in kept[5].collect():
        pieces[r["doc_id"]][r["seq"]].append(np.frombuffer(r["ids"], np.uint16)[: r["n_tokens"]])
    n_of = {r["doc_id"]: r["n"] for r in times}
    assert set(pieces) == set(n_of)
    for d, by_seq in pieces.items():
        assert all(len(v) == n_of[d] for v in by_seq.values())
        assert decode(np.concatenate([by_seq[s][0] for s in sorted(by_seq)])[:-1].tolist()) == texts[d]
    again = corpus_pipeline.run(spark, SF)
    assert again.count() == kept[5].count()


def test_classifier_on_held_out_labels(spark):
    """Fitted on the labels of two documents in three, some 2,650, it agrees with the rest of them."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = cotraining.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter(~held)).select("row.doc_id", "kept")
    told = out.join(labels.filter(held), "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    good = [r["kept"] for r in told if r["good"]]
    bad = [r["kept"] for r in told if not r["good"]]
    assert len(told) > 1000 and np.mean(good) > 0.98 and np.mean(bad) < 0.1, (len(told), np.mean(good), np.mean(bad))

"""The pipeline against brute force, stage by stage, and the queries with SQL."""

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import pii_surrogates, quality_ftrl, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[k] for k in columns)) for r in df.collect())
    result = c.execute(queries.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    assert rows == sorted(repr(tuple(dict(zip(found, r, strict=True))[k] for k in columns)) for r in result.fetchall())


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "personal_data", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, unique, safe, packed = ({r.doc_id: r for r in f.collect()} if k < 4 else f.collect() for k, f in enumerate(frames))
    assert all(f.columns == docs.columns for f in frames[:4])

    scores = {r.doc_id: r.score for r in quality_ftrl.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(good) == {d for d in raw if scores[d] >= 0.3} and all(good[d] == raw[d] for d in good)

    sets = {d: shingles(r.text) for d, r in good.items()}
    root = {d: d for d in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(unique) == {d for d in ids if find(d) == d} and all(unique[d] == good[d] for d in unique)

    assert set(safe) == set(unique)
    changed = {d for d in safe if safe[d].text != unique[d].text}
    direct = pii_surrogates.replace_entities(frames[2], "any", count_col="c").where("c > 0").collect()
    assert changed == {r.doc_id for r in direct} and all(safe[d].n_chars == len(safe[d].text) for d in safe)

    assert {r.doc_id for r in packed} == set(safe)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, and columns of other names."""
    from pyspark.sql import functions as F

    long = " ".join(f"long{k}" for k in range(60_000))
    rows = [(1, "some plain words stand here and there", "en"), (2, None, None), (3, "", "en"), (4, "call +1 743 555 3824 now please my friend", None), (4, "another text with the same id as before", "de")]
    rows += [(None, "a row without an id has words too", "en"), (None, None, None), (5, long, "fr"), (6, long + " end", "fr"), (7, "twice the same row of plain words", "en"), (7, "twice the same row of plain words", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", None if t is None else len(t), 1, "q") for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, `row` int, `do.c` string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], str(tmp_path)).cache())
    assert all(f.columns == docs.columns for f in frames[:4])
    assert frames[1].count() == len(rows)  # no labels: nothing is rejected
    kept = sorted(((r.doc_id, (r.text or "")[:12]) for r in frames[2].collect()), key=str)
    want = sorted({(i, (t or "")[:12]) for i, t, _ in rows if i != 6}, key=str)
    assert kept == want
    safe = {(r.doc_id, r.lang): r for r in frames[3].collect()}
    assert "555 3824" not in safe[4, None].text and safe[5, "fr"].text == long and safe[2, None].text is None
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r["do.c"] == "q" for r in safe.values())
    packed = frames[4].groupBy("doc_id", "piece").agg(F.count("*").alias("n"), F.sum("length").alias("ids")).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in frames[3].collect()} and sum(r.ids for r in packed if r.doc_id == 2) == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_run_leaves_only_its_result(spark, tmp_path):
    from pathlib import Path

    from tidemark.llm import scratch

    root = Path(scratch.shared_dir(spark).removeprefix("file://")) / "tidemark"
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    left = {p.name.split("-")[0] for p in root.iterdir() if p.name not in before and not p.name.endswith(".crc")}
    assert left == {"stage"}


def test_tables_live_as_long_as_they_are_read(spark):
    from pathlib import Path

    from tidemark.llm import scratch

    seen = []

    @scratch.operator
    def twice(df):
        one = scratch.materialize(df, "one")
        two = scratch.materialize(one.where("id > 1"), "two")
        seen.extend(sorted(scratch.read_by(one) | scratch.read_by(two)))
        return two.where("id < 5")

    with scratch.scope(spark):
        out = twice(spark.range(10))
        assert [Path(p).exists() for p in seen] == [False, True] and out.count() == 3
    assert not any(Path(p).exists() for p in seen)
    for form in ("file:/a/b/", "file:///a/b", "/a/b", "hdfs://host:1/a/b"):
        assert scratch._bare(spark, form) == "/a/b"

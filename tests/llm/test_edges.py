"""Nulls in every column, empty tables, very long texts, ties, repeated rows and clashing names, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strandweave.llm import cotrain, decontaminate, packing, passages, pii, quality_rules, shards, simhash, token_file, url_rules

from test_ops import prose

NAMES = ["th", "extra", "x_id", "x_th", "spans", "h", "v", "k", "n", "fp", "root", "rep", "kind", "start", "ids", "words", "style", "fh", "path", "rows", "bytes", "tier", "_metadata", "item_id", "u", "term", "df", "base", "result", "part", "before", "y", "rule", "verdict", "host", "t", "bad", "items", "row", "token"]
LABELS = "doc_id long, quality int, toxic int"


def documents(spark):
    long = prose(30_000, "long")
    texts = [None, "", " \n\t", "one", prose(80, 1), prose(80, 1), prose(80, 2) + " a@b.example 10.0.0.1", "la " * 200, "x" * 300_000, long, long + " tail", prose(80, 3), prose(80, 4)]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None if k % 4 == 0 else 9) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[4], None, None, None), (None, None, None, None, None), (None, None, None, None, None), (4, "another text of the same id", "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(7) for c in NAMES}).repartition(3), len(rows)


@pytest.fixture(scope="module")
def tables(spark):
    d, n = documents(spark)
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(13)] + [(4, 0, 0), (4, None, None), (None, 1, 0), (5, None, None)], LABELS).withColumns({c: F.lit("z") for c in NAMES})
    bench = spark.createDataFrame([(1, prose(80, 3)), (1, prose(80, 3)), (None, prose(80, 4)), (2, None), (3, "")], "item_id long, text string").withColumns({c: F.lit(1) for c in NAMES if c != "item_id"})
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate([None, "", "http://", "://a.net/es/x", "http://a.org/x y?q&r=1#f", "http://" + "b." * 20_000 + "com/" + "z/" * 20_000, "http://a.org/x", "http://a.org/x"])] + [(None, "http://a.org/x", "h"), (6, "http://a.org/x", None)], "page_id long, url string, html string").withColumns({c: F.lit(7) for c in NAMES if c != "page_id"})
    return d, n, labels, bench, pages


OPS = {
    "op1": lambda d, l, b, p: url_rules.judge(p, l),
    "op2": lambda d, l, b, p: pii.find(d),
    "op3": lambda d, l, b, p: cotrain.score(d, l),
    "op4": lambda d, l, b, p: shards.shard(d),
    "op5": lambda d, l, b, p: passages.digest(d),
    "op5 strip": lambda d, l, b, p: passages.strip(d),
    "op6": lambda d, l, b, p: packing.pack(d),
    "op7": lambda d, l, b, p: decontaminate.leaks(d, b),
    "op8": lambda d, l, b, p: token_file.round_trip(d),
    "op9": lambda d, l, b, p: quality_rules.judged(d, l),
    "op10": lambda d, l, b, p: simhash.near_classes(d),
    "base urls": lambda d, l, b, p: url_rules.judge_base(p),
    "base pii": lambda d, l, b, p: pii.count_base(d),
    "base quality": lambda d, l, b, p: quality_rules.judge_base(d),
}
STAGES = {
    "quality": lambda d, l, b: quality_rules.keep_clean(d, l),
    "near": lambda d, l, b: simhash.keep_one(d),
    "leaks": lambda d, l, b: decontaminate.drop_leaks(d, b),
    "pii": lambda d, l, b: pii.sanitise(d),
}


@pytest.mark.parametrize("name", OPS)
def test_operator_on_odd_rows(tables, name):
    d, n, labels, bench, pages = tables
    got = OPS[name](d, labels, bench, pages).toPandas()
    if name in ("op1", "base urls"):
        assert len(got) == 10
    elif name == "op6":
        assert (got.start == 0).sum() == n and got.groupby("sequence_id").length.sum().le(2048).all()
    elif name == "op7":
        assert set(got.doc_id) == {11, 12} and len(got) == 3  # the repeated item twice
    else:
        assert len(got) == n


@pytest.mark.parametrize("name", OPS)
def test_operator_on_empty_tables(spark, tables, name):
    d, _, labels, bench, pages = tables
    assert OPS[name](d.limit(0), labels.limit(0), bench.limit(0), pages.limit(0)).count() == 0
    assert OPS[name](d.limit(0), labels, bench, pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_odd_and_empty_tables(tables, name):
    d, n, labels, bench, _ = tables
    got = STAGES[name](d, labels, bench)
    assert got.columns == d.columns
    rows = got.select("doc_id", "text").toPandas()
    if name == "pii":
        assert len(rows) == n and rows.text.isna().sum() == 3 and "[EMAIL] [IP]" in " ".join(rows.text.dropna())
    elif name == "near":
        assert rows.doc_id.tolist().count(4) <= 2 and 5 not in rows.doc_id.tolist()  # 5 has the text of 4
    elif name == "leaks":
        assert len(rows) == n - 2
    else:
        assert not {0, 1, 2, 3, 7} & set(rows.doc_id.dropna())
    assert STAGES[name](d.limit(0), labels.limit(0), bench.limit(0)).count() == 0
    assert STAGES[name](d.limit(0), labels, bench).columns == d.columns


def test_whole_pipeline_on_odd_and_empty_tables(spark, tables, tmp_path):
    d, _, labels, bench, _ = tables
    for name, some in (("odd", (d, labels, bench)), ("empty", (d.limit(0), labels.limit(0), bench.limit(0)))):
        for t, df in zip(("documents", "labels", "benchmark"), some):
            df.write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").toPandas()
        assert out.columns.tolist() == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
        assert (len(out) > 0) == (name == "odd") and not {11, 12} & set(out.doc_id)

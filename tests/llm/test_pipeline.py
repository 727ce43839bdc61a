"""The stages together against brute force, and every registered text query."""

from collections import Counter

import numpy as np

import corpus_pipeline
from rankmill.llm import decontaminate, toxicity
from rankmill.llm.common import stored
from rankmill.llm.queries import QUERIES, byte_bpe
from rankmill.llm.sql import STATEMENTS
from tests.llm.helpers import documents, exact_groups, near_groups, texts
from tests.llm.test_groups import exact_left, near_left, repeated_keys


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = list(model.scores((t or "").encode() for _, t in rows))
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    kept = {i for i, _, _, keep, _ in exact_groups(rows) if keep}
    rows = [r for r in rows if r[0] in kept]
    kept = {i for i, _, component in near_groups(rows) if i == component}
    rows = [r for r in rows if r[0] in kept]
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(list(enumerate(items)))
    rows = [r for r in rows if not matcher.find(decontaminate.plain(r[1]))]
    own = byte_bpe().made()[0]
    want = {i: (t, tuple(own.encode_ordinary(t))) for i, t in rows}
    got = {r.doc_id: (r.text, tuple(np.frombuffer(r.tokens, "<u4").tolist())) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def through_stages(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def test_awkward_documents_go_through_all_stages(spark, sf_dir):
    """Missing and empty texts, repeated and missing keys, repeated rows, extra columns, an item of the benchmark."""
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = texts() + repeated_keys() + [(70, "before " + items[0] + " behind"), (71, items[1].upper())]
    docs = documents(spark, rows)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = [r for r, s in zip(rows, model.scores((t or "").encode() for _, t in rows)) if s < 0.5]
    left = near_left(sorted(exact_left(left).elements(), key=repr))
    matcher = decontaminate.Matcher(list(enumerate(map(decontaminate.plain, items))))
    want = Counter({r: n for r, n in left.items() if not matcher.find(decontaminate.plain(r[1]))})
    got = through_stages(spark, docs, sf_dir).collect()
    squeezed = lambda counts: Counter({(i, "".join(t.split())): n for (i, t), n in counts.items()})  # noqa: E731 - ties
    assert squeezed(Counter((r.doc_id, r.text) for r in got)) == squeezed(want)
    own = byte_bpe().made()[0]
    assert all(np.frombuffer(r.tokens, "<u4").tolist() == own.encode_ordinary(r.text) and r.n_tokens * 4 == len(r.tokens) for r in got)
    assert not {70, 71} & {r.doc_id for r in got}


def test_an_empty_table_goes_through_all_stages(spark, sf_dir):
    assert through_stages(spark, documents(spark, []), sf_dir).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(STATEMENTS) <= set(QUERIES)


def test_queries_return_a_row_for_each_row(spark, sf_dir):
    sizes = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("documents", "pages")}
    for name, query in QUERIES.items():
        if name not in ("op2_decontaminate", "op3_secrets", "op10_exact_dedup"):  # the last two are compared with SQL
            assert query(spark, sf_dir).count() == sizes["pages" if "url" in name else "documents"], name

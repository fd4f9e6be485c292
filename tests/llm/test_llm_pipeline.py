"""The pipeline and the registered queries, held against plain versions on the small tables."""


import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from postkit.llm import minhash
from postkit.llm.tokenizer import DEFAULT_RANKS, Counter, load_ranks
from postkit.session import materialize
from tests_llm_plain import brute_links, connected, plain_contaminated, plain_lines, plain_near

SF = "/root/testdata/sf0.001"


def collect(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages_keep_columns_and_clean_documents(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    before, after = collect(steps[0]), collect(steps[1])
    assert all(any(c.isalpha() for c in before[i].text or "") for i in after)
    assert len(after) >= 0.99 * len(before)


def test_line_stage_equals_plain(steps):
    want = plain_lines([(r.doc_id, r.text) for r in collect(steps[1]).values()])
    got = {i: r.text for i, r in collect(steps[2]).items()}
    for i, (text, dropped) in want.items():
        if dropped and not text.strip():
            assert i not in got
        else:
            assert got[i] == text
    assert all(r.n_chars == len(r.text) for r in collect(steps[2]).values() if want[r.doc_id][1])


def test_near_duplicate_stage_equals_plain(spark, steps):
    texts = {i: r.text for i, r in collect(steps[2]).items()}
    idf = minhash.idf_table(steps[2], "text", 5)
    assert sorted(collect(steps[3])) == plain_near(texts, idf)


def test_decontamination_stage_equals_plain(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = collect(steps[3])
    bad = plain_contaminated([(i, r.text) for i, r in rows.items()], items)
    assert sorted(collect(steps[4])) == sorted(set(rows) - bad)


def test_packing_stage_places_all_that_is_left(steps):
    count = Counter(load_ranks(DEFAULT_RANKS))
    left, packed = collect(steps[4]), collect(steps[5])
    assert sorted(packed) == sorted(left)
    assert all(packed[i].n_tokens == count(left[i].text) for i in left)
    assert len({(r.bucket, r.batch, r.slot) for r in packed.values()}) == len(packed)


def test_pipeline_run_is_its_stages(spark, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, steps[5].collect()))


def test_pipeline_takes_empty_tables(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_pass_on_columns_of_any_name(spark, steps):
    clashing = ["__id", "__ID_", "__th", "__h", "__lines", "__n_dropped", "__n_lines", "__data", "__words", "__dc_spans", "__text", "__score", "extra_0", "id", "th",
                "node", "component", "a.b", "score"]
    plain = steps[0].where("doc_id < 120")
    docs = materialize(plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clashing]), "clash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, docs = (materialize(stage(spark, df, SF), "clash") for df in (plain, docs))
        assert docs.columns == [*plain.columns, *clashing]
        assert sorted(map(str, docs.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        for c in clashing:
            assert docs.where(F.col(f"`{c}`") != F.concat(F.lit(c), F.col("doc_id").cast("string"))).count() == 0
    assert corpus_pipeline.pack(spark, docs, SF).count() == corpus_pipeline.pack(spark, plain, SF).count() > 0


def test_workers_need_no_package(tmp_path):
    """A driver that alone has the package on its path; the workers are started in another folder."""
    job = tmp_path / "job.py"
    job.write_text(f"""import sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from postkit.session import build_session
from postkit.llm.queries import QUERIES
spark = build_session("local[2]", shuffle_partitions=2, app="away")
small = {str(tmp_path / "tables")!r}
for name, rows in (("documents", 150), ("labels", 400)):
    spark.read.parquet(f"{SF}/{{name}}.parquet").orderBy("doc_id").limit(rows).write.parquet(f"{{small}}/{{name}}.parquet")
print("ROWS", QUERIES["op1_toxicity"](spark, small).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 150" in done.stdout, done.stderr[-2000:]


# ---- queries without SQL ------------------------------------------------------------------

def test_language_query_on_held_out_rows(spark):
    got = collect(queries()["op4_language_id"](spark, SF))
    docs = collect(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(got) == sorted(docs)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.95 * len(held)


def test_near_duplicate_query_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {i: r.text for i, r in collect(docs).items()}
    got = {i: r.class_id for i, r in collect(queries()["op5_minhash_dedup"](spark, SF)).items()}
    assert got == connected(texts, minhash.idf_table(docs, "text", 5))


def test_vector_query_equals_plain(spark):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in queries()["op6_embedding_dedup"](spark, SF).collect())
    assert got == sorted(brute_links(vectors))


def test_token_query_equals_plain(spark):
    count = Counter(load_ranks(DEFAULT_RANKS))
    lengths = [count(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.n_tokens: r for r in queries()["op7_token_counts"](spark, SF).collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r.n_docs == lengths.count(n) and r.truncated_total == sum(min(n, x) for x in lengths)


def test_page_query_reads_the_article(spark):
    import html
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries()["op9_html_text"](spark, SF).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|h2|ul|li)[^>]*>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_toxicity_query_scores_every_document(spark):
    got = collect(queries()["op1_toxicity"](spark, SF))
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_packing_query_places_every_document(spark):
    got = queries()["op10_packing"](spark, SF).collect()
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()

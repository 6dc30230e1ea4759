import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from ridecast.llm.queries import QUERIES

from .conftest import SF_SMALL
from .test_line_dedup import brute as repeated_lines
from .test_ngram_join import brute as components
from .test_tokens import check_pieces


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_deduplication", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_every_stage_against_plain_python(spark, documents):
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = documents([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 34"), (10**6 + 3, "12 34")]).drop("extra").to(base.schema)
    docs = base.limit(120).unionByName(extra).cache()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["language_id"](spark, docs, SF_SMALL).cache()
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == base.columns and before.keys() - after.keys() == {10**6 + k for k in range(4)}

    docs, before = stages["line_deduplication"](spark, docs, SF_SMALL).cache(), after
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    gone = {(i, n) for i, n, _, _ in repeated_lines(list(before.items()))}
    expected = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before.items()}
    assert after == {i: t for i, t in expected.items() if t.strip()} and docs.columns == base.columns
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs, before = stages["near_duplicates"](spark, docs, SF_SMALL).cache(), after
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(after) == sorted(i for i, _, c in components(list(before.items()), 5, 80, 100) if i == c)

    docs, before = stages["benchmark_decontamination"](spark, docs, SF_SMALL).cache(), after
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert {i for i, t in before.items() if any(x in t for x in items)} <= before.keys() - after.keys()
    assert len(after) >= 0.85 * len(before) and docs.columns == base.columns

    check_pieces(stages["best_fit_packing"](spark, docs, SF_SMALL).collect(), list(after.items()))


ROWS = [
    (1, "The old bridge over the river was closed for repairs until spring", "en"),
    (1, "A second text with the same number but quite other words in it", "en"),
    (None, "Without a number this text is still a document like any other", "en"),
    (None, "Another one without a number and with words of its own here", None),
]


def test_stages_take_odd_tables(spark, documents):
    odd = documents([*ROWS, (5, None), (6, "")]).withColumn("line_no", F.lit(1)).withColumn("_held", F.lit(2)).withColumn("component_id", F.lit(3))
    odd = odd.withColumn("item_id", F.lit(4)).withColumn("first", F.lit(5))
    texts = {text for _, text, _ in ROWS}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, odd, SF_SMALL)
        assert left.columns == corpus_pipeline.COLUMNS and texts <= {r["text"] for r in left.collect()}, name
        assert stage(spark, odd.where("false"), SF_SMALL).collect() == [], name
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r["doc_id"] for r in stage(spark, odd, SF_SMALL).collect()} == {1, None, 5, 6}
    assert stage(spark, odd.where("false"), SF_SMALL).collect() == []


def test_without_a_language_to_learn_all_rows_stay(spark, documents):
    docs = documents([(i, text) for i, text, _ in ROWS])
    kept = corpus_pipeline.language_id(spark, docs, SF_SMALL).collect()
    assert sorted(r["text"] for r in kept) == sorted(text for _, text, _ in ROWS)


def test_a_contaminated_row_without_an_id_goes(spark, documents):
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first()["text"]
    docs = documents([*ROWS, (None, f"before {item} after"), (1, item)])
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, SF_SMALL).collect()
    assert sorted(r["text"] for r in kept) == sorted(text for _, text, _ in ROWS)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL)
    assert rows.count() > 50 and rows.columns[:2] == ["doc_id", "piece"]

"""Every document operator: defined results for awkward rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from transectra.llm import exact, jaccard, language, packing, pieces, quality, secrets, tokenfile, urls

from .conftest import prose

OPERATORS = {
    "quality": quality.classify, "language": language.identify, "packing": packing.pack_documents, "tokens": tokenfile.round_trip,
    "secrets": secrets.secret_digests, "exact": exact.exact_duplicates, "pieces": pieces.piece_digests,
    "similar": jaccard.similarity_components,
}


def rounded(df):
    """Rows; floats, whose sums depend on the order of rows, to a few digits."""
    return sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_clashing_columns(name, awkward, clashing):
    rows = rounded(OPERATORS[name](awkward))
    assert len(rows) >= awkward.count()
    if name not in ("packing", "tokens"):  # these two also give places
        assert len(rows) == awkward.count()
    again = rounded(OPERATORS[name](clashing(awkward).repartition(3)))
    # Windows are numbered by partition.
    assert [r[:5] for r in again] == [r[:5] for r in rows] if name == "packing" else again == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, no_documents):
    assert OPERATORS[name](no_documents).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(name, spark, no_documents):
    rows = spark.createDataFrame([(None, None, None, None, None)] * 3, no_documents.schema)
    found = OPERATORS[name](rows)
    assert found.count() == 3
    assert found.filter(F.col("doc_id").isNotNull()).isEmpty()


def test_samples_of_rows_without_ids(spark, no_documents):
    """Rows with null ids are drawn one by one: both languages and both qualities are learnt from a part of them."""
    german, english = "der die und ist nicht mit ein Haus Baum Wasser Licht", "the and is not with a house tree water light"
    rows = [(None, " ".join(prose(i, 12).split()[:3] + (german if i % 2 else english).split() * 3), "de" if i % 2 else "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, no_documents.schema)
    model = language.fit(docs, train_docs=40, rounds=1)
    assert model.langs == ["de", "en"]
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) < int(0.2 * (1 << 30))
    drawn = {r.lang: r["count"] for r in docs.filter(draw).groupBy("lang").count().collect()}
    assert all(10 < drawn[k] < 90 for k in ("de", "en"))
    found = quality.score(docs, quality.fit(docs, train_docs=100))
    assert len({r.score for r in found.collect()}) > 1


def test_columns_of_any_name_pass_through(spark, awkward, clashing):
    docs = clashing(awkward)
    kept = exact.drop_copies(docs, exact.exact_duplicates(docs))
    plain_kept = exact.drop_copies(awkward, exact.exact_duplicates(awkward))
    assert kept.columns == docs.columns and rounded(kept.select(awkward.columns)) == rounded(plain_kept)
    pages = spark.createDataFrame([(1, "http://a.b/c", "2024-01-05"), (2, None, None)], "page_id long, url string, fetched string")
    pages = clashing(pages.withColumn("fetched", F.col("fetched").cast("date")))
    log = spark.createDataFrame([("l", "host", "a.b", "add", "2024-01-01")], "list string, kind string, pattern string, action string, at string")
    got = {r.page_id: r for r in urls.judge(pages, log.withColumn("at", F.col("at").cast("date"))).collect()}
    assert (got[1].blocked, got[1].n_matches, got[1].matched, got[1]["_url"]) == (True, 1, "l:host:a.b", "other _url")
    assert (got[2].blocked, got[2].n_matches, got[2].matched) == (False, 0, None)

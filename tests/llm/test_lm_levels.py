"""The query of the language model has all levels that its operator has."""

from orrery.llm.lm_score import score_documents
from orrery.llm.queries import QUERIES


def test_query_uses_triples(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, want, less = ({r.doc_id: round(r.score, 6) for r in df.collect()} for df in (QUERIES["op9_lm_scoring"](spark, sf), score_documents(docs, order=3), score_documents(docs, order=2)))
    assert got == want and got != less

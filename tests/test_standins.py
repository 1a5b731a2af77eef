"""Stand-in views and registered queries take in their whole tables."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import learning
from tidewatch.plans import learning_queries
from tidewatch.plans.standins import table, view

SF = "/root/testdata/sf0.001"


def test_every_document_has_reviews_of_several_claims(spark):
    reviews = view(spark, SF, "v_reviews")
    per = reviews.groupBy("doc_id").agg(F.countDistinct("claim_no").alias("claims"))
    assert per.where("claims > 1").count() == table(spark, SF, "documents").select("doc_id").distinct().count()
    assert reviews.where("claim_no >= 6").count() > 0 and reviews.where("claim_no < 6").count() > 0
    assert reviews.select("review_id").distinct().count() == reviews.count()


def test_every_event_is_feedback(spark):
    assert view(spark, SF, "v_feedback").count() == table(spark, SF, "events").count()


def test_all_three_sources_of_a_score_appear(spark):
    got = {r.score_source for r in entry.queries()["v06_source_precedence"](spark, SF).collect()}
    assert got == {"fact_check", "rag_evidence", "heuristic"}


def test_the_classifier_is_trained_with_its_default_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(learning, "train_classifier", lambda rows, features, **more: asked.append(more))
    monkeypatch.setattr(learning, "score_classifier", lambda rows, model: rows.withColumn("probability", F.lit(0.5)))
    learning_queries._classified(spark, SF)
    assert asked == [{}]

"""Queries on tables that hold more than their fixed lists and samples."""

from kalamos.plans import catalogue


def test_loss_status_of_late_runs(spark, tmp_path):
    rows = [(1, 3, "train", 0.5), (2, 400, "train", 0.25), (3, 70_000, "valid", 1.0), (4, None, "train", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.run_id: (r.status, r.num_points) for r in catalogue.loss_status(spark, str(tmp_path)).collect()}
    assert len(got) == 402 and got[3] == ("ok", 1) and got[400] == ("ok", 1)
    assert got[70_000] == ("missing_train_loss", 0) and got[5] == ("missing_history", 0)


def test_retrieval_variants_of_every_corpus_row(spark, tmp_path):
    text = "transliteration string, translation string"
    corpus = [(1, "a-na be-li-ia", "to my lord", "A"), (2, "a-na be-li-ka", "to your lord", "B"), (3, "a-na be-li-ia", "held", "H"), (4, "um-ma šu-ut-ma", "thus he", None), (5, "um-ma šu-ut-ma-a", "thus", "J")]
    spark.createDataFrame(corpus, f"row_id long, {text}, oare_id string").write.parquet(f"{tmp_path}/{catalogue.CORPUS}.parquet")
    spark.createDataFrame([(100, "a-na be-li-ia", "x", "H")], f"test_id long, {text}, doc_id string").write.parquet(f"{tmp_path}/independent_test_set_clean.parquet")
    spark.createDataFrame([(200, "um-ma šu-ut-ma", "y", "J")], f"test_id long, {text}, oare_id string").write.parquet(f"{tmp_path}/new_test_set.parquet")
    got = {(r.format, r.split, r.row_id): r.retrieved_doc_id for r in catalogue.retrieval_variants(spark, str(tmp_path)).collect()}
    assert len(got) == 3 * (5 + 1 + 1)
    train = {k: got["retrieval_compact", "train", k] for k in range(1, 6)}
    assert train[1] == "B" and train[2] == "A" and train[3] == "A" and train[5] is None  # 3 and 5 are held out, so queries only
    assert got["retrieval_compact", "independent", 100] == "A" and got["retrieval_compact", "new_test", 200] is None


def test_paired_bootstrap_draws_the_stated_rounds(spark, tmp_path):
    rows = [(k, f"word{k} of the text {k % 3}") for k in range(4)]
    spark.createDataFrame(rows, "test_id long, translation string").write.parquet(f"{tmp_path}/independent_test_set_clean.parquet")
    assert catalogue.paired_bootstrap(spark, str(tmp_path)).first().resamples == 2000

"""Readers, sinks, configuration, modes, reports and the command line on small files."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from kalamos import cli
from kalamos.plans import pipeline, reports
from kalamos.sources import config, readers, sinks
from kalamos.streaming import flows


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "train.csv").write_text('oare_id,transliteration,translation\nA,"a-na be-li2-ia, w2 w3 w4",to my lord and on\nB,um-ma šu-ut-ma ni-nu,"thus ""he"" said\nto us"\nC,NA,lost source text\nD,ki-am lá sí na,in this way now\nA,second row,ignored for spans\n', encoding="utf-8")
    (tmp_path / "Sentences_Oare_FirstWord_LinNum.csv").write_text("text_uuid,first_word_number,first_word_spelling,translation\nA,1,a-na,To my lord\nA,3,w3,and so on\nB,1,um-ma,thus we\nP,1,pu,published one\n", encoding="utf-8")
    (tmp_path / "published_texts.csv").write_text("oare_id,transliteration\nP,pu-b li-sh ed\nA,known\nQ,no anchors\n", encoding="utf-8")
    (tmp_path / "held.json").write_text(json.dumps(["B", " ", ""]))
    (tmp_path / "eBL_Dictionary.csv").write_text('word,definition,derived_from\nana,"""to, for""",\n', encoding="utf-8")
    (tmp_path / "OA_Lexicon_eBL.csv").write_text("type,form,norm,lexeme,eBL\nword,a-na,ana,ana,x\n", encoding="utf-8")
    return tmp_path


def data(folder, **settings):
    return config.DataConfig(data_dir=str(folder), min_translation_chars=1, **settings)


def test_csv(spark, folder):
    rows = {r.oare_id: r for r in readers.read_documents(spark, str(folder)).collect()}
    assert rows["B"].translation == 'thus "he" said\nto us' and rows["C"].transliteration is None
    raw = {r.oare_id: r for r in readers.read_strings(spark, str(folder / "train.csv")).collect()}
    assert raw["C"].transliteration == "NA"
    with pytest.raises(FileNotFoundError):
        readers.read_dictionary(spark, "/nowhere")


def test_id_lists(spark, folder, caplog):
    assert [r.id for r in readers.read_ids(spark, str(folder / "held.json")).collect()] == ["B"]
    assert readers.read_ids(spark, str(folder / "held.json"), keep_blanks=True).count() == 3
    with caplog.at_level(logging.WARNING):
        assert readers.read_ids(spark, str(folder / "none.json")).count() == 0
    assert "none.json" in caplog.text
    with pytest.raises(FileNotFoundError, match="holdout-union"):
        readers.read_ids(spark, str(folder / "none.json"), strict=True)
    for bad in ("{", '{"a": 1}'):
        (folder / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            readers.read_ids(spark, str(folder / "bad.json"))


@pytest.mark.parametrize(("mode", "want"), [("document", 5), ("sentence_only", 3), ("mixed", 3), ("extended_sentence", 4)])
def test_modes(spark, folder, mode, want):
    df = pipeline.load_source(spark, data(folder, data_mode=mode))
    assert df.count() == want
    if mode == "extended_sentence":
        assert {r.doc_id: r.source for r in df.collect()} == {"A": "train", "B": "train", "P": "published"}


def test_prepared_mode_and_filters(spark, folder):
    path = folder / "prepared.csv"
    rows = [("a b c", "five letters", "A", "sentence"), ("d " * 160, "long source", "B", "sentence"), ("x y", "a document", "C", "document"), ("?", "nothing is left", "E", "sentence")]
    path.write_text("transliteration,translation,doc_id,granularity\n" + "".join(f"{','.join(r)}\n" for r in rows))
    d = data(folder, data_mode="prepared", prepared_file=str(path), prepared_granularity="sentence", min_sentence_words=1)
    assert {r.oare_id for r in pipeline.prepare(pipeline.load_source(spark, d), spark, d).collect()} == {"A"}
    d = data(folder, data_mode="prepared", prepared_file=str(path), skip_source_normalization=True)
    assert "?" in {r.transliteration for r in pipeline.prepare(pipeline.load_source(spark, d), spark, d).collect()}
    with pytest.raises(ValueError):
        pipeline.load_source(spark, data(folder, data_mode="prepared"))


def test_training_tables(spark, folder):
    d = data(folder, val_split_strategy="doc_id", holdout_doc_ids_file=str(folder / "held.json"), val_split=0.5, use_dictionary_gloss=True)
    train, validation = pipeline.load_train_data(spark, d)
    ids = [{r.oare_id for r in side.collect()} for side in (train, validation)]
    assert ids[0] | ids[1] == {"A", "D"} and not ids[0] & ids[1]
    assert any("|| a-na: to" in r.transliteration for r in train.unionAll(validation).collect())
    train, validation = pipeline.load_train_data(spark, data(folder, val_split=0.3))
    assert train.count() + validation.count() == 4
    test = folder / "test.csv"
    test.write_text("transliteration,doc_id\na-na [x],A\n")
    assert pipeline.load_test_data(spark, d).first().transliteration == "a-na <gap>"
    test.write_text("transliteration,doc_id\n,A\n")
    with pytest.raises(ValueError):
        pipeline.load_test_data(spark, d)
    assert pipeline.test_file(None, "b", "c") == "b" and pipeline.test_file("a", "b", "c") == "a" and pipeline.test_file(None, None, "c") == "c"


def test_predictors(spark):
    df = spark.createDataFrame([(1, "a-na be-li", "to my lord"), (2, "um-ma", "thus thus thus")], "k long, transliteration string, translation string")

    def echo(batches):
        for b in batches:
            yield b.assign(prediction=b["translation"] + " .")

    said = pipeline.predict_with(df, echo)
    assert [r.prediction for r in said.orderBy("k").collect()] == ["to my lord.", "thus."]
    near = pipeline.predict_nearest(df, df, "k", "k")
    assert [r.prediction for r in near.orderBy("k").collect()] == ["to my lord", "thus thus thus"]
    assert abs(pipeline.evaluate(near).first().chrf - 100) < 1e-9


def test_positional_references(spark):
    said = spark.createDataFrame([(i, f"d{i}", f"p{i}") for i in range(30)], "ordinal long, doc_id string, prediction string")
    refs = spark.createDataFrame([(i * 10, f"d{i}", f"s{i}", f"t{i}") for i in range(30)], "ordinal long, doc_id string, transliteration string, translation string")
    out = readers.attach_references(said, refs).collect()
    assert len(out) == 30 and all(r.translation == "t" + r.prediction[1:] for r in out)
    with pytest.raises(ValueError):
        readers.attach_references(said, refs.where("ordinal > 0"))


def test_metric_files(spark, tmp_path):
    for run in ("base_seed1", "base_seed2"):
        (tmp_path / run).mkdir()
        scores = {"bleu": 4.0, "chrf": 9.0, "combined": 6.0}
        (tmp_path / run / "independent_metrics.json").write_text(json.dumps(scores, indent=1))
        (tmp_path / run / "summary.json").write_text(json.dumps({"run_id": run, "independent": scores, "newtest": scores}, indent=1))
    df = readers.read_metric_files(spark, f"{tmp_path}/*/independent_metrics.json", r"/(\w+)_seed(\d+)/(\w+)_metrics", ("size", "seed", "split"))
    assert {tuple(r)[:3] for r in df.collect()} == {("base", "1", "independent"), ("base", "2", "independent")}
    assert {r.newtest_combined for r in readers.read_summaries(spark, f"{tmp_path}/*/summary.json").collect()} == {6.0}


def test_sinks(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sinks.write_id_union(str(tmp_path / "u.json"), ids("b", "a", None), ids("b", " ")) == 2
    assert json.loads((tmp_path / "u.json").read_text()) == ["a", "b"]
    df = spark.createDataFrame([("s", "t", "p", 1)], "transliteration string, translation string, prediction string, n int")
    sinks.write_bundle(str(tmp_path / "run"), {"a": 1}, {"test": df}, {"test": {"bleu": 1.0}})
    assert readers.read_strings(spark, str(tmp_path / "run/test_preds")).columns == ["prediction", "n"]
    log = tmp_path / "h.csv"
    sinks.append_history(str(log), {"b": 2, "a": 1.5, "text": "no", "flag": True}, 1, 0, fresh=True)
    sinks.append_history(str(log), {"a": 1.0}, 2, 0)
    assert log.read_text().split() == ["step,epoch,metric,value", "1,0,a,1.5", "1,0,b,2", "2,0,a,1.0"]
    sinks.append_history(str(log), {"a": 9}, 1, 0, fresh=True)
    assert len(log.read_text().split()) == 2
    sinks.write_csv(df, str(tmp_path / "q"), quote_all=True)
    assert '"s","t","p","1"' in "".join(p.read_text() for p in (tmp_path / "q").glob("*.csv"))
    sinks.write_predictions(df, str(tmp_path / "preds"))
    assert readers.read_strings(spark, str(tmp_path / "preds")).columns == ["transliteration", "reference", "prediction"]
    assert sinks.report_lines(df, "%s-%d", "prediction", "n") == ["p-1"]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data: {data_mode: mixed, max_glosses: 3}\ntrain: {fp16: false, epochs: 30}\n")
    c = config.load(path)
    assert c.data.data_mode == "mixed" and c.data.max_glosses == 3 and c.data.val_split == 0.1 and c.train.epochs == 30
    words = ["--train.batch_size", "16", "--train.wandb_run_name", "exp-1", "--data.filter_quality", "yes", "--data.nothing", "1", "--data.max_glosses", "many", "--data.prepared_file", "p.csv", "--odd"]
    config.override(c, words)
    assert (c.train.batch_size, c.train.wandb_run_name, c.data.filter_quality, c.data.max_glosses, c.data.prepared_file) == (16, "exp-1", True, 3, "p.csv")
    config.override(c, ["--train.wandb_run_name", "null", "--data.prepared_file", "null", "--data.val_split", "1", "--data.filter_quality", "0", "--model.name", "x"])
    assert (c.train.wandb_run_name, c.data.prepared_file, c.data.val_split, c.data.filter_quality, c.model.name) == (None, None, 1.0, False, "x")
    with pytest.raises(ValueError, match="val_split"):
        c.data.check()
    assert config.active_ablations(c.data) == [] and config.normalisation_flags(c.data)["strip_homophones"]
    for bad in ({"data": {"val_split": 1.0}}, {"data": {"val_split_strategy": "x"}}, {"data": {"max_glosses": -1}}, {"data": {"remove_gaps": "perhaps"}}, {"data": 3}, ["a"]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(path)
    path.write_text("- a\n")
    with pytest.raises(ValueError, match="top-level must be a mapping"):
        config.load(path)
    (tmp_path / "below").mkdir()
    (tmp_path / "below/only.yaml").write_text("data: {unknown: 1}")
    assert config.load("only.yaml", [tmp_path]).data.unknown == 1
    with pytest.raises(FileNotFoundError):
        config.load("no_such.yaml", [tmp_path])


def test_evaluation_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data: {remove_gaps: true}\n")
    assert pipeline.evaluation_settings(str(path)).remove_gaps
    assert pipeline.evaluation_settings(None, {"data": {"tag_sumerograms": True, "old": 1}}).tag_sumerograms
    assert not pipeline.evaluation_settings(None).tag_sumerograms


def test_loss_curves(spark, tmp_path):
    (tmp_path / "m.csv").write_text("run_id,priority,comparison_group,order,history_path\nr1,core,g,2,h1.csv\nr2,core,g,1,h2.csv\nr3,core,g,3,h3.csv\nr4,other,g,4,h1.csv\n")
    (tmp_path / "h1.csv").write_text("step,epoch,metric,value\n1,0,train/loss,4.0\n2,0,train/loss,3.2\n2,0,val/loss,9\n3,0,train/loss,\n")
    (tmp_path / "h2.csv").write_text("step,epoch,metric,value\n1,0,val/loss,4.0\n")
    status, series = reports.loss_curves(spark, str(tmp_path / "m.csv"), str(tmp_path), 2, priorities=["core"])
    assert [(r.run_id, r.status, r.num_points) for r in status.collect()] == [("r2", "missing_train_loss", 0), ("r1", "ok", 2), ("r3", "missing_history", 0)]
    assert [round(r.smoothed, 6) for r in series.collect()] == [4.0, 3.6]


def test_command_line(spark, folder, capsys):
    with pytest.raises(SystemExit) as stop:
        cli.main(["--help"])
    assert stop.value.code == 0 and "holdout-union" in capsys.readouterr().out
    assert cli.main(["holdout-union", str(folder / "held.json"), "--out", str(folder / "out.json")]) == 0
    assert json.loads((folder / "out.json").read_text()) == ["B"]
    (folder / "c.yaml").write_text(json.dumps({"data": {"data_dir": str(folder)}}))
    assert cli.main(["prepare", "--config", str(folder / "c.yaml"), "--out", str(folder / "tables"), "--data.val_split", "0.3"]) == 0
    assert spark.read.parquet(str(folder / "tables/train")).count() >= 1


def test_evaluate_command(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("doc_id,transliteration,translation\nA,a-na be,to the lord of it\nB,um-ma,thus he said to us\n")
    (tmp_path / "p.csv").write_text("doc_id,prediction\nA,to the lord of it\nB,thus he said\n")
    words = ["evaluate", "--predictions", f"x={tmp_path}/p.csv", "--references", f"x={tmp_path}/t.csv", "--out", str(tmp_path / "out")]
    assert cli.main(words) == 0
    scores = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert 50 < scores["x"]["chrf"] < 100 and json.loads((tmp_path / "out/summary.json").read_text()) == scores
    (tmp_path / "p.csv").write_text("doc_id,prediction\nB,to the lord of it\nA,thus he said\n")
    with pytest.raises(ValueError, match="order of documents"):
        cli.main(words)


def run_stream(df, name):
    stream = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a-na be-li₂-ia", "to my lord and so on"), ("x", "obv"), (None, "nothing")], "transliteration string, translation string").write.parquet(src)
    got = run_stream(flows.normalised_stream(spark, src, "transliteration string, translation string"), "normal")
    assert [r.transliteration for r in got] == ["a-na be-li-ia"]
    log = str(tmp_path / "log")
    values = [1.0, 2.0, 2.0, 1.0, 5.0]
    rows = [("r", k, 0, "val", v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "run_id string, step int, epoch int, metric string, value double").withColumn("logged_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,step*30)")).write.parquet(log)
    stops = sorted(run_stream(flows.early_stops(flows.history_stream(spark, log), "val", 2), "stops"), key=lambda r: r.step)
    assert [(r.step, r.best, r.since, r.stopped) for r in stops] == [(0, 1.0, 0, False), (1, 2.0, 0, False), (2, 2.0, 1, False), (3, 2.0, 2, True)]
    batch = flows.windowed_loss(spark.read.schema(flows.HISTORY).parquet(log), metric="val")
    assert sum(r.points for r in batch.collect()) == 5
    assert len(run_stream(flows.deduplicated(flows.history_stream(spark, log)), "dedup")) == 5

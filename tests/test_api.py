"""The analysis as one call."""

import json

from spanloom.api import analyse, main, verify
from spanloom.config import load_settings
from spanloom.sources.tables import observations


def test_analyse_and_command_line(spark, tmp_path, capsys):
    obs = observations(spark, "/root/testdata/sf0.001")
    tables = analyse(obs)
    assert tables["heroes"].count() > 0
    counted = tables["lineages"].selectExpr("sum(members) AS m", "sum(size(split(chain, ','))) AS c", "count(*) AS n").first()
    assert counted.m == counted.c == counted.n + tables["matched"].count()
    obs.write.parquet(f"file://{tmp_path}/obs")
    main([f"file://{tmp_path}/obs", "--out", f"file://{tmp_path}/out", "--format", "json", "--only", "beats", "track_stats"])
    assert spark.read.json(f"file://{tmp_path}/out/beats").count() == tables["beats"].count()
    main(["verify", f"file://{tmp_path}/obs", "--every", "5", "--max-frames", "100", "--out", f"file://{tmp_path}/out"])
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    kept = obs.where("frame % 5 = 0 AND frame < 500")  # a hundred frames of each video
    assert said["videos"] == said["usable"] == spark.read.parquet(said["table"]).count() == kept.select("video_id").distinct().count()
    assert said["rows"] == kept.count() and said["unusable"] == said["shown"] == 0


def test_verify_names_the_worst_and_counts_all(spark, tmp_path, capsys):
    rows = [(v, 1, None if k <= v else k, 1.0, 1.0) for v in range(150) for k in range(150)]
    spark.createDataFrame(rows, "video_id long, track_id long, frame long, cx double, cy double").write.parquet(f"file://{tmp_path}/bad")
    main(["verify", f"file://{tmp_path}/bad"])
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (said["videos"], said["usable"], said["unusable"], said["shown"]) == (150, 0, 150, 20)
    assert [v["video_id"] for v in said["worst"]] == list(range(149, 129, -1)) and said["incomplete"] == sum(range(1, 151))


def test_verify_counts_what_is_missing(spark):
    rows = [(0, 1, 1, 1.0, 1.0), (0, 1, 1, 2.0, 1.0), (0, 2, None, 1.0, 1.0), (1, 1, 1, None, 1.0)]
    got = {r.video_id: (r.rows, r.incomplete, r.repeats, r.usable) for r in verify(spark.createDataFrame(rows, "video_id long, track_id long, frame long, cx double, cy double")).collect()}
    assert got == {0: (3, 1, 1, False), 1: (1, 1, 0, False)}


def test_settings_keep_defaults_for_what_cannot_be_read():
    found = load_settings({"SPANLOOM_FRAME_STRIDE": "15", "SPANLOOM_MAX_FRAMES": "many", "SPANLOOM_EMBEDDINGS": "off", "SPANLOOM_BALL": " "})
    assert (found.frame_stride, found.max_frames, found.embeddings, found.ball) == (15, 0, False, "purchase")


def test_names_of_the_package():
    import spanloom
    from spanloom.operators import scene

    assert spanloom.analyse is analyse and callable(scene.cuts) and set(spanloom.__all__) <= set(dir(spanloom))

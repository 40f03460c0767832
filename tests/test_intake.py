from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from recollect.operators import intake
from recollect.schemas import ITEMS
from recollect.sources import archive as src, tables


OPEN = T.StructType([T.StructField(f.name, f.dataType, True) for f in ITEMS.fields])


def _items(spark, rows):
    return spark.createDataFrame([(i, s, None, None, None, None, t, v) for i, s, t, v in rows], OPEN)


def test_validate_gives_reasons_and_keeps_every_row(spark):
    rows = [(1, "a", "x", None)] * 5 + [(1, "a", "y", None), (None, "a", "z", None), (2, "a", " . ", None)]
    rows += [(3, "a", None, [1.0]), (4, "b", None, [1.0, 2.0])]
    ok, bad = intake.validate(_items(spark, rows), dim=2)
    accepted = {r["image_id"] for r in ok.collect()}
    assert accepted == {1, 4} and ok.count() == 2
    reasons = {}
    for r in bad.collect():
        reasons[r["reason"]] = reasons.get(r["reason"], 0) + r["copies"]
    assert reasons == {
        intake.REPEATED_ID: 5,
        intake.NULL_ID: 1,
        intake.NO_CONTENT: 1,
        intake.WRONG_LENGTH: 1,
    }


def test_audit_counts_invented_values(spark, archive):
    honest = intake.provenance_audit(archive, archive)
    assert honest.agg(F.sum("invented")).first()[0] == 0
    forged = archive.withColumn("source", F.coalesce("source", F.lit("guess")))
    found = {r["field"]: r["invented"] for r in intake.provenance_audit(archive, forged).collect()}
    assert found["source"] == 1 and found["meta.lang"] == 0


def test_folder_of_images_keeps_unknown_unknown(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    rows = src.normalize(src.scan_archive(spark, str(tmp_path), "files")).collect()
    assert rows[0]["file_info"]["name"] == "a.png" and rows[0]["file_info"]["bytes"] == 3
    assert rows[0]["ts"] is None and rows[0]["source"] is None and rows[0]["text"] is None


def test_sources_share_one_layout(spark, archive):
    sent = spark.createDataFrame([(90, "tg://1", "hello")], "image_id long, uri string, text string")
    both = src.normalize(archive, src.land_source(sent, "messenger"))
    assert both.columns == archive.columns and both.count() == archive.count() + 1


def test_latest_row_wins(spark):
    path = f"{tables.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    for at, state in ((1, "waiting"), (2, "done")):
        df = spark.createDataFrame([(7, "ocr", state, at)], "image_id long, stage string, state string, at long")
        tables.write_table(df, path, ["stage"])
    assert [r["state"] for r in tables.read_latest(spark, path, ["image_id", "stage"], "at").collect()] == ["done"]

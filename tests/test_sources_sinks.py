"""CSV source bound by header name, sinks and the report."""
import os
import tempfile

from adlift.operators import report, roi
from adlift.sources import files


def test_csv_roundtrip_by_name(spark, tables):
    d = tempfile.mkdtemp(prefix="adlift-csv-")
    for t in files.TABLES:
        # write columns in a shuffled order: the reader binds by header name
        df = getattr(tables, t)
        df.select(*reversed(df.columns)).coalesce(1).write.option("header", True).mode("overwrite") \
          .csv(os.path.join(d, f"{t}.csv"))
    back = files.read_campaign_csvs(spark, d)
    assert back.exposures.count() == tables.exposures.count()
    assert back.campaigns.columns[0] == "campaign_id"


def test_export_and_report(spark, tables):
    r = roi.campaign_roi(tables.exposures, tables.outcomes)
    out = tempfile.mkdtemp(prefix="adlift-out-")
    paths = files.export_results({"campaign_performance": r, "channel_effectiveness": roi.channel_performance(r)},
                                 out, fmt="csv")
    assert set(paths) == {"campaign_performance", "channel_effectiveness"}
    assert spark.read.option("header", True).csv(paths["campaign_performance"]).count() == 12
    rep = report.executive_report(r, roi.channel_performance(r))
    sections = {x["section"] for x in rep.select("section").distinct().collect()}
    assert {"TOTALS", "NEXT STEPS"} <= sections
    files.write_report_text(rep, os.path.join(out, "summary"))
    assert spark.read.text(os.path.join(out, "summary")).count() == rep.count()

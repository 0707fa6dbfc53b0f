import pytest
from pyspark.sql import functions as F

from cograph.functions import responses as R


def ask(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("PREDICTION: BENIGN", "BENIGN"), ("**Final Prediction:** MALWARE", "MALWARE"), ("**Final Prediction:**\nMALWARE", "MALWARE"), ("PREDICTION:\n\nBENIGN", "BENIGN"), ("PREDICTION: <MALWARE or BENIGN>", "MALWARE"),
        ("My final verdict: benign", "BENIGN"), ("I would classify this as malware", "MALWARE"), ("the verdict is benign", "BENIGN"), ("shows spyware and trojan traits", "MALWARE"), ("shows spyware traits", "BENIGN"), ("", "BENIGN"), (None, "BENIGN"),
        ("* MALWARE", "MALWARE"),
    ],
)
def test_verdict(spark, text, verdict):
    assert ask(spark, text, R.final_verdict(F.col("t"))) == verdict


def test_confidence_and_risk(spark):
    t = F.col("t")
    assert ask(spark, "x\nCONFIDENCE: high", R.confidence(t, F.lit("BENIGN"))) == "HIGH"
    assert ask(spark, "x", R.confidence(t, F.lit("MALWARE"))) == "MEDIUM"
    assert ask(spark, "x", R.confidence(t, F.lit("BENIGN"))) == "UNKNOWN"
    assert ask(spark, "RISK_ASSESSMENT: CRITICAL", R.risk(t, 1)) == "HIGH"
    assert ask(spark, "RISK_LEVEL: CRITICAL", R.risk(t, 2)) == "CRITICAL"
    assert ask(spark, "nothing", R.risk(t, 1)) == "UNKNOWN"
    assert ask(spark, "Final prediction is malware", R.log_verdict(t)) == "MALWARE"
    assert ask(spark, "fine", R.log_verdict(t)) == "BENIGN"
    assert tuple(ask(spark, "VERDICT: INCONSISTENT\nREASON: made up", R.consistency(t))) == (False, "made up")
    assert ask(spark, "x" * 90 + " exec RISK: LOW", R.sanity(t, F.lit("a.exec"))) == "OK"
    assert ask(spark, "exec", R.sanity(t, F.lit("a.exec"))) == "too short"

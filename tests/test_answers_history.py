import json

from pyspark.sql import functions as F

from sitewright import fixed_values as fv
from sitewright.operators import answers as A
from sitewright.operators import history as H
from sitewright.operators.article_features import article_features
from sitewright.operators.findings import article_findings, with_failures
from sitewright.operators.inputs import complete_inputs, input_markup, parse_inputs
from sitewright.operators.page_features import page_features
from sitewright.operators.reports import markdown_reports, rewrite_prompts
from sitewright.operators.scoring import article_scores, article_verdicts
from sitewright.streaming.feature_stream import page_stream, write_feature_stream

GOOD = {"oneSentenceTruth": "t", "topProblems": ["1", "2", "3"], "topFixes": ["1", "2", "3"],
        "rewriteBrief": ["• a", "- b", "c", "d", "e", "f"], "titleOptions": ["t"] * 5, "metaOptions": ["m"] * 3,
        "h2Suggestions": ["h"] * 6, "faqSuggestions": [{"q": "q", "a": "a"}] * 4}


def test_json_block(spark):
    df = spark.createDataFrame(
        [('x ```json\n{"a": 1}\n``` y {"b": 2}',), ('say {"a": {"b": 1}} ok',), ("nothing",)], "t string")
    assert [r[0] for r in df.select(A.json_block(F.col("t"))).collect()] == [
        '{"a": 1}', '{"a": {"b": 1}}', "nothing"]


def test_site_answers(spark):
    full = {"salesPitchSummary": "p", "executiveSummary": "e", "businessType": "b", "overallVerdict": "v",
            "actionPlan": [{"x": 1}], "expectedResults": {"day30": ["a"], "day60": ["b"], "day90": ["c"]}}
    bad = dict(full, executiveSummary="  ", actionPlan=[], expectedResults={"day30": ["a"]})
    df = spark.createDataFrame(
        [(1, json.dumps(full)), (2, json.dumps(bad)), (3, json.dumps(full)[:-4]), (4, "no json")],
        "scan_id long, text string")
    got = {r["scan_id"]: r for r in A.checked_site_answers(df).collect()}
    assert got[1]["is_accepted"] and got[1]["missing"] == []
    assert got[2]["missing"] == ["executiveSummary", "actionPlan", "expectedResults.day60", "expectedResults.day90"]
    assert not got[3]["is_parsed"] and not got[4]["is_parsed"] and not got[4]["is_accepted"]
    filled = A.checked_site_answers(df).filter("scan_id = 1").select(A.with_empty_lists(F.col("answer")).alias("a"))
    assert filled.select("a.quickWins", "a.salesInsight").first()[:] == ([], "")


def test_rejected_answers_are_counted_in_one_pass(spark):
    full = {n: "x" for n in fv.ANSWER_REQUIRED_TEXT} | {n: ["a"] for n in fv.ANSWER_REQUIRED_LISTS}
    full["expectedResults"] = {p: ["a"] for p in fv.ANSWER_REQUIRED_PERIODS}
    rows = [(1, json.dumps(full)), (2, json.dumps(full)[:-9]), (3, "sorry"), (4, "{}"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "scan_id long, text string")
    rejected = {r["scan_id"]: r["reason"] for r in A.rejected_site_answers(df).collect()}
    assert rejected == {2: "broken_json", 3: "no_json", 4: "missing_fields", 5: "no_json", 6: "no_json"}
    checked, counts = A.counted_site_answers(df)
    checked.collect()
    assert counts.get == {"answers": 6, "accepted": 1, "no_json": 3, "broken_json": 1, "missing_fields": 1}


def test_article_answers_and_merge(spark):
    long = dict(GOOD, titleOptions=["t"] * 8)
    text = dict(GOOD, rewriteBrief="\n".join(["one", " ", "two", "3", "4", "5", "6"]))
    df = spark.createDataFrame(
        [(1, json.dumps(GOOD)), (2, json.dumps(long)), (3, json.dumps(text))], "scan_id long, text string")
    checked = A.checked_article_answers(df)
    got = {r["scan_id"]: r for r in checked.collect()}
    assert got[1]["is_accepted"] and got[2]["out_of_bounds"] == ["titleOptions"] and got[3]["is_accepted"]
    assert got[3]["brief"] == ["one", "two", "3", "4", "5", "6"]
    rule = spark.createDataFrame([(i, ["rule"], "rule brief") for i in (1, 2, 9)],
                                 "scan_id long, top_problems array<string>, rewrite_brief string")
    merged = {r["scan_id"]: r for r in A.merged_scans(rule, checked).collect()}
    assert merged[1]["top_problems"] == ["1", "2", "3"] and merged[1]["is_ai_enhanced"]
    assert merged[1]["rewrite_brief"] == "• a\n• b\n• c\n• d\n• e\n• f"
    assert merged[2]["top_problems"] == ["rule"] and merged[9]["rewrite_brief"] == "rule brief"


def test_errors(spark):
    df = spark.createDataFrame(
        [("IAM.serviceAccounts.getAccessToken",), ("GoogleAuthError x",), ("Permission denied",), ("404 gone",),
         ("Quota",), ("socket hang up",)], "m string")
    got = [tuple(r) for r in df.select(A.error_class(F.col("m")), A.is_retryable(F.col("m"))).collect()]
    assert got == [("impersonation_denied", False), ("authentication_failed", False), ("permission_denied", False),
                   ("model_missing", True), ("quota", True), ("other", True)]


def _scans(spark):
    text = "Everything about shoes. " * 40
    df = spark.createDataFrame([(i, text + "x" * 6000) for i in range(60)], "article_id long, raw_input string")
    a = complete_inputs(article_features(input_markup(parse_inputs(df)).withColumn("url", F.col("main_url"))))
    rows = article_scores(a).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", "name", "score", "max_score", "status", "evidence"))).alias("categories"))
    return with_failures(a).join(article_verdicts(a), "article_id").join(
        article_findings(a), "article_id").join(rows, "article_id").withColumn(
        "id", F.concat(F.lit("s"), "article_id"))


def test_history_and_reports(spark, tmp_path):
    scans = _scans(spark).cache()
    reports = markdown_reports(scans, report_date=F.lit("2024-03-05").cast("date"))
    whole = scans.join(reports, "id").join(rewrite_prompts(scans), "id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("article_id") % 3).cast("int"))
    path = str(tmp_path / "scans")
    H.append_scans(H.scan_rows(whole, created_at=day), path)
    stored = H.read_scans(spark, path)
    one = H.scan_by_id(stored, "s7").first()
    assert len(one["raw_input"]) > 5000 and one["score"] > 0
    assert json.loads(one["json_report"])["score"]["total"] == one["score"]
    assert one["markdown_report"].count("\n## ") == 23 and "5 March 2024" in one["markdown_report"]
    assert "## 23. Honest means" in one["markdown_report"]
    assert "Text:" in one["rewrite_prompt"] and "xxx" in one["rewrite_prompt"]
    newest = H.recent_scans(stored).collect()
    assert len(newest) == 50 and newest[0]["created_at"] >= newest[-1]["created_at"]
    assert newest[0]["id"] == "s11" and len(newest[0]) == 9
    plan = H.scan_by_id(stored, "s7")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,s7)]" in plan
    days = {r["day"] for r in H.last_days(stored, 5).select("day").distinct().collect()}
    assert 0 < len(days) < stored.select("day").distinct().count()
    H.delete_scans(spark, path, spark.createDataFrame([("s7",), ("s8",), ("zz",)], "id string"))
    left = H.read_scans(spark, path)
    assert left.count() == 58 and H.scan_by_id(left, "s7").count() == 0
    assert left.select("day").distinct().count() == 3


def test_stream_equals_batch(spark, data_dir, tmp_path):
    source = tmp_path / "in"
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(source))
    query = write_feature_stream(
        page_stream(spark, str(source), "page_id BIGINT, url STRING, html STRING"),
        str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(300)
    cols = ["page_id", "title", "word_count", "page_type", "internal_link_count"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, page_features(pages).select(cols).collect()))

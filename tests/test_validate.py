import pytest

from driftline.plans.validate import EXECUTION_ERROR, SILENT_FAILURE, VALID, overlap, paraphrase, validate, validate_with_embeddings


@pytest.fixture(scope="module", autouse=True)
def singers(spark):
    spark.createDataFrame([(1, "Joe - France", 52), (2, "Ann - Japan", 41)], "Singer_ID int, Name_Country string, Age int").createOrReplaceTempView("singer")


def test_verdicts_in_order(spark):
    assert validate(spark, "SELECT nope FROM singer", "list names").verdict == EXECUTION_ERROR
    assert validate(spark, "SELECT 1 / 0 FROM singer", "list names").verdict == EXECUTION_ERROR
    assert validate(spark, "SELECT Age FROM singer", "zebra quux").reason == "low_token_overlap"
    got = validate(spark, "SELECT Name_Country FROM singer WHERE Name_Country = 'Joe'", "show the name of singers")
    assert (got.verdict, got.reason) == (SILENT_FAILURE, "empty_result_on_affirmative_question")
    assert validate(spark, "SELECT count(*) FROM singer WHERE Age > 99", "how many singers").reason == "empty_result_on_affirmative_question"
    good = validate(spark, "SELECT count(*) FROM singer", "how many singers are there")
    assert (good.verdict, good.row_count) == (VALID, 1) and "rows" not in good.to_dict()


def test_embeddings_are_injected(spark):
    assert validate_with_embeddings(spark, "SELECT Age FROM singer", "x", similarity=lambda a, b: 0.44).reason == "low_semantic_similarity"
    assert validate_with_embeddings(spark, "SELECT Age FROM singer", "x", similarity=lambda a, b: 0.45).verdict == VALID
    with pytest.warns(RuntimeWarning):
        validate_with_embeddings(spark, "SELECT Age FROM singer", "show the age of singers")


def test_paraphrase():
    sql = "SELECT count(*) AS n, T1.Song_Name FROM singer AS T1 WHERE T1.Is_male = 'T' GROUP BY T1.Song_Name ORDER BY n"
    assert paraphrase(sql) == "show count n song name where is male ordered grouped singer"
    assert paraphrase("nothing") == ""


def test_overlap():
    assert overlap("", "") == 1.0
    assert overlap("the of", "and") == 1.0
    assert overlap("how", "count") == 0.5

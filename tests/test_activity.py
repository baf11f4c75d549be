"""Address rules and credential lines on hand-made rows."""

import time

import pytest

from codestrata.catalog import activity, rules

HOSTS = ("github.com", "git.example.org", "10.0.0.5", "127.0.0.1", "[::1]", "169.254.169.254", "0.0.0.0", "224.0.0.1", "8.8.8.8", "10.example.com")


@pytest.mark.parametrize("url,want", [
    ("https://github.com/a/b", "ok"), ("  HTTPS://GitHub.com/a/b\n", "ok"), ("https://github.com:443/a", "ok"), ("https://8.8.8.8/a", "ok"),
    ("https://10.example.com/a", "ok"), (None, "empty"), ("  ", "empty"), ("https://github.com/" + "a" * 500, "too long"),
    ("http://github.com/a", "not https"), ("ssh://github.com/a", "not https"), ("git@github.com:a/b", "not https"), ("file:///etc/passwd", "not https"),
    ("https://me:pw@github.com/a", "credentials"), ("https://me@github.com/a", "credentials"), ("https://", "no host"), ("https:///a", "no host"),
    ("https://10.0.0.5/a", "private"), ("https://127.0.0.1:8080/a", "private"), ("https://[::1]/a", "private"), ("https://169.254.169.254/latest", "private"),
    ("https://0.0.0.0/a", "private"), ("https://224.0.0.1/a", "private"), ("https://192.168.1.1/a", "private"), ("https://[fe80::1]/a", "private"),
    ("https://evil.com/a", "not allowed"), ("https://github.com.evil.com/a", "not allowed"), ("https://github.com", "no path"), ("https://github.com//", "no path"),
])
def test_url(spark, url, want):
    row = spark.createDataFrame([(url,)], "url string")
    assert row.select(activity.url_verdict(row["url"], HOSTS).alias("v")).first().v == want


def test_credentials(spark):
    texts = [(1, "x = 1\nDB_PASSWORD = \"abc\"\nname = 'token'\n"), (2, "secret: 'a' api_key = \"b\" other = 'c'"), (3, "password = \"\"\npassword = abc"),
             (4, None), (5, ""), (6, "the password \"is\" here"), (7, "Access_Key='q'"), (8, "a" * 1_000_000 + "password" * 10_000 + " '")]
    began = time.time()
    got = sorted(tuple(r) for r in activity.credentials(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == [(1, 2, "DB_PASSWORD"), (2, 1, "api_key"), (2, 1, "secret"), (7, 1, "Access_Key")]
    assert time.time() - began < 60         # long runs of letters are read about once


@pytest.mark.parametrize("path,want", [
    ("src/tests/a.py", "test"), ("src\\tests\\a.py", "test"), ("test_a.py", "test"), ("a_test.py", "test"), ("x/conftest.py", "test"), ("src/cli.py", "cli_parser"),
    ("src/CMD_run.py", "cli_parser"), ("src/user_model.py", "data_model"), ("src/models/user.py", "utility"), ("contest.py", "utility"), ("src/command_model.py", "cli_parser"),
])
def test_role(spark, path, want):
    row = spark.createDataFrame([(path,)], "path string")
    assert row.select(rules.role(row["path"]).alias("v")).first().v == want


@pytest.mark.parametrize("text,want", [
    ("SELECT id FROM t", True), ("  (select 1 from t)", True), ("Select a file to open", False), ("Please select from the menu", False), ("UPDATE t SET a = 1", True),
    ("update your settings", False), ("with x as (\nselect 1\n) select * from x", True), ("DROP TABLE t", False), ("insert into t values (1)", True), (None, None),
])
def test_sql_shape(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string")
    assert row.select(rules.like_sql(row["text"]).alias("v")).first().v == want

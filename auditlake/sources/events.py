"""Change events of code hosts: filter, fields, signatures."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PULL = "action string, repository struct<full_name: string, clone_url: string>, pull_request struct<number: long, head: struct<sha: string, ref: string>, base: struct<ref: string>>"
MERGE = "object_kind string, project struct<path_with_namespace: string>, object_attributes struct<iid: long, action: string, source_branch: string, target_branch: string, last_commit: struct<id: string>>"
# The actions that start a review.
PULL_ACTIONS = ["opened", "synchronize", "reopened"]
MERGE_ACTIONS = ["open", "update", "reopen"]


def pull_requests(events: DataFrame) -> DataFrame:
    """(repo, number, sha, branch, action) of events(event, body) that start a review; unreadable bodies start none."""
    p = F.from_json("body", PULL)
    x = events.where(F.col("event") == "pull_request").select(p.alias("p")).where(F.col("p.action").isin(PULL_ACTIONS))
    return x.select(F.col("p.repository.full_name").alias("repo"), F.col("p.pull_request.number").alias("number"), F.col("p.pull_request.head.sha").alias("sha"), F.col("p.pull_request.base.ref").alias("branch"), F.col("p.action").alias("action"))


def merge_requests(events: DataFrame) -> DataFrame:
    """The same of the other host's events(body)."""
    m = F.from_json("body", MERGE)
    x = events.select(m.alias("m")).where((F.col("m.object_kind") == "merge_request") & F.col("m.object_attributes.action").isin(MERGE_ACTIONS))
    a = "m.object_attributes."
    return x.select(F.col("m.project.path_with_namespace").alias("repo"), F.col(a + "iid").alias("number"), F.col(a + "last_commit.id").alias("sha"), F.col(a + "target_branch").alias("branch"), F.col(a + "action").alias("action"))


def signed(body: Column, signature: Column, secret: str) -> Column:
    """The signature is the body's keyed SHA-256, with or without its prefix; compared in constant time. There is no such builtin."""

    @F.pandas_udf("boolean")
    def check(b: pd.Series, s: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or not y:
                return False
            data = x if isinstance(x, bytes) else x.encode()
            return hmac.compare_digest(hmac.new(secret.encode(), data, hashlib.sha256).hexdigest(), y.removeprefix("sha256="))

        return pd.Series([one(x, y) for x, y in zip(b, s)], dtype=bool)

    return check(body, signature)

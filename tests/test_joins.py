"""Joins over large groups: what they return, and how many rows they make or move on the way."""

import datetime
import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from jobmill.functions.text import host_of
from jobmill.operators import joins
from jobmill.plans import queries as core
from jobmill.plans.q_reports import LABELS

POSTING = "id long, group_key string, source string, source_url string, first_seen_at timestamp_ntz, expired_at timestamp_ntz"


def nodes(plan):
    """The nodes of a plan that ran, those of its stages included."""
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))


def most(df, metric: str, kind: str) -> int:
    """The largest value of a metric of the nodes whose name has `kind`, after df is collected."""
    found = [n.metrics().get(metric) for n in nodes(df._jdf.queryExecution().executedPlan()) if kind in n.getClass().getSimpleName()]
    return max(m.get().value() for m in found if m.isDefined())


def postings(rows):
    day = datetime.datetime(2024, 1, 1)
    return [(i, g, s, u, day + datetime.timedelta(hours=h), day if gone else None) for i, g, s, u, h, gone in rows]


def test_also_on_equals_all_pairs(spark):
    r = random.Random(3)
    pick = lambda: (r.choice(["a", "b", "c", "", None]), r.choice(["WEB", "WEB", "ATS", "JOBSCZ", "JOOBLE", None]), r.choice(["https://www.x.cz/1", "https://x.cz/2", "http://y.cz", "no url", None]))
    df = spark.createDataFrame(postings([(k, *pick(), r.randrange(9), r.random() < 0.3) for k in range(150)]), POSTING)
    listed = joins.cross_listings(df)
    spread = F.col("other_source").isin("WEB", "ATS") & ~host_of("other_url").eqNullSafe(host_of("source_url"))
    entry = F.struct("other_seen", "other_id", joins.board_label(F.col("other_source"), F.col("other_url"), LABELS).alias("label"))
    pairs = listed.filter((F.col("other_source") != F.col("source")) | spread).select("id", entry.alias("e")).collect()
    wanted = {}
    for p in sorted(pairs, key=lambda p: (p.e.other_seen, p.e.other_id)):
        wanted.setdefault(p.id, []).append(p.e.label)
    got = {x.id: x.boards for x in joins.also_on(df, LABELS).collect()}
    assert got == wanted and len(got) > 50


def test_postings_of_one_board_make_no_pairs(spark):
    n = 1500
    rows = [(k, "g", "JOOBLE", f"https://jooble.org/{k}", k % 50, False) for k in range(n)] + [(n, "g", "JOBSCZ", "https://jobs.cz/1", 3, False)]
    out = joins.also_on(spark.createDataFrame(postings(rows), POSTING), LABELS)
    got = {x.id: x.boards for x in out.collect()}
    assert got.pop(n) == ["JOOBLE"] * n and set(map(tuple, got.values())) == {("Jobs.cz",)} and len(got) == n
    assert most(out, "numOutputRows", "Join") <= 3 * n


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Few users with many applications, and large groups of postings; some users, parts and lines are missing."""
    sf = str(tmp_path_factory.mktemp("dense"))
    r = random.Random(5)
    day = datetime.datetime(1996, 6, 1)
    parts = [(k, 900.5, "Brand#1", 1, "name", "type") for k in range(2000)]
    orders = [(k, r.choice([1, 2, 3, 4, None, *range(5, 60)]), day + datetime.timedelta(days=r.randrange(-600, 600)), "1-URGENT") for k in range(600)]
    lines = [(k, r.choice([7, 27, r.randrange(2100)])) for k in range(600) if k % 9 for _ in range(2)]
    for name, rows, schema in (
        ("part", parts, "p_partkey long, p_retailprice double, p_brand string, p_size int, p_name string, p_type string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_partkey long"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(sf, f"{name}.parquet"))
    return sf


@pytest.mark.parametrize("name", ["j6_earlier_application_in_group", "k7_track_decision"])
def test_candidates_of_large_groups_equal_sql_and_are_not_moved(spark, dense, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{dense}/{t}.parquet/*.parquet')")
    theirs = con.execute(core.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    out = core.QUERIES[name](spark, dense)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    got = order(out.select(*columns).collect())
    assert got == order(theirs.fetchall())
    if name.startswith("k7"):
        assert len({x[3] for x in got}) == 4 and any(x[0] is None for x in got)
    out.collect()
    assert len(got) > 10_000 and most(out, "shuffleRecordsWritten", "ShuffleExchangeExec") <= 2_000


def test_tracking_is_decided_before_candidates_spread(spark, dense):
    """Above the join of groups and postings there is only what depends on a candidate: whether it is held."""
    plan = core.QUERIES["k7_track_decision"](spark, dense)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner, (group_key", 1)
    assert "already tracked" in above and "elsewhere" not in above and "elsewhere" in below


def test_candidates_go_by_lists_from_user_to_user(spark):
    """What files of many candidates compress: a list of postings repeats for all users of a share before the next list."""
    day = datetime.datetime(2024, 1, 1)
    posted = spark.createDataFrame([(k, "g") for k in range(1300)], "id long, group_key string")
    made = spark.createDataFrame([(k, k, 7 * k, "APPLIED", day) for k in range(100)], "id long, user_id long, job_id long, status string, created_at timestamp_ntz")
    groups = joins.applied_groups(made, posted, F.lit(day))
    rows = joins.group_candidates(groups, posted).select(F.spark_partition_id().alias("p"), "user_id", "candidate").collect()
    assert sorted((x.user_id, x.candidate) for x in rows) == [(u, c) for u in range(100) for c in range(1300)]
    runs = [len(list(same)) for _, same in itertools.groupby(rows, key=lambda x: (x.p, x.user_id))]
    assert max(runs) == 504


def test_groups_with_what_is_held_are_not_moved_again(spark, dense):
    """Rows of a user and group are made where the join with the group's postings needs them, whatever is too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = core.QUERIES["k7_track_decision"](spark, dense)
        out.collect()
        moved = [n for n in nodes(out._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    columns = ["".join(n.output().mkString(",")) for n in moved]
    assert len(columns) > 3 and not any("held" in c for c in columns)

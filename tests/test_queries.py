import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.abi_types import EventDef
from logweave.operators import aggregates as A
from logweave.operators import routing as R
from logweave.plans import paging
from logweave.plans import entity, rows, sql
from logweave.plans.dataset import index_batch
from logweave.plans.event_query import EventQuery, WhereClause, classify, event_query, latest, literal, where_from_map
from logweave.sources.catalog import Catalog
from logweave.sources.store import export
from tests.abi_codec import frame, log
from tests.test_filters import TRANSFER, account
from workload.adapters import ACTIVATED, CANCELED, CREATED, EXECUTED, FAILED, GOVERNANCE_CATALOG, QUEUED

SIGNED = EventDef.parse("Moved(address indexed who, int256 by, uint128 size, string note, bytes4 tag)")


@pytest.fixture(scope="module")
def moves(spark):
    values = [-(2**255), -5, -1, 0, 3, 10**30, 2**255 - 1]
    logs = [log(SIGNED, [account(i), v, abs(v) % 2**128, f"it's {i}", "0xdeadbeef"], block=100 + i, index=i) for i, v in enumerate(values)]
    return frame(spark, logs), values


@pytest.mark.parametrize("keys", [True, False])
def test_wide_numbers_compare_and_sort_as_numbers(moves, keys):
    logs, values = moves
    table = R.decode(logs, SIGNED, keys=keys)
    for op, keep in (("gt", lambda v, x: v > x), ("lte", lambda v, x: v <= x), ("lt", lambda v, x: v < x), ("gte", lambda v, x: v >= x), ("eq", lambda v, x: v == x)):
        for bound in (-5, 0, 10**30, 2**300, -(2**300)):
            got = event_query(table, SIGNED, EventQuery([WhereClause("by", op, str(bound))])).count()
            assert got == sum(keep(v, bound) for v in values), (op, bound)
    page = event_query(table, SIGNED, EventQuery(order_by="by", order_dir="desc", first=3, skip=1))
    assert [int(r.by) for r in page.collect()] == sorted(values, reverse=True)[1:4]
    assert "by__w" not in page.columns


def test_predicates(moves):
    table = R.decode(moves[0], SIGNED, keys=True)

    def count(where, **more):
        return event_query(table, SIGNED, EventQuery(where_from_map(where), **more)).count()

    assert count({"blockNumber": {"gte": "101", "lte": "103"}}) == 3
    assert count({"block_number": {"in": ["101", "105", "999999999999999999999999"]}}) == 2
    assert count({"block_number": {"lt": "99999999999999999999999999"}}) == 7
    assert count({"who": {"eq": account(3).upper().replace("0X", "0x")}}) == 1
    assert count({"who": {"eq": account(3)[2:]}}) == 1
    assert count({"note": {"eq": "it's 2"}}) == 1
    assert count({"tag": {"eq": "0xDEADBEEF"}}) == 7
    assert count({"by": {"in": ["-5", "3", "+3"]}}) == 2
    assert count({"logIndex": {"gt": "2"}}, condition={"who": account(4)}) == 1


def test_bad_queries(moves):
    table = R.decode(moves[0], SIGNED)
    for clause in (("by", "like", "1"), ("by", "in", "1"), ("by", "in", []), ("by", "eq", ["1"])):
        with pytest.raises(ValueError):
            WhereClause(*clause)
    for query in (
        EventQuery([WhereClause("by", "eq", "abc")]),
        EventQuery([WhereClause("who", "eq", "0x")]),
        EventQuery([WhereClause("who", "eq", "xyz")]),
        EventQuery([WhereClause("nope", "eq", "1")]),
        EventQuery(order_by="nope"),
        EventQuery(order_by="by", order_dir="up"),
        EventQuery(first=-1),
        EventQuery(skip=-1),
    ):
        with pytest.raises(ValueError):
            event_query(table, SIGNED, query)


def test_classes_and_literals():
    kinds = {c: classify(c, SIGNED) for c in ("block_number", "transaction_hash", "who", "by", "size", "note", "tag")}
    assert kinds == {"block_number": "long", "transaction_hash": "hex", "who": "hex", "by": "int", "size": "uint", "note": "text", "tag": "hex"}
    assert literal("0xAB", "hex") == literal("ab", "hex") == "0xab"
    assert literal("-7", "int") == -7 and literal("any'thing", "text") == "any'thing"


def test_api_names_and_latest(moves):
    data = index_batch(moves[0], Catalog.of(1, [SIGNED]), processed_to=200, keys=True)
    (name, run), = data.api().items()
    got = run(where={"blockNumber": {"gt": "104"}}, orderBy="blockNumber", orderDir="desc")
    assert got.columns[:4] == ["blockNumber", "transactionHash", "logIndex", "contractAddress"]
    assert [r.blockNumber for r in got.collect()] == [106, 105]
    assert [r.block_number for r in latest(data.tables[name], 2).collect()] == [106, 105]


def test_json_and_string_rows(spark):
    df = spark.sql(
        "SELECT 1 AS i, 1.5D AS d, true AS b, 12345678901234567890BD AS big, X'abcd' AS bin, "
        "TIMESTAMP '1970-01-01 00:00:01' AS ts, DATE '1970-01-03' AS day, CAST(NULL AS STRING) AS n, array(1, 2) AS a"
    )
    row = json.loads(rows.to_json_rows(df).first().row)
    assert row == {"i": 1, "d": 1.5, "b": True, "big": "12345678901234567890", "bin": "0xabcd", "ts": 1_000_000, "day": 2, "n": None, "a": "[1, 2]"}
    text = rows.to_string_rows(df.select("i", "b", "n")).first()
    assert (text.i, text.b, text.n) == ("1", True, None)


def test_raw_select(spark, moves):
    index_batch(moves[0], Catalog.of(1, [SIGNED]), processed_to=200, keys=True).register_views()
    name = SIGNED.table_name(1)
    assert sql.raw_select(spark, f'  select count(*) AS "n" FROM {name} WHERE "by" = \'3\'').first().n == 1
    assert "by__w" not in sql.raw_select(spark, f"SELECT * FROM {name}").columns
    for bad in ("DROP TABLE x", "WITH a AS (SELECT 1) SELECT * FROM a", f"INSERT INTO {name} VALUES (1)"):
        with pytest.raises(ValueError):
            sql.raw_select(spark, bad)
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"
    with pytest.raises(sql.SetupSqlError, match="no_such_table"):
        sql.run_setup_sql(spark, ["CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS a", "CREATE OR REPLACE TEMP VIEW v2 AS SELECT * FROM no_such_table"])


def governance(spark):
    def created(p, b):
        return log(CREATED, [p, account(9), 1, "0x" + "11" * 32], block=b, index=0)

    def activated(p, b):
        return log(ACTIVATED, [p, "0x" + "22" * 32, 86400], block=b, index=1)

    return frame(
        spark,
        [
            created(1, 17_600_000),
            activated(1, 17_600_100),
            log(QUEUED, [1, 500_000, 50_000], block=17_600_200, index=2),
            log(EXECUTED, [1], block=17_600_300, index=3),
            created(2, 17_700_000),
            activated(2, 17_700_100),
            log(FAILED, [2, 10_000, 800_000], block=17_700_200, index=2),
            created(3, 17_800_000),
            log(CANCELED, [3], block=17_800_100, index=1),
            created(4, 17_900_000),
        ],
    )


@pytest.mark.parametrize("build", [entity.lifecycle, entity.lifecycle_one_pass])
def test_proposal_states(spark, build):
    data = index_batch(governance(spark), GOVERNANCE_CATALOG, processed_to=18_000_000)
    table = {e.name: data.tables[e.table_name(1)] for e in GOVERNANCE_CATALOG.events}
    stages = {"va": table["VotingActivated"], "pq": table["ProposalQueued"], "pf": table["ProposalFailed"], "pex": table["ProposalExecuted"], "pcan": table["ProposalCanceled"]}
    out = build(table["ProposalCreated"], stages, "proposalId", data.blocks, {"pq": ["votesFor"], "pf": ["votesFor"]})
    order = [("pcan", "Canceled", 5), ("pex", "Executed", 4), ("pf", "Failed", 3), ("pq", "Queued", 2), ("va", "VotingActivated", 1)]
    out = entity.derive_state(out, order, ("Created", 0)).withColumn("votes", entity.first_of("pq__votesFor", "pf__votesFor"))
    got = {r.proposalId: (r.state, r.stateId, r.votes, r.created__at, r.pcan__at) for r in out.collect()}
    # The four reference life cycles; logs without a timestamp count as time 0.
    assert got == {
        "1": ("Executed", 4, "500000", 0, None),
        "2": ("Failed", 3, "10000", 0, None),
        "3": ("Canceled", 5, None, 0, 0),
        "4": ("Created", 0, None, 0, None),
    }


def test_hot_keys_join_like_a_left_join(spark):
    left = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).cast("long").alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k", "left")
    safe = entity.left_join_hot_keys(left, right, "k", hot_share=1 / 20, salts=4).select(*plain.columns)
    assert plain.exceptAll(safe).count() == 0 and safe.exceptAll(plain).count() == 0


def test_repeated_stage_repeats_the_entity(spark):
    logs = governance(spark).unionByName(frame(spark, [log(QUEUED, [1, 7, 7], block=17_600_201, index=9)]))
    data = index_batch(logs, GOVERNANCE_CATALOG, processed_to=18_000_000)
    base = data.tables[CREATED.table_name(1)]
    stages = {"pq": data.tables[QUEUED.table_name(1)]}
    for skew_safe in (False, True):
        assert entity.lifecycle(base, stages, "proposalId", data.blocks, skew_safe=skew_safe).count() == 5


def test_supply_and_balances(spark):
    # Minted, burned and the supply they leave; incoming, outgoing and the balance.
    mints = spark.createDataFrame([("586649044690017105",)], "amount string")
    burns = spark.createDataFrame([("534246887727239015",)], "amount string")
    assert A.total_supply(mints, burns).first().supply == "52402156962778090"
    logs = frame(spark, [log(TRANSFER, [account(1), account(2), 1012679061520274098], index=0), log(TRANSFER, [account(2), account(3), 1012625572111479566], block=2, index=1)])
    table = R.decode(logs, TRANSFER)
    assert A.balance_of(table, account(2).upper().replace("0X", "0x")).first().balance == "53489408794532"
    got = {r.account: r.balance for r in A.balances(table).collect()}
    assert got == {account(1): "-1012679061520274098", account(2): "53489408794532", account(3): "1012625572111479566"}
    assert {r.account for r in A.balances(table, at_block=1).collect()} == {account(1), account(2)}
    assert A.balance_of(table, account(77)).first().balance == "0"
    truth = spark.createDataFrame([(account(2), "53489408794532"), (account(9), "4")], "account string, balance string")
    rec = {r.account: (r.matches, r.difference) for r in A.reconcile(A.balances(table), truth, "account", "balance").collect()}
    assert rec[account(2)] == (True, "0") and rec[account(9)] == (False, "-4") and rec[account(3)][0] is False


def test_self_transfer_changes_no_balance(spark):
    table = R.decode(frame(spark, [log(TRANSFER, [account(1), account(1), 5])]), TRANSFER)
    assert [(r.account, r.balance) for r in A.balances(table).collect()] == [(account(1), "0")]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    export(df, str(tmp_path / "p"))
    export(df, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().y == "a"
    with pytest.raises(ValueError):
        export(df, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_against_a_sort(spark, descending):
    """Pages of every depth, with a sort key that most rows share, and rows with equal keys in all."""
    rng = random.Random(4)
    rows = [(rng.randrange(50), f"0x{rng.randrange(40):02x}", rng.randrange(3), rng.choice([1, 1, 1, 2, 3])) for _ in range(600)]
    table = spark.createDataFrame(rows, "block_number long, transaction_hash string, log_index int, v int").repartition(4)
    want = sorted(sorted(rows, key=lambda r: r[:3]), key=lambda r: r[3], reverse=descending)
    for enough, key in ((10_000, F.col("v")), (40, F.col("v"))):
        for skip in (0, 7, 290, 595, 600, 700):
            got = [tuple(r) for r in paging.page(table, paging.Order(key, descending), 9, skip, enough).collect()]
            assert got == want[skip : skip + 9]
    by_key = [tuple(r)[:3] for r in paging.page(table, paging.Order(), 9, 300, 40).collect()]
    assert by_key == sorted(r[:3] for r in rows)[300:309]
    assert paging.page(table.limit(0), paging.Order(), 9, 300, 40).count() == 0

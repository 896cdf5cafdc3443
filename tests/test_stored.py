"""Stored parents, key filters, pages, ranges and co-located copies."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tradewind.filters import FilterSpec
from tradewind.functions.geography import department_of, postcode_ranges, within_ranges
from tradewind.functions.geomap import DEPARTMENTS, REGIONS
from tradewind.operators import closure, keyfilter
from tradewind.operators.geo import matching_addresses
from tradewind.operators.orders import select_orders
from tradewind.operators.predicates import day_range
from tradewind.operators.wide import flat_orders
from tradewind.plans.entities import ENTITIES
from tradewind.registry.queries import QUERIES
from tradewind.sinks.csvfiles import write_csv
from tradewind.sinks.manifest import file_manifest
from tradewind.sources import scans
from tradewind.sources.colocated import write_colocated
from tradewind.sources.shop import Shop
from tradewind.sources.standin import SampleShop
from tradewind.workspace import Files, Scratch, unstored


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts(tables):
    return {n: t.count() for n, t in tables.items()}


# Stored parents.


def test_children_read_only_the_key_of_stored_parents(spark):
    shop = SampleShop(spark, SMALL)
    plan = closure.plan_export(shop, "orders", "complete")
    roots = {"orders": select_orders(shop, FilterSpec(payment="5-LOW"))}
    with Scratch(spark) as scratch:
        tables = closure.relational_closure(shop, plan, roots, scratch.store)
        for name in ("order_detail", "order_slip", "order_payment"):
            text = planned(tables[name])
            columns = {c for part in re.findall(rf"Location: [^\n]*{re.escape(os.path.basename(scratch.folder))}/orders\][^\n]*ReadSchema: struct<([^>]*)>", text) for c in part.split(",")}
            assert columns and {c.split(":")[0] for c in columns} <= {"id_order", "reference"}, text
            assert "o_orderpriority" not in text
        stored = counts(tables)
        assert scratch.folder.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.exists(scratch.folder)
    assert not os.path.exists(scratch.folder)
    assert stored == counts(closure.relational_closure(shop, plan, roots, unstored)) == counts(closure.relational_closure(shop, plan, roots))


def test_stored_tables_go_after_an_error_too(spark, tmp_path):
    with pytest.raises(ZeroDivisionError), Scratch(spark, str(tmp_path / "s")) as scratch:
        assert scratch.store("t", spark.range(3)).count() == 3
        1 / 0
    assert not os.path.exists(tmp_path / "s")


@pytest.mark.parametrize("name", ["relational_closure", "relational_closure_customers", "reference_bundle", "custom_table_closure", "scan_children_scattered"])
def test_closures_leave_nothing_in_the_shared_folder(spark, name):
    def held():
        return {p for p in glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**", recursive=True) if os.path.isfile(p)}

    before = held()
    assert QUERIES[name](spark, SMALL).count() > 0
    assert held() == before


def test_bundles_agree_however_ids_are_kept(spark):
    shop = SampleShop(spark, SMALL)
    plan = closure.plan_export(shop, "full", "complete")
    tables = closure.relational_closure(shop, plan, {"orders": select_orders(shop, FilterSpec(id_max=200)), "customer": shop["customer"].where("id_customer < 40")}, unstored)
    with Scratch(spark) as scratch:
        stored = counts(closure.reference_bundle(shop, tables, scratch.store))
    assert stored == counts(closure.reference_bundle(shop, tables, unstored)) and len(stored) > 3


def test_json_files_are_there_whole_or_not_at_all(spark, tmp_path):
    files, place = Files(spark), str(tmp_path / "a" / "b.json")
    assert files.read_json(place) is None and files.names(str(tmp_path / "none")) == []
    files.write_json(place, {"größe": [1, None]})
    assert files.read_json(place) == {"größe": [1, None]} and files.names(str(tmp_path / "a")) == ["b.json"]
    with pytest.raises(FileExistsError):
        files.write_json(place, 2)
    assert files.names(str(tmp_path / "a")) == ["b.json"]


# Key filters.


def scattered(spark, tmp_path):
    """A hundredth of 40,000 orders, all over the key range, and 200,000 lines, a third of them of one order."""
    lines = spark.range(200_000).select(
        F.col("id").alias("id_order_detail"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(40_000))).alias("id_order")
    )
    lines.write.parquet(f"{tmp_path}/lines")
    orders = spark.range(40_000).select(F.col("id").alias("id_order"), F.concat(F.lit("R"), "id").alias("reference"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(100)).alias("state"))
    chosen = orders.where("state = 3 AND id_order <> 7")
    return spark.read.parquet(f"{tmp_path}/lines"), chosen


def test_few_rows_pass_a_filter_of_scattered_parents(spark, tmp_path):
    lines, chosen = scattered(spark, tmp_path)
    shop = Shop(spark, {"order_detail": lines})
    with Scratch(spark) as scratch:
        parents = scratch.store("orders", chosen)
        known = closure.parent_keys(parents, "id_order", ["id_order"], scratch.store, "orders")
        assert known.scattered and known.high - known.low > 39_000
        passed = keyfilter.passing(lines, "id_order", known.filters["id_order"])
        assert passed.count() <= 0.02 * lines.count()
        children = closure.scan_children(shop, ENTITIES["order_detail"], parents, known)
        plan = planned(children)
        want = lines.join(chosen, "id_order", "left_semi")
        assert sorted(map(tuple, children.collect())) == sorted(map(tuple, want.select(lines.columns).collect())) != []
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "GreaterThanOrEqual(id_order," in plan and "LessThanOrEqual(id_order," in plan
    filtered = plan[plan.index("LeftSemi") :]
    assert "BroadcastHashJoin [shiftrightunsigned(xxhash64(id_order" in plan and filtered


def test_the_filter_stands_below_the_exchange(spark, tmp_path):
    lines, chosen = scattered(spark, tmp_path)
    shop = Shop(spark, {"order_detail": lines})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = closure.parent_keys(chosen, "id_order", ["id_order"], unstored, "orders")
        children = closure.scan_children(shop, ENTITIES["order_detail"], chosen, known)
        children.collect()
        stages = planned(children).split("== Initial Plan ==")[0].splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchange = next(i for i, line in enumerate(stages) if "Exchange hashpartitioning(id_order" in line)
    assert any("BroadcastHashJoin [shiftrightunsigned" in line for line in stages[exchange : exchange + 4])


@pytest.mark.parametrize("words", [1 << 10, 1 << 18])
def test_no_child_of_a_parent_is_lost(spark, words):
    keys = spark.range(0, 5000, 3).select(F.col("id").alias("k"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("ref"))
    for column in ("k", "ref"):
        held = keyfilter.key_filter(keys, column, words)
        assert held.count() <= words
        assert keyfilter.passing(keys, column, held, words).count() == keys.count()
    assert keyfilter.passing(keys.where("k < 0"), "k", keyfilter.key_filter(keys, "k")).count() == 0
    assert keyfilter.passing(keys, "k", keyfilter.key_filter(keys.where("k < 0"), "k")).count() == 0


def test_no_filter_where_it_would_not_help():
    assert not keyfilter.ParentKeys(900, 1, 1000).scattered and not keyfilter.ParentKeys(0, None, None).scattered
    assert not keyfilter.ParentKeys(10**9, 1, 10**12).scattered
    assert keyfilter.ParentKeys(100, 1, 1000).scattered


# Pages.


@pytest.mark.parametrize("limit, cursor", [(7, None), (100, 300), (10**6, None)])
def test_all_pages_equal_one_page_after_the_other(spark, limit, cursor):
    rows = SampleShop(spark, SMALL)["orders"].select("id_order", "id_customer").where("id_order % 5 > 1")
    got = {}
    paged = scans.keyset_pages(rows, "id_order", limit, cursor)
    plan = planned(paged)
    for r in paged.collect():
        got.setdefault(r.page, []).append(r.id_order)
    n, last = 0, cursor
    keys = sorted(r.id_order for r in rows.collect() if r.id_order > (cursor or -1))
    while page := [k for k in keys if last is None or k > last][:limit]:
        n += 1
        assert sorted(got[n]) == page
        if n in (1, 2, 5):
            assert [r.id_order for r in scans.keyset_page(rows, "id_order", last, limit).collect()] == page
        last = page[-1]
    assert len(got) == n
    assert len(re.findall("FileScan parquet", plan)) == 1
    for window in re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan):
        assert "_part" in window


def test_pages_of_uneven_and_of_no_keys(spark):
    keys = [-(2**62), -3, 5, 2**63 - 1, *range(10**6, 10**6 + 9000, 3)]
    rows = spark.createDataFrame([(k, k) for k in keys], "id long, _part long").repartition(3)
    got = sorted((r.page, r.id) for r in scans.keyset_pages(rows, "id", 11).collect())
    assert got == [(i // 11 + 1, k) for i, k in enumerate(sorted(keys))]
    assert scans.keyset_pages(rows, "id", 11).columns == ["id", "_part", "page"]
    assert scans.keyset_pages(rows.where("id > 5 AND id < 6"), "id", 11).collect() == []


# Postcode ranges.

POSTCODES = sorted({f"{n:05d}" for n in range(0, 99999, 23)} | {"2A004", "2B1", "20", "9", "97", "971", "97400", "98", "200", "20199", "20299", "", "é1", "0100"})


def addresses(spark, tmp_path):
    if not os.path.exists(f"{tmp_path}/address"):
        rows = [(i, p, 8 if i % 2 else 9) for i, p in enumerate(POSTCODES)] + [(-1, None, 8)]
        spark.createDataFrame(rows, "id_address long, postcode string, id_country long").coalesce(1).write.parquet(f"{tmp_path}/address")
    return Shop(spark, {"address": spark.read.parquet(f"{tmp_path}/address")})


def test_every_department_keeps_its_postcodes(spark, tmp_path):
    """All codes of the map, with Corsica's read and not, against the department of every postcode."""
    rows = spark.createDataFrame([(p,) for p in POSTCODES], "p string")
    for corsica in (False, True):
        found = rows.select("p", department_of(F.col("p"), corsica).alias("d")).collect()
        for code, *_ in DEPARTMENTS:
            ranges = postcode_ranges([code], corsica)
            want = {r.p for r in found if r.d == code}
            got = {p for p in POSTCODES if any(low <= p and (high is None or p < high) for low, high in ranges)}
            assert want <= got, code
            if len(code) == 3 or code[0] != "2":
                assert all(p.startswith(code) for p in got)


@pytest.mark.parametrize("corsica", [False, True])
def test_ranges_do_not_change_results(spark, tmp_path, corsica):
    shop = addresses(spark, tmp_path)
    code = department_of(F.col("postcode"), corsica)
    plain = {}
    for r in shop["address"].select("id_address", code.alias("d")).collect():
        plain.setdefault(r.d, set()).add(r.id_address)
    regions = {}
    for c, _, region in DEPARTMENTS:
        regions.setdefault(region, set()).update(plain.get(c, set()))
    for wanted in [["01"], ["2A"], ["2B", "05"], ["971", "974"], ["01", "02", "03"], ["99"], [c for c, *_ in DEPARTMENTS]]:
        known = [c for c in wanted if c in {d[0] for d in DEPARTMENTS}]
        got = {r.id_address for r in matching_addresses(shop, FilterSpec(dept_code=wanted), corsica=corsica).collect()}
        assert got == set().union(*(plain.get(c, set()) for c in known)), wanted
    for region in REGIONS:
        got = {r.id_address for r in matching_addresses(shop, FilterSpec(region_code=[region]), corsica=corsica).collect()}
        assert got == regions.get(region, set()), region


def test_ranges_reach_the_scan(spark, tmp_path):
    shop = addresses(spark, tmp_path)
    plan = planned(matching_addresses(shop, FilterSpec(dept_code=["03", "02", "974"])))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    for test in ("GreaterThanOrEqual(postcode,02)", "LessThan(postcode,04)", "GreaterThanOrEqual(postcode,974)", "LessThan(postcode,975)"):
        assert test in pushed
    corsican = planned(matching_addresses(shop, FilterSpec(region_code=["COR"]), corsica=True))
    assert "GreaterThanOrEqual(postcode,206)" in corsican and "LessThan(postcode,203)" in corsican


def test_ranges_are_merged_and_few():
    assert postcode_ranges(["02", "01", "04"]) == [("01", "03"), ("04", "05")]
    assert postcode_ranges(["2B", "2A"], corsica=True) == [("200", "203"), ("206", "207"), ("2A", "2C")]
    assert postcode_ranges(["97", "974"]) == [("97", "98")]
    assert postcode_ranges([]) == [] and postcode_ranges([""]) == [("", None)]
    assert postcode_ranges(["\U0010ffff", "a\U0010ffff"]) == [("a\U0010ffff", "b"), ("\U0010ffff", None)]
    assert postcode_ranges(["퟿"]) == [("퟿", "")]
    many = postcode_ranges([f"{i:03d}" for i in range(0, 999, 2)])
    assert many == [("000", "999")]


def test_no_range_lets_nothing_through(spark):
    assert spark.range(3).where(within_ranges(F.col("id").cast("string"), [])).count() == 0


# Co-located copies.


def test_lines_meet_their_orders_without_a_shuffle(spark, tmp_path):
    shop = SampleShop(spark, SMALL)
    copies = write_colocated(shop, "default", ["orders", "order_detail"], 8, prefix=f"c{os.getpid()}_", path=str(tmp_path))
    spec = FilterSpec(date_add_from="1997-01-01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planned(flat_orders(copies, spec)).splitlines()
        usual = planned(flat_orders(shop, spec))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans_ = [i for i, line in enumerate(plan) if "FileScan parquet" in line and "order_detail" in line]
    assert len(scans_) == 2 and "hashpartitioning(id_order" in usual
    for i in scans_:
        depth = plan[i].index("FileScan")
        above = []
        for line in reversed(plan[:i]):
            at = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if at < depth:
                above.append(line)
                depth = at
            if "SortMergeJoin [id_order" in line and at <= depth:
                break
        assert above and not any("Exchange" in line for line in above)
    got, want = (sorted(map(str, flat_orders(s, spec).collect())) for s in (copies, shop))
    assert got == want
    by_catalog = Shop.from_catalog(spark, "default", f"c{os.getpid()}_")
    assert {"orders", "order_detail"} <= set(by_catalog) and by_catalog["orders"].count() == shop["orders"].count()


def test_a_huge_order_is_refused(spark, tmp_path):
    shop = SampleShop(spark, SMALL)
    hot = shop["order_detail"].withColumn("id_order", F.lit(7))
    with pytest.raises(ValueError, match="of one id_order"):
        write_colocated(shop.replace(order_detail=hot), "default", ["orders", "order_detail"], 4, prefix="hot_", path=str(tmp_path), most_rows=1000)
    assert not [t for t in spark.catalog.listTables("default") if t.name.startswith("hot_")]


# Manifests and dates.


@pytest.mark.parametrize("folder", ["größe", "a%20b", "a b", "a#b", "a+b?c", "日本"])
def test_manifest_of_any_path(spark, tmp_path, folder):
    path = f"{tmp_path}/{folder}"
    write_csv(spark.range(23).repartition(2), path)
    rows = file_manifest(spark, {"t": path}).collect()
    assert sum(r.row_count for r in rows) == 23 and len(rows) == 2
    sizes = sorted(os.path.getsize(p) for p in glob.glob(f"{glob.escape(path)}/part-*"))
    assert sorted(r.filesize for r in rows) == sizes


def test_the_last_day_of_the_calendar_bounds_nothing(spark):
    rows = spark.sql("SELECT timestamp_ntz '9999-12-31 23:59:59.999' AS t UNION ALL SELECT timestamp_ntz '2024-01-01 00:00:00'")
    for first, last, n in [("2024-01-01", "9999-12-31", 2), (None, "9999-12-30", 1), ("9999-12-31", "9999-12-31", 1)]:
        kept = rows
        for test in day_range(F.col("t"), first, last):
            kept = kept.where(test)
        assert kept.count() == n

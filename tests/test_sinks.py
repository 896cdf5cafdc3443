import glob
import gzip
import hashlib
import os

import pytest

from tradewind.filters import FilterSpec
from pyspark.sql import functions as F

from tradewind.functions.cells import csv_safe_cells, csv_safe_value, plain_number
from tradewind.sinks.csvfiles import CsvOptions, read_csv, write_csv
from tradewind.sinks.exports import export_enriched, export_flat, export_relational
from tradewind.sinks.manifest import file_manifest
from tradewind.sources.shop import Shop
from tradewind.workspace import scratch_dir

TEXTS = ["a;b", 'say "x"', "two\nlines", "cr\rhere", " spaces ", "back\\slash\"", "", None, "é€", "=1"]


def text_frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(text_frame(spark).coalesce(2), path)
    back = {int(r.id): r.text for r in read_csv(spark, path).collect()}
    want = {i: t or None for i, t in enumerate(TEXTS)}
    want[9] = "'=1"
    assert back == want


def test_every_part_has_mark_and_header(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(text_frame(spark).repartition(3), path)
    parts = glob.glob(f"{path}/part-*")
    assert len(parts) == 3
    assert all(open(p, "rb").read().startswith(b"\xef\xbb\xbfid;text\n") for p in parts)


def test_single_column_keeps_empty_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(text_frame(spark).select("text"), path)
    assert read_csv(spark, path).count() == len(TEXTS)


def test_declared_columns(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(text_frame(spark), path, CsvOptions(bom=False, sep=","), columns=["extra", "id"])
    assert open(glob.glob(f"{path}/part-*")[0]).readline() == "extra,id\n"


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    options = CsvOptions(rows_per_file=4)
    write_csv(text_frame(spark).coalesce(1), path, options)
    rows = file_manifest(spark, {"texts": path}, options).collect()
    assert sorted(r.row_count for r in rows) == [2, 4, 4]
    for r in rows:
        data = open(r.filepath.removeprefix("file:"), "rb").read()
        assert (r.filesize, r.checksum) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.entity_name == "texts" and r.filename.startswith("part-")


def test_relational_export_is_consistent(spark, shop, tmp_path):
    specs = {"orders": FilterSpec(has_payment=True), "customers": FilterSpec(newsletter=True)}
    done = export_relational(
        shop, str(tmp_path), "full", "complete", specs,
        options=CsvOptions(anonymize=True), include_custom_tables=True,
    )
    read = {n: read_csv(spark, p) for n, p in done.outputs.items()}
    assert {r.id_order for r in read["order_detail"].collect()} == {"1", "2", "3"}
    assert {r.id_customer for r in read["address"].collect()} == {"1"}
    assert {r.id_wishlist for r in read["wishlist"].collect()} == {"1"}
    assert read["customer"].first().passwd == "***MASKED***"
    assert read["orders"].columns == shop["orders"].columns
    assert done.cursors == {"orders": 3, "customer": 5}
    assert "country_lang" in read


def test_incremental_export(spark, shop, tmp_path):
    spec = {"orders": FilterSpec(incremental=True)}
    first = export_relational(shop, str(tmp_path / "a"), "orders", specs=spec, cursors={"orders": 3})
    assert {r.id_order for r in read_csv(spark, first.outputs["orders"]).collect()} == {"4", "5"}
    second = export_relational(
        shop, str(tmp_path / "b"), "orders", specs=spec, cursors=first.cursors
    )
    assert read_csv(spark, second.outputs["orders"]).count() == 0
    assert second.cursors == {"orders": 5}


def test_without_custom_columns(spark, shop, tmp_path):
    done = export_relational(
        shop.replace(orders=shop["orders"].selectExpr("*", "'x' AS gift_card")),
        str(tmp_path), "orders", include_custom_columns=False, include_reference=False,
    )
    assert read_csv(spark, done.outputs["orders"]).columns == shop["orders"].columns


def test_wide_exports(spark, shop, tmp_path):
    flat = read_csv(spark, export_flat(shop, str(tmp_path), ordered=True).outputs["export_complet"])
    assert [int(r.id_order) for r in flat.collect()] == [1, 1, 1, 2, 3, 4, 5]
    assert len(flat.columns) == 39
    rich = export_enriched(shop, str(tmp_path), FilterSpec(id_min=4)).outputs["orders_enriched"]
    assert read_csv(spark, rich).count() == 2


@pytest.mark.parametrize("export", [export_enriched, export_flat])
def test_wide_exports_continue_after_their_cursor(spark, shop, tmp_path, export):
    spec = FilterSpec(incremental=True, id_max=4)
    first = export(shop, str(tmp_path / "1"), spec, cursor=2, ordered=True)
    (output,) = first.outputs.values()
    assert {r.id_order for r in read_csv(spark, output).collect()} == {"3", "4"}
    assert first.cursors == {"main": 4}
    second = export(shop, str(tmp_path / "2"), spec, cursor=first.cursors["main"])
    (output,) = second.outputs.values()
    assert read_csv(spark, output).count() == 0
    assert second.cursors == {"main": 4}
    whole = export(shop, str(tmp_path / "3"))
    assert whole.cursors == {"main": 5}


def test_scratch_follows_the_session(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_column_collision_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        write_csv(spark.sql("SELECT 1 AS `a b`, 2 AS `a-b`"), str(tmp_path / "x"))


def test_safe_cells_leave_no_formula(spark):
    cells = [r.text for r in csv_safe_cells(text_frame(spark)).collect()]
    assert not any(c[:1] in ("=", "+", "-", "@") for c in cells)


def test_no_cell_is_overwritten(spark):
    rows = spark.sql("SELECT 'keepme' AS _dirty, 'a' || char(1) AS _dirty_, 1 AS n")
    assert csv_safe_cells(rows).first().asDict() == {"_dirty": "keepme", "_dirty_": "a", "n": "1"}


def test_numbers_have_no_power_of_ten(spark):
    texts = {
        "1.23456789E7": "12345678.9", "1.0E-4": "0.0001", "-1.5E-10": "-0.00000000015",
        "1.0E7": "10000000.0", "-9.99E300": "-999" + "0" * 298 + ".0", "12.5": "12.5", "NaN": "NaN",
        "4.9E-324": "0." + "0" * 323 + "49", "0E-18": "0." + "0" * 18,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.p for r in rows.select("t", plain_number(F.col("t")).alias("p")).collect()}
    assert got == texts
    row = spark.sql("SELECT 12345678.9D AS d, CAST(0.0000001 AS DECIMAL(20,10)) AS m, '1.0E-4' AS t")
    assert csv_safe_cells(row).first().asDict() == {"d": "12345678.9", "m": "0.0000001000", "t": "1.0E-4"}
    value = row.select(csv_safe_value(F.col("d")).alias("d"), csv_safe_value(F.col("t")).alias("t")).first()
    assert value.asDict() == {"d": "12345678.9", "t": "1.0E-4"}


def test_manifest_reads_files_in_blocks(spark, tmp_path):
    path, limit = str(tmp_path / "out"), "spark.sql.sources.binaryFile.maxLength"
    rows = spark.range(40).select("id", F.expr("repeat('two\nlines \"x\" ', 10000)").alias("t")).coalesce(1)
    write_csv(rows, path)
    spark.conf.set(limit, str(1 << 20))
    try:
        found = file_manifest(spark, {"texts": path}).collect()
    finally:
        spark.conf.unset(limit)
    (part,) = glob.glob(f"{path}/part-*")
    data = open(part, "rb").read()
    assert len(data) > 4 << 20
    assert [(r.filesize, r.row_count, r.checksum) for r in found] == [
        (len(data), 40, hashlib.sha256(data).hexdigest())
    ]


def test_manifest_of_compressed_files(spark, tmp_path):
    path, options = str(tmp_path / "out"), CsvOptions(compression="gzip")
    write_csv(text_frame(spark).coalesce(1), path, options)
    (row,) = file_manifest(spark, {"texts": path}, options).collect()
    (part,) = glob.glob(f"{path}/part-*")
    assert row.row_count == len(TEXTS) and row.filesize == os.path.getsize(part)
    assert gzip.open(part).read(3) == b"\xef\xbb\xbf"
    with pytest.raises(ValueError):
        file_manifest(spark, {"texts": path}, CsvOptions(compression="lz4"))


def test_parts_are_bounded_by_bytes(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).select(F.lpad(F.col("id").cast("string"), 999, "x").alias("t")).coalesce(1)
    write_csv(rows, path, CsvOptions(bytes_per_file=20_000))
    sizes = [os.path.getsize(p) for p in glob.glob(f"{path}/part-*")]
    assert len(sizes) == 5 and max(sizes) < 22_000


def test_reference_table_with_a_root_key_is_no_own_table(spark, shop, tmp_path):
    owned = shop["cart_rule"].withColumn("id_customer", F.lit(1).cast("long"))
    done = export_relational(
        shop.replace(cart_rule=owned), str(tmp_path), "full", "complete", include_custom_tables=True
    )
    assert {r.code for r in read_csv(spark, done.outputs["cart_rule"]).collect()} == {"NOEL_10", "ETE20"}
    assert "wishlist" in done.outputs


def test_export_leaves_no_scratch(spark, shop, tmp_path):
    done = export_relational(shop, str(tmp_path / "a"), "full", "ultra")
    assert not glob.glob(f"{tmp_path}/a/_scratch/*")
    export_relational(shop, str(tmp_path / "b"), "orders", scratch=str(tmp_path / "s"))
    assert not glob.glob(f"{tmp_path}/s/*") and not os.path.exists(tmp_path / "b" / "_scratch")
    for name, path in done.outputs.items():
        assert read_csv(spark, path).columns == done.columns[name]


def test_ordered_relational_export(spark, shop, tmp_path):
    rows = shop["order_detail"].repartition(3, "product_name")
    done = export_relational(shop.replace(order_detail=rows), str(tmp_path), "orders", "complete", ordered=True)
    back = read_csv(spark, done.outputs["order_detail"]).withColumn("f", F.input_file_name())
    lines = sorted((r.f, i, int(r.id_order_detail)) for i, r in enumerate(back.collect()))
    assert [x[2] for x in lines] == [1, 2, 3, 4, 5]


def test_child_without_its_parent_table_is_left_out(spark, shop, tmp_path):
    tables = {n: shop[n] for n in shop if n != "order_slip"}
    done = export_relational(Shop(spark, tables), str(tmp_path), "orders", "ultra")
    assert "order_slip_detail" not in done.outputs and "order_detail" in done.outputs

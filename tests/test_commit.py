"""Exports that fail in the middle, or whose driver dies, and are called again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.sinks import commit
from tradewind.sinks.commit import ExportLog, discard
from tradewind.sinks.csvfiles import read_csv
from tradewind.sinks.exports import export_enriched, export_flat, export_relational


class Killed(BaseException):
    """The driver is gone."""


def broken(shop, table="order_history", column="id_order_state"):
    rows = shop[table].withColumn(column, F.raise_error(F.lit("unreadable")).cast("long"))
    return shop.replace(**{table: rows})


def visible(path):
    return sorted(n for n in os.listdir(path) if n[0] not in "_.") if os.path.exists(path) else []


def ids(spark, done, table="orders", key="id_order"):
    return sorted(int(r[key]) for r in read_csv(spark, done.outputs[table]).collect())


@pytest.mark.parametrize("scratch", [None, "elsewhere"])
def test_a_failed_export_is_called_again(spark, shop, tmp_path, scratch):
    path, options = str(tmp_path / "out"), {}
    if scratch:
        options["scratch"] = str(tmp_path / scratch)
    with pytest.raises(Exception, match="unreadable"):
        export_relational(broken(shop), path, "full", "complete", **options)
    assert visible(path) == []
    (staging,) = glob.glob(f"{path}/_staging-*")
    assert "order_detail" in os.listdir(f"{staging}/data") and "order_history" not in os.listdir(f"{staging}/data")
    done = export_relational(shop, path, "full", "complete", **options)
    plain = export_relational(shop, str(tmp_path / "plain"), "full", "complete")
    assert visible(path) == visible(str(tmp_path / "plain")) == sorted(done.outputs)
    for name in done.outputs:
        rows = [sorted(map(str, read_csv(spark, e.outputs[name]).collect())) for e in (done, plain)]
        assert rows[0] == rows[1], name
    assert done.cursors == plain.cursors and done.columns == plain.columns
    assert not glob.glob(f"{path}/_*") and not glob.glob(f"{tmp_path}/elsewhere/*")


def test_finished_datasets_and_parents_are_kept(spark, shop, tmp_path):
    """What changed in between does not tear tables apart: the second call goes on with the parents of the first."""
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="unreadable"):
        export_relational(broken(shop), path, "orders", "complete")
    written = {p: os.path.getmtime(p) for p in glob.glob(f"{path}/_staging-*/data/order_detail/part-*")}
    assert written
    fewer = shop.replace(orders=shop["orders"].where("id_order < 2"))
    done = export_relational(fewer, path, "orders", "complete")
    assert ids(spark, done) == [1, 2, 3, 4, 5] and ids(spark, done, "order_history") == [1, 1, 2, 3, 3]
    kept = {os.path.getmtime(p) for p in glob.glob(f"{path}/order_detail/part-*")}
    assert kept == set(written.values())


def test_another_export_does_not_take_over_what_one_left(spark, shop, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="unreadable"):
        export_relational(broken(shop), path, "orders", "complete")
    done = export_relational(shop, path, "orders", "complete", {"orders": FilterSpec(id_max=2)})
    assert ids(spark, done) == [1, 2]
    assert glob.glob(f"{path}/_staging-*")
    discard(spark, path)
    assert not glob.glob(f"{path}/_staging-*") and "orders" in visible(path)


def test_a_path_that_holds_a_dataset_is_refused(spark, shop, tmp_path):
    export_relational(shop, str(tmp_path), "orders")
    with pytest.raises(FileExistsError):
        export_relational(shop, str(tmp_path), "orders")
    export_flat(shop, str(tmp_path))
    with pytest.raises(FileExistsError):
        export_flat(shop, str(tmp_path), FilterSpec(id_min=2))
    assert not glob.glob(f"{tmp_path}/_*")


def test_a_driver_that_dies_between_renames(spark, shop, tmp_path, monkeypatch):
    path, moved = str(tmp_path / "out"), []
    move = commit.Files.move

    def dying(self, source, target):
        if "/data/" in source:
            moved.append(target)
            if len(moved) == 3:
                raise Killed
        move(self, source, target)

    monkeypatch.setattr(commit.Files, "move", dying)
    with pytest.raises(Killed):
        export_relational(shop, path, "orders", "complete")
    monkeypatch.undo()
    assert len(visible(path)) == 2
    for name in visible(path):  # each one that is visible is whole
        assert os.path.exists(f"{path}/{name}/_SUCCESS")
    done = export_relational(shop, path, "orders", "complete")
    assert visible(path) == sorted(done.outputs) and ids(spark, done) == [1, 2, 3, 4, 5]
    assert not glob.glob(f"{path}/_*")


@pytest.mark.parametrize("where", ["before", "after"])
@pytest.mark.parametrize("kind", ["relational", "enriched", "flat"])
def test_no_row_is_lost_or_repeated_when_the_driver_dies(spark, shop, tmp_path, monkeypatch, where, kind):
    """Orders arrive in two lots; the driver dies around the commit of the second run, which is called again."""
    log = ExportLog(spark, str(tmp_path / "log"))
    spec = FilterSpec(incremental=True)

    def export(shop, run):
        path = str(tmp_path / str(run))
        if kind == "relational":
            return export_relational(shop, path, "orders", specs={"orders": spec}, log=log)
        return (export_enriched if kind == "enriched" else export_flat)(shop, path, spec, log=log)

    def exported(done):
        return sorted({int(r.id_order) for r in read_csv(spark, next(p for n, p in done.outputs.items() if n in ("orders", "orders_enriched", "export_complet"))).collect()})

    early = shop.replace(orders=shop["orders"].where("id_order <= 2"))
    root = "orders" if kind == "relational" else "main"
    assert exported(export(early, 1)) == [1, 2] and log.cursors() == {root: 2}

    def die(*_, **__):
        raise Killed

    if where == "before":
        monkeypatch.setattr(ExportLog, "append", die)
    else:
        monkeypatch.setattr(commit, "publish", die)
    with pytest.raises(Killed):
        export(shop, 2)
    monkeypatch.undo()
    assert log.cursors() == {root: 2 if where == "before" else 5}
    assert visible(str(tmp_path / "2")) == []
    again = export(shop, 2)
    assert exported(again) == [3, 4, 5] and again.cursors == {root: 5} and log.cursors() == {root: 5}
    assert exported(export(shop, 2)) == [3, 4, 5]  # the same call is the same export
    assert exported(export(shop, 3)) == [] and log.cursors() == {root: 5}
    numbers = [(r.number, r.cursors) for r in log.records().orderBy("number").collect()]
    assert numbers == [(1, {root: 2}), (2, {root: 5}), (3, {root: 5})]


def test_the_next_run_finishes_what_counts_already(spark, shop, tmp_path, monkeypatch):
    log, spec = ExportLog(spark, str(tmp_path / "log")), {"orders": FilterSpec(incremental=True)}
    monkeypatch.setattr(commit, "publish", lambda *_: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        export_relational(shop, str(tmp_path / "1"), "orders", specs=spec, log=log)
    monkeypatch.undo()
    late = export_relational(shop, str(tmp_path / "2"), "orders", specs=spec, log=log)
    assert ids(spark, late) == [] and "orders" in visible(str(tmp_path / "1"))


def test_what_a_run_left_behind_an_old_cursor_starts_anew(spark, shop, tmp_path):
    log, spec = ExportLog(spark, str(tmp_path / "log")), {"orders": FilterSpec(incremental=True)}
    with pytest.raises(Exception, match="unreadable"):
        export_relational(broken(shop, "order_detail", "product_id"), str(tmp_path / "1"), "orders", specs=spec, log=log)
    export_relational(shop.replace(orders=shop["orders"].where("id_order <= 3")), str(tmp_path / "2"), "orders", specs=spec, log=log)
    done = export_relational(shop, str(tmp_path / "1"), "orders", specs=spec, log=log)
    assert ids(spark, done) == [4, 5]


def test_only_continued_roots_move_their_cursor(spark, shop, tmp_path):
    log = ExportLog(spark, str(tmp_path / "log"))
    assert log.cursors() == {} and log.records().count() == 0
    export_relational(shop, str(tmp_path / "1"), "full", specs={"orders": FilterSpec(incremental=True, id_max=4)}, log=log)
    assert log.cursors() == {"orders": 4}
    export_relational(shop, str(tmp_path / "2"), "customers", specs={"customers": FilterSpec(incremental=True)}, log=log)
    assert log.cursors() == {"orders": 4, "customer": 5}


def test_a_call_that_cannot_succeed_leaves_nothing(spark, shop, tmp_path):
    """Its dimensions are there already, or a table of the shop's own has a dimension's name."""
    export_relational(shop, str(tmp_path / "a"), "customers")
    held = visible(str(tmp_path / "a"))
    assert "country" in held
    with pytest.raises(FileExistsError, match="country"):
        export_relational(shop.replace(orders=shop["orders"].withColumn("id_country", F.lit(8).cast("long"))), str(tmp_path / "a"), "orders")
    assert visible(str(tmp_path / "a")) == held and not glob.glob(f"{tmp_path}/a/_*")


def test_stored_parents_that_are_gone_are_stored_again(spark, shop, tmp_path):
    path, scratch = str(tmp_path / "out"), str(tmp_path / "scratch")
    with pytest.raises(Exception, match="unreadable"):
        export_relational(broken(shop), path, "orders", "complete", scratch=scratch)
    for table in glob.glob(f"{scratch}/*/*"):
        commit.Files(spark).remove(table)
    done = export_relational(shop, path, "orders", "complete", scratch=scratch)
    assert ids(spark, done) == [1, 2, 3, 4, 5] and not glob.glob(f"{scratch}/*")

import hashlib
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import compaction
from folio.llm.queries import op13_compaction
from folio.storage import new_path


def brute(table):
    """The final files by the contract's words: plain loops over the whole table."""
    rows, out = len(table), []
    share = lambda x: 1 + rows // x
    days = table.arrived_at.astype("datetime64[us]").astype("int64") // 86_400_000_000
    h = np.array([zlib.crc32(str(i).encode()) for i in table.click_id])
    for day in sorted(set(days)):
        own = table[days == day]
        mine = h[days == day]
        lot, piece = (mine // 16) % (1 + len(own) // share(200)), np.minimum(mine % 4, (mine // 4) % 4)
        files = [(g, f.sort_values(["arrived_at", "click_id"])) for g, f in own.groupby([lot, piece])]
        small = sorted((f for f in files if len(f[1]) < share(750)), key=lambda f: (-len(f[1]), f[0]))
        groups = []
        for f in small:
            for g in groups:
                if sum(len(x[1]) for x in g) + len(f[1]) <= share(300):
                    g.append(f)
                    break
            else:
                groups.append([f])
        for g in groups + [[f] for f in files if len(f[1]) >= share(750)]:
            whole = pd.concat([f for _, f in g])
            cents = np.floor(100 * np.where(np.isfinite(whole.value.astype(float)), whole.value.astype(float), 0) + 0.5).sum()
            ids = ",".join(map(str, whole.click_id))
            out.append((day, *g[0][0], len(whole), whole.click_id.min(), whole.click_id.max(), int(cents), ",".join(f"{a}-{b}" for (a, b), _ in g), hashlib.sha256(ids.encode()).hexdigest(), ",".join(table.columns), len(g) > 1))
    return out


NAMES = ["day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "rewritten"]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, folder):
    got = op13_compaction(spark, f"/root/testdata/{folder}").collect()
    clicks = pq.read_table(f"/root/testdata/{folder}/clicks.parquet").to_pandas()
    assert sorted(tuple(r[n] for n in NAMES) for r in got) == sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in brute(clicks))
    top = os.path.dirname(got[0].path.removeprefix("file://"))
    assert sorted(os.listdir(top)) == sorted(os.path.basename(r.path) for r in got)
    back = spark.read.parquet(top)
    whole = spark.read.parquet(f"/root/testdata/{folder}/clicks.parquet")
    assert back.schema == whole.schema and back.exceptAll(whole).count() == 0 == whole.exceptAll(back).count()


def frame(spark, rows):
    made = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, day string")
    return made.withColumns({"lot": F.lit("clash"), "Path": F.lit(1), "a b`c.d": F.lit(2), "m": F.create_map(F.lit(1), F.lit(2)), "at": F.to_timestamp(F.lit("2024-01-01 00:00:00"))})


def rows_of(n):
    from datetime import datetime, timedelta

    start = datetime(1969, 12, 30)
    own = [(i % 97 if i % 5 else i, start + timedelta(hours=i * i % 90), (None, float("nan"), float("inf"), -1.005, i / 7)[i % 5], None if i % 2 else "x") for i in range(n)]
    return [*own, (None, start, 1.0, "x"), (None, start, 1.0, "x"), (7, None, 2.0, None), (8, None, 2.0, None)]


def test_odd_rows(spark, monkeypatch):
    df, found = frame(spark, rows_of(900)), []
    for limit in (compaction.BROADCAST_DAYS, 1):
        monkeypatch.setattr(compaction, "BROADCAST_DAYS", limit)
        folder = new_path(spark, "clicks")
        files, n = compaction.write_files(df.repartition(3), folder, "arrived_at", "click_id")
        assert n == 904 and files.agg(F.sum("n_rows")).first()[0] == n
        before = {r.path: open(r.path.removeprefix("file://"), "rb").read() for r in files.collect()}
        final = compaction.digests(compaction.compact(files, n, folder), "click_id", "value").collect()
        assert any(r.rewritten for r in final) and all(open(r.path.removeprefix("file://"), "rb").read() == before[r.path] for r in final if not r.rewritten)
        assert {r.columns for r in final} == {",".join(df.columns)}
        back = spark.read.parquet(folder)
        assert back.schema == df.schema or back.dtypes == df.dtypes
        key = lambda d: sorted(str(r.asDict()) for r in d.collect())
        assert key(back) == key(df)
        assert sum(r.n_rows for r in final if r.day is None) == 2
        assert min(r.day for r in final if r.day is not None) == -2
        found.append(sorted((r.day or 0, r.sources, r.ids_sha256, r.cents) for r in final))
    assert found[0] == found[1]


def test_empty(spark):
    folder = new_path(spark, "clicks")
    files, n = compaction.write_files(frame(spark, rows_of(1)).limit(0), folder, "arrived_at", "click_id")
    assert n == 0 and compaction.digests(compaction.compact(files, n, folder), "click_id", "value").count() == 0


@given(st.lists(st.integers(1, 100), max_size=300), st.integers(100, 250))
@settings(deadline=None)
def test_first_fit(sizes, capacity):
    groups = []
    for at, n in enumerate(sizes):
        fits = next((g for g in groups if sum(sizes[i] for i in g) + n <= capacity), None)
        groups.append([at]) if fits is None else fits.append(at)
    assert compaction.first_fit(sizes, capacity) == groups


@given(st.lists(st.one_of(st.tuples(st.just("open"), st.integers(0, 50)), st.tuples(st.just("join"), st.integers(1, 50))), max_size=200))
@settings(deadline=None)
def test_treap(steps):
    groups, rooms = compaction.OpenGroups(), []
    for what, n in steps:
        if what == "open":
            assert groups.open(n) == len(rooms)
            rooms.append(n)
        else:
            at = next((i for i, r in enumerate(rooms) if r >= n), None)
            assert groups.join(n) == at
            if at is not None:
                rooms[at] -= n
    depth = lambda x: 0 if x < 0 else 1 + max(depth(groups.left[x]), depth(groups.right[x]))
    assert groups.room == rooms and (not rooms or depth(groups.spine[0]) <= 8 + 3 * np.log2(len(rooms) + 1))


def test_steps_may_run_again(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    open(a, "w").close()
    compaction._moved(a, b)
    compaction._moved(a, b)
    compaction._deleted(b)
    compaction._deleted(b)
    with pytest.raises(FileNotFoundError):
        compaction._moved(a, b)


def test_joined_files_hold_instants_and_row_groups_in_order(spark, tmp_path):
    df = spark.range(5000).select("id", F.timestamp_micros(F.col("id") * 1_000_000).alias("t"))
    for kind in ("INT96", "TIMESTAMP_MICROS"):
        spark.conf.set("spark.sql.parquet.outputTimestampType", kind)
        try:
            df.coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / kind))
        finally:
            spark.conf.unset("spark.sql.parquet.outputTimestampType")
        own = [str(p) for p in (tmp_path / kind).glob("*.parquet")]
        target = str(tmp_path / f"{kind}-merged" / "x.parquet")
        compaction._merge([*own, *own], target, "1")
        assert pq.read_table(target)["id"].to_pylist() == [*range(5000)] * 2
        back = spark.read.parquet(target)
        assert back.dtypes == df.dtypes and back.distinct().exceptAll(df).count() == 0

"""Composite jobs: ingest twice -> one report; failure; archive; stream once."""

import os

import pytest
from pyspark.sql import functions as F

from dqlens.plans import jobs as J
from dqlens.session import scratch_path, session_conf
from dqlens.sources import csv as S
from dqlens.sources.tables import dirty
from dqlens.streaming.folder_ingest import ingest_folder_stream

from conftest import SF_SMALL


@pytest.fixture()
def store(spark):
    return scratch_path(spark, "store")


def test_ingest_is_idempotent(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    r1 = J.ingest_and_profile(spark, store, src, "d1", "u1", filename="dirty.csv",
                              custom_name="  Commandes\t")
    rep = r1.first()
    J.ingest_and_profile(spark, store, src, "d1", "u1", register=False)
    assert spark.read.parquet(f"{store}/reports").count() == 1
    assert spark.read.parquet(f"{store}/columns").count() == 6
    assert rep["row_count"] == 1500 and rep["column_count"] == 6
    assert rep["constant_columns"] == ["const_col", "empty_col"]
    lst = J.list_datasets(spark, store, "u1").collect()
    assert [(r["name"], r["custom_name"], r["filename"], r["status"], r["row_count"]) for r in lst] == \
        [("Commandes", "Commandes", "dirty.csv", "done", 1500)]
    st = J.get_status(spark, store, "d1", "u1").first()
    assert st["progress"] == 100 and st["status_label"] == "Terminé"
    det = J.get_dataset(spark, store, "d1", "u1").first()
    assert det["analysis"]["null_counts"]["price"] == 300


def test_failure_is_recorded(spark, store):
    with pytest.raises(Exception):
        J.ingest_and_profile(spark, store, f"{store}/does-not-exist.csv", "d9", "u9")
    st = J.get_status(spark, store, "d9", "u9").first()
    assert st["status"] == "failed" and st["progress"] == 100 and st["error_message"]


def test_row_gate_rejects_before_registering(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    with pytest.raises(ValueError):
        J.ingest_and_profile(spark, store, src, "d2", "u2", max_rows=100)
    assert not os.path.exists(f"{store}/catalog_events".replace("file:", ""))


def test_archive(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    J.ingest_and_profile(spark, store, src, "a1", "u3")
    J.ingest_and_profile(spark, store, src, "a2", "u3")
    out = J.archive_dataset(spark, store, "a1", "u3")
    assert out["archived"] and out["fs_error"] is None
    assert [r["dataset_id"] for r in J.list_datasets(spark, store, "u3").collect()] == ["a2"]
    assert [r["dataset_id"] for r in J.reports_table(spark, store).collect()] == ["a2"]
    for call in (J.get_dataset, J.get_status, J.archive_dataset):
        with pytest.raises(J.DatasetNotFound):
            call(spark, store, "a1", "u3")


def test_folder_stream_processes_each_folder_once(spark, store):
    root = scratch_path(spark, "incoming")
    S.write_csv(dirty(spark, SF_SMALL), f"{root}/first")
    ck = scratch_path(spark, "ck")
    assert ingest_folder_stream(spark, root, store, "s1", checkpoint=ck).count() == 1
    assert ingest_folder_stream(spark, root, store, "s1", checkpoint=ck).count() == 0
    S.write_csv(dirty(spark, SF_SMALL), f"{root}/second")
    assert ingest_folder_stream(spark, root, store, "s1", checkpoint=ck).count() == 1
    names = sorted(r["filename"] for r in J.list_datasets(spark, store, "s1").collect())
    assert names == ["first", "second"]


def test_ingest_empty_and_header_only_files(spark, store, tmp_text_dir):
    empty = os.path.join(tmp_text_dir, "empty.csv")
    open(empty, "w").close()
    rep = J.ingest_and_profile(spark, store, empty, "e0", "u5").first()
    assert rep["row_count"] == 0 and rep["column_count"] == 0 and rep["suggestions"] == []
    header = os.path.join(tmp_text_dir, "header.csv")
    with open(header, "w") as fh:
        fh.write("a,b\n")
    rep = J.ingest_and_profile(spark, store, header, "e1", "u5").first()
    assert rep["row_count"] == 0 and rep["column_count"] == 2
    assert rep["constant_columns"] == ["a", "b"]
    assert rep["suggestions"] == ["Supprimer 2 colonne(s) constante(s): a, b"]
    st = {r["dataset_id"]: (r["status"], r["row_count"]) for r in J.list_datasets(spark, store, "u5").collect()}
    assert st == {"e0": ("done", 0), "e1": ("done", 0)}


def test_ingest_many_matches_one_by_one(spark, tmp_text_dir):
    from dqlens.sources.tables import table
    root = scratch_path(spark, "many-src")
    S.write_csv(dirty(spark, SF_SMALL), f"{root}/dirty")
    S.write_csv(table(spark, SF_SMALL, "customer"), f"{root}/customer")
    empty = os.path.join(tmp_text_dir, "empty.csv")
    open(empty, "w").close()
    items = [{"path": f"{root}/dirty", "dataset_id": "m1", "custom_name": " Dirty "},
             {"path": f"{root}/customer", "dataset_id": "m2"},
             {"path": empty, "dataset_id": "m3"}]
    many_store, one_store = scratch_path(spark, "many"), scratch_path(spark, "one")
    keep = ["dataset_id", "row_count", "column_count", "schema", "null_counts", "bad_type_counts",
            "distinct_counts", "constant_columns", "suggestions"]
    got = {r["dataset_id"]: r for r in J.ingest_many(spark, many_store, items, "u7").select(*keep).collect()}
    for it in items:
        one = J.ingest_and_profile(spark, one_store, it["path"], it["dataset_id"], "u7",
                                   custom_name=it.get("custom_name")).first()
        assert {k: one[k] for k in keep if k != "dataset_id"} == \
            {k: got[it["dataset_id"]][k] for k in keep if k != "dataset_id"}
    lst = {r["dataset_id"]: (r["name"], r["status"], r["row_count"])
           for r in J.list_datasets(spark, many_store, "u7").collect()}
    assert lst == {"m1": ("Dirty", "done", 1500), "m2": ("customer", "done", 150),
                   "m3": ("empty.csv", "done", 0)}


def test_ingest_many_approximate(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    rep = J.ingest_many(spark, store, [{"path": src, "dataset_id": "x1"}], "u8", exact=False).first()
    assert rep["row_count"] == 1500 and rep["null_counts"]["price"] == 300
    assert abs(rep["distinct_counts"]["o_orderkey"] - 1500) <= 60


def test_ingest_many_approximate_only_empty_files(spark, store, tmp_text_dir):
    empty = os.path.join(tmp_text_dir, "e.csv")
    open(empty, "w").close()
    rep = J.ingest_many(spark, store, [{"path": empty, "dataset_id": "z"}], "u9", exact=False).first()
    assert rep["row_count"] == 0 and rep["column_count"] == 0


def test_ingest_many_isolates_a_failing_file(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    items = [{"path": src, "dataset_id": "g1"},
             {"path": f"{store}/no-such-file.csv", "dataset_id": "g2"}]
    got = [r["dataset_id"] for r in J.ingest_many(spark, store, items, "u10").collect()]
    assert got == ["g1"]
    st = {r["dataset_id"]: (r["status"], r["error_message"] is not None)
          for r in J.list_datasets(spark, store, "u10").join(
              J.current_catalog(spark, store, "u10").select("dataset_id", "error_message"), "dataset_id").collect()}
    assert st == {"g1": ("done", False), "g2": ("failed", True)}


def test_register_only(spark, store):
    J.register_dataset(spark, J.Layout(store), "r1", "u11", "f.csv", custom_name="  ")
    row = J.get_status(spark, store, "r1", "u11").first()
    assert (row["status"], row["progress"], row["status_label"]) == ("queued", 0, "En file d’attente")
    lst = J.list_datasets(spark, store, "u11").first()
    assert (lst["name"], lst["custom_name"], lst["row_count"]) == ("f.csv", None, None)


def test_batch_jobs_inherit_the_job_group(spark, store):
    root = scratch_path(spark, "grp")
    for name in ("a", "b"):
        S.write_csv(dirty(spark, SF_SMALL), f"{root}/{name}")
    sc = spark.sparkContext
    sc.setJobGroup("batch-group", "batch-group")
    try:
        J.ingest_many(spark, store, [{"path": f"{root}/{n}", "dataset_id": n} for n in ("a", "b")], "u12")
        jobs = set(sc.statusTracker().getJobIdsForGroup("batch-group"))
    finally:
        sc.setJobGroup(None, None)
    assert len(jobs) >= 10        # every job of the batch, threads included


def test_folder_stream_file_and_folder_datasets(spark, store):
    root = scratch_path(spark, "incoming-mixed")
    S.write_csv(dirty(spark, SF_SMALL), f"{root}/orders_folder")
    local = root[len("file:"):] if root.startswith("file:") else root
    with open(os.path.join(local, "one.csv"), "w") as fh:
        fh.write("a,b\n1,x\n2,y\n")
    with open(os.path.join(local, "two.CSV"), "w") as fh:
        fh.write("c\n1\n")
    got = ingest_folder_stream(spark, root, store, "s2")
    assert sorted(r["dataset"].rsplit("/", 1)[-1] for r in got.collect()) == ["one.csv", "orders_folder", "two.CSV"]
    rows = {r["filename"]: r["row_count"] for r in J.list_datasets(spark, store, "s2").collect()}
    assert rows == {"one.csv": 2, "orders_folder": 1500, "two.CSV": 1}


def test_stream_profiles_a_folder_once_whatever_the_trigger_bound(spark, store):
    root = scratch_path(spark, "incoming-parts")
    S.write_csv(dirty(spark, SF_SMALL).repartition(5), f"{root}/parts")
    got = ingest_folder_stream(spark, root, store, "s3", max_files_per_trigger=1)
    assert got.count() == 1
    events = J.ST.read_events(spark, f"{store}/catalog_events", "s3").collect()
    assert [e["status"] for e in events].count("queued") == 1
    assert J.list_datasets(spark, store, "s3").first()["row_count"] == 1500


ODD_IDS = ["x/../..", "a:b", "..", "p=1%2F", "é {[*]}"]


def test_odd_ids_stay_in_their_owners_folder(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    J.ingest_and_profile(spark, store, src, "keep:bob", "bob")      # an id has one owner
    for odd in ODD_IDS:
        with pytest.raises(J.DatasetNotFound):
            J.archive_dataset(spark, store, odd, "eve")
    items = [{"path": src, "dataset_id": d} for d in ["keep", *ODD_IDS]]
    got = {r["dataset_id"]: r["row_count"] for r in J.ingest_many(spark, store, items, "eve").collect()}
    assert got == dict.fromkeys(["keep", *ODD_IDS], 1500)
    assert J.get_dataset(spark, store, "a:b", "eve").first()["analysis"]["null_counts"]["price"] == 300
    for odd in ODD_IDS:
        with pytest.raises(J.DatasetNotFound):
            J.archive_dataset(spark, store, odd, "bob")
        assert J.archive_dataset(spark, store, odd, "eve")["fs_error"] is None
    left = {(r["user_id"], r["dataset_id"]) for r in J.reports_table(spark, store).collect()}
    assert left == {("eve", "keep"), ("bob", "keep:bob")}
    assert J.ST.read_landed(spark, f"{store}/landing", "bob", "keep:bob").count() > 1500


def test_empty_ids_are_refused(spark, store):
    with pytest.raises(ValueError):
        J.archive_dataset(spark, store, "", "eve")


def test_archived_then_ingested_again(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    J.ingest_and_profile(spark, store, src, "d", "u20", custom_name="old")
    J.archive_dataset(spark, store, "d", "u20")
    assert J.list_datasets(spark, store, "u20").count() == 0
    J.register_dataset(spark, J.Layout(store), "d", "u20", "new.csv")
    row = J.list_datasets(spark, store, "u20").first()
    assert (row["name"], row["custom_name"], row["row_count"], row["status"]) == ("new.csv", None, None, "queued")
    J.ingest_and_profile(spark, store, src, "d", "u20")
    assert J.list_datasets(spark, store, "u20").first()["row_count"] == 1500


def test_compaction_keeps_the_catalogue(spark, store):
    for i in range(3):
        J.register_dataset(spark, J.Layout(store), f"d{i}", "u21", f"f{i}.csv")
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    J.ingest_and_profile(spark, store, src, "d3", "u21")
    J.archive_dataset(spark, store, "d1", "u21")
    J.register_dataset(spark, J.Layout(store), "other", "u22", "o.csv")
    before = sorted(map(tuple, J.current_catalog(spark, store, "u21").collect()), key=str)
    assert J.compact_catalog(spark, store, "u21") > 1
    assert sorted(map(tuple, J.current_catalog(spark, store, "u21").collect()), key=str) == before
    listed = J.ST.read_events(spark, f"{store}/catalog_events", "u21")     # a reader from before the next compaction
    many = len(listed.inputFiles())
    assert J.compact_catalog(spark, store, "u21") == 0 and many > 2
    assert sorted(map(tuple, J.current_catalog(spark, store, "u21").collect()), key=str) == before
    assert len(J.ST.read_events(spark, f"{store}/catalog_events", "u21").inputFiles()) == 1
    J.archive_dataset(spark, store, "d0", "u21")
    assert {r["dataset_id"] for r in J.list_datasets(spark, store, "u21").collect()} == {"d2", "d3"}
    assert J.list_datasets(spark, store, "u22").count() == 1


def test_landing_is_lossless(spark, store, tmp_text_dir):
    text = 'a,user_id,dataset_id\r\n1,x,y,EXTRA\n\n"q ""z""", ,\n4'
    path = os.path.join(tmp_text_dir, "odd.csv")
    with open(path, "w", newline="") as fh:
        fh.write(text)
    rep = J.ingest_and_profile(spark, store, path, "d1", "u23", wanted={"user_id": "int"}).first()
    lines = J.ST.read_landed(spark, f"{store}/landing", "u23", "d1").orderBy("file", "block", "seq").collect()
    back = "\n".join(r["line"] for r in lines)
    assert back == text and lines[0]["file_size"] == len(text)
    assert [c["name"] for c in rep["schema"]] == ["a", "user_id", "dataset_id"]
    assert rep["bad_type_counts"] == {"user_id": 1}


def test_a_wanted_column_that_is_absent_is_an_error(spark, store):
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    with pytest.raises(ValueError, match="nope"):
        J.ingest_and_profile(spark, store, src, "d1", "u24", wanted={"nope": "int"})


def test_gate_of_single_and_batch(spark, store, tmp_text_dir):
    path = os.path.join(tmp_text_dir, "a.pdf")
    with open(path, "w") as fh:
        fh.write("a\n1\n2\n")
    with pytest.raises(J.UploadRejected):
        J.ingest_and_profile(spark, store, path, "d1", "u25")
    src = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "src"))
    items = [{"path": path, "dataset_id": "pdf"}, {"path": path, "dataset_id": "mime", "mime": "text/csv"},
             {"path": src, "dataset_id": "long"}]
    got = J.ingest_many(spark, store, items, "u25", max_rows=100).collect()
    assert [r["dataset_id"] for r in got] == ["mime"]
    assert [r["dataset_id"] for r in J.list_datasets(spark, store, "u25").collect()] == ["mime"]


def test_long_error_is_stored_whole(spark, store):
    path = f"{store}/{'x' * 60}/" + "/".join("y" * 200 for _ in range(12)) + ".csv"
    with pytest.raises(Exception):
        J.ingest_and_profile(spark, store, path, "d", "u26")
    assert len(J.get_status(spark, store, "d", "u26").first()["error_message"]) > 2400


def test_batch_of_many_datasets_of_one_schema_is_one_scan(spark, store, tmp_text_dir):
    items = []
    for i in range(40):
        path = os.path.join(tmp_text_dir, f"f{i}.csv")
        with open(path, "w") as fh:
            fh.write("a,b\n" + "".join(f"{k},v{k % (i + 1)}\n" for k in range(30)))
        items.append({"path": path, "dataset_id": f"n{i}", "schema": "a int, b string"})
    got = {r["dataset_id"]: r for r in J.ingest_many(spark, store, items, "u27").collect()}
    assert len(got) == 40
    assert all(got[f"n{i}"]["distinct_counts"] == {"a": 30, "b": min(30, i + 1)} for i in range(40))


def _csv(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as fh:
        fh.write(text)
    return path


def _statuses(spark, store, owner):
    return {r["dataset_id"]: (r["status"], r["row_count"]) for r in J.list_datasets(spark, store, owner).collect()}


def test_one_bad_upload_of_64_fails_alone(spark, store, tmp_text_dir):
    items = [{"path": _csv(tmp_text_dir, f"i{i}.csv", "a,b\n" + ("no number,x\n" if i == 41 else "1,x\n2,y\n")),
              "dataset_id": f"i{i}", "schema": "a int, b string"} for i in range(64)]
    sc = spark.sparkContext
    sc.setJobGroup("halving", "halving")
    try:
        got = J._profile_apart
        calls = []
        J._profile_apart = lambda *a: calls.append(len(a[3])) or got(*a)
        try:
            stored = J.ingest_many(spark, store, items, "u30", mode="FAILFAST")
        finally:
            J._profile_apart = got
    finally:
        sc.setJobGroup(None, None)
    assert stored.count() == 63 and len(calls) == 1 + 2 * 6        # halves down to the one
    want = {f"i{i}": ("done", 2) for i in range(64)} | {"i41": ("failed", None)}
    assert _statuses(spark, store, "u30") == want
    assert {r["distinct_counts"]["a"] for r in stored.collect()} == {2}


def test_ids_given_twice_are_refused_before_landing(spark, store, tmp_text_dir):
    path = _csv(tmp_text_dir, "t.csv", "a\n1\n")
    items = [{"path": path, "dataset_id": d} for d in ("x", "y", "x")]
    with pytest.raises(J.DatasetTaken, match="x: given twice"):
        J.ingest_many(spark, store, items, "u31")
    assert not J.ST.exists(spark, f"{store}/landing") and not J.ST.exists(spark, f"{store}/catalog_events")
    J.ingest_many(spark, store, items[:2], "u32")                  # nothing stayed claimed


def test_an_id_has_one_owner(spark, store, tmp_text_dir):
    path = _csv(tmp_text_dir, "t.csv", "a\n1\n")
    J.ingest_and_profile(spark, store, path, "mine", "u33")
    for call in (lambda: J.ingest_many(spark, store, [{"path": path, "dataset_id": d} for d in ("free", "mine")], "u34"),
                 lambda: J.register_dataset(spark, J.Layout(store), "mine", "u34", "f.csv")):
        with pytest.raises(J.DatasetTaken, match="mine: another owner"):
            call()
    assert _statuses(spark, store, "u34") == {}
    J.ingest_and_profile(spark, store, path, "mine", "u33", register=False)
    J.ingest_and_profile(spark, store, path, "free", "u35")        # given back when the batch was refused
    J.archive_dataset(spark, store, "mine", "u33")
    J.ingest_and_profile(spark, store, path, "mine", "u34")        # free again once archived
    assert _statuses(spark, store, "u34") == {"mine": ("done", 1)}


def test_concurrent_callers_have_one_winner(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    def call(owner):
        try:
            J.register_dataset(spark, J.Layout(store), "wanted", owner, "f.csv")
            return owner
        except J.DatasetTaken:
            return None
    with ThreadPoolExecutor(8) as pool:
        won = [o for o in pool.map(call, [f"c{i}" for i in range(8)]) if o]
    assert len(won) == 1 and J.ST.claim_owner(spark, J.Layout(store).claims, "wanted") == won[0]
    assert [r["user_id"] for r in J.current_catalog(spark, store).collect()] == won


def test_a_rejected_upload_leaves_nothing(spark, store, tmp_text_dir):
    long = _csv(tmp_text_dir, "long.csv", "a\n" + "1\n" * 30)
    short = _csv(tmp_text_dir, "short.csv", "a\n1\n")
    items = [{"path": long, "dataset_id": "long"}, {"path": short, "dataset_id": "short"},
             {"path": f"{store}/none.csv", "dataset_id": "none"}]
    J.ingest_many(spark, store, items, "u36", max_rows=29)
    assert {d: s for d, (s, _) in _statuses(spark, store, "u36").items()} == {"short": "done", "none": "failed"}
    local = store[len("file:"):] if store.startswith("file:") else store
    assert os.listdir(f"{local}/landing/user_id=u36") == ["dataset_id=short"]
    assert os.listdir(f"{local}/staging") == []
    J.register_dataset(spark, J.Layout(store), "long", "u37", "f.csv")     # its id is free
    J.ingest_many(spark, store, items[1:2] + [{"path": long, "dataset_id": "exact"}], "u36", max_rows=30)
    assert _statuses(spark, store, "u36")["exact"] == ("done", 30)


def test_landing_counts_headers_of_every_file(spark, store, tmp_text_dir):
    folder = os.path.join(tmp_text_dir, "parts")
    os.makedirs(folder)
    for i, text in enumerate(("a\n1\n2\n", "a\n3", "", "a\n")):
        _csv(folder, f"p{i}.csv", text)
    counts = J.ST.stage_raw(spark, folder, f"{store}/x")
    assert counts == {"n_lines": 6, "n_files": 3, "n_rows": 3}
    gate = S.row_limit_gate(spark, folder, 3).first()
    assert (gate["n_lines"], gate["n_files"], gate["n_rows"], gate["accepted"]) == (6, 3, 3, True)


def test_shared_paths_count_once_each(spark, store, tmp_text_dir):
    folder = os.path.join(tmp_text_dir, "shared")
    os.makedirs(folder)
    one = _csv(folder, "one.csv", "a\n1\n2\n")
    _csv(folder, "two.csv", "a\n3\n")
    items = [{"path": p, "dataset_id": d} for p, d in ((folder, "f1"), (folder + "/", "f2"), (one, "o1"), (one, "o2"))]
    J.ingest_many(spark, store, items, "u38")
    assert _statuses(spark, store, "u38") == {"f1": ("done", 3), "f2": ("done", 3), "o1": ("done", 2), "o2": ("done", 2)}


def test_readers_own_parsing_is_kept(spark, store, tmp_text_dir):
    path = _csv(tmp_text_dir, "d.csv", "d,n\n02/01/2024,NA\n03/01/2024,1.5\nx,2\n")
    rep = J.ingest_and_profile(spark, store, path, "d", "u39", schema="d date, n double",
                               dateFormat="dd/MM/yyyy", nanValue="NA").first()
    assert rep["null_counts"] == {"d": 1, "n": 0} and rep["distinct_counts"] == {"d": 3, "n": 3}


def _registered(spark, store, owner, n):
    now = J._now()
    J.ST.append_events(spark, f"{store}/catalog_events",
                       [J.registration_event(f"d{i}", owner, f"f{i}.csv", None, now) for i in range(n)])


def test_many_are_archived_in_a_constant_number_of_jobs(spark, store):
    sc = spark.sparkContext
    _registered(spark, store, "u40", 600)

    def jobs(ids, group):
        sc.setJobGroup(group, group)
        try:
            out = J.archive_many(spark, store, spark.createDataFrame([(i,) for i in ids], "dataset_id string"), "u40")
        finally:
            sc.setJobGroup(None, None)
        return len(sc.statusTracker().getJobIdsForGroup(group)), {r["dataset_id"]: r["archived"] for r in out.collect()}
    few, got = jobs(["d0", "d1", "nobody", "d0"], "archive-few")
    assert got == {"d0": True, "d1": True, "nobody": False}
    many, got = jobs([f"d{i}" for i in range(500)], "archive-many")
    assert sum(got.values()) == 498 and many <= few + 2
    assert J.list_datasets(spark, store, "u40").count() == 100


def test_a_sweep_takes_up_what_a_crash_left(spark, store, tmp_text_dir, monkeypatch):
    path = _csv(tmp_text_dir, "t.csv", "a\n1\n")
    J.ingest_many(spark, store, [{"path": path, "dataset_id": d} for d in ("x/1", "y", "z")], "u41")
    ids = spark.createDataFrame([("x/1",), ("y",)], "dataset_id string")

    def crash(*a):
        raise OSError("driver lost")
    with monkeypatch.context() as broken:
        broken.setattr(J.ST, "delete_dataset_dir", crash)
        with pytest.raises(OSError):
            J.archive_many(spark, store, ids, "u41")
    assert [r["dataset_id"] for r in J.list_datasets(spark, store, "u41").collect()] == ["z"]
    assert J.ST.claim_owner(spark, J.Layout(store).claims, "y") == "u41"
    assert J.sweep_removed(spark, store, "u41") == 2 and J.sweep_removed(spark, store, "u41") == 0
    assert {r["dataset_id"] for r in J.reports_table(spark, store).collect()} == {"z"}
    J.ingest_and_profile(spark, store, path, "y", "u42")           # free for another owner
    J.ingest_and_profile(spark, store, path, "x/1", "u41")         # and to be made again
    J.archive_many(spark, store, ids, "u41")
    assert {(r["user_id"], r["dataset_id"]) for r in J.reports_table(spark, store).collect()} == {("u41", "z"), ("u42", "y")}


def test_400_files_are_inferred_in_one_job(spark, tmp_text_dir):
    paths = [_csv(tmp_text_dir, f"n{i}.csv", f"k{i % 3},v\n1,{'x' if i % 2 else 2.5}\n") for i in range(400)]
    items = [{"path": p, "dataset_id": f"n{i}"} for i, p in enumerate(paths)]
    sc = spark.sparkContext
    sc.setJobGroup("infer", "infer")
    try:
        got = J._infer_together(spark, items)
    finally:
        sc.setJobGroup(None, None)
    assert len(got) == 400 and len(sc.statusTracker().getJobIdsForGroup("infer")) <= 3      # listing, map stage, result
    assert got["n1"].simpleString() == "struct<k1:int,v:string>" and got["n2"].simpleString() == "struct<k2:int,v:double>"


def _columns(spark, store, owner):
    cols = spark.read.schema(J.COLUMNS_SCHEMA).parquet(f"{store}/columns").where(f"user_id = '{owner}'")
    return sorted(tuple(r) for r in cols.drop("user_id", "dataset_id").collect())


FIRST = "k,v,t,d,flag\n1,1.50,plain,2024-01-02,true\n01,,nan,2024-01-03,TRUE\n"
LATER = ["k,v,t,d,flag\n2,1.5, ,2024-01-02 00:00:00,x\n+1,2," + "y" * 80 + ",,false\n",
         "k,v,t,d,flag\nx,3," + "y" * 80 + ",2024-01-02,true\n", "k,v,t,d,flag\n", "k,v,t,d,flag\n99999999999999999999,1,z,x,true\n"]


def test_a_growing_folder_reads_its_new_files_only(spark, store, monkeypatch):
    root, ck = scratch_path(spark, "growing"), scratch_path(spark, "growing-ck")
    local = root[len("file:"):] if root.startswith("file:") else root
    os.makedirs(f"{local}/set")
    read = []
    got = J._add_states
    monkeypatch.setattr(J, "_add_states", lambda s, la, u, items, names: read.append([f for it in items for fs in it["files"].values() for f in fs])
                        or got(s, la, u, items, names))
    for i, text in enumerate([FIRST, *LATER]):
        _csv(f"{local}/set", f"p{i}.csv", text)
        assert ingest_folder_stream(spark, root, store, "s4", checkpoint=ck).count() == 1
        assert [os.path.basename(f) for f in read[-1]] == [f"p{i}.csv"]
        whole = scratch_path(spark, "whole")
        J.ingest_and_profile(spark, whole, f"{root}/set", "w", "s4", mime="text/csv", filename="set")
        assert _columns(spark, store, "s4") == _columns(spark, whole, "s4")
    landed = spark.read.option("recursiveFileLookup", True).parquet(f"{store}/landing")
    assert landed.count() == 1 + 4 + sum(t.count("\n") for t in LATER) - 2        # the last one was read whole
    assert J.list_datasets(spark, store, "s4").first()["row_count"] == 6


def test_an_increment_that_is_repeated_counts_once(spark, store, tmp_text_dir):
    folder = os.path.join(tmp_text_dir, "rep")
    os.makedirs(folder)
    one, two = (_csv(folder, f"{n}.csv", f"a,b\n{n},x\n") for n in (1, 2))
    item = {"path": folder, "dataset_id": "r", "filename": "rep", "mime": "text/csv"}
    for files in ({"0": [one]}, {"0": [one]}, {"0": [one], "1": [two]}, {"1": [two]}):
        rep = J.ingest_increments(spark, store, [item | {"files": files}], "u50").first()
    assert rep["row_count"] == 2 and rep["distinct_counts"] == {"a": 2, "b": 1}
    assert J.ST.read_landed(spark, f"{store}/landing", "u50", "r").count() == 4
    three = _csv(folder, "3.csv", "a,c\n3,x\n")                    # another header: read whole
    rep = J.ingest_increments(spark, store, [item | {"files": {"2": [three]}}], "u50").first()
    assert rep["row_count"] == 3
    four = _csv(folder, "4.csv", "a,b\n4,x\n")
    bad = {"path": f"{store}/none", "dataset_id": "bad", "files": {"0": [f"{store}/none/x.csv"]}, "mime": "text/csv"}
    got = J.ingest_increments(spark, store, [item | {"files": {"3": [four]}}, bad], "u50").collect()
    assert [(r["dataset_id"], r["row_count"]) for r in got] == [("r", 4)]
    assert {d: s for d, (s, _) in _statuses(spark, store, "u50").items()} == {"r": "done", "bad": "failed"}


def test_rows_of_a_batch_are_not_shuffled_by_upload(spark, tmp_text_dir):
    """A large upload is not one task's rows, and a path that two uploads share is counted once."""
    for name, lines in (("a", "1,x\n2,\n2,y\n"), ("b", "7,z\n"), ("empty", "")):
        with open(os.path.join(tmp_text_dir, f"{name}.csv"), "w") as fh:
            fh.write("n,t\n" + lines)
    roots = {d: os.path.join(tmp_text_dir, f"{n}.csv") for d, n in (("x", "a"), ("y", "a"), ("z", "b"), ("e", "empty"))}
    schema = J.T.StructType([J.T.StructField("n", J.T.IntegerType()), J.T.StructField("t", J.T.StringType())])
    for exact, options in ((True, {}), (False, {}), (True, {"mode": "PERMISSIVE"})):
        stats = J._group_stats(spark, roots, False, schema, [J.T.IntegerType(), J.T.StringType()], exact, options)
        plan = J.P.physical_plan(stats)
        assert "_root" in plan and "hashpartitioning(_root" not in plan
        got = {(r["_id"], r["position"]): (r["n_rows"], r["n_miss"], r["n_distinct"], r["n_bad"] or 0) for r in stats.collect()}
        assert got == {("z", 0): (1, 0, 1, 0), ("z", 1): (1, 0, 1, 0)} | {
            (d, i): (3, i, 2 + i, 0) for d in "xy" for i in (0, 1)}


def test_new_files_are_counted_where_they_are_read(spark, store, tmp_text_dir, monkeypatch):
    """The rows of one large file are not one task's."""
    for name in ("a", "b"):
        with open(os.path.join(tmp_text_dir, f"{name}.csv"), "w") as fh:
            fh.write("n,t\n1,x\n2,\n")
    plans, count = [], J.VS.value_state
    monkeypatch.setattr(J.VS, "value_state", lambda raw, keys: plans.append(J.P.physical_plan(raw)) or count(raw, keys))
    with session_conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):     # as for files beyond it
        ingest_folder_stream(spark, tmp_text_dir, store, "s9")
    assert len(plans) == 1 and "_file" in plans[0] and "hashpartitioning(_file" not in plans[0]
    assert {(r["filename"], r["row_count"]) for r in J.list_datasets(spark, store, "s9").collect()} == {("a.csv", 2), ("b.csv", 2)}


def test_values_are_read_once_per_distinct_value(spark):
    """What a value can be read as is found after counting, whatever the number of columns."""
    narrow, wide = (J.P.physical_plan(J.VS.value_state(spark.range(1).select(
        *[F.col("id").cast("string").alias(f"c{i}") for i in range(n)], F.lit("d").alias("dataset_id")), ["dataset_id"])) for n in (2, 12))
    assert narrow.count("RLIKE") == wide.count("RLIKE") > 0
    state = spark.createDataFrame([], "dataset_id string, " + J.VS.VALUE_FIELDS)
    names = spark.createDataFrame([], "dataset_id string, position int, column_name string")
    plan = J.P.physical_plan(J.VS.profile_of_state(state, names, ["dataset_id"]))
    assert plan.count("SortMergeJoin") <= 1         # the columns' names, not their values


def test_value_states_of_odd_values(spark):
    odd = [None, "", "  ", " " * 60, "NaN", "nan", "1", "01", "1.5", "1" * 60, "0." + "0" * 60, "2020-01-01", "true", "x", "y" * 60,
           "é" * 30, "\0", "\0" + "7", "7", "9" * 30, "2020-01-01T00:00:00." + "1" * 40]
    rows = spark.createDataFrame([(v, "d") for k, v in enumerate(odd) for _ in range(1 + k % 3)], "v string, d string").repartition(3)
    kind = S.value_kind(F.col("v"))
    missing = F.expr(J.P.missing_sql("v", J.T.StringType()))
    whole = rows.groupBy("d", F.when(kind == S.STRING, F.expr(J.P.text_key("v"))).otherwise(F.col("v")).alias("value"),
                         kind.alias("kind"), missing.alias("missing")).agg(F.count("*").alias("cnt"))
    want = whole.selectExpr("d", "0 AS position", "value", "kind", "missing", "cnt")
    got = J.VS.value_state(rows, ["d"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

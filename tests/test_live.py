"""The live catalog, other sources, trimming, and the content index, beyond what their queries check."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from rankfield.operators import catalogs, content, latency, merge, rank, security, tree
from rankfield.plans import snapshot
from rankfield.session import materialized, shared_folder
from rankfield.sources import journal, providers
from rankfield.streaming import live, usage

SCHEMA = "frn long, parent_frn long, name string, flags int"
ROWS = [(100, 5, "docs", 1), (101, 100, "a", 1), (102, 101, "b.txt", 0), (103, 5, "pics", 1), (104, 103, "c.png", 2)]


def entries(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def state_of(spark, rows=ROWS, cursor=(7, 0)):
    state = live.Live(spark, enumerate=lambda: (entries(spark, rows), journal.Cursor(*cursor)))
    state.rebuild("first")
    return state


def seen(state):
    return {r["frn"]: (r["depth"], r["path"]) for r in state.entries.collect()}


def written_journal(path, *events):
    path.mkdir(exist_ok=True)
    (path / "j").write_bytes(b"".join(journal.record(*e) for e in events))
    return str(path)


def test_tail_applies_and_moves_on(spark, tmp_path):
    at = written_journal(tmp_path / "a", (1, 105, 101, 0x100, 0, "new.txt"), (2, 102, 101, 0x200, 0, "b.txt"), (3, 104, 103, 0x2000, 2, "d.png"), (9, 106, 5, 0x100, 0, "later"))
    state = state_of(spark)
    assert state.step(journal.Journal(at, 7, 0, 4)) and state.cursor == journal.Cursor(7, 4) and state.epoch == 1
    got = seen(state)
    assert got[105] == (2, "docs\\a\\new.txt") and 102 not in got and got[104] == (1, "pics\\d.png") and 106 not in got
    assert state.step(journal.Journal(at, 7, 0, 10)) and seen(state)[106] == (0, "later") and 105 in seen(state)
    hit = snapshot.search(state.entries, "NEW").collect()
    assert [r["frn"] for r in hit] == [105]


@pytest.mark.parametrize("what", [{"journal_id": 8}, {"first_usn": 5}, {"active": False}, {"deleting": True}])
def test_tail_rebuilds(spark, tmp_path, what):
    at = written_journal(tmp_path / "a", (1, 105, 101, 0x100, 0, "new.txt"))
    state = state_of(spark)
    state.enumerate = lambda: (entries(spark, [(200, 5, "fresh", 0)]), journal.Cursor(8, 50))
    args = {"path": at, "journal_id": 7, "first_usn": 0, "next_usn": 60} | what
    assert state.step(journal.Journal(**args)) and state.epoch == 2 and state.cursor == journal.Cursor(8, 50)
    assert set(seen(state)) == {200} and state.reason and not state.rebuilding


def test_what_lies_under_moved_folders_is_found_by_equality(spark):
    """As by comparing all paths with all tops, odd names among them, and without the product of the two."""
    r = random.Random(21)
    paths = [None, "", "\\", "a\\", "\\a", "a\\\\b"] + ["\\".join(r.choice(["a", "ab", "b", "", "\u00e9", "\U0001d11e"]) for _ in range(r.randint(1, 6))) for _ in range(400)]
    tops = sorted({r.choice(paths) or "" for _ in range(25)})
    rows = spark.createDataFrame(list(enumerate(paths)), "frn long, path string")
    found = tree.at_or_under(rows, spark.createDataFrame([(x,) for x in tops], "t string"), "t")
    assert sorted(x["frn"] for x in found.collect()) == [k for k, p in enumerate(paths) if p is not None and any(p == t or p.startswith(t + "\\") for t in tops)]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_pause(spark, tmp_path):
    at = written_journal(tmp_path / "a", (1, 105, 101, 0x100, 0, "new.txt"))
    state = state_of(spark)
    state.paused = True
    assert not state.step(journal.Journal(at, 7, 0, 4)) and state.cursor.next_usn == 0 and 105 not in seen(state)
    state.paused = False
    assert state.step(journal.Journal(at, 7, 0, 4)) and 105 in seen(state)


def test_repair_waits_and_then_places_what_hangs_below(spark, tmp_path):
    at = written_journal(tmp_path / "a", (1, 101, 103, 0x2000, 0x10, "moved"))
    state = state_of(spark)
    state.step(journal.Journal(at, 7, 0, 4), now=100.0)
    assert seen(state)[102] == (2, "docs\\a\\b.txt")  # stale, but there
    assert not state.repair_due(100.2) and state.repair_due(100.6)
    state.repair()
    assert seen(state)[102] == (2, "pics\\moved\\b.txt") and not state.repair_due(200)


def test_many_moves_at_once_equal_resolving_anew(spark, tmp_path):
    rng = random.Random(5)
    rows = [(100 + k, rng.choice([5, *range(100, 100 + k)]) if k else 5, f"n{k}", 1) for k in range(40)]
    state = state_of(spark, rows)
    parent = {r[0]: r[1] for r in rows}
    usn = 0
    for part in range(3):
        events = []
        for _ in range(5):
            frn = rng.choice(sorted(parent))
            under, grown = {frn}, True
            while grown:
                grown = {f for f, p in parent.items() if p in under} - under
                under |= grown
            usn += 1
            if rng.random() < 0.25:
                parent.pop(frn)
                events.append((usn, frn, 0, 0x200, 0x10, "gone"))
            else:
                parent[frn] = rng.choice([5, *sorted(set(parent) - under)])
                events.append((usn, frn, parent[frn], 0x2000, 0x10, f"m{usn}"))
        usn += 1
        parent[500 + part] = rng.choice(sorted(parent))
        events.append((usn, 500 + part, parent[500 + part], 0x100, 0, f"new{part}"))
        at = written_journal(tmp_path / f"b{part}", *events)
        assert state.step(journal.Journal(at, 7, 0, usn + 1))
        if part != 1:
            state.repair()
    want = {r["frn"]: (r["depth"], r["path"]) for r in tree.resolve(state.entries).collect()}
    assert seen(state) == want and {r["frn"]: r["parent_frn"] for r in state.entries.collect()} == parent


def test_save_and_load(spark, tmp_path):
    state = state_of(spark, cursor=(7, 3))
    state.save(str(tmp_path / "s"))
    again = live.Live(spark, enumerate=lambda: (entries(spark, [(200, 5, "fresh", 0)]), journal.Cursor(8, 50)))
    assert again.load(str(tmp_path / "s")) and seen(again) == seen(state) and again.cursor == journal.Cursor(7, 3) and again.epoch == 1
    kept = json.loads(spark.read.text(str(tmp_path / "s" / "state")).first()[0])
    for broken in ({"version": 99}, {"checksum": "0:0"}):
        spark.createDataFrame([(json.dumps(kept | broken),)], "s string").write.mode("overwrite").text(str(tmp_path / "s" / "state"))
        assert not again.load(str(tmp_path / "s")) and set(seen(again)) == {200}
    assert not again.load(str(tmp_path / "none")) and set(seen(again)) == {200}


def test_repair_of_a_snapshot_equals_resolving_anew(spark):
    built = snapshot.build(entries(spark))
    changed = built.withColumn("parent_frn", F.when(F.col("frn") == 101, 103).otherwise(F.col("parent_frn")))
    got = {r["frn"]: (r["depth"], r["path"]) for r in tree.repair(changed, spark.createDataFrame([(101, "docs\\a")], "frn long, was string")).collect()}
    want = {r["frn"]: (r["depth"], r["path"]) for r in tree.resolve(changed).collect()}
    assert got == want and got[102] == (2, "pics\\a\\b.txt")


def test_providers_tell_nothing_from_nobody(spark):
    class Slow:
        def search(self, q, most):
            slow = F.udf(lambda x: time.sleep(30) or x, "long")
            return spark.range(1).select(slow("id").alias("name"))

    class Broken:
        def search(self, q, most):
            raise providers.Failed("no")

    files = entries(spark)
    got = providers.ask_all(spark, {"files": providers.LikeProvider(files), "nobody": providers.LikeProvider(None), "broken": Broken(), "slow": Slow()}, "zz", dict.fromkeys(("files", "nobody", "broken", "slow"), 3), 12)
    assert {k: (v.status, len(v.rows)) for k, v in got.items()} == {"files": ("ok", 0), "nobody": ("unavailable", 0), "broken": ("failed", 0), "slow": ("late", 0)}
    assert [r["name"] for r in providers.answer(providers.LikeProvider(files), "C", 1).rows] == ["docs"]


def test_cancelled_work_returns_nothing(spark):
    work = providers.Work(spark)
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    threading.Timer(2, work.stop).start()
    began = time.time()
    with pytest.raises(providers.Cancelled):
        work.run(lambda: spark.range(4).select(slow("id")).collect())
    assert time.time() - began < 18
    with pytest.raises(providers.Cancelled):
        work.run(lambda: 1)


def test_grants_go_with_changed_folders(spark):
    built = snapshot.build(entries(spark))
    grants = spark.createDataFrame([(100, "u"), (101, "u"), (103, "u"), (101, "v")], "dir long, sid string")
    left = security.still_granted(grants, built, spark.createDataFrame([(100,)], "frn long"))
    assert sorted(map(tuple, left.collect())) == [(103, "u")]
    assert [r["frn"] for r in security.trimmed(built, grants, "v").collect()] == [102]


def test_settings_fall_back_to_the_built_in_copy(spark, tmp_path):
    own = spark.createDataFrame([("x", "Own", "uri:x", ["s"], None, None), ("y", "Gated", "uri:y", [], 99, None)], "id string, name string, target string, synonyms array<string>, min_build int, requires string")
    (tmp_path / "bad.json").write_text("{ not json")
    for path in (tmp_path / "none.json", tmp_path / "bad.json"):
        assert [r["id"] for r in catalogs.read_settings(spark, str(path), own, 10, []).collect()] == ["x"]


def test_settings_are_written_by_tasks_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogs, "SETTINGS_BITS", 3)
    rows = spark.range(100).selectExpr("cast(id as string) id", "concat('n\u00e9\"', id) name", "concat('u', id) uri", "concat('c', id) canonical", "array('s', cast(id as string)) synonyms", "named_struct('min_build', int(id % 30), 'requires', if(id % 3 = 0, 'pen', null)) gate").repartition(3)
    none = rows.where("false").selectExpr("id", "name", "uri target", "synonyms", "gate.min_build", "gate.requires")
    monkeypatch.setattr(type(rows), "collect", None)  # the driver is sent nothing
    catalogs.write_settings(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), str(tmp_path / "many"))
    monkeypatch.undo()
    files = [json.loads(x.read_text()) for x in (tmp_path / "many").glob("part-*.txt")]
    assert len(files) > 100 // 8 and all(len(x["settings"]) + len(x["control_panel"]) <= 8 for x in files)
    got = {r["id"]: r for r in catalogs.read_settings(spark, str(tmp_path / "many"), none, 20, ["pen"]).collect()}
    assert set(got) == {str(k) for k in range(100) if k % 30 <= 20} and got["7"]["target"] == "c7" and got["6"]["target"] == "u6"
    assert got["6"]["name"] == 'n\u00e9"6' and got["6"]["synonyms"] == ["s", "6"] and got["6"]["requires"] == "pen"
    (tmp_path / "broken").mkdir()
    for k, x in enumerate((*files, "{ not json")):
        (tmp_path / "broken" / f"{k}.json").write_text(x if isinstance(x, str) else json.dumps(x))
    assert catalogs.read_settings(spark, str(tmp_path / "broken"), none, 20, ["pen"]).count() == 0  # a part of a catalog is none
    catalogs.write_settings(rows.where("false"), rows.where("false"), str(tmp_path / "none"))
    assert catalogs.read_settings(spark, str(tmp_path / "none"), rows.where("id = 1").selectExpr("id", "name", "uri target", "synonyms", "gate.min_build", "gate.requires"), 20, []).count() == 0


def test_content_index_reads_only_its_terms(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, None), (3, "b"), (4, "")], "doc_id long, text string")
    at = f"{shared_folder(spark)}/index-test-{time.time_ns()}"
    content.build_index(docs, at)
    for terms in (["b"], ["a", "zz"], ["none"], []):
        want = {r["doc_id"]: r["score"] for r in content.bm25(docs, terms).collect()}
        got = {r["doc_id"]: r["score"] for r in content.search_index(spark, at, terms).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    plan = content.search_index(spark, at, ["b"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    assert content.parse_content("x content:deep Content:er content: y") == ("x y", ["deep", "er"])


def test_caps_keep_frozen_rows_beyond_them(spark):
    rows = spark.createDataFrame([("app", str(k), f"n{k}", 1.0 - k / 10, None) for k in range(8)] + [(None, "z", "n", 0.0, None), ("odd", "y", "n", 0.0, None)], "kind string, key string, name string, score double, ord int")
    frozen = spark.createDataFrame([(str(k), k) for k in (7, 6, 5, 4)], "key string, frozen_pos int")
    assert [r["key"] for r in merge.merge(rows, frozen).orderBy("pos").collect()] == ["4", "5", "6", "7", "y", "z"]


def test_blocks_of_queries_equal_one(spark, monkeypatch):
    rows = snapshot.build(entries(spark))
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(("DOCS", "c", "txt", "", "zz"))], "qid int, q string")
    one = sorted(map(tuple, rank.batch_search(rows, queries, 3).select("qid", "frn", "place").collect()))
    monkeypatch.setattr(rank, "QUERIES_AT_ONCE", 2)
    assert sorted(map(tuple, rank.batch_search(rows, queries, 3).select("qid", "frn", "place").collect())) == one and one


def test_running_windows_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, k, rng.random()) for c in "ab" for k in sorted(rng.sample(range(9000), 700))]
    samples = spark.createDataFrame(rows, "class string, id long, value double")
    want = {}
    for c in "ab":
        own = [v for x, _, v in rows if x == c]
        keys = [k for x, k, _ in rows if x == c]
        want |= {(c, k): (max(own[max(0, i - 99) : i + 1]), len(own[max(0, i - 99) : i + 1])) for i, k in enumerate(keys)}
    for size in (100_000, 500, 40):
        monkeypatch.setattr(latency, "BLOCK_SAMPLES", size)
        got = {(r["class"], r["id"]): (r["ring_most"], r["ring_n"]) for r in latency.running(samples, "class", "id", "value").collect()}
        assert got == want


def test_newest_states(spark):
    states = spark.createDataFrame([("a", 1, 0), ("a", 5, 2), ("a", 3, 1), ("b", 2, 0)], "id string, n int, batch int")
    assert sorted(map(tuple, usage.newest_states(states, "id").collect())) == [("a", 5), ("b", 2)]


def test_machine_local_folders_are_refused(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared_folder(Session())
    assert materialized(entries(spark), "here").count() == len(ROWS)

import json

import pytest

from quarrydex import cli
from quarrydex.functions.vectors import hashing_embedder
from quarrydex.plans.embedding import embed_cached, embed_long
from quarrydex.plans.index import TextIndex
from quarrydex.plans.repository import Repository
from quarrydex.schema import Settings
from quarrydex.sources.store import Store, StoreConflict


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(Store(spark, str(tmp_path / "store")))


def test_rows(repo):
    made = repo.repos.create([{"id": "a", "name": "one", "root_path": "/x"}, {"id": "b", "name": "two"}])
    assert made.count() == 2 and repo.repos.first(name="one")["root_path"] == "/x" and repo.repos.first(name="none") is None
    repo.repos.update([{"id": "a", "name": "uno"}])
    assert repo.repos.first(id="a")["name"] == "uno" and repo.repos.first(id="a")["root_path"] == "/x"
    assert repo.repos.get([]).count() == 0 and repo.repos.get(["a", "z"]).count() == 1
    with pytest.raises(ValueError):
        repo.repos.create([{"colour": "red"}])
    with pytest.raises(AttributeError):
        repo.colours
    repo.link("p", ["a", "b"])
    repo.link("p", ["b"])
    assert repo.project_repos.all().count() == 2 and repo.repos_of("p").count() == 2 and repo.repos_of("q").count() == 0
    repo.packages.create([{"id": "p1", "repo_id": "a"}, {"id": "p2", "repo_id": "a"}, {"id": "p3", "repo_id": "b"}])
    repo.files.create([{"id": "f1", "repo_id": "a", "package_id": "p1", "path": "x.py"}, {"id": "f2", "repo_id": "b", "package_id": "p3", "path": "y.py"}])
    assert repo.drop_orphans() == 1 and {r["id"] for r in repo.packages.all().collect()} == {"p1", "p3"}
    repo.nodes.create([{"id": f"n{i}", "repo_id": "ab"[i % 2], "file_id": "f1", "name": n, "parent_node_id": None if i < 2 else "n0"} for i, n in enumerate(["Beta", "Alpha", "Gamma"])])
    assert repo.nodes.find(top_level=True, repo_id=["a"]).count() == 1 and repo.nodes.find(has_embedding=True).count() == 0
    assert [r["id"] for r in repo.nodes.find(limit=2, offset=1).collect()] == ["n1", "n2"] and repo.nodes.first(id="n0")["search_boost"] is None
    repo.drop_repos(["a"])
    assert [t.all().count() for t in (repo.repos, repo.packages, repo.files, repo.nodes, repo.project_repos)] == [1, 1, 1, 1, 1]
    repo.files.delete(["f2"])
    assert repo.files.all().count() == 0


def test_migrations(repo):
    ran = []
    steps = [("001", lambda s: ran.append(1)), ("002", lambda s: ran.append(2))]
    assert repo.migrate(steps[:1]) == ["001"] and repo.migrate(steps) == ["002"] and repo.migrate(steps) == [] and ran == [1, 2]


def test_index_is_a_snapshot(repo, spark):
    repo.nodes.create([{"id": "n1", "body": "alpha beta alpha"}, {"id": "n2", "body": "gamma"}])
    index = TextIndex(repo.store)
    asked = spark.createDataFrame([(0, "alpha"), (1, "delta")], "query_id int, needle string")
    assert not index.valid() and [r["id"] for r in index.scores(asked).collect()] == ["n1"] and index.valid()
    repo.nodes.create([{"id": "n3", "body": "delta alpha"}])
    assert index.scores(asked).filter("id = 'n3'").count() == 0 and [r["id"] for r in index.validate().collect()] == ["n3"]
    repo.refresh_indexes()
    assert index.scores(asked).filter("id = 'n3'").count() == 2 and index.validate().count() == 0


def test_needles_follow_the_fields(repo):
    repo.files.create([{"id": "f", "repo_id": "a", "path": "src/fooBar.py"}])
    made = repo.nodes.create([{"id": "n", "repo_id": "a", "file_id": "f", "name": "oneTwo", "body": "three"}, {"id": "m", "repo_id": "b"}])
    needle = {r["id"]: r["fts_needle"] for r in made.collect()}
    assert needle["n"].split().count("oneTwo") == 3 and needle["n"].split().count("fooBar") == 2 and needle["n"].endswith("three") and needle["m"] == ""
    repo.nodes.update([{"id": "n", "body": "four", "header": "def oneTwo"}])
    assert repo.nodes.first(id="n")["fts_needle"].endswith("four") and "def" in repo.nodes.first(id="n")["fts_needle"]
    assert repo.nodes.create([]).count() == 0 and repo.nodes.update([{"id": "none", "name": "x"}]).count() == 0


def test_store_snapshots(spark, tmp_path):
    """Untouched repositories aren't copied, readers keep their snapshot, two writers don't overwrite each other."""
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"n{i}", f"r{i % 5}") for i in range(50)], "id string, repo_id string")
    store.write("nodes", rows)
    before = store.read("nodes")
    version, buckets = store._manifest("nodes")
    store.write("nodes", rows.filter("repo_id = 'r1' AND id <> 'n1'"), ["r1"])
    after = store._manifest("nodes")[1]
    changed = [b for b in after if after[b] != buckets.get(b)]
    assert len(changed) == 1 and store.read("nodes").count() == 49 and store.read("nodes", "r1").count() == 9 and store.read("nodes", "zz").count() == 0
    assert before.count() == 50  # the old snapshot is still there for its readers
    with pytest.raises(StoreConflict):
        store._commit("nodes", version, buckets)
    store.write("nodes", rows.limit(0), ["r1"])
    assert store.read("nodes").count() == 40
    store.keep_s = -1
    store.vacuum("nodes")
    assert store.read("nodes").count() == 40 and store.check() == []
    at = store._manifest("nodes")[1]
    import shutil

    shutil.rmtree(tmp_path / "s/nodes" / next(iter(at.values()))[0])
    assert len(store.check()) == 1 and "scan again" in store.check()[0]
    (tmp_path / "s/files").mkdir()
    (tmp_path / "s/files/v-000000000001.json").write_text("{")
    assert any("can't be read" in x for x in store.check())


def test_embedding_cache(repo, spark):
    embed = hashing_embedder(16)
    texts = spark.createDataFrame([("one two",), ("one two",), ("three " * 600,)], "text string")
    first = {r["text"]: r["vector"] for r in embed_cached(repo.store, texts, embed, "m", window=256).collect()}
    assert len(first) == 2 and all(len(v) == 16 for v in first.values()) and repo.store.read("embedding_cache").count() == 2
    again = {r["text"]: r["vector"] for r in embed_cached(repo.store, texts, embed, "m").collect()}
    assert again == first and repo.store.read("embedding_cache").count() == 2
    more = spark.createDataFrame([(f"text {i}",) for i in range(5)], "text string")
    embed_cached(repo.store, more, embed, "m", Settings(cache_max_rows=4, cache_trim_batch=1))
    assert repo.store.read("embedding_cache").count() == 4
    assert embed_long(texts, embed).count() == 2


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('tokenizer = "word"\nlist_limit = 7\n[search]\nrrf_k = 5\n')
    (tmp_path / "c.json").write_text(json.dumps({"ignored_dirs": ["x"]}))
    s = cli.load_settings(str(tmp_path / "c.toml"), {"list_limit": "9", "project_paths": "True"}, {"QUARRYDEX_SEARCH__RRF_K": "8", "OTHER": "1"})
    assert (s.tokenizer, s.list_limit, s.search.rrf_k, s.project_paths) == ("word", 9, 8, True)
    assert cli.load_settings(str(tmp_path / "c.json"), env={}).ignored_dirs == ("x",)
    with pytest.raises(ValueError):
        cli.load_settings(flags={"colour": "red"}, env={})
    (tmp_path / ".env").write_text('# note\nexport QUARRYDEX_LIST_LIMIT=3\nQUARRYDEX_TOKENIZER="noop"\n\nOTHER=1\n')
    s = cli.load_settings(env={"QUARRYDEX_TOKENIZER": "word"}, env_file=str(tmp_path / ".env"))
    assert (s.list_limit, s.tokenizer) == (3, "word")


def test_embedder_and_cache_choice(repo, spark):
    from quarrydex.functions import vectors as V
    from quarrydex.plans.embedding import vectors_of

    texts = spark.createDataFrame([("one",), ("two",)], "text string")
    embed = V.embedder("hashing", 8)
    assert vectors_of(repo.store, texts, embed, "m", Settings(embedding_cache="none")).count() == 2 and repo.store.read("embedding_cache").count() == 0
    assert vectors_of(repo.store, texts, embed, "m").count() == 2 and repo.store.read("embedding_cache").count() == 2
    with pytest.raises(ValueError):
        vectors_of(repo.store, texts, embed, "m", Settings(embedding_cache="odd"))
    with pytest.raises(ValueError):
        V.embedder("odd")
    with pytest.raises(ValueError):
        V.register_embedder("hashing", V.hashing_embedder)

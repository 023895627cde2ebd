"""Loads, reload plans, the catalog and the command line on a small library of delimited files."""

import copy
import json

import pytest

from graphloom import model
from graphloom.__main__ import main
from graphloom.plans import catalog, loading, mapping
from graphloom.sources.files import DelimitedFolder
from graphloom.sources.store import GraphStore


@pytest.fixture
def library(spark, tmp_path):
    d = tmp_path / "library"
    d.mkdir()
    (d / "authors.csv").write_text("id,name\n1,Ann\n2,Bo\n")
    (d / "books.csv").write_text("id,title,author_id,published\n10,A,1,1999\n11,B,,2001\n12,C,9,x\n")
    source = DelimitedFolder(spark, str(d))
    schema = source.schema()
    schema.tables["books"].column("published").data_type = "integer"
    schema.tables["books"].foreign_keys = [model.ForeignKey(["author_id"], "authors", ["id"])]
    return d, source, schema, mapping.auto_map(schema), GraphStore(spark, str(tmp_path / "store"), buckets=2)


def test_load(library):
    _, source, schema, config, store = library
    dry = loading.load_graph(store, schema, config, source.rows, dry_run=True)
    assert dry.documents == {"authors": 2, "books": 3} and len(dry.samples["books"]) == 3 and store.collections() == []
    bad, said = [], []
    done = loading.load_graph(store, schema, config, source.rows, graph_name="g", dead_letters=lambda df: bad.extend(df.collect()), on_event=lambda *x: said.append(x))
    assert done.documents == {"authors": 2, "books": 3} and done.edges == {"books_to_authors": 2} and done.errors == {}
    assert [b.raw for b in bad] == ["x"] and said[0] == ("loaded", "authors") and store.graph("g")
    again = loading.load_graph(store, schema, config, source.rows, skip_existing=True)
    assert sorted(again.skipped) == ["authors", "books", "books_to_authors"]
    twice = loading.load_graph(store, schema, config, source.rows, on_duplicate="error")
    assert set(twice.errors) == {"authors", "books", "books_to_authors"}
    part = loading.load_graph(store, schema, config, source.rows, include_tables=["authors"], drop_collections=True)
    assert part.documents == {"authors": 2} and part.edges == {}


def test_reload_follows_a_mapping(library):
    _, source, schema, config, store = library
    loading.load_graph(store, schema, config, source.rows)
    new = copy.deepcopy(config)
    new.collections["authors"].target_collection = "Writers"
    new.collections["books"].field_mappings = {"title": "name"}
    plan = mapping.diff_mappings(config, new)
    assert len(loading.execute(plan, store, schema, new, source.rows, dry_run=True).skipped) == len(plan)
    done = loading.execute(plan, store, schema, new, source.rows)
    assert done.errors == {} and store.documents("authors") is None
    assert {r._to for r in store.documents("books_to_authors").collect()} == {"Writers/1", "Writers/9"}
    assert {"name", "published"} <= set(store.documents("books").columns) and store.documents("Writers").count() == 2
    failed = loading.execute([mapping.Action("reload", "nope"), mapping.Action("odd", "x")], store, schema, new, source.rows)
    assert len(failed.errors) == 2


def test_catalog(tmp_path):
    c = catalog.Catalog(tmp_path / "c/catalog.json")
    c.put("sources", "lib", {"type": "csv"})
    with pytest.raises(KeyError):
        c.put("sources", "lib", {})
    schema = model.Schema({"t": model.Table("t", [model.Column("id")], ["id"])})
    assert [c.snapshot("lib", schema), c.snapshot("lib", schema)] == ["lib@1", "lib@2"] == c.snapshots("lib")
    assert c.schema("lib@1") == schema
    c.put("projects", "p", {"source": "lib"})
    c.record_load("p", {"documents": 3})
    c.record_load("p", {"documents": 4})
    assert [x["documents"] for x in c.history("p")] == [3, 4]
    c.remove("sources", "lib")
    assert c.names("sources") == [] and c.snapshots("lib") == []


def test_proposals():
    schema = model.Schema({"t": model.Table("t", [model.Column("id"), model.Column("a")], ["id"]), "u": model.Table("u", [model.Column("id")], ["id"])})
    config, left = catalog.from_proposal(schema, {"collections": {"t": {"target": "T", "rename": {"a": "b", "zz": "y"}}, "ghost": {}}, "edges": [{"name": "e", "from": "t", "to": "u", "from_fields": ["a"], "to_fields": ["id"]}, {"name": "f", "from": "t", "to": "ghost"}]})
    assert config.collections["t"].target_collection == "T" and config.collections["t"].field_mappings == {"a": "b"} and [e.edge_collection for e in config.edges] == ["e"] and len(left) == 3
    config, left = catalog.from_proposal(schema, {"collections": {"t": {"rename": {"a": "_key"}}}})
    assert config == mapping.auto_map(schema) and "reserved" in left[0]


def test_command_line(library, tmp_path, capsys):
    d, _, schema, config, _ = library
    s, m, out = (str(tmp_path / x) for x in ("s.json", "m.json", "out"))
    model.save(schema, s)
    assert main(["generate-config", s, m]) == 0 and model.load(model.MappingConfig, m) == config
    assert main(["validate-config", s, m]) == 0 and main(["diff-schema", s, s]) == 0 and main(["mapping-diff", m, m]) == 0 and main(["migrate-config", m, s, m]) == 0
    for command in (["infer-fks", s], ["export-model", s, m], ["export-r2rml", s, m], ["entitlements", s, m], ["generate-import", m, "/x", "tool"], ["validate-schema", s], ["analyze-denorm", s, "--data", str(d)]):
        assert main(command) == 0
    capsys.readouterr()
    assert main(["validate-data", s, str(d)]) == 1
    found = json.loads(capsys.readouterr().out)
    assert found["references"][0]["orphans"] == 1 and [(i["check"], i["value"]) for i in found["issues"]] == [("books.author_id", "9")]
    assert main(["generate-csv-import", s, m, "/x", "tool"]) == 0
    script = capsys.readouterr().out
    assert '--translate "id=_key"' in script and '--translate "author_id=_to"' in script and '--to-collection-prefix "authors"' in script and '--remove-attribute "title"' in script
    assert main(["entitlements-emit", s, m, str(tmp_path / "gov")]) == 0 and main(["diff-classifications", s, s]) == 0
    assert sorted(p.name for p in (tmp_path / "gov").iterdir()) == ["classification.json", "layout.json", "lineage.json", "policy.rego", "roles.json"]
    assert main(["transform", s, m, out, str(d)]) == 0 and main(["load", s, m, str(tmp_path / "st"), str(d)]) == 0
    assert main(["inspect", "books", str(d), "--rows", "1"]) == 0 and main(["ingest-schema", s, str(d)]) == 0 and main(["dump", out + "2", str(d)]) == 0
    model.save(mapping.auto_map(model.load(model.Schema, s)), m)
    assert main(["selective-reload", m, m, s, str(tmp_path / "st"), str(d), "--dry-run"]) == 0

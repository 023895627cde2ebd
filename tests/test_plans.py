"""Mappings, migration, naming, inference, governance and exports: driver-side, no session."""

import copy

import pytest

from graphloom import model
from graphloom.functions.masking import mask
from graphloom.functions.types import clean_type, logical_type
from graphloom.plans import export, governance, inference, mapping, naming
from graphloom.plans.mapping import Action


def table(name, columns, pk=("id",), fks=(), **more):
    cols = [model.Column(c, t, c not in pk, c in pk) for c, t in (x if isinstance(x, tuple) else (x, "integer") for x in columns)]
    return model.Table(name, cols, list(pk), [model.ForeignKey(list(c), t, list(k)) for c, t, k in fks], **more)


def shop():
    return model.Schema(
        {
            "users": table("users", ["id", ("name", "text"), ("email", "text")]),
            "orders": table("orders", ["id", "user_id", ("total", "numeric")], fks=[(["user_id"], "users", ["id"])]),
            "items": table("items", ["order_id", "product_id", "qty"], pk=("order_id", "product_id"), fks=[(["order_id"], "orders", ["id"]), (["product_id"], "products", ["id"])]),
            "products": table("products", ["id", ("title", "text")]),
        }
    )


@pytest.mark.parametrize("source, logical", [("BIGINT", "integer"), ("numeric(10,2)", "float"), ("text[]", "array"), ("ARRAY<int>", "array"), ("jsonb", "object"), ("bool", "boolean"), ("timestamptz", "string"), ("double precision", "float"), ("UInt64", "integer"), ("Decimal(9, 2)", "float"), ("nothing known", "string"), ("money", "string"), ("bit", "string"), ("vector", "array")])
def test_logical_types(source, logical):
    assert logical_type(source) == logical


def test_clean_type():
    assert clean_type("LowCardinality(Nullable(String))") == "String" and clean_type(" Int64 ") == "Int64"


def test_auto_map_and_names():
    schema = shop()
    schema.tables["items_2024"] = table("items_2024", ["order_id"], pk=("order_id",), partition_of="items")
    schema.tables["pairs"] = table("pairs", ["id", "a", "b", "c"], fks=[(["a"], "users", ["id"]), (["b"], "users", ["id"])])
    config = mapping.auto_map(schema)
    assert set(config.collections) == {"users", "orders", "items", "products", "pairs"}
    assert config.collections["items"].is_join_table and not config.collections["pairs"].is_join_table
    assert [e.edge_collection for e in config.edges] == ["orders_to_users", "items_to_orders", "items_to_products", "pairs_to_users", "pairs_to_users_b"]
    assert "items_2024" in mapping.auto_map(schema, expand_partitions=True).collections


def test_partitions_roll_up():
    schema = model.Schema(
        {
            "events": table("events", ["id"], is_partitioned=True),
            "e1": table("e1", ["id", "u"], fks=[(["u"], "users", ["id"])], partition_of="events", is_partitioned=True),
            "e2": table("e2", ["id", "u"], fks=[(["u"], "users", ["id"])], partition_of="e1"),
        }
    )
    assert len(schema.roll_up_partitions().tables["events"].foreign_keys) == 1 and not schema.tables["events"].foreign_keys


def test_validate():
    schema, config = shop(), mapping.auto_map(shop())
    assert mapping.validate(schema, config) == []
    config.collections["users"] = model.CollectionMapping(
        "users", "People", field_mappings={"nope": "x", "name": "_key"}, exclude_fields=["gone"], include_fields=["lost"],
        field_expressions=[model.FieldExpression("_id", ["zip"], "@zap"), model.FieldExpression("bad", [], "1 +"), mask("email", "hash")],
    )
    config.collections["ghost"] = model.CollectionMapping("ghost", "ghost")
    schema.tables["orders"].primary_key = []
    config.edges += [model.EdgeDefinition("e", "orders", "People", ["zip"], ["id"])]
    text = "\n".join(mapping.validate(schema, config))
    for part in ("'nope'", "'_key' is a reserved", "'gone'", "'lost'", "'_id' is a reserved", "'zip'", "@zap", "is invalid", "'ghost' not found", "no primary key", "target of table 'users'"):
        assert part in text, part
    assert "MD5" not in text


def test_topological_order():
    schema = shop()
    assert mapping.topological_order(schema) == (["products", "users", "orders", "items"], [])
    schema.tables["a"] = table("a", ["id", "b"], fks=[(["b"], "b", ["id"]), (["id"], "a", ["id"]), (["b"], "missing", ["id"])])
    schema.tables["b"] = table("b", ["id", "a"], fks=[(["a"], "a", ["id"])])
    schema.tables["c"] = table("c", ["id", "a"], fks=[(["a"], "a", ["id"])])
    assert mapping.topological_order(schema) == (["products", "users", "orders", "items", "a", "b", "c"], [["a", "b"]])


def test_schema_diff_and_migration():
    old, new = shop(), shop()
    del new.tables["products"]
    new.tables["tags"] = table("tags", ["id", "user_id"], fks=[(["user_id"], "users", ["id"])])
    users = new.tables["users"]
    users.columns = [c for c in users.columns if c.name != "email"] + [model.Column("age", "integer")]
    users.column("name").data_type = "varchar"
    users.primary_key = ["id", "name"]
    new.tables["items"].foreign_keys.pop()
    diff = mapping.diff_schemas(old, new)
    assert (diff["added_tables"], diff["removed_tables"]) == (["tags"], ["products"])
    found = diff["modified_tables"]["users"]
    assert found["removed_columns"] == ["email"] and found["added_columns"][0]["name"] == "age" and found["type_changes"][0]["new_type"] == "varchar" and found["pk_changed"]
    assert diff["modified_tables"]["items"]["removed_fks"][0]["foreign_table"] == "products"
    config = mapping.auto_map(old)
    config.collections["users"].field_mappings = {"email": "mail", "name": "label"}
    config.collections["users"].include_fields = ["email"]
    config.type_overrides = {"users.email": "string", "gone.x": "string", "total": "string"}
    before = copy.deepcopy(config)
    moved, report = mapping.migrate(config, new)
    assert config == before
    assert report.added_collections == ["tags"] and report.orphaned_collections == ["products"] and report.added_edges == ["tags_to_users"] and report.removed_edges == ["items_to_products (items -> products)"]
    assert moved.collections["users"].field_mappings == {"name": "label"} and moved.collections["users"].include_fields is None and moved.type_overrides == {"total": "string"}
    assert len(report.cleaned_fields) == 4


def test_mapping_diff():
    a = mapping.auto_map(shop())
    assert mapping.diff_mappings(a, copy.deepcopy(a)) == []
    b = copy.deepcopy(a)
    b.key_separator = "-"
    found = mapping.diff_mappings(a, b)
    assert {x.kind for x in found} == {"reload", "reload_edge", "rebuild_graph"} and len(found) == 4 + 3 + 1
    b = copy.deepcopy(a)
    b.collections["users"].target_collection = "People"
    b.collections["products"].field_mappings = {"title": "name"}
    b.collections["orders"].field_expressions = [model.FieldExpression("x", [], "1")]
    b.type_overrides = {"items.qty": "string"}
    b.edges = [e for e in b.edges if e.edge_collection != "items_to_products"]
    found = mapping.diff_mappings(a, b)
    for want in (Action("rename", "People", "users"), Action("reload_edge", "orders_to_users", "endpoint renamed"), Action("rename_field", "products", "title->name"), Action("reload", "orders", "field_expressions changed"), Action("reload", "items", "type_overrides changed: items.qty"), Action("drop", "items_to_products", "edge removed"), Action("rebuild_graph", "graph")):
        assert want in found, want
    assert len(found) == len(set(found)) == 7


@pytest.mark.parametrize("name, snake, camel, pascal", [("HTTPServer", "http_server", "httpServer", "HttpServer"), ("user_id", "user_id", "userId", "UserId"), ("Order Items-2", "order_items_2", "orderItems2", "OrderItems2"), ("___", "___", "___", "___")])
def test_case(name, snake, camel, pascal):
    assert [naming.convert(name, s) for s in ("snake", "camel", "pascal", "preserve")] == [snake, camel, pascal, name]


@pytest.mark.parametrize("one, many", [("order", "orders"), ("city", "cities"), ("box", "boxes"), ("branch", "branches"), ("day", "days"), ("bus", "buses"), ("", "")])
def test_number(one, many):
    assert naming.pluralize(one) == many and naming.singularize(many) == one


def test_convention():
    config = mapping.auto_map(shop())
    config.collections["users"].field_mappings = {"name": "full_name"}
    out = naming.apply_convention(config, model.NamingConvention("pascal", "camel", "snake"), shop())
    assert out.collections["orders"].target_collection == "Orders" and out.collections["orders"].field_mappings == {"user_id": "userId"}
    assert out.collections["users"].field_mappings == {"name": "full_name"} and out.edges[0].from_collection == "orders"
    assert config.collections["orders"].target_collection == "orders"


def test_plain_round_trip(tmp_path):
    schema, config = shop(), mapping.auto_map(shop())
    schema.tables["users"].column("email").classification = model.Classification(["PII"])
    config.collections["users"].field_expressions = [mask("email", "hash")]
    for value, name in ((schema, "s.json"), (config, "m.yaml"), (config, "m.json")):
        model.save(value, tmp_path / name)
        assert model.load(type(value), tmp_path / name) == value
    (tmp_path / "e.json").write_text("")
    assert model.load(model.MappingConfig, tmp_path / "e.json") == model.MappingConfig()
    edge = model.from_plain(model.EdgeDefinition, {"edge_collection": "e", "from_collection": "a", "to_collection": "b", "from_field": "x, y", "to_field": "z", "unknown": 1})
    assert edge.from_fields == ["x", "y"] and edge.to_fields == ["z"]


def infer(*tables, **options):
    return inference.infer_foreign_keys(model.Schema({t.name: t for t in tables}), **options)


def test_foreign_key_inference():
    users, orders = table("users", ["id"]), table("orders", ["id", "user_id"])
    (found,) = infer(users, orders)
    assert (found.table, found.columns, found.foreign_table, found.foreign_columns, found.method) == ("orders", ["user_id"], "users", ["id"], "name_suffix") and found.confidence >= 0.75
    assert infer(table("user", ["id"]), orders)[0].foreign_table == "user"
    assert infer(users, table("orders", ["id", "user_id"], fks=[(["user_id"], "users", ["id"])])) == []
    assert infer(users, table("flags", ["id", ("user_id", "boolean")])) == []
    assert infer(users, table("orders", ["id", ("user_id", "number")]))
    assert infer(users, table("sessions", ["id"])) == []
    assert infer(table("products", [("sku", "text")], pk=("sku",)), table("lines", ["id", ("sku", "text")]))[0].foreign_table == "products"
    (loose,) = infer(users, table("orders", ["id", "userid"]))
    assert loose.confidence < 0.6 and infer(users, table("orders", ["id", "userid"]), min_confidence=0.9) == []
    users.columns[0].is_nullable = True
    orders.column("user_id").is_nullable = False
    assert infer(users, orders)[0].confidence < 0.8
    lines, op = table("order_lines", ["id", "order_id", "product_id"]), table("order_products", ["order_id", "product_id"], pk=("order_id", "product_id"))
    assert [c.columns for c in infer(op, lines) if c.method == "composite"] == [["order_id", "product_id"]]
    assert not [c for c in infer(op, lines, allow_composite=False) if c.method == "composite"]
    assert found.edge().edge_collection == "orders_to_users"


def test_foreign_key_overlap():
    t = (table("users", ["id"]), table("orders", ["id", "user_id"]))
    plain = infer(*t)[0].confidence
    assert infer(*t, overlap=lambda *a: 1.0)[0].confidence > plain
    assert infer(*t, overlap=lambda *a: 0.0) == []
    assert infer(*t, overlap=lambda *a: 0.0, veto_on_zero=False)[0].confidence == 0.6
    assert infer(*t, overlap=lambda *a: None)[0].confidence == plain == infer(*t, overlap=lambda *a: 1 / 0)[0].confidence


def test_denormalization():
    t = table("customers", ["id", ("email", "text"), ("zip", "text"), ("city", "text"), ("state", "text"), ("phone1", "text"), ("phone_2", "text"), ("md5", "text")], fks=[(["id"], "people", ["id"])])
    schema = model.Schema({"customers": t, "people": table("people", ["id"])})
    ratios = {"email": 1.0, "zip": 0.1, "city": 0.15, "state": 0.05}
    strengths = {("zip", "city"): 1.0, ("zip", "state"): 1.0, ("city", "zip"): 0.2, ("city", "state"): 0.9, ("state", "zip"): 0.1, ("state", "city"): 0.1}
    found = {f.kind: f for f in inference.analyze_table(t, schema, ratios, strengths, {("email", ";"): 0.9, ("email", ","): 0.9, ("zip", ","): 0.2})}
    assert set(found) == {"embedded_lookup", "repeating_group", "one_to_one", "multi_valued"}
    assert found["embedded_lookup"].columns == ["zip", "city", "state"] and found["embedded_lookup"].confidence == 0.9
    assert found["repeating_group"].columns == ["phone1", "phone_2"] and found["repeating_group"].confidence == 0.7
    assert "','" in found["multi_valued"].evidence[0]
    (redundant,) = inference.redundant_references(t, {"state": 0.01, "id": 0.01, "zip": 0.5}, set())
    assert redundant.columns == ["state"] and redundant.confidence == 0.75
    assert "customers" in inference.hints(list(found.values()))
    t.column("email").classification = model.Classification(["PII"])
    assert inference.sampleable(t, frozenset({"zip", "customers.city"})) == ["id", "state", "phone1", "phone_2", "md5"]


def test_shared_keys():
    click = model.Schema({"usage": table("usage", [("account_id", "UInt64"), ("region_id", "String"), "id"], pk=())})
    crm = model.Schema({"accounts": table("accounts", [("account_id", "bigint"), ("region_id", "bigint")], pk=("account_id",)), "contacts": table("contacts", ["id", ("account_id", "bigint"), "owner_id"])})
    found, left = inference.infer_shared_keys({"click": click, "crm": crm})
    (key,) = found
    assert (key.key, key.hub, key.concept, key.references, key.confidence) == ("account_id", ("crm", "accounts", "account_id"), "Account", [("click", "usage", "account_id")], 0.9)
    reasons = {(s, t, r) for s, t, _, _, r in left}
    assert {("crm", "contacts", "same_source_as_hub"), ("crm", "accounts", "hub_table"), ("crm", "contacts", "single_source"), ("click", "usage", "generic_name")} <= reasons
    assert any(r == "type_mismatch" for *_, r in left)
    assert inference.infer_shared_keys({"click": click, "crm": crm}, overlap=lambda a, b: 0.95)[0][0].confidence == 0.98
    virtual, _ = inference.infer_shared_keys({"a": model.Schema({"x": table("x", ["id", "tenant_id"])}), "b": model.Schema({"y": table("y", ["id", "tenant_id"])})})
    assert virtual[0].method == "virtual_hub" and virtual[0].confidence == 0.5


def governed():
    schema = shop()
    n = governance.annotate(schema, {"users": {"email": model.Classification(["PII.Sensitive"]), "name": model.Classification([], "Tier.Tier2"), "nope": model.Classification(["x"])}, "none": {}})
    assert n == 2
    config = mapping.auto_map(schema)
    config.collections["users"].field_expressions = [model.FieldExpression("contact", ["name", "email"], "CONCAT(@name, @email)")]
    return schema, config


def test_levels():
    g = governance
    assert g.tag_level("PII.Sensitive.Deep") == "restricted" and g.tag_level("PersonalData.Special") == "restricted" and g.tag_level("personaldata.other") == "confidential" and g.tag_level("odd") is None and g.tag_level("piix") is None
    assert g.highest(["internal", "restricted", "odd"]) == "restricted" and g.highest([]) == "public" and g.reaches("confidential", "confidential") and not g.reaches("odd", "internal")


def test_mosaic_gate_and_artifacts():
    schema, config = governed()
    found = governance.report(config, schema)
    assert found.collections == {"users": "restricted", "orders": "public", "items": "public", "products": "public"} and found.edges["orders_to_users"] == "restricted" and found.edges["items_to_orders"] == "public"
    assert {f.property for f in found.blocked} == {"contact", "email"}
    gated, out = governance.gate(config, found)
    users = gated.collections["users"]
    assert users.field_expressions == [] and set(users.exclude_fields) == {"name", "email"} and config.collections["users"].exclude_fields == []
    assert governance.gate(config, found, allow_sensitive=True) == (config, [])
    handling = {(p["collection"], p["property"]): p["handling"] for p in governance.manifest(found, out)["properties"]}
    assert handling["users", "email"] == "excluded" and handling["users", "id"] == "loaded"
    config.collections["users"].field_expressions = [mask("email", "tokenize")]
    masked = governance.report(config, schema)
    assert masked.blocked == [] and {p["property"]: p["handling"] for p in governance.manifest(masked)["properties"] if p["collection"] == "users"}["email"] == "masked"
    roles = governance.suggested_roles(found)
    assert [r["clearance"] for r in roles] == ["public", "restricted"] and "users" not in roles[0]["collections"]
    assert governance.tier_layout(found)["restricted"] == ["orders_to_users", "users"]
    assert '"users": "restricted"' in governance.rego_policy(found)
    assert governance.drift(shop(), schema) == [("users", "email", "public", "restricted"), ("users", "name", "public", "internal")]


def test_exports():
    schema, config = shop(), mapping.auto_map(shop())
    document = export.conceptual_model(config, schema)
    assert export.check_model(document) == []
    assert {"name": "items", "from": "Order", "to": "Product"} in document["conceptual"]["relationships"]
    names = {e["name"]: [p["name"] for p in e["properties"]] for e in document["conceptual"]["entities"]}
    assert names["User"] == ["userId", "name", "email"] and set(names) == {"User", "Order", "Product"}
    roles = export.conceptual_model(config, schema, label_policy="roles")
    assert [p["name"] for e in roles["conceptual"]["entities"] if e["name"] == "User" for p in e["properties"]] == ["name", "email"]
    assert export.conceptual_model(config, schema, label_policy="off")["provenance"]["labelCollisions"] == []
    assert [c["label"] for c in export.conceptual_model(config, schema, label_policy="warn")["provenance"]["labelCollisions"]] == ["id"]
    assert export.check_model({}) and pytest.raises(ValueError, export.conceptual_model, config, schema, label_policy="odd")
    turtle = export.r2rml(config, schema)
    assert 'rr:tableName "orders"' in turtle and "xsd:double" in turtle and "ordersToUsers" in turtle
    script = export.load_script(config, "/data", "loader")
    assert script.index("users") < script.index("orders_to_users") and "--on-duplicate replace" in script
    assert "graph._relation" in export.graph_script(config, "g", "m") and len(export.picture_data(config, schema)["links"]) == 3
    assert export.entity_name("usage_metrics") == "UsageMetric"

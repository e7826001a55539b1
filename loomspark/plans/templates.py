"""Three pipelines to start from; paths and addresses are parameters."""

from __future__ import annotations


def _node(key: str, kind: str, label: str, **config: object) -> dict:
    return {"id": key, "type": kind, "data": {"label": label, "config": config}}


def _chain(*keys: str) -> list[dict]:
    return [{"source": a, "target": b} for a, b in zip(keys, keys[1:], strict=False)]


def csv_cleaning(file_path: str = "customers.csv", db_path: str = "cleaned.db", table_name: str = "customers") -> dict:
    """CSV to SQLite: valid ages and known addresses, one row per e-mail."""
    return {
        "nodes": [
            _node("read", "source", "Customers", source_type="csv", source_config={"file_path": file_path}),
            _node("valid", "filter", "Valid rows", condition="age > 0 and email.notnull()"),
            _node("shape", "map", "Types and names", operations=[{"type": "type_convert", "column": "age", "target_type": "int"}, {"type": "rename", "old_name": "name", "new_name": "full_name"}]),
            _node("once", "deduplicate", "One per e-mail", columns=["email"], keep="first"),
            _node("write", "output", "Clean customers", output_type="sqlite", output_config={"db_path": db_path, "table_name": table_name, "write_mode": "replace"}),
        ],
        "edges": _chain("read", "valid", "shape", "once", "write"),
    }


def multi_table_join(db_path: str = "sales.db", filename: str = "sales_by_region.csv", export_dir: str = "exports", aliases: tuple[str, str, str] = ("total_amount", "order_count", "avg_amount")) -> dict:
    """Orders and customers joined, summed by region, largest first, to CSV. aliases: what the sum, the count and the mean are called."""
    total, count, mean = aliases
    return {
        "nodes": [
            _node("orders", "source", "Orders", source_type="sqlite", source_config={"db_path": db_path, "table_name": "orders"}),
            _node("customers", "source", "Customers", source_type="sqlite", source_config={"db_path": db_path, "table_name": "customers"}),
            _node("both", "join", "Orders with customers", join_type="inner", left_key="customer_id", right_key="id"),
            _node(
                "by_region", "aggregate", "By region", group_by=["region"],
                aggregations=[{"column": "amount", "function": "sum", "alias": total}, {"column": "id", "function": "count", "alias": count}, {"column": "amount", "function": "avg", "alias": mean}],
            ),
            _node("largest", "sort", "Largest first", sort_by=[{"column": total, "ascending": False}]),
            _node("write", "output", "Regions", output_type="csv", output_config={"filename": filename, "export_dir": export_dir}),
        ],
        "edges": [{"source": "orders", "target": "both"}, {"source": "customers", "target": "both", "targetHandle": "join_right"}, *_chain("both", "by_region", "largest", "write")],
    }


def api_sync(url: str = "http://localhost/users", cities: tuple[str, ...] = ("Gwenborough", "Wisokyburgh"), db_path: str = "users.db") -> dict:
    """Users from an address split by city into two tables."""
    listed = ", ".join(repr(c) for c in cities)
    sink = lambda table: {"output_type": "sqlite", "output_config": {"db_path": db_path, "table_name": table, "write_mode": "replace"}}
    return {
        "nodes": [
            _node("users", "source", "Users", source_type="http_api", source_config={"url": url, "data_path": ""}),
            _node("shape", "map", "Names and address", operations=[{"type": "rename", "old_name": "id", "new_name": "user_id"}, {"type": "compute", "new_column": "full_address", "expression": "address.street + ', ' + address.city"}]),
            _node("by_city", "branch", "By city", branches=[{"name": "near", "condition": f"address.city in [{listed}]"}, {"name": "far", "condition": ""}]),
            _node("near", "output", "Near", **sink("users_near")),
            _node("far", "output", "Far", **sink("users_far")),
        ],
        "edges": [*_chain("users", "shape", "by_city"), {"source": "by_city", "target": "near", "sourceHandle": "branch_0"}, {"source": "by_city", "target": "far", "sourceHandle": "branch_1"}],
    }


TEMPLATES = {"csv_cleaning": csv_cleaning, "multi_table_join": multi_table_join, "api_sync": api_sync}


def instantiate(name: str, **parameters: object) -> dict:
    if name not in TEMPLATES:
        raise KeyError(f"no template {name!r}")
    return TEMPLATES[name](**parameters)

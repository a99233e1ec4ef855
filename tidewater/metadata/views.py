"""The columns and rows of every metadata view. Kinds: s text, i int, l bigint, b bit, d datetime."""

from __future__ import annotations

import datetime as dt

from tidewater.catalog import Table, View
from tidewater.functions.system import TYPE_IDS, bytes_of, indexes_of
from tidewater.tsql import types as t

EPOCH = dt.datetime(2000, 1, 1)
VIEWS: dict[tuple[str, str], tuple] = {}


def view(schema: str, name: str, spec: str):
    def register(rows):
        VIEWS[schema, name] = (spec, rows)
        return rows

    return register


def shown_type(kind: t.Type) -> str:
    return {"datetime": "datetime2", "bit": "bit"}.get(kind.name, kind.name)


def tables(s):
    return list(s.catalog.tables.values())


def relations(s):
    """(object, columns) of tables and views."""
    for x in tables(s):
        yield x, x.columns
    for v in s.catalog.views.values():
        from tidewater.catalog import Column

        rel = s.bind(v.query)
        names = v.columns or [c for c, _ in rel.columns]
        yield v, [Column(n, k) for n, (_, k) in zip(names, rel.columns)]


def numbers(kind: t.Type):
    """(precision, radix, scale) of a number type."""
    if kind.name == "float":
        return 53, 2, None
    if kind.is_number:
        p, s = t.digits(kind)
        return p, 10, s
    return None, None, None


def widths(kind: t.Type):
    if kind.is_string:
        n = kind.length if kind.length is not None else -1
        return n, n * 2 if n > 0 and kind.name.startswith("n") else n
    if kind.name in ("binary", "varbinary"):
        return kind.length or -1, kind.length or -1
    return None, None


# INFORMATION_SCHEMA

I = "information_schema"  # noqa: E741


@view(I, "schemata", "CATALOG_NAME:s SCHEMA_NAME:s SCHEMA_OWNER:s")
def _(s):
    return [(s.database, name, "dbo") for name in s.catalog.schemas]


@view(I, "tables", "TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s TABLE_TYPE:s")
def _(s):
    return [(s.database, x.schema, x.name, "BASE TABLE") for x in tables(s)] + [(s.database, x.schema, x.name, "VIEW") for x in s.catalog.views.values()]


@view(I, "views", "TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s VIEW_DEFINITION:s CHECK_OPTION:s IS_UPDATABLE:s")
def _(s):
    return [(s.database, x.schema, x.name, x.text, "NONE", "NO") for x in s.catalog.views.values()]


@view(I, "columns", "TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s ORDINAL_POSITION:i COLUMN_DEFAULT:s IS_NULLABLE:s DATA_TYPE:s CHARACTER_MAXIMUM_LENGTH:i CHARACTER_OCTET_LENGTH:i NUMERIC_PRECISION:i NUMERIC_PRECISION_RADIX:i NUMERIC_SCALE:i DATETIME_PRECISION:i COLLATION_NAME:s")
def _(s):
    for x, columns in relations(s):
        for i, c in enumerate(columns):
            default = f"({c.default.value!r})" if c.default is not None and c.default.kind == "lit" else "(...)" if c.default is not None else None
            yield (s.database, x.schema, x.name, c.name, i + 1, default, "YES" if c.nullable else "NO", shown_type(c.type), *widths(c.type), *numbers(c.type), 7 if c.type.name == "datetime" else 0 if c.type.name == "date" else None, "SQL_Latin1_General_CP1_CI_AS" if c.type.is_string else None)


KEYS = {"primary": "PRIMARY KEY", "unique": "UNIQUE", "check": "CHECK", "foreign": "FOREIGN KEY"}


def rules(s, *kinds):
    for x in tables(s):
        for c in x.constraints:
            if c.type in (kinds or KEYS):
                yield x, c


@view(I, "table_constraints", "CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s CONSTRAINT_TYPE:s IS_DEFERRABLE:s INITIALLY_DEFERRED:s")
def _(s):
    return [(s.database, x.schema, c.name, s.database, x.schema, x.name, KEYS[c.type], "NO", "NO") for x, c in rules(s)]


@view(I, "check_constraints", "CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s CHECK_CLAUSE:s")
def _(s):
    return [(s.database, x.schema, c.name, c.text) for x, c in rules(s, "check")]


@view(I, "referential_constraints", "CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s UNIQUE_CONSTRAINT_CATALOG:s UNIQUE_CONSTRAINT_SCHEMA:s UNIQUE_CONSTRAINT_NAME:s MATCH_OPTION:s UPDATE_RULE:s DELETE_RULE:s")
def _(s):
    for x, c in rules(s, "foreign"):
        parent = s.catalog.tables.get(c.table)
        key = next((k.name for k in parent.constraints if k.type in ("primary", "unique")), None) if parent else None
        yield (s.database, x.schema, c.name, s.database, c.table[0], key, "SIMPLE", c.on_update.upper(), c.on_delete.upper())


@view(I, "key_column_usage", "CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s ORDINAL_POSITION:i")
def _(s):
    return [(s.database, x.schema, c.name, s.database, x.schema, x.name, k, i + 1) for x, c in rules(s, "primary", "unique", "foreign") for i, k in enumerate(c.columns)]


@view(I, "constraint_column_usage", "TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s")
def _(s):
    return [(s.database, x.schema, x.name, k, s.database, x.schema, c.name) for x, c in rules(s) for k in c.columns]


@view(I, "constraint_table_usage", "TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s")
def _(s):
    return [(s.database, x.schema, x.name, s.database, x.schema, c.name) for x, c in rules(s)]


def routines(s):
    return [*s.catalog.procedures.values(), *s.catalog.functions.values()]


@view(I, "routines", "ROUTINE_CATALOG:s ROUTINE_SCHEMA:s ROUTINE_NAME:s ROUTINE_TYPE:s DATA_TYPE:s ROUTINE_DEFINITION:s")
def _(s):
    for x in routines(s):
        n = x.node
        yield (s.database, x.schema, x.name, "PROCEDURE" if n.kind == "create_procedure" else "FUNCTION", None if n.kind == "create_procedure" else "TABLE" if n.query is not None else shown_type(n.returns), n.text)


@view(I, "parameters", "SPECIFIC_CATALOG:s SPECIFIC_SCHEMA:s SPECIFIC_NAME:s ORDINAL_POSITION:i PARAMETER_MODE:s PARAMETER_NAME:s DATA_TYPE:s CHARACTER_MAXIMUM_LENGTH:i")
def _(s):
    return [(s.database, x.schema, x.name, i + 1, "INOUT" if p.output else "IN", p.name, shown_type(p.type), widths(p.type)[0]) for x in routines(s) for i, p in enumerate(x.node.parameters)]


@view(I, "routine_columns", "TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s ORDINAL_POSITION:i DATA_TYPE:s")
def _(s):
    return []


@view(I, "table_privileges", "GRANTOR:s GRANTEE:s TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s PRIVILEGE_TYPE:s IS_GRANTABLE:s")
def _(s):
    return [("dbo", "dbo", s.database, x.schema, x.name, p, "YES") for x in tables(s) for p in ("SELECT", "INSERT", "UPDATE", "DELETE", "REFERENCES")]


@view(I, "column_privileges", "GRANTOR:s GRANTEE:s TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s PRIVILEGE_TYPE:s IS_GRANTABLE:s")
def _(s):
    return [("dbo", "dbo", s.database, x.schema, x.name, c.name, p, "YES") for x in tables(s) for c in x.columns for p in ("SELECT", "UPDATE")]


def used_tables(v: View):
    from tidewater.tsql.ast import walk

    return [n.parts for n in walk(v.query, into_queries=True) if n.kind == "table"]


@view(I, "view_table_usage", "VIEW_CATALOG:s VIEW_SCHEMA:s VIEW_NAME:s TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s")
def _(s):
    return [(s.database, v.schema, v.name, s.database, s.catalog.key(p)[0], p[-1]) for v in s.catalog.views.values() for p in used_tables(v)]


@view(I, "view_column_usage", "VIEW_CATALOG:s VIEW_SCHEMA:s VIEW_NAME:s TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s")
def _(s):
    from tidewater.tsql.ast import walk

    for v in s.catalog.views.values():
        used = {n.parts[-1].lower() for n in walk(v.query, into_queries=True) if n.kind == "col"}
        for p in used_tables(v):
            x = s.catalog.tables.get(s.catalog.resolve(p))
            for c in x.columns if x else []:
                if c.name.lower() in used:
                    yield (s.database, v.schema, v.name, s.database, x.schema, x.name, c.name)


@view(I, "domains", "DOMAIN_CATALOG:s DOMAIN_SCHEMA:s DOMAIN_NAME:s DATA_TYPE:s")
def _(s):
    return [(s.database, "dbo", key[1], x.base.name) for key, x in s.catalog.types.items() if x.base is not None]


VIEWS[I, "column_domain_usage"] = ("DOMAIN_CATALOG:s DOMAIN_SCHEMA:s DOMAIN_NAME:s TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s", lambda s: [])
VIEWS[I, "domain_constraints"] = ("CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s DOMAIN_CATALOG:s DOMAIN_SCHEMA:s DOMAIN_NAME:s", lambda s: [])

# sys


def schema_id(s, x) -> int:
    return s.catalog.schemas.get(x.schema.lower(), 1)


@view("sys", "schemas", "name:s schema_id:i principal_id:i")
def _(s):
    return [(n, i, 1) for n, i in s.catalog.schemas.items()]


@view("sys", "databases", "name:s database_id:i owner_sid:s create_date:d compatibility_level:i collation_name:s state:i state_desc:s is_read_only:b recovery_model_desc:s")
def _(s):
    return [(n, i + 1, "01", EPOCH, 160, "SQL_Latin1_General_CP1_CI_AS", 0, "ONLINE", False, "SIMPLE") for i, n in enumerate(dict.fromkeys(["master", "tempdb", "model", "msdb", s.engine.database]))]


VIEWS["sys", "sysdatabases"] = ("name:s dbid:i", lambda s: [(n, i + 1) for i, n in enumerate(["master", "tempdb", "model", "msdb", s.engine.database])])


def kind_code(x) -> tuple[str, str]:
    if isinstance(x, Table):
        return "U", "USER_TABLE"
    if isinstance(x, View):
        return "V", "VIEW"
    node = getattr(x, "node", None)
    if node is None:
        return "SO", "SEQUENCE_OBJECT"
    if node.kind == "create_procedure":
        return "P", "SQL_STORED_PROCEDURE"
    if node.kind == "create_trigger":
        return "TR", "SQL_TRIGGER"
    return ("IF", "SQL_INLINE_TABLE_VALUED_FUNCTION") if node.query is not None else ("FN", "SQL_SCALAR_FUNCTION")


def objects(s):
    return [x for held in s.catalog.kinds().values() for x in held.values() if hasattr(x, "id")]


def object_rows(s):
    out = [(x.name, x.id, schema_id(s, x), 0, *kind_code(x), EPOCH, EPOCH, False) for x in objects(s)]
    codes = {"primary": ("PK", "PRIMARY_KEY_CONSTRAINT"), "unique": ("UQ", "UNIQUE_CONSTRAINT"), "check": ("C", "CHECK_CONSTRAINT"), "foreign": ("F", "FOREIGN_KEY_CONSTRAINT")}
    return out + [(c.name, rule_id(c), schema_id(s, x), x.id, *codes[c.type], EPOCH, EPOCH, False) for x, c in rules(s)]


def rule_id(c) -> int:
    return sum(ord(ch) * 31**i for i, ch in enumerate(c.name)) % 1_000_000_007


OBJECT = "name:s object_id:i schema_id:i parent_object_id:i type:s type_desc:s create_date:d modify_date:d is_ms_shipped:b"
for _name in ("objects", "all_objects"):
    VIEWS["sys", _name] = (OBJECT, object_rows)
VIEWS["sys", "tables"] = (OBJECT, lambda s: [r for r in object_rows(s) if r[4] == "U"])
for _name in ("views", "all_views"):
    VIEWS["sys", _name] = (OBJECT, lambda s: [r for r in object_rows(s) if r[4] == "V"])
VIEWS["sys", "procedures"] = (OBJECT, lambda s: [r for r in object_rows(s) if r[4] == "P"])
VIEWS["sys", "functions"] = (OBJECT, lambda s: [r for r in object_rows(s) if r[4] in ("FN", "IF")])
VIEWS["sys", "routines"] = (OBJECT, lambda s: [r for r in object_rows(s) if r[4] in ("FN", "IF", "P")])
VIEWS["sys", "sysobjects"] = ("name:s id:i xtype:s uid:i parent_obj:i", lambda s: [(r[0], r[1], r[4], r[2], r[3]) for r in object_rows(s)])


def column_rows(s):
    for x, columns in relations(s):
        for i, c in enumerate(columns):
            number = TYPE_IDS.get(shown_type(c.type), 231)
            size = bytes_of(c.type)
            yield (x.id, c.name, i + 1, number, number, size if size is not None else -1, numbers(c.type)[0] or 0, numbers(c.type)[2] or 0, c.nullable, bool(c.identity), c.computed is not None, "SQL_Latin1_General_CP1_CI_AS" if c.type.is_string else None, *((c.type.length, 0, "float32") if c.type.name == "vector" else (None, None, None)))


COLUMN = "object_id:i name:s column_id:i system_type_id:i user_type_id:i max_length:i precision:i scale:i is_nullable:b is_identity:b is_computed:b collation_name:s vector_dimensions:i vector_base_type:i vector_base_type_desc:s"
for _name in ("columns", "all_columns"):
    VIEWS["sys", _name] = (COLUMN, column_rows)
VIEWS["sys", "view_columns"] = (COLUMN, lambda s: [r for r in column_rows(s) if any(v.id == r[0] for v in s.catalog.views.values())])
VIEWS["sys", "computed_columns"] = (COLUMN, lambda s: [r for r in column_rows(s) if r[10]])


@view("sys", "identity_columns", "object_id:i name:s column_id:i seed_value:l increment_value:l last_value:l")
def _(s):
    return [(x.id, c.name, i + 1, *c.identity, x.next_identity - c.identity[1] if x.next_identity != c.identity[0] else None) for x in tables(s) for i, c in enumerate(x.columns) if c.identity]


@view("sys", "types", "name:s system_type_id:i user_type_id:i schema_id:i is_user_defined:b is_table_type:b")
def _(s):
    own = [(k[1], 231 if x.base is None else TYPE_IDS.get(x.base.name, 231), 257 + i, 1, True, x.columns is not None) for i, (k, x) in enumerate(s.catalog.types.items())]
    return [(n, i, i, 4, False, False) for n, i in TYPE_IDS.items()] + own


@view("sys", "table_types", "name:s user_type_id:i schema_id:i is_table_type:b")
def _(s):
    return [(k[1], 257 + i, 1, True) for i, (k, x) in enumerate(s.catalog.types.items()) if x.columns is not None]


@view("sys", "indexes", "object_id:i name:s index_id:i type:i type_desc:s is_unique:b is_primary_key:b is_unique_constraint:b has_filter:b")
def _(s):
    for x in tables(s):
        for i, (n, _, unique, primary) in enumerate(indexes_of(x)):
            constraint = any(c.name == n and c.type == "unique" for c in x.constraints)
            yield (x.id, n, i + 1, 1 if primary else 2, "CLUSTERED" if primary else "NONCLUSTERED", bool(unique), primary, constraint, False)


@view("sys", "index_columns", "object_id:i index_id:i index_column_id:i column_id:i key_ordinal:i is_descending_key:b is_included_column:b")
def _(s):
    for x in tables(s):
        places = {c.name.lower(): i + 1 for i, c in enumerate(x.columns)}
        for i, (_, columns, _, _) in enumerate(indexes_of(x)):
            for k, c in enumerate(columns):
                yield (x.id, i + 1, k + 1, places.get(c.lower(), 0), k + 1, False, False)


@view("sys", "foreign_keys", "name:s object_id:i schema_id:i parent_object_id:i referenced_object_id:i delete_referential_action_desc:s update_referential_action_desc:s is_disabled:b")
def _(s):
    return [(c.name, rule_id(c), schema_id(s, x), x.id, s.catalog.tables[c.table].id, c.on_delete.upper().replace(" ", "_"), c.on_update.upper().replace(" ", "_"), False) for x, c in rules(s, "foreign") if c.table in s.catalog.tables]


@view("sys", "foreign_key_columns", "constraint_object_id:i constraint_column_id:i parent_object_id:i parent_column_id:i referenced_object_id:i referenced_column_id:i")
def _(s):
    for x, c in rules(s, "foreign"):
        parent = s.catalog.tables.get(c.table)
        place = lambda y, n: next((i + 1 for i, z in enumerate(y.columns) if z.name.lower() == n.lower()), 0)
        for i, (a, b) in enumerate(zip(c.columns, c.target)):
            yield (rule_id(c), i + 1, x.id, place(x, a), parent.id if parent else 0, place(parent, b) if parent else 0)


@view("sys", "key_constraints", "name:s object_id:i schema_id:i parent_object_id:i type:s type_desc:s unique_index_id:i")
def _(s):
    return [(c.name, rule_id(c), schema_id(s, x), x.id, "PK" if c.type == "primary" else "UQ", "PRIMARY_KEY_CONSTRAINT" if c.type == "primary" else "UNIQUE_CONSTRAINT", 1) for x, c in rules(s, "primary", "unique")]


@view("sys", "check_constraints", "name:s object_id:i schema_id:i parent_object_id:i definition:s is_disabled:b")
def _(s):
    return [(c.name, rule_id(c), schema_id(s, x), x.id, c.text, False) for x, c in rules(s, "check")]


@view("sys", "default_constraints", "name:s schema_id:i parent_object_id:i parent_column_id:i definition:s")
def _(s):
    return [(c.default_name or f"DF__{x.name}__{c.name}", schema_id(s, x), x.id, i + 1, f"({c.default.value!r})" if c.default.kind == "lit" else "(...)") for x in tables(s) for i, c in enumerate(x.columns) if c.default is not None]


def parameter_rows(s):
    return [(x.id, p.name, i + 1, TYPE_IDS.get(shown_type(p.type), 231), bytes_of(p.type) or -1, bool(p.output), p.default is not None, bool(p.readonly)) for x in routines(s) for i, p in enumerate(x.node.parameters)]


for _name in ("parameters", "all_parameters"):
    VIEWS["sys", _name] = ("object_id:i name:s parameter_id:i user_type_id:i max_length:i is_output:b has_default_value:b is_readonly:b", parameter_rows)


@view("sys", "triggers", "name:s object_id:i parent_id:i type:s is_disabled:b is_instead_of_trigger:b")
def _(s):
    return [(x.name, x.id, s.table(x.node.table).id, "TR", False, bool(x.node.instead)) for x in s.catalog.triggers.values()]


@view("sys", "trigger_events", "object_id:i type:i type_desc:s")
def _(s):
    codes = {"insert": 1, "update": 2, "delete": 3}
    return [(x.id, codes[e], e.upper()) for x in s.catalog.triggers.values() for e in x.node.events]


def module_rows(s):
    return [(x.id, x.text if isinstance(x, View) else x.node.text, True, True) for x in objects(s) if isinstance(x, View) or getattr(x, "node", None) is not None]


for _name in ("sql_modules", "all_sql_modules"):
    VIEWS["sys", _name] = ("object_id:i definition:s uses_ansi_nulls:b uses_quoted_identifier:b", module_rows)


@view("sys", "sequences", "name:s object_id:i schema_id:i start_value:l increment:l current_value:l")
def _(s):
    return [(x.name, x.id, schema_id(s, x), x.start, x.step, x.start if x.current is None else x.current) for x in s.catalog.sequences.values()]


@view("sys", "synonyms", "name:s schema_id:i base_object_name:s")
def _(s):
    return [(k[1], s.catalog.schemas.get(k[0], 1), ".".join(f"[{p}]" for p in v)) for k, v in s.catalog.synonyms.items()]


@view("sys", "sql_expression_dependencies", "referencing_id:i referenced_schema_name:s referenced_entity_name:s referenced_id:i")
def _(s):
    for v in s.catalog.views.values():
        for p in used_tables(v):
            x = s.catalog.tables.get(s.catalog.resolve(p))
            yield (v.id, s.catalog.key(p)[0], p[-1], x.id if x else None)


@view("sys", "partitions", "partition_id:l object_id:i index_id:i partition_number:i rows:l")
def _(s):
    return [(x.id, x.id, 1, 1, x.df.count()) for x in tables(s)]


@view("sys", "dm_db_partition_stats", "object_id:i index_id:i row_count:l")
def _(s):
    return [(x.id, 1, x.df.count()) for x in tables(s)]


@view("sys", "dm_exec_sessions", "session_id:i login_name:s host_name:s program_name:s status:s open_transaction_count:i")
def _(s):
    return [(x.id, x.login, x.host, x.app, "running", len(x.transactions)) for x in s.engine.sessions.values()]


@view("sys", "dm_exec_requests", "session_id:i status:s command:s database_id:i")
def _(s):
    return [(s.id, "running", "SELECT", 1)]


@view("sys", "dm_exec_connections", "session_id:i net_transport:s auth_scheme:s")
def _(s):
    return [(x.id, "TCP", "SQL") for x in s.engine.sessions.values()]


@view("sys", "server_principals", "name:s principal_id:i type:s type_desc:s")
def _(s):
    return [("sa", 1, "S", "SQL_LOGIN"), ("sysadmin", 3, "R", "SERVER_ROLE")]


@view("sys", "database_principals", "name:s principal_id:i type:s type_desc:s default_schema_name:s")
def _(s):
    return [("dbo", 1, "S", "SQL_USER", "dbo"), ("db_owner", 16384, "R", "DATABASE_ROLE", None)]


@view("sys", "configurations", "configuration_id:i name:s value:i")
def _(s):
    return [(1, "user options", 0), (2, "max degree of parallelism", 0)]


@view("sys", "filegroups", "name:s data_space_id:i type:s")
def _(s):
    return [("PRIMARY", 1, "FG")]


@view("sys", "data_spaces", "name:s data_space_id:i type:s")
def _(s):
    return [("PRIMARY", 1, "FG")]


@view("sys", "system_views", "name:s object_id:i schema_id:i")
def _(s):
    return [(key[1], -i - 1, 4 if key[0] == "sys" else 3) for i, key in enumerate(sorted(VIEWS))]


#: Views that never have rows here, and their columns.
EMPTY = {
    "filetables": "object_id:i is_enabled:b directory_name:s filename_collation_id:i filename_collation_name:s",
    "periods": "name:s period_type:i period_type_desc:s object_id:i start_column_id:i end_column_id:i",
    "xml_indexes": "object_id:i name:s index_id:i type:i type_desc:s is_unique:b using_xml_index_id:i secondary_type:s secondary_type_desc:s xml_index_type:i",
    "xml_schema_collections": "xml_collection_id:i schema_id:i principal_id:i name:s create_date:d modify_date:d",
    "column_encryption_keys": "name:s column_encryption_key_id:i create_date:d modify_date:d",
    "column_master_keys": "name:s column_master_key_id:i create_date:d modify_date:d key_store_provider_name:s key_path:s allow_enclave_computations:b",
    "column_encryption_key_values": "column_encryption_key_id:i column_master_key_id:i encryption_algorithm_name:s",
    "internal_tables": "name:s object_id:i schema_id:i parent_object_id:i type:s type_desc:s create_date:d modify_date:d internal_type:i internal_type_desc:s parent_id:i parent_minor_id:i",
    "partition_functions": "name:s function_id:i type:s type_desc:s fanout:i boundary_value_on_right:b is_system:b create_date:d modify_date:d",
    "partition_parameters": "function_id:i parameter_id:i system_type_id:i max_length:i precision:i scale:i collation_name:s user_type_id:i",
    "partition_schemes": "name:s data_space_id:i type:s type_desc:s is_default:b is_system:b function_id:i",
    "allocation_units": "allocation_unit_id:l type:i type_desc:s container_id:l data_space_id:i total_pages:l used_pages:l data_pages:l",
    "destination_data_spaces": "partition_scheme_id:i destination_id:i data_space_id:i",
    "edge_constraints": "name:s object_id:i principal_id:i schema_id:i parent_object_id:i type:s type_desc:s is_disabled:b is_not_trusted:b delete_referential_action:i",
    "assembly_modules": "object_id:i assembly_id:i assembly_class:s assembly_method:s null_on_null_input:b execute_as_principal_id:i",
    "assembly_types": "name:s system_type_id:i user_type_id:i schema_id:i principal_id:i is_user_defined:b is_assembly_type:b assembly_id:i assembly_class:s",
    "system_sql_modules": "object_id:i definition:s uses_ansi_nulls:b uses_quoted_identifier:b is_schema_bound:b",
    "stats": "object_id:i name:s stats_id:i auto_created:b user_created:b no_recompute:b has_filter:b filter_definition:s is_temporary:b is_incremental:b",
    "stats_columns": "object_id:i stats_id:i stats_column_id:i column_id:i",
    "extended_properties": "class:i class_desc:s major_id:i minor_id:i name:s value:s",
    "dm_os_host_info": "host_platform:s host_distribution:s host_release:s host_service_pack_level:s host_sku:i os_language_version:i",
    "dm_os_sys_info": "cpu_ticks:l ms_ticks:l cpu_count:i hyperthread_ratio:i physical_memory_kb:l committed_kb:l max_workers_count:i scheduler_count:i sqlserver_start_time:d",
    "dm_db_index_usage_stats": "database_id:i object_id:i index_id:i user_seeks:l user_scans:l user_lookups:l user_updates:l last_user_seek:d last_user_scan:d last_user_update:d",
    "dm_db_index_physical_stats": "database_id:i object_id:i index_id:i partition_number:i index_type_desc:s alloc_unit_type_desc:s index_depth:i index_level:i page_count:l record_count:l",
    "server_role_members": "role_principal_id:i member_principal_id:i",
    "availability_replicas": "replica_id:s group_id:s replica_server_name:s endpoint_url:s availability_mode:i availability_mode_desc:s failover_mode:i failover_mode_desc:s",
    "availability_groups": "group_id:s name:s resource_id:s resource_group_id:s failure_condition_level:i health_check_timeout:i",
    "dm_hadr_database_replica_states": "database_id:i group_id:s replica_id:s is_local:b synchronization_state:i synchronization_state_desc:s database_state:i database_state_desc:s",
    "database_mirroring": "database_id:i mirroring_guid:s mirroring_state:i mirroring_state_desc:s mirroring_role:i mirroring_role_desc:s mirroring_partner_name:s",
    "master_files": "database_id:i file_id:i file_guid:s type:i type_desc:s data_space_id:i name:s physical_name:s state:i state_desc:s size:i max_size:i growth:i",
    "database_files": "file_id:i file_guid:s type:i type_desc:s data_space_id:i name:s physical_name:s state:i state_desc:s size:i max_size:i growth:i",
    "database_permissions": "class:i class_desc:s major_id:i minor_id:i grantee_principal_id:i grantor_principal_id:i type:s permission_name:s state:s state_desc:s",
    "database_role_members": "role_principal_id:i member_principal_id:i",
    "change_tracking_tables": "object_id:i is_track_columns_updated_on:b min_valid_version:l begin_version:l cleanup_version:l",
    "fulltext_indexes": "object_id:i unique_index_id:i fulltext_catalog_id:i is_enabled:b change_tracking_state:s change_tracking_state_desc:s has_crawl_completed:b",
    "fulltext_index_columns": "object_id:i column_id:i type_column_id:i language_id:i statistical_semantics:i",
    "fulltext_catalogs": "fulltext_catalog_id:i name:s path:s is_default:b is_accent_sensitivity_on:b data_space_id:i principal_id:i",
}
for _name, _columns in EMPTY.items():
    VIEWS["sys", _name] = (_columns, lambda s: [])

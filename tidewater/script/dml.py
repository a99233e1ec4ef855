"""Changes of data: each makes a new version of its table from DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.catalog import Column, Constraint, Table, View
from tidewater.errors import CHECK_VIOLATION, KEY_VIOLATION, MERGE_CONFLICT, NULL_VIOLATION, TRUNCATED, SqlError
from tidewater.functions.base import Typed, boolean, name
from tidewater.functions.convert import cast
from tidewater.operators.versions import RID
from tidewater.session import Result, Session
from tidewater.tsql import types as t
from tidewater.tsql.ast import Node
from tidewater.tsql.emit import Binder, Env, Rel, Scope, Source

MAX_TRIGGER_DEPTH = 16


@dataclass
class Change:
    """What a statement does to a table: rows that go (old values) and rows that come (new values).

    `updated` has a row for each row that stays but changes, with d_ and i_ columns; `deleted` has d_
    columns, `inserted` i_ columns; each may be None.
    """

    table: Table
    parts: list[str]
    new: DataFrame | None = None
    deltas: list[tuple[str, DataFrame]] = field(default_factory=list)  # (action, d_ and i_ columns)
    next_identity: int | None = None


def owned(s: Session, table: Table) -> Table:
    """The table with row ids: a registered DataFrame is written once before it changes."""
    if RID in table.df.columns:
        return table
    df = s.engine.store.segment(table.df)
    return table.with_(df=df, view=s.engine.view(df), external=False)


def arranged(s: Session, df: DataFrame, columns: list[Column]) -> DataFrame:
    """df with every column of a table, computed ones anew, and its row ids."""
    plain = [c for c in columns if c.computed is None]
    held = df.select(*[F.col(name(c.name)).cast(c.type.spark()).alias(c.name) for c in plain], *([RID] if RID in df.columns else []))
    for c in columns:
        if c.computed is not None:
            scope = Scope([Source("", [(x.name, x.type, name(x.name)) for x in columns if x.computed is None])])
            held = held.withColumn(c.name, F.expr(cast(Binder(s), Binder(s).expr(c.computed, scope, Env()), c.type).sql))
    return held.select(*[name(c.name) for c in columns], *([RID] if RID in df.columns else []))


# rules


def check_rows(s: Session, table: Table, rows: DataFrame) -> DataFrame:
    """Rows that are about to come in: lengths, NULLs and CHECK; CHAR is padded."""
    tests, given = [], rows
    for c in table.columns:
        col = F.col(name(c.name))
        if c.type.length and c.type.is_string:
            tests.append((col.isNotNull() & (F.length(F.rtrim(col)) > c.type.length), f"String or binary data would be truncated in table '{table.name}', column '{c.name}'.", TRUNCATED))
            if c.type.name in ("char", "nchar"):
                rows = rows.withColumn(c.name, F.rpad(col, c.type.length, " "))
        if not c.nullable and c.computed is None:
            tests.append((col.isNull(), f"Cannot insert the value NULL into column '{c.name}', table '{table.name}'; column does not allow nulls. INSERT fails.", NULL_VIOLATION))
        if c.type.name == "tinyint":
            tests.append((~col.between(0, 255), "Arithmetic overflow error for data type tinyint.", 220))
    for rule in table.constraints:
        if rule.type == "check":
            tests.append((~F.coalesce(F.expr(check_sql(s, table, rule)), F.lit(True)), f"The INSERT or UPDATE statement conflicted with the CHECK constraint \"{rule.name}\".", CHECK_VIOLATION))
    if tests:
        hits = given.agg(*[F.coalesce(F.max(F.when(test, 1)), F.lit(0)).alias(f"t{i}") for i, (test, _, _) in enumerate(tests)])
        found = s.collect(hits)[0]
        for i, (_, message, number) in enumerate(tests):
            if found[i]:
                raise SqlError(message, number)
    return rows


def check_sql(s: Session, table: Table, rule: Constraint) -> str:
    scope = Scope([Source(table.name, [(c.name, c.type, name(c.name)) for c in table.columns])])
    return boolean(Binder(s).expr(rule.expr, scope, Env()))


def check_unique(table: Table, rule: Constraint, df: DataFrame, rows: DataFrame | None) -> None:
    """No two rows agree in all key columns; NULL keys don't count, but for a primary key's, which can't be."""
    keys = [name(table.column(c).name) for c in rule.columns]
    known = df if rows is None else df.join(rows.select(*keys).distinct(), [k.strip("`") for k in keys], "left_semi")
    known = known.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    if known.groupBy(*keys).count().where("count > 1").take(1):
        raise SqlError(f"Violation of {'PRIMARY' if rule.type == 'primary' else 'UNIQUE'} KEY constraint '{rule.name}'. Cannot insert duplicate key in object '{table.schema}.{table.name}'.", KEY_VIOLATION)


def check_rule(s: Session, table: Table, rule: Constraint, df: DataFrame, rows: DataFrame | None) -> None:
    if rule.type in ("primary", "unique", "unique_index"):
        check_unique(table, rule, df, rows)
    elif rule.type == "check":
        if df.where(f"NOT coalesce({check_sql(s, table, rule)}, TRUE)").take(1):
            raise SqlError(f"The ALTER TABLE statement conflicted with the CHECK constraint \"{rule.name}\".", CHECK_VIOLATION)
    elif rule.type == "foreign":
        check_parent(s, table, rule, rows if rows is not None else df)


def check_parent(s: Session, table: Table, rule: Constraint, rows: DataFrame) -> None:
    """Every row's key is in the parent; a key with a NULL is let through."""
    parent = s.catalog.tables.get(rule.table)
    if parent is None:
        return
    own = rows.select(*[F.col(name(table.column(c).name)).alias(f"k{i}") for i, c in enumerate(rule.columns)]).dropna().distinct()
    held = parent.df if parent is not table else table.df
    other = held.select(*[F.col(name(c)).alias(f"k{i}") for i, c in enumerate(rule.target)])
    if own.join(other, [f"k{i}" for i in range(len(rule.columns))], "left_anti").take(1):
        raise SqlError(f"The INSERT or UPDATE statement conflicted with the FOREIGN KEY constraint \"{rule.name}\".", CHECK_VIOLATION)


def children(s: Session, table: Table):
    key = (table.schema.lower(), table.name.lower())
    for child_key, child in list(s.catalog.tables.items()):
        for rule in child.constraints:
            if rule.type == "foreign" and rule.table == key:
                yield child_key, child, rule


def keep_references(s: Session, table: Table, lost: DataFrame, action: str, moved: DataFrame | None = None) -> None:
    """What happens to rows that refer to keys that are no longer there (lost: d_ columns; moved: with i_ ones)."""
    for key, child, rule in children(s, table):
        keys = [f"k{i}" for i in range(len(rule.columns))]
        gone = lost.select(*[F.col(name(f"d_{table.column(c).name}")).alias(k) for k, c in zip(keys, rule.target)]).dropna().distinct()
        now = s.catalog.tables[rule.table].df.select(*[F.col(name(c)).alias(k) for k, c in zip(keys, rule.target)])
        gone = s.engine.store.write(gone.join(now, keys, "left_anti"))
        child = s.catalog.tables[key]
        child = owned(s, child)
        marked = child.df
        for k, c in zip(keys, rule.columns):
            marked = marked.withColumn(k, F.col(name(child.column(c).name)))
        hit = marked.join(gone, keys, "left_semi")
        if not hit.take(1):
            continue
        how = rule.on_delete if action == "delete" else rule.on_update
        parts = [key[0], key[1]]
        if how == "no action":
            raise SqlError(f"The {action.upper()} statement conflicted with the REFERENCE constraint \"{rule.name}\".", CHECK_VIOLATION)
        s.catalog.tables[key] = child
        if how == "cascade" and action == "delete":
            delete_rows(s, parts, child, hit.select(RID))
            continue
        values = {}
        if how == "cascade":
            pairs = moved.select(*[F.col(name(f"d_{table.column(c).name}")).alias(k) for k, c in zip(keys, rule.target)], *[F.col(name(f"i_{table.column(c).name}")).alias(f"n{k}") for k, c in zip(keys, rule.target)])
            new = marked.join(gone, keys, "left_semi").join(pairs, keys).select(RID, *[F.col(f"n{k}").alias(f"n_{child.column(c).name}") for k, c in zip(keys, rule.columns)])
        else:
            for c in rule.columns:
                column = child.column(c)
                values[column.name] = F.lit(None) if how == "set null" or column.default is None else F.expr(Binder(s).expr(column.default, Scope(), Env()).sql)
            new = hit.select(RID, *[v.cast(child.column(c).type.spark()).alias(f"n_{c}") for c, v in values.items()])
        update_rows(s, parts, child, s.engine.store.write(new), [child.column(c).name for c in rule.columns])


# versions


def append(s: Session, table: Table, rows: DataFrame) -> tuple[Table, DataFrame]:
    """The table with a new segment of rows, and the segment."""
    segment = s.engine.store.segment(rows)
    df = table.df.select(*[name(c.name) for c in table.columns], RID).unionByName(segment.select(*[name(c.name) for c in table.columns], RID))
    if table.version % 48 == 47:  # many small segments become one
        df = s.engine.store.segment(df)
    return table.with_(df=df, view=s.engine.view(df)), segment


def delete_rows(s: Session, parts: list[str], table: Table, rids: DataFrame) -> DataFrame:
    """Deletes by row id; returns the old rows as d_ columns."""
    rids = s.engine.store.write(rids.distinct())
    lost = s.engine.store.write(table.df.join(rids, RID, "left_semi").select(*[F.col(name(c.name)).alias(f"d_{c.name}") for c in table.columns]))
    df = s.engine.store.write(table.df.join(rids, RID, "left_anti").select(*[name(c.name) for c in table.columns], RID))
    s.replace(parts, table.with_(df=df, view=s.engine.view(df)))
    if not parts[-1].startswith(("#", "@")):
        keep_references(s, table, lost, "delete")
    return lost


def update_rows(s: Session, parts: list[str], table: Table, new: DataFrame, columns: list[str]) -> DataFrame:
    """Sets columns by row id (new: a row id and n_ columns); returns old and new rows as d_ and i_ columns."""
    low = {c.lower() for c in columns}
    plain = [c for c in table.columns if c.computed is None]
    changed = table.df.join(new, RID).select(RID, *[F.col(name(c.name)).alias(f"d_{c.name}") for c in table.columns], *[(F.col(name(f"n_{c.name}")) if c.name.lower() in low else F.col(name(c.name))).alias(f"p_{c.name}") for c in plain])
    changed = s.engine.store.write(changed)
    after = arranged(s, changed.select(RID, *[F.col(name(f"p_{c.name}")).alias(c.name) for c in plain]), table.columns)
    after = s.engine.store.write(check_rows(s, table, after))
    rest = table.df.join(changed.select(RID), RID, "left_anti").select(*[name(c.name) for c in table.columns], RID)
    df = s.engine.store.write(rest.unionByName(after))
    fresh = table.with_(df=df, view=s.engine.view(df))
    for rule in table.constraints:
        if rule.type != "check" and {c.lower() for c in rule.columns} & low:
            check_rule(s, fresh, rule, df, after)
    both = changed.select(RID, *[name(f"d_{c.name}") for c in table.columns]).join(after.select(RID, *[F.col(name(c.name)).alias(f"i_{c.name}") for c in table.columns]), RID).drop(RID)
    both = s.engine.store.write(both)
    s.replace(parts, fresh)
    if not parts[-1].startswith(("#", "@")):
        keys = {c.lower() for _, _, rule in children(s, table) for c in rule.target}
        if keys & low:
            keep_references(s, table, both, "update", both)
    return both


# OUTPUT and triggers


def returned(s: Session, node: Node, table: Table, deltas: list[tuple[str, DataFrame]], extra: list[Source] = ()) -> Result | None:
    """The rows of an OUTPUT clause, or None if they went into a table."""
    if node.output is None:
        return None
    frames = []
    for action, df in deltas:
        for c in table.columns:
            for prefix in ("d_", "i_"):
                if f"{prefix}{c.name}" not in df.columns:
                    df = df.withColumn(f"{prefix}{c.name}", F.lit(None).cast(c.type.spark()))
        frames.append(df.withColumn("_action", F.lit(action)))
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    view = s.engine.view(whole)
    scope = Scope([Source(which, [(c.name, c.type, name(f"{p}{c.name}")) for c in table.columns]) for which, p in (("deleted", "d_"), ("inserted", "i_"))] + [x for x in extra])
    scope.sources.append(Source("", [("$action", t.NVARCHAR, "_action")]))
    binder, shown, columns = Binder(s), [], []
    from tidewater.tsql.emit import label

    for item in node.output:
        if item.expr.kind == "star":
            for c, e in binder.star(item.expr, scope):
                shown.append(f"{e} AS {name(c)}")
                columns.append((c, e.type))
        else:
            e = binder.expr(item.expr, scope, Env())
            columns.append((item.alias or label(item.expr), e.type))
            shown.append(f"{e} AS {name(columns[-1][0])}")
    df = s.run(f"SELECT {', '.join(shown)} FROM {name(view)}")
    if node.output_into is not None:
        insert_frame(s, node.output_into, df, [k for _, k in columns], node.output_columns)
        return None
    names = [f"_{i}" for i in range(len(columns))]
    held = s.engine.store.write(df.toDF(*names))
    return Result(held.toDF(*[c for c, _ in columns]), columns)


def triggers_of(s: Session, table: Table, event: str, instead: bool):
    key = (table.schema.lower(), table.name.lower())
    for trigger in list(s.catalog.triggers.values()):
        if s.catalog.resolve(trigger.node.table) == key and event in trigger.node.events and bool(trigger.node.instead) == instead:
            yield trigger


def fire(interp, table: Table, event: str, deltas: list[tuple[str, DataFrame]], instead: bool = False) -> bool:
    """Runs the triggers of an event; tells whether there were any."""
    s, ran = interp.s, False
    for trigger in triggers_of(s, table, event, instead):
        if len(s.changed) >= MAX_TRIGGER_DEPTH:
            raise SqlError("Maximum trigger nesting level exceeded.", 217)
        if instead and any(x.get("") == trigger.id for x in s.changed):
            continue
        ran = True
        held = {"": trigger.id}
        for which, p in (("deleted", "d_"), ("inserted", "i_")):
            frames = [df.select(*[F.col(name(f"{p}{c.name}")).cast(c.type.spark()).alias(c.name) for c in table.columns]) for _, df in deltas if f"{p}{table.columns[0].name}" in df.columns]
            whole = frames[0] if frames else s.empty(table.columns).drop(RID)
            for f in frames[1:]:
                whole = whole.unionByName(f)
            held[which] = s.make_table("dbo", which, table.columns, whole)
        s.changed.append(held)
        interp.enter()
        s.scopes.append({"": "procedure"})
        try:
            from tidewater.script.interp import Return

            try:
                interp.run(trigger.node.body)
            except Return:
                pass
        finally:
            s.scopes.pop()
            s.nesting -= 1
            s.changed.pop()
    return ran


def visible(s: Session, key: str) -> bool:
    return key in s.changed[-1] if s.changed else False


# INSERT


def targets_of(s: Session, table: Table, parts: list[str], columns: list[str] | None) -> list[Column]:
    explicit = s.catalog.resolve(parts) in s.identity_insert if not parts[-1].startswith(("#", "@")) else parts[-1].lower() in {k[1] for k in s.identity_insert}
    if columns is None:
        return [c for c in table.columns if c.computed is None and (c.identity is None or explicit)]
    out = [table.column(c) for c in columns]
    for c in out:
        if c.computed is not None:
            raise SqlError(f"The column \"{c.name}\" cannot be modified because it is either a computed column or is the result of a UNION operator.", 271)
        if c.identity is not None and not explicit:
            raise SqlError(f"Cannot insert explicit value for identity column in table '{table.name}' when IDENTITY_INSERT is set to OFF.", 544)
    return out


def full_rows(s: Session, table: Table, targets: list[Column], df: DataFrame, kinds: list[t.Type]) -> tuple[DataFrame, int | None]:
    """df's columns, by position, as rows of the table; the next identity value."""
    df = df.toDF(*[f"_v{i}" for i in range(len(targets))])
    given = {c.name.lower(): cast(Binder(s), Typed(f"_v{i}", k), t.unbounded(c.type)).sql for i, (c, k) in enumerate(zip(targets, kinds))}
    given = {n: f"CAST({sql} AS {table.column(n).type.spark()})" for n, sql in given.items()}
    next_identity = table.next_identity
    identity = next((c for c in table.columns if c.identity), None)
    if identity is not None and identity.name.lower() not in given:
        df, total = s.engine.store.numbered(df, next_identity, identity.identity[1], "_identity")
        given[identity.name.lower()] = f"CAST(_identity AS {identity.type.spark()})"
        next_identity += total * identity.identity[1]
        s.identity = next_identity - identity.identity[1] if total else s.identity
    binder = Binder(s)
    shown = []
    for c in table.columns:
        if c.computed is not None:
            continue
        if c.name.lower() in given:
            sql = given[c.name.lower()]
        elif c.default is not None:
            sql = cast(binder, binder.expr(c.default, Scope(), Env()), c.type).sql
        else:
            sql = f"CAST(NULL AS {c.type.spark()})"
        shown.append(F.expr(sql).alias(c.name))
    rows = arranged(s, df.select(*shown), table.columns)
    if identity is not None and any(c is identity for c in targets):
        top = s.collect(rows.agg(F.max(name(identity.name))))[0][0]
        if top is not None:
            next_identity = max(next_identity, int(top) + identity.identity[1])
            s.identity = int(top)
    return rows, next_identity


def store_rows(s: Session, parts: list[str], table: Table, rows: DataFrame, next_identity: int | None) -> DataFrame:
    """Adds checked rows; returns them as i_ columns."""
    rows = s.engine.store.write(check_rows(s, table, rows))
    new, segment = append(s, table, rows)
    new = new.with_(next_identity=next_identity)
    for rule in table.constraints:
        if rule.type != "check":
            if rule.type == "foreign" and rule.table == (table.schema.lower(), table.name.lower()):
                before = s.catalog.tables.get(rule.table)
                s.catalog.tables[rule.table] = new
                try:
                    check_parent(s, new, rule, rows)
                finally:
                    if before is not None:
                        s.catalog.tables[rule.table] = before
            else:
                check_rule(s, new, rule, new.df, rows)
    s.replace(parts, new)
    return segment.select(*[F.col(name(c.name)).alias(f"i_{c.name}") for c in table.columns])


def insert_frame(s: Session, parts: list[str], df: DataFrame, kinds: list[t.Type], columns: list[str] | None = None) -> int:
    """Appends a DataFrame's columns, by position."""
    table = owned(s, s.table(parts))
    targets = targets_of(s, table, parts, columns)
    if len(targets) != len(kinds):
        raise SqlError("Column name or number of supplied values does not match table definition.", 213)
    rows, next_identity = full_rows(s, table, targets, df, kinds)
    return store_rows(s, parts, table, rows, next_identity).count()


def insert(interp, node: Node) -> Result:
    s = interp.s
    found = s.find(node.target)
    if isinstance(found, View):
        node = node.copy(target=base_of(s, found))
    table = owned(s, s.table(node.target))
    targets = targets_of(s, table, node.target, node.columns)
    binder = Binder(s)
    if node.default_values:
        targets, kinds, df = [], [], s.spark.range(1).select()
        df = s.spark.range(1).drop("id")
    elif node.rows is not None:
        rows = []
        for row in node.rows:
            if len(row) != len(targets):
                raise SqlError("Column name or number of supplied values does not match table definition.", 213)
            cells = []
            for e, c in zip(row, targets):
                if e.kind == "default":
                    e = c.default if c.default is not None else Node("lit", value=None, type="null")
                cells.append(cast(binder, binder.expr(e, Scope(), Env()), t.unbounded(c.type)))
            rows.append(cells)
        kinds = [t.unbounded(c.type) for c in targets]
        listed = ", ".join("(" + ", ".join(f"CAST({x} AS {k.spark()})" for x, k in zip(r, kinds)) + ")" for r in rows)
        plain = all(" (SELECT" not in str(x) and "EXISTS (" not in str(x) for r in rows for x in r)
        df = s.run(f"SELECT * FROM (VALUES {listed})" if plain else " UNION ALL ".join("SELECT " + ", ".join(f"CAST({x} AS {k.spark()}) AS v{i}" for i, (x, k) in enumerate(zip(r, kinds))) for r in rows))
        df = df.coalesce(1)  # a statement's own rows are few, and come out in their order
    elif node.exec is not None:
        before = len(interp.out)
        interp.statement(node.exec)
        results, interp.out[before:] = interp.out[before:], []
        frames = [r for r in results if r.df is not None]
        if not frames:
            return Result(count=0)
        df, kinds = frames[0].df, [k for _, k in frames[0].columns]
        for r in frames[1:]:
            df = df.union(r.df)
    else:
        query = Node("with", ctes=node.ctes, query=node.query) if node.ctes else node.query
        df, rel = s.frame(query)
        kinds = [k for _, k in rel.columns]
    if len(targets) != len(kinds):
        raise SqlError("Column name or number of supplied values does not match table definition.", 213)
    if node.top is not None:
        df = df.limit(int(s.evaluate(node.top)))
    if s.options["rowcount"]:
        df = df.limit(s.options["rowcount"])
    if not targets:
        df = s.spark.range(1).drop("id")
    rows, next_identity = full_rows(s, table, targets, df, kinds)
    if any(triggers_of(s, table, "insert", True)) and not s.changed:
        delta = [("INSERT", s.engine.store.write(rows).select(*[F.col(name(c.name)).alias(f"i_{c.name}") for c in table.columns]))]
        fire(interp, table, "insert", delta, instead=True)
        s._rows = delta[0][1].count()
        return Result(count=s._rows)
    delta = [("INSERT", store_rows(s, node.target, table, rows, next_identity))]
    shown = returned(s, node, table, delta)
    s._rows = delta[0][1].count()
    fire(interp, table, "insert", delta)
    return shown or Result(count=s._rows)


def select_into(s: Session, target: list[str], df: DataFrame, rel: Rel) -> int:
    columns = [Column(c, k if k.name != "null" else t.INT) for c, k in rel.columns]
    low = target[-1].lower()
    key = s.catalog.key(target)
    if not low.startswith("#"):
        s.catalog.free(key)
    held = s.engine.store.segment(df.select(*[F.col(name(c.name)).cast(c.type.spark()).alias(c.name) for c in columns]))
    table = s.make_table(key[0], target[-1], columns, held)
    if low.startswith("#"):
        s.temps[low] = table
    else:
        s.catalog.tables[key] = table
    return held.count()


def base_of(s: Session, view: View) -> list[str]:
    """The one table that a view's rows come from."""
    q = view.query
    if q.kind != "select" or q.from_ is None or q.from_.kind != "table" or q.group or q.distinct:
        raise SqlError(f"View or function '{view.name}' is not updatable because the modification affects multiple base tables.", 4405)
    return q.from_.parts


# UPDATE and DELETE


def aliased(s: Session, node: Node) -> tuple[list[str], str | None]:
    """The table that a statement changes, and its alias if FROM names it."""
    if node.from_ is not None:
        from tidewater.tsql.ast import walk

        for n in walk(node.from_):
            if n.kind == "table" and len(node.target) == 1 and (n.alias or "").lower() == node.target[0].lower():
                return n.parts, n.alias
        for n in walk(node.from_):
            if n.kind == "table" and s.catalog.key(n.parts) == s.catalog.key(node.target):
                return n.parts, n.alias or n.parts[-1]
    found = s.find(node.target)
    if isinstance(found, View):
        return base_of(s, found), None
    return node.target, None


def matched(s: Session, node: Node, table: Table, parts: list[str], alias: str | None, shown) -> str:
    """SQL for the row ids that FROM and WHERE choose, and what `shown` adds."""
    env, binder = Env(), Binder(s)
    if node.ctes:
        raise SqlError("A common table expression before UPDATE or DELETE must be used in its FROM clause.", 102)
    if node.from_ is not None:
        scope = Scope()
        sql = binder.source(node.from_, scope, env)
        label = alias or parts[-1]
        if alias is None:
            scope.sources.append(Source(label, [(c.name, c.type, f"{name(label)}.{name(c.name)}") for c in table.columns]))
            sql = f"{name(table.view)} AS {name(label)} CROSS JOIN {sql}"
        rid = f"{name(label)}.{RID}"
    else:
        label = parts[-1]
        scope = Scope([Source(label, [(c.name, c.type, f"{name(label)}.{name(c.name)}") for c in table.columns])])
        sql, rid = f"{name(table.view)} AS {name(label)}", f"{name(label)}.{RID}"
    where = f" WHERE {boolean(binder.expr(node.where, scope, env))}" if node.where is not None else ""
    top = int(s.evaluate(node.top)) if node.top is not None else s.options["rowcount"] or None
    limit = f" LIMIT {top}" if top else ""
    extra = "".join(f", {e}" for e in shown(binder, scope, env))
    return f"SELECT {rid} AS {RID}{extra} FROM {sql}{where}{limit}"


def with_ctes(s: Session, node: Node) -> Node:
    """FROM items that name a common table expression become derived tables."""
    if not node.ctes:
        return node
    from tidewater.tsql.ast import rebuild

    known = {c.name.lower(): c for c in node.ctes}

    def change(n: Node):
        if n.kind == "table" and len(n.parts) == 1 and n.parts[0].lower() in known:
            c = known[n.parts[0].lower()]
            return Node("derived", query=rebuild(c.query, change), alias=n.alias or n.parts[0], columns=c.columns)
        return None

    return Node(node.kind, **{k: rebuild(v, change) for k, v in node.__dict__.items() if k not in ("kind", "ctes", "target")}, target=node.target)


def plain_change(s: Session, node: Node, table: Table, parts: list[str], event: str, columns: set[str]) -> bool:
    """Whether a statement changes rows by themselves alone: one projection or filter of the table does it, without a join."""
    from tidewater.tsql.ast import walk

    if node.from_ is not None or node.top is not None or node.output is not None or s.options["rowcount"]:
        return False
    if any(n.kind in ("subquery", "exists", "quantified", "nextval") or n.query is not None for x in [node.where, *(node.sets or [])] if x is not None for n in walk(x)):
        return False
    if any(x.variable for x in node.sets or []) or any(triggers_of(s, table, event, True)) or any(triggers_of(s, table, event, False)):
        return False
    if not parts[-1].startswith(("#", "@")) and any(event == "delete" or {c.lower() for c in rule.target} & columns for _, _, rule in children(s, table)):
        return False
    return not any(rule.type != "check" and {c.lower() for c in rule.columns} & columns for rule in table.constraints)


def plain_update(s: Session, node: Node, table: Table, parts: list[str], sets: list) -> int:
    binder, label = Binder(s), parts[-1]
    scope = Scope([Source(label, [(c.name, c.type, f"{name(label)}.{name(c.name)}") for c in table.columns])])
    hit = boolean(binder.expr(node.where, scope, Env())) if node.where is not None else "TRUE"
    new = {}
    for c, x in sets:
        expr = (c.default if c.default is not None else Node("lit", value=None, type="null")) if x.expr.kind == "default" else x.expr
        e = binder.expr(expr, scope, Env())
        if x.op != "=":
            e = binder.arithmetic(x.op[0], scope.find([label, c.name]), e)
        new[c.name] = f"CASE WHEN {hit} THEN CAST({cast(binder, e, t.unbounded(c.type))} AS {c.type.spark()}) ELSE {name(label)}.{name(c.name)} END"
    shown = ", ".join(f"{new.get(c.name, f'{name(label)}.{name(c.name)}')} AS {name(c.name)}" for c in table.columns if c.computed is None)
    source = f"FROM {name(table.view)} AS {name(label)}"
    rows = s.run(f"SELECT {shown}, {name(label)}.{RID} AS {RID} {source}")
    check_rows(s, table, arranged(s, s.run(f"SELECT {shown}, {name(label)}.{RID} AS {RID} {source} WHERE {hit}"), table.columns))
    for c, _ in sets:
        if c.type.name in ("char", "nchar") and c.type.length:
            rows = rows.withColumn(c.name, F.rpad(F.col(name(c.name)), c.type.length, " "))
    df = s.engine.store.write(arranged(s, rows, table.columns))
    s.replace(parts, table.with_(df=df, view=s.engine.view(df)))
    return int(s.scalar(f"SELECT count(*) {source} WHERE {hit}"))


def plain_delete(s: Session, node: Node, table: Table, parts: list[str]) -> int:
    label = parts[-1]
    scope = Scope([Source(label, [(c.name, c.type, f"{name(label)}.{name(c.name)}") for c in table.columns])])
    hit = boolean(Binder(s).expr(node.where, scope, Env())) if node.where is not None else "TRUE"
    source = f"FROM {name(table.view)} AS {name(label)}"
    df = s.engine.store.write(s.run(f"SELECT * {source} WHERE NOT coalesce({hit}, FALSE)"))
    gone = int(s.scalar(f"SELECT count(*) {source} WHERE {hit}"))
    s.replace(parts, table.with_(df=df, view=s.engine.view(df)))
    return gone


def update(interp, node: Node) -> Result:
    s = interp.s
    node = with_ctes(s, node)
    parts, alias = aliased(s, node)
    table = owned(s, s.table(parts))
    s.replace(parts, table)
    if node.current_of:
        raise SqlError("WHERE CURRENT OF is not supported.", 102)
    sets = [(table.column(x.column), x) for x in node.sets if x.column]
    for c, _ in sets:
        if c.computed is not None:
            raise SqlError(f"The column \"{c.name}\" cannot be modified because it is either a computed column or is the result of a UNION operator.", 271)
        if c.identity:
            raise SqlError(f"Cannot update identity column '{c.name}'.", 8102)
    if alias is None and plain_change(s, node, table, parts, "update", {c.name.lower() for c, _ in sets}):
        s._rows = plain_update(s, node, table, parts, sets)
        return Result(count=s._rows)

    def shown(binder, scope, env):
        label = alias or parts[-1]
        for c, x in sets:
            expr = x.expr
            if expr.kind == "default":
                expr = c.default if c.default is not None else Node("lit", value=None, type="null")
            e = binder.expr(expr, scope, env)
            if x.op != "=":
                e = binder.arithmetic(x.op[0], scope.find([label, c.name]), e)
            e = cast(binder, e, t.unbounded(c.type))
            yield f"CAST({e} AS {c.type.spark()}) AS {name(f'n_{c.name}')}"

    new = s.run(matched(s, node, table, parts, alias, shown))
    if node.from_ is not None:
        new = new.dropDuplicates([RID])
    new = s.engine.store.write(new)
    if any(triggers_of(s, table, "update", True)) and not s.changed:
        after = table.df.join(new, RID).select(*[F.col(name(c.name)).alias(f"d_{c.name}") for c in table.columns], *[(F.col(name(f"n_{c.name}")) if any(x is c for x, _ in sets) else F.col(name(c.name))).alias(f"i_{c.name}") for c in table.columns])
        fire(interp, table, "update", [("UPDATE", s.engine.store.write(after))], instead=True)
        s._rows = new.count()
        return Result(count=s._rows)
    delta = [("UPDATE", update_rows(s, parts, table, new, [c.name for c, _ in sets]))]
    for x in node.sets:
        if x.variable:
            view = s.engine.view(delta[0][1])
            scope = Scope([Source(parts[-1], [(c.name, c.type, name(f"d_{c.name}")) for c in table.columns])])
            last = s.run(f"SELECT {cast(Binder(s), Binder(s).expr(x.expr, scope, Env()), s.variable_type(x.variable))} FROM {name(view)}").tail(1)
            if last:
                s.set_variable(x.variable, last[0][0])
    shown_rows = returned(s, node, table, delta)
    s._rows = delta[0][1].count()
    fire(interp, table, "update", delta)
    return shown_rows or Result(count=s._rows)


def delete(interp, node: Node) -> Result:
    s = interp.s
    node = with_ctes(s, node)
    parts, alias = aliased(s, node)
    table = owned(s, s.table(parts))
    s.replace(parts, table)
    if alias is None and plain_change(s, node, table, parts, "delete", set()):
        s._rows = plain_delete(s, node, table, parts)
        return Result(count=s._rows)
    rids = s.run(matched(s, node, table, parts, alias, lambda *a: ()))
    if any(triggers_of(s, table, "delete", True)) and not s.changed:
        lost = table.df.join(rids.distinct(), RID, "left_semi").select(*[F.col(name(c.name)).alias(f"d_{c.name}") for c in table.columns])
        lost = s.engine.store.write(lost)
        fire(interp, table, "delete", [("DELETE", lost)], instead=True)
        s._rows = lost.count()
        return Result(count=s._rows)
    delta = [("DELETE", delete_rows(s, parts, table, rids))]
    shown = returned(s, node, table, delta)
    s._rows = delta[0][1].count()
    fire(interp, table, "delete", delta)
    return shown or Result(count=s._rows)


def truncate(interp, node: Node) -> None:
    s = interp.s
    table = s.table(node.target)
    if any(True for _ in children(s, table)):
        raise SqlError(f"Cannot truncate table '{table.name}' because it is being referenced by a FOREIGN KEY constraint.", 4712)
    identity = next((c.identity for c in table.columns if c.identity), None)
    df = s.empty(table.columns)
    s.replace(node.target, table.with_(df=df, view=s.engine.view(df), next_identity=identity[0] if identity else None, external=False))


# MERGE


def plain_merge(s: Session, node: Node, table: Table, parts: list[str]) -> bool:
    """Whether a MERGE's new version can be made in one pass: nothing but row rules looks at what it changes."""
    if node.output is not None or any(c.identity for c in table.columns) or any(rule.type != "check" for rule in table.constraints):
        return False
    if any(any(triggers_of(s, table, event, instead)) for event in ("insert", "update", "delete") for instead in (True, False)):
        return False
    return parts[-1].startswith(("#", "@")) or not any(True for _ in children(s, table))


def merge_at_once(s: Session, node: Node, table: Table, parts: list[str], whole: DataFrame, both: Scope, label: str) -> int:
    """The new version from the joined rows: each keeps, changes, drops or adds a row of the table."""
    binder = Binder(s)
    branches: dict[str, list[str]] = {c.name: [] for c in table.columns if c.computed is None}
    for i, c in enumerate(node.clauses):
        if c.action == "update":
            pairs = [(table.column(x.column), x.expr, x.op) for x in c.sets]
        elif c.action == "insert":
            targets = targets_of(s, table, parts, c.columns)
            if len(c.values or []) != len(targets):
                raise SqlError("Column name or number of supplied values does not match table definition.", 213)
            given = dict(zip((x.name for x in targets), c.values))
            default = lambda x: x.default if x.default is not None else Node("lit", value=None, type="null")
            pairs = [(x, given.get(x.name, default(x)), "=") for x in table.columns if x.computed is None]
        else:
            continue
        for column, expr, op in pairs:
            if expr.kind == "default":
                expr = column.default if column.default is not None else Node("lit", value=None, type="null")
            e = binder.expr(expr, both, Env())
            if op != "=":
                e = binder.arithmetic(op[0], both.find([label, column.name]), e)
            branches[column.name].append(f"WHEN _clause = {i} THEN CAST({cast(binder, e, t.unbounded(column.type))} AS {column.type.spark()})")
    doomed = [i for i, c in enumerate(node.clauses) if c.action == "delete"]
    stays = whole.where(F.col(RID).isNotNull() | F.col("_clause").isNotNull())
    if doomed:
        stays = stays.where(f"NOT coalesce(_clause IN ({', '.join(map(str, doomed))}), FALSE)")
    cells = [F.expr(f"CASE {' '.join(b)} ELSE {name(f'd_{c}')} END" if b else name(f"d_{c}")).alias(c) for c, b in branches.items()]
    changed = stays.where("_clause IS NOT NULL").select(*cells)
    check_rows(s, table, arranged(s, changed, table.columns))
    rows = arranged(s, stays.select(*cells), table.columns)
    for c in table.columns:
        if c.type.name in ("char", "nchar") and c.type.length:
            rows = rows.withColumn(c.name, F.rpad(F.col(name(c.name)), c.type.length, " "))
    df = s.engine.store.segment(rows)
    s.replace(parts, table.with_(df=df, view=s.engine.view(df)))
    return whole.where("_clause IS NOT NULL").count()


def merge(interp, node: Node) -> Result:
    """One full outer join of target and source; each row's first fitting clause decides."""
    s = interp.s
    node = with_ctes(s, node)
    parts = node.target
    table = owned(s, s.table(parts))
    s.replace(parts, table)
    binder, label = Binder(s), node.alias or parts[-1]
    scope = Scope()
    source_sql = binder.source(node.source, scope, Env())
    sources = list(scope.sources)
    flat, shown = [], []
    for src in sources:
        mine = []
        for c, kind, ref in src.columns:
            held = f"s_{len(shown)}"
            shown.append(f"{ref} AS {held}")
            mine.append((c, kind, held))
        flat.append(Source(src.alias, mine))
    source = s.run(f"SELECT {', '.join(shown)}, TRUE AS _source FROM {source_sql}")
    target = table.df.select(RID, *[F.col(name(c.name)).alias(f"d_{c.name}") for c in table.columns])
    own = Source(label, [(c.name, c.type, name(f"d_{c.name}")) for c in table.columns])
    both = Scope([own, *flat])
    on = F.expr(boolean(binder.expr(node.on, both, Env())))
    joined = target.join(source, on, "full")
    is_target, is_source = f"{RID} IS NOT NULL", "_source IS NOT NULL"
    when = {"matched": f"{is_target} AND {is_source}", "target": f"{RID} IS NULL", "source": "_source IS NULL"}
    tests = []
    for i, c in enumerate(node.clauses):
        test = when[c.when] + (f" AND {boolean(binder.expr(c.test, both, Env()))}" if c.test is not None else "")
        tests.append(f"WHEN {test} THEN {i}")
    whole = s.engine.store.write(joined.withColumn("_clause", F.expr(f"CASE {' '.join(tests)} END")))
    decided = whole.where("_clause IS NOT NULL")
    changing = [i for i, c in enumerate(node.clauses) if c.action != "insert"]
    if plain_merge(s, node, table, parts) and not whole.where(F.col(RID).isNotNull()).groupBy(RID).count().where("count > 1").take(1):
        s._rows = merge_at_once(s, node, table, parts, whole, both, label)
        return Result(count=s._rows)
    if changing and decided.where(F.col("_clause").isin(changing) & F.col(RID).isNotNull()).groupBy(RID).count().where("count > 1").take(1):
        raise SqlError("The MERGE statement attempted to UPDATE or DELETE the same row more than once.", MERGE_CONFLICT)
    deltas, extra_columns = [], [c for src in flat for _, _, c in src.columns]
    doomed = [i for i, c in enumerate(node.clauses) if c.action == "delete"]
    updates = [(i, c) for i, c in enumerate(node.clauses) if c.action == "update"]
    inserts = [(i, c) for i, c in enumerate(node.clauses) if c.action == "insert"]
    if updates:
        columns = list({table.column(x.column).name: None for _, c in updates for x in c.sets})
        cells = []
        for column in columns:
            branches = []
            for i, c in updates:
                for x in c.sets:
                    if table.column(x.column).name == column:
                        e = binder.expr(x.expr, both, Env())
                        if x.op != "=":
                            e = binder.arithmetic(x.op[0], both.find([label, column]), e)
                        kind = table.column(column).type
                        branches.append(f"WHEN _clause = {i} THEN CAST({cast(binder, e, t.unbounded(kind))} AS {kind.spark()})")
            cells.append(F.expr(f"CASE {' '.join(branches)} ELSE {name(f'd_{column}')} END").alias(f"n_{column}"))
        rows = decided.where(F.col("_clause").isin([i for i, _ in updates]))
        new = s.engine.store.write(rows.select(RID, *cells, *extra_columns))
        both_sides = update_rows(s, parts, table, new.select(RID, *[name(f"n_{c}") for c in columns]), columns)
        deltas.append(("UPDATE", both_sides))
        table = s.table(parts)
    if doomed:
        deltas.append(("DELETE", delete_rows(s, parts, table, decided.where(F.col("_clause").isin(doomed)).select(RID))))
        table = s.table(parts)
    for i, c in inserts:
        targets = targets_of(s, table, parts, c.columns)
        values = c.values or []
        if len(values) != len(targets):
            raise SqlError("Column name or number of supplied values does not match table definition.", 213)
        cells = []
        for e, column in zip(values, targets):
            if e.kind == "default":
                e = column.default if column.default is not None else Node("lit", value=None, type="null")
            cells.append(cast(binder, binder.expr(e, both, Env()), t.unbounded(column.type)))
        df = decided.where(F.col("_clause") == i).select(*[F.expr(str(x)).cast(k.type.spark()).alias(f"v{n}") for n, (x, k) in enumerate(zip(cells, targets))])
        rows, next_identity = full_rows(s, table, targets, df, [t.unbounded(k.type) for k in targets])
        deltas.append(("INSERT", store_rows(s, parts, table, rows, next_identity)))
        table = s.table(parts)
    total = sum(df.count() for _, df in deltas)
    result = returned(s, node, table, deltas) if deltas else None
    s._rows = total
    for event, action in (("insert", "INSERT"), ("update", "UPDATE"), ("delete", "DELETE")):
        mine = [d for d in deltas if d[0] == action]
        if mine:
            fire(interp, table, event, mine)
    return result or Result(count=total)


def bulk_insert(interp, node: Node) -> Result:
    from tidewater.sources import read_delimited

    s = interp.s
    table = s.table(node.target)
    schema = ", ".join(f"{name(c.name)} {'STRING' if c.type.spark() == 'STRING' else c.type.spark()}" for c in table.columns if c.computed is None and c.identity is None)
    df = read_delimited(s.spark, node.path, schema, node.options)
    s._rows = insert_frame(s, node.target, df, [c.type for c in table.columns if c.computed is None and c.identity is None])
    return Result(count=s._rows)


def insert_bulk(interp, node: Node) -> None:
    """The handshake of a client's bulk load: its rows come through Session.bulk_load."""
    interp.s.table(node.target)


STATEMENTS = {"insert": insert, "update": update, "delete": delete, "truncate": truncate, "merge": merge, "bulk_insert": bulk_insert, "insert_bulk": insert_bulk}

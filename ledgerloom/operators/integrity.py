"""Declared constraints as batch checks.

NULL follows the SQL constraint rules: a check passes on NULL, a foreign key
passes when any part is NULL, a unique column ignores NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.model.schema import TABLES, ForeignKey, Table
from ledgerloom.model.tables import RetailTables
from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import pinned, spread


def _all_filled(keys: Sequence[str]) -> Column:
    filled = F.lit(True)
    for k in keys:
        filled = filled & F.col(k).isNotNull()
    return filled


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])


# ---- keys -------------------------------------------------------------------


def sharing_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that may share their key: all that do, and the few whose key's hash agrees with another's.

    Hashes are counted and written at once. As a rule few repeat, so that rows are
    looked up in a broadcast of them; else the two are shuffled.
    """
    marked = df.withColumn("_mark", F.xxhash64(*keys))
    again = marked.groupBy("_mark").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_mark")
    return marked.join(pinned(again, "repeated-hashes"), "_mark", "left_semi").drop("_mark")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fully filled keys held by more than one row, with their count.

    Whole keys are moved and compared only of rows whose key's hash more than one row has.
    """
    return (
        sharing_rows(df.where(_all_filled(keys)), keys)
        .groupBy(*keys)
        .agg(F.count("*").alias("ocorrencias"))
        .where("ocorrencias > 1")
    )


def key_violations(table: Table, df: DataFrame) -> DataFrame:
    """Keys that are repeated or incomplete: one row per key value."""
    counted = df.groupBy(*table.key).agg(F.count("*").alias("ocorrencias"))
    filled = _all_filled(table.key)
    problem = F.when(~filled, F.lit("CHAVE NULA")).otherwise(F.lit("CHAVE REPETIDA"))
    return counted.where(~filled | (F.col("ocorrencias") > 1)).select(
        F.lit(table.name).alias("tabela"),
        key_text(table.key).alias("chave"),
        problem.alias("problema"),
        "ocorrencias",
    )


def primary_key_report(tables: RetailTables) -> DataFrame:
    parts = []
    for table in TABLES.values():
        rows = tables[table.name].select(*table.key)
        if tables.is_stored(table.name):  # others are cut by their joins
            rows = spread(rows, table.key, rows)
        parts.append(key_violations(table, rows))
    return _stack(parts)


def unique_violations(table: Table, df: DataFrame) -> DataFrame:
    """Values of the unique columns held by more than one row; NULL is no value."""
    return _stack(
        [
            duplicate_keys(df, [column]).select(
                F.lit(table.name).alias("tabela"),
                F.lit(column).alias("coluna"),
                F.col(column).cast("string").alias("valor"),
                "ocorrencias",
            )
            for column in table.unique
        ]
    )


# ---- row checks -------------------------------------------------------------


def null_faults(table: Table) -> list[Column]:
    return [F.when(F.col(c).isNull(), F.lit(f"nulo:{c}")) for c in table.required]


def check_faults(table: Table) -> list[Column]:
    return [
        F.when(~F.coalesce(F.expr(predicate), F.lit(True)), F.lit(f"regra:{name}"))
        for name, predicate in table.checks.items()
    ]


def width_faults(table: Table) -> list[Column]:
    return [
        F.when(F.length(c.name) > c.length, F.lit(f"largura:{c.name}"))
        for c in table.columns
        if c.length
    ]


def null_report(tables: RetailTables) -> DataFrame:
    """NULLs per required column; one aggregate per table, one pass over it."""
    parts = []
    for table in TABLES.values():
        counts = [
            F.struct(
                F.lit(c).alias("coluna"), F.count_if(F.col(c).isNull()).alias("nulos")
            )
            for c in table.required
        ]
        row = tables[table.name].agg(F.array(*counts).alias("counts"))
        parts.append(
            row.select(F.lit(table.name).alias("tabela"), F.inline("counts"))
        )
    return _stack(parts)


def check_violations(tables: RetailTables) -> DataFrame:
    """One row per broken check and row; all checks of a table in a single scan."""
    parts = []
    for table in TABLES.values():
        broken = F.concat_ws(",", F.lit(None), *check_faults(table))
        parts.append(
            tables[table.name]
            .select(key_text(table.key).alias("chave"), broken.alias("faults"))
            .where("faults <> ''")
            .select(
                F.lit(table.name).alias("tabela"),
                F.explode(F.split("faults", ",")).alias("fault"),
                "chave",
            )
            .select("tabela", F.substring_index("fault", ":", -1).alias("regra"), "chave")
        )
    return _stack(parts)


def domain_report(raw: RetailTables) -> DataFrame:
    """Raw text that does not fit its column: too long, or too many digits."""
    parts = []
    for table in TABLES.values():
        counts = []
        for column in table.columns:
            if column.name not in table.raw_columns:
                continue
            text = F.trim(column.name)
            if column.length:
                rule, broken = f"ate {column.length} caracteres", F.length(text) > column.length
            elif column.type.typeName() == "decimal":
                room = 10 ** (column.type.precision - column.type.scale)
                rule = f"{column.type.precision - column.type.scale} digitos inteiros"
                broken = F.abs(F.round(text.try_cast("decimal(38,10)"), column.type.scale)) >= room
            else:
                continue
            counts.append(
                F.struct(
                    F.lit(column.name).alias("coluna"),
                    F.lit(rule).alias("regra"),
                    F.count_if(broken).alias("ocorrencias"),
                )
            )
        row = raw[table.name].agg(F.array(*counts).alias("counts"))
        parts.append(row.select(F.lit(table.name).alias("tabela"), F.inline("counts")))
    return _stack(parts)


# ---- references -------------------------------------------------------------


def _parent_keys(fk: ForeignKey, parent: DataFrame) -> DataFrame:
    return parent.select(
        *[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)]
    ).distinct()


def orphans(fk: ForeignKey, child: DataFrame, parent: DataFrame) -> DataFrame:
    """Child rows whose complete key has no parent."""
    filled = child.where(_all_filled(fk.columns))
    return lookup_join(filled, _parent_keys(fk, parent), fk.columns, "left_anti")


def missing_parents(fk: ForeignKey, child: DataFrame, parent: DataFrame) -> DataFrame:
    """Missing parent keys with the number of child rows that point at each.

    Counts before it joins, so a parent key held by many rows costs no more
    than any other.
    """
    counted = (
        child.where(_all_filled(fk.columns))
        .groupBy(*fk.columns)
        .agg(F.count("*").alias("linhas"))
    )
    return counted.join(_parent_keys(fk, parent), list(fk.columns), "left_anti")


def foreign_key_report(tables: RetailTables, prospective: bool = False) -> DataFrame:
    """Missing parents of every enforced reference: reference, key, child rows."""
    return _stack(
        [
            missing_parents(fk, tables[t.name], tables[fk.parent]).select(
                F.lit(fk.name).alias("restricao"), key_text(fk.columns).alias("chave"), "linhas"
            )
            for t in TABLES.values()
            for fk in t.foreign_keys
            if fk.prospective == prospective
        ]
    )


def admit(fk: ForeignKey, batch: DataFrame, parent: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Gate for new rows: adds ``aceito``. Stored history is never looked at."""
    known = _parent_keys(fk, parent).withColumn("_known", F.lit(True))
    looked_up = lookup_join(batch, known, fk.columns, "left", counts)
    passes = ~_all_filled(fk.columns) | F.col("_known").isNotNull()
    return looked_up.withColumn("aceito", passes).drop("_known")


def validate(fk: ForeignKey, child: DataFrame, parent: DataFrame) -> DataFrame:
    """One row: how many stored rows break the reference, and whether it holds."""
    broken = F.coalesce(F.sum("linhas"), F.lit(0)).cast("bigint")
    return missing_parents(fk, child, parent).agg(broken.alias("violacoes")).select(
        F.lit(fk.name).alias("restricao"), "violacoes", (F.col("violacoes") == 0).alias("valida")
    )


def cascade(child: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    """Follow parent key changes into the child: renamed keys move, deleted ones clear.

    ``changes`` has one row per changed parent: ``old`` and ``new``, where a
    NULL ``new`` means the parent is gone.
    """
    moves = changes.select(
        F.col("old").alias(column), F.col("new").alias("_new"), F.lit(True).alias("_moved")
    )
    joined = lookup_join(child, moves, [column], "left")
    value = F.when(F.col("_moved"), F.col("_new")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*child.columns)


def cascade_all(
    tables: RetailTables, changes: dict[str, DataFrame], declared: dict[str, Table] = TABLES
) -> RetailTables:
    """Carry changed parent rows along all cascading references, table after table.

    ``changes`` has by parent table one row per changed row: ``old_x`` and
    ``new_x`` for each column x that references point at. A parent that is gone
    has NULL in all new columns. The parents themselves change as well. Where a
    child's own columns are pointed at, what its references changed in them goes
    on to its children: ``declared`` lists parents before children.
    """
    changes, result = dict(changes), tables
    targets = _referenced(declared)
    for name, table in declared.items():
        rows = tables[name]
        given = changes.get(name)
        followed = [fk for fk in table.foreign_keys if fk.cascades and fk.parent in changes]
        if given is None and not followed:
            continue
        before = {c: f"_before_{c}" for c in rows.columns}
        moved = rows
        for fk in followed:
            moved = _follow(moved, fk, changes[fk.parent], before)
        if given is not None:
            moved = _change_parent(moved, given, targets[name])
        passed_on = [c for c in targets.get(name, []) if any(c in fk.columns for fk in followed)]
        if passed_on:
            pairs = moved.select(*[F.col(before[c] if before[c] in moved.columns else c).alias(f"old_{c}") for c in targets[name]], *[F.col(c).alias(f"new_{c}") for c in targets[name]])
            own = pairs.where(~F.struct(*[f"old_{c}" for c in targets[name]]).eqNullSafe(F.struct(*[f"new_{c}" for c in targets[name]]))).distinct()
            changes[name] = own if given is None else own.unionByName(given.select(own.columns))
        result = result.with_table(name, moved.select(*rows.columns))
    return result


def _referenced(declared: dict[str, Table]) -> dict[str, list[str]]:
    """Per table the columns that cascading references point at."""
    found: dict[str, list[str]] = {}
    for table in declared.values():
        for fk in table.foreign_keys:
            if fk.cascades:
                columns = found.setdefault(fk.parent, [])
                columns += [c for c in fk.parent_columns if c not in columns]
    return found


def _follow(child: DataFrame, fk: ForeignKey, changes: DataFrame, before: dict[str, str]) -> DataFrame:
    """The child with one reference moved; what the reference was is kept under its name in ``before``."""
    old = [F.col(f"old_{p}").alias(c) for c, p in zip(fk.columns, fk.parent_columns)]
    new = [F.col(f"new_{p}").alias(f"_new_{c}") for c, p in zip(fk.columns, fk.parent_columns)]
    changed = [~F.col(f"old_{p}").eqNullSafe(F.col(f"new_{p}")) for p in fk.parent_columns]
    moves = changes.where(reduce(Column.__or__, changed)).select(*old, *new, F.lit(True).alias("_moved")).distinct()
    joined = lookup_join(child, moves, fk.columns, "left")
    joined = joined.withColumns({before[c]: F.col(c) for c in fk.columns if before[c] not in child.columns})
    values = {c: F.when(F.col("_moved"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fk.columns}
    return joined.withColumns(values).drop("_moved", *[f"_new_{c}" for c in fk.columns])


def _change_parent(parent: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The parent's own rows: renamed, or gone where all new values are NULL."""
    renamed = [F.col(f"{side}_{c}").alias(f"_{side}_{c}") for side in ("old", "new") for c in columns]
    known = changes.select(*renamed, F.lit(True).alias("_moved"))
    joined = parent.join(known, [parent[c].eqNullSafe(known[f"_old_{c}"]) for c in columns], "left")
    gone = F.col("_moved") & reduce(Column.__and__, [F.col(f"_new_{c}").isNull() for c in columns])
    values = {c: F.when(F.col("_moved"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    kept = joined.where(~F.coalesce(gone, F.lit(False))).withColumns(values)
    return kept.drop("_moved", *[f"_{side}_{c}" for side in ("old", "new") for c in columns])


# ---- defaults ---------------------------------------------------------------


def fill_omitted(table: Table, batch: DataFrame) -> DataFrame:
    """Add the columns a batch leaves out, with their default or NULL.

    A column that is present keeps its NULLs: a default answers omission only.
    """
    present = set(batch.columns)
    return batch.select(
        *[
            F.col(c.name)
            if c.name in present
            else F.expr(c.default or "NULL").cast(c.type).alias(c.name)
            for c in table.columns
        ]
    )


# ---- rules that report without rejecting --------------------------------------

# Name, table, condition a sound row meets
REPORT_ONLY = (
    ("margem_nao_negativa", "branch_product", "preco_venda >= preco_compra"),
    ("entrega_apos_pedido", "purchase_order", "data_entrega >= data_pedido"),
)


def report_only(tables: RetailTables) -> DataFrame:
    return _stack(
        [
            tables[table]
            .agg(F.count_if(~F.expr(condition)).alias("ocorrencias"))
            .select(
                F.lit(rule).alias("regra"),
                F.lit(table).alias("tabela"),
                F.lit("report").alias("severidade"),
                "ocorrencias",
            )
            for rule, table, condition in REPORT_ONLY
        ]
    )


def _stack(parts: list[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked

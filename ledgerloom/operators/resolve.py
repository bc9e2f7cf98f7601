"""Supplier keys for product changes, as one set operation in the order of events.

Every change event carries the supplier code and number before and after. An
event sees the suppliers known before the batch and those that earlier events
registered. Whether an event registers a supplier depends on its own values and
on who comes first with a code, never on a number being accepted: so the first
use of each unknown code settles all registrations at once, and an event's place
behind or before them settles the rest. The last accepted event per product gives
its final state.

Order of precedence for an event:

1. the code changed: the number is cleared and found again from the code;
2. a number is present: it must exist; the code follows it when the code is
   missing or the number is what changed;
3. no number and no code: both stay empty;
4. a known code: its number is copied;
5. an unknown code: the first event that needs it registers a supplier, which gets
   the next number; later events find a known code.

A number that the batch hands out is accepted behind the event that registered
it and rejected before it.

An insert that brings a code and a valid number keeps both as they are, even
if they belong to different suppliers; :func:`mismatched_pairs` lists those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.casts import blank_to_null
from ledgerloom.model.labels import PENDING_SUPPLIER, UNKNOWN_NUMBER
from ledgerloom.operators.numbering import next_number, number_rows
from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import pinned

# Branch an event took (fixed values)
NUMBER_KEPT = "NUMERO"
REJECTED = "RECUSADO"
EMPTY = "VAZIO"
KNOWN_CODE = "CODIGO"
NEW_CODE = "CODIGO NOVO"


@dataclass(frozen=True)
class Resolution:
    events: DataFrame  # every event with idfornecedor, idfornecedor_num and ramo
    new_suppliers: DataFrame  # idfornecedor, fornecedor_num, razao_social

    @property
    def accepted(self) -> DataFrame:
        return self.events.where(F.col("ramo") != REJECTED)

    @property
    def rejected(self) -> DataFrame:
        return self.events.where(F.col("ramo") == REJECTED).select(
            "seq",
            "filial_id",
            "idproduto",
            "new_idfornecedor_num",
            F.format_string(UNKNOWN_NUMBER, "new_idfornecedor_num", "idproduto", "filial_id").alias("motivo"),
        )

    @property
    def notices(self) -> DataFrame:
        return self.new_suppliers.select(
            "idfornecedor",
            F.format_string("novo cadastro %s: numero %d, nome a completar", "idfornecedor", "fornecedor_num").alias("aviso"),
        )

    @property
    def final_state(self) -> DataFrame:
        """One row per product: the supplier keys left by its last accepted event."""
        last = F.max_by(F.struct("idfornecedor", "idfornecedor_num"), "seq")
        return (
            self.accepted.groupBy("filial_id", "idproduto")
            .agg(last.alias("last"))
            .select("filial_id", "idproduto", "last.*")
        )


def changed_columns(changes: DataFrame) -> DataFrame:
    """Which of the two supplier columns an update changed, NULLs compared as values."""
    update = F.col("op") == "UPDATE"
    text = ~F.col("new_idfornecedor").eqNullSafe(F.col("old_idfornecedor"))
    number = ~F.col("new_idfornecedor_num").eqNullSafe(F.col("old_idfornecedor_num"))
    return changes.withColumns({"texto_mudou": update & text, "numero_mudou": update & number})


def code_wins(changes: DataFrame) -> DataFrame:
    """Adds ``num``: the number to go by, cleared where the code changed."""
    number = F.when(~F.col("texto_mudou"), F.col("new_idfornecedor_num"))
    return changed_columns(changes).withColumn("num", number)


def unknown_codes(events: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Codes to register, with the first event that needs each: ``idfornecedor``, ``desde``.

    A code is needed where it decides, and unknown if the suppliers lack it.
    """
    codes = (
        events.where("num IS NULL")
        .select(blank_to_null(F.col("new_idfornecedor")).alias("idfornecedor"), "seq")
        .where("idfornecedor IS NOT NULL")
        .groupBy("idfornecedor")
        .agg(F.min("seq").alias("desde"))
    )
    return codes.join(suppliers.select("idfornecedor"), ["idfornecedor"], "left_anti")


def register(codes: DataFrame, suppliers: DataFrame, last_number: int = 0) -> DataFrame:
    """New suppliers in the order of their first events, numbered above all numbers in use.

    Numbers up to ``last_number`` were handed out before, maybe to suppliers that
    are gone, and are not handed out again.
    """
    first = max(next_number(suppliers, "fornecedor_num"), last_number + 1)
    return number_rows(codes, ["desde", "idfornecedor"], "fornecedor_num", first).select(
        "idfornecedor",
        "fornecedor_num",
        F.concat(F.lit(PENDING_SUPPLIER), "idfornecedor").alias("razao_social"),
        "desde",
    )


def resolve(changes: DataFrame, suppliers: DataFrame, last_number: int = 0) -> Resolution:
    """Resolve change events, in the order of ``seq``, against a supplier register.

    ``changes``: seq, op (INSERT or UPDATE), filial_id, idproduto and the old
    and new value of idfornecedor and idfornecedor_num.
    """
    events = code_wins(changes)
    suppliers = suppliers.select("idfornecedor", "fornecedor_num", "razao_social")
    # Read three times below; numbers are handed out once.
    new = pinned(register(unknown_codes(events, suppliers), suppliers, last_number), "registered")

    known = suppliers.withColumn("desde", F.lit(None).cast("long")).unionByName(new)
    by_number = (
        known.where("fornecedor_num IS NOT NULL")
        .groupBy(F.col("fornecedor_num").alias("num"))
        .agg(F.min("idfornecedor").alias("code_of_num"), F.min("desde").alias("num_since"))
    )
    by_code = known.groupBy(F.col("idfornecedor").alias("code")).agg(
        F.min("fornecedor_num").alias("num_of_code"), F.min("desde").alias("code_since")
    )
    # Only rows whose number is empty look their code up.
    events = events.withColumn(
        "code", F.when(F.col("num").isNull(), blank_to_null(F.col("new_idfornecedor")))
    )
    events = lookup_join(events, by_number, ["num"], "left")
    events = lookup_join(events, by_code, ["code"], "left")

    has_number = F.col("num").isNotNull()
    not_there = F.col("code_of_num").isNull() | F.coalesce(F.col("num_since") >= F.col("seq"), F.lit(False))
    branch = (
        F.when(has_number & not_there, REJECTED)
        .when(has_number, NUMBER_KEPT)
        .when(F.col("code").isNull(), EMPTY)
        .when(F.col("code_since") == F.col("seq"), NEW_CODE)
        .otherwise(KNOWN_CODE)
    )
    follows = F.col("new_idfornecedor").isNull() | F.col("numero_mudou")
    text = (
        F.when(F.col("ramo") == REJECTED, F.lit(None))
        .when(has_number & follows, F.col("code_of_num"))
        .when(has_number, F.col("new_idfornecedor"))
        .otherwise(F.col("code"))
    )
    number = F.when(F.col("ramo") == REJECTED, F.lit(None)).otherwise(
        F.coalesce("num", "num_of_code")
    )
    resolved = events.withColumn("ramo", branch).withColumns(
        {"idfornecedor": text, "idfornecedor_num": number}
    )
    kept = [*changes.columns, "texto_mudou", "numero_mudou", "ramo", "idfornecedor", "idfornecedor_num"]
    return Resolution(resolved.select(*kept), new.drop("desde"))


def unlinked_products(products: DataFrame) -> DataFrame:
    """Products without a supplier number, as no-change updates to be resolved."""
    return products.where("idfornecedor_num IS NULL").select(
        F.lit(0).cast("bigint").alias("seq"),
        F.lit("UPDATE").alias("op"),
        "filial_id",
        "idproduto",
        F.col("idfornecedor").alias("old_idfornecedor"),
        F.col("idfornecedor_num").alias("old_idfornecedor_num"),
        F.col("idfornecedor").alias("new_idfornecedor"),
        F.col("idfornecedor_num").alias("new_idfornecedor_num"),
    )


def backfill(products: DataFrame, suppliers: DataFrame, last_number: int = 0) -> tuple[DataFrame, DataFrame]:
    """Products with their numbers filled in, and the suppliers this registered, in code order."""
    outcome = resolve(unlinked_products(products), suppliers, last_number)
    linked = products.where("idfornecedor_num IS NOT NULL")
    keys = ["filial_id", "idproduto"]
    found = products.where("idfornecedor_num IS NULL").drop("idfornecedor", "idfornecedor_num").join(
        outcome.final_state, keys, "left"
    )
    return linked.unionByName(found), outcome.new_suppliers


def apply_to_products(products: DataFrame, outcome: Resolution) -> DataFrame:
    """Products after the accepted events: known lines take the new keys, new lines are added."""
    keys = ["filial_id", "idproduto"]
    state = outcome.final_state.withColumnsRenamed(
        {"idfornecedor": "_code", "idfornecedor_num": "_num"}
    ).withColumn("_hit", F.lit(True))
    joined = products.withColumn("_old", F.lit(True)).join(state, keys, "full")
    return joined.withColumns(
        {
            "idfornecedor": F.when(F.col("_hit"), F.col("_code")).otherwise(F.col("idfornecedor")),
            "idfornecedor_num": F.when(F.col("_hit"), F.col("_num")).otherwise(
                F.col("idfornecedor_num")
            ),
        }
    ).select(*products.columns)


def mismatched_pairs(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Products whose code and number belong to different suppliers."""
    owner = (
        suppliers.where("fornecedor_num IS NOT NULL")
        .groupBy(F.col("fornecedor_num").alias("idfornecedor_num"))
        .agg(F.min("idfornecedor").alias("dono_do_numero"))
    )
    keyed = products.select("filial_id", "idproduto", "idfornecedor", "idfornecedor_num")
    return lookup_join(keyed, owner, ["idfornecedor_num"], "inner").where(
        "idfornecedor IS NOT NULL AND trim(idfornecedor) <> dono_do_numero"
    )


def link_coverage(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("total_produtos"),
        F.count("idfornecedor_num").alias("com_vinculo_numerico"),
        (F.count("*") - F.count("idfornecedor_num")).alias("sem_vinculo"),
    )

"""Reading fields of a semi-structured record (a variant column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.money import parse_inr, parse_inr_number

# Fields that identify the borrower rather than the asset.
PERSONAL_FIELDS = (
    "borrowerName",
    "borrowerAddress",
    "borrowerCIF",
    "coBorrowerName",
    "guarantorName",
    "guarantorAddress",
    "ownerName",
    "ownerAddress",
    "custId",
    "customerId",
)


def text_at(record: Column, path: str) -> Column:
    """Scalar at ``a.b.c`` as text; null when any link is missing or not an object."""
    return F.try_variant_get(record, f"$.{path}", "string")


def kind_at(record: Column, path: str) -> Column:
    """``STRING``, ``BIGINT``, ``DECIMAL(..)``, ``BOOLEAN``, ... of the value at a path."""
    return F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant"))


def is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def typed_at(record: Column, path: str) -> Column:
    """struct(kind, text) at a path."""
    return F.struct(kind_at(record, path).alias("kind"), text_at(record, path).alias("text"))


def read_fields(rows: DataFrame, record: str, texts: dict[str, str], amounts: dict[str, str]) -> DataFrame:
    """Add one text column per entry of ``texts`` and one typed column per entry of ``amounts`` (name -> path).

    Later steps then name columns instead of repeating the lookups.
    """
    v = F.col(record)
    found = {name: text_at(v, path) for name, path in texts.items()}
    found |= {name: typed_at(v, path) for name, path in amounts.items()}
    return rows.withColumns(found)


def _filled(value: Column) -> Column:
    """Neither missing, blank, zero nor false."""
    text = value["text"]
    zero = is_number(value["kind"]) & (text.try_cast("double") == 0)
    return text.isNotNull() & (text != "") & ~F.coalesce(zero, F.lit(False)) & ~text.isin("false", "{}", "[]")


def either(*values: Column) -> Column:
    """First filled of several typed columns, else the last as it is."""
    return F.coalesce(*[F.when(_filled(v), v) for v in values[:-1]], values[-1])


def rupees(value: Column) -> Column:
    """Money from a typed value: text is parsed, numbers are taken with their sign."""
    return F.when(value["kind"] == "STRING", parse_inr(value["text"])).when(
        is_number(value["kind"]), parse_inr_number(value["text"])
    )



def strip_personal_map(record: Column) -> Column:
    """A map without the personal keys."""
    return F.map_filter(record, lambda key, _: ~key.isin(*PERSONAL_FIELDS))


def strip_personal_struct(record: Column, names: list[str]) -> Column:
    """A struct without the personal fields it has."""
    found = [name for name in names if name in PERSONAL_FIELDS]
    return record.dropFields(*found) if found else record


def strip_personal_data(record: Column) -> Column:
    """JSON text of a record (a variant) without the personal keys of its top level."""
    return F.to_json(strip_personal_map(F.try_variant_get(record, "$", "map<string,variant>")))

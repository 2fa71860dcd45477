"""Rules of incoming requests, as one column of problems a row: lengths, blank texts, addresses, listed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip

ADDRESS = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"


@dataclass(frozen=True)
class Field:
    most: int | None = None
    required: bool = True
    stripped: bool = False  # must hold more than white space
    address: bool = False
    least: int = 1


#: The fields of each kind of request and their longest lengths in code points.
REQUESTS = {
    "register": {"email": Field(address=True), "password": Field(128), "nickname": Field(255, stripped=True), "organization_code": Field(50), "admin_code": Field(50, required=False, least=0)},
    "login": {"email": Field(address=True), "password": Field(128)},
    "refresh": {"refresh_token": Field()},
    "message": {"content": Field(stripped=True)},
    "template": {"title": Field(100), "content": Field()},
    "guideline": {"title": Field(100), "content": Field()},
    "article_update": {"title": Field(255, required=False), "visibility": Field(required=False, least=0)},
    "member_update": {"email": Field(required=False, address=True), "nickname": Field(255, required=False), "role": Field(required=False, least=0)},
}


def field_problem(name: str, value: Column, rule: Field) -> Column:
    """The first rule that a value breaks, or null. A field that is not required may be null."""
    out = F.when(value.isNull(), F.lit(f"{name}: missing" if rule.required else None).cast("string"))
    if rule.least:
        out = out.when(value == "", f"{name}: empty")
    if rule.stripped:
        out = out.when(strip(value) == "", f"{name}: blank")
    if rule.most is not None:
        out = out.when(F.length(value) > rule.most, f"{name}: longer than {rule.most}")
    if rule.address:
        out = out.when(~value.rlike(ADDRESS), f"{name}: no address")
    return out


def problems(kind: str, **values: Column) -> Column:
    """All problems of a request of this kind, in the order of its fields; fields without a value count as null."""
    fields = REQUESTS[kind]
    unknown = values.keys() - fields.keys()
    if unknown:
        raise ValueError(f"{kind} has no {', '.join(sorted(unknown))}")
    return F.array_compact(F.array(*[field_problem(n, values.get(n, F.lit(None).cast("string")), r) for n, r in fields.items()]))

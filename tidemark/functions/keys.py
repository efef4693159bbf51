"""Keys of the job layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "done", "dead")
JOB, INDEX, NEXT_ID = "job/", "idx/status/", "meta/next_id"


def hex16(id_: Column) -> Column:
    return F.lpad(F.lower(F.hex(id_)), 16, "0")


def job_key(id_: Column) -> Column:
    return F.concat(F.lit(JOB), hex16(id_))


def status_key(status: Column, id_: Column) -> Column:
    return F.concat(F.lit(INDEX), status, F.lit("/"), hex16(id_))


def id_from_key(key: Column) -> Column:
    """Of the last part of a key; null unless it is 16 hex digits."""
    last = F.element_at(F.split(key, "/"), -1)
    return F.when(last.rlike("^[0-9a-fA-F]{16}$"), F.conv(last, 16, 10).cast("decimal(20,0)").cast("long"))


def job_key_bytes(id_: int) -> bytes:
    return f"{JOB}{id_:016x}".encode()


def status_key_bytes(status: str, id_: int) -> bytes:
    return f"{INDEX}{status}/{id_:016x}".encode()


def zipf_key(n: Column) -> Column:
    return F.format_string("key%010d", n)

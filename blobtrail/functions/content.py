"""Content column expressions: line-end normalisation, lenient decoding and
git blob ids (B1-B4). All are built-in JVM expressions; string and binary
content columns are both accepted. Bytes are rewritten by way of ISO-8859-1,
which maps each byte to one character and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType


def _is_binary(dtype: DataType | None) -> bool:
    return isinstance(dtype, BinaryType)


def normalize_lf(c: Column, dtype: DataType | None = None) -> Column:
    """B1: CRLF and lone CR become LF."""
    if _is_binary(dtype):
        return F.encode(F.regexp_replace(F.decode(c, "ISO-8859-1"), "\r\n?", "\n"), "ISO-8859-1")
    return F.regexp_replace(c, "\r\n?", "\n")


def crlf_variant(c: Column, dtype: DataType | None = None) -> Column:
    """Every LF becomes CRLF (the content a CRLF checkout would store)."""
    if _is_binary(dtype):
        return F.encode(F.replace(F.decode(c, "ISO-8859-1"), F.lit("\n"), F.lit("\r\n")), "ISO-8859-1")
    return F.replace(c, F.lit("\n"), F.lit("\r\n"))


def decode_ignore(c: Column, dtype: DataType | None = None) -> Column:
    """B2: UTF-8 decode that drops undecodable bytes. Invalid sequences are
    first replaced by U+FFFD, then every U+FFFD is removed (a real U+FFFD in
    the input is removed too; documented difference)."""
    if not _is_binary(dtype):
        return c
    return F.regexp_replace(F.make_valid_utf8(c.cast("string")), "\ufffd", "")


def as_bytes(c: Column, dtype: DataType | None = None) -> Column:
    return c if _is_binary(dtype) else F.encode(c, "UTF-8")


def blob_id(c: Column, dtype: DataType | None = None) -> Column:
    """Git object id of a blob: sha1("blob <len>\\0" + bytes)."""
    b = as_bytes(c, dtype)
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(b).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), b))


def blob_ids_lf_crlf(c: Column, dtype: DataType | None = None, crlf: bool = True) -> tuple[Column, Column]:
    """(id of the content, id of its CRLF variant). With ``crlf=False``
    both are the plain id, as the reference does outside Windows."""
    norm = blob_id(c, dtype)
    if not crlf:
        return norm, norm
    return norm, blob_id(crlf_variant(c, dtype), dtype)

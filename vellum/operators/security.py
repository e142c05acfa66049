"""What stands against an edit: encryption and signatures, and what a document says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources.scan import entry, markers, objects, trailers


def encryption(docs: DataFrame) -> DataFrame:
    """doc_id, filter, sub_filter, version, revision, length, permissions, crypt_filters of the documents whose trailer names an encryption."""
    tops = trailers(docs).where(entry("Encrypt").isNotNull()).select("doc_id", "entries")
    ref = F.nullif(F.regexp_extract(entry("Encrypt"), r"^(\d{1,9})\s+\d+\s+R$", 1), F.lit("")).cast("int")
    direct = F.transform_keys(F.map_filter("entries", lambda k, _: F.startswith(k, F.lit("Encrypt/"))), lambda k, _: F.substring(k, F.lit(9), F.length(k)))
    asked = tops.select("doc_id", ref.alias("num"), direct.alias("direct"))
    there = objects(docs).select("doc_id", "num", F.col("entries").alias("there"))
    rows = asked.join(there, ["doc_id", "num"], "left").select("doc_id", F.coalesce("there", "direct").alias("entries"))
    plain = lambda key: F.nullif(F.regexp_extract(F.coalesce(entry(key), F.lit("")), r"^/?(.*)$", 1), F.lit(""))
    whole = lambda key: F.expr(f"try_cast(entries['{key}'] as int)")
    names = F.array_sort(F.transform(F.filter(F.map_keys("entries"), lambda k: k.rlike(r"^CF/[^/]+$")), lambda k: F.concat(F.substring(k, F.lit(4), F.length(k)), F.lit(":"), F.regexp_replace(F.coalesce(F.col("entries")[F.concat(k, F.lit("/CFM"))], F.lit("")), "^/", ""))))
    return rows.select("doc_id", plain("Filter").alias("filter"), plain("SubFilter").alias("sub_filter"), whole("V").alias("version"), whole("R").alias("revision"), whole("Length").alias("length"), whole("P").alias("permissions"), names.alias("crypt_filters"))


def check(docs: DataFrame, invalidate: bool = False) -> DataFrame:
    """doc_id, refusal: why a document can't be edited as it is; null if nothing stands against it.

    Encryption comes first: one that isn't Standard can't be undone at all, the other needs a password. A signed document
    needs leave to lose its signatures.
    """
    rows = markers(docs).select("doc_id", "has_encrypt", "has_signature").join(encryption(docs).select("doc_id", "filter", "sub_filter"), "doc_id", "left")
    odd = F.col("sub_filter").isNotNull() | (F.coalesce("filter", F.lit("Standard")) != "Standard")
    refusal = F.when(F.col("has_encrypt") & odd, "unsupported_encryption").when(F.col("has_encrypt"), "password_required").when(F.col("has_signature") & F.lit(not invalidate), "signed")
    return rows.select("doc_id", refusal.alias("refusal"))

"""Column functions that hash: digests, plan ids, sign vectors and order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import digest_form, strip


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def digest(text: Column, width: int = 16) -> Column:
    return F.substring(sha(text), 1, width)


def text_digest(text: Column) -> Column:
    return digest(digest_form(text))


def stable_suffix(domain: Column, key: Column, seed: int | str) -> Column:
    return digest(F.concat_ws(":", domain, key.cast("string"), F.lit(str(seed))), 8)


def shuffle_key(*parts: Column) -> Column:
    """An order that looks random and is the same on any engine."""
    return digest(F.concat_ws(":", *[p.cast("string") for p in parts]))


def fraction(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of parts."""
    return F.conv(F.substring(sha(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_plan(text: Column, salt: str = "parallel-decoder-v1", buckets: int = 65536) -> Column:
    """A plan item's id in [1, buckets); 0 for an empty one. sha-256 of salt::text modulo buckets, with 0 as 1."""
    plain = F.lower(strip(text))
    hashed = sha(F.concat(F.lit(salt + "::"), plain))
    if buckets & (buckets - 1) == 0 and buckets <= 1 << 60:
        value = F.conv(F.substring(hashed, -15, 15), 16, 10).cast("long") % buckets
    else:
        value = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda t, i: (t * (65536 % buckets) + F.conv(F.substring(hashed, i * 4 + 1, F.lit(4)), 16, 10).cast("long")) % buckets)
    return F.when(plain == "", 0).otherwise(F.greatest(value, F.lit(1))).cast("int")


def hash_plan_entry(stream: Column, text: Column, **how) -> Column:
    return F.when(strip(text) == "", 0).otherwise(hash_plan(F.concat_ws("::", F.lower(strip(stream)), F.lower(strip(text))), **how))


def padded_ids(ids: Column, slots: int) -> Column:
    """ids with zeros up to `slots`; more ids than that are an error."""
    over = F.raise_error(F.lit(f"more than {slots} plan ids")).cast("array<int>")
    return F.when(F.size(ids) > slots, over).otherwise(F.concat(ids, F.array_repeat(F.lit(0), slots - F.size(ids))))


def id_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != 0).cast("int"))


def sign_vector(texts: Column, dim: int) -> Column:
    """Sum over texts and the bytes of their sha-256 of +1 or -1, at place (byte index + text index) mod dim; length 1."""
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    steps = F.sequence(F.lit(0), F.lit(31))

    def one(text: Column, offset: Column) -> Column:
        hashed = sha(text)
        return F.transform(steps, lambda i: F.struct(F.pmod(i + offset, F.lit(dim)).alias("at"), F.when(F.conv(F.substring(hashed, i * 2 + 2, F.lit(1)), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("v")))

    marks = F.flatten(F.transform(texts, one))
    raw = F.transform(places, lambda p: F.aggregate(marks, F.lit(0.0), lambda t, m: t + F.when(m["at"] == p, m["v"]).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda t, x: t + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, F.try_divide(x, norm)).otherwise(0.0))

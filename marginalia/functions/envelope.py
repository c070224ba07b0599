"""Signed and encrypted message envelopes, inside the JVM.

The envelope is AES-CBC with the first 16 bytes of the key as the vector over: 16 random
bytes, the big-endian length, the text, the receiver; padded to 32-byte blocks. Spark's CBC
mode pads to 16 bytes and prefixes the vector, so one block is added or taken off here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import let

BLOCK = 32
# The results of the checks.
OK = 0
CODES = {
    "signature": -40001, "xml": -40002, "sha": -40003, "key": -40004, "receiver": -40005, "encrypt": -40006, "decrypt": -40007, "buffer": -40008,
    "encode base64": -40009, "decode base64": -40010, "write xml": -40011,
}


def signature(*parts: Column) -> Column:
    """SHA-1 of the sorted, concatenated parts."""
    return F.sha1(F.array_join(F.array_sort(F.array(*parts)), ""))


def key_bytes(encoding_key: Column) -> Column:
    """The 32-byte key from its 43 base-64 characters; null if it isn't 32 bytes."""
    key = F.try_to_binary(F.concat(encoding_key, F.lit("=")), F.lit("base64"))
    return F.when(F.octet_length(key) == BLOCK, key)


def seal(text: Column, receiver: Column, key: Column, nonce: Column) -> Column:
    """Base-64 envelope of a text; ``nonce``: 16 bytes."""
    body, to = F.encode(text, "UTF-8"), F.encode(receiver, "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.octet_length(body).cast("long")), 8, "0"))
    plain = F.concat(nonce, size, body, to)
    pad = F.lit(BLOCK) - F.octet_length(plain) % BLOCK
    padded = F.concat(plain, F.unhex(F.repeat(F.lpad(F.hex(pad.cast("long")), 2, "0"), pad)))
    sealed = F.aes_encrypt(padded, key, F.lit("CBC"), F.lit("PKCS"), F.substring(key, 1, 16))
    return F.base64(F.substring(sealed, F.lit(17), F.octet_length(sealed) - 32))


def opened(envelope: Column, key: Column) -> Column:
    """(text, receiver) of a base-64 envelope; null where it can't be opened."""
    data = F.try_to_binary(envelope, F.lit("base64"))
    last = F.substring(data, F.octet_length(data) - 15, F.lit(16))
    # a further block that decrypts to Spark's own padding
    more = F.aes_encrypt(F.lit("").cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), last)
    whole = F.concat(F.substring(key, 1, 16), data, F.substring(more, F.lit(17), F.lit(16)))
    padded = F.try_aes_decrypt(F.when(F.octet_length(data) % 16 == 0, whole), key, F.lit("CBC"), F.lit("PKCS"))
    n = F.octet_length(padded)
    pad = F.conv(F.hex(F.substring(padded, n, F.lit(1))), 16, 10).cast("int")
    end = n - F.when((pad < 1) | (pad > BLOCK), 0).otherwise(pad)
    size = F.conv(F.hex(F.substring(padded, 17, 4)), 16, 10).cast("int")
    text = F.decode(F.substring(padded, F.lit(21), size), "UTF-8")
    receiver = F.decode(F.substring(padded, size + 21, end - size - 20), "UTF-8")
    return F.when((size >= 0) & (size <= end - 20), F.struct(text.alias("text"), receiver.alias("receiver")))


def verdict(signed: Column, given: Column, receiver: Column, expected: Column) -> Column:
    """The result code of an incoming message."""
    return F.when(~given.eqNullSafe(signed), CODES["signature"]).when(~receiver.eqNullSafe(expected), CODES["receiver"]).otherwise(OK)


def received(given: Column, parts: list[Column], envelope: Column, encoding_key: Column, expected: Column) -> Column:
    """(code, text) of an incoming envelope: the first check that fails, or its text.

    In order: the signature over ``parts`` and the envelope, the key, base 64, decryption, the buffer
    inside, the receiver. The text is null unless the code is 0.
    """
    key, data = key_bytes(encoding_key), F.try_to_binary(envelope, F.lit("base64"))
    size = F.octet_length(data)
    unreadable = (
        F.when(~given.eqNullSafe(signature(*[F.coalesce(p, F.lit("")) for p in (*parts, envelope)])), CODES["signature"])
        .when(key.isNull(), CODES["key"]).when(data.isNull(), CODES["decode base64"]).when((size == 0) | (size % 16 != 0), CODES["decrypt"])
    )

    def inside(x: Column) -> Column:
        o = x["o"]
        wrong = F.coalesce(x["code"], F.when(o.isNull(), CODES["buffer"]).when(~o["receiver"].eqNullSafe(x["to"]), CODES["receiver"]))
        return F.struct(F.coalesce(wrong, F.lit(OK)).alias("code"), F.when(wrong.isNull(), o["text"]).alias("text"))

    return let(F.struct(unreadable.alias("code"), opened(envelope, key).alias("o"), expected.alias("to")), inside)

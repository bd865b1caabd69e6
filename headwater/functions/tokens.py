"""Signed tokens (header.claims.signature, HMAC with SHA-256) as Column expressions.

The key's two padded blocks are literals of the plan, so plans show them to whoever may read plans. Defined cases: a null or
broken token is malformed; a claim that is absent fails only where it is required (exp always, iss and aud if asked for).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from headwater.functions import text as X

_BLOCK = 64


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The keyed hash of a binary column, as binary."""
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    pad = lambda mask: F.lit(bytearray(b ^ mask for b in block))
    return F.unhex(F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256))


def base64url(data: Column) -> Column:
    """Base64url of a binary column, without padding."""
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), r"[=\r\n]+", "")


def sign(header: Column, claims: Column, key: bytes) -> Column:
    """The token of two JSON texts."""
    body = F.concat(base64url(F.encode(header, "UTF-8")), F.lit("."), base64url(F.encode(claims, "UTF-8")))
    return F.concat(body, F.lit("."), base64url(hmac_sha256(F.encode(body, "UTF-8"), key)))


def refusal(token: Column, key: bytes, now: Column, issuer: str | None = None, audience: str | None = None, leeway: int = 0) -> Column:
    """Why a token is refused at ``now`` (seconds): malformed, algorithm, signature, expired, early, issuer or audience, the
    first that applies; null if it is accepted. aud may be a text or a list."""
    parts = F.split(F.coalesce(token, F.lit("")), r"\.", -1)
    body = F.concat(F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)))
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9_-]+$"))
    claims = X.base64url_decode(F.get(parts, F.lit(1)))
    claim = lambda name: F.get_json_object(claims, f"$.{name}")
    exp, nbf = claim("exp").try_cast("double"), claim("nbf").try_cast("double")
    listed = F.coalesce(F.from_json(claim("aud"), "array<string>"), F.array(claim("aud")))
    not_true = lambda c: ~F.coalesce(c, F.lit(False))
    why = (
        F.when(not_true(whole) | claims.isNull() | F.get_json_object(claims, "$").isNull(), "malformed")
        .when(not_true(F.get_json_object(X.base64url_decode(F.get(parts, F.lit(0))), "$.alg") == "HS256"), "algorithm")
        .when(not_true(base64url(hmac_sha256(F.encode(body, "UTF-8"), key)) == F.get(parts, F.lit(2))), "signature")
        .when(not_true(exp + leeway > now), "expired")
        .when(claim("nbf").isNotNull() & not_true(nbf - leeway <= now), "early")
    )
    if issuer is not None:
        why = why.when(not_true(claim("iss") == issuer), "issuer")
    if audience is not None:
        why = why.when(not_true(F.array_contains(listed, audience)), "audience")
    return why

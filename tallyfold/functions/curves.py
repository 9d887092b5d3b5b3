"""Whether the points of elliptic-curve keys are on their curve: y**2 = x**3 - 3x + b modulo p."""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus, b and base point of the curves, as NIST publishes them.
CURVES = {
    "nistp256": (
        2**256 - 2**224 + 2**192 + 2**96 - 1,
        0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B,
        0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296,
        0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5,
    ),
    "nistp384": (
        2**384 - 2**128 - 2**96 + 2**32 - 1,
        0xB3312FA7E23EE7E4988E056BE3F82D19181D9C6EFE8141120314088F5013875AC656398D8A2ED19D2A85C8EDD3EC2AEF,
        0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7,
        0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F,
    ),
    "nistp521": (
        2**521 - 1,
        0x0051953EB9618E1C9A1F929A21A0B68540EEA2DA725B99B315F3B8B489918EF109E156193951EC7E937B1652C0BD3BB1BF073573DF883D2C34F1EF451FD46B503F00,
        0x00C6858E06B70404E9CD9E3ECB662395B4429C648139053FB521F828AF606B4D3DBAA14B5E77EFE75928FE1DC127A2FFA8DE3348B3C1856A429BF97E7E31C2E5BD66,
        0x011839296A789A3BC0045C8A5FB42C7D1BD998F54449579B446817AFBD17273E662C97EE72995EF42640C550B9013FAD0761353C7086A272C24088BE94769FD16650,
    ),
}
#: Base64 that begins like an elliptic-curve key: plain, of a security key, and certificates of both.
EC_WORD = "^AAAA(E2VjZHNhL|InNrLWVjZHNhL|KGVjZHNhL|K3NrLWVjZHNhL)"


def on_curve(curve: str, point: bytes) -> bool:
    """Whether an uncompressed point has its curve's length and lies on it."""
    p, b, _, _ = CURVES[curve]
    size = (p.bit_length() + 7) // 8
    if len(point) != 1 + 2 * size or point[0] != 4:
        return False
    x, y = int.from_bytes(point[1 : 1 + size], "big"), int.from_bytes(point[1 + size :], "big")
    return x < p and y < p and (y * y - x * x * x + 3 * x - b) % p == 0


def multiples(curve: str, n: int) -> list[bytes]:
    """The first ``n`` multiples of a curve's base point, uncompressed."""
    p, _, gx, gy = CURVES[curve]
    size, out, (x, y) = (p.bit_length() + 7) // 8, [], (gx, gy)
    for k in range(n):
        out.append(b"\x04" + x.to_bytes(size, "big") + y.to_bytes(size, "big"))
        top, bottom = (3 * x * x - 3, 2 * y) if k == 0 else (y - gy, x - gx)
        slope = top * pow(bottom, -1, p) % p
        x2 = (slope * slope - x - gx) % p
        x, y = x2, (slope * (gx - x2) - gy) % p
    return out


def _off(word: str) -> bool:
    """Whether a base64 word is an elliptic-curve key whose point is not on its curve.

    What isn't framed as such a key is left to others.
    """
    try:
        blob = base64.b64decode(word, validate=True)
    except (binascii.Error, ValueError):
        return False
    fields, at = [], 0
    while at + 4 <= len(blob) and len(fields) < 4:
        size = int.from_bytes(blob[at : at + 4], "big")
        fields.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    first = 2 if fields and b"-cert-" in fields[0] else 1  # a certificate's nonce comes before
    if len(fields) < first + 2:
        return False
    curve = fields[first].decode("latin-1")
    return curve in CURVES and not on_curve(curve, fields[first + 1])


def off_curve(value: Column) -> Column:
    """The base64 words of a value that are elliptic-curve keys off their curve (array of strings).

    Only such words go to Python, so that other values cost an empty array.
    """
    words = F.filter(F.regexp_extract_all(value, F.lit("[A-Za-z0-9+/]{60,}={0,2}"), F.lit(0)), lambda w: w.rlike(EC_WORD))

    @F.arrow_udf("array<string>")
    def those_off(batch):
        import pyarrow as pa

        return pa.array([[w for w in some or [] if _off(w)] for some in batch.to_pylist()], pa.list_(pa.string()))

    return those_off(F.coalesce(words, F.array().cast("array<string>")))

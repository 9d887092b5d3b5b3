"""Public keys and fingerprints as column expressions.

A key value is an authorized-key line: options, a word, base64 blob, comment.  The
blob says the type; it must be framed exactly as its type demands (RFC 4253 fields
with big-endian lengths that fill it) and hold a body of the type's lengths and
curve.  Lines without a key before the key's line are skipped, as comments are;
nothing may follow it.  RSA blobs may lack their base64 padding.  A point that is not on
its curve is no key; that is told of elliptic-curve keys beforehand, by long numbers
in Python, and everything else by column expressions.

Not checked: the signature and option lists of a certificate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import off_curve

# What follows the type field in a blob; s: length-prefixed field, 8 and 4: bytes of a number.
BODIES = {
    "ssh-rsa": "ss",
    "ssh-dss": "ssss",
    "ssh-ed25519": "s",
    "ecdsa-sha2-nistp256": "ss",
    "ecdsa-sha2-nistp384": "ss",
    "ecdsa-sha2-nistp521": "ss",
    "sk-ssh-ed25519@openssh.com": "ss",
    "sk-ecdsa-sha2-nistp256@openssh.com": "sss",
}
CERTIFICATES = {
    "ssh-rsa-cert-v01@openssh.com": "ssh-rsa",
    "ssh-dss-cert-v01@openssh.com": "ssh-dss",
    "ssh-ed25519-cert-v01@openssh.com": "ssh-ed25519",
    "ecdsa-sha2-nistp256-cert-v01@openssh.com": "ecdsa-sha2-nistp256",
    "ecdsa-sha2-nistp384-cert-v01@openssh.com": "ecdsa-sha2-nistp384",
    "ecdsa-sha2-nistp521-cert-v01@openssh.com": "ecdsa-sha2-nistp521",
    "sk-ssh-ed25519-cert-v01@openssh.com": "sk-ssh-ed25519@openssh.com",
    "sk-ecdsa-sha2-nistp256-cert-v01@openssh.com": "sk-ecdsa-sha2-nistp256@openssh.com",
}
#: Serial, kind, key id, principals, two times, two option lists, reserved, signer, signature.
CERTIFICATE_REST = "84ss88sssss"
#: Bytes of an uncompressed point by curve; bits of a DSA modulus.
POINTS = {"nistp256": 65, "nistp384": 97, "nistp521": 133}
DSA_BITS = 1024
MOST_BYTES = 64 << 10

#: Parts of every type after its own field, a certificate's nonce first, and the type of the key inside.
_LAYOUT = {t: (parts, t) for t, parts in BODIES.items()} | {c: ("s" + BODIES[t] + CERTIFICATE_REST, t) for c, t in CERTIFICATES.items()}
#: Options end at the first blank outside quotes; a quote after a backslash is none.
_SECOND = r"^[^ \t]+[ \t]+([^ \t]+)"
_THIRD = r'^(?:[^ \t"]|(?<=\\)"|(?<!\\)"(?:[^"]|(?<=\\)")*(?<!\\)")+[ \t]+[^ \t]+[ \t]+([^ \t]+)'


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(blob: Column, at: Column, size: int = 4) -> Column:
    """Big-endian unsigned number at a byte offset; null past the end."""
    return _let(F.hex(F.substring(blob, (at + 1).cast("int"), F.lit(size))), lambda raw: F.when(F.length(raw) == 2 * size, F.conv(raw, 16, 10).cast("long")))


def _fields(blob: Column, layout: Column) -> Column:
    """Fields of a blob that the layout (array of s, 8, 4) cuts exactly; null if it doesn't."""
    kind = "struct<at: long, parts: array<binary>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<binary>").alias("parts")).cast(kind)

    def step(s: Column, form: Column) -> Column:
        head = F.when(form == "s", 4).otherwise(0)
        size = F.when(form == "s", _number(blob, s["at"])).otherwise(form.try_cast("long"))
        part = lambda n: F.substring(blob, (s["at"] + head + 1).cast("int"), n.cast("int"))
        return _let(size, lambda n: F.when(s["at"] + head + n <= F.length(blob), F.struct((s["at"] + head + n).alias("at"), F.concat(s["parts"], F.array(part(n))).alias("parts"))).cast(kind))

    return F.aggregate(layout, start, step, lambda s: F.when(s["at"] == F.length(blob), s["parts"]))


def _base64(raw: Column) -> Column:
    """Base64 in one line, whatever the session says about line breaks."""
    return F.regexp_replace(F.base64(raw), r"[\r\n]", "")


def _decoded(text: Column) -> Column:
    """Bytes of padded base64, or of strict base64 without padding if they are an RSA blob."""

    def bare(x: Column) -> Column:
        whole = F.when(x.rlike("^[A-Za-z0-9+/]+$") & (F.length(x) % 4 > 1), F.unbase64(F.concat(x, F.repeat(F.lit("="), 4 - F.length(x) % 4))))
        return _let(whole, lambda raw: F.when((F.rtrim(_base64(raw), F.lit("=")) == x) & (F.substring(raw, 1, 11) == F.unhex(F.lit("000000077373682D727361"))), raw))

    padded = text.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(text) % 4 == 0)
    return F.when(padded, F.unbase64(text)).otherwise(bare(text))


def _byte(part: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(part, at, 1)), 16, 10).cast("int")


def _positive_mpint(part: Column) -> Column:
    """Positive, without a needless zero byte before."""
    size, head = F.length(part), _byte(part, 1)
    return (size > 0) & (head < 128) & ~((head == 0) & ((size == 1) | (_byte(part, 2) < 128)))


def _has_bits(part: Column, bits: int) -> Column:
    """Whether an mpint has just so many bits, a multiple of eight."""
    return (F.length(part) == bits // 8 + 1) & (_byte(part, 1) == 0) & (_byte(part, 2) >= 128)


def _sound(kind: Column, parts: Column) -> Column:
    """Whether the fields of a key of a plain type are of that type's lengths and curve."""
    at = lambda i: F.get(parts, F.lit(i))
    curves = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])

    def on(curve: Column, named: Column) -> Column:
        return (curve == named) & (F.length(at(1)) == F.element_at(curves, named)) & (_byte(at(1), 1) == 4)

    return F.coalesce(
        F.when(kind == "ssh-rsa", _positive_mpint(at(0)) & _positive_mpint(at(1)))
        .when(kind == "ssh-dss", F.forall(F.slice(parts, 1, 4), _positive_mpint) & _has_bits(at(0), DSA_BITS))
        .when(kind.contains("ed25519"), F.length(at(0)) == 32)
        .otherwise(on(at(0).cast("string"), F.regexp_extract(kind, "nistp[0-9]+", 0))),
        F.lit(False),
    )


KEY = "struct<fingerprint: binary, text: string, type: string, canonical: string, reason: string>"


def _rejected(reason: str) -> Column:
    return F.expr(f"cast(struct(null, null, null, null, '{reason}') AS {KEY})")


def _key_of(encoded: Column) -> Column:
    """KEY of a base64 word."""
    rows = ", ".join(f"'{t}', struct(split('s{form}', '') AS form, '{inner}' AS inner, {form != BODIES.get(t)} AS signed)" for t, (form, inner) in _LAYOUT.items())
    types = F.expr(f"map({rows})")

    def of_type(blob: Column, kind: Column, known: Column) -> Column:
        def checked(parts: Column) -> Column:
            body = F.slice(parts, F.when(known["signed"], 3).otherwise(2), F.lit(8))
            digest = F.unhex(F.sha2(blob, 256))
            good = _let(digest, lambda d: F.struct(d, fingerprint_text(d), kind, F.concat(kind, F.lit(" "), _base64(blob)), F.lit(None).cast("string")).cast(KEY))
            sound = _sound(known["inner"], body) & ~F.array_contains(F.col("_off"), encoded)
            return F.when(parts.isNull(), _rejected("broken framing")).when(sound, good).otherwise(_rejected("invalid key body"))

        return F.when(known.isNull(), _rejected("unknown type")).otherwise(_let(_fields(blob, known["form"]), checked))

    def of_blob(blob: Column) -> Column:
        size = _number(blob, F.lit(0))
        name = _let(size, lambda n: F.when((n > 0) & (n <= 64), F.substring(blob, 5, n.cast("int")).try_cast("string")))
        framed = _let(name, lambda kind: F.when(kind.isNull(), _rejected("broken framing")).otherwise(_let(F.try_element_at(types, kind), lambda known: of_type(blob, kind, known))))
        return F.when(blob.isNull(), _rejected("invalid base64")).when(F.length(blob) > MOST_BYTES, _rejected("blob too large")).otherwise(framed)

    return _let(_decoded(encoded), of_blob)


def _key_of_line(line: Column) -> Column:
    """KEY of one line: the second word is the blob, or the third after options."""

    def chosen(keys: Column) -> Column:
        a, b = F.get(keys, F.lit(0)), F.get(keys, F.lit(1))
        later = b["reason"].isNull() | (a["reason"] == "invalid base64") & b["reason"].isin("unknown type", "invalid key body")
        return F.when(F.size(keys) == 0, _rejected("no key")).when((F.size(keys) > 1) & a["reason"].isNotNull() & later, b).otherwise(a)

    words = F.filter(F.array(F.regexp_extract(line, _SECOND, 1), F.regexp_extract(line, _THIRD, 1)), lambda w: (w != "") & ~line.startswith("#"))
    return _let(F.transform(words, _key_of), chosen)


def _key_of_value(value: Column) -> Column:
    """KEY of a whole value: its first line with a key, the last line with anything."""

    def of_lines(lines: Column) -> Column:
        def chosen(keys: Column) -> Column:
            def at(i: Column) -> Column:
                last = F.get(keys, i - 1)
                return F.when(i == 0, F.coalesce(F.get(F.filter(keys, lambda k: k["reason"] != "no key"), F.lit(0)), F.get(keys, F.lit(0)))).when(i < F.size(keys), _rejected("more than one key")).otherwise(last)

            return _let(F.array_position(F.transform(keys, lambda k: k["reason"].isNull()), F.lit(True)).cast("int"), at)

        return F.when(F.size(lines) == 0, _rejected("empty")).otherwise(_let(F.transform(lines, _key_of_line), chosen))

    blank = r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$"
    lines = F.filter(F.transform(F.split(value, "\n"), lambda x: F.regexp_replace(x, blank, "")), lambda x: x != "")
    return F.when(value.isNull(), _rejected("empty")).otherwise(_let(lines, of_lines))


def fingerprint_text(digest: Column) -> Column:
    return F.concat(F.lit("SHA256:"), F.rtrim(_base64(digest), F.lit("=")))


@lru_cache(maxsize=2)
def _parser(application: str) -> Column:
    """The fields of the key in ``_value``; made once for an application, as it has many parts.

    A generator, so that the value is parsed once and its fields are only read.
    """
    return F.inline(F.array(_key_of_value(F.col("_value"))))


def parse_keys(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with fingerprint, text, type, canonical and reason (null when valid); columns of these names are replaced."""
    others = df.withColumn("_value", F.col(raw)).withColumn("_off", off_curve(F.col("_value"))).drop("fingerprint", "text", "type", "canonical", "reason")
    return others.select("*", _parser(df.sparkSession.sparkContext.applicationId)).drop("_value", "_off")


def normalize_keys(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """(keys, rejects): valid rows with their key columns, others with a reason."""
    rows = parse_keys(df, raw)
    keys = rows.filter("reason is null").drop("reason")
    return keys, rows.filter("reason is not null").drop("fingerprint", "text", "type", "canonical")


def normalize_fingerprints(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``normal``: the canonical fingerprint text of a spelling or of a key."""
    value = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    tagged = F.upper(F.substring(value, 1, 7)) == "SHA256:"
    body = F.when(tagged, F.substring(value, 8, 1 << 20)).otherwise(value)
    size = F.length(body)
    shaped = (size == 43) | ((size == 44) & body.endswith("="))
    raw = F.try_to_binary(F.concat(F.rtrim(body, F.lit("=")), F.lit("=")), F.lit("base64"))
    digest = F.when(shaped & body.rlike("^[A-Za-z0-9+/]{43}=?$") & (F.length(raw) == 32), fingerprint_text(raw))
    rows = parse_keys(df, column)
    normal = F.when(tagged | shaped, digest).otherwise(F.col("text"))
    return rows.withColumn("normal", normal).drop("fingerprint", "text", "type", "canonical", "reason")


def is_user_node(node_id: str) -> Column:
    """Whether a node id names a user: by its prefix, or in its decoded older form."""
    decoded = F.try_to_binary(F.col(node_id), F.lit("base64")).cast("string")
    return F.coalesce(F.col(node_id).startswith("U_") | F.coalesce(decoded.contains(":User"), F.lit(False)), F.lit(False))


def classify_actors(df: DataFrame, node_id: str = "node_id", n_keys: str = "n_keys") -> DataFrame:
    """``df`` with is_user, without the other actors that hold no key."""
    return df.withColumn("is_user", is_user_node(node_id)).filter(F.col("is_user") | (F.col(n_keys) > 0))

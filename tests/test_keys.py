from __future__ import annotations

import base64
import hashlib

from tallyfold.functions import curves
from tallyfold.functions import keys as K

# A key line and its fingerprint.
RSA = "ssh-rsa AAAAB3NzaC1yc2EAAAAJAsokcuriAAABAAABAQDhas4u48SN8004rJFz2w8W3VVABgV0kMLJqRq6vj5p+q1tFxXJFt/E1hRl5vpFPUqPh7uZ1nnYHkfM9sDmKCrq9r9KyX+i1+DaEHabP4QsXt2W/5fcxHswJHWReTRa7dA4wHo9iFW27rMHk32OSAvIy3y8bTSuD8PFeuhjTouONHNFwEaJudX3FuqGy7ZQzF6yrf5WrYYrZpQXPyiGjv8E3b9wr2HeT9mr1R8rPukKV23dLRfLERXXdbzK8Wcw0AcDmMXWGhnaC2q7fwoUEq6XO+ArHmaV0OmCrb3R2pW1tXY3VrwXpSxXMd4lrrrRd6sKroHZmQOfMCWfdgBx62KT"
PRINT = "SHA256:cifKeaoLTezpRRdYtMNnPURa3L//wT4gS3pC0S7KSB0"
ED = "ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAIL1LeQQBsiMach2TP93bSThTouh8aV9DOZABSw3qzwfb"


def parsed(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, raw string")
    return {r["i"]: r for r in K.parse_keys(df, "raw").collect()}


def blob(*fields: bytes) -> str:
    return base64.b64encode(b"".join(len(f).to_bytes(4, "big") + f for f in fields)).decode()


def test_golden_and_spellings(spark):
    got = parsed(spark, [RSA, RSA + " comment here", 'from="a b",no-pty ' + RSA, "  " + ED + "\t", ED.rstrip("=")])
    assert [got[i]["text"] for i in range(3)] == [PRINT] * 3
    assert got[0]["canonical"] == RSA and got[2]["type"] == "ssh-rsa"
    raw = base64.b64decode(ED.split()[1])
    assert bytes(got[3]["fingerprint"]) == hashlib.sha256(raw).digest() and got[4]["reason"] is None


def u32(n: int) -> bytes:
    return n.to_bytes(4, "big")


E, N = b"\x01\x00\x01", b"\x00" + b"\xc5" * 32
POINT = {len(p): p for p in (curves.multiples(c, 3)[2] for c in curves.CURVES)}
DSS = [b"\x00" + b"\x81" * 128, b"\x00" + b"\x91" * 20, b"\x05" * 128, b"\x06" * 128]


def certificate(kind: bytes, *body: bytes, rest: bytes = b"") -> str:
    s = lambda *parts: b"".join(u32(len(x)) + x for x in parts)
    return base64.b64encode(s(kind, b"nonce", *body) + bytes(8) + u32(1) + s(b"id", b"names") + bytes(16) + s(b"", b"", b"", b"signer", b"signature") + rest).decode()


def test_types(spark):
    good = {
        "ssh-rsa": blob(b"ssh-rsa", E, N),
        "ssh-dss": blob(b"ssh-dss", *DSS),
        "ssh-ed25519": blob(b"ssh-ed25519", b"\x02" * 32),
        "ecdsa-sha2-nistp256": blob(b"ecdsa-sha2-nistp256", b"nistp256", POINT[65]),
        "ecdsa-sha2-nistp384": blob(b"ecdsa-sha2-nistp384", b"nistp384", POINT[97]),
        "ecdsa-sha2-nistp521": blob(b"ecdsa-sha2-nistp521", b"nistp521", POINT[133]),
        "sk-ssh-ed25519@openssh.com": blob(b"sk-ssh-ed25519@openssh.com", b"\x02" * 32, b"ssh:"),
        "sk-ecdsa-sha2-nistp256@openssh.com": blob(b"sk-ecdsa-sha2-nistp256@openssh.com", b"nistp256", POINT[65], b"ssh:"),
        "ssh-rsa-cert-v01@openssh.com": certificate(b"ssh-rsa-cert-v01@openssh.com", E, N),
        "ssh-ed25519-cert-v01@openssh.com": certificate(b"ssh-ed25519-cert-v01@openssh.com", b"\x02" * 32),
        "ecdsa-sha2-nistp521-cert-v01@openssh.com": certificate(b"ecdsa-sha2-nistp521-cert-v01@openssh.com", b"nistp521", POINT[133]),
    }
    got = parsed(spark, [f"any {b} me" for b in good.values()])
    for i, (kind, text) in enumerate(good.items()):
        raw = base64.b64decode(text)
        assert (got[i]["reason"], got[i]["type"], got[i]["canonical"], bytes(got[i]["fingerprint"])) == (None, kind, f"{kind} {text}", hashlib.sha256(raw).digest())


def test_lines(spark):
    short = blob(b"ssh-rsa", E, b"\x00" + b"\xc5" * 33)
    assert short.endswith("=")
    cases = {
        "# a comment\n\n" + ED + "\n  ": None,
        "nonsense line\r\n" + ED + "\r\n": None,
        'command="say \\"hi you\\" now",no-pty ' + ED: None,
        "ssh-rsa " + short.rstrip("="): None,
        "ssh-ed25519 " + ED.split()[1]: None,
        "# only a comment": "no key",
        "one-word": "no key",
        ED + "\n# after": "more than one key",
        'from="a b ' + ED: "invalid base64",
        "ecdsa-sha2-nistp256 " + blob(b"ecdsa-sha2-nistp256", b"nistp256", POINT[65]).rstrip("="): "invalid base64",
    }
    got = parsed(spark, list(cases))
    assert [got[i]["reason"] for i in range(len(cases))] == list(cases.values())
    assert got[3]["canonical"] == "ssh-rsa " + short


def test_rejects(spark):
    cases = {
        "": "empty",
        None: "empty",
        " \n\t": "empty",
        ED + "\n" + ED: "more than one key",
        "ssh-foo " + blob(b"ssh-foo", b"x"): "unknown type",
        "ssh-foo AAAA": "broken framing",
        "ssh-ed25519 A*AA": "invalid base64",
        "ssh-rsa " + RSA.split()[1][:-8]: "broken framing",
        "ssh-rsa " + blob(b"ssh-rsa", E, b"\x80\x01"): "invalid key body",
        "ssh-rsa " + blob(b"ssh-rsa", b"\x00\x01", b"\x01\x01"): "invalid key body",
        "ssh-rsa " + blob(b"ssh-rsa", b"\x00", b"\x01\x01"): "invalid key body",
        "ssh-rsa " + blob(b"ssh-rsa", b"\x01", b"\x01", b"x"): "broken framing",
        "ssh-rsa " + blob(b"ssh-dss", b"\x01", b"\x01"): "broken framing",
        "ssh-ed25519 AAAAC": "invalid base64",
        "ssh-ed25519 " + blob(b"ssh-ed25519", b"abc"): "invalid key body",
        "ecdsa-sha2-nistp256 " + blob(b"ecdsa-sha2-nistp256", b"nistp384", POINT[97]): "invalid key body",
        "ecdsa-sha2-nistp384 " + blob(b"ecdsa-sha2-nistp384", b"nistp384", POINT[65]): "invalid key body",
        "ecdsa-sha2-nistp256 " + blob(b"ecdsa-sha2-nistp256", b"nistp256", b"\x02" + POINT[65][1:]): "invalid key body",
        **{f"ecdsa-sha2-{c} " + blob(f"ecdsa-sha2-{c}".encode(), c.encode(), moved(POINT[n])): "invalid key body" for c, n in (("nistp256", 65), ("nistp384", 97), ("nistp521", 133))},
        "sk " + blob(b"sk-ecdsa-sha2-nistp256@openssh.com", b"nistp256", moved(POINT[65]), b"ssh:"): "invalid key body",
        "c " + certificate(b"ecdsa-sha2-nistp521-cert-v01@openssh.com", b"nistp521", moved(POINT[133])): "invalid key body",
        "ssh-dss " + blob(b"ssh-dss", b"\x01", *DSS[1:]): "invalid key body",
        "c " + certificate(b"ssh-ed25519-cert-v01@openssh.com", b"\x02" * 31): "invalid key body",
        "c " + certificate(b"ssh-ed25519-cert-v01@openssh.com", b"\x02" * 32, rest=b"x"): "broken framing",
        "ssh-rsa " + base64.b64encode(b"\x00" * 70_000).decode(): "blob too large",
    }
    got = parsed(spark, list(cases))
    assert [got[i]["reason"] for i in range(len(cases))] == list(cases.values())
    assert all(got[i][c] is None for i in range(len(cases)) for c in ("text", "type", "canonical", "fingerprint"))


def moved(point: bytes) -> bytes:
    """A point of the same length that is off the curve by one."""
    return point[:-1] + bytes([point[-1] ^ 1])


def test_points(spark):
    """Multiples of the base point are on each curve, their neighbours aren't; coordinates stay below the modulus."""
    for curve, (p, _, _, _) in curves.CURVES.items():
        size = (p.bit_length() + 7) // 8
        some = curves.multiples(curve, 40)
        assert len(set(some)) == 40 and all(curves.on_curve(curve, x) for x in some)
        assert not any(curves.on_curve(curve, moved(x)) for x in some)
        x, y = (int.from_bytes(part, "big") for part in (some[4][1 : 1 + size], some[4][1 + size :]))
        if (x + p).bit_length() <= 8 * size:
            assert not curves.on_curve(curve, b"\x04" + (x + p).to_bytes(size, "big") + y.to_bytes(size, "big"))
        assert curves.on_curve(curve, b"\x04" + x.to_bytes(size, "big") + (p - y).to_bytes(size, "big"))
        assert not curves.on_curve(curve, some[0][:-1]) and not curves.on_curve(curve, b"\x02" + some[0][1:])
    # a key off its curve is no key: the line after it counts
    line = "ecdsa-sha2-nistp256 " + blob(b"ecdsa-sha2-nistp256", b"nistp256", moved(POINT[65]))
    got = parsed(spark, [line + "\n" + ED, ED + "\n" + line])
    assert got[0]["canonical"] == ED and got[0]["reason"] is None and got[1]["reason"] == "more than one key"


def test_fingerprint_spellings(spark):
    bare = PRINT[7:]
    good = [PRINT, "sha256:" + bare, bare, bare + "=", "SHA256:" + bare + "=", " " + RSA + " me "]
    bad = ["SHA256:" + bare[:-1], "x" + bare, "SHA256:" + bare + "x", "nonsense", ""]
    df = spark.createDataFrame(list(enumerate(good + bad)), "i int, v string")
    got = [r["normal"] for r in K.normalize_fingerprints(df, "v").orderBy("i").collect()]
    assert got == [PRINT] * len(good) + [None] * len(bad)

"""Ed25519 signatures over whole numbers, after RFC 8032: a manifest is signed once, so plain arithmetic will do."""

from __future__ import annotations

import hashlib

# The field, the group's order, the curve's constant and the base point's y.
P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
_ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _x_of(y: int, odd: int) -> int | None:
    """x of a point by its y and the parity of x; None if there is none."""
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * _ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x % 2 != odd else x


def _add(a: Point, b: Point) -> Point:
    """Sum of two points in extended coordinates."""
    s, t = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    u, v = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = t - s, v - u, v + u, t + s
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, point: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point = _add(point, point)
        n >>= 1
    return out


_BASE_Y = 4 * pow(5, -1, P) % P
_BASE_X = _x_of(_BASE_Y, 0) or 0
BASE: Point = (_BASE_X, _BASE_Y, 1, _BASE_X * _BASE_Y % P)


def _encode(point: Point) -> bytes:
    z = pow(point[2], -1, P)
    x, y = point[0] * z % P, point[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _decode(data: bytes) -> Point | None:
    n = int.from_bytes(data, "little")
    y, odd = n & (1 << 255) - 1, n >> 255
    x = _x_of(y, odd) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    n = int.from_bytes(h[:32], "little")
    return n & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    """The 32 bytes that others may know of a 32-byte seed."""
    return _encode(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    """64 bytes of signature."""
    a, prefix = _secret(seed)
    mine = public_key(seed)
    r = _number(prefix, message) % L
    first = _encode(_times(r, BASE))
    s = (r + _number(first, mine, message) * a) % L
    return first + s.to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature is the holder's of ``public`` for this message."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _decode(public), _decode(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    k = _number(signature[:32], public, message) % L
    return _encode(_times(s, BASE)) == _encode(_add(r, _times(k, a)))

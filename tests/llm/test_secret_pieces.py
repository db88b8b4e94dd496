"""Random secrets joined to a base span."""

import random

from tessera.llm import secrets as sc


def test_secret_joined_to_a_base_span():
    rng = random.Random(11)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(100):
        secret = "x9" + draw(mixed, 38)
        for first in ("AKIA" + draw(mixed[:26], 16), draw("0123456789abcdef", 32)):
            for joint in "/-":
                for text in (f"a {first}{joint}{secret} b", f"a {secret}{joint}{first} b"):
                    base = sc.base_spans(text)
                    found = sc.entropy_spans(text, base, sc.Rules())
                    assert base and found and all(b[2] <= x[0] or x[2] <= b[0] for b in base for x in found)
                    left = sc.redact(text, base + found)
                    assert not any(secret[i : i + 20] in left for i in range(21))

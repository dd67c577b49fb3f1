"""Labelled findings for the secret scan: tokens of known kinds planted into texts.

No table labels findings, so known ones are planted: keys and passwords (label 1), and
digests, identifiers, paths, numbers, placeholders and long words (label 0), each after the
kind of words it stands behind in code, logs and configuration. The label is the kind that
was planted, never a rule over what the scan measures.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

LOWERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
UPPERS, HEX = LOWERS.upper(), "0123456789abcdef"
# fixed values: names a secret is assigned to, names other values are assigned to, words of placeholders
SECRET = ("password", "passwd", "pwd", "token", "secret", "api_key", "apiKey", "access_key", "auth_token",
          "client_secret", "private-key", "API_KEY", "SECRET_KEY", "db_password", "credential", "Bearer")
DIGEST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "revision", "integrity")
PLAIN = ("id", "uuid", "request_id", "name", "author", "user", "path", "file", "class", "url", "version", "title",
         "branch", "host", "date", "keynote", "tokenizer", "layout", "subject", "ref")
FILLERS = ("REDACTED", "PLACEHOLDER", "EXAMPLE", "changeme", "your", "here", "dummy", "sample", "insert", "todo",
           "masked", "hidden", "replace", "xxxx")
WORD = re.compile(r"[A-Za-z]{3,10}")


class Maker:
    """Draws planted findings; ``words`` are words of the text they go into."""

    def __init__(self, rng: np.random.Generator, words: list[str]) -> None:
        self.rng, self.words = rng, words or ["value", "data", "item"]

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chars(self, alphabet: str, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def some(self, lo: int, hi: int) -> list[str]:
        return [self.one(self.words) for _ in range(int(self.rng.integers(lo, hi + 1)))]

    def behind(self, name: str) -> str:
        """``name`` followed by an assignment."""
        return name + self.one((" = ", "=", ": ", ":", ' = "', '="', ': "', " = '"))

    # label 1
    def key(self) -> tuple[str, str]:
        alphabet = self.one((UPPERS + DIGITS, LOWERS + DIGITS, LOWERS + UPPERS + DIGITS, LOWERS + UPPERS + DIGITS + "-_",
                             LOWERS + UPPERS + DIGITS + "+/"))
        prefix = self.chars(self.one((LOWERS, UPPERS)), 2, 5) + self.one(("", "-", "_")) if self.rng.random() < 0.5 else ""
        if prefix and self.rng.random() < 0.3:
            prefix = prefix.rstrip("-_") + "_" + self.one(("live", "prod", "pat", "bot")) + "_"
        behind = "" if self.rng.random() < 0.4 else self.behind(self.one(SECRET)).replace("Bearer = ", "Bearer ")
        return behind, prefix + self.chars(alphabet, 20, 64)

    def hex_key(self) -> tuple[str, str]:
        return self.behind(self.one(SECRET)), self.chars(HEX, 20, 64) if self.rng.random() < 0.5 else self.chars(HEX, 40, 40)

    def password(self) -> tuple[str, str]:
        words = "".join(self.some(1, 3))
        token = self.one((words.lower(), words + self.chars(DIGITS, 1, 4), self.chars(LOWERS + UPPERS + DIGITS, 8, 16),
                          self.chars(LOWERS + DIGITS, 8, 14)))
        return self.behind(self.one(("password", "passwd", "pwd", "db_password", "secret"))), token

    # label 0
    def digest(self) -> tuple[str, str]:
        n = self.one((32, 40, 64))
        name = self.one(DIGEST)
        return self.one(("", name + " ", name + ":", self.behind(name), self.behind(self.one(PLAIN)))), self.chars(HEX, n, n)

    def uuid(self) -> tuple[str, str]:
        token = "-".join(self.chars(HEX, n, n) for n in (8, 4, 4, 4, 12))
        return self.one(("", self.behind(self.one(PLAIN)), self.one(self.words) + " ")), token

    def path(self) -> tuple[str, str]:
        token = "/".join(self.some(3, 6))
        return self.one(("", "/", self.behind(self.one(PLAIN)), "see ")), self.one((token, token + "/" + self.identifier()[1]))

    def identifier(self) -> tuple[str, str]:
        words = self.some(2, 5)
        token = self.one(("_".join(words).lower(), "_".join(words).upper(), "".join(w.capitalize() for w in words),
                          "-".join(words).lower(), words[0].lower() + "".join(w.capitalize() for w in words[1:])))
        if self.rng.random() < 0.4:
            token += self.one(("", "_", "-")) + self.chars(DIGITS, 1, 4)
        return self.one(("", "see ", self.one(self.words) + " ", self.behind(self.one(PLAIN)),
                         self.behind(self.one(self.words)))), token

    def mixture(self) -> tuple[str, str]:
        """Characters of any kind behind a plain name."""
        return self.behind(self.one(PLAIN[3:])), "".join(self.some(1, 2)) + self.chars(LOWERS + DIGITS, 4, 12)

    def lookup(self) -> tuple[str, str]:
        """Code that gets a secret from elsewhere."""
        return self.behind(self.one(SECRET)), self.one(("get", "load", "read", "fetch")) + "".join(
            w.capitalize() for w in self.some(2, 4))

    def placeholder(self) -> tuple[str, str]:
        parts = [self.one(FILLERS)] + self.some(0, 2) + [self.one(FILLERS)] * int(self.rng.integers(2))
        token = self.one(("_", "-")).join(parts)
        token = self.one((token, token.upper(), token.lower())) + self.one(("", "_1", "_KEY", "-token"))
        return self.behind(self.one(SECRET)), self.one((token, token, "x" * int(self.rng.integers(8, 40))))

    def number(self) -> tuple[str, str]:
        return self.one(("", self.behind(self.one(PLAIN)), "")), self.one(
            (self.chars(DIGITS, 16, 24), "2" + "-".join(self.chars(DIGITS, n, n) for n in (3, 2, 2, 4, 4))))

    def long_word(self) -> tuple[str, str]:
        return self.one(("", self.one(self.words) + " ")), "".join(self.some(2, 5)).lower()


KINDS: list[tuple[int, Callable[[Maker], tuple[str, str]]]] = [
    (1, Maker.key), (1, Maker.key), (1, Maker.key), (1, Maker.hex_key), (1, Maker.hex_key), (1, Maker.password),
    (1, Maker.password), (0, Maker.digest), (0, Maker.uuid), (0, Maker.path), (0, Maker.identifier), (0, Maker.identifier),
    (0, Maker.mixture), (0, Maker.lookup), (0, Maker.placeholder), (0, Maker.number), (0, Maker.long_word)]


def planted(context: str, seed: int, length: int) -> tuple[str, int, int, int, str]:
    """(text, start, end, label, kind): ``context`` with one finding of at least ``length``
    bytes planted between two words; start and end are byte offsets."""
    rng = np.random.default_rng(seed)
    maker = Maker(rng, WORD.findall(context))
    while True:
        label, kind = KINDS[int(rng.integers(len(KINDS)))]
        behind, token = kind(maker)
        if len(token) >= (length if behind.rstrip(" \"'").endswith(("=", ":")) else 2 * length):
            break
    words = context.split(" ")
    at = int(rng.integers(len(words) + 1))
    head = " ".join(words[:at] + [""]) + behind
    quote = behind[-1:] if behind[-1:] in ("'", '"') else ""
    text = head + token + quote + " " + " ".join(words[at:])
    start = len(head.encode())
    return text, start, start + len(token.encode()), label, kind.__name__

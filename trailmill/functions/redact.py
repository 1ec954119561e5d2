"""Redaction of credential-shaped values, family by family on the text as it then is."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmill.functions import fixed

_families = [(name, re.compile(p, re.I if i else 0), label) for name, p, i, label in fixed.FAMILIES]
_auth, _url = re.compile(fixed.AUTH_SCHEME), re.compile(fixed.URL_CREDENTIALS, re.I)
_named = [re.compile(fixed.NAMED, re.I), re.compile(fixed.FLAG, re.I)]
_prefix, _identifier, _wordy = re.compile(fixed.PROVIDER_PREFIX), re.compile(fixed.IDENTIFIER), re.compile(fixed.WORDY, re.I)


def marker(family: str) -> str:
    return f"[REDACTED:{family}]"


def is_placeholder(body: str) -> bool:
    """One repeated character after the provider's prefix, or nothing."""
    return len(set(_prefix.sub("", body, count=1))) < 2


def is_reference(value: str) -> bool:
    """A variable, path, keyword or identifier: named, but no secret."""
    return value.startswith(("[REDACTED", "$", "%", "/", "~", ".")) or bool(_wordy.match(value) or _identifier.match(value))


def redact_text(text: str, known: tuple[str, ...] = ()) -> tuple[str, int]:
    """The text with its credentials replaced by markers, and their number.

    `known` are exact values of at least eight bytes.  A match that is left as it is still
    uses up its span.
    """
    n = 0
    for value in known:
        if len(value.encode()) >= 8:
            n += text.count(value)
            text = text.replace(value, marker("known"))

    def counted(keep, new):
        def change(m):
            nonlocal n
            if keep(m):
                return m[0]
            n += 1
            return new(m)

        return change

    for name, pattern, label in _families:
        head = (lambda m: m[1]) if label else (lambda m: "")
        glued = (lambda m: m.start() > 0 and re.match(r"[A-Za-z0-9-]", m.string[m.start() - 1]) is not None) if name == "sk" else (lambda m: False)
        text = pattern.sub(counted(lambda m: glued(m) or is_placeholder(m[0][len(head(m)) :]), lambda m: head(m) + marker(name)), text)
    text = _auth.sub(counted(lambda m: m[3].isascii() and m[3].isalpha() or m[3].startswith("[REDACTED"), lambda m: m[1] + m[2] + marker("bearer")), text)
    text = _url.sub(counted(lambda m: "[REDACTED" in m[2], lambda m: m[1] + marker("url-password") + m[3]), text)
    for pattern in _named:
        text = pattern.sub(counted(lambda m: is_reference(m[2]), lambda m: m[1] + marker("named")), text)
    return text, n


def redacted(text: str | Column, known: tuple[str, ...] = ()) -> Column:
    """struct(text, redacted) of a text column; null stays null."""

    @F.pandas_udf("text string, redacted long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else redact_text(t, known) for t in texts], columns=["text", "redacted"])

    return run(F.col(text) if isinstance(text, str) else text)

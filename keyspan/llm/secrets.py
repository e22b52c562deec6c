"""Secret scan with a token-efficiency test.

Three fixed patterns give the base spans.  The method adds strings that a
byte-level vocabulary cannot compress: words of natural or programming language
take few tokens for their length, random strings many.  A candidate (a run of
key characters, long enough, with letters) is a secret if it has less than
``RATIO`` characters per token, unless it is a known kind of digest or
identifier.  Letters without digits, or with digits at their end only, may be a
word, so less is asked of them: ``CASED`` if capitals follow small letters,
``PLAIN`` if not.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "random")    # in the order in which equal starts are listed
RATIO = 2.2                 # characters per token below which a string counts as random
CASED, PLAIN = 1.8, 1.6     # the same for strings shaped like words
LEAST = 16                  # characters of a candidate
VOCABULARY = "byte_bpe_50k.tiktoken"
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}(?![A-Za-z0-9+/_=-])" % LEAST)
# known digests and identifiers: hex digests of the usual lengths, UUIDs, numbers, dates and versions,
# words joined by separators
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    r"|sha(?:1|256|384|512)-[A-Za-z0-9+/]+=*"
    r"|[0-9+/_=-]+"
    r"|(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[+/_=-]+)+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)?)\Z")
# no digits, or only behind the letters
WORD = re.compile(r"[A-Za-z+/_=-]+[0-9]*[+/_=-]*\Z")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding of a rank file, one per worker process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                             special_tokens={})
    return _encodings[path]


def random_string(s: str, path: str) -> bool:
    """Whether a candidate fails the token-efficiency test."""
    if KNOWN.match(s) or not re.search("[A-Za-z]", s):
        return False
    ratio = RATIO if not WORD.match(s) else CASED if re.search("[a-z][A-Z]", s) else PLAIN
    return len(s) < ratio * len(encoding(path).encode_ordinary(s))


def find(text: str | None, path: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), in code points, by start and
    then by kind.  A string that a base span touches is not added again."""
    if not text:
        return []
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base.sort(key=lambda x: x[1])
    added, at, far = [], 0, 0
    for m in CANDIDATE.finditer(text):
        # the end of the furthest base span that starts before the candidate's end
        while at < len(base) and base[at][1] < m.end():
            far = max(far, base[at][2])
            at += 1
        if far <= m.start() and random_string(m.group(), path):
            added.append(("random", m.start(), m.end()))
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def spans(text: Column, vocabulary: str | None = None) -> Column:
    """The secrets of a text, array<struct<kind,start,end>>; null or empty
    texts have none.  Only the text itself passes through Python."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t, path)] for t in texts],
                            dtype=object)

    return scan(text)


def scanned(docs: DataFrame, text_col: str = "text", name: str = "spans", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the secrets of every text in a column ``name``."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, spans(F.col(text_col), vocabulary))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "<secret>",
           vocabulary: str | None = None) -> DataFrame:
    """Every row of ``docs`` with all its columns; secrets in the text are
    replaced by ``mark`` (overlapping spans by one mark) and the length column
    follows.  Rows without a secret stay as they are, null texts too."""
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask(t, find(t, path), mark) for t in texts], dtype=object)

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast("long"))
                             .otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out


def mask(text: str | None, found: list[tuple[str, int, int]], mark: str) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for _, a, b in found:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])

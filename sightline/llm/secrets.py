"""Secret scans: named patterns, and strings that a tokenizer finds hard to compress.

Words of natural text are few tokens for their length; keys and passwords are not. A
candidate is a run of ``[A-Za-z0-9+/_.=-]`` that holds letters and digits and is long
enough; what a byte-pair vocabulary needs more than one token per
``max_chars_per_token`` characters for is reported as kind ``random``, unless it is a
known public form: a digest of a usual length, a UUID, a date, a version, a name, or
plain numbers. Hosts with paths and file names, and runs that are not dense as a whole, are
cut at ``=``, then at ``/``, then at dots, and each part is a candidate of its own.

Spans are ``kind, start, end`` in code points, end exclusive. Null texts are empty and
have no spans; the whole text is scanned, whatever its length; repeated rows are scanned
each for itself; other columns of the table are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import words

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The base kinds in the order in which they are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Lengths of hexadecimal digests in common use (CRC-32, MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (8, 32, 40, 56, 64, 96, 128)
# The split pattern of the vocabulary's tokenizer.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PUBLIC = re.compile(
    r"[-+/_.=0-9]*"  # numbers, dates, versions
    r"|[A-Za-z]+([-_./][A-Za-z]+)*[-_./]?[0-9]{0,4}"  # names and paths with a number at the end
)
_HOST = re.compile(r"([A-Za-z0-9-]+\.)+[A-Za-z]{2,6}(/[A-Za-z0-9_.=-]*)*")  # hosts and files
_ANY_BASE = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each base pattern that are long enough, kind by kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]


def is_public_form(run: str) -> bool:
    """Whether a run has the form of a digest, an identifier or a name."""
    if _UUID.fullmatch(run) or _PUBLIC.fullmatch(run):
        return True
    hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", run)
    return bool(hexadecimal) and len(run) in DIGEST_LENGTHS


def random_spans(
    text: str, count_tokens: Callable[[str], int], least: int, max_chars_per_token: float
) -> list[tuple[str, int, int]]:
    """Runs, or parts of runs, that need more tokens than text of their length does."""
    found = []

    def look(run: str, start: int) -> None:
        start, run = start + len(run) - len(run.lstrip("=.-_/")), run.strip("=.-_/")
        if len(run) < least or is_public_form(run):
            return
        if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
            return
        if "=" not in run and not _HOST.fullmatch(run) and len(run) <= max_chars_per_token * count_tokens(run):
            found.append(("random", start, start + len(run)))
            return
        mark = next((c for c in "=/." if c in run), None)  # a name before the value, a path, a host or file
        for part in run.split(mark) if mark else []:
            look(part, start)
            start += len(part) + 1

    for m in _RUN.finditer(text):
        look(m[0], m.start())
    return found


def written(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def load_vocabulary(vocabulary: bytes) -> Callable[[str], int]:
    """Token counter of a vocabulary of lines ``base64 rank``."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    encoding = tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def scan_secrets(
    docs: DataFrame,
    vocabulary: str = DEFAULT_VOCABULARY,
    least: int = 20,
    max_chars_per_token: float = 2.0,
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` for every row.

    vocabulary: file of the token ranks; it is read once on the driver (under 1 MB) and
    sent to the executors with the function.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    nothing = hashlib.sha256(b"").hexdigest()
    candidate = r"[A-Za-z0-9+/_.=-]{%d}" % least

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_tokens = None
        for batch in words.slices(batches, "text"):
            texts = batch.column("text")
            rows = [(0, 0, 0, 0, nothing, "")] * len(texts)
            based = pc.fill_null(pc.match_substring_regex(texts, _ANY_BASE), False).to_pylist()
            dense = pc.fill_null(pc.match_substring_regex(texts, candidate), False).to_pylist()
            for i, (b, d) in enumerate(zip(based, dense)):
                if not (b or d):
                    continue
                text = texts[i].as_py()
                base = base_spans(text) if b else []
                if d and count_tokens is None:
                    count_tokens = load_vocabulary(ranks.value)
                extra = random_spans(text, count_tokens, least, max_chars_per_token) if d else []
                count = [sum(k == kind for k, _, _ in base + extra) for kind in KINDS]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows[i] = (*count, digest, written(base + extra))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema_names(schema))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]

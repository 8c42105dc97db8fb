"""Secret scanning: fixed patterns, plus assignment-aware lexing.

The lexer reads source and configuration syntax (``name = value``, ``name: value``,
``"name": "value"``, ``name := value``, ``name => value``) into pairs of a target
name and an expression of literals, names and ``+``.  Constants are propagated:
a name that was given literals stands for them in later expressions.  Literals
that reach a target are scored by how sensitive the target's name is and by how
little the literal looks like a word or a placeholder.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import read_table

#: The fixed patterns; letters of the assign words are in either case (ASCII only).
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "named")

STRING = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
TERM = rf"(?:{STRING}|[\w./+=$@-]++)"
PAIR = re.compile(
    rf"(?<![\w.$-])(?P<quote>[\"']?)(?P<name>[A-Za-z_$][\w.$-]*+)(?P=quote)\]?[ \t]*+(?:=>|:=|=(?![=>])|:(?![:/]))[ \t]*+"
    rf"(?P<expr>{TERM}(?:[ \t]*+\+[ \t]*+{TERM})*+)"
)
LEAF = re.compile(rf"(?P<string>{STRING})|(?P<bare>[\w./+=$@-]++)")
NAME = re.compile(r"[A-Za-z_$][\w.$-]*")
#: Weight of a target name by the parts it is made of; the largest counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9,
    "signingkey": 0.9, "encryptionkey": 0.9, "clientsecret": 1.0, "authorization": 0.7,
}
STEMS = re.compile(r"pass|pwd|secret|token|key|credential|bearer|authorization", re.ASCII)
PLACEHOLDER = re.compile(r"(?i:change.?me|example|placeholder|your[_-]|dummy|sample|redacted|undefined|none$|null$|true$|false$)|^(.)\1*$|^[<$%{*]")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
THRESHOLD = 0.5


def name_weight(name: str) -> float:
    """Sensitivity of a target name, by its parts and pairs of neighbouring parts."""
    parts = [p.lower() for p in PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


def literal_weight(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret rather than a word or placeholder."""
    if len(value) < 8 or PLACEHOLDER.search(value):
        return 0.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    weight = min(1.0, bits / 3.2) * (1.0 if kinds >= 2 else 0.45)
    if any(c.isspace() for c in value):
        weight *= 0.5
    return weight if quoted else weight * (1.0 if any(c.isdigit() for c in value) else 0.4)


def named_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that sensitive names are given, directly or through constants.

    An assignment keeps its own literals and the assignments that the names in it stood
    for, not a copy of what those hold, so the work is linear in the text however constants
    are built on each other.  A literal counts with the heaviest target that it reaches.
    """
    literals: list[list[tuple[int, int, bool]]] = []
    origins: list[list[int]] = []
    targets: list[tuple[float, int]] = []
    known: dict[str, int] = {}
    for number, pair in enumerate(PAIR.finditer(text)):
        own: list[tuple[int, int, bool]] = []
        behind: dict[int, None] = {}
        for leaf in LEAF.finditer(text, *pair.span("expr")):
            if leaf["string"]:
                own.append((leaf.start() + 1, leaf.end() - 1, True))
            elif leaf["bare"] in known:
                behind[known[leaf["bare"]]] = None
            else:
                own.append((*leaf.span(), False))
        literals.append(own)
        origins.append(list(behind))
        known[pair["name"]] = number
        if weight := name_weight(pair["name"]):
            targets.append((weight, number))
    found, seen = [], set()
    for weight, target in sorted(targets, key=lambda t: -t[0]):
        reached = [target]
        while reached:
            if (number := reached.pop()) in seen:
                continue
            seen.add(number)
            reached += origins[number]
            found += [(a, b) for a, b, quoted in literals[number] if weight * literal_weight(text[a:b], quoted) >= THRESHOLD]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in order."""
    low, spans = text.lower(), []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those together with the lexer's (those inside a base span are left out)."""
    base = base_spans(text)
    if not ("=" in text or ":" in text) or not STEMS.search(text.lower()):
        return base, base
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    # a base span that starts at or before a, and the furthest end of those
    more = [(a, 3, b) for a, b in named_literals(text) if not (at := bisect_right(starts, a)) or reach[at - 1] < b]
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Null and empty texts have no spans (and the digest of the empty string);
    repeated rows stay repeated; null ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_spans(t.as_py() or "") for t in batch.column(1)]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([_joined(s) for _, s in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = cols.schema["doc_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlaps merged, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col`` and ``length_col`` set to the new length.

    Rows, order of columns and all other values stay; a null text stays null and
    rows without secrets are untouched.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names.index(text_col)).to_pylist()
            new = [t if t is None else redacted(t, mark) for t in old]
            cols = batch.columns
            cols[names.index(text_col)] = pa.array(new, batch.schema.field(names.index(text_col)).type)
            if length_col in names:
                at = names.index(length_col)
                lengths = [n if a == b else len(b) for n, a, b in zip(cols[at].to_pylist(), old, new, strict=True)]
                cols[at] = pa.array(lengths, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))

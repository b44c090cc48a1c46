"""Secret scans with multipart credential linking."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Patterns of weak parts. Names are in either case, prefixes of access identifiers in capitals only.
KEY_ID = re.compile(r"""(?<![A-Za-z0-9])(?:(?i:(?:access|client|account|tenant|app|key)[_\x20-]?(?:key[_-]?)?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{4,})|(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{4,})""", re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|sftp|ftp)://[^\s"'<>]{4,}|(?<![A-Za-z0-9.])(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+(?::\d+)?)""", re.ASCII | re.IGNORECASE)

KINDS = ["assign", "access", "hex", "key_id", "weak_secret", "endpoint"]
#: The scope of linking, in production: parts belong together within one paragraph and a gap of so many characters. Least bits a character of an opaque string.
REACH, ENTROPY = 400, 3.5

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, number of kind, end) of the base patterns, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def paragraphs(text: str) -> list[int]:
    """Starts of the scopes: paragraphs, which a blank line ends."""
    return [0, *(m.end() for m in re.finditer(r"\n[\x20\t]*\n", text))]


def linked_spans(text: str, base: list[Span], reach_chars: int | None = REACH) -> list[Span]:
    """Weak candidates whose complementary parts stand in the same scope.

    Identifiers, secrets and endpoints are intervals; those of one paragraph with a gap of `reach_chars` characters or fewer between them (None: of any width) are joined by a sorted search, so the cost is n log n in the
    candidates and no pairs are built. A weak secret needs an identifier or an endpoint; a weak identifier needs a secret; an endpoint needs both an identifier and a secret.
    Base spans count as strong parts. A weak candidate inside a base span is not one.
    """
    if not (":" in text or "=" in text or "AKIA" in text or "ASIA" in text or "AIDA" in text or "AROA" in text):
        return []
    gap = len(text) if reach_chars is None else reach_chars
    starts, reach = [s for s, _, _ in base], []
    for s, _, e in base:
        reach.append(max(e, reach[-1]) if reach else e)

    def free(s: int) -> bool:
        k = bisect.bisect_right(starts, s)
        return k == 0 or reach[k - 1] <= s

    ids = [(m.start(), 3, m.end()) for m in KEY_ID.finditer(text) if free(m.start())]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text) if free(m.start())]
    strong_ids, strong_secrets = [x for x in base if x[1] == 1], [x for x in base if x[1] != 1]
    if not (ids or ends or strong_ids):
        return []
    taken = sorted([*ids, *ends])
    begins, far = [s for s, _, _ in taken], []
    for _, _, e in taken:
        far.append(max(e, far[-1]) if far else e)

    def outside(s: int) -> bool:
        k = bisect.bisect_right(begins, s)
        return k == 0 or far[k - 1] <= s

    weak = [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if free(m.start()) and outside(m.start()) and any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])) and entropy(m[0]) >= ENTROPY]
    scopes = paragraphs(text)

    def near(spans: list[Span]):
        held = sorted(spans)
        places, last = [s for s, _, _ in held], list(accumulate((e for _, _, e in held), max))

        def there(s: int, e: int) -> bool:
            k = bisect.bisect_right(scopes, s) - 1
            high = min(scopes[k + 1] - 1 if k + 1 < len(scopes) else len(text), e + gap)
            at = bisect.bisect_right(places, high)
            return at > 0 and last[at - 1] > scopes[k] and last[at - 1] >= s - gap  # no span goes over a blank line

        return there

    by_id, by_secret, by_end = near([*ids, *strong_ids]), near([*weak, *strong_secrets]), near(ends)
    out = [x for x in weak if by_id(x[0], x[2]) or by_end(x[0], x[2])]
    out += [x for x in ids if by_secret(x[0], x[2])]
    out += [x for x in ends if by_id(x[0], x[2]) and by_secret(x[0], x[2])]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """Spans of secrets in every whole text, without a shuffle; a null text is empty. reach: widest gap between linked parts of a paragraph (None: any).

    Returns doc_id, spans: array of (kind, start, end) in code points, end exclusive, by start and then KINDS; base: whether a base pattern found it. Ids may be null or repeated; other columns
    are ignored; a text without secrets has an empty array; an empty table gives an empty one.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = sorted([*base, *linked_spans(text or "", base, reach)])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], names=["doc_id", "spans"])

    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of documents, one row each. A null or empty text has no spans, counts of 0 and the digest of nothing; repeated rows and null ids get rows of their own."""
    found = scan(table(spark, sf_dir, "documents"))
    form = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(form(base), 256).alias("base_sha256"), form(F.col("spans")).alias("spans"))


def brute_base(text: str) -> list[Span]:
    """The base spans as their definition reads, for tests."""
    found = []
    for k, (pattern, flags, least) in enumerate([(ASSIGN.pattern, re.I | re.A, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24)]):
        at = 0
        while m := re.compile(pattern, flags).search(text, at):
            if len(m[2] if k == 0 else m[0]) >= least:
                found.append((m.start(), k, m.end()))
            at = m.end()
    return sorted(found)


def brute_links(text: str, base: list[Span], reach: int | None = REACH) -> list[Span]:
    """The linked spans by trying all pairs of parts, for tests."""
    inside = lambda s, spans: any(x <= s < y for x, _, y in spans)
    ids = [(m.start(), 3, m.end()) for m in KEY_ID.finditer(text) if not inside(m.start(), base)]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text) if not inside(m.start(), base)]
    weak = [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if not inside(m.start(), [*base, *ids, *ends]) and any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])) and entropy(m[0]) >= ENTROPY]

    def meets(x: Span, others: list[Span]) -> bool:
        together = lambda y: not re.search(r"\n[\x20\t]*\n", text[min(x[0], y[0]) : max(x[0], y[0])])
        return any(together(y) and (reach is None or max(x[0], y[0]) - min(x[2], y[2]) <= reach) for y in others)

    all_ids, secrets = [*ids, *(x for x in base if x[1] == 1)], [*weak, *(x for x in base if x[1] != 1)]
    return sorted([x for x in weak if meets(x, all_ids) or meets(x, ends)] + [x for x in ids if meets(x, secrets)] + [x for x in ends if meets(x, all_ids) and meets(x, secrets)])


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()

"""Secret scan with multipart credential linking.

Strong findings (an assignment to a secret's name, an access identifier, a long hex string) stand
alone. Weak parts (an account name, a token of mixed characters, an endpoint) are reported only if
complementary parts lie within one scope of `window` code points: a bucketed interval join of the
parts on their text and scope. Null and empty texts have no findings; repeated rows are scanned
each on their own; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

#: Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", "account", "token", "endpoint")
WINDOW = 200

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as the shorter ones fall away
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

ACCOUNT = re.compile(r"""(?ai:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}\b")
ACCOUNT_NAMES = ("user", "login", "account", "clientid", "client_id", "accesskey", "access_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of the strong findings, in order."""
    found, low = [], text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that mean nothing alone; those inside a strong finding are left out."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(n in low for n in ACCOUNT_NAMES):
            found += [(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    for m in MIXED.finditer(text):
        t = m.group()
        if any(c.islower() for c in t) and any(c.isupper() for c in t) and any(c.isdigit() for c in t):
            found.append((m.start(), 4, m.end()))
    starts, reach = [s for s, _, _ in strong], list(accumulate((e for _, _, e in strong), max))
    inside = lambda s, e: (k := bisect_right(starts, s)) > 0 and e <= reach[k - 1]
    return [p for p in found if not inside(p[0], p[2])]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for b in slices(batches):
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "weak")}
        for text in b.column("text").to_pylist():
            strong = base_spans(text or "")
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in strong))
            out["base_sha256"].append(hashlib.sha256(joined(strong).encode()).hexdigest())
            out["base"].append([dict(start=s, kind=k, end=e) for s, k, e in strong])
            out["weak"].append([dict(start=s, kind=k, end=e) for s, k, e in weak_parts(text or "", strong)])
        kinds = {"base_sha256": pa.string(), "base": span, "weak": span}
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], ["doc_id", *out])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts and spans of the strong findings, and the weak parts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base {SPAN}, weak {SPAN}")


def linked_parts(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of parts (rid, start, kind, end): those within `window` of a complement in the same text.

    Secrets (token, hex, assign) need an account, access identifier or endpoint, and these need a secret.
    Each side goes to the buckets of `window` that it reaches, so rows meet only neighbours, and a
    semi-join reports each part once however many complements it has."""
    secret = F.col("kind").isin(0, 2, 4)
    wide = lambda d: d.withColumn("bucket", F.explode(F.sequence(F.expr(f"floor(greatest(start - {window}, 0) / {window})"), F.expr(f"floor((end + {window}) / {window})"))))
    a, b = wide(parts.where(secret)), wide(parts.where(~secret))
    near = lambda x, y: x.alias("x").join(y.alias("y"), F.expr(f"x.rid = y.rid and x.bucket = y.bucket and x.start <= y.end + {window} and y.start <= x.end + {window}"), "left_semi").select("rid", "start", "kind", "end")
    return near(a, b).unionByName(near(b, a)).distinct()


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for every row of docs."""
    scanned = cut(scan(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    with_weak = scanned.where(F.size("weak") > 0)
    parts = with_weak.select("rid", F.inline(F.concat("base", "weak")))
    extra = linked_parts(parts, window).where("kind > 2").groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return scanned.join(extra, "rid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).alias("n_linked"))


#: Texts with linked parts whose spans may be broadcast; copies of these spans that meet the documents otherwise.
BROADCAST_TEXTS, SALT = 100_000, 16


def linked_by_text(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(digest, extra): the linked weak parts of each distinct text of (digest, text) that has any."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for digest, text in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                strong = base_spans(text)
                weak = weak_parts(text, strong)
                out += [(digest, *p) for p in (*strong, *weak)] if weak else []
            cols = [*zip(*out, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int32()] * 3), strict=True)], ["rid", "start", "kind", "end"])

    found = cut(texts.where("text is not null").mapInArrow(parts, "rid string, start int, kind int, end int").distinct())
    return linked_parts(found, window).where("kind > 2").groupBy(F.col("rid").alias("digest")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", window: int = WINDOW) -> DataFrame:
    """docs with every strong finding and every linked part in the text replaced by mask, all other columns as they were.

    n_chars, if there, follows the new text. Overlapping findings are replaced as one. The parts of equal texts
    are linked once; their spans go to the documents by broadcast where they are counted to be few, else by salted digest."""
    kept = docs.schema.names
    digest = F.md5(F.col(text_col).cast("binary"))
    extra = cut(linked_by_text(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), window)).withColumnsRenamed({"digest": "__digest", "extra": "__extra"})
    if extra.count() <= BROADCAST_TEXTS:
        marked = docs.join(F.broadcast(extra), digest == F.col("__digest"), "left")
    else:
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALT)))
        copies = extra.withColumn("__own", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        marked = salted.join(copies, (digest == F.col("__digest")) & (F.col("__salt") == F.col("__own")), "left")

    def hide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, sizes = [], []
            for text, linked in zip(b.column(text_col).to_pylist(), b.column("__extra").to_pylist(), strict=True):
                parts, at = [], 0
                for s, e in sorted([(s, e) for s, _, e in base_spans(text or "")] + [(x["start"], x["end"]) for x in linked or ()]):
                    if s >= at:
                        parts += [text[at:s], mask]
                    at = max(at, e)
                texts.append("".join(parts) + text[at:] if parts else text)
                sizes.append(None if text is None else len(texts[-1]))
            cols = {k: b.column(k) for k in kept}
            cols[text_col] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array(sizes, pa.int64()).cast(b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), kept)

    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return marked.select(*kept, "__extra").mapInArrow(hide, nullable)
